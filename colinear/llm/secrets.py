"""Secret scans: character Markov models of random strings and ordinary identifiers, compared by log-likelihood ratio."""

from __future__ import annotations

import hashlib
import importlib
import inspect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.llm.words import column
from colinear.session import forget, stored, table

# The base rules of the contract, in the order that breaks ties. Letters are ASCII.
RULES = {
    "assign": (re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 2, 8),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(rb"[0-9a-f]+"), 0, 32),
}
#: What the method adds.
KIND = "random"
KINDS = [*RULES, KIND]
RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{16,}")
#: Characters that the random model leads on at least; up to EDGE more letters or digits at either end go with them.
LEAST, EDGE = 12, 4
#: Labelled samples: ordinary runs (lowest by hash over the whole corpus) and generated strings of each alphabet, at most.
SAMPLE = 4000
#: Nats by which the random model must lead: random strings are taken to be one candidate in e^16.
LEAD = 16.0
#: Weight of the next lower order in a context's estimate.
SMOOTH = 48.0

# The characters that a candidate can have, and the alphabets of keys.
CHARS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_.=-"
ALPHABETS = {
    "hex": b"0123456789abcdef",
    "upper": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"0123456789abcdefghijklmnopqrstuvwxyz",
    "mixed": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "url64": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-",
}
ORDINARY = "ordinary"
#: Public modules whose names and documentation are labelled samples of ordinary identifiers, words, paths and addresses.
MODULES = ("argparse", "asyncio", "collections", "csv", "datetime", "decimal", "email.message", "http.client", "inspect", "json", "logging", "os", "pathlib", "pyspark.sql.functions", "shutil", "socket", "ssl", "statistics", "subprocess", "threading", "typing", "unittest.mock", "urllib.parse", "urllib.request", "xml.dom.minidom", "zipfile")
_N = len(CHARS) + 1  # one more symbol for the start of a run
_CODE = np.full(256, len(CHARS), np.int32)
_CODE[np.frombuffer(CHARS, np.uint8)] = np.arange(len(CHARS))


def base_spans(text: bytes) -> list[tuple[int, int, str, bytes]]:
    """(start, end, kind, value) of the base rules in bytes: leftmost non-overlapping matches of each kind, those too short dropped."""
    out = []
    for kind, (rule, group, least) in RULES.items():
        out += [(m.start(), m.end(), kind, m[group]) for m in rule.finditer(text) if len(m[group]) >= least]
    return out


def _outside(text: bytes, spans: list[tuple[int, int, str, bytes]]) -> bytes:
    """The text with a space in place of each byte of a span."""
    if not spans:
        return text
    cut = bytearray(text)
    for start, end, *_ in spans:
        cut[start:end] = b" " * (end - start)
    return bytes(cut)


_WORDS = re.compile(rb"[A-Za-z0-9][A-Za-z0-9+/_.=-]{5,}")
_JOINS = (b"_", b"", b"-", b".", b"/", b"=")


def ordinary_runs(docs: DataFrame, n: int = SAMPLE) -> DataFrame:
    """(doc_id, text) -> (value, label): the n distinct runs of 6 characters or more of the lowest hash, outside base spans.

    Every task keeps its n lowest (a bottom-k sketch), so the sample is that of the whole corpus whatever the partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, bytes] = {}
        cut = 1 << 64
        for batch in batches:
            for text in column(batch, "text"):
                if not text:
                    continue
                for value in set(_WORDS.findall(_outside(text, base_spans(text)))):
                    h = xxhash.xxh64_intdigest(value, 12)
                    if h < cut:
                        best[h] = value
                if len(best) > 2 * n:
                    keep = sorted(best)[:n]
                    cut = keep[-1]
                    best = {h: best[h] for h in keep}
        keep = sorted(best)[:n]
        yield pa.RecordBatch.from_arrays([pa.array([best[h] for h in keep], pa.binary()), pa.array(np.array(keep, np.uint64).view(np.int64))], ["value", "h"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "value binary, h long")
    # unsigned order, as in the tasks
    return found.distinct().orderBy(F.col("h") < 0, "h").limit(n).select("value", F.lit(ORDINARY).alias("label"))


def random_strings(spark: SparkSession, n: int = SAMPLE, seed: int = 12) -> DataFrame:
    """(value, label): n generated strings of 16 to 64 characters of each alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, labels = [], []
            for i in batch.column(0).to_pylist():
                for label, alphabet in ALPHABETS.items():
                    bits = int.from_bytes(b"".join(hashlib.sha512(f"{seed}:{label}:{i}:{k}".encode()).digest() for k in range(2)), "big")
                    value = bytearray()
                    for _ in range(16 + i % 49):
                        bits, at = divmod(bits, len(alphabet))
                        value.append(alphabet[at])
                    values.append(bytes(value))
                    labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(labels)], ["value", "label"])

    return spark.range(n).mapInArrow(run, "value binary, label string")


def documentation(modules: tuple[str, ...] = MODULES) -> list[bytes]:
    """Distinct runs of 6 characters or more of the public names and docstrings of modules: ordinary text of programs."""
    found: set[bytes] = set()
    for name in modules:
        module = importlib.import_module(name)
        for at, x in [(name, module), *inspect.getmembers(module)]:
            inner = inspect.getmembers(x) if inspect.isclass(x) else []
            for text in (f"{name}.{at}", at, inspect.getdoc(x) if callable(x) or x is module else "", *(f"{at}.{n} {n} {inspect.getdoc(y) if callable(y) else ''}" for n, y in inner)):
                found.update(_WORDS.findall((text or "").encode()))
    return sorted(found)


def regular() -> list[bytes]:
    """Rulers, rows of keys, the alphabet and counts: regular runs that are no words."""
    rows = [b"qwertyuiop", b"asdfghjkl", b"zxcvbnm", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"1234567890", b"01234567890abcdef"]
    return [bytes([c]) * 24 for c in CHARS] + [x for r in rows for x in (2 * r, r.upper() * 2, r[::-1])]


def compounds(values: list[bytes]) -> list[bytes]:
    """Identifiers, paths and versions as programs write them, put together from ordinary runs that stand next to each other in hash order."""
    out = []
    for i, (a, b) in enumerate(zip(values, values[1:])):
        if i % 3 == 0:
            out.append(a + b[:1].upper() + b[1:])
        elif i % 3 == 1:
            out.append((a + b"_" + b).upper())
        else:
            out.append(a + _JOINS[i % len(_JOINS)] + b + str(i * 7919 % 10000).encode())
    return out


def fit(samples: DataFrame) -> tuple[np.ndarray, list[str]]:
    """(value binary, label) -> (table, labels): log-likelihood ratios [label, two characters before, character] against `ordinary`.

    Markov models, of second order for ordinary text and of first order for random strings, each order smoothed by the next lower
    one, from counts that Spark sums: at most (characters + 1)^3 of them a label, whatever the samples. Values of other characters
    are cut at them. Without ordinary samples that model is uniform; no other label: an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, values = np.array(column(batch, "label"), object), column(batch, "value")
            for label in sorted(set(labels)):
                flat, starts = _joined([v for v, x in zip(values, labels) if x == label])
                context = _contexts(flat, starts)
                keys, n = np.unique((context if label == ORDINARY else context % _N) * _N + flat, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["label", "key", "n"])

    counts = samples.mapInArrow(run, "label string, key long, n long").groupBy("label", "key").agg(F.sum("n").alias("n"))
    grids: dict[str, np.ndarray] = {}
    for r in counts.collect():  # bounded by the characters, not by the samples
        grids.setdefault(r.label, np.zeros(_N**3))[r.key] = r.n
    models = {label: _smoothed(grid.reshape(_N, _N, _N), label == ORDINARY) for label, grid in grids.items()}
    ordinary = models.pop(ORDINARY, np.full((_N, _N, _N), 1 / len(CHARS)))
    labels = sorted(models)
    return np.stack([np.log(models[x] / ordinary) for x in labels]).astype(np.float32) if labels else np.zeros((0, _N, _N, _N), np.float32), labels


def _smoothed(counts: np.ndarray, second: bool) -> np.ndarray:
    """Probabilities of a character after two others; not second: after one, whatever stands before."""
    counts = counts.copy()
    counts[:, :, -1] = 0  # other characters are never predicted
    one = counts.sum((0, 1))
    p1 = (one + 1 / len(CHARS) * SMOOTH) / (one.sum() + SMOOTH)
    two = counts.sum(0)
    p2 = (two + SMOOTH * p1) / (two.sum(1, keepdims=True) + SMOOTH)
    if not second:
        return np.broadcast_to(p2, counts.shape)
    return (counts + SMOOTH * p2[None]) / (counts.sum(2, keepdims=True) + SMOOTH)


def _joined(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(character codes of all runs one after another, where each starts)."""
    return _CODE[np.frombuffer(b"".join(runs), np.uint8)], np.cumsum([0, *map(len, runs)])[:-1]


def _contexts(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two characters before each, as one number; none before a run's start."""
    none = len(CHARS)
    before = np.concatenate([[none], flat[:-1]])[: len(flat)]
    starts = starts[starts < len(flat)]
    before[starts] = none
    second = np.concatenate([[none], before[:-1]])[: len(flat)]
    second[starts] = none
    return second * _N + before


def segments(steps: np.ndarray, lead: float = LEAD, least: int = LEAST) -> list[tuple[int, int, float]]:
    """(start, end, ratio) of the stretches whose summed log-likelihood ratio leads by `lead`: each from where the running
    ratio leaves its minimum to where it peaks before it is used up; the rest behind a peak is searched again."""
    out, todo = [], [(0, len(steps))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        total = np.concatenate([[0.0], np.cumsum(steps[a:b], dtype=np.float64)])
        low = np.minimum.accumulate(total)
        over = total - low
        bounds = np.flatnonzero(over == 0)
        for s, e in zip(bounds, [*bounds[1:], len(total)]):
            if e - s <= least:
                continue
            peak = int(s + over[s:e].argmax())
            if over[peak] >= lead and peak - s >= least:
                out.append((a + int(s), a + peak, float(over[peak])))
                todo.append((a + peak, a + int(e) - 1))
    return sorted(out)


def _whole(run: bytes, start: int, end: int) -> tuple[int, int]:
    """A stretch with the letters or digits beside it, if no more than EDGE stand there: ends of a secret may look like words."""
    a, b = start, end
    while a and run[a - 1 : a].isalnum():
        a -= 1
    while b < len(run) and run[b : b + 1].isalnum():
        b += 1
    return (a if start - a <= EDGE else start), (b if b - end <= EDGE else end)


def random_spans(texts: list[bytes], model: np.ndarray, lead: float = LEAD, block: int = 1 << 18) -> list[list[tuple[int, int, float]]]:
    """For each text (start, end, ratio) in bytes of the parts of its runs that the best random model leads on."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    if not len(model):
        return out
    table = model.reshape(len(model), -1)
    runs, size = [], 0

    def flush() -> None:
        flat, starts = _joined([r for _, _, r in runs])
        at = _contexts(flat, starts) * _N + flat
        steps = table[:, at]
        hopes = np.add.reduceat(np.maximum(steps, 0).max(0), starts)  # no stretch of the run can have more
        ends = [*starts[1:], len(flat)]
        for k in np.flatnonzero(hopes >= lead):
            i, begin, run = runs[k]
            best: list[tuple[int, int, float]] = []
            for s, e, ratio in sorted((x for row in steps[:, starts[k] : ends[k]] for x in segments(row, lead)), key=lambda x: (-x[2], x)):
                s, e = _whole(run, s, e)
                if all(e <= a or s >= b for a, b, _ in best):  # of models that overlap the surest
                    best.append((s, e, ratio))
            out[i] += [(begin + s, begin + e, ratio) for s, e, ratio in sorted(best)]
        runs.clear()

    for i, text in enumerate(texts):
        for m in RUN.finditer(text):
            runs.append((i, m.start(), m[0]))
            size += len(m[0])
            if size >= block:
                flush()
                size = 0
    if runs:
        flush()
    return out


_FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("ratio", pa.float64())])))])


def found(docs: DataFrame, model: np.ndarray, lead: float = LEAD) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_assign, n_access, n_hex, n_random, spans), a row for each row.

    spans: (start, end, kind, value, ratio) in code points, end exclusive, by start, then kind as listed in KINDS. Base spans have no
    ratio; a random one that meets a base span is left out. Whole texts are read; null and empty ones have no span.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # labels x (characters + 1)^3 floats, whatever the corpus
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = [t or b"" for t in column(batch, "text")]
            base = [base_spans(t) for t in texts]
            more = random_spans([_outside(t, b) for t, b in zip(texts, base)], table, lead)
            rows = []
            for text, own, new in zip(texts, base, more):
                every = [(s, e, k, text[s:e], None) for s, e, k, _ in own] + [(s, e, KIND, text[s:e], ratio) for s, e, ratio in new]
                every.sort(key=lambda x: (x[0], rank[x[2]]))
                spans, read, chars = [], 0, 0
                for s, e, k, value, ratio in every:  # all spans are ASCII
                    chars += len(text[read:s].decode("utf-8", "replace"))
                    read = s
                    spans.append({"start": chars, "end": chars + e - s, "kind": k, "value": value.decode(), "ratio": ratio})
                rows.append({**{f"n_{k}": sum(x["kind"] == k for x in spans) for k in KINDS}, "spans": spans})
            out = pa.RecordBatch.from_pylist([{"doc_id": None, **r} for r in rows], schema=_FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns[1:]], schema=_FOUND)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, spans array<struct<start: long, end: long, kind: string, value: string, ratio: double>>")


def samples(docs: DataFrame, n: int = SAMPLE) -> DataFrame:
    """(value, label): n ordinary runs of the corpus at most, compounds of them, documented identifiers, and n generated strings of each alphabet."""
    runs = ordinary_runs(docs, n)
    values = sorted(bytes(r.value) for r in runs.select(F.substring("value", 1, 200).alias("value")).collect())  # n short strings
    values.sort(key=lambda v: xxhash.xxh64_intdigest(v, 13))
    spark = docs.sparkSession
    known = documentation()
    ordinary = values + compounds(values) + known + compounds(known) + 3 * regular()
    joined = spark.createDataFrame([(x, ORDINARY) for x in ordinary], "value binary, label string")
    return joined.union(random_strings(spark, n))


def scanned(docs: DataFrame, lead: float = LEAD) -> DataFrame:
    """found() with models trained on docs themselves and generated strings."""
    known = stored(samples(docs))
    model, _ = fit(known)
    forget(known)
    return found(docs, model, lead)


def digests(spans: DataFrame) -> DataFrame:
    """found() -> doc_id, the counts, base_sha256 and spans as text."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    joined = lambda c: F.array_join(F.transform(c, text), ",")
    base = F.filter("spans", lambda x: x["kind"] != KIND)
    return spans.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scanned(table(spark, sf_dir, "documents")))
