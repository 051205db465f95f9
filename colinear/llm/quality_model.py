"""Ordinal cumulative-link regression over hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.llm.words import alnum, column
from colinear.session import table

#: Labelled documents that the fit uses at most, those of the lowest hash of doc_id; all others are only scored.
SAMPLE = 20_000
BUCKETS = 1 << 18
#: A document is kept if the probability of the top grade reaches this.
KEEP = 0.5
ROUNDS, RATE, DECAY = 500, 0.1, 1e-3
#: Buckets enter the fit if they are in LEAST_DOCS rated documents and some grade's share among those is off by so many
#: standard errors of a full sample, that is, by an effect of the same size in a smaller one, CHANCE standard errors at least. Which
#: of SCREENS it is, a part of the sample that the others are not fit on decides: every PARTS-th rating.
LEAST_DOCS, SCREENS, CHANCE, PARTS = 3, (4.0, 8.0, 15.0, 25.0), 4.0, 5
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?")
_CACHE = 500_000


def _bucket(feature: bytes) -> int:
    return xxhash.xxh32_intdigest(feature) % BUCKETS


def features(text: bytes | None, cache: dict[bytes, int]) -> list[int]:
    """Distinct buckets: of each distinct word of the whole text, and of its shape in steps."""
    if len(cache) > _CACHE:
        cache.clear()
    text = text or b""
    words = alnum(text)
    distinct = set(words)
    out = set()
    for w in distinct:
        f = cache.get(w)
        if f is None:
            f = cache[w] = _bucket(w)
        out.add(f)
    size = max(1, len(text) - text.count(b" "))
    letters_up = len(text) - len(text.translate(None, _UPPER))
    marks = len(text) - len(text.translate(None, _MARKS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shape = {
        "upper": min(9, int(20 * letters_up / size)),
        "marks": min(9, int(40 * marks / size)),
        "digits": min(9, int(20 * (len(text) - len(text.translate(None, _DIGITS))) / size)),
        "distinct": int(10 * len(distinct) ** 1.15 / max(1, len(words)) ** 1.15),
        "words": len(words).bit_length(),
        "length": min(15, size // max(1, len(words))),
        "again": min(9, int(10 * (len(lines) - len(set(lines))) / max(1, len(lines)))),
        "bar": min(5, text.count(b" | ") * 20 // max(1, len(words))),
        "shout": min(5, text.count(b"!") * 10 // max(1, len(words))),
    }
    out.update(_bucket(f"\0{k}\0{v}".encode()) for k, v in shape.items())
    return list(out)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; P(grade >= k) = sigmoid(score - thresholds[k - 1])


def loss(model: Model, rows: list[tuple[int, np.ndarray]], grades: int) -> float:
    """Mean negative log-likelihood of rated rows, each grade with the same weight."""
    s = np.array([model.weights[f].sum(dtype=np.float64) for _, f in rows])
    tail = 1 / (1 + np.exp(-np.clip(s[:, None] - model.thresholds[None, :], -30, 30)))
    tail = np.hstack([np.ones((len(s), 1)), tail, np.zeros((len(s), 1))])
    y = np.array([g for g, _ in rows])
    own = -np.log(np.maximum(1e-9, tail[np.arange(len(y)), y] - tail[np.arange(len(y)), y + 1]))
    return float(np.mean([own[y == g].mean() for g in range(grades) if (y == g).any()]))


def fit(rows: list[tuple[int, np.ndarray]], grades: int) -> Model:
    """The model of the whole sample, its screen chosen on a part of it that the candidates aren't fit on."""
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))  # whatever order the tasks came in
    held, rest = rows[::PARTS], [r for i, r in enumerate(rows) if i % PARTS]
    if len(rest) < PARTS or grades < 2:
        return fit_screened(rows, grades, SCREENS[0])
    losses = [loss(fit_screened(rest, grades, s), held, grades) for s in SCREENS]
    return fit_screened(rows, grades, SCREENS[int(np.argmin(losses))])


def fit_screened(rows: list[tuple[int, np.ndarray]], grades: int, screen: float) -> Model:
    """Proportional odds by Adam; grades: how many, from 0."""
    weights, raw = np.zeros(BUCKETS), np.linspace(-1, 1, grades - 1) if grades > 1 else np.zeros(0)
    if not rows or grades < 2:
        return Model(weights.astype(np.float32), np.sort(raw))
    y = np.array([g for g, _ in rows])
    share = np.array([(y >= k).mean() for k in range(1, grades)])
    raw = -np.log((share + 1e-3) / (1 - share + 1e-3))
    col = np.concatenate([f for _, f in rows])
    row = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    n_docs = np.bincount(col, minlength=BUCKETS)
    off = np.zeros(BUCKETS)
    for k in range(grades):
        p = min(max((y == k).mean(), 1e-6), 1 - 1e-6)
        seen = np.bincount(col, (y == k)[row].astype(float), BUCKETS)
        off = np.maximum(off, np.abs(seen - n_docs * p) / np.sqrt(np.maximum(1e-9, n_docs * p * (1 - p))))
    told = ((n_docs >= min(LEAST_DOCS, len(rows))) & (off >= max(CHANCE, screen * (len(rows) / SAMPLE) ** 0.5)))[col]
    col, row = col[told], row[told]
    used, at = np.unique(col, return_inverse=True)
    w = np.zeros(len(used))
    m, v = np.zeros(len(used) + len(raw)), np.zeros(len(used) + len(raw))
    balance = np.bincount(y, minlength=grades)
    by_row = (len(y) / np.maximum(1, balance) / grades)[y] ** 0.5
    by_row /= by_row.mean()
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, ROUNDS + 1):
        s = np.bincount(row, w[at], len(rows))
        theta = np.concatenate([[-np.inf], np.sort(raw), [np.inf]])
        low, high = theta[y], theta[y + 1]  # grade k lies between theta_k and theta_k+1
        a, b = np.where(np.isinf(low), 1.0, sigmoid(s - np.where(np.isinf(low), 0, low))), np.where(np.isinf(high), 0.0, sigmoid(s - np.where(np.isinf(high), 0, high)))
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a), b * (1 - b)
        ds = -(da - db) / p * by_row
        gw = np.bincount(at, ds[row], len(used)) / len(rows) + DECAY * w / len(rows) ** 0.5
        gt = np.zeros(len(raw))
        np.add.at(gt, np.maximum(0, y - 1), np.where(y > 0, da / p * by_row, 0))
        np.add.at(gt, np.minimum(len(raw) - 1, y), np.where(y < grades - 1, -db / p * by_row, 0))
        g = np.concatenate([gw, gt / len(rows)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, raw = w - step[: len(used)], np.sort(raw - step[len(used) :])
    weights[used] = w
    return Model(weights.astype(np.float32), raw)


def _marked(docs: DataFrame, wanted: list[str]) -> DataFrame:
    return docs.select(*wanted, F.col("text").cast("binary").alias("text"))


def sample_features(labelled: DataFrame, limit: int = SAMPLE) -> list[tuple[int, np.ndarray]]:
    """(doc_id, text, grade) -> grade and features of up to about `limit` whole documents, the lowest by hash of doc_id."""
    schema = pa.schema([("grade", pa.int32()), ("f", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            f = [np.array(features(t, cache), np.int32).tobytes() for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(f, pa.binary())], schema=schema)

    return [(r.grade, np.frombuffer(r.f, np.int32)) for r in _marked(labelled, ["grade"]).mapInArrow(run, "grade int, f binary").toLocalIterator()]


def graded(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Ratings from 0: toxic, 1: poor, 2: good. (Toxic is the lowest grade, so that many toxic words can't pass for a middle one.) Rows without a doc_id, quality or text are left out;
    of labels that disagree the lowest counts, of rows of one doc_id the text of the lowest hash, so no id brings more than one.
    Up to about `limit` documents: those in a cut of the hash range."""
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2)
    rated = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_rated"), grade.alias("grade")).groupBy("_rated").agg(F.min("grade").alias("grade"))
    n = rated.count()
    cut = -(2.0**63) + 2.0**64 * min(1.0, limit / max(1, n))
    rated = rated.where(F.xxhash64("_rated").cast("double") <= F.lit(cut))  # about `limit` rows: the documented bound
    own = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))  # so that no name clashes
    return own.join(F.broadcast(rated), F.col("_id") == F.col("_rated")).where("_text is not null").groupBy(F.col("_id").alias("doc_id")).agg(F.min_by("_text", F.xxhash64("_text")).alias("text"), F.first("grade").alias("grade"))


def score(docs: DataFrame, model: Model, wanted: list[str]) -> DataFrame:
    """The wanted columns, and expected_grade, p_top, kept, for every row. Null and empty texts are scored by their shape."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the corpus
    source = docs.select(*wanted).schema
    out = "expected_grade double, p_top double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        w, theta = shared.value.weights, shared.value.thresholds
        for batch in batches:
            s = np.array([w[features(t, cache)].sum(dtype=np.float64) for t in column(batch, "_text")])
            tail = 1 / (1 + np.exp(-np.clip(s[:, None] - theta[None, :], -30, 30)))
            p = tail[:, -1] if tail.shape[1] else np.ones(len(s))
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(tail.sum(1)), pa.array(p), pa.array(p >= KEEP)], [*batch.schema.names[:-1], "expected_grade", "p_top", "kept"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.fields)
    return docs.select(*wanted, F.col("text").cast("binary").alias("_text")).mapInArrow(run, f"{ddl}, {out}")


def kept_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with p_top of KEEP or more, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        w, theta = shared.value.weights, shared.value.thresholds
        for batch in batches:
            s = np.array([w[features(t, cache)].sum(dtype=np.float64) for t in batch.column(at).cast(pa.binary()).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(s - theta[-1], -30, 30))) if len(theta) else np.ones(len(s))
            yield batch.filter(pa.array(p >= KEEP))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(sample_features(graded(docs, labels)), 3)
    return score(docs, model, ["doc_id"])
