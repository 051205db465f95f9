"""Language identification with error-correcting output codes over byte trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.llm.words import column
from colinear.session import table

#: Training documents at most for each language, those of the lowest hash of doc_id and text.
SAMPLE = 1500
BUCKETS = 1 << 16
#: A prediction is flagged ambiguous below this probability.
SURE = 0.8
_LETTER = regex.compile(r"\p{L}")  # Unicode category L: no number forms, no superscripts
_CHUNK = 2_000_000


def trigram_ids(text: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes from each position (the last two have none)."""
    x = text.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int32)


def as_bytes(text: str) -> bytes:
    """What the classifiers read: lower-case, with a space at both ends."""
    return b" " + text.lower().encode() + b" "


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all distinct splits of up to 5 languages, beyond that seeded splits that keep codewords apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        bits = [[1 if (1 | m << 1) >> i & 1 else -1 for i in range(n)] for m in range((1 << (n - 1)) - 1)]
        return np.array(bits, np.int8).T
    rng, length, best = np.random.default_rng(n), max(15, 10 * int(np.ceil(np.log2(n)))), (-1, None)
    for _ in range(200):
        code = np.where(rng.random((n, length)) < 0.5, 1, -1).astype(np.int8)
        gaps = (code[:, None, :] != code[None, :, :]).sum(2) + length * np.eye(n, dtype=int)
        if gaps.min() > best[0] and (abs(code.sum(0)) < n).all():
            best = (gaps.min(), code)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log odds of a trigram
    slope: np.ndarray  # bits: margin scale
    worth: np.ndarray  # bits: loss weight


def fit(counts: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """counts: for each document its language, trigram buckets and how often each occurs."""
    langs = sorted({x for x, _, _ in counts})
    code = codewords(len(langs))
    totals = np.zeros((len(langs), BUCKETS))
    for lang, ids, n in counts:
        totals[langs.index(lang)] += np.bincount(ids, n / max(1, n.sum()), BUCKETS)
    share = totals / np.maximum(1e-12, totals.sum(1, keepdims=True)) if langs else totals
    floor = 1e-6
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        plus, minus = code[:, b] > 0, code[:, b] < 0
        if plus.any() and minus.any():
            weights[:, b] = np.log((share[plus].mean(0) + floor) / (share[minus].mean(0) + floor))
    margins = np.array([(weights[ids] * n[:, None]).sum(0) / max(1, n.sum()) for _, ids, n in counts]) if counts else np.zeros((0, code.shape[1]))
    truth = np.array([code[langs.index(x)] for x, _, _ in counts]) if counts else margins
    slope, worth = np.ones(code.shape[1]), np.ones(code.shape[1])
    for b in range(code.shape[1] if counts else 0):
        m, y, a = margins[:, b], truth[:, b].astype(float), 1.0
        for _ in range(200):  # logistic slope, kept within a bound so that separable bits end
            p = 1 / (1 + np.exp(np.clip(a * m * y, -30, 30)))
            a = min(60.0, a + 20 * float((p * m * y).mean()))
        slope[b] = max(a, 0.1)
        right = ((m * y) > 0).mean()
        worth[b] = np.log((right + 0.01) / (1.01 - right)) if right > 0.5 else 0.05
    return Model(langs, code, weights, slope, worth / worth.max() if len(worth) else worth)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword by weighted logistic loss: (language index, its probability among the codewords)."""
    loss = np.zeros((len(margins), len(model.langs)))
    for k in range(len(model.langs)):
        loss[:, k] = (np.logaddexp(0, -model.code[k] * model.slope * margins) * model.worth).sum(1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return best, p[np.arange(len(p)), best]


def sample_counts(labelled: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Trigram counts of about per_language whole documents of each language at most, the lowest by hash of doc_id and text.

    Rows without a doc_id count as any other, of repeated rows one; so no key brings more rows to the driver than that.
    """
    schema = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(column(batch, "lang"), column(batch, "text")):
                ids, n = np.unique(trigram_ids(np.frombuffer(as_bytes(text), np.uint8)), return_counts=True)
                rows.append({"lang": lang, "ids": ids.astype(np.int32).tobytes(), "n": n.astype(np.int32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    # a cut of the hash range that holds about per_language documents: no sort of the corpus
    cut = (F.lit(-(2**63)).cast("double") + F.lit(2.0**64) * F.least(F.lit(1.0), per_language / F.col("n"))).alias("cut")
    cuts = [(r.lang, r.cut) for r in sizes.select("lang", cut).toLocalIterator()]
    if not cuts:
        return []
    spark = labelled.sparkSession
    chosen = known.join(F.broadcast(spark.createDataFrame(cuts, "lang string, cut double")), "lang")  # a row a language
    chosen = chosen.where(F.col("h").cast("double") <= F.col("cut")).dropDuplicates(["lang", "h"]).select("lang", "text")
    rows = chosen.mapInArrow(run, "lang string, ids binary, n binary").toLocalIterator()
    return [(r.lang, np.frombuffer(r.ids, np.int32), np.frombuffer(r.n, np.int32)) for r in rows]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, lang_pred, score, ambiguous), a row for each row.

    Text null or without a letter, or no language learned: `und` with score 0, ambiguous. The whole text is read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = column(batch, "text")
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            margins, where = [], []

            def flush(parts: list[bytes]) -> None:
                flat = np.frombuffer(b"".join(parts), np.uint8)
                starts = np.cumsum([0, *map(len, parts)])
                sums = np.zeros((len(parts), model.weights.shape[1]))
                for a in range(0, len(flat) - 2, _CHUNK):  # blocks bound the memory, not the text
                    own = model.weights[trigram_ids(flat[a : a + _CHUNK + 2])]
                    cuts = np.clip(starts[:-1] - a, 0, len(own))
                    stops = np.clip(starts[1:] - 2 - a, 0, len(own))
                    total = np.vstack([np.zeros((1, own.shape[1])), np.cumsum(own, 0, dtype=np.float64)])
                    sums += np.where((stops > cuts)[:, None], total[np.maximum(stops, cuts)] - total[cuts], 0)
                margins.append(sums / np.maximum(1, np.diff(starts) - 2)[:, None])

            parts, size = [], 0
            for i, text in enumerate(texts):
                if text is None or not model.langs or not _LETTER.search(text):
                    continue
                parts.append(as_bytes(text))
                where.append(i)
                size += len(parts[-1])
                if size >= _CHUNK // 4:
                    flush(parts)
                    parts, size = [], 0
            if parts:
                flush(parts)
            if where:
                best, p = decode(model, np.vstack(margins))
                lang[where], score[where] = np.array(model.langs, object)[best], p
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(score < SURE)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(divisor: int) -> F.Column:
    """crc32 of doc_id as text leaves the remainder 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(sample_counts(docs.where(~held_out(4)).select("doc_id", "text", "lang")))
    return identify(docs, model).select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score", "ambiguous")
