"""Benchmark decontamination with spaced seeds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.llm.words import alnum, column
from colinear.session import stored, table

#: Word offsets that a seed looks at; the positions between are ignored. Wherever the unequal words of an overlap of SPAN and
#: SHARE lie, one of the first two masks hits (at most 3 of 15 words leave no four in a row, and then two and two around
#: one); an item of LEAST_WORDS words, of which four are equal, needs all four.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
_ALWAYS = 2
#: Items below LEAST_WORDS words have no seed.
LEAST_WORDS = 5
#: An overlap counts from SPAN words (or all of a shorter item) with at least SHARE of them equal.
SPAN, SHARE = 12, 0.8
#: Up to this many test hashes go to every task as a filter before the join; beyond, all training hashes are joined.
FILTERED = 4_000_000
_CHUNK = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) & 0x7FFFFFFFFFFFFFFF | 1


def _seed(values: np.ndarray, starts: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the words that the mask selects, at each start."""
    out = np.full(len(starts), len(mask), np.uint64)
    for o in mask:
        out = (out ^ values[starts + o]) * _STEP
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def test_seeds(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) -> (item_id, item_key, words, mask, at, h)."""
    schema = pa.schema([("item_id", pa.int64()), ("item_key", pa.int64()), ("words", pa.string()), ("mask", pa.int32()), ("at", pa.int32()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, key, text in zip(column(batch, "item_id"), column(batch, "item_key"), column(batch, "text")):
                words = alnum(text)
                values = np.array([_word_hash(w) for w in words], np.uint64)
                joined = b" ".join(words).decode()
                for m, mask in enumerate(MASKS):
                    if len(words) < LEAST_WORDS or m >= _ALWAYS and len(words) != LEAST_WORDS:
                        continue
                    starts = np.arange(max(0, len(words) - mask[-1]))
                    rows += [{"item_id": item_id, "item_key": key, "words": joined, "mask": m, "at": i, "h": h} for i, h in enumerate(_seed(values, starts, mask).tolist())]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("item_id", "text").alias("item_key"), F.col("text").cast("binary").alias("text"))
    return wanted.mapInArrow(run, "item_id long, item_key long, words string, mask int, at int, h long")


def training_hits(docs: DataFrame, known: dict[bytes, int] | None, tests: np.ndarray | None) -> DataFrame:
    """(doc_id, text) -> whole texts with seeds that can join: (doc_id, row_key, words, seeds).

    known: word hashes of the test vocabulary, tests: the sorted test hashes; None: every seed is kept.
    """
    masks = MASKS
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("words", pa.string()), ("seeds", pa.list_(pa.struct([("mask", pa.int32()), ("pos", pa.int32()), ("h", pa.int64())])))])

    def chunk(part: list[tuple]) -> Iterator[dict]:
        flat = [w for *_, words in part for w in words]
        if known is not None:
            values = np.array([known.get(w, 0) for w in flat], np.uint64)
        else:
            table_ = {w: _word_hash(w) for w in set(flat)}
            values = np.array([table_[w] for w in flat], np.uint64)
        sizes = np.array([len(words) for *_, words in part])
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(flat))  # words from here to the text's end
        inside = values != 0
        found = []
        for m, mask in enumerate(masks):
            if len(flat) <= mask[-1]:
                continue
            ok = (left > mask[-1])[: len(flat) - mask[-1]]
            for o in mask:
                ok &= inside[o : len(flat) - mask[-1] + o]
            at = np.flatnonzero(ok)
            h = _seed(values, at, mask)
            if tests is not None and len(at):
                place = np.searchsorted(tests, h)
                hit = tests[np.minimum(place, len(tests) - 1)] == h if len(tests) else np.zeros(len(h), bool)
                at, h = at[hit], h[hit]
            found.append((np.full(len(at), m), at, h))
        if not found:
            return
        mask_of, at, h = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((mask_of, at))
        mask_of, at, h = mask_of[order], at[order], h[order]
        if not len(at):
            return
        doc = np.searchsorted(ends, at, side="right")
        for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1):
            d = int(doc[run[0]])
            doc_id, key, words = part[d]
            base = int(ends[d] - sizes[d])
            yield {"doc_id": doc_id, "row_key": key, "words": b" ".join(words).decode(), "seeds": [{"mask": int(mask_of[i]), "pos": int(at[i]) - base, "h": int(h[i])} for i in run]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, size, rows = [], 0, []
            for doc_id, key, text in zip(column(batch, "doc_id"), column(batch, "row_key"), column(batch, "text")):
                words = alnum(text)
                if len(words) < LEAST_WORDS:
                    continue
                part.append((doc_id, key, words))
                size += len(words)
                if size >= _CHUNK:
                    rows += chunk(part)
                    part, size = [], 0
            if part:
                rows += chunk(part)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row_key"), F.col("text").cast("binary").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, row_key long, words string, seeds array<struct<mask:int,pos:int,h:long>>")


def aligned(doc: list[str], item: list[str], diagonal: int) -> tuple[int, int, int, int] | None:
    """Best stretch of item laid on doc at doc[diagonal + i] = item[i]: (first, last, equal, length) or None.

    Of the stretches from one equal word to another, with at least SHARE of their words equal and SHARE of SPAN (or of a
    shorter item) equal words, that with the most equal words, the first of them.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    hits = [i for i in range(lo, hi) if doc[diagonal + i] == item[i]]
    least = SHARE * min(SPAN, len(item)) - 1e-9
    if len(hits) < least:
        return None
    # a stretch from hit a to hit b has b - a + 1 equal of hits[b] - hits[a] + 1 words: enough if over[b] <= under[a]
    under = [SHARE * (h - 1) - k + 1e-9 for k, h in enumerate(hits)]
    over = [SHARE * h - k - 1 for k, h in enumerate(hits)]
    tops = [0]  # starts of a greater `under` than all before
    for k in range(1, len(hits)):
        if under[k] > under[tops[-1]]:
            tops.append(k)
    bounds = [under[k] for k in tops]
    best = None
    for b, x in enumerate(over):
        j = bisect_left(bounds, x)
        if j < len(tops) and tops[j] <= b and (best is None or b - tops[j] > best[1] - best[0]):
            best = (tops[j], b)
    if best is None or best[1] - best[0] + 1 < least:
        return None
    first, last = hits[best[0]], hits[best[1]]
    return diagonal + first, diagonal + last, best[1] - best[0] + 1, last - first + 1


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row_key, item_id, first_word, last_word, n_equal, n_length): verified overlaps, the best for each pair.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null texts, texts and
    items of fewer than LEAST_WORDS words have no overlap; repeated rows give one row; either table may be empty.
    """
    spark = docs.sparkSession
    seeds = stored(test_seeds(benchmark))
    known = tests = None
    if seeds.count() <= FILTERED:  # the proven bound
        tests = np.unique(np.array([r.h for r in seeds.select("h").distinct().toLocalIterator()], np.int64))
        words = seeds.select("item_key", "words").distinct().select(F.explode(F.split("words", " ")).alias("w")).distinct()
        known = {w: _word_hash(w) for w in (r.w.encode() for r in words.toLocalIterator())}
    hits = stored(training_hits(docs, known, tests).dropDuplicates(["row_key"]))
    flat = hits.select("row_key", F.inline("seeds"))
    met = flat.join(seeds.select("item_key", "mask", "at", "h"), ["mask", "h"]).groupBy("row_key", "item_key").agg(F.collect_set(F.col("pos") - F.col("at")).alias("diagonals"))
    items = seeds.select("item_key", "item_id", F.col("words").alias("item")).distinct()
    cases = met.join(hits.drop("seeds"), "row_key").join(items, "item_key")
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("n_equal", pa.int64()), ("n_length", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words, item = r["words"].split(" "), r["item"].split(" ")
                for diagonal in r["diagonals"]:  # read to its ends: an item's whole copy is one overlap, however long
                    if x := aligned(words, item, diagonal):
                        rows.append({"doc_id": r["doc_id"], "row_key": r["row_key"], "item_id": r["item_id"], "first_word": x[0], "last_word": x[1], "n_equal": x[2], "n_length": x[3]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = cases.mapInArrow(verify, "doc_id long, row_key long, item_id long, first_word long, last_word long, n_equal long, n_length long")
    best = F.max(F.struct("n_equal", -F.col("n_length"), -F.col("first_word"), "last_word", "n_length", "first_word"))
    return found.groupBy("doc_id", "row_key", "item_id").agg(best.alias("b")).select("doc_id", "row_key", "item_id", "b.first_word", "b.last_word", "b.n_equal", "b.n_length")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a verified overlap with an item; all columns stay as they are."""
    bad = overlaps(docs, benchmark).select(F.col("row_key").alias("_row_key")).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == bad["_row_key"], "left_anti")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each contaminated document and item."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")
