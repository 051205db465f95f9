"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.llm.words import column, plain, shingle_hashes
from colinear.operators.components import components
from colinear.session import forget, stored, table

#: Postings of up to this many fingerprints are paired off; larger ones are linked through midpoints.
PAIRED = 64
_LANES = np.uint64(0x0101010101010101)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes; 0 for none."""
    n = len(hashes)
    if n == 0:
        return 0
    if n == 1:
        return int(hashes[0])
    starts = np.arange(0, n, 255)
    out = np.zeros((8, 8), np.uint8)
    for bit in range(8):  # eight byte-wide counters in a word; 255 hashes can't overflow one
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        out[:, bit] = 2 * sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64) > n
    return int(np.packbits(out, axis=1, bitorder="little").tobytes()[::-1].hex(), 16)


def with_fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long). Null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(plain(t), shingle_words)) for t in column(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _byte(name: str, i: int) -> F.Column:
    return F.shiftrightunsigned(F.col(name), 8 * i).bitwiseAND(F.lit(255))


def links(fps: DataFrame, bits: int = 2, tables: list[DataFrame] | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) at `bits` or fewer differing bits (2 at most); tables takes what it stored.

    Two fingerprints at 2 bits or less share 6 of their 8 positional bytes at least. The inverted index posts a
    fingerprint under groups of four positional bytes: the eight positions are taken in four pairs, and
    any two differing bytes leave two pairs whole, so one of six groups holds both. (A posting of a single byte would
    hold a 256th of all fingerprints.) A pair's shared bytes are counted, pairs under the
    guaranteed minimum go, the rest is verified.
    Postings of over PAIRED fingerprints are not paired off: two fingerprints are within 2 bits exactly if some
    midpoint is within one bit of both, so each meets the others at its 65 midpoints, of which each has 65 members
    at most. That way is exact too and linear.
    """
    if not 0 <= bits <= 2:
        raise ValueError("links: bits must be 0, 1 or 2")
    pairs = [F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    groups = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = F.array(*[F.struct(F.lit(g).alias("g"), F.shiftleft(pairs[i], 16).bitwiseOR(pairs[j]).alias("k")) for g, (i, j) in enumerate(groups)])
    postings = fps.select("fp", F.inline(keys).alias("g", "k"))
    sizes = postings.groupBy("g", "k").agg(F.count("*").alias("n")).where("n > 1")
    posted = stored(postings.join(sizes, ["g", "k"]))
    if tables is not None:
        tables.append(posted)
    small = posted.where(F.col("n") <= PAIRED)
    x, y = small.select("g", "k", F.col("fp").alias("a")), small.select("g", "k", F.col("fp").alias("b"))
    same = sum(((_byte("a", i) == _byte("b", i)).cast("int") for i in range(8)), F.lit(0))
    paired = x.join(y, ["g", "k"]).where("a < b").where(same >= 8 - bits).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    large = posted.where(F.col("n") > PAIRED).select("fp").distinct()
    around = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    met = large.select("fp", F.explode(F.concat(F.array("fp"), around)).alias("mid")).groupBy("mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    starred = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    if bits < 2:  # a midpoint's members are 2 bits apart at most, so all of them are needed
        starred = met.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return paired.select("a", "b").union(starred).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3, bits: int = 2) -> DataFrame:
    """documents -> (doc_id, fingerprint, component_id): a row for each row of docs.

    Fingerprints link at `bits` or fewer differing bits; component_id is the smallest doc_id reachable.
    Null and empty texts have fingerprint zero, linked like any other. A null doc_id keeps its row and is never a
    component_id unless no other id is in the component. Repeated rows each give a row. An empty table gives none.
    """
    marked = stored(with_fingerprints(docs, shingle_words))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tables: list[DataFrame] = []
    roots = components(links(least.select("fp"), bits, tables))
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = stored(placed)
    for t in tables:
        forget(t)
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
