"""One document of each group of near duplicates: wide SimHash fingerprints in a byte-position inverted index, then what that can miss, exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colinear.llm.words import column, hashed_shingles, hashed_words
from colinear.operators.components import components
from colinear.session import forget, stored

WORDS, SIMILARITY = 5, 0.8
#: Random hyperplanes: a power of two. Keys of three positional bytes each; bytes in a pair's tally. The keys link the large groups
#: at little cost; what they miss is found by prefix_postings.
PLANES, KEYS, KEY_BYTES, TALLIED = 4096, 24, 3, 64
#: Equal bytes, of TALLIED, that a pair needs to be verified in the first rounds. At similarity 0.8 a byte is equal with chance 0.27,
#: so 17 are on average; of unrelated texts a quarter of one byte is.
LEAST_EQUAL = 6
#: Bits of a text's sketch, by which most pairs that can't be links are seen before their texts are compared.
SKETCH = 1024
#: In the first rounds postings of up to this many texts are paired off; in larger ones all meet two hubs.
PAIRED = 8
#: Up to this many texts to verify are sent to every task as a filter; beyond, all texts' shingles are joined.
FILTERED = 2_000_000
#: Shingles that a block of texts, and about as many as a part of the hash range, holds.
DEALT = 1_000_000
_BLOCK = 128


def _rotate(v: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, in place."""
    n, h = v.shape[1], 1
    while h < n:
        x = v.reshape(len(v), n // (2 * h), 2, h)
        a = x[:, :, 0, :] + x[:, :, 1, :]
        x[:, :, 1, :] = x[:, :, 0, :] - x[:, :, 1, :]
        x[:, :, 0, :] = a
        h *= 2
    return v


def fingerprints(shingles: list[np.ndarray]) -> np.ndarray:
    """PLANES bits a text (rows of bytes): the sides of PLANES random hyperplanes on which its distinct shingles' sum lies.

    A shingle's hash gives its coordinate and sign; the transform then sums all with the signs of every plane.
    """
    v = np.zeros((len(shingles), PLANES), np.float32)
    for row, h in zip(v, shingles):
        if len(h):
            row += np.bincount((h & np.uint64(PLANES - 1)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)), PLANES)
    return np.packbits(_rotate(v) >= 0, axis=1)


def sketches(shingles: list[np.ndarray]) -> np.ndarray:
    """SKETCH bits a text (rows of longs): for each hash value, whether an odd number of its distinct shingles has it.

    A shingle of only one of two texts turns one bit, so the bits in which they differ are never more than such shingles.
    """
    odd = np.zeros((len(shingles), SKETCH), np.uint8)
    shift = np.uint64(65 - SKETCH.bit_length())
    for row, h in zip(odd, shingles):
        row += (np.bincount((h >> shift).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd, axis=1).view(np.int64)


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def marked_texts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, row_key, tid, size, keys, tally, sketch): tid is the same for texts of the same words; size: distinct shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("tid", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int32())), ("tally", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
    scale = np.array([65536, 256, 1], np.int64)
    place = np.arange(KEYS, dtype=np.int64) << 24

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for a in range(0, len(texts), _BLOCK):
                tids, sets = _shingled(texts[a : a + _BLOCK], words)
                fps = fingerprints(sets)
                keys = (fps[:, : KEYS * KEY_BYTES].reshape(len(sets), KEYS, KEY_BYTES).astype(np.int64) @ scale + place).astype(np.int32)
                tally = np.ascontiguousarray(fps[:, -TALLIED:]).view(np.int64)
                lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.from_numpy_dtype(x.dtype)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), batch.column(1).slice(a, len(sets)), pa.array(tids), pa.array([len(x) for x in sets], pa.int64()), lists(keys), lists(tally), lists(sketches(sets))], schema=schema)

    wanted = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _row_key(docs).alias("row_key"), docs["text"].cast("binary").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, row_key long, tid long, size long, keys array<int>, tally array<long>, sketch array<long>")


def _shingled(texts: list[bytes | None], words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(tids, sorted distinct shingle hashes of each text)."""
    hashes, counts = hashed_words(texts)
    ends = np.cumsum(counts).tolist()
    tids = np.array([xxhash.xxh64_intdigest(hashes[e - n : e].tobytes(), 1) for e, n in zip(ends, counts.tolist())], np.uint64).view(np.int64)
    return tids, [np.unique(x) for x in hashed_shingles(hashes, counts, words)]


def _equal_bytes(a: str, b: str) -> Column:
    """How many of the TALLIED positional bytes of two arrays of longs are equal."""
    total = F.lit(0)
    for i in range(TALLIED // 8):
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):  # each byte's bits meet in its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)))
        total = total + (F.lit(8) - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    return total


def _can_link(a: str, b: str, similarity: float) -> Column:
    """False only where the sizes and sketches of two texts show that they aren't of the similarity.

    Of two sets at similarity s, at most (1 - s) / (1 + s) of their elements, counted in both, are in one only.
    """
    x, y = F.col(f"{a}_size"), F.col(f"{b}_size")
    differing = reduce(Column.__add__, [F.bit_count(F.get(F.col(f"{a}_sketch"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{b}_sketch"), F.lit(i)))) for i in range(SKETCH // 64)])
    return (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9) & (differing <= (1 - similarity) / (1 + similarity) * (x + y) + 1e-6)


def candidate_pairs(postings: DataFrame, unique: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, tid, label), (tid, size, tally, sketch) -> pairs (a, b), a < b, of texts that share a posting with more than one
    label, and enough positional bytes, and whose sketches don't rule them out.

    A posting of two texts is a pair, of up to PAIRED texts every pair. In a larger one, which a group of many near
    copies makes, each text meets two hubs that it isn't linked to: the text nearest to the posting's majority fingerprint, where
    copies of one original have it, and the first. So pairs grow with postings, and groups link up through their hubs.
    """
    sizes = postings.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("tid", "label")).alias("lo"), F.max("tid").alias("hi"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").drop("l1", "l2")
    sizes = stored(sizes)
    members = stored(postings.join(sizes.where("n > 2").select("key", "n", "lo"), "key"))
    small = members.where(F.col("n") <= PAIRED)
    x, y = small.select("key", F.col("tid").alias("a"), F.col("label").alias("al")), small.select("key", F.col("tid").alias("b"), F.col("label").alias("bl"))
    large = stored(members.where(F.col("n") > PAIRED).join(unique.select("tid", F.get("tally", F.lit(0)).alias("s")), "tid"))
    votes = large.groupBy("key").agg(F.count("*").alias("of"), *[F.sum(F.shiftrightunsigned("s", i).bitwiseAND(F.lit(1))).alias(f"v{i}") for i in range(64)])
    major = F.lit(0).cast("long")
    for i in range(64):
        major = major.bitwiseOR(F.shiftleft((2 * F.col(f"v{i}") > F.col("of")).cast("long"), i))
    votes = votes.select("key", major.alias("major"))
    hub = large.join(votes, "key").groupBy("key").agg(F.min(F.struct(F.bit_count(F.col("s").bitwiseXOR(F.col("major"))).alias("d"), "tid", "label")).alias("h")).select("key", F.struct("h.tid", "h.label").alias("hub"))
    starred = large.select("key", "tid", "label", "lo").join(hub, "key").select("tid", "label", F.explode(F.array("lo", "hub")).alias("h")).where("label <> h.label").select("tid", F.col("h.tid").alias("other"))
    pairs = sizes.where("n = 2").select(F.col("lo.tid").alias("a"), F.col("hi").alias("b")).union(x.join(y, "key").where("a < b and al <> bl").select("a", "b"))
    pairs = pairs.union(starred.select(F.least("tid", "other").alias("a"), F.greatest("tid", "other").alias("b"))).distinct()
    side = lambda p: unique.select(F.col("tid").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("tally", "size", "sketch")])
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(_equal_bytes("a_tally", "b_tally") >= LEAST_EQUAL)
    return met.where(_can_link("a", "b", similarity)).select("a", "b")


def prefix_postings(docs: DataFrame, n_shingles: int, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, tid, place, first): the shingles of each distinct text's prefix that some other text has too, and their places.

    A text's shingles are ordered by how many distinct texts have them, then by hash. Two texts of the similarity have
    a common shingle that is among the first size - ceil(similarity * size) + 1 of the larger text and, marked by `first`,
    among the first size - ceil(2 * similarity / (1 + similarity) * size) + 1 of the smaller one. So nothing is lost, and
    passages that many texts share stand at the end of the order, behind what makes two texts copies of each other.
    Shingles of a single text come first in its order and need no posting. Counts are exact: every block of texts deals its
    shingles to parts of the hash range, a sorted array for each, and a part is one task's.
    """
    parts = max(16, n_shingles // DEALT + 1)

    def dealt(tids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        tid, size = np.array(tids, np.int64), np.array([len(x) for x in sets], np.int64)
        keys, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(keys)
        keys, of = keys[order], of[order]
        part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        rows = []
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[p], cuts[p + 1])
            here, which = np.unique(of[own], return_inverse=True)
            rows.append({"part": p, "keys": keys[own].tobytes(), "which": which.astype(np.uint32).tobytes(), "tids": tid[here].tobytes(), "sizes": size[here].tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int64()), *[(x, pa.binary()) for x in ("keys", "which", "tids", "sizes")]]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # copies in a block are one text
        size = 0
        for batch in batches:
            texts = column(batch, "text")
            for a in range(0, len(texts), _BLOCK):
                for tid, own in zip(*(lambda t, x: (t.tolist(), x))(*_shingled(texts[a : a + _BLOCK], words))):
                    if tid not in held and len(own):
                        held[tid] = own
                        size += len(own)
                if size >= DEALT:
                    yield dealt([*held], [*held.values()])
                    held, size = {}, 0
        if held:
            yield dealt([*held], [*held.values()])

    def shared(group: pa.Table) -> pa.Table:
        keys, tids, sizes = [], [], []
        for r in zip(*(group.column(x).to_pylist() for x in ("keys", "which", "tids", "sizes"))):
            which = np.frombuffer(r[1], np.uint32)
            keys.append(np.frombuffer(r[0], np.uint64))
            tids.append(np.frombuffer(r[2], np.int64)[which])
            sizes.append(np.frombuffer(r[3], np.int64)[which])
        key, tid, size = np.concatenate(keys), np.concatenate(tids), np.concatenate(sizes)
        order = np.lexsort((tid, key))
        key, tid, size = key[order], tid[order], size[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (tid[1:] != tid[:-1])])  # a copy in another block is the same text
        key, tid, size = key[new], tid[new], size[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(first, append=len(key))
        many = np.repeat(n > 1, n)
        return pa.table({"key": key[many].view(np.int64), "tid": tid[many], "size": size[many], "n": np.repeat(n, n)[many]})

    texts = docs.select(docs["text"].cast("binary").alias("text"))
    found = texts.mapInArrow(deal, "part long, keys binary, which binary, tids binary, sizes binary").groupBy("part").applyInArrow(shared, "key long, tid long, size long, n long")
    own = Window.partitionBy("tid")
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "key")) - 1
    least = lambda share: F.col("size") - F.ceil(share * F.col("size") - 1e-9) + 1
    found = found.withColumn("place", place).where(F.col("place") < least(similarity))
    return found.select("key", "tid", "place", (F.col("place") < least(2 * similarity / (1 + similarity))).alias("first"))


def crossing_pairs(postings: DataFrame, unique: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, tid, place, first, label), (tid, size, sketch) -> all pairs (a, b), a < b, of texts of different labels that
    prefix_postings lets meet and that may be of the similarity.

    At the first shingle that two texts share, no more than what stands behind it in either can be shared besides. That
    and their sketches are tested where they meet, so that pairs ruled out aren't rows; both tests are exact.
    """
    crossed = postings.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.max("first").alias("any")).where("l1 <> l2 and any").select("key")
    met = stored(postings.join(crossed, "key").join(unique.select("tid", "size", "sketch"), "tid"))
    side = lambda df, p: df.select("key", F.col("tid").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("place", "label", "size", "sketch")])
    x, y = side(met.where("first"), "x"), side(met, "y")
    smaller = (F.col("x_size") < F.col("y_size")) | (F.col("x_size") == F.col("y_size")) & (F.col("x") < F.col("y"))
    behind = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    enough = behind >= similarity / (1 + similarity) * (F.col("x_size") + F.col("y_size")) - 1e-6
    pairs = x.join(y, "key").where(F.col("x_label") != F.col("y_label")).where(smaller & enough).where(_can_link("x", "y", similarity))
    out = stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    forget(met)
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(tid, row_key) of wanted -> (tid, set): the sorted distinct shingle hashes of that row's text."""
    few = np.unique(np.array([r.row_key for r in wanted.select("row_key").toLocalIterator()], np.int64)) if wanted.count() <= FILTERED else None
    shared = docs.sparkSession.sparkContext.broadcast(few)  # FILTERED numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = frozenset(shared.value.tolist()) if shared.value is not None else None
        for batch in batches:
            kept = [(key, text) for key, text in zip(column(batch, "row_key"), column(batch, "text")) if chosen is None or key in chosen]
            for a in range(0, len(kept), _BLOCK):
                keys, texts = zip(*kept[a : a + _BLOCK])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in _shingled(list(texts), words)[1]], pa.binary())], ["row_key", "set"])

    found = docs.select(_row_key(docs).alias("row_key"), docs["text"].cast("binary").alias("text")).mapInArrow(run, "row_key long, set binary")
    return found.dropDuplicates(["row_key"]).join(wanted, "row_key").select("tid", "set")


def verified_links(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of `similarity` or more."""
    side = lambda p: sets.select(F.col("tid").alias(p), F.col("set").alias(f"{p}_set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "a_set"), column(batch, "b_set")):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(u), len(v)) < similarity * max(len(u), len(v)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both >= similarity * (len(u) + len(v) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(2)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row_key, root): a row for each row of docs; rows of one root are near duplicates.

    Texts of the same words are one text from the start, so that exact copies cost a row each and no pair. Texts without
    words are copies of each other. Three rounds: candidates of the byte-position index; prefix postings by
    hubs; all pairs of prefix postings whose texts are still apart. Each round leaves out what is linked already, so
    that a large group isn't paired off, and after the third no link between two groups is left.
    """
    marked = stored(marked_texts(docs, words))
    unique = marked.groupBy("tid").agg(F.min_by(F.struct("size", "keys", "tally", "sketch"), "row_key").alias("m"), F.min("row_key").alias("row_key")).select("tid", "row_key", "m.*")
    unique = stored(unique)
    tables = [marked, unique]
    links, roots, tested = [], None, []

    def labelled(df: DataFrame) -> DataFrame:
        if roots is None:
            return df.withColumn("label", F.col("tid"))
        return df.join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("root", "tid")).drop("root")

    def link(pairs: DataFrame) -> None:
        nonlocal roots
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        tables.append(pairs)
        if pairs.isEmpty():
            return
        tested.append(pairs)
        wanted = stored(unique.select("tid", "row_key").join(pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).distinct(), "tid"))
        found = stored(verified_links(pairs, shingle_sets(docs, wanted, words), similarity))
        forget(wanted)
        known = [found] if roots is None else [found, roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
        links.append(found)
        roots = stored(components(reduce(DataFrame.union, known)))
        tables.extend([found, roots])

    link(candidate_pairs(unique.select("tid", F.explode("keys").alias("key"), F.col("tid").alias("label")), unique, similarity))
    total = marked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    postings = stored(prefix_postings(docs, total, words, similarity))
    link(candidate_pairs(labelled(postings).select("key", "tid", "label"), unique, similarity))
    crossing = crossing_pairs(labelled(postings), unique, similarity)
    tables.append(crossing)
    link(crossing)
    placed = marked.select("doc_id", "row_key", "tid")
    placed = placed.withColumn("root", F.col("tid")) if roots is None else placed.join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    out = stored(placed.select("doc_id", "row_key", "root"))
    for t in [*tables, postings]:
        forget(t)
    return out


def deduplicated(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The row of the smallest doc_id of each group of near duplicates (nulls last), all columns as they are.

    Two texts are linked at a Jaccard similarity of `similarity` or more of their distinct runs of `words` words; groups are
    the connected components. Repeated rows are copies: one stays. Null and empty texts are one group.
    """
    placed = groups(docs, words, similarity)
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("f"))
    gone = placed.select("row_key", "root").distinct().join(first.select("root", F.col("f.row_key").alias("kept")), "root").where("row_key <> kept").select(F.col("row_key").alias("_gone_key")).distinct()
    left = docs.join(gone, _row_key(docs) == gone["_gone_key"], "left_anti")
    again = stored(placed.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row_key").alias("_again_key")))
    if again.isEmpty():
        return left
    key = F.xxhash64(left["doc_id"].cast("long"), left["text"])
    once = left.join(again, key == again["_again_key"], "left_anti")
    return once.unionByName(left.join(again, key == again["_again_key"], "left_semi").dropDuplicates(["doc_id", "text"]))
