"""Anchors between regions and the chains through them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colinear.functions import batches
from colinear.operators.sampling import ranked
from colinear.session import stored

MATCH, MISMATCH, GAP = 5.0, -1.0, -1.0


def _grouped(occ: DataFrame, side: str) -> DataFrame:
    """A row for each motif and region with its positions: what is joined is that, not every pair of positions."""
    return occ.groupBy("motif", "acr").agg(F.collect_list("pos").alias(f"{side}s")).withColumnRenamed("acr", f"acr{1 if side == 'a' else 2}")


def shared_motifs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(acr1, acr2, motif, as, cs) for every motif that two regions share.

    left alone: each unordered pair of its regions once, the smaller identifier first; with right: every pair of a
    left and a right region. Rows of occ: acr, pos, motif. A very common motif is split by adaptive execution.
    """
    joined = _grouped(left, "a").join(_grouped(left if right is None else right, "c"), "motif")
    return joined.where("acr1 < acr2") if right is None else joined


def anchors(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(acr1, acr2, motif, a, c): every anchor as a row."""
    return shared_motifs(left, right).select("acr1", "acr2", "motif", F.explode("as").alias("a"), "cs").select("acr1", "acr2", "motif", "a", F.explode("cs").alias("c"))


def anchor_offsets(counts: DataFrame) -> DataFrame:
    """Adds first and stop, the slice of each pair if all anchors lay one after another in order of the pair.

    Running sums within ranges of pairs, then over the ranges: no one task sees all pairs.
    """
    placed = ranked(counts, [F.col("acr1"), F.col("acr2")], "_rank", F.col("n_anchors"))
    return placed.select("acr1", "acr2", "n_anchors", (F.col("_rank") - F.col("n_anchors")).alias("first"), F.col("_rank").alias("stop"))


#: Least regions of a block. Blocks that share a motif meet, and their regions' anchors are found there.
BLOCK = 128
#: Blocks are as small as that up to BLOCKS of them, then larger, up to ELEMENTS elements on average: each block moves once for each
#: other one, so their number is what the shuffle grows by.
BLOCKS, ELEMENTS = 32, 1 << 18
#: Anchors that a task holds at once, but for a single region's (few enough for the processor's cache); pairs counted at once.
HELD, COUNTED = 1 << 18, 1 << 18
#: Pairs of blocks of a broadcast.
MET = 4_000_000


def _regions(occ: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(acr, seq): each region's elements; a motif goes by its 64-bit hash. Rows without a region or motif are left out."""
    occ = occ.where("acr is not null and motif is not null")
    known = occ.select("acr", "pos", "motif", F.lit(1.0).alias("weight")) if weights is None else occ.select("acr", "pos", "motif").join(weights.select("motif", F.col("score").cast("double").alias("weight")), "motif", "left")
    return stored(known.groupBy("acr").agg(F.collect_list(F.struct(F.xxhash64("motif").alias("k"), F.col("pos").cast("long").alias("pos"), "weight")).alias("seq")))


def _block_pairs(left: DataFrame, right: DataFrame | None, weights: DataFrame | None, fields: tuple[str, ...], measure: Column | None = None, within: DataFrame | None = None, places: list[DataFrame] | None = None) -> DataFrame:
    """(b1, b2, rows1, rows2): pairs of blocks of regions that share a motif, with each block's regions and these fields of their elements;
    with a measure, made of acr, each region has that too. within (acr, cluster): blocks hold regions of one cluster and meet in it only. places: a list
    that takes the table (acr, b, measure) of the left side, whose measure is then a region's place in its block.

    What is joined on motifs is blocks, so a motif that two thousand regions have makes some hundred rows, not millions; and
    what moves is a block for each other one, once, not a row for each motif of each pair.
    """
    sides = [_regions(left, weights)]
    sides.append(sides[0] if right is None else _regions(right, weights))
    dealt = []
    for r in sides:
        n, elements = r.agg(F.count("*"), F.coalesce(F.sum(F.size("seq")), F.lit(0))).first()
        blocks = max(1, min(-(-n // BLOCK), max(BLOCKS, -(-elements // ELEMENTS))))
        if within is not None:
            own = r.join(within.select("acr", F.col("cluster").cast("string").alias("g")), "acr")
            sizes = own.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / max(BLOCK, -(-n // blocks)))).alias("blocks"))
            dealt.append(own.join(sizes, "g").withColumn("b", F.concat("g", F.lit("/"), F.pmod(F.xxhash64("acr"), F.col("blocks")).cast("string"))))
        else:
            dealt.append(r.withColumn("g", F.lit("")).withColumn("b", F.pmod(F.xxhash64("acr"), F.lit(blocks))))
    if places is not None:
        place = F.row_number().over(Window.partitionBy("b").orderBy("acr")) - 1  # a block is about one task's in any case
        placed = stored(dealt[0].select("acr", "b", place.cast("long").alias("measure")))
        places.append(placed)
        dealt = [r.join(placed.select("acr", F.col("measure").alias("_place")), "acr") for r in dealt]
        measure = F.col("_place")
    keys = [r.select("g", F.col("b").alias(f"b{i}"), F.explode(F.transform("seq", lambda x: x["k"])).alias("k")).distinct() for i, r in enumerate(dealt, 1)]
    met = keys[0].join(keys[1], ["g", "k"])
    met = stored((met.where("b1 <= b2") if right is None else met).select("b1", "b2").distinct())
    own = [] if measure is None else [measure.cast("long").alias("measure")]
    packed = [r.groupBy(F.col("b").alias(f"b{i}")).agg(F.collect_list(F.struct("acr", *own, *[F.col("seq")[c].alias(c) for c in fields])).alias(f"rows{i}")) for i, r in enumerate(dealt, 1)]  # a row a block
    n = met.count()
    tasks = max(1, min(n, max(16 * left.sparkSession.sparkContext.defaultParallelism, n // 16)))
    known = F.broadcast(met) if n <= MET else met
    side = [p.join(known, f"b{i}").select("b1", "b2", f"rows{i}").repartition(tasks, "b1", "b2") for i, p in enumerate(packed, 1)]
    return side[0].join(side[1].hint("merge"), ["b1", "b2"]).select("b1", "b2", "rows1", "rows2")  # blocks are never gathered by the driver


def _elements(rows: pa.Array, *fields: str) -> tuple[list[str], np.ndarray, ...]:
    """(names, region of each element, and its fields) of a block."""
    names, first = rows.field("acr").to_pylist(), rows.field(fields[0])
    sizes = first.value_lengths().to_numpy(zero_copy_only=False)
    return names, np.repeat(np.arange(len(names)), sizes), *(rows.field(c).flatten().to_numpy(zero_copy_only=False) for c in fields)


def _table(of1: np.ndarray, k1: np.ndarray, v1: np.ndarray, n1: int, of2: np.ndarray, k2: np.ndarray, v2: np.ndarray, n2: int, held: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, table): for `step` rows of the first side at a time, the sums of v1 * v2 over the keys that a row and a column share.

    By a matrix product where its cells aren't many more than the meetings, else by the meetings, `held` at once.
    """
    lo, hi = np.searchsorted(k2, k1, "left"), np.searchsorted(k2, k1, "right")  # k2 is sorted
    keys = np.unique(k1[hi > lo])
    width = len(keys)
    if (n1 + n2) * width <= 1 << 25 and n1 * n2 * width <= 256 * int((hi - lo).sum()):

        def dense(of: np.ndarray, k: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
            at = np.searchsorted(keys, k)
            ok = (at < width) & (keys[np.minimum(at, width - 1)] == k)
            return np.bincount(of[ok] * width + at[ok], v[ok], n * width).reshape(n, width)

        if width:
            a, b = dense(of1, k1, v1, n1), dense(of2, k2, v2, n2).T
            for begin in range(0, n1, step):
                yield begin, a[begin : begin + step] @ b
        return
    for begin in range(0, n1, step):
        own = np.flatnonzero((of1 >= begin) & (of1 < begin + step) & (hi > lo))
        upto, out = np.cumsum(hi[own] - lo[own]), np.zeros(min(step, n1 - begin) * n2)
        at = 0
        while at < len(own):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + held, "right")))
            some = own[at:stop]
            n = hi[some] - lo[some]
            i = np.repeat(some, n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
            out += np.bincount((of1[i] - begin) * n2 + of2[j], v1[i] * v2[j], len(out))
            at = stop
        yield begin, out.reshape(-1, n2)


def _keys(rows: pa.Array, each: bool) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(names, region, motif and how many of it) of a block, a row for each motif of a region, by motif; each: False counts a motif once."""
    names, of, k = _elements(rows, "k")
    order = np.lexsort((of, k))
    of, k = of[order], k[order]
    first = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(k) != 0)]) if len(k) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(k)])
    return names, of[first], k[first], times.astype(float) if each else np.ones(len(first))


def _counted(left: DataFrame, right: DataFrame | None, each: bool, within: DataFrame | None = None) -> DataFrame:
    """(acr1, acr2, n) of pairs that share a motif: how many motifs they share, or with `each` how many anchors they have.

    Counted in the task where two blocks meet, so no row of a pair is shuffled.
    """
    one_set, held, counted = right is None, HELD, COUNTED

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            records = batch.to_struct_array()
            for r in range(batch.num_rows):
                record = records.slice(r, 1)
                same = one_set and record.field("b1")[0].as_py() == record.field("b2")[0].as_py()
                # a block's two copies may be in different order: with itself it meets as one of them
                (names1, *own), (names2, *other) = (_keys(record.field(c).flatten(), each) for c in ("rows1", "rows1" if same else "rows2"))
                texts = np.array(names1 + names2, object)
                place = np.argsort(np.argsort(texts, kind="stable"), kind="stable")
                taken = pa.array(names1 + names2, pa.string())
                for begin, table in _table(*own, len(names1), *other, len(names2), held, max(1, counted // max(1, len(names2)))):
                    i, j = np.nonzero(table)
                    n = table[i, j]
                    i, j = i + begin, j
                    if same:
                        keep = i < j
                        i, j, n = i[keep], j[keep], n[keep]
                    j = j + len(names1)
                    if one_set:
                        turned = place[i] > place[j]
                        i, j = np.where(turned, j, i), np.where(turned, i, j)
                    if len(n):
                        yield pa.RecordBatch.from_arrays([taken.take(pa.array(i)), taken.take(pa.array(j)), pa.array(n.astype(np.int64))], ["acr1", "acr2", "n"])

    return _block_pairs(left, right, None, ("k",), within=within).mapInArrow(run, "acr1 string, acr2 string, n long")


def _anchored(record: pa.StructArray, one_set: bool, missing: float | None, use: bool, held: int) -> Iterator[tuple[list[str], list[str], batches.Pairs]]:
    """Names and anchors of the pairs of two blocks (one_set: each unordered pair once, the smaller name first)."""
    b1, b2 = (record.field(c)[0].as_py() for c in ("b1", "b2"))
    fields = ("k", "pos", "weight") if use else ("k", "pos")
    (names1, of1, k1, x1, *w1), (names2, of2, k2, x2, *_) = (_elements(record.field(c).flatten(), *fields) for c in ("rows1", "rows1" if one_set and b1 == b2 else "rows2"))
    w1 = w1[0] if use else np.ones(len(k1))
    order = np.argsort(k2, kind="stable")
    of2, k2, x2 = of2[order], k2[order], x2[order]
    lo, hi = np.searchsorted(k2, k1, "left"), np.searchsorted(k2, k1, "right")
    per = np.bincount(of1, hi - lo, len(names1)).astype(np.int64)  # anchors of each region of the first block
    cut = np.searchsorted(np.cumsum(per), np.arange(held, int(per.sum()) + held, held), "left")
    text1, text2 = np.array(names1, object), np.array(names2, object)
    begin = 0
    for end in sorted({*(int(c) + 1 for c in cut if c + 1 < len(names1)), len(names1)}):
        own = np.flatnonzero((of1 >= begin) & (of1 < end))
        begin = end
        n = (hi - lo)[own]
        i = np.repeat(own, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
        a, c = of1[i], of2[j]
        turned = np.zeros(len(i), bool)
        if one_set:
            keep = a < c if b1 == b2 else np.ones(len(i), bool)
            i, j, a, c = i[keep], j[keep], a[keep], c[keep]
        pair = a * len(names2) + c
        order = batches.ordering(pair)
        i, j, pair = i[order], j[order], pair[order]
        begins = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else order
        known, sizes = pair[begins], np.diff(begins, append=len(pair))
        first, second = text1[known // len(names2)], text2[known % len(names2)]
        x, y, w = x1[i], x2[j], w1[i]
        if one_set:
            turned = np.array([p > q for p, q in zip(first, second)], bool)
            first, second = np.where(turned, second, first), np.where(turned, first, second)
            swap = np.repeat(turned, sizes)
            x, y = np.where(swap, y, x), np.where(swap, x, y)
        if use and np.isnan(w).any():
            if missing is None:
                raise ValueError(f"no weight for a motif of {text1[of1[i[np.flatnonzero(np.isnan(w))[0]]]]}")
            w = np.where(np.isnan(w), missing, w)
        if len(known):
            yield first.tolist(), second.tolist(), batches.Pairs(sizes, x, y, w)


def _chained(left: DataFrame, right: DataFrame | None, weights: DataFrame | None, missing: float | None, found: Callable[[batches.Pairs], dict[str, np.ndarray]], columns: str) -> DataFrame:
    """(acr1, acr2, columns, n_anchors) by what found makes of the pairs' anchors."""
    use, one_set, held = weights is not None, right is None, HELD

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            records = batch.to_struct_array()
            for k in range(batch.num_rows):
                for first, second, pairs in _anchored(records.slice(k, 1), one_set, missing, use, held):
                    out = {"acr1": pa.array(first, pa.string()), "acr2": pa.array(second, pa.string())} | {c: pa.array(v) for c, v in found(pairs).items()}
                    yield pa.RecordBatch.from_pydict(out | {"n_anchors": pa.array(pairs.sizes[: pairs.n], pa.int64())})

    return _block_pairs(left, right, weights, ("k", "pos", "weight") if use else ("k", "pos")).mapInArrow(run, f"acr1 string, acr2 string, {columns}n_anchors long")


def anchor_counts(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(acr1, acr2, n_anchors) of all pairs that share a motif."""
    return _counted(left, right, True).withColumnRenamed("n", "n_anchors")


def motif_counts(left: DataFrame, right: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """(acr1, acr2, n_motifs) of all pairs that share a motif: how many different ones; within (acr, cluster): of pairs in one cluster only."""
    return _counted(left, right, False, within).withColumnRenamed("n", "n_motifs")


def listed_motif_counts(occ: DataFrame, listed: DataFrame) -> DataFrame:
    """(acr1, acr2, n_motifs) of those pairs of motif_counts that are listed as (r1, r2), each once.

    A listed pair goes by its regions' places to where their blocks meet; pairs that aren't listed are never rows. What moves is the list, two
    numbers a pair.
    """
    held, counted, places = HELD, COUNTED, []
    blocks = _block_pairs(occ, None, None, ("k",), places=places)
    known = places[0]
    sent = F.broadcast if known.count() <= MET else lambda df: df
    side = lambda k: sent(known.select(F.col("acr").alias(f"r{k}"), F.col("b").alias(f"x{k}"), F.col("measure").alias(f"i{k}")))
    met = listed.where("r1 < r2").select("r1", "r2").join(side(1), "r1").join(side(2), "r2")
    first = F.col("x1") <= F.col("x2")
    turn = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    met = met.select(turn("x1", "x2").alias("b1"), turn("x2", "x1").alias("b2"), turn("i1", "i2").alias("i"), turn("i2", "i1").alias("j"))

    def run(wanted: pa.Table, both: pa.Table) -> pa.Table:
        out = []
        records = both.combine_chunks().to_batches()[0].to_struct_array() if wanted.num_rows and both.num_rows else []
        for r in range(len(records)):
            record = records.slice(r, 1)
            rows = [record.field(c).flatten() for c in ("rows1", "rows2")]
            sides = [_keys(x, False) for x in rows]
            at = [np.argsort(x.field("measure").to_numpy(zero_copy_only=False)) for x in rows]
            (names1, *own), (names2, *other) = sides
            i, j = (where[wanted.column(c).to_numpy()] for where, c in zip(at, ("i", "j")))
            key = np.unique(i * len(names2) + j)
            i, j = key // len(names2), key % len(names2)
            n, step = np.zeros(len(key), np.int64), max(1, counted // max(1, len(names2)))
            for begin, table in _table(*own, len(names1), *other, len(names2), held, step):
                some = slice(*np.searchsorted(i, [begin, begin + len(table)]))
                n[some] = table[i[some] - begin, j[some]]
            kept = np.flatnonzero(n)
            a, b = (pa.array(names, pa.string()).take(pa.array(x[kept])) for names, x in ((names1, i), (names2, j)))
            turned = pc.greater(a, b)
            out.append(pa.table({"acr1": pc.if_else(turned, b, a), "acr2": pc.if_else(turned, a, b), "n_motifs": pa.array(n[kept])}))
        return pa.concat_tables(out) if out else pa.table({"acr1": pa.array([], pa.string()), "acr2": pa.array([], pa.string()), "n_motifs": pa.array([], pa.int64())})

    return met.groupBy("b1", "b2").cogroup(blocks.groupBy("b1", "b2")).applyInArrow(run, "acr1 string, acr2 string, n_motifs long")


def motif_count_groups(left: DataFrame, right: DataFrame, measure: Column) -> DataFrame:
    """(acr, n_motifs, n, least): for each region of left, how many of right share so many motifs with it, 1 at least, and the least measure of these.

    The same pairs as those of motif_counts, grouped in the task where two blocks meet: what leaves it is a region's different numbers, not its
    pairs. measure: a whole number made of right's acr, null if it has none.
    """
    held, counted = HELD, COUNTED

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            records = batch.to_struct_array()
            for r in range(batch.num_rows):
                record = records.slice(r, 1)
                blocks = [record.field(c).flatten() for c in ("rows1", "rows2")]
                (names1, *own), (names2, *other) = (_keys(b, False) for b in blocks)
                none = np.iinfo(np.int64).max
                value = blocks[1].field("measure").fill_null(none).to_numpy(zero_copy_only=False)
                taken = pa.array(names1, pa.string())
                for begin, table in _table(*own, len(names1), *other, len(names2), held, max(1, counted // max(1, len(names2)))):
                    cells = table.astype(np.int64)
                    width = int(cells.max(initial=0)) + 1
                    key = (np.arange(len(cells))[:, None] * width + cells).reshape(-1)
                    n, least = np.bincount(key, minlength=len(cells) * width), np.full(len(cells) * width, none)
                    np.minimum.at(least, key, np.broadcast_to(value, cells.shape).reshape(-1))
                    at = np.flatnonzero((n > 0) & (np.arange(len(n)) % width > 0))  # pairs without a shared motif have no row
                    if len(at):
                        columns = [taken.take(pa.array(at // width + begin)), pa.array(at % width), pa.array(n[at]), pa.array(least[at], mask=least[at] == none)]
                        yield pa.RecordBatch.from_arrays(columns, ["acr", "n_motifs", "n", "least"])

    met = _block_pairs(left, right, None, ("k",), measure).mapInArrow(run, "acr string, n_motifs long, n long, least long")
    return met.groupBy("acr", "n_motifs").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def global_chains(left: DataFrame, right: DataFrame | None = None, weights: DataFrame | None = None, missing: float | None = None) -> DataFrame:
    """(acr1, acr2, chain, n_anchors): the longest (with weights: heaviest) chain, forward or with right's order reversed.

    weights: (motif, score); missing: that of motifs without one, None: such a motif shared by two regions is an error.
    """
    best = batches.chain_lengths if weights is None else batches.chain_weights
    return _chained(left, right, weights, missing, lambda pairs: {"chain": best(pairs).astype(float)}, "chain double, ")


def native_global_chains(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """As global_chains without weights, by a patience fold in SQL functions; for checks and small regions."""
    pairs = anchors(left, right).groupBy("acr1", "acr2").agg(F.count("*").alias("n_anchors"), F.collect_list(F.struct("a", "c")).alias("m"))

    def longest(turn: int):
        ordered = F.transform(F.array_sort(F.transform("m", lambda x: F.struct(x["a"].alias("a"), (-turn * x["c"]).alias("nc")))), lambda x: -x["nc"])
        empty = F.array().cast("array<int>")
        grown = lambda s, x: F.when((F.size(s) == 0) | (F.element_at(s, F.greatest(F.size(s), F.lit(1))) < x), F.concat(s, F.array(x))).otherwise(F.transform(s, lambda v, i: F.when((v >= x) & ((i == 0) | (F.get(s, i - 1) < x)), x).otherwise(v)))
        return F.size(F.aggregate(ordered, empty, lambda s, x: F.when(F.size(s) == 0, F.array(x)).otherwise(grown(s, x))))

    return pairs.select("acr1", "acr2", F.greatest(longest(1), longest(-1)).cast("double").alias("chain"), "n_anchors")


def local_chains(left: DataFrame, right: DataFrame | None = None, weights: DataFrame | None = None, missing: float | None = None, match: float = MATCH, mismatch: float = MISMATCH, gap: float = GAP, compat: bool = False, lengths: bool = True) -> DataFrame:
    """(acr1, acr2, score, chain_len, n_anchors): the best local chain, forward or reversed, by (score, length).

    With weights an anchor's match score is its weight; compat: times `match`. Positions should be ordinals. lengths: False leaves
    chain_len out; then pairs of very many anchors take far less than the square of their number.
    """
    use = weights is not None
    worth = lambda own: own * match if use and compat else own if use else np.full(len(own), float(match))

    def found(pairs: batches.Pairs) -> dict[str, np.ndarray]:
        scores, sizes, _ = batches.local_chains(pairs, worth(pairs.v[: len(pairs.v) // 2]), mismatch, gap)
        return {"score": scores, "chain_len": sizes.astype(np.int32)}

    def scored(pairs: batches.Pairs) -> dict[str, np.ndarray]:
        return {"score": batches.local_scores(pairs, worth(pairs.v[: len(pairs.v) // 2]), mismatch, gap)}

    return _chained(left, right, weights, missing, found, "score double, chain_len int, ") if lengths else _chained(left, right, weights, missing, scored, "score double, ")
