"""Language-model scoring with an Elias-Fano n-gram trie, whose levels lie in shards that are served where their counts meet."""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.llm import elias_fano as ef
from colinear.llm.langid import held_out
from colinear.llm.words import column, hashed_words, mixed
from colinear.session import forget, stored, table

#: Weight of the lower order, in tokens: p(w | context) = (count + WEIGHT * p(w | shorter context)) / (context's count + WEIGHT).
WEIGHT = {2: 20.0, 3: 5.0}
#: Tokens of a block of texts, and about as many entries as a shard of a level has.
BLOCK, SHARD = 800_000, 1_000_000
#: A level's parts are served in as many rounds, so that its n-grams aren't all on their way at once.
ROUNDS = {1: 1, 2: 1, 3: 2}
#: Blocks are scored in as many rounds, so that the stored blocks and answers don't all stand beside their shuffle.
SCORED = 3
#: Contexts of SHARD / 4 tokens or more, and of a millionth of all at least, are split by their successors: a million at most.
FREQUENT = 1_000_000
_END = np.uint64(0x9E3779B97F4A7C15)  # the end of a text, a token
_A, _B = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)
#: Probabilities and weights are kept as logarithms in steps of a 4000th of a decade; 0: none.
_STEPS = 4000
_VALUE = np.concatenate([[0.0], 10.0 ** (-np.arange(65535) / _STEPS)])


def _coded(x: np.ndarray) -> np.ndarray:
    return (1 + np.minimum(65534, np.rint(-np.log10(x) * _STEPS))).astype(np.uint16)


_PLAIN = (1, 2, 4, 8)  # bytes of numpy's own integers


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs."""
    x = np.ascontiguousarray(x.astype(np.uint64))
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + (x.astype(f"u{width}") if width in _PLAIN else x.view("V8").astype(f"V{width}")).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    return np.frombuffer(raw, f"u{width}", offset=1).astype(np.uint64) if width in _PLAIN else np.frombuffer(raw, f"V{width}", offset=1).astype("V8").view(np.uint64)


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(x: np.ndarray) -> bytes:
    """Numbers from 0 whose values repeat: their bytes by place, compressed."""
    raw = packed(x)
    return raw[:1] + _zstd()[0].compress(np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0]).T.tobytes())


def unsqueezed(raw: bytes) -> np.ndarray:
    body = np.frombuffer(_zstd()[1].decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, : raw[0]] = body.T
    return out.view(np.uint64).ravel()


def packed_rising(x: np.ndarray) -> bytes:
    """Ascending numbers: the first, and the steps between them."""
    return x[:1].tobytes() + packed(np.diff(x))


def unpacked_rising(raw: bytes) -> np.ndarray:
    if not len(raw[:8]) == 8:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(raw, np.uint64, 1)
    return np.concatenate([first, first + np.cumsum(unpacked(raw[8:]), dtype=np.uint64)])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _ordered(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order by context, then word of 48 bits: by one number of leading bits of both; what these don't tell apart is ordered after."""
    if not len(context):
        return np.zeros(0, np.int64)
    low = context.min()
    spread = np.uint64(64 - int(context.max() - low).bit_length())
    key = (context - low << spread if spread < 64 else context - low) & ~np.uint64(0xFFFFFF) | word >> np.uint64(24)
    order = np.argsort(key)
    key, context, word = key[order], context[order], word[order]
    doubt, head = np.zeros(len(key), bool), key >> np.uint64(24)
    for link, differ in ((head[1:] == head[:-1], context[1:] != context[:-1]), (key[1:] == key[:-1], word[1:] != word[:-1])):
        at = np.flatnonzero(link & differ)
        if len(at):  # the whole runs that these are of
            run = np.concatenate([[0], np.cumsum(~link)])
            of = np.zeros(run[-1] + 1, bool)
            of[run[at]] = True
            doubt |= of[run]
    many = np.flatnonzero(doubt)
    if len(many):
        order[many] = order[many[np.lexsort((word[many], context[many]))]]
    return order


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


# ---- blocks of texts -------------------------------------------------------------------------------------------------

_BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())])
_BLOCK_DDL = "block long, n long, doc_ids array<long>, held array<boolean>, sizes binary, words binary, tokens binary"


def blocks_of(docs: DataFrame, held: Column) -> DataFrame:
    """Whole texts in blocks of about BLOCK tokens: the hashes of a block's words, and each token as its word's place among them."""

    def made(number: int, doc_ids: list, held: list, hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        flat, sizes = np.concatenate(hashes), np.concatenate(counts) + 1
        tokens = np.empty(int(sizes.sum()), np.uint64)
        last = np.cumsum(sizes) - 1
        inner = np.ones(len(tokens), bool)
        inner[last] = False
        tokens[last], tokens[inner] = _END, flat
        words, places = np.unique(tokens, return_inverse=True)
        block = (TaskContext.get().partitionId() << 33) + number
        return pa.RecordBatch.from_pylist([{"block": block, "n": len(tokens), "doc_ids": doc_ids, "held": held, "sizes": packed(sizes), "words": packed_rising(words), "tokens": squeezed(places)}], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, doc_ids, flags, hashes, counts, size = 0, [], [], [], [], 0
        for batch in batches:
            ids, own, texts, at = column(batch, "doc_id"), column(batch, "held"), column(batch, "text"), 0
            while at < len(texts):
                start, read = at, 0
                while at < len(texts) and read < 2_000_000:
                    read, at = read + len(texts[at] or b""), at + 1
                h, c = hashed_words(texts[start:at])
                doc_ids += ids[start:at]
                flags += own[start:at]
                hashes.append(h)
                counts.append(c)
                size += len(h) + len(c)
                if size >= BLOCK:
                    yield made(number, doc_ids, flags, hashes, counts)
                    number, doc_ids, flags, hashes, counts, size = number + 1, [], [], [], [], 0
        if doc_ids:
            yield made(number, doc_ids, flags, hashes, counts)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.col("text").cast("binary").alias("text"))
    return wanted.mapInArrow(run, _BLOCK_DDL)


class Block:
    """A block's tokens and their n-grams."""

    def __init__(self, row: dict):
        self.sizes, self.words = unpacked(row["sizes"]).astype(np.int64), unpacked_rising(row["words"])
        self.tokens, self.held = unsqueezed(row["tokens"]).astype(np.int64), np.array(row["held"], bool)

    def entries(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the contexts in order, a number of context and word for each token that orders by the contexts' hash, then the word's).

        Contexts of two words are told apart by their hash.
        """
        n, t = len(self.words), self.tokens
        if level == 1:
            return self.words, t
        end, starts = int(np.searchsorted(self.words, _END)), np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(t)
        before[1:] = t[:-1]
        before[starts] = end
        if level == 2:
            return self.words, before * n + t
        second = np.empty_like(t)
        second[2:] = t[:-2]
        second[starts] = end
        second[starts[self.sizes > 1] + 1] = end
        hashes, at = np.unique(pair_hash(self.words[second], self.words[before] >> np.uint64(16)), return_inverse=True)
        return hashes, at * n + t

    def split(self, level: int, contexts: np.ndarray, entries: np.ndarray, frequent: np.ndarray, parts: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct entries -> (part, 1 if of frequent contexts, places among the entries, context hashes, word hashes of 48 bits).

        A context's entries are of one part, those of a frequent context are dealt by their words.
        """
        if level == 1:
            cuts = np.searchsorted(_part(self.words[entries], parts), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                own = np.arange(cuts[p], cuts[p + 1])
                yield p, 0, own, self.words[entries[own]], own[:0]
            return
        n = len(self.words)
        of = entries // n
        context, word = contexts[of], self.words[entries - of * n] >> np.uint64(16)
        split = np.isin(context, frequent) if len(frequent) else np.zeros(len(context), bool)
        for flag, own in ((0, np.flatnonzero(~split)), (1, np.flatnonzero(split))):
            part = _part(mixed(context[own] + word[own] * _A) if flag else context[own], parts)
            if flag:
                order = np.argsort(part, kind="stable")
                own, part = own[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                at = own[cuts[p] : cuts[p + 1]]
                yield p, flag, at, context[at], word[at]


def pair_hash(first: np.ndarray, second48: np.ndarray) -> np.ndarray:
    """Hash of the context of two words, from the first's hash and 48 bits of the second's."""
    return mixed((first >> np.uint64(16)) * _A + second48 * _B)


# ---- levels ----------------------------------------------------------------------------------------------------------


def build_level(level: int, context: np.ndarray, word: np.ndarray, count: np.ndarray, total: np.ndarray) -> bytes:
    """A shard of a level as one blob, from n-grams in order of context and word, their counts and their contexts' counts.

    Contexts are an Elias-Fano sequence, pointers to their successors another one; a successor is kept relative to its
    context, as its word's place in the shard's vocabulary. A probability (its count's part) belongs to each, and a weight of
    the lower order to each context, both quantised. Words (level 1) have running counts instead.
    """
    if level == 1:
        return ef.pack(ef.encode(context, 1 << 64, "word") | ef.encode(np.concatenate([[0], np.cumsum(count)]), int(count.sum()) + 1, "total"))
    first = _starts(context)
    vocabulary, place = np.unique(word, return_inverse=True)
    of = np.repeat(np.arange(len(first)), np.diff(first, append=len(context)))
    m = len(vocabulary)
    sequences = ef.encode(context[first], 1 << 64, "context") | ef.encode(vocabulary, 1 << 48, "word") | ef.encode(np.append(first, len(context)), len(context) + 1, "pointer") | ef.encode(of * m + place, max(1, len(first) * m), "child")
    return ef.pack(sequences | {"part": _coded(count / (total + WEIGHT[level])), "rest": _coded(WEIGHT[level] / (total[first] + WEIGHT[level]))})


class Level:
    """A shard of a level in a memory map."""

    def __init__(self, blob: bytes):
        self.map = mmap.mmap(-1, len(blob))
        self.map.write(blob)
        self.arrays = ef.unpack(np.frombuffer(self.map, np.uint8))
        self.sequences = {k.split(".")[0]: ef.Sequence(self.arrays, k.split(".")[0]) for k in self.arrays if k.endswith(".meta")}

    def counts(self, words: np.ndarray) -> np.ndarray:
        i, there = self.sequences["word"].find(words)
        i = np.where(there, i, 0)
        total = self.sequences["total"]
        return np.where(there, total.at(i + 1) - total.at(i), 0).astype(np.int64) if total.n > 1 else np.zeros(len(words), np.int64)

    def probabilities(self, context: np.ndarray, runs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the n-grams' parts, codes of the contexts' weights), 0 where training has none; runs: how many words each context has.

        A context's pointers bound its successors, among which the search is for the word relative to the context.
        """
        s = self.sequences
        i, there = s["context"].find(context)
        rest = np.where(there, self.arrays["rest"][np.where(there, i, 0)], 0) if s["context"].n else np.zeros(len(context), np.uint16)
        part = np.zeros(len(word), np.uint16)
        known, back = np.unique(word, return_inverse=True)
        place, held = s["word"].find(known)
        at = np.flatnonzero(np.repeat(there, runs) & held[back])
        if len(at):
            begin, end = (np.repeat(x.astype(np.int64), runs)[at] for x in (s["pointer"].at(np.where(there, i, 0)), s["pointer"].at(np.where(there, i, 0) + 1)))
            j, found = s["child"].find((np.repeat(i, runs)[at] * s["word"].n + place[back[at]]).astype(np.uint64))
            hit = found & (j >= begin) & (j < end)
            part[at[hit]] = self.arrays["part"][j[hit]]
        return part, rest


_SERVED = "kind int, level int, block long, part long, hot int, a binary, g binary, key long, n long, m long"


@dataclass(frozen=True)
class Frequent:
    """Contexts that are split: their hashes in order, and their training counts, which no shard has whole."""

    keys: np.ndarray
    counts: np.ndarray


def _requests(blocks: DataFrame, level: int, parts: int, shared, turn: int) -> DataFrame:
    """A row for each block and part of this turn: the block's distinct n-grams there, and how often they occur, in training too."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("hot", pa.int32()), *[(x, pa.binary()) for x in ("context", "runs", "word", "every", "train")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value.keys
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                contexts, codes = block.entries(level)
                codes = codes * 2 + np.repeat(block.held, block.sizes)
                if ROUNDS[level] > 1:  # words of frequent contexts may be of any part
                    wanted = (_part(contexts, parts) % ROUNDS[level] == turn) | np.isin(contexts, frequent)
                    codes = codes[wanted[codes // (2 * len(block.words))]]
                    if not len(codes):
                        continue
                codes = np.sort(codes)
                first = _starts(codes >> 1)
                every = np.diff(first, append=len(codes))
                train = every - np.add.reduceat(codes & 1, first)
                rows = []
                for part, hot, own, context, word in block.split(level, contexts, codes[first] >> 1, frequent, parts):
                    if part % ROUNDS[level] != turn:
                        continue
                    begins = _starts(context)
                    rows.append({"part": part, "block": row["block"], "hot": hot, "context": _order(context[begins], hot), "runs": packed(np.diff(begins, append=len(context))), "word": packed(word), "every": packed(every[own]), "train": packed(train[own])})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return blocks.mapInArrow(run, "part long, block long, hot int, context binary, runs binary, word binary, every binary, train binary")


def _order(x: np.ndarray, hot: int) -> bytes:
    return packed(x) if hot else packed_rising(x)


def _served(requests: DataFrame, level: int, least: int, shared, keep: bool) -> DataFrame:
    """A level: each part merges its counts into a shard, and answers its blocks from it.

    Rows by kind. 0: a block's codes (level 1: training counts) in the order of its request; 1: an n-gram of `least` tokens or more as a
    context of the next level (its hash, all and training tokens); 2: a part's tokens and words; 3, with keep: the shard.
    """

    def serve(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        contexts = [(unpacked if r["hot"] else unpacked_rising)(r["context"]) for r in rows]
        runs = [unpacked(r["runs"]).astype(np.int64) for r in rows]
        words = [unpacked(r["word"]) for r in rows]
        context = np.concatenate([np.repeat(c, n) for c, n in zip(contexts, runs)])
        word = np.concatenate(words) if level > 1 else np.zeros(len(context), np.uint64)
        every, train = (np.concatenate([unpacked(r[x]) for r in rows]).astype(np.int64) for x in ("every", "train"))
        order = _ordered(context, word)
        context, word = context[order], word[order]
        first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
        every, train = np.add.reduceat(every[order], first), np.add.reduceat(train[order], first)
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
        context, word = context[first], word[first]
        seen = np.flatnonzero(train)
        begins = _starts(context[seen])
        total = np.repeat(np.add.reduceat(train[seen], begins), np.diff(begins, append=len(seen))) if len(seen) else train[:0]
        split = shared.value
        if len(split.keys) and len(seen):
            i = np.minimum(np.searchsorted(split.keys, context[seen]), len(split.keys) - 1)
            total = np.where(split.keys[i] == context[seen], split.counts[i], total)
        blob = build_level(level, context[seen], word[seen], train[seen], total)
        shard, part = Level(blob), rows[0]["part"]
        blank = {"level": level, "part": part, "block": 0, "hot": 0, "a": None, "g": None, "key": 0, "n": 0, "m": 0}
        out, at = [blank | {"kind": 2, "n": int(train.sum()), "m": len(seen)}], 0
        if level == 1:
            answers = train.copy()
            asked = np.flatnonzero(every > train)
            answers[asked] = shard.counts(context[asked])
        else:
            starts = _starts(context)
            runs_ = np.diff(starts, append=len(context))
            # training's own n-grams stand where they were put; what held-out texts ask for is searched
            answers = np.zeros(len(context), np.uint16)
            answers[seen] = shard.arrays["part"]
            asked = np.flatnonzero(every > train)
            first_asked = _starts(context[asked])
            answers[asked], _ = shard.probabilities(context[asked][first_asked], np.diff(first_asked, append=len(asked)), word[asked])
            known = np.add.reduceat(train, starts) > 0
            rest = np.zeros(len(starts), np.uint16)
            rest[known] = shard.arrays["rest"]
            if len(split.keys):  # a split context's successors here may all be unseen ones
                i = np.minimum(np.searchsorted(split.keys, context[starts]), len(split.keys) - 1)
                whole = np.where(split.keys[i] == context[starts], split.counts[i], 0)
                rest = np.where(whole > 0, _coded(WEIGHT[level] / (whole + WEIGHT[level])), rest)
            of = np.repeat(np.arange(len(starts)), runs_)
        for r, n in zip(rows, runs):
            size = int(n.sum())
            own = place[at : at + size]
            at += size
            weights = squeezed(rest[of[own[np.cumsum(n) - n]]]) if level > 1 else None
            out.append(blank | {"kind": 0, "block": r["block"], "hot": r["hot"], "a": squeezed(answers[own]), "g": weights})
        if level < 3:
            many = np.flatnonzero(every >= least)
            keys = context[many] if level == 1 else pair_hash(context[many], word[many])
            out += [blank | {"kind": 1, "key": int(k), "n": int(e), "m": int(t)} for k, e, t in zip(keys.view(np.int64), every[many], train[many])]
        if keep:
            out.append(blank | {"kind": 3, "a": blob})
        return pa.Table.from_pylist(out, schema=_SERVED_SCHEMA)

    return requests.groupBy("part").applyInArrow(serve, _SERVED)


_SERVED_SCHEMA = pa.schema([("kind", pa.int32()), ("level", pa.int32()), ("block", pa.int64()), ("part", pa.int64()), ("hot", pa.int32()), ("a", pa.binary()), ("g", pa.binary()), ("key", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])


@dataclass(frozen=True)
class Trained:
    """What the levels' tables are, and the numbers that scoring needs: parts of a level, tokens and words of training, split contexts."""

    tables: list[DataFrame]
    parts: int
    n: int
    v: int
    frequent: list


def trained(blocks: DataFrame, keep: bool = False) -> Trained:
    """The levels of orders 1 to 3 over all training texts of the blocks, each answering all blocks."""
    sc = blocks.sparkSession.sparkContext
    every, docs = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()
    parts, least = max(16, every // SHARD + 1), max(SHARD // 4, every // FREQUENT)
    shared, tables, frequent, n, v = sc.broadcast(Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))), [], [], 0, 0
    for level in (1, 2, 3):
        turns = [stored(_served(_requests(blocks, level, parts, shared, turn), level, least, shared, keep)) for turn in range(ROUNDS[level])]
        served = reduce(DataFrame.union, turns)
        tables += turns
        frequent.append(shared)
        if level == 1:
            n, v = served.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        if level < 3:  # FREQUENT rows at most, as each has a millionth of all tokens
            rows = [(r.key, r.m) for r in served.where("kind = 1").select("key", "m").toLocalIterator()]
            start = pair_hash(np.array([_END]), np.array([_END >> np.uint64(16)])).view(np.int64)
            if level == 2 and docs >= least:  # no pair, but the context of every first token
                rows = [x for x in rows if x[0] != int(start[0])] + [(int(start[0]), docs)]
            keys, counts = np.array([x for x, _ in rows], np.int64).view(np.uint64), np.array([x for _, x in rows], np.int64)
            order = np.argsort(keys)
            shared = sc.broadcast(Frequent(keys[order], counts[order]))
    return Trained(tables, int(parts), int(n), int(v), frequent)


def levels(docs: DataFrame) -> DataFrame:
    """(level, part, blob): the shards of the trie over all docs, a table in the shared folder. Level opens a blob."""
    blocks = stored(blocks_of(docs, F.lit(False)))
    model = trained(blocks, True)
    return reduce(DataFrame.union, [t.where("kind = 3").select("level", "part", F.col("a").alias("blob")) for t in model.tables])


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scored(docs: DataFrame, held: Column) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row.

    The model learns from the rows that held (null: false) doesn't hold out. A null or empty text is one end. Rows without a doc_id and
    repeated rows count and score like any other. Without training tokens every probability is 1. No text or model goes to
    the driver or to every task: blocks of texts send their n-grams to the shards and get codes back.
    """
    blocks = stored(blocks_of(docs, held), "zstd")
    model = trained(blocks)
    n, v, parts, frequent = model.n, model.v, model.parts, model.frequent

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _SCORED.empty_table()
        row = left.to_pylist()[0]
        block = Block(row)
        answers = {(r["level"], r["part"], r["hot"]): (r["a"], r["g"]) for r in right.to_pylist()}
        p, counts = None, None
        for level in (1, 2, 3):
            contexts, codes = block.entries(level)
            distinct, at = (np.arange(len(block.words)), codes) if level == 1 else np.unique(codes, return_inverse=True)
            found, weight = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            for part, hot, own, context, _ in block.split(level, contexts, distinct, frequent[level - 1].value.keys, parts):
                a, g = answers[level, part, hot]
                found[own] = unsqueezed(a)
                if g is not None:
                    weight[own] = np.repeat(unsqueezed(g), np.diff(_starts(context), append=len(context)))
            if level == 1:
                counts = found[at]
                p = (counts + 1.0) / (n + v + 1.0)
            else:
                p = _VALUE[found][at] + np.where(weight == 0, 1.0, _VALUE[weight])[at] * p
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        total = lambda x: np.bincount(doc, x, len(block.sizes))
        base = np.log10(counts + 1.0) - np.log10(n + v + 1.0)
        return pa.Table.from_arrays(
            [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"]), pa.array(block.sizes), pa.array(total(counts > 0).astype(np.int64)), pa.array(np.full(len(block.sizes), n, np.int64)), pa.array(total(base)), pa.array(total(np.log10(p)))], schema=_SCORED
        )

    answers = [t.where("kind = 0").select("block", "level", "part", "hot", "a", "g") for t in model.tables]
    every, turns = reduce(DataFrame.union, answers), []
    for turn in range(SCORED):
        left, right = (t.where(F.pmod(F.xxhash64("block"), F.lit(SCORED)) == turn).groupBy("block") for t in (blocks, every))
        turns.append(stored(left.cogroup(right).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")))
    for t in [blocks, *model.tables]:
        forget(t)
    return reduce(DataFrame.union, turns)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(7))
