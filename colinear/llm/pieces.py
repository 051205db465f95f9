"""SentencePiece BPE encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.llm.words import column
from colinear.session import table

#: Chance that a candidate merge is skipped, and the seed of the keyed hash that decides.
DROPOUT, SEED = 0.1, 7
_M64 = (1 << 64) - 1
_STEP, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_SPACE = "▁"
#: Characters cut at once, units in a matrix, and the sizes of units that share a matrix; longer units go one by one.
_CHARS, _COLUMNS = 400_000, 1 << 15
_SIZES = (3, 5, 7, 9, 12, 16, 24, 40, 63)
_NONE = np.int32(2**31 - 1)
_CODE = 0x110000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(_M1)
    x = (x ^ x >> np.uint64(27)) * np.uint64(_M2)
    return x ^ x >> np.uint64(31)


def _mixed_one(x: int) -> int:
    x = (x ^ x >> 30) * _M1 & _M64
    x = (x ^ x >> 27) * _M2 & _M64
    return x ^ x >> 31


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """BPE pieces of a SentencePiece model with byte fallback, identity normaliser, a dummy prefix and blanks kept.

    A symbol is the id of a piece, or for a character without one the number of pieces plus its code point.
    """

    def __init__(self, proto: bytes, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.n = model.get_piece_size()
        if n > 1 << 16:
            raise ValueError("Codec: at most 65536 pieces")
        if not 0 <= dropout <= 1:
            raise ValueError("Codec: dropout must be from 0 to 1")
        self.byte_id, self.surface = np.zeros(256, np.int32), [b""] * n
        order, ids = [], {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                shown = piece.replace(_SPACE, " ")
                if re.search(r"[^ ] |\n", shown):
                    raise ValueError("Codec: a piece crosses a blank, so units can't be cut on their own")
                order.append((-model.get_score(i), i, shown))
                ids[shown], self.surface[i] = i, shown.encode()
        self.symbol = np.arange(n, n + _CODE, dtype=np.int32)  # by code point
        for x, i in ids.items():
            if len(x) == 1:
                self.symbol[ord(x)] = i
        self.ranked = np.zeros(len(order), np.int32)  # piece by rank
        of = lambda x: ids.get(x, n + ord(x) if len(x) == 1 else -1)
        pairs = {}
        for r, (_, i, shown) in enumerate(sorted(order)):
            self.ranked[r] = i
            for k in range(1, len(shown)):
                if (a := of(shown[:k])) >= 0 and (b := of(shown[k:])) >= 0:
                    pairs[a << 21 | b] = r
        self.pairs, self.dropout, self.seed = pairs, dropout, seed
        self.limit = int(dropout * 2.0**64)
        self._table(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open hash table of the pairs that merge: slots of (pair, rank)."""
        self.bits = max(4, (3 * len(keys)).bit_length())
        self.slot_key, self.slot_rank = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, _NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slot_key[at] < 0
            where, first = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.slot_key[where], self.slot_rank[where] = keys[took], ranks[took]
            rest = np.ones(len(keys), bool)
            rest[took] = False
            keys, ranks, at = keys[rest], ranks[rest], at[rest] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_STEP)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of what each two symbols merge into, _NONE for those that don't."""
        keys = a.astype(np.int64) << 21 | b
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] += 1
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _agenda(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of symbols, a unit each -> (the merged symbols of one column after another, how many each has).

        At each step a unit's candidate of the best rank, leftmost first, is merged, or skipped for good if the keyed hash of
        document, place and candidate (its rank and where its two sides begin) says so. A symbol stays where it begins.
        """
        height, width = symbols.shape
        rows = np.arange(height, dtype=np.int32)[:, None]
        alive = rows < sizes
        after = np.broadcast_to(rows + 1, symbols.shape).astype(np.int32).ravel()  # where the next symbol begins
        before = np.broadcast_to(rows - 1, symbols.shape).astype(np.int32).ravel()
        ranks = self._ranks(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(height - 1, width)
        agenda = np.full(symbols.shape, _NONE, np.int32)
        agenda[:-1] = np.where((ranks != _NONE) & alive[1:], ranks << 6 | rows[:-1], _NONE)  # the rank, and ties by place
        flat, todo, on = symbols.ravel(), agenda.ravel(), alive.ravel()

        def enter(left: np.ndarray, right: np.ndarray, c: np.ndarray) -> None:
            r = self._ranks(flat[left * width + c], flat[right * width + c])
            todo[left * width + c] = np.where(r != _NONE, r << 6 | left.astype(np.int32), _NONE)

        while True:
            best = agenda.min(0)
            c = np.flatnonzero(best != _NONE)
            if not len(c):
                break
            value = best[c]
            left, rank = (value & 63).astype(np.int64), value >> 6
            at = left * width + c
            right = after[at].astype(np.int64)
            if self.dropout:
                skip = self._skipped(keys[c], rank, left, right)
                todo[at[skip]] = _NONE
                c, left, right, at, rank = c[~skip], left[~skip], right[~skip], at[~skip], rank[~skip]
            gone = right * width + c
            flat[at] = self.ranked[rank]
            on[gone], todo[gone], todo[at] = False, _NONE, _NONE
            then = after[gone].astype(np.int64)
            after[at] = then
            more = then < sizes[c]
            before[then[more] * width + c[more]] = left[more]
            enter(left[more], then[more], c[more])
            first = before[at].astype(np.int64)
            some = first >= 0
            enter(first[some], left[some], c[some])
        return symbols.T[alive.T], alive.sum(0)

    def _skipped(self, keys: np.ndarray, rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.dropout >= 1:
            return np.ones(len(keys), bool)
        candidate = rank.astype(np.uint64) << np.uint64(42) | left.astype(np.uint64) << np.uint64(21) | right.astype(np.uint64)
        return _mixed(keys + candidate * np.uint64(_STEP)) < np.uint64(self.limit)

    def _agenda_long(self, symbols: list[int], key: int) -> list[int]:
        """The same for one unit of any size, by a heap."""
        rank, n = self.pairs.get, len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank(symbols[i] << 21 | symbols[i + 1])) is not None]
        heapify(heap)

        def enter(i: int, j: int) -> None:
            if (r := rank(symbols[i] << 21 | symbols[j])) is not None:
                heappush(heap, (r, i, symbols[i], symbols[j]))

        while heap:
            r, i, a, b = heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            if self.dropout and (self.dropout >= 1 or _mixed_one(key + (r << 42 | (i & 0x1FFFFF) << 21 | j & 0x1FFFFF) * _STEP & _M64) < self.limit):
                continue
            symbols[i], symbols[j] = int(self.ranked[r]), -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                enter(i, right[i])
            if left[i] >= 0:
                enter(left[i], i)
        return [x for x in symbols if x >= 0]

    def encode_all(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray]:
        """Ids of whole texts; keys: what tells documents apart. Null and empty texts have none."""
        out, at = [], 0
        while at < len(texts):
            start, size = at, 0
            while at < len(texts) and size < _CHARS:
                size, at = size + len(texts[at] or ""), at + 1
            out += self._encode_some(texts[start:at], keys[start:at])
        return out

    def _encode_some(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray]:
        own = [" " + t if t else "" for t in texts]
        code = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
        if not len(code):
            return [np.zeros(0, np.uint16) for _ in texts]
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        blank, line = code == 32, code == 10
        begins = line.copy()  # a unit: blanks and what follows them up to the next blank; a newline
        begins[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        begins[0] = True
        begins[ends[:-1][ends[:-1] < len(code)]] = True
        at = np.flatnonzero(begins)
        sizes = np.diff(at, append=len(code))
        doc = np.searchsorted(ends, at, "right")
        first = np.searchsorted(at, ends - [len(x) for x in own])  # of each text
        place = (np.arange(len(at)) - first[doc]).astype(np.uint64)
        texts_key = _mixed(np.array([(k * _STEP + self.seed) & _M64 for k in keys], np.uint64))
        unit_key = _mixed(texts_key[doc] + place * np.uint64(_STEP))
        symbol = self.symbol[code]
        counts, parts = np.ones(len(at), np.int64), [(np.flatnonzero(sizes == 1), symbol[at[sizes == 1]])]
        least = 1
        for most in _SIZES:
            wanted = np.flatnonzero((sizes > least) & (sizes <= most))
            for k in range(0, len(wanted), _COLUMNS):
                units = wanted[k : k + _COLUMNS]
                where = at[units] + np.arange(most)[:, None]
                flat, counts[units] = self._agenda(symbol[np.minimum(where, len(symbol) - 1)], sizes[units], unit_key[units])
                parts.append((units, flat))
            least = most
        for u in np.flatnonzero(sizes > least).tolist():
            cut = self._agenda_long(symbol[at[u] : at[u] + sizes[u]].tolist(), int(unit_key[u]))
            counts[u] = len(cut)
            parts.append((np.array([u]), np.array(cut, np.int32)))
        starts = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(starts[-1], np.int32)
        for units, flat in parts:
            n = counts[units]
            out[np.repeat(starts[units] - np.cumsum(n) + n, n) + np.arange(len(flat))] = flat
        bounds = starts[np.append(first, len(at))]
        bare = out >= self.n
        if bare.any():  # characters without a piece become bytes
            points = (out[bare] - self.n).astype(np.uint32)
            widths = np.ones(len(out), np.int64)
            widths[bare] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            out, raw = np.repeat(out, widths), np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
            out[np.repeat(bare, widths)] = self.byte_id[raw]
            bounds = np.concatenate([[0], np.cumsum(widths)])[bounds]
        out = out.astype(np.uint16)
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, text: str | None, key: int = 0) -> np.ndarray:
        return self.encode_all([text], [key])[0]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids; the dummy prefix goes. An id that is no piece's is an error."""
        if ids and not (0 <= min(ids) and max(ids) < self.n):
            raise ValueError("decode: an id that is no piece's")
        return b"".join(map(self.surface.__getitem__, ids))[1:]


def _proto(df: DataFrame, model: str | None):
    with open(model or default_model(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # the model file, whatever the corpus


def encoded(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids array<int>, n_tokens, n_fallback, lossless), a row for each row.

    ids decode to the text, byte for byte; lossless is the result of doing so. Null and empty texts have no ids.
    The cut depends on seed, doc_id (null: 0), place and candidate only, so repeated rows and retried tasks give the same ids.
    """
    shared = _proto(docs, model)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_fallback", pa.int64()), ("lossless", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, dropout, seed)
        is_byte = np.zeros(1 << 16, bool)
        is_byte[codec.byte_id] = True
        for batch in batches:
            doc_ids, texts = column(batch, "doc_id"), column(batch, "text")
            at = 0
            while at < len(texts):  # blocks of whole texts bound the memory
                start, size = at, 0
                while at < len(texts) and size < 4_000_000:
                    size, at = size + len(texts[at] or ""), at + 1
                own, rows = codec.encode_all(texts[start:at], [x or 0 for x in doc_ids[start:at]]), []
                for doc_id, text, ids in zip(doc_ids[start:at], texts[start:at], own):
                    back = codec.decode(ids.tolist()) if len(ids) else b""
                    rows.append((doc_id, len(ids), int(is_byte[ids].sum()), back == (text or "").encode()))
                flat = np.concatenate(own).astype(np.int32)
                offsets = np.cumsum([0, *map(len, own)]).astype(np.int32)
                doc, n, fallback, same = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(n, pa.int64()), pa.array(fallback, pa.int64()), pa.array(same)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_fallback long, lossless boolean")


def decoded(df: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give an empty text, ids that aren't pieces an error. Ids that end inside a
    character give U+FFFD for what is left of it."""
    shared = _proto(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, 0.0)
        for batch in batches:
            texts = [codec.decode(x or []).decode(errors="replace") for x in column(batch, "ids")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
