"""Chains of many pairs of regions at once: one step of numpy takes the next anchor of every pair. Results equal those of kernels.py."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from colinear.functions import kernels

#: Cells of a block of pairs padded to one width: few enough for the processor's cache.
CELLS, LOCAL_CELLS = 1 << 18, 1 << 16
#: Blocks of fewer rows are left to the kernels for one pair; such pairs are long.
FEW = 12
#: Anchors from which a pair's local score is found by divide and conquer, where its length isn't asked for.
LONG = 2048


def _blocks(sizes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Rows by falling size, cut so that rows times the largest size is about `cells`."""
    order = np.argsort(-sizes, kind="stable")
    order = order[: np.count_nonzero(sizes)]
    at = 0
    while at < len(order):
        stop = min(len(order), at + max(1, cells // int(sizes[order[at]])))
        yield order[at:stop]
        at = stop


def ordering(*keys: np.ndarray) -> np.ndarray:
    """np.lexsort of whole numbers: keys and place are packed into one number each if they fit, which sorts several times as fast."""
    n = len(keys[0])
    packed, bits = np.arange(n), n.bit_length()
    for key in keys if n else ():
        low = int(key.min())
        width = (int(key.max()) - low).bit_length()
        if bits + width > 63:
            return np.lexsort(keys)
        packed |= (key - low) << bits
        bits += width
    packed.sort()
    return packed & ((1 << n.bit_length()) - 1)


def _ranks(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    return np.unique(values, return_inverse=True)[1] if len(values) and (values != values[0]).any() else np.zeros(len(values), np.int64)


class Pairs:
    """Anchors of pairs one after another: pair, x, y and weight of each, and how many each pair has."""

    def __init__(self, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray):
        n = len(sizes)
        # every pair twice: as it is, and with the other side's order reversed
        self.n, self.sizes = n, np.concatenate([sizes, sizes])
        self.pair = np.repeat(np.arange(2 * n), self.sizes)
        self.x, self.y, self.v = np.concatenate([x, x]).astype(np.int64, copy=False), np.concatenate([y, -y]).astype(np.int64, copy=False), np.concatenate([v, v]).astype(float, copy=False)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def best(self, values: np.ndarray) -> np.ndarray:
        return np.maximum(values[: self.n], values[self.n :])

    def padded(self, rows: np.ndarray, values: np.ndarray, fill) -> np.ndarray:
        """Values (those of a pair next to each other) of some pairs, a row each."""
        width = int(self.sizes[rows[0]])
        at = self.starts[rows][:, None] + np.arange(width)
        inside = np.arange(width) < self.sizes[rows][:, None]
        return np.where(inside, values[np.where(inside, at, 0)], fill)


def chain_lengths(pairs: Pairs) -> np.ndarray:
    """Most anchors in a row with both coordinates strictly increasing, by either orientation; patience sorting."""
    order = ordering(-pairs.y, pairs.x, pairs.pair)
    ordered, out = pairs.y[order], np.zeros(len(pairs.sizes))
    for rows in _blocks(pairs.sizes, CELLS):
        if len(rows) < FEW:
            for r in rows:
                own = slice(pairs.starts[r], pairs.starts[r] + pairs.sizes[r])
                out[r] = kernels.chain_length(pairs.x[own].tolist(), pairs.y[own].tolist())
            continue
        y = pairs.padded(rows, ordered, 0)
        sizes, width = pairs.sizes[rows], y.shape[1]
        tails = np.full((len(rows), 2 << width.bit_length()), np.iinfo(np.int64).max)
        flat, base = tails.reshape(-1), np.arange(len(rows)) * tails.shape[1]
        longest, top = np.zeros(len(rows), np.int64), 0
        for t in range(width):
            k = int(np.searchsorted(-sizes, -t))  # rows are by falling size
            value, at = y[:k, t], base[:k].copy()
            for level in range(top.bit_length() - 1, -1, -1):
                step = 1 << level
                at += step * (flat[at + (step - 1)] < value)
            flat[at] = value
            at -= base[:k]
            np.maximum(longest[:k], at + 1, out=longest[:k])
            top = max(top, int(at.max()) + 1)
        out[rows] = longest
    return pairs.best(out)


def chain_weights(pairs: Pairs) -> np.ndarray:
    """Largest total weight of such a row, by either orientation; trees of prefix maxima."""
    order = ordering(_ranks(pairs.v), -pairs.y, pairs.x, pairs.pair)
    by_y = ordering(pairs.y, pairs.pair)
    first = np.ones(len(by_y), bool)
    first[1:] = (np.diff(pairs.y[by_y]) != 0) | (np.diff(pairs.pair[by_y]) != 0)
    steps = np.cumsum(first)
    rank = np.empty(len(by_y), np.int64)
    rank[by_y] = steps - (steps[pairs.starts[pairs.pair[by_y]]] if len(by_y) else 0) + 1
    rank, weight, out = rank[order], pairs.v[order], np.zeros(len(pairs.sizes))
    for rows in _blocks(pairs.sizes, CELLS):
        if len(rows) < FEW:
            for r in rows:
                own = slice(pairs.starts[r], pairs.starts[r] + pairs.sizes[r])
                out[r] = kernels.chain_weight(pairs.x[own].tolist(), pairs.y[own].tolist(), pairs.v[own].tolist())
            continue
        ranks, weights = pairs.padded(rows, rank, 1), pairs.padded(rows, weight, 0.0)
        sizes, width = pairs.sizes[rows], ranks.shape[1]
        most = int(ranks.max())
        tree = np.zeros((len(rows), most + 2))  # the last column takes what falls off the tree
        flat, base = tree.reshape(-1), np.arange(len(rows)) * (most + 2)
        top = np.zeros(len(rows))
        for t in range(width):
            k = int(np.searchsorted(-sizes, -t))
            r, before = ranks[:k, t], np.zeros(k)
            i = r - 1
            while i.any():
                np.maximum(before, flat[base[:k] + i], out=before)  # column 0 stays 0
                i &= i - 1
            total = before + weights[:k, t]
            np.maximum(top[:k], total, out=top[:k])
            i = np.where(total > 0, r, most + 1)
            while (i <= most).any():
                at = base[:k] + i
                flat[at] = np.maximum(flat[at], total)
                i = np.minimum(i + (i & -i), most + 1)
        out[rows] = top
    return pairs.best(out)


def local_chains(pairs: Pairs, match: np.ndarray, mismatch: float, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, length, turned) of the best local chain, by either orientation; match: the score of each anchor (once, not turned)."""
    match = np.concatenate([match, match]).astype(float)
    order = ordering(_ranks(match), -pairs.x, pairs.y, pairs.pair)
    place = np.arange(len(order)) - np.repeat(pairs.starts, pairs.sizes)
    visit = ordering(-place, pairs.x[order], pairs.pair)  # rows stay where their pair is
    scores, lengths = np.zeros(len(pairs.sizes)), np.zeros(len(pairs.sizes), np.int64)
    columns, visit = (pairs.x[order], pairs.y[order], match[order]), place[visit]
    for rows in _blocks(pairs.sizes, LOCAL_CELLS):
        x, y, m = (pairs.padded(rows, c, 0).astype(float) for c in columns)
        turn = pairs.padded(rows, visit, 0)
        sizes, width = pairs.sizes[rows], x.shape[1]
        score, size = np.zeros(x.shape), np.zeros(x.shape, np.int64)
        each = np.arange(len(rows))
        for t in range(width):
            k = int(np.searchsorted(-sizes, -t))
            at, row = turn[:k, t], each[:k]
            most = int(at.max())
            own = m[row, at]
            if not most:
                score[row, at], size[row, at] = own, 1
                continue
            s = score[:k, :most]
            da, dc = x[row, at][:, None] - x[:k, :most], y[row, at][:, None] - y[:k, :most]
            far, near = np.maximum(da, dc), np.minimum(da, dc)
            value = own[:, None] + s + (gap * (far - near) + mismatch * (near - 1))
            value[(s == 0) | (np.arange(most) >= at[:, None])] = -np.inf
            led = np.maximum.accumulate(np.concatenate([own[:, None], value], 1), axis=1)
            ahead = np.where(value >= led[:, :-1], size[:k, :most] + 1, 1).max(1)
            score[row, at], size[row, at] = led[:, -1], ahead
        pad = np.arange(width) >= sizes[:, None]
        score[pad] = -np.inf
        top = score.max(1)
        scores[rows], lengths[rows] = top, np.where(score == top[:, None], size, 0).max(1)
    turned = scores[pairs.n :] > scores[: pairs.n]
    same = scores[pairs.n :] == scores[: pairs.n]
    length = np.where(turned, lengths[pairs.n :], np.where(same, np.maximum(lengths[: pairs.n], lengths[pairs.n :]), lengths[: pairs.n]))
    return pairs.best(scores), length, turned


def local_alignments(of1: np.ndarray, tokens1: np.ndarray, weights: np.ndarray, of2: np.ndarray, tokens2: np.ndarray, n: int, mismatch: float, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, first, last) of the Smith-Waterman alignments of n windows: tokens of the sequence with the score of a match, and of the other.

    Tokens are numbers from 0, those of a window next to each other; of1 and of2 are their windows. A row of every window is a
    step. Each cell carries the row that its path begins in, so no way back is stored: the path that local_alignment takes.
    """
    sizes1, sizes2 = np.bincount(of1, minlength=n), np.bincount(of2, minlength=n)
    starts1, starts2 = np.cumsum(sizes1) - sizes1, np.cumsum(sizes2) - sizes2
    score, first, last = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1)
    for rows in _blocks(sizes1 * (sizes2 > 0), CELLS // max(1, int(sizes2.max(initial=1)))):
        width = int(sizes2[rows].max())
        columns = np.arange(width)
        inside = columns < sizes2[rows][:, None]
        other = np.where(inside, tokens2[np.where(inside, starts2[rows][:, None] + columns, 0)], -1)
        value, begun = np.zeros((len(rows), width + 1)), np.zeros((len(rows), width + 1), np.int64)
        best, best_first, best_last = np.zeros(len(rows)), np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        steps = gap * np.arange(width)
        for i in range(int(sizes1[rows[0]])):
            k = int(np.searchsorted(-sizes1[rows], -i))
            at = starts1[rows[:k]] + i
            old, was = value[:k], begun[:k]
            diagonal = old[:, :-1] + np.where(other[:k] == tokens1[at][:, None], weights[at][:, None], mismatch)
            up = old[:, 1:] + gap
            open_ = np.maximum(np.maximum(diagonal, up), 0.0)
            left = np.full_like(open_, -np.inf)
            left[:, 1:] = np.maximum.accumulate(open_ - steps, 1)[:, :-1] + steps[1:]
            now = np.maximum(open_, left)
            origin = np.where(now == diagonal, np.where(old[:, :-1] > 0, was[:, :-1], i), was[:, 1:])
            source = np.maximum.accumulate(np.where((now == diagonal) | (now == up) | (now == 0), columns, 0), 1)
            value[:k, 1:], begun[:k, 1:] = now, np.take_along_axis(origin, source, 1)
            top = now.argmax(1)
            high = now[np.arange(k), top]
            better = np.flatnonzero(high > best[:k])
            best[better], best_first[better], best_last[better] = high[better], begun[better, top[better] + 1], i
        score[rows], first[rows], last[rows] = best, best_first, best_last
    return score, first, last


def _dominated(y1: np.ndarray, d1: np.ndarray, f: np.ndarray, y2: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """For each point (y2, d2) the largest f of the points with a smaller y1 and no larger d1: in order of y, halves of halves, each sorted by d."""
    n, asks = len(y1) + len(y2), np.concatenate([np.zeros(len(y1), np.int64), np.ones(len(y2), np.int64)])
    order = np.lexsort((1 - asks, np.concatenate([y1, y2])))  # at one y those that ask come first
    full = 1 << max(1, (n - 1).bit_length())
    key = np.full(full, np.iinfo(np.int64).max)
    key[:n] = (2 * np.concatenate([d1, d2]) + asks)[order]
    values, found = np.full(full, -np.inf), np.full(full, -np.inf)
    values[:n] = np.concatenate([f, np.full(len(y2), -np.inf)])[order]
    width = 2
    while width <= full:
        at = key.reshape(-1, width).argsort(1, kind="stable")
        give = np.where(at < width // 2, np.take_along_axis(values.reshape(-1, width), at, 1), -np.inf)
        best = np.empty_like(give)
        np.put_along_axis(best, at, np.maximum.accumulate(give, 1), 1)
        later = found.reshape(-1, width)[:, width // 2 :]
        np.maximum(later, best[:, width // 2 :], out=later)
        width *= 2
    out = np.empty(n)
    out[order] = found[:n]
    return out[len(y1) :]


def local_score(x: np.ndarray, y: np.ndarray, m: np.ndarray, mismatch: float, gap: float, base: int = 96) -> float:
    """The score of kernels.local_chain without its length, in n log^3 n steps: sparse dynamic programming by divide and conquer.

    In order of x (of equal ones the larger y first) the first half of a stretch is finished before what it gives the second: over
    the larger gap in x, the best of the anchors below with no larger x - y; over that in y, of those with a larger x - y.
    """
    if not len(x):
        return 0.0
    order = np.lexsort((-y, x))
    x, y, m = x[order].astype(np.int64), y[order].astype(np.int64), m[order].astype(float)
    d, before, score = x - y, np.full(len(x), -np.inf), np.zeros(len(x))

    def solve(lo: int, hi: int) -> None:
        if hi - lo <= base:
            for i in range(lo, hi):
                j = slice(lo, i)
                da, dc = x[i] - x[j], y[i] - y[j]
                far, near = np.maximum(da, dc), np.minimum(da, dc)
                value = np.where((near > 0) & (score[j] != 0), score[j] + (gap * (far - near) + mismatch * (near - 1)), -np.inf)
                score[i] = m[i] + max(0.0, before[i], value.max(initial=-np.inf))
            return
        mid = (lo + hi) // 2
        solve(lo, mid)
        j, i = lo + np.flatnonzero(score[lo:mid]), np.arange(mid, hi)
        if len(j):
            wide = _dominated(y[j], d[j], score[j] - gap * d[j] - mismatch * y[j], y[i], d[i]) + gap * d[i] + mismatch * (y[i] - 1)
            back = np.argsort(-d[j], kind="stable")
            most = np.maximum.accumulate((score[j] + gap * d[j] - mismatch * x[j])[back])
            k = np.searchsorted(-d[j][back], -d[i], "left")  # those with a larger d
            tall = np.where(k > 0, most[np.maximum(k - 1, 0)], -np.inf) - gap * d[i] + mismatch * (x[i] - 1)
            before[i] = np.maximum(before[i], np.maximum(wide, tall))
        solve(mid, hi)

    solve(0, len(x))
    return float(score.max())


def _short_scores(pairs: Pairs, match: np.ndarray, mismatch: float, gap: float) -> np.ndarray:
    """Scores of local_chains alone: in order of x an anchor meets all before it, pairs side by side in memory."""
    order = ordering(pairs.y, pairs.x, pairs.pair)
    match = np.concatenate([match, match]).astype(float)
    kind = np.float64
    if len(order):  # eighths of under 2^20 are exact in half the bytes
        span = int(np.abs(pairs.x).max()) + int(np.abs(pairs.y).max()) + 1
        most = float(np.abs(match).max()) * int(pairs.sizes.max()) + 4 * (abs(mismatch) + abs(gap) + 1) * span
        if most < 1 << 20 and all((v == np.rint(v)).all() for v in (match * 8, np.array([mismatch, gap]) * 8.0)):
            kind = np.float32
    columns = tuple(c[order].astype(kind) for c in (pairs.x, pairs.y, match))
    mismatch, gap = kind(mismatch), kind(gap)
    scores = np.zeros(len(pairs.sizes))
    for rows in _blocks(pairs.sizes, LOCAL_CELLS):
        x, y, m = (np.ascontiguousarray(pairs.padded(rows, c, kind(0)).T) for c in columns)
        sizes, score = pairs.sizes[rows], np.zeros(x.shape, kind)
        score[0] = m[0]
        top = m[0].copy()
        for t in range(1, len(x)):
            k = int(np.searchsorted(-sizes, -t))
            own, s = m[t, :k], score[:t, :k]
            da, dc = x[t, :k] - x[:t, :k], y[t, :k] - y[:t, :k]
            near = np.minimum(da, dc)
            far = np.maximum(da, dc, out=da)
            out = (near <= 0) | (s == 0)
            far -= near
            far *= gap
            near -= 1
            near *= mismatch
            far += near
            far += np.add(own, s, out=dc)
            np.copyto(far, -np.inf, where=out)
            score[t, :k] = np.maximum(own, far.max(0))
            np.maximum(top[:k], score[t, :k], out=top[:k])
        scores[rows] = top
    return pairs.best(scores)


def local_scores(pairs: Pairs, match: np.ndarray, mismatch: float, gap: float) -> np.ndarray:
    """Scores of local_chains without lengths: long pairs by divide and conquer, so that a pair's time is not the square of its anchors."""
    long = pairs.sizes[: pairs.n] >= LONG
    out = np.zeros(pairs.n)
    if not long.all():
        kept = np.repeat(~long, pairs.sizes[: pairs.n])
        half = len(pairs.x) // 2
        out[~long] = _short_scores(Pairs(pairs.sizes[: pairs.n][~long], pairs.x[:half][kept], pairs.y[:half][kept], pairs.v[:half][kept]) if long.any() else pairs, match[kept], mismatch, gap)
    for k in np.flatnonzero(long):
        own = slice(pairs.starts[k], pairs.starts[k] + pairs.sizes[k])
        out[k] = max(local_score(pairs.x[own], s * pairs.y[own], match[own], mismatch, gap) for s in (1, -1))
    return out


def affine_scores(of1: np.ndarray, codes1: np.ndarray, of2: np.ndarray, codes2: np.ndarray, n: int, free_ends: bool, match: float, mismatch: float, opening: float, extending: float) -> np.ndarray:
    """Scores of kernels.affine_alignment for n cases: a row of every case is a step."""
    sizes1, sizes2 = np.bincount(of1, minlength=n), np.bincount(of2, minlength=n)
    starts1, starts2 = np.cumsum(sizes1) - sizes1, np.cumsum(sizes2) - sizes2
    gap = opening + (sizes1 + sizes2 - 1) * float(extending)
    out = np.where((sizes1 + sizes2 == 0) | ((sizes2 == 0) & free_ends), 0.0, gap)  # those of an empty side
    far = -1e18
    order = np.argsort(-sizes1 * (sizes2 > 0), kind="stable")[: np.count_nonzero(sizes1 * sizes2)]
    held = max(1, LOCAL_CELLS // max(1, int(sizes2.max(initial=1))))
    for at in range(0, len(order), held):
        rows = order[at : at + held]
        width = int(sizes2[rows].max())
        columns, last = np.arange(width), sizes2[rows]
        inside = columns < last[:, None]
        other = np.where(inside, codes2[np.where(inside, starts2[rows][:, None] + columns, 0)], -1)
        steps = np.arange(width + 1) * float(extending)
        whole = np.repeat(np.concatenate([[0.0], opening + columns * float(extending)])[None], len(rows), 0)  # best, the last gap in any state
        down = np.full((len(rows), width + 1), far)  # best that ends in a gap in the second side
        best = np.full(len(rows), far)
        for i in range(int(sizes1[rows[0]])):
            k = int(np.searchsorted(-sizes1[rows], -i))
            old = whole[:k]
            gaps = np.maximum(old + opening, down[:k] + extending)
            if free_ends:
                gaps[:, 0] = 0.0
            now = gaps.copy()
            np.maximum(old[:, :-1] + np.where(other[:k] == codes1[starts1[rows[:k]] + i][:, None], match, mismatch), gaps[:, 1:], out=now[:, 1:])
            across = np.maximum.accumulate(now - steps, 1)[:, :-1] + (opening - extending) + steps[1:]
            np.maximum(now[:, 1:], across, out=now[:, 1:])
            whole[:k], down[:k] = now, gaps
            if free_ends:
                np.maximum(best[:k], now[np.arange(k), last[:k]], out=best[:k])
        out[rows] = np.maximum(best, whole[np.arange(len(rows)), last])
    return out


def global_alignments(of1: np.ndarray, tokens1: np.ndarray, weights: np.ndarray, of2: np.ndarray, tokens2: np.ndarray, n: int, mismatch: float, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Needleman-Wunsch alignments of n cases: for each token of the second side (place, offset): the token of the first side that it
    stands on with offset -1, or the one before which it is put in, and which of those put in there it is.

    weights: the score of a match, by token of the first side. A row of every case is a step, and then a step of every way back; as
    global_alignment, the way back prefers the diagonal, then a blank in the second side.
    """
    sizes1, sizes2 = np.bincount(of1, minlength=n), np.bincount(of2, minlength=n)
    starts1, starts2 = np.cumsum(sizes1) - sizes1, np.cumsum(sizes2) - sizes2
    place, offset = np.zeros(len(of2), np.int64), np.arange(len(of2)) - starts2[of2]  # an empty first side: all are put in before its end
    for rows in _blocks(sizes1 * (sizes2 > 0), max(1, 8 * CELLS // max(1, int(sizes2.max(initial=1))))):
        width, height = int(sizes2[rows].max()), int(sizes1[rows[0]])
        columns = np.arange(width)
        other = np.where(columns < sizes2[rows][:, None], tokens2[np.where(columns < sizes2[rows][:, None], starts2[rows][:, None] + columns, 0)], -1)
        value = np.repeat(gap * np.arange(width + 1)[None], len(rows), 0).astype(float)
        ways = np.full((height + 1, len(rows), width + 1), 2, np.uint8)  # 0: diagonal, 1: up, 2: left
        ways[:, :, 0] = 1
        steps = gap * np.arange(width + 1)
        for i in range(height):
            k = int(np.searchsorted(-sizes1[rows], -i))
            at = starts1[rows[:k]] + i
            old = value[:k]
            diagonal = old[:, :-1] + np.where(other[:k] == tokens1[at][:, None], weights[at][:, None], mismatch)
            up = old + gap
            open_ = up.copy()
            open_[:, 1:] = np.maximum(diagonal, up[:, 1:])
            now = np.maximum.accumulate(open_ - steps, 1) + steps
            np.maximum(now, open_, out=now)
            ways[i + 1, :k, 1:] = np.where(now[:, 1:] == diagonal, 0, np.where(now[:, 1:] == up[:, 1:], 1, 2))
            value[:k] = now
        i, j, each = sizes1[rows].copy(), sizes2[rows].copy(), np.arange(len(rows))
        while (j > 0).any():
            way = np.where(i == 0, 2, np.where(j == 0, 1, ways[i, each, j]))
            puts = np.flatnonzero((j > 0) & (way != 1))
            token = starts2[rows[puts]] + j[puts] - 1
            place[token], offset[token] = np.where(way[puts] == 0, i[puts] - 1, i[puts]), np.where(way[puts] == 0, -1, 0)
            open_ = j > 0
            i, j = np.where(open_ & (way != 2), i - 1, i), np.where(open_ & (way != 1), j - 1, j)
    put = np.flatnonzero(offset >= 0)  # count those put in at one place, from the left
    if len(put):
        new = np.ones(len(put), bool)
        new[1:] = (np.diff(put) != 1) | (np.diff(place[put]) != 0) | (np.diff(of2[put]) != 0)
        begins = np.maximum.accumulate(np.where(new, np.arange(len(put)), 0))
        offset[put] = np.arange(len(put)) - begins
    return place, offset
