"""Repeated strings of a shard by induced suffix sorting with longest common prefixes.

Suffixes that start at a local minimum of the text (S*) are sorted first, and the order of all others
follows from them: the smaller the suffix behind a place, the smaller the place's own suffix among those of
its first character.  That is a monotone priority queue with one queue for each first character: characters
are served in order, and what a queue yields is pushed, with the character before it, to later queues.  Each
tuple carries its place and the common prefix with the one before it; pushing adds one to the smallest common
prefix passed since the last push to that queue.  Queues live in memory up to ``MEMORY`` bytes and on disk
beyond, and all tuples of a character move together as arrays.

To sort S* suffixes, their pieces up to the next one are sorted by the same induction and named, and the
names are sorted.  Only the first ``length`` characters matter, so that last sort doubles the names looked at
until they span ``length`` characters; suffixes alike that far may stand in any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np

from .common import U64, splitmix

MEMORY = 256 << 20


class Rolling:
    """Hashes of any span of a text: polynomials modulo two primes below 2 ** 31, 62 bits together."""

    PRIMES = ((2147483647, 1103515245), (2147483629, 1999292671))

    def __init__(self, chars: np.ndarray):
        values = splitmix(np.arange(int(chars.max(initial=0)) + 1, dtype=U64) + U64(77)) >> U64(34)
        self.parts = []
        for p, base in self.PRIMES:
            sums = np.zeros(len(chars) + 1, U64)
            np.cumsum(values[chars] * _ladder(base, p, len(chars)) % U64(p), out=sums[1:])
            self.parts.append((sums, _ladder(pow(base, -1, p), p, len(chars) + 1), U64(p)))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (end - start).astype(U64)
        for sums, back, p in self.parts:
            out = splitmix(out) ^ ((sums[end] - sums[start]) % p * back[start] % p)
        return out


def _ladder(base: int, p: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo p."""
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate((out, out * U64(pow(base, len(out), p)) % U64(p)))
    return out[:n]


class Queues:
    """Queues of (place, common prefix) arrays, one for each character; the excess over ``memory`` bytes is on disk."""

    def __init__(self, n: int, memory: int = MEMORY):
        self.parts: list[list] = [[] for _ in range(n)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # without a name: gone with the task
            self.held -= pos.nbytes + lcp.nbytes
            at = self.file.seek(0, 2)
            pos.tofile(self.file)
            lcp.tofile(self.file)
            self.parts[c].append((at, len(pos), pos.dtype, lcp.dtype))
        else:
            self.parts[c].append((pos, lcp))

    def take(self, c: int, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        got = []
        for p in self.parts[c]:
            if len(p) == 4:
                self.file.seek(p[0])
                got.append((np.fromfile(self.file, p[2], p[1]), np.fromfile(self.file, p[3], p[1])))
            else:
                got.append(p)
                self.held -= 0 if keep else p[0].nbytes + p[1].nbytes
        if not keep:
            self.parts[c] = []
        if not got:
            return np.zeros(0, np.int32), np.zeros(0, np.int16)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


class RangeMin:
    """Smallest value of x[i + 1 .. j] for arrays i < j."""

    def __init__(self, x: np.ndarray, widest: int):
        self.levels = [x]
        k = 1
        while 2 * k <= max(1, widest):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        width = j - i
        out = np.zeros(len(i), self.levels[0].dtype)
        level = np.frexp(width.astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            v = self.levels[k]
            out[at] = np.minimum(v[i[at] + 1], v[j[at] - (1 << k) + 1])
        return out


class Text:
    """A text ending in its smallest character, with the types of its suffixes."""

    def __init__(self, chars: np.ndarray, cap: int, memory: int = MEMORY):
        n = len(chars)
        self.chars, self.cap, self.memory = chars, cap, memory
        self.size = int(chars.max()) + 1
        change = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        stops = np.append(change, n)
        lengths = np.diff(np.concatenate(([0], stops)))
        up = np.ones(len(stops), bool)  # the last character counts as smaller than nothing after it
        up[:-1] = chars[stops[:-1] - 1] < chars[stops[:-1]]
        self.is_s = np.repeat(up, lengths)
        self.run_end = np.repeat(stops, lengths).astype(np.int32)
        star = self.is_s.copy()
        star[0] = False
        star[1:] &= ~self.is_s[:-1]
        star[n - 1] = True
        self.star = star

    def rounds(self, pos: np.ndarray, lcp: np.ndarray, c: int, lcps: bool) -> tuple[np.ndarray, np.ndarray]:
        """The tuples of a queue with those they push to their own queue, again and again."""
        out_pos, out_lcp, carry = [pos], [lcp], self.cap
        while len(pos):
            before = pos - 1
            at = np.flatnonzero((pos > 0) & (self.chars[np.maximum(before, 0)] == c))
            if not len(at):
                break
            if lcps:
                low = np.minimum.reduceat(np.append(lcp, self.cap), np.concatenate(([0], at + 1)))
                new = np.minimum(low[:-1] + 1, self.cap).astype(np.int16)
                new[0] = min(self.cap, min(carry, int(low[0])) + 1)
                carry = int(low[-1])
            else:
                new = np.zeros(len(at), np.int16)
            pos, lcp = before[at], new
            out_pos.append(pos)
            out_lcp.append(lcp)
        return np.concatenate(out_pos), np.concatenate(out_lcp)

    def serve(self, queues: Queues, pos: np.ndarray, lcp: np.ndarray, wanted: np.ndarray, begun: np.ndarray, lcps: bool) -> None:
        """Push the places before ``wanted`` ones of a served character, in order."""
        at = np.flatnonzero(wanted)
        if not len(at):
            return
        before = pos[at] - 1
        to = self.chars[before]
        order = np.argsort(to, kind="stable")
        at, before, to = at[order], before[order], to[order]
        new = np.concatenate(([True], to[1:] != to[:-1]))
        first = np.flatnonzero(new)
        if lcps:
            values = np.zeros(len(at), np.int16)
            rest = np.flatnonzero(~new)
            if len(rest):
                i, j = at[rest - 1], at[rest]
                values[rest] = np.minimum(RangeMin(lcp, int((j - i).max())).between(i, j) + 1, self.cap)
            values[first] = begun[to[first]]  # one shared character, or none at the start of a queue
        else:
            values = np.zeros(len(at), np.int16)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)]):
            queues.push(int(to[a]), before[a:b], values[a:b])
        begun[to[first]] = 1

    def induce(self, stars: np.ndarray, star_lcp: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """From S* suffixes in order: (character, L places, their common prefixes, S places, theirs), largest character first, S places descending."""
        chars, lcps = self.chars, star_lcp is not None
        first = chars[stars]
        bounds = np.searchsorted(first, np.arange(self.size + 1))
        present = np.flatnonzero(np.bincount(chars, minlength=self.size)).tolist()
        queues, kept = Queues(self.size, self.memory // 2), Queues(self.size, self.memory // 2)
        begun = np.zeros(self.size, np.int16)
        for c in present:
            pos, lcp = self.rounds(*queues.take(c), c, lcps)
            kept.push(c, pos, lcp)
            own = stars[bounds[c] : bounds[c + 1]].astype(np.int32)
            own_lcp = star_lcp[bounds[c] : bounds[c + 1]].copy() if lcps else np.zeros(len(own), np.int16)
            if lcps and len(own):
                own_lcp[0] = self.border(pos[-1], own[0]) if len(pos) else 0
            pos, lcp = np.concatenate((pos, own)), np.concatenate((lcp, own_lcp))
            self.serve(queues, pos, lcp, (pos > 0) & (chars[np.maximum(pos - 1, 0)] > c), begun, lcps)
        queues = Queues(self.size, self.memory // 2)
        begun[:] = 0
        n = len(chars)
        for c in reversed(present):
            taken, taken_lcp = queues.take(c)
            if c == chars[n - 1]:  # the last character alone is the smallest suffix of all
                taken, taken_lcp = np.append(taken, np.int32(n - 1)), np.append(taken_lcp, np.int16(1 if len(taken) else 0))
            pos, lcp = self.rounds(taken, taken_lcp, c, lcps)
            l_pos, l_lcp = kept.take(c)
            yield c, l_pos, l_lcp, pos, lcp
            back = l_lcp[::-1].copy()
            if len(back):
                back[1:] = back[:-1].copy() if len(back) > 1 else back[1:]
                back[0] = self.border(l_pos[-1], pos[-1]) if len(pos) else 0
            pos, lcp = np.concatenate((pos, l_pos[::-1])), np.concatenate((lcp, back))
            self.serve(queues, pos, lcp, (pos > 0) & (chars[np.maximum(pos - 1, 0)] < c), begun, lcps)

    def border(self, low: int, high: int) -> int:
        """Common prefix of the largest L and the smallest S suffix of a character: the shorter of their runs."""
        return min(self.cap, int(self.run_end[low]) - int(low), int(self.run_end[high]) - int(high))

    def sorted_stars(self) -> np.ndarray:
        places = np.flatnonzero(self.star).astype(np.int32)
        order = np.argsort(self.chars[places], kind="stable")
        found = []
        for _, _, _, pos, _ in self.induce(places[order], None):
            found.append(pos[self.star[pos]])
        by_piece = np.concatenate(found)[::-1]
        after = np.append(places[1:], places[-1]) + 1
        number = np.zeros(len(self.chars), np.int32)
        number[places] = np.arange(len(places))
        self.hashes = Rolling(self.chars)
        pieces = self.hashes.span(by_piece.astype(np.int64), after[number[by_piece]].astype(np.int64))
        name = np.zeros(len(places), np.int64)
        name[number[by_piece]] = np.concatenate(([0], np.cumsum(pieces[1:] != pieces[:-1])))
        span, m = 1, len(places)
        while span < self.cap:  # every name spans a character at least
            if int(name.max()) + 1 == m:
                break
            second = np.zeros(m, np.int64)
            second[: max(0, m - span)] = name[span:] + 1
            _, name = np.unique(name * (m + 1) + second, return_inverse=True)
            span *= 2
        return places[np.argsort(name, kind="stable")]

    def star_prefixes(self, stars: np.ndarray) -> np.ndarray:
        """Common prefix of each sorted S* suffix with the one before, by halving the range of lengths."""
        a, b = stars[:-1].astype(np.int64), stars[1:].astype(np.int64)
        n = len(self.chars)
        low, high = np.zeros(len(a), np.int64), np.minimum(self.cap, n - np.maximum(a, b))
        while (low < high).any():
            at = np.flatnonzero(low < high)
            mid = (low[at] + high[at] + 1) // 2
            same = self.hashes.span(a[at], a[at] + mid) == self.hashes.span(b[at], b[at] + mid)
            low[at[same]] = mid[same]
            high[at[~same]] = mid[~same] - 1
        return np.concatenate(([0], low)).astype(np.int16)


def sorted_suffixes(chars: np.ndarray, cap: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefixes with the suffix before) of each first character, largest character first.

    ``chars`` ends in its smallest character.  Common prefixes count up to ``cap``; beyond it the order is free.
    """
    text = Text(chars, cap, memory)
    stars = text.sorted_stars()
    for _, l_pos, l_lcp, pos, lcp in text.induce(stars, text.star_prefixes(stars)):
        s_pos = pos[::-1]
        s_lcp = np.zeros(len(pos), np.int16)
        if len(pos):
            s_lcp[1:] = lcp[::-1][:-1]
            s_lcp[0] = text.border(l_pos[-1], s_pos[0]) if len(l_pos) else 0
        yield np.concatenate((l_pos, s_pos)), np.concatenate((l_lcp, s_lcp))


def repeated_starts(pieces: Sequence[bytes], length: int, memory: int = MEMORY) -> Iterator[tuple[int, int, int]]:
    """(piece, first, last): runs of starts of strings of ``length`` bytes that start elsewhere as well."""
    if not pieces:
        return
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    chars = raw.astype(np.int16) + 1
    ends = np.cumsum(sizes + 1) - 1
    chars[ends] = 0
    hit = np.zeros(len(chars), bool)
    for pos, lcp in sorted_suffixes(chars, length, memory):
        same = lcp >= length
        hit[pos[same]] = True
        hit[pos[np.flatnonzero(same) - 1]] = True
    begin = ends - sizes
    valid = hit.copy()
    for e in ends.tolist():
        valid[max(0, e - length + 1) : e + 1] = False
    step = np.diff(np.concatenate(([0], valid.astype(np.int8), [0])))
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    piece = np.searchsorted(begin, starts, side="right") - 1
    for p, a, b in zip(piece.tolist(), starts.tolist(), stops.tolist()):
        yield p, a - int(begin[p]), b - 1 - int(begin[p])
