"""Exact Jaccard join of word-shingle sets with token-combination prefixes.

Tokens are 64-bit hashes of shingles.  A global order puts rare tokens first (by hash) and the tokens found
frequent last (by count).  If two sets reach the similarity, their prefixes of length n - need + 1 share a
token, and those of length n - need + 2 share two.  So:

1. Documents with equal sets form one class; all further work is on classes.
2. Prefixes are indexed: rare tokens as single keys; frequent ones, from the prefix extended by one, as pairs of
   tokens.  Two similar sets whose first shared token is rare meet under it; otherwise their first two shared
   tokens are frequent, and they meet under that pair.
3. Under a key of at most ``bound`` classes, each pair that sizes and places allow is a candidate, unless both sets
   have the same token just before: then they met under that one already.  Under a larger key no pair is formed: its
   classes, as far as their sizes chain, become one family.
4. Of the candidates that are not of one family, those go whose parity bitmaps differ in more places than their
   sets may: a token changes one bit, so the bitmaps never differ in more places than the sets.  The others are
   verified by the exact sizes of intersections: first one for each class, then those between different components.
5. A family is cut into blocks of bounded size, and whole sets meet block by block: first each block within
   itself, then, where a family has several blocks, those pairs of blocks that can still hold a link between
   different components.  Within a task, sizes of intersections are products of 0/1 matrices, and only a
   spanning forest of the links leaves it, so no task emits more rows than it has read sets.

Candidates and pairs of blocks are worked off in parts of bounded size, each written before the next, and shuffle files
go with each write: a growing number of candidates costs time, but not disk for all of their sets at once.

Only components are returned, so links inside one need no verification; every pair of classes that shares a
key is verified, meets in a block, or is in one component already.
``bound`` is at least ``LEAST_BOUND`` and grows with the rows, which bounds the frequent tokens at a million.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, column_names, discard, map_arrow, materialize, signed, splitmix, U64
from .components import components

WORDS = 5
PERCENT = 80
COUNT_TOKENS = 1_000_000
LOCAL_FREQUENT = 2
MOST_FREQUENT = 1_000_000
LEAST_FREQUENT = 16
LEAST_BOUND = 128
COMBINED_UP_TO = 200
BLOCK_CLASSES = 1024
BLOCK_TOKENS = 1_600_000
BROADCAST_IDS = 2_000_000
MATRIX_TOKENS = 4096
#: Pairs of classes whose sets move at a time: this or a quarter of the number of classes.
PART_PAIRS = 250_000
BITMAP_BITS = 1024


def needed(n, percent: int):
    """Smallest overlap a set of n tokens has with any set similar enough: ceil(percent * n / 100)."""
    return (percent * n + 99) // 100


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    block = Block(texts, fold=True)
    grams = block.grams(words)
    out = []
    first = block.first.tolist()
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            h = U64(b - a)
            for w in block.words[a:b]:
                h = splitmix(np.array([h ^ w], U64))[0]
            out.append(np.array([h], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set; (0, 0) is kept for the empty one."""
    import xxhash

    if not len(tokens):
        return 0, 0
    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    one, two = signed(np.array([h >> 64, h & (1 << 64) - 1], U64)).tolist()
    return one or 1, two


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens' counts, as 64-bit words, in as many slots as the next power of two, at least ``BITMAP_BITS``."""
    slots = max(BITMAP_BITS, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else BITMAP_BITS
    odd = np.bincount((tokens & U64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


class Names:
    """64-bit names of sets: the first half of the fingerprint, or, of those known to clash, a mix of both."""

    def __init__(self, clashing: set[int]):
        self.clashing = clashing

    def of(self, tokens: np.ndarray) -> int:
        one, two = fingerprint(tokens)
        return one if one not in self.clashing else self.mixed(one, two)

    @staticmethod
    def mixed(one: int, two: int) -> int:
        return int(signed(splitmix(splitmix(np.array([one], np.int64).view(U64)) ^ np.array([two], np.int64).view(U64)))[0])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, t): t tells apart rows that repeat an id."""
    text = F.col(text_col).cast("binary")
    return column_names(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("t"))


def _sets_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for part in blocks(texts):
            yield batch.slice(part.start, part.stop - part.start), shingle_sets(texts[part], words)


def describe(src: DataFrame, words: int) -> DataFrame:
    """kind 0: (doc_id, t, n, one, two, bits) of each row; kind 1: (one: token, n: count) of tokens met often within a stretch of rows."""
    names = ["kind", "doc_id", "t", "n", "one", "two", "bits"]

    def often(own: dict) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(list(own.values())), return_counts=True)
        at = counts >= LOCAL_FREQUENT
        m = int(at.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(counts[at].astype(np.int64)), pa.array(signed(tokens[at])), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64()))], names=names)

    def run(batches):
        own, held = {}, 0
        for rows, sets in _sets_of(batches, words):
            prints = [fingerprint(s) for s in sets]
            m = len(sets)
            maps = [bitmap(s) for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in maps]))).astype(np.int32)
            bits = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *maps])))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), bits], names=names)
            for p, s in zip(prints, sets):
                if len(s) > 1 and p not in own:
                    own[p] = s
                    held += len(s)
            if held >= COUNT_TOKENS:
                yield often(own)
                own, held = {}, 0
        if own:
            yield often(own)

    return map_arrow(src, run, "kind int, doc_id long, t long, n long, one long, two long, bits array<long>")


class Frequent:
    """The frequent tokens, sorted, and the place of each in the order by count."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        self.place = np.empty(len(tokens), np.int64)
        self.place[np.lexsort((tokens, counts))] = np.arange(len(tokens))
        self.place = self.place[order]

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """The place of each token in the order, -1 for rare ones."""
        if not len(self.tokens):
            return np.full(len(tokens), -1, np.int64)
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        return np.where(self.tokens[at] == tokens, self.place[at], -1)


def keys_of(sets: list[np.ndarray], frequent: Frequent, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, index of the set, left, before) of all sets.

    left: the largest overlap a set can have with one whose first shared tokens in the order are this key's.
    before: the token that stands before the key's (before the second of a pair, or before the first where the two
    are neighbours), 0 if there is none.  Two sets that share a key and what is before it share the earlier key, too.
    Sets of up to ``COMBINED_UP_TO`` tokens use pairs of frequent tokens; sets from ``percent`` of that on use
    single ones as well, so that two similar sets always have one kind in common, and long sets never need all
    pairs.
    """
    n = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    place = frequent.find(flat)
    rare = place < 0
    upto = np.concatenate(([0], np.cumsum(rare)))
    first = np.cumsum(n) - n
    n_rare = upto[first + n] - upto[first]
    at = upto[:-1] - np.repeat(upto[first], n)  # a rare token's place within its set
    length = n - needed(n, percent) + 1
    pick = rare & (at < np.repeat(length, n))
    earlier = np.zeros(len(flat), U64)
    where = np.flatnonzero(rare)
    earlier[where[1:]] = flat[where[:-1]]
    earlier[at == 0] = 0
    keys, owners, lefts, befores = [splitmix(flat[pick])], [owner[pick]], [np.repeat(n, n)[pick] - at[pick]], [earlier[pick]]
    for i in np.flatnonzero((n_rare < length + 1) & (n_rare < n)).tolist():
        s, p, m = sets[i], place[first[i] : first[i] + n[i]], int(n[i])
        inside, before = int(min(m, length[i] + 1)), int(n_rare[i])
        often = s[p >= 0][np.argsort(p[p >= 0])][: inside - before]
        if m * 100 >= percent * COMBINED_UP_TO:
            alone = often[: max(0, int(length[i]) - before)]
            keys.append(splitmix(alone))
            lefts.append(m - before - np.arange(len(alone)))
            owners.append(np.full(len(alone), i))
            befores.append(np.concatenate((np.zeros(1, U64), alone))[: len(alone)])
        if m <= COMBINED_UP_TO and len(often) > 1:
            a, b = np.triu_indices(len(often), 1)
            keys.append(splitmix(splitmix(often[a]) + splitmix(often[b] ^ U64(0x5BD1E995)) * U64(3)))
            lefts.append(m - before - b + 1)
            owners.append(np.full(len(a), i))
            befores.append(np.concatenate((np.zeros(1, U64), often))[np.where(b - 1 > a, b, a)])
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(lefts), np.concatenate(befores)


def chains(key: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Where a new run begins in rows sorted by (key, n): at a new key, or where sizes are too far apart for any pair across."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (100 * n[:-1].astype(np.int64) < percent * n[1:].astype(np.int64))
    return new


def index(src: DataFrame, words: int, percent: int, frequent: Frequent, clashing: set[int], bound: int) -> DataFrame:
    """Rows (kind, key, cls, n, left, before): kind 0 a class under a key, 1 the same under a key known to be large, 2 an edge (key, cls) of a family.

    Within a stretch of rows, the classes of a key with more than ``bound`` of them form families at once, and
    of each run of sizes only so many go on that any other class that could link into it can link to one of
    them.  So a key sends few rows from a task, however many documents hold it.
    """
    names = ["kind", "key", "cls", "n", "left", "before"]

    def run(batches):
        own = Names(clashing)
        for _, sets in _sets_of(batches, words):
            named = {own.of(s): s for s in sets if len(s) > 1}
            if not named:
                continue
            key, at, left, before = keys_of(list(named.values()), frequent, percent)
            cls = np.fromiter(named, np.int64, len(named))[at]
            n = np.array([len(s) for s in named.values()], np.int32)[at]
            order = np.lexsort((n, key))
            key, cls, n, left, before = signed(key[order]), cls[order], n[order], left[order].astype(np.int32), signed(before[order])
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            kind = np.repeat((size > bound).astype(np.int32), size)
            if kind.any():
                run_start = np.flatnonzero(chains(key, n, percent))
                hub = np.repeat(np.minimum.reduceat(cls, run_start), np.diff(np.append(run_start, len(key))))
                sent = kind == 0
                for a, b in zip(run_start.tolist(), [*run_start[1:].tolist(), len(key)]):
                    if not kind[a]:
                        continue
                    at_n, k = n[a:b], 0
                    while k < b - a:  # the last one within reach of the one before
                        sent[a + k] = True
                        k = max(k + 1, int(np.searchsorted(at_n, 100 * int(at_n[k]) // percent, side="right")) - 1)
                edge = (kind == 1) & (hub != cls)
                pairs = np.unique(np.stack((hub[edge], cls[edge]), 1), axis=0)
                zero = np.zeros(len(pairs), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(zero + 2), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(zero), pa.array(zero), pa.array(zero.astype(np.int64))], names=names)
                kind, key, cls, n, left, before = (x[sent] for x in (kind, key, cls, n, left, before))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, key, cls, n, left, before)], names=names)

    return map_arrow(src, run, "kind int, key long, cls long, n int, left int, before long")


def _pairs_in_runs(start: np.ndarray, size: np.ndarray, cls: np.ndarray, n: np.ndarray, left: np.ndarray, before: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) within runs of rows that sizes and ``left`` allow and that no earlier key has, some runs at a time."""
    for m in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(m, 1)
        runs = start[size == m]
        step = max(1, 200_000 // len(i))
        for at in range(0, len(runs), step):
            base = runs[at : at + step, None]
            x, y = (base + i).ravel(), (base + j).ravel()
            nx, ny = n[x].astype(np.int64), n[y].astype(np.int64)
            ok = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
            ok &= (100 + percent) * np.minimum(left[x], left[y]).astype(np.int64) >= percent * (nx + ny)
            ok &= (before[x] != before[y]) | (before[x] == 0)
            x, y = cls[x[ok]], cls[y[ok]]
            yield np.minimum(x, y), np.maximum(x, y)


def meet(rows: DataFrame, bound: int, percent: int) -> DataFrame:
    """(family, a, b): edges of families (1) and candidate pairs (0), each once a task at least.  Keys stream by in order; one is held at a time."""

    def found(key, cls, n, left, before, kind) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        order = np.lexsort((cls, n, key))
        key, cls, n, left, before, kind = (x[order] for x in (key, cls, n, left, before, kind))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        kind = np.maximum.reduceat(kind, np.flatnonzero(fresh))
        key, cls, n, left, before = (x[fresh] for x in (key, cls, n, left, before))
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        large = (size > bound) | (np.maximum.reduceat(kind, start) > 0)
        for a, b in _pairs_in_runs(start[~large], size[~large], cls, n, left, before, percent):
            yield 0, a, b
        if large.any():
            inside = np.repeat(large, size)
            key, cls, n = key[inside], cls[inside], n[inside]
            run_start = np.flatnonzero(chains(key, n, percent))
            hub = np.repeat(np.minimum.reduceat(cls, run_start), np.diff(np.append(run_start, len(key))))
            at = hub != cls
            yield 1, hub[at], cls[at]

    def run(batches):
        held, out, n_out = None, {0: [], 1: []}, 0

        def flush():
            for k, parts in out.items():
                if parts:
                    rows = np.unique(np.concatenate(parts), axis=0)
                    parts.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["family", "a", "b"])

        def add(*columns):
            for k, a, b in found(*columns):
                if len(a):
                    out[k].append(np.stack((a, b), 1))
                    yield len(a)

        for batch in batches:
            kind, key, cls, n, left, before = (batch.column(k).to_numpy() for k in range(6))
            edge = kind == 2
            if edge.any():
                out[1].append(np.stack((key[edge], cls[edge]), 1))
                n_out += int(edge.sum())
                kind, key, cls, n, left, before = (x[~edge] for x in (kind, key, cls, n, left, before))
            now = [key, cls, n, left, before, kind]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            held = [x[last:] for x in now]
            if last:
                n_out += sum(add(*(x[:last] for x in now)))
            if n_out > 200_000:
                yield from flush()
                n_out = 0
        if held is not None and len(held[0]):
            for _ in add(*held):
                pass
        yield from flush()

    dealt = rows.repartition(F.when(F.col("kind") == 2, F.col("cls")).otherwise(F.col("key"))).sortWithinPartitions("key")
    return map_arrow(dealt, run, "family int, a long, b long")


def in_parts(rows: DataFrame, most: int, step, name: str) -> DataFrame:
    """``step`` of the rows, about ``most`` of them at a time; each part is written before the next begins."""
    parts = max(1, -(-rows.count() // most))
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    return reduce(DataFrame.union, [materialize(step(rows if parts == 1 else rows.filter(part == k)), name) for k in range(parts)])


def class_sets(src: DataFrame, words: int, clashing: set[int]) -> DataFrame:
    """(cls, n, tokens) of each row."""

    def run(batches):
        own = Names(clashing)
        for _, sets in _sets_of(batches, words):
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, U64), *sets])
            yield pa.RecordBatch.from_arrays([pa.array([own.of(s) for s in sets], pa.int64()), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(flat)))], names=["cls", "n", "tokens"])

    return map_arrow(src, run, "cls long, n int, tokens array<long>")


def _bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is small; otherwise left to a shuffled join.  Counting must be cheap: tables that need a shuffle are written first."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def sets_of(classes: DataFrame, src: DataFrame, reps: DataFrame, words: int, clashing: set[int]) -> DataFrame:
    """(cls, n, tokens) of the wanted classes, from the text of one document each."""
    wanted = materialize(classes.join(reps, "cls").select("cls", "rep.doc_id", "rep.t"), "wanted")
    ids = _bounded(wanted.select(F.col("doc_id").alias("w_id"), F.col("t").alias("w_t")))
    picked = src.join(ids, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("t") == F.col("w_t")), "left_semi")
    return class_sets(picked, words, clashing)


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps differ in no more places than the sets may: with sizes na and nb and an
    overlap of o, in at most na + nb - 2 * o, where (100 + percent) * o >= percent * (na + nb)."""
    one, two = (reps.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("rep.bits").alias(f"s{x}")) for x in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b")
    # one bitmap may have twice the other's slots: its halves are laid over each other
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, 1, half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
    fit = lambda x, y: F.when(F.size(x) > F.size(y), folded(x)).otherwise(F.col(x))
    differ = F.aggregate(F.zip_with(fit("sa", "sb"), fit("sb", "sa"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    least = f"(({percent} * (na + nb) + {99 + percent}) DIV {100 + percent})"
    far = F.greatest(F.size("sa"), F.size("sb")) > 2 * F.least(F.size("sa"), F.size("sb"))  # only below a similarity of one half
    return both.filter(far | (differ <= F.expr(f"na + nb - 2 * {least}"))).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose similarity is reached, by the exact sizes of their sets.

    Sets of b go to their pairs in place, and from there to a, so that each pair moves one set.
    """
    two = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")).join(_bounded(pairs), "b")
    one = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")).join(_bounded(materialize(pairs.select("a").distinct(), "first-sets")), "a", "left_semi")
    shared = two.join(one, "a").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("shared"))
    return shared.filter(f"100 * shared >= {percent} * (na + nb - shared)").select("a", "b")


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component of ``roots`` (node, root) already."""
    one, two = (_bounded(roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))) for x in ("a", "b"))
    return pairs.join(one, "a", "left").join(two, "b", "left").filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")


def overlaps(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of intersections: of all sets with all (cut = 0), or of the first ``cut`` with the others."""
    n = [len(s) for s in sets]
    tokens, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[at] > 1
    owner, at = np.repeat(np.arange(len(sets)), n)[shared], column[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((cut or len(sets), len(sets) - cut), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, MATRIX_TOKENS):
        part = slice(*np.searchsorted(at, (low, low + MATRIX_TOKENS)))
        marks = np.zeros((len(sets), MATRIX_TOKENS), np.float32)
        marks[owner[part], at[part] - low] = 1
        out += marks[: cut or None] @ marks[cut:].T
    return out


def forest(links: np.ndarray) -> np.ndarray:
    """The smallest member reachable from each, given a symmetric 0/1 matrix."""
    label = np.arange(len(links))
    links = links | np.eye(len(links), dtype=bool)
    while True:
        low = np.where(links, label, len(label)).min(1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def linked(cls: np.ndarray, sets: list[np.ndarray], percent: int, cut: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links among sets, or, with ``cut``, of those between the first ``cut`` and the others."""
    n = np.array([len(s) for s in sets], np.int64)
    shared = overlaps(sets, cut).astype(np.int64)
    near = 100 * shared >= percent * (n[: cut or None, None] + n[None, cut:] - shared)
    links = near
    if cut:
        links = np.zeros((len(sets), len(sets)), bool)
        links[:cut, cut:] = near
        links[cut:, :cut] = near.T
    label = forest(links)
    at = label != np.arange(len(label))
    return cls[label[at]], cls[at]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _unpacked(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    tokens = table.column("tokens").combine_chunks()
    offsets, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
    return table.column("cls").to_numpy(), [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside the blocks of each family; members: (cls, family, block)."""

    def run(table: pa.Table) -> pa.Table:
        cls, own = _unpacked(table)
        return _edges(*linked(cls, own, percent))

    placed = sets.join(_bounded(members), "cls").select("family", "block", "cls", "tokens")
    return grouped(placed, ["family", "block"], run)


def grouped(rows: DataFrame, by: list[str], function) -> DataFrame:
    from tissueloom.shipping import ship

    from .common import release

    ship(rows.sparkSession)

    def run(table):
        out = function(table)
        if table.nbytes > 1 << 23:
            release()
        return out

    return rows.groupBy(*by).applyInArrow(run, "a long, b long")


def between(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """Links between components of one family; members: (cls, family, n) of families of several blocks.

    Classes of a large component fill blocks of their own, others share blocks, and a block holds sizes of one
    quarter step, so that pairs of blocks of one component or of far sizes are left out.
    """
    rows = members.join(_bounded(roots.select(F.col("node").alias("cls"), "root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rows = rows.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int"))
    rows = materialize(rows, "rooted")
    big = rows.groupBy("family", "root").agg(F.count("*").alias("c")).filter(F.col("c") >= BLOCK_CLASSES // 2).select("family", "root", F.lit(True).alias("big"))
    rows = rows.join(_bounded(materialize(big, "large-roots")), ["family", "root"], "left").withColumn("own", F.when(F.col("big"), F.col("root")))
    sizes = rows.groupBy("family", "own", "step").agg(F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_TOKENS)).alias("k"))
    same = F.col("s.family").eqNullSafe(F.col("r.family")) & F.col("s.own").eqNullSafe(F.col("r.own")) & (F.col("s.step") == F.col("r.step"))
    rows = rows.alias("r").join(_bounded(materialize(sizes, "sizes")).alias("s"), same).select("r.cls", "r.family", "r.own", "r.n", F.xxhash64("r.family", F.col("r.own").isNull(), "r.own", "r.step", F.pmod(F.xxhash64("r.cls"), F.col("s.k"))).alias("block"))
    rows = materialize(rows, "blocked")
    about = rows.groupBy("family", "own", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = about.alias("x"), about.alias("y")
    apart = F.col("x.own").isNull() | F.col("y.own").isNull() | (F.col("x.own") != F.col("y.own"))
    reach = (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
    cells = one.join(two, (F.col("x.family") == F.col("y.family")) & (F.col("x.block") <= F.col("y.block")) & apart & reach)
    cells = materialize(cells.select(F.col("x.block").alias("one"), F.col("y.block").alias("two")), "cells")

    def placed(cells: DataFrame) -> DataFrame:
        sides = cells.select(F.col("one").alias("block"), "one", "two").union(cells.filter("one <> two").select(F.col("two").alias("block"), "one", "two"))
        return sets.join(_bounded(rows.select("cls", "block")), "cls").join(_bounded(sides), "block").select("one", "two", (F.col("block") == F.col("two")).cast("int").alias("side"), "cls", "tokens")

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        cls, own = _unpacked(table)
        order = np.argsort(side, kind="stable")
        cut = int((side == 0).sum())
        return _edges(*linked(cls[order], [own[i] for i in order], percent, cut if cut < len(side) else 0))

    return in_parts(cells, max(1, most // (2 * BLOCK_CLASSES)), lambda part: grouped(placed(part), ["one", "two"], run), "across-blocks")


def families(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """(cls, family, n, block, blocks) of all classes under large keys."""
    found = components(edges).select(F.col("node").alias("cls"), F.col("root").alias("family")).join(reps.select("cls", "n"), "cls")
    found = materialize(found, "families")
    sizes = found.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    return materialize(found.join(_bounded(materialize(sizes, "sizes")), "family").select("cls", "family", "n", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"), "blocks"), "members")


def _described(src: DataFrame, words: int) -> tuple[DataFrame, Frequent, set[int], int]:
    seen = materialize(describe(src, words), "described")
    rows = seen.filter("kind = 0").drop("kind")
    total = rows.agg(F.sum("n")).first()[0] or 0
    bound = max(LEAST_BOUND, total // 5 // MOST_FREQUENT // 4)
    often = seen.filter("kind = 1").groupBy("one").agg(F.sum("n").alias("n")).filter(F.col("n") >= min(bound, LEAST_FREQUENT)).orderBy(F.desc("n"), "one").limit(MOST_FREQUENT).toArrow()
    frequent = Frequent(often.column("one").to_numpy().view(U64), often.column("n").to_numpy())
    # two sets with one first half: expected once in 10 ** 10 sets
    halves = rows.filter("n > 0").groupBy("one").agg(F.min("two").alias("low"), F.max("two").alias("high")).filter("low <> high").select("one")
    return rows, frequent, {r["one"] for r in halves.toLocalIterator()}, bound


def labelled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(doc_id, t, n, root) of every row; rows of one root are one component.  Rows without words have root 0."""
    src = _source(docs, id_col, text_col)
    rows, frequent, clashing, bound = _described(src, words)
    # beyond 64 bits: the few first halves that clash are replaced by a mix of both
    clash = F.col("one").isin(*clashing) if clashing else F.lit(False)
    mixed = F.udf(Names.mixed, "long") if clashing else (lambda one, two: one)
    rows = rows.withColumn("cls", F.when(clash, mixed("one", "two")).otherwise(F.col("one"))).select("doc_id", "t", "n", "cls", "bits")
    one_each = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "bits")).alias("rep")
    reps = materialize(rows.filter("n > 1").groupBy("cls").agg(one_each, F.min("n").cast("int").alias("n")), "reps")
    most = max(PART_PAIRS, reps.count() // 4)
    met = materialize(meet(index(src, words, percent, frequent, clashing, bound), bound, percent).distinct(), "met")
    members = families(met.filter("family = 1").select("a", "b"), reps)
    one, two = (members.select(F.col("cls").alias(x), F.col("family").alias(f"f{x}")) for x in ("a", "b"))
    pairs = met.filter("family = 0").select("a", "b").join(_bounded(one), "a", "left").join(_bounded(two), "b", "left")
    apart = materialize(pairs.filter("NOT coalesce(fa = fb, false)").select("a", "b"), "apart")
    pairs = in_parts(apart, 4 * most, lambda part: plausible(part, reps, percent), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).union(members.select("cls")).distinct()
    sets = materialize(sets_of(wanted, src, reps, words, clashing), "sets")
    inside = within(members.select("cls", "family", "block"), sets, percent)
    # a copy of a passage meets every other one, so links to the smallest partner join most; the rest is checked across components
    first = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = in_parts(first, most, lambda part: verify(part, sets, percent), "verified")
    links = materialize(links.union(inside).distinct(), "links")
    roots = components(links)
    rest = materialize(across(pairs.join(_bounded(first), ["a", "b"], "left_anti"), roots), "rest")
    if not rest.isEmpty():
        links = materialize(links.union(in_parts(rest, most, lambda part: verify(part, sets, percent), "verified")).distinct(), "links")
        roots = components(links)
    several = members.filter("blocks > 1").select("cls", "family", "n")
    if not several.isEmpty():
        more = materialize(between(several, roots, sets, percent, most), "more")
        roots = components(links.union(more))
    discard(met, apart, sets)
    named = _bounded(roots.select(F.col("node").alias("cls"), "root"))
    return rows.join(named, "cls", "left").select("doc_id", "t", "n", F.coalesce("root", "cls").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    component_id is the smallest doc_id reachable over links of similarity ``percent`` / 100 or more.  Null,
    empty and wordless texts have no shingles, link with nothing and are their own component.  Equal texts
    and repeated rows share a component and keep their rows; a row with a null id takes part, and gets the
    smallest id that is not null, or null.  Other columns are not carried.
    """
    found = labelled(docs, id_col, text_col, words, percent)
    least = found.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = found.join(least, "root", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns: that with the smallest id, null ids last.

    Rows that repeat an id with other texts are documents of their own; of rows that repeat both, as of any
    copies, one stays.  Rows without words link with nothing and all stay.
    """
    found = materialize(labelled(docs, id_col, text_col, words, percent).filter("n > 0"), "labelled")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    least = found.groupBy("root").agg(F.min(place).alias("first"))
    judged = found.join(least, "root").select(place.alias("place"), "first")
    names = (F.col("place.doc_id").alias("w_id"), F.col("place.t").alias("w_t"))
    dropped = materialize(judged.filter("place <> first").select(*names).distinct(), "dropped")
    twice = materialize(judged.filter("place = first").groupBy(*names).count().filter("count > 1").select("w_id", "w_t"), "repeated")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("w_id")) & (F.coalesce(F.xxhash64(F.col(f"`{text_col}`").cast("binary")), F.lit(0)) == F.col("w_t"))
    kept = docs.join(_bounded(dropped), same, "left_anti")
    if twice.isEmpty():
        return kept
    return kept.join(_bounded(twice), same, "left_anti").unionByName(kept.join(_bounded(twice), same, "left_semi").dropDuplicates([id_col, text_col]))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS to_ FROM n UNION SELECT r.d, e.b FROM r JOIN e ON r.to_ = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c.c, d.doc_id) AS BIGINT) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT d, min(to_) AS c FROM r GROUP BY d) c ON c.d = d.doc_id
"""
