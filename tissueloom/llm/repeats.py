"""Removal of long strings that occur more than once in a corpus.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts anywhere else.  Work is cut into
shards by content, so that all places of one string meet in one shard:

1. Anchors.  In a text, the hashes of all ``GRAM``-byte strings are taken, and of each run of
   LENGTH - GRAM + 1 of them the smallest is an anchor.  Every LENGTH-byte string holds an anchor, and equal
   strings hold equal anchors at equal places.
2. Places of one anchor meet by its hash.  Those with equal surroundings (LENGTH - GRAM bytes before, LENGTH
   from its start) are repeats of each other.  An anchor with different surroundings stays open.
3. The surroundings of open anchors, one of each kind, meet in shards, and the suffixes of a shard that
   start a LENGTH-byte string are sorted and compared with their neighbours (:mod:`.suffixes`).
   An anchor with more than ``HOT_PLACES`` kinds of surroundings is split instead: each of the LENGTH-byte strings
   that hold it is known by a 128-bit hash and meets its equals by that, so no shard outgrows a task.
4. The spans found are merged by text and cut out.

Equal texts are one text throughout, known by a 64-bit hash and the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, map_arrow, materialize, signed, splitmix
from .suffixes import repeated_starts

LENGTH = 400
GRAM = 200
BROADCAST_ROWS = 2_000_000
#: Keys of a partition are sorted together up to so many bytes of text; one key adds at most HOT_PLACES pieces.
SHARD_BYTES = 3_000_000
HOT_PLACES = 5_000


_BYTE_VALUE = splitmix(np.arange(256, dtype=U64))
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64; kept up to a few MB."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(1 << max(16, int(n + 1).bit_length()), base, U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if have.nbytes <= 1 << 24:
            _powers[base] = have
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial, from which :func:`gram_hash` hashes any span.

    Modulo 2 ** 64 this is weak on some regular texts.  It only chooses anchors, which may be any function of
    the bytes; what decides that strings are equal is hashed by XXH3 or compared.
    """
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUE[data] * powers(_BASE, len(data))[: len(data)], dtype=U64, out=out[1:])
    return out


def gram_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return splitmix((prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start])


def sliding(x: np.ndarray, w: int, function) -> np.ndarray:
    """function (np.minimum or np.maximum) over x[i : i + w], for every i where it fits."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    edge = x.max() if function is np.minimum else x.min()
    grid = np.concatenate((x, np.full(pad, edge, x.dtype))).reshape(-1, w)
    forward = function.accumulate(grid, axis=1).ravel()
    backward = function.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return function(backward[: n - w + 1], forward[w - 1 : n])


def anchors(prefix: np.ndarray, start: int, end: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places from ``start``, hashes) of the anchors of data[start:end], given its prefix hashes."""
    if end - start < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.arange(start, end - gram + 1)
    h = gram_hash(prefix, at, at + gram)
    w = length - gram + 1
    least = sliding(h, w, np.minimum)
    # a place is an anchor if it is the smallest of some run that holds it, that is, of the run with the largest minimum
    edge = np.zeros(w - 1, U64)
    most = sliding(np.concatenate((edge, least, edge)), w, np.maximum)
    found = np.flatnonzero(h == most)
    return found, h[found]


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), t.alias("text"), F.xxhash64(t).alias("u"), F.octet_length(t).cast("int").alias("n"))


def anchor_rows(src: DataFrame, length: int, gram: int) -> DataFrame:
    """(spread, key, context, u, n, pos, star): anchors of all texts.

    Within a block, equal texts are one, and of places with equal surroundings one goes on with star = 1 and
    the others, known to be repeats already, carry star = 2 and a ``spread`` of their own.
    """
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, us, ns = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for part in blocks(texts):
                own = {(u, n): t for u, n, t in zip(us[part], ns[part], texts[part]) if n >= length}
                if not own:
                    continue
                joined = b"".join(own.values())
                raw, data = memoryview(joined), np.frombuffer(joined, np.uint8)
                prefix = prefix_hash(data)
                rows = []
                at = 0
                for u, n in own:
                    pos, key = anchors(prefix, at, at + n, length, gram)
                    lo, hi = np.maximum(pos - before, 0), np.minimum(pos + length, n)
                    near = np.fromiter(map(xxhash.xxh3_64_intdigest, [raw[a:b] for a, b in zip((at + lo).tolist(), (at + hi).tolist())]), U64, len(pos))
                    context = splitmix(near ^ splitmix(((pos - lo) << 32 | (hi - pos)).astype(U64)))
                    rows.append((key, context, np.full(len(pos), u, np.int64), np.full(len(pos), n, np.int32), pos.astype(np.int32)))
                    at += n
                key, context, u, n, pos = (np.concatenate(x) for x in zip(*rows))
                order = np.lexsort((context, key))
                key, context, u, n, pos = (x[order] for x in (key, context, u, n, pos))
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (context[1:] != context[:-1]))) if len(key) else np.zeros(0, bool)
                size = np.diff(np.append(np.flatnonzero(new), len(key)))
                star = np.where(new, np.repeat((size > 1).astype(np.int32), size), 2).astype(np.int32)
                spread = np.where(star == 2, u ^ pos, signed(key))
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(signed(key)), pa.array(signed(context)), pa.array(u), pa.array(n), pa.array(pos), pa.array(star)], names=["spread", "key", "context", "u", "n", "pos", "star"])

    return map_arrow(src, run, "spread long, key long, context long, u long, n int, pos int, star int")


def meet(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """kind 0: (u, n, a, b) spans of places with equal surroundings; kind 1: (key, u, n, pos) still open."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(k).to_numpy() for k in range(1, 7)] for b in batches if b.num_rows]
        if not got:
            return
        key, context, u, n, pos, star = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((pos, u, context, key))
        key, context, u, n, pos, star = (x[order] for x in (key, context, u, n, pos, star))
        local = star == 2
        spans = [(u[local], n[local], pos[local])]
        key, context, u, n, pos, star = (x[~local] for x in (key, context, u, n, pos, star))
        if len(key):
            # one text's place can come from several blocks, as copies of a text do
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (context[1:] != context[:-1]) | (u[1:] != u[:-1]) | (pos[1:] != pos[:-1])))
            star = np.maximum.reduceat(star, np.flatnonzero(fresh))
            key, context, u, n, pos = (x[fresh] for x in (key, context, u, n, pos))
            new_key = np.concatenate(([True], key[1:] != key[:-1]))
            new = new_key | np.concatenate(([True], context[1:] != context[:-1]))
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(key)))
            several = np.repeat((size > 1) | (np.maximum.reduceat(star, at) > 0), size)
            spans.append((u[several], n[several], pos[several]))
            # kinds of surroundings of a key
            kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))
            open_ = new & np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(new_key), len(key))))
            key, ku, kn, kpos = key[open_], u[open_], n[open_], pos[open_]
        else:
            ku, kn, kpos = u, n, pos
        su, sn, sp = (np.concatenate(x) for x in zip(*spans))
        a, b = np.maximum(sp - before, 0), np.minimum(sp + length, sn)
        for lo in range(0, len(su), 200_000):
            p = slice(lo, lo + 200_000)
            m = len(su[p])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(su[p]), pa.array(sn[p]), pa.array(a[p].astype(np.int32)), pa.array(b[p].astype(np.int32))], names=["kind", "key", "u", "n", "a", "b"])
        for lo in range(0, len(ku), 200_000):
            p = slice(lo, lo + 200_000)
            m = len(ku[p])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(key[p]), pa.array(ku[p]), pa.array(kn[p]), pa.array(kpos[p]), pa.array(kpos[p])], names=["kind", "key", "u", "n", "a", "b"])

    return map_arrow(rows.repartition("spread"), run, "kind int, key long, u long, n int, a int, b int")


def segments(src: DataFrame, asked: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, u, n, at, bytes): the surroundings of open anchors, those of one key and text that overlap joined."""
    before = length - gram
    lists = asked.groupBy("u", "n").agg(F.array_sort(F.collect_set(F.struct("key", "a"))).alias("asked"))
    joined = src.drop("id").join(F.broadcast(lists) if asked.count() <= BROADCAST_ROWS else lists, ["u", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for u, n, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
                last = None
                for w in wanted:
                    lo, hi = max(w["a"] - before, 0), min(w["a"] + length, n)
                    if last and last[0] == w["key"] and lo <= last[2]:
                        last[2] = hi
                    else:
                        if last:
                            out.append((last[0], u, n, last[1], text[last[1] : last[2]]))
                        last = [w["key"], lo, hi]
                if last:
                    out.append((last[0], u, n, last[1], text[last[1] : last[2]]))
            if out:
                key, u, n, at, raw = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(u, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(raw, pa.binary())], names=["key", "u", "n", "at", "bytes"])

    return map_arrow(joined.select("u", "n", "text", "asked"), run, "key long, u long, n int, at int, bytes binary")


def shards(parts: DataFrame, length: int) -> DataFrame:
    """(u, n, a, b): spans of the strings that repeat within a shard, a shard being some keys of a partition."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        # anchors of one text that lie close give overlapping pieces; a place must stand in the shard once
        pieces: list[list] = []
        for _, u, n, at, raw in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
            last = pieces[-1] if pieces else None
            if last and last[0] == u and last[1] == n and at <= last[2] + last[4]:
                extra = at + len(raw) - last[2] - last[4]
                if extra > 0:
                    last[3].append(raw[len(raw) - extra :])
                    last[4] += extra
            else:
                pieces.append([u, n, at, [raw], len(raw)])
        out = [(pieces[p][0], pieces[p][1], pieces[p][2] + lo, pieces[p][2] + hi + length) for p, lo, hi in repeated_starts([b"".join(p[3]) for p in pieces], length)]
        u, n, a, b = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(n, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["u", "n", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by key; copies of a text ask for the same pieces
        held: dict[tuple, tuple] = {}
        size, last = 0, None
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5))):
                if size >= SHARD_BYTES and row[0] != last:
                    yield shard(list(held.values()))
                    held, size = {}, 0
                last = row[0]
                if (name := row[:2] + row[3:4]) not in held:
                    held[name] = row
                    size += len(row[4])
        if held:
            yield shard(list(held.values()))

    return map_arrow(parts.repartition("key").sortWithinPartitions("key"), run, "u long, n int, a int, b int")


def windows(src: DataFrame, asked: DataFrame, length: int, gram: int) -> DataFrame:
    """(u, n, a, b): the strings of ``length`` bytes around anchors that occur at two places or more, found by their hashes alone.

    Within a batch, places of one string are spans at once, runs of them joined, and one of them goes on, so a
    string sends one row from a batch however often it occurs.
    """
    lists = asked.groupBy("u", "n").agg(F.array_sort(F.collect_set("a")).alias("asked"))
    joined = src.drop("id").join(F.broadcast(lists) if asked.count() <= BROADCAST_ROWS else lists, ["u", "n"])
    names = ["kind", "one", "two", "u", "n", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, places = [], []
            us, ns = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, (n, text, wanted) in enumerate(zip(ns.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                starts = sorted({p for a in wanted for p in range(max(0, a - length + gram), min(a, n - length) + 1)})
                raw = memoryview(text)
                digests += [xxhash.xxh3_128_digest(raw[p : p + length]) for p in starts]
                places.append(np.stack((np.full(len(starts), row), starts), 1).reshape(-1, 2))
            if not digests:
                continue
            one, two = np.ascontiguousarray(np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T)
            row, start = np.ascontiguousarray(np.concatenate(places).T.astype(np.int64))
            order = np.lexsort((two, one))
            new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
            several = np.repeat(np.diff(np.append(np.flatnonzero(new), len(order))) > 1, np.diff(np.append(np.flatnonzero(new), len(order))))
            again = np.zeros(len(order), bool)
            again[order[several]] = True
            hit = np.flatnonzero(again)  # rows and starts ascend
            if len(hit):
                begin = np.flatnonzero(np.concatenate(([True], (row[hit][1:] != row[hit][:-1]) | (start[hit][1:] != start[hit][:-1] + 1))))
                last = np.append(begin[1:], len(hit)) - 1
                of = row[hit[begin]]
                zero = np.zeros(len(begin), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32)), pa.array(zero), pa.array(zero), pa.array(us[of]), pa.array(ns[of]), pa.array(start[hit[begin]].astype(np.int32)), pa.array((start[hit[last]] + length).astype(np.int32))], names=names)
            sent = order[new]
            at = start[sent].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(sent), np.int32)), pa.array(one[sent]), pa.array(two[sent]), pa.array(us[row[sent]]), pa.array(ns[row[sent]]), pa.array(at), pa.array((at + length).astype(np.int32))], names=names)

    rows = map_arrow(joined.select("u", "n", "text", "asked"), run, "kind int, one long, two long, u long, n int, a int, b int")
    rows = materialize(rows, "windows")
    met = rows.filter("kind = 1")
    again = met.groupBy("one", "two").agg(F.count("*").alias("c")).filter("c > 1").select("one", "two")
    return rows.filter("kind = 0").select("u", "n", "a", "b").union(met.join(again, ["one", "two"], "left_semi").select("u", "n", "a", "b"))


def repeated_spans(src: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(u, n, a, b): spans of repeated strings, possibly overlapping, by text."""
    met = materialize(meet(anchor_rows(src, length, gram), length, gram), "anchors")
    asked = met.filter("kind = 1").select("key", "u", "n", "a")
    hot = materialize(asked.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > HOT_PLACES).select("key"), "hot")
    split = None
    if not hot.isEmpty():
        few = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
        split = windows(src, materialize(asked.join(few, "key", "left_semi"), "split"), length, gram)
        asked = materialize(asked.join(few, "key", "left_anti"), "asked")
    found = shards(segments(src, asked, length, gram), length)
    found = found if split is None else found.union(split)
    copies = src.filter(F.col("n") >= length).groupBy("u", "n").agg(F.count("*").alias("c")).filter("c > 1").select("u", "n", F.lit(0).alias("a"), F.col("n").alias("b"))
    return met.filter("kind = 0").select("u", "n", "a", "b").union(found).union(copies)


def merged(spans: DataFrame) -> DataFrame:
    """(u, n, spans): the spans of each text as disjoint runs in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(k).to_numpy() for k in range(4)] for b in batches if b.num_rows]
        if not got:
            return
        u, n, a, b = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((a, n, u))
        u, n, a, b = u[order], n[order], a[order].astype(np.int64), b[order].astype(np.int64)
        text = np.cumsum(np.concatenate(([0], (u[1:] != u[:-1]) | (n[1:] != n[:-1])))) << 32
        reach = np.maximum.accumulate(text + b)
        new = np.concatenate(([True], (text + a)[1:] > reach[:-1]))
        at = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(n[at]), pa.array(a[at].astype(np.int32)), pa.array((np.maximum.reduceat(text + b, at) - text[at]).astype(np.int32))], names=["u", "n", "a", "b"])

    runs = map_arrow(spans.distinct().repartition("u", "n"), run, "u long, n int, a int, b int")
    return runs.groupBy("u", "n").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left)."""
    out, removed, runs, at = [], 0, 0, 0
    last = -1
    for a, b in sorted(spans):
        if a > last:
            runs += 1
            out.append(text[at:a])
            removed += b - a
            at = last = b
        elif b > last:
            removed += b - last
            at = last = b
    out.append(text[at:])
    return removed, runs, b"".join(out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept and text) of every row.

    Null texts count as empty; texts shorter than ``length`` bytes lose nothing; of equal texts and repeated
    rows every copy loses all.  kept is binary, as cuts need not fall between characters; text is the same
    without the bytes of characters that were cut through.  Other columns are not carried.
    """
    src = _text(docs, id_col, text_col)
    lists = materialize(merged(repeated_spans(src, length, length // 2)), "spans")
    few = (lists.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_ROWS
    joined = src.join(F.broadcast(lists) if few else lists, ["u", "n"], "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [cut(t, [(s["a"], s["b"]) for s in spans] if spans else []) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            removed, runs, kept = zip(*got) if got else ((), (), ())
            sizes = np.array(removed, np.int64) + np.array([len(k) for k in kept], np.int64)
            cols = [batch.column(0), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols += [pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())]
                names += ["kept", "text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(joined, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, text string" * keep_text)
