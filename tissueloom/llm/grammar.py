"""Token ids of a corpus as grammar-compressed shards.

Re-Pair per shard block: frequent pairs of neighbouring symbols become nonterminals, again and again; the
rules and the length of each rule's expansion are stored, so any range of ids is decoded by finding its
symbols in the running sum of lengths.  Each round replaces a set of frequent pairs in which no symbol is the
right half of one pair and the left half of another, so replacements never overlap; rounds go on until no pair
occurs ``LEAST_COUNT`` times, from which on a rule takes more room than it saves.

File format: Parquet files with one row per block: shard, block, n_docs, n_tokens, payload.  A payload is
``RPR2``, six little-endian unsigned 32-bit counts (docs, docs without an id, tokens, symbols, rules,
terminals), then arrays: document ids (int64; those without an id come first, as 0), rule halves (2 x uint32 a rule), expansion lengths (uint32 a rule), symbols (uint32).
Terminal number ``terminals - 1`` ends a document and stands for the end id; no rule holds it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, column_names, map_arrow, shared_dir
from .pretokens import gather, loaded, tokenizer_text, word_coder

MAGIC = b"RPR2"
HEAD = struct.Struct("<6I")
END_ID = 2
BLOCK_TOKENS = 2_000_000
RULES_A_ROUND = 4096
LEAST_COUNT = 24
_BITS = 20


def compress(symbols: np.ndarray, terminals: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Rules (n x 2) and the remaining symbols; symbol ``terminals - 1`` is never paired.

    Pairs are counted by hash buckets first; once these show nothing more, exactly.  A pair seen less than ``least``
    times can only be rarer later, so a place is looked at again only once a new symbol stands there.
    """
    seq = symbols.astype(np.int32)  # half the memory to move; a block has far fewer symbols than fit
    rules = np.zeros((0, 2), np.int64)
    exact = False
    live = np.ones(len(seq), bool)
    while len(seq) > 1:
        live[-1] = False
        at = np.flatnonzero(live)
        left, right = seq.take(at), seq[1:].take(at)
        inside = left != terminals - 1
        inside &= right != terminals - 1
        if not inside.all():
            live[at[~inside]] = False
            at, left, right = at[inside], left[inside], right[inside]
        halves = np.empty((len(at), 2), np.int32)
        halves[:, 0], halves[:, 1] = right, left
        code = halves.view("<i8").ravel()
        bits = min(_BITS, max(10, len(at).bit_length()))
        bucket = code.view(np.uint64) * np.uint64(11400714819323198485)
        bucket >>= np.uint64(64 - bits)
        bucket = bucket.view(np.int64)
        counts = np.bincount(bucket, minlength=1 << bits)
        often = counts >= least
        heavy = np.flatnonzero(often)
        if len(heavy) > 2 * RULES_A_ROUND:
            heavy = heavy[counts[heavy] >= np.partition(counts[heavy], -2 * RULES_A_ROUND)[-2 * RULES_A_ROUND]]
        # the heaviest buckets are at most 2 * RULES_A_ROUND and those that tie with the last
        rank = np.where(often, -1, -2).astype(np.int16 if len(heavy) < 1 << 15 else np.int32)
        rank[heavy] = np.arange(len(heavy))
        place = rank.take(bucket)
        live[at[place == -2]] = False
        among = np.flatnonzero(place >= 0)
        if not len(among):
            break
        at, place, found = at.take(among), place.take(among).astype(np.int64), code.take(among)
        if exact:
            own, place, n = np.unique(found, return_inverse=True, return_counts=True)
            same = np.ones(len(found), bool)
        else:  # one pair stands for a bucket; another that shares it waits for a later round
            own = np.zeros(len(heavy), np.int64)
            own[place] = found
            same = own.take(place) == found
            n = np.bincount(place, minlength=len(heavy)) - np.bincount(place[~same], minlength=len(heavy))
        name = np.full(len(own), -1, np.int32)
        lefts: set[int] = set()
        rights: set[int] = set()
        taken: list[int] = []
        for k in np.argsort(-n, kind="stable")[:RULES_A_ROUND].tolist():
            if n[k] < least:
                break
            p = int(own[k])
            a, b = p >> 32, p & 0xFFFFFFFF
            if a in rights or b in lefts or (a == b and (a in lefts or b in rights)):
                continue
            lefts.add(a)
            rights.add(b)
            name[k] = terminals + len(rules) + len(taken)
            taken.append(p)
        if not taken:
            if exact:
                break
            exact = True
            continue
        new = name.take(place)
        hit = np.flatnonzero(same & (new >= 0))
        at, new = at.take(hit), new.take(hit)
        # matches at consecutive places come only from pairs of one symbol: take every other of a run
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1] + 1
        if not fresh.all():
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            even = (np.arange(len(at)) - run) % 2 == 0
            at, new = at[even], new[even]
        pairs = np.array(taken, np.int64)
        rules = np.concatenate((rules, np.stack((pairs >> 32, pairs & 0xFFFFFFFF), 1)))
        seq[at] = new
        live[at] = True
        live[at[at > 0] - 1] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, live = seq[keep], live[keep]
    return rules, seq


def pack(doc_ids: np.ndarray, nulls: int, symbols: np.ndarray, terminals: int) -> bytes:
    rules, seq = compress(symbols, terminals)
    sizes = rule_sizes(rules, terminals)
    head = HEAD.pack(len(doc_ids), nulls, len(symbols), len(seq), len(rules), terminals)
    return MAGIC + head + doc_ids.astype("<i8").tobytes() + rules.astype("<u4").tobytes() + sizes.astype("<u4").tobytes() + seq.astype("<u4").tobytes()


def levels(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How deep each symbol's rules nest: 0 for terminals."""
    out = np.zeros(terminals + len(rules), np.int64)
    while len(rules):
        new = 1 + np.maximum(out[rules[:, 0]], out[rules[:, 1]])
        if (new == out[terminals:]).all():
            break
        out[terminals:] = new
    return out


def rule_sizes(rules: np.ndarray, terminals: int) -> np.ndarray:
    sizes, level = np.ones(terminals + len(rules), np.int64), levels(rules, terminals)
    for k in range(1, int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        sizes[at] = sizes[rules[at - terminals, 0]] + sizes[rules[at - terminals, 1]]
    return sizes[terminals:]


class Block:
    """A payload opened for reading; ``read`` decodes any range of ids without the rest."""

    def __init__(self, payload: bytes, end_id: int = END_ID):
        if payload[:4] != MAGIC:
            raise ValueError("not a grammar block")
        docs, self.nulls, self.n_tokens, n_seq, n_rules, self.terminals = HEAD.unpack_from(payload, 4)
        at, self.end_id = 4 + HEAD.size, end_id
        self.doc_ids = np.frombuffer(payload, "<i8", docs, at)
        at += 8 * docs
        self.rules = np.frombuffer(payload, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.sizes = np.concatenate((np.ones(self.terminals, np.int64), np.frombuffer(payload, "<u4", n_rules, at)))
        at += 4 * n_rules
        self.seq = np.frombuffer(payload, "<u4", n_seq, at).astype(np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.flat = np.zeros(int(self.sizes.sum()), np.int64)
        self.flat[: self.terminals] = np.arange(self.terminals)
        self.flat[self.terminals - 1] = end_id
        level = levels(self.rules, self.terminals)
        for k in range(1, int(level.max(initial=0)) + 1):
            at_level = np.flatnonzero(level == k)
            a, b = self.rules[at_level - self.terminals].astype(np.int64).T
            self.flat[gather(self.offsets[at_level], self.sizes[a])] = self.expand(a)
            self.flat[gather(self.offsets[at_level] + self.sizes[a], self.sizes[b])] = self.expand(b)
        self.after = np.cumsum(self.sizes[self.seq])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[gather(self.offsets[symbols], self.sizes[symbols])]

    def read(self, start: int, stop: int) -> np.ndarray:
        first, last = np.searchsorted(self.after, [start, stop - 1], side="right")
        before = int(self.after[first - 1]) if first else 0
        return self.expand(self.seq[first : last + 1])[start - before : stop - before]

    def doc_ends(self) -> np.ndarray:
        return self.after[self.seq == self.terminals - 1]


def write_corpus(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text, append ``end_id`` and write blocks in ascending id order.

    Null and empty texts hold only the end id.  Rows with equal ids stand in the order of their texts; rows
    with a null id come before all others.
    """
    text = tokenizer_text(tokenizer_path, "word_bpe_49k.json")
    src = column_names(docs, id_col, text_col).withColumn(id_col, F.col(id_col).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded("word", text, word_coder)
        terminals = coder.tokenizer.get_vocab_size(with_added_tokens=True) + 1
        shard, block = TaskContext.get().partitionId(), 0
        ids_held, docs_held, held, nulls = [], [], 0, 0

        def out() -> pa.RecordBatch:
            doc_ids, symbols = np.concatenate(docs_held), np.concatenate(ids_held)
            payload = pack(doc_ids, nulls, symbols, terminals)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(symbols)], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "block", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            texts, given = batch.column(1).to_pylist(), batch.column(0)
            none, doc_ids = given.is_null().to_numpy(zero_copy_only=False), given.fill_null(0).to_numpy()
            for part in blocks(texts):
                ids, counts = coder.ids(texts[part])
                symbols = np.insert(ids.astype(np.uint32), np.cumsum(counts), terminals - 1)
                ids_held.append(symbols)
                docs_held.append(doc_ids[part])
                nulls += int(none[part].sum())
                held += len(symbols)
                if held >= BLOCK_TOKENS:
                    yield out()
                    ids_held, docs_held, held, nulls = [], [], 0, 0
                    block += 1
        if docs_held:
            yield out()

    spread = src.repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    map_arrow(spread, run, "shard int, block int, n_docs long, n_tokens long, payload binary").write.parquet(path)


def block_starts(files: DataFrame) -> DataFrame:
    """(shard, block, block_start): ids before each block, from block sizes alone."""
    sizes = files.select("shard", "block", "n_tokens")
    in_shard = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over_shards = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(over_shards), F.lit(0)).alias("shard_start"))
    own = sizes.select("shard", "block", F.coalesce(F.sum("n_tokens").over(in_shard), F.lit(0)).alias("in_shard"))
    return own.join(shards, "shard").select("shard", "block", (F.col("in_shard") + F.col("shard_start")).alias("block_start"))


def read_corpus(spark: SparkSession, path: str, with_ids: bool = True, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of every document in the files."""
    files = spark.read.schema("shard int, block int, n_docs long, n_tokens long, payload binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block = Block(payload.as_py(), end_id)
                ids = block.expand(block.seq).astype("<u4")
                ends = block.doc_ends()
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(np.full(len(ends), shard, np.int32)), pa.array(np.full(len(ends), number, np.int32)), pa.array(block.doc_ids.astype(np.int64), mask=np.arange(len(ends)) < block.nulls), pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())]
                names = ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = np.concatenate(([0], ends)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = map_arrow(files.select("shard", "block", "payload"), run, schema)
    out = docs.join(block_starts(files), ["shard", "block"]).withColumn("start", F.col("at") + F.col("block_start"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the corpus to the shared folder and read it back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tissueloom/grammar-{uuid.uuid4().hex}"
    write_corpus(docs, path, **options)
    return read_corpus(spark, path, with_ids=False, end_id=options.get("end_id", END_ID))
