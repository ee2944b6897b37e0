"""BPE encoding by backtracking and decoding by an offset table.

The encoder walks a pre-token from left to right.  At each position it takes the longest vocabulary entry
that starts there (goto function of the Aho-Corasick automaton of the vocabulary), keeps it if the pair with
the token before it is compatible (no merge crosses the border before both tokens are complete), and
otherwise tries the next shorter entry or steps back.  A sequence whose neighbours are all compatible is the
merge result, and positions once left as dead ends are never entered again, so the work is linear.  Many
pre-tokens advance together, one numpy step at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, column_names, map_arrow
from .pretokens import BYTE_SPLIT, Coder, gather, loaded, open_tokenizer, tokenizer_text

NEVER = 1 << 30
SLOTS = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Tables of a byte-level BPE vocabulary and the two directions."""

    def __init__(self, text: str):
        model = json.loads(text)["model"]
        to_byte = byte_alphabet()
        vocab = {bytes(to_byte[c] for c in s): i for s, i in model["vocab"].items()}
        size = max(vocab.values()) + 1
        self.size = size
        self.tokens = [b""] * size
        for s, i in vocab.items():
            self.tokens[i] = s
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, rank = (np.full(size, -1, np.int64) for _ in range(3))
        keys = np.zeros(len(merges), np.int64)
        ids = model["vocab"]
        for k, (a, b) in enumerate(merges):
            i, x, y = ids[a + b], ids[a], ids[b]
            keys[k] = x * size + y
            if rank[i] < 0:
                left[i], right[i], rank[i] = x, y, k
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self._spines(left, right, rank)
        self._trie(vocab)
        self.cache_key, self.cache_ok = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.table = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def _spines(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        """Right and left edges of each token's merge tree, with the rank at which each part is used up."""

        def spine(child: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
            at, used = np.arange(self.size), np.full(self.size, NEVER, np.int64)
            parts, ends = [], []
            while (at >= 0).any():
                parts.append(at)
                ends.append(used)
                used = np.where(at >= 0, rank[at], NEVER)
                at = np.where(at >= 0, child[at], -1)
            return parts, ends

        self.right_parts, self.right_ends = spine(right)
        self.left_parts, self.left_ends = spine(left)

    def _trie(self, vocab: dict[bytes, int]) -> None:
        nodes: dict[int, int] = {}
        token = [-1]
        shorter = np.full(self.size, -1, np.int64)
        for s in sorted(vocab):  # prefixes come first
            node, last = 0, -1
            for c in s[:-1]:
                key = node * 256 + c
                nxt = nodes.get(key)
                if nxt is None:
                    nxt = nodes[key] = len(token)
                    token.append(-1)
                node = nxt
                if token[node] >= 0:
                    last = token[node]
            key = node * 256 + s[-1]
            nxt = nodes.get(key)
            if nxt is None:
                nxt = nodes[key] = len(token)
                token.append(-1)
            token[nxt] = vocab[s]
            shorter[vocab[s]] = last
        self.node_token, self.shorter = np.array(token, np.int64), shorter
        edges = np.array(sorted(nodes.items()), np.int64)
        self.edge_keys, self.edge_to = edges[:, 0], edges[:, 1]

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node * 256 + byte
        at = np.searchsorted(self.edge_keys, key)
        at[at == len(self.edge_keys)] = 0
        return np.where(self.edge_keys[at] == key, self.edge_to[at], -1)

    def longest(self, data: np.ndarray, pos: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest entry that starts at each position and ends by ``end``."""
        best = np.full(len(pos), -1, np.int64)
        live, node, pos = np.arange(len(pos)), np.zeros(len(pos), np.int64), pos.copy()
        while len(live):
            node = self.step(node, data[pos])
            keep = node >= 0
            live, node, pos = live[keep], node[keep], pos[keep] + 1
            found = self.node_token[node]
            whole = found >= 0
            best[live[whole]] = found[whole]
            keep = pos < end[live]
            live, node, pos = live[keep], node[keep], pos[keep]
        return best

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for parts, ends in zip(self.right_parts, self.right_ends):
            x, x_end = parts[a], ends[a]
            if not (x >= 0).any():
                break
            for parts2, ends2 in zip(self.left_parts, self.left_ends):
                y = parts2[b]
                at = np.flatnonzero(ok & (x >= 0) & (y >= 0))
                if not len(at):
                    break
                key = x[at] * self.size + y[at]
                k = np.searchsorted(self.pair_keys, key)
                k[k == len(self.pair_keys)] = 0
                rank = np.where(self.pair_keys[k] == key, self.pair_ranks[k], NEVER)
                # equal ranks: the leftmost pair merges first
                ok[at] = ~((rank < x_end[at]) & (rank <= ends2[b][at]) & (rank < NEVER))
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair-compatibility table, filled as pairs are met (slots are overwritten, never trusted blindly)."""
        key = a * self.size + b
        slot = (key * 0x9E3779B1 >> 7) & (SLOTS - 1)
        hit = self.cache_key[slot] == key
        out = self.cache_ok[slot]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            some, back = np.unique(key[miss], return_inverse=True)
            ok = self._compatible(some // self.size, some % self.size)
            out[miss] = ok[back]
            slot = (some * 0x9E3779B1 >> 7) & (SLOTS - 1)
            self.cache_key[slot] = some
            self.cache_ok[slot] = ok
            wrong = self.cache_key[slot] != some  # two new pairs in one slot: keep the last whole
            if wrong.any():
                last = dict(zip(slot.tolist(), range(len(slot))))
                at = np.array(list(last.values()))
                self.cache_key[slot[at]], self.cache_ok[slot[at]] = some[at], ok[at]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of pre-tokens, in the order given."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out_sizes = np.zeros(len(raw), np.int64)
        order = np.argsort(sizes, kind="stable")
        at = 0
        parts, rows = [], []
        while at < len(order):
            widest = int(sizes[order[at]])
            n = max(1, min(len(order) - at, 2_000_000 // (widest + 8)))
            while n > 1 and n * (int(sizes[order[at + n - 1]]) + 1) > 4_000_000:
                n //= 2
            pick = order[at : at + n]
            got, ids = self._encode_some([raw[i] for i in pick], sizes[pick])
            out_sizes[pick] = got
            parts.append(ids)
            rows.append(pick)
            at += n
        if not parts:
            return out_sizes, np.zeros(0, np.uint32)
        flat, rows = np.concatenate(parts), np.concatenate(rows)
        starts = np.zeros(len(raw), np.int64)
        starts[rows] = np.cumsum(out_sizes[rows]) - out_sizes[rows]
        return out_sizes, flat[gather(starts, out_sizes)].astype(np.uint32)

    def _encode_some(self, raw: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        end = begin + sizes
        width = int(sizes.max(initial=0))
        stack = np.zeros((len(raw), width + 1), np.int32)
        dead = np.zeros((len(raw), width + 1), bool)
        depth = np.zeros(len(raw), np.int64)
        live = np.flatnonzero(sizes > 0)
        pos, token = begin[live].copy(), np.zeros(0, np.int64)
        token = self.longest(data, pos, end[live])
        while len(live):
            last = np.where(depth[live] > 0, stack[live, depth[live] - 1], -1)
            after = pos + self.lengths[token]
            ok = ~dead[live, after - begin[live]]
            check = np.flatnonzero(ok & (last >= 0))
            ok[check] = self.compatible(last[check].astype(np.int64), token[check])
            yes, no = np.flatnonzero(ok), np.flatnonzero(~ok)
            if len(yes):
                w = live[yes]
                stack[w, depth[w]] = token[yes]
                depth[w] += 1
                pos[yes] = after[yes]
                more = yes[pos[yes] < end[w]]
                token[more] = self.longest(data, pos[more], end[live[more]])
            if len(no):
                shorter = self.shorter[token[no]]
                token[no[shorter >= 0]] = shorter[shorter >= 0]
                back = no[shorter < 0]
                if len(back):
                    w = live[back]
                    dead[w, pos[back] - begin[w]] = True
                    depth[w] -= 1
                    token[back] = stack[w, depth[w]]
                    pos[back] -= self.lengths[token[back]]
            keep = pos < end[live]
            live, pos, token = live[keep], pos[keep], token[keep]
        return depth, stack[np.arange(width + 1)[None, :] < depth[:, None]]

    def decode(self, ids: np.ndarray, special: dict[int, bytes]) -> bytes:
        """Bytes of ids, by offsets into one table of all entries; an unknown id raises KeyError."""
        ids = ids.astype(np.int64)
        if len(ids) and ids.max() >= self.size:
            out, at = [], 0
            for k in np.flatnonzero(ids >= self.size):
                out += [self.decode(ids[at:k], special), special[int(ids[k])]]
                at = k + 1
            return b"".join([*out, self.decode(ids[at:], special)])
        return self.table[gather(self.offsets[ids], self.lengths[ids])].tobytes()


class Engine:
    def __init__(self, text: str):
        tokenizer = open_tokenizer(text)
        self.bpe = ByteBpe(text)
        self.coder = Coder(tokenizer, BYTE_SPLIT, self.bpe.encode_words, keep_space=True)
        self.special = {i: s.encode() for s, i in self.coder.special.items()}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.coder.ids(texts)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Token ids of every whole text: (id_col, ids array<int>), one row per input row.

    Null and empty texts give an empty array; a null id stays null; repeated rows each give a row; other
    columns are not carried.  Special strings inside a text become their id, as the library's default does.
    """
    text = tokenizer_text(tokenizer_path, "byte_bpe_50k.json")
    src = column_names(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = loaded("byte", text, Engine)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in blocks(texts):
                ids, counts = engine.encode(texts[part])
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=[id_col, "ids"])

    return map_arrow(src, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """Texts of id arrays: (id_col, text), special ids written out; a null array gives a null text."""
    text = tokenizer_text(tokenizer_path, "byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = loaded("byte", text, Engine)
        for batch in batches:
            out = [None if v is None else engine.bpe.decode(np.array(v, np.int64), engine.special).decode("utf-8", "replace") for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return map_arrow(column_names(encoded, id_col, ids_col), run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Encode and decode in one pass: (id_col, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    The ids never leave the executor; null texts count as empty.
    """
    text = tokenizer_text(tokenizer_path, "byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = loaded("byte", text, Engine)
        names = [str(i) for i in range(max([engine.bpe.size, *(i + 1 for i in engine.special)]))]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts_out, ids_out, text_out = [], [], []
            for part in blocks(texts):
                ids, counts = engine.encode(texts[part])
                listed = ids.tolist()
                decoded = None if len(ids) and ids.max() >= engine.bpe.size else engine.bpe.decode(ids, engine.special)
                ends = np.cumsum(counts)
                if decoded is not None:
                    bytes_at = np.concatenate(([0], np.cumsum(engine.bpe.lengths[ids])))
                for n, e in zip(counts.tolist(), ends.tolist()):
                    said = ",".join(map(names.__getitem__, listed[e - n : e]))
                    counts_out.append(n)
                    ids_out.append(hashlib.sha256(said.encode()).hexdigest())
                    raw = decoded[bytes_at[e - n] : bytes_at[e]] if decoded is not None else engine.bpe.decode(ids[e - n : e], engine.special)
                    text_out.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts_out, pa.int64()), pa.array(ids_out, pa.string()), pa.array(text_out, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        engine.coder.clear()  # the worker lives on for other stages

    return map_arrow(column_names(docs, id_col, text_col), run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
