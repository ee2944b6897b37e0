"""Token counts with a whole-token shortcut.

Before any text is read, every vocabulary string that can be a pre-token is encoded alone; those that come
out as one token are proven whole.  Counting then looks pre-tokens up among them, and only the others are
merged, once for each distinct one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .pretokens import WORD_SPLIT, Coder, library_words, loaded, open_tokenizer, tokenizer_text
from .common import blocks, map_arrow


def whole_tokens(tokenizer) -> list[str]:
    """Vocabulary strings that are a pre-token by themselves and encode alone as exactly one token."""
    to_byte = byte_alphabet()
    found = []
    for s in tokenizer.get_vocab(with_added_tokens=False):
        if not s.endswith("</w>"):
            continue
        try:
            word = bytes(to_byte[c] for c in s[: -len("</w>")]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if word and WORD_SPLIT.findall(word) == [word] and tokenizer.normalizer.normalize_str(word) == word:
            found.append(word)
    sizes, _ = library_words(tokenizer)(found)
    return [w for w, n in zip(found, sizes) if n == 1]


class Counter:
    """Counts tokens of texts; whole tokens are known from the start and kept."""

    def __init__(self, text: str):
        tokenizer = open_tokenizer(text)
        merge = library_words(tokenizer)
        self.coder = Coder(tokenizer, WORD_SPLIT, lambda words: (merge(words)[0], np.zeros(0, np.uint32)), keep_space=False, keep_ids=False)
        whole = whole_tokens(tokenizer)
        self.coder.always = (whole, np.ones(len(whole), np.int64), np.zeros(0, np.uint32))
        self.coder.clear()

    def count(self, texts: list[str | None]) -> np.ndarray:
        return self.coder.count(texts)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, tokenizer_path: str | None = None) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row; null and empty texts count 0 bytes and 0 tokens.

    Repeated rows each give a row, a null id stays null, other columns are not carried.  No shuffle.
    """
    text = tokenizer_text(tokenizer_path, "word_bpe_49k.json")
    src = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")).cast("long"), F.lit(0)).alias("n_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded("count", text, Counter)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.concatenate([np.zeros(0, np.int64), *(counter.count(texts[part]) for part in blocks(texts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(src, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
