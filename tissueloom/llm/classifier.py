"""Quality classifier by compression.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad.  A text is
compressed in pieces of ``PIECE`` bytes with each.  Its evidence is the difference of the two sizes over its
length plus ``PRIOR`` bytes (so that short texts say little).  A logistic curve fitted on other labelled texts
turns the evidence into a score.

Fitting uses at most ``SAMPLE`` labelled texts of either class, those with the smallest hashes of their id.
Fitting and scoring read every text whole; the driver holds the texts fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, map_arrow

SAMPLE = 1200
DICTIONARY_BYTES = 64 << 10
PIECE = 2048
LEVEL = 3
PRIOR = 200


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: tuple[float, ...]
    empty: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        x, some = evidence(texts, *compressors(self.good, self.bad))
        z = np.clip(x @ np.array(self.curve[:-1]) + self.curve[-1], -30, 30)
        return np.where(some, 1 / (1 + np.exp(-z)), self.empty)


_made: dict[int, tuple] = {}
kept_by_worker.append(_made)


def compressors(good: bytes, bad: bytes) -> tuple:
    import zstandard

    key = hash((good, bad))
    if key not in _made:
        _made.clear()
        _made[key] = tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad))
    return _made[key]


def _dictionary(raw: bytes):
    import zstandard

    out = zstandard.ZstdCompressionDict(raw)
    out.precompute_compress(level=LEVEL)
    return out


def evidence(texts: list[bytes | None], with_good, with_bad) -> tuple[np.ndarray, np.ndarray]:
    """The normalised size difference of each text, as a column, and whether there is text at all."""
    out, some = np.zeros((len(texts), 1)), np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        if not t:
            continue
        some[i] = True
        a = b = 0
        for at in range(0, len(t), PIECE):
            piece = t[at : at + PIECE]
            a += len(with_good.compress(piece))
            b += len(with_bad.compress(piece))
        out[i] = (b - a) / (len(t) + PRIOR)
    return out, some


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or plain content where there is too little text to train on."""
    import zstandard

    pieces = [t[at : at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
    pieces = [p for p in pieces if len(p) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:] or b" " * 8


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Slopes and, last, the offset, by Newton's method with a small ridge; classes weigh alike."""
    middle, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    u = np.concatenate(((x - middle) / scale, np.ones((len(x), 1))), 1)
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(u.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(u @ beta, -30, 30)))
        gradient = u.T @ (w * (p - y)) + 1e-2 * beta
        hessian = (u * (w * p * (1 - p))[:, None]).T @ u + 1e-2 * np.eye(u.shape[1])
        step = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[:-1] / scale
    return (*map(float, slopes), float(beta[-1] - slopes @ middle))


def training_rows(docs: DataFrame, labels: DataFrame, held_out, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(y, order, text) of at most ``SAMPLE`` texts of either class, one an id.

    Conflicting labels of an id count as bad, null labels not at all; of rows that repeat an id the smallest text is taken.
    """
    rows = labels.filter(~held_out(F.col(f"`{id_col}`"))).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("y IN (0, 1)")
    rows = rows.groupBy("id").agg(F.min("y").alias("y")).withColumn("order", F.xxhash64("id"))
    picked = rows.filter("y = 1").orderBy("order", "id").limit(SAMPLE).union(rows.filter("y = 0").orderBy("order", "id").limit(SAMPLE))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    # at most 2 * SAMPLE ids
    found = texts.join(F.broadcast(picked), "id")
    return found.groupBy("id", "y", "order").agg(F.min("text").alias("text")).select("y", "order", "text")


def fit(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from the labelled texts whose id is not held out.  Without labels of both classes every score is one half."""
    rows = sorted(((r["order"], r["y"], bytes(r["text"] or b"")) for r in training_rows(docs, labels, held_out, id_col, text_col, label_col).toLocalIterator()), key=lambda r: (r[0], r[2]))
    full = [r for r in rows if r[2]]
    empty = [r[1] for r in rows if not r[2]]
    halves = [[r for k, r in enumerate([r for r in full if r[1] == y]) if k % 2 == half] for y in (0, 1) for half in (0, 1)]
    (bad, bad_check), (good, good_check) = halves[:2], halves[2:]
    if not bad or not good:
        return Model(b" " * 8, b" " * 8, (0.0, 0.0), 0.5)
    good_d, bad_d = (build_dictionary([r[2] for r in part]) for part in (good, bad))
    check = good_check + bad_check or good + bad
    x, _ = evidence([r[2] for r in check], *compressors(good_d, bad_d))
    curve = fit_logistic(x, np.array([r[1] for r in check], float))
    # a text without content: the share of good ones among such, drawn to a low start, as nothing is no quality
    return Model(good_d, bad_d, curve, (sum(empty) + 0.2) / (len(empty) + 2))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every row; null and empty texts get the model's score for them.

    Repeated rows score alike; other columns are neither used nor carried.
    """
    src = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return map_arrow(src, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def held_out(ident):
    """Whether a row is kept from fitting: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))
