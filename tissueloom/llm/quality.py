"""Quality rules whose thresholds adapt to language and source.

Each document's rates (integers per thousand) go into one mergeable quantile sketch per language, source
and rate: a histogram with 64 buckets to each power of two, exact below 128 and within 1.6 % above, of at
most a few thousand buckets, whatever the input.  A source's sketch is merged with its language's, scaled to
the weight of ``PRIOR`` documents, and that with the sketch of all, so small groups lean on larger ones by
weight and no size switches a rule.

Limits are quantiles of the merged sketch alone: a rate is too high beyond q + fence * (q - median), with q an
upper quantile of the group.  For rates that clean text hardly has (symbols) and for word length, q and the
median are low enough that a share of junk in the group does not move them; for rates that clean text has now
and then (repeated lines and words), q is the 99th percentile.  A mean word length can be too low as well.
A rate counts against a document only if ``EVENTS`` of what it counts are there, as one repeated line in three
says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Block, U64, blocks, map_arrow, materialize, span_hash, splitmix

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A broader sketch weighs as many documents as this in a narrower one.
PRIOR = 200
EVENTS = 5
SMALL_GROUPS = 100_000
#: rate, upper percentile, fence, whether it also has a lower limit, the count of its events
RATES = (("symbol_rate", 75, 4, False, "n_symbols"), ("dup_line_rate", 99, 3, False, "n_dup_lines"), ("repeat_rate", 99, 3, False, "n_repeat_words"), ("word_length", 90, 4, True, None))
NAMES = tuple(r[0] for r in RATES)

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return np.diff(total[np.minimum(starts, len(flags))])


def measure_texts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The counts of each text; words are maximal runs without space and 0x09-0x0D."""
    block = Block(texts)
    data, starts, first = block.data, block.starts, block.first
    n_words = np.diff(first)
    inside = np.zeros(len(data) + 1, np.int64)
    inside[block.begin] += 1
    inside[block.end] -= 1
    in_word = np.cumsum(inside[:-1]) > 0
    point = (data & 0xC0) != 0x80
    doc_of_word = np.repeat(np.arange(len(texts)), n_words)

    repeat = np.zeros(len(block.words), bool)
    grams = block.grams(3)
    if len(grams):
        ok = np.flatnonzero(doc_of_word[:-2] == doc_of_word[2:])
        _, back, count = np.unique(grams[ok] ^ splitmix(doc_of_word[ok].astype(U64)), return_inverse=True, return_counts=True)
        twice = ok[count[back] > 1]
        for k in range(3):
            repeat[twice + k] = True

    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate(([0], breaks + 1))
    line_end = np.concatenate((breaks, [len(data)]))
    worded = np.searchsorted(block.begin, line_start) < np.searchsorted(block.begin, line_end)
    line_start, line_end = line_start[worded], line_end[worded]
    line_doc = np.searchsorted(starts, line_start, side="right") - 1
    keys = span_hash(data, line_start, line_end) ^ splitmix(line_doc.astype(U64) + U64(1 << 40))
    _, at = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[at] = False
    count = lambda where, n=len(texts): np.bincount(where, minlength=n)[:n]

    return {
        "n_words": n_words,
        "word_chars": _sums(in_word & point, starts),
        "n_symbols": _sums(_IS_SYMBOL[data], starts),
        "n_dup_lines": count(line_doc[again]),
        "n_repeat_words": count(doc_of_word[repeat]),
        "n_lines": count(line_doc),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id_col, lang, source, counts) of every whole text; missing lang or source columns count as null.

    With carry, the whole row stands in column ``row`` in place of the id.
    """
    have = set(docs.columns)
    first = "row" if carry else "id"
    lead = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.col(f"`{id_col}`")
    src = docs.select(lead.alias(first), *[(F.col(f"`{c}`").cast("string") if c in have else F.lit(None).cast("string")).alias(f"g_{c}") for c in ("lang", "source")], *([] if carry else [F.col(f"`{text_col}`").cast("binary").alias("g_text")]))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).flatten()[at].cast(pa.binary()) if carry else batch.column(3)
            texts = found.to_pylist()
            got = [measure_texts(texts[part]) for part in blocks(texts)]
            cols = [pa.array(np.concatenate([np.zeros(0, np.int64), *(g[c] for g in got)]).astype(np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], names=[first, "lang", "source", *COUNTS])

    out = map_arrow(src, run, StructType([src.schema[first], *[StructField(c, StringType()) for c in ("lang", "source")], *[StructField(c, LongType()) for c in COUNTS]]))
    return out if carry else out.withColumnRenamed("id", id_col)


def rates(measured: DataFrame) -> DataFrame:
    share = lambda a, b: F.expr(f"CASE WHEN {b} > 0 THEN (1000 * {a}) DIV {b} ELSE 0L END")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumns(
        {
            "base_failed": failed,
            "symbol_rate": share("n_symbols", "word_chars"),
            "dup_line_rate": share("n_dup_lines", "n_lines"),
            "repeat_rate": share("n_repeat_words", "n_words"),
            "word_length": share("word_chars", "n_words"),
            "g_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")),
            "g_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
        }
    )


def _bucket(v: str) -> str:
    """The lowest value of the sketch bucket that holds v."""
    shift = f"(length(bin({v})) - 7)"
    return f"CASE WHEN {v} < 128 THEN {v} ELSE shiftleft(shiftright({v}, {shift}), {shift}) END"


def limits(rated: DataFrame) -> DataFrame:
    """(g_lang, g_source, <rate>_low, <rate>_high) of every language and source with a document that passes the base rule."""
    cols = ", ".join(f"'{r}', {_bucket(r)}" for r in NAMES)
    cells = rated.filter("NOT base_failed").select("g_lang", "g_source", F.expr(f"stack({len(RATES)}, {cols}) AS (rate, v)"))
    sketch = materialize(cells.groupBy("g_lang", "g_source", "rate", "v").agg(F.count("*").alias("w")), "sketch")

    def merged(own: DataFrame, keys: list[str], broad: DataFrame, shared: list[str]) -> DataFrame:
        """Ten times the own counts plus the broader sketch scaled to 10 * PRIOR."""
        total = F.sum("w").over(Window.partitionBy(*shared, "rate"))
        scaled = broad.withColumn("total", total).withColumn("w", F.expr(f"({10 * PRIOR} * w) DIV total")).drop("total")
        lent = own.select(*keys, "rate").distinct().join(scaled, [*shared, "rate"]).select(*keys, "rate", "v", "w")
        return own.select(*keys, "rate", "v", (10 * F.col("w")).alias("w")).union(lent).groupBy(*keys, "rate", "v").agg(F.sum("w").alias("w"))

    every = sketch.groupBy("rate", "v").agg(F.sum("w").alias("w"))
    langs = materialize(merged(sketch.groupBy("g_lang", "rate", "v").agg(F.sum("w").alias("w")), ["g_lang"], every, []), "languages")
    groups = merged(sketch, ["g_lang", "g_source"], langs, ["g_lang"])
    by = ["g_lang", "g_source", "rate"]
    upto, whole = F.sum("w").over(Window.partitionBy(*by).orderBy("v")), F.sum("w").over(Window.partitionBy(*by))
    ranked = groups.withColumns({"upto": upto, "whole": whole})
    percent = lambda of: F.expr("CASE rate " + " ".join(f"WHEN '{r}' THEN {of(p)}" for r, p, *_ in RATES) + " END")
    fence = F.expr("CASE rate " + " ".join(f"WHEN '{r}' THEN {f}" for r, _, f, *_ in RATES) + " END")
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("whole"), F.col("v")))
    q = ranked.groupBy(*by).agg(at(F.lit(50)).alias("mid"), at(percent(lambda p: p)).alias("up"), at(percent(lambda p: 100 - p)).alias("down"))
    q = q.withColumns({"high": F.col("up") + fence * (F.col("up") - F.col("mid")), "low": F.col("down") - fence * (F.col("mid") - F.col("down"))})
    wide = [F.max(F.when(F.col("rate") == r, F.col(e))).alias(f"{r}_{e}") for r in NAMES for e in ("low", "high")]
    return q.groupBy("g_lang", "g_source").agg(*wide)


def _verdict(rated: DataFrame, found: DataFrame) -> DataFrame:
    """found: the written limits, one row a language and source; broadcast once their number is known to be small."""
    fine = F.lit(True)
    for r, _, _, two_sided, events in RATES:
        fits = F.col(r) <= F.col(f"{r}_high")
        fits = fits | (F.col(events) < EVENTS) if events else fits
        fits = fits & (F.col(r) >= F.col(f"{r}_low")) if two_sided else fits
        fine = fine & F.coalesce(fits, F.lit(True))
    few = F.broadcast(found) if found.count() <= SMALL_GROUPS else found
    return rated.join(few, ["g_lang", "g_source"], "left").withColumn("kept", ~F.col("base_failed") & fine)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, counts, base_failed, kept, rates) for every row.

    Null, empty and wordless texts have zero counts and fail the base rule.  Null language or source forms a
    group of its own.  Repeated rows are judged alike, each giving a row.  Other columns are not carried.
    """
    rated = rates(materialize(measure(docs, id_col, text_col), "measured"))
    return _verdict(rated, materialize(limits(rated), "limits")).select(id_col, *COUNTS[:5], "base_failed", "kept", *NAMES)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns; texts are never shuffled."""
    found = materialize(limits(rates(materialize(measure(docs, id_col, text_col), "measured"))), "limits")
    kept = _verdict(rates(measure(docs, id_col, text_col, carry=True)), found).filter("kept")
    return _unpacked(kept, docs)


def _oracle() -> str:
    def bucket(v: str) -> str:
        return f"CASE WHEN {v} < 128 THEN {v} ELSE ({v} >> (length(bin({v})) - 7)) << (length(bin({v})) - 7) END"

    cells = " UNION ALL ".join(f"SELECT gl, gs, '{r}' AS rate, {bucket(r)} AS v FROM f WHERE NOT base_failed" for r in NAMES)
    case = lambda of: "CASE rate " + " ".join(f"WHEN '{r[0]}' THEN {of(r)}" for r in RATES) + " END"
    at = lambda p: f"min(CASE WHEN 100 * upto >= {p} * whole THEN v END)"

    def merged(name: str, own: str, keys: str, broad: str, shared: str) -> str:
        on = f"USING ({shared}rate)"
        return f"""
{name}t AS (SELECT {shared}rate, v, ({10 * PRIOR} * w) // sum(w) OVER (PARTITION BY {shared}rate) AS w FROM {broad}),
{name} AS (SELECT {keys}rate, v, sum(w) AS w FROM (SELECT {keys}rate, v, 10 * w AS w FROM {own} UNION ALL SELECT {keys}rate, v, {name}t.w FROM (SELECT DISTINCT {keys}rate FROM {own}) JOIN {name}t {on}) GROUP BY {keys}rate, v)"""

    breaks = " OR ".join(f"(rate = '{r}' AND ((x.v > high{f' AND events >= {EVENTS}' if e else ''}){' OR x.v < low' if two else ''}))" for r, _, _, two, e in RATES)
    long = " UNION ALL ".join(f"SELECT doc_id, gl, gs, '{r}' AS rate, {r} AS v, {e or '0'} AS events FROM f" for r, _, _, _, e in RATES)
    return f"""
WITH t AS (SELECT doc_id, lang, source, text, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
wi AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM wi),
rp AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
ls AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS dup FROM ln GROUP BY doc_id),
m AS (SELECT t.doc_id, coalesce('=' || lang, '') AS gl, coalesce('=' || source, '') AS gs, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
    CAST(coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rp.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM t LEFT JOIN rp ON rp.doc_id = t.doc_id LEFT JOIN ls ON ls.doc_id = t.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbol_rate, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_rate,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_rate, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length FROM m),
c AS (SELECT gl, gs, rate, v, CAST(count(*) AS HUGEINT) AS w FROM ({cells}) GROUP BY gl, gs, rate, v),
ca AS (SELECT rate, v, sum(w) AS w FROM c GROUP BY rate, v), cl AS (SELECT gl, rate, v, sum(w) AS w FROM c GROUP BY gl, rate, v),{merged("ml", "cl", "gl, ", "ca", "")},{merged("mo", "c", "gl, gs, ", "ml", "gl, ")},
r AS (SELECT *, sum(w) OVER (PARTITION BY gl, gs, rate ORDER BY v) AS upto, sum(w) OVER (PARTITION BY gl, gs, rate) AS whole FROM mo),
q AS (SELECT gl, gs, rate, {at("50")} AS mid, {at("(" + case(lambda r: r[1]) + ")")} AS up, {at("(" + case(lambda r: 100 - r[1]) + ")")} AS down FROM r GROUP BY gl, gs, rate),
li AS (SELECT gl, gs, rate, up + {case(lambda r: r[2])} * (up - mid) AS high, down - {case(lambda r: r[2])} * (mid - down) AS low FROM q),
x AS ({long}),
bad AS (SELECT DISTINCT doc_id FROM x JOIN li USING (gl, gs, rate) WHERE {breaks})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f
"""


ORACLE_SQL = _oracle()
