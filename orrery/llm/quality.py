"""Quality rules with cross-document line frequency, in DataFrame functions alone.

A line, whatever its length, is boilerplate of a host if more than a limit of
the host's documents have it. Such lines are removed; a document that keeps
too few words without them is depleted and rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import NOT_SPACE, cut, packed, small, spaced, table, unpacked, word_count, words_of

#: The symbols counted, and the words of a repetition window.
SYMBOLS, WINDOW = "[#*$%&|<>]", 8


@dataclass(frozen=True)
class Limits:
    """min_docs, share: a line is boilerplate above the larger of min_docs and share of the host's documents.
    min_words, min_share: a document that has lost lines is depleted if fewer words than min_words, or less
    than min_share of its words, remain. copies_once: documents of one text on a host count as one, for use
    before deduplication: else a text that stands there more often than the limit is lost with all its copies."""

    min_docs: int = 20
    share: float = 0.001
    copies_once: bool = False
    min_words: int = 20
    min_share: float = 0.3


def _repeat_words(docs: DataFrame) -> DataFrame:
    """From __words: n_repeat_words, the words in windows that a text has twice or more."""
    # Hashes of 1, 2, 4 and 8 words: each pairs those of half the length.
    docs = docs.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    half = 1
    while half < WINDOW:
        later = F.slice("__h", half + 1, F.greatest(F.size("__h") - half, F.lit(0)))
        docs = docs.withColumn("__h", F.zip_with("__h", later, lambda x, y: F.xxhash64(x, y)))
        half *= 2
    docs = docs.withColumn("__h", F.slice("__h", 1, F.greatest(F.size("__words") - (WINDOW - 1), F.lit(0))))
    # Most texts repeat no window; only the others are sorted.
    docs = docs.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("__s", lambda e, k: (F.get("__s", k - 1)["h"] == e["h"]) | (F.get("__s", k + 1)["h"] == e["h"]))
    docs = docs.withColumn("__p", F.sort_array(F.transform(twice, lambda e: e["i"])))
    first = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("__p", first, lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(x - a["at"], F.lit(WINDOW))).alias("n")), lambda a: a["n"])
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__h", "__s", "__p")


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    docs = docs.withColumns({"__text": whole, "__words": words_of(whole), "__lines": lines})
    docs = docs.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        }
    )
    docs = _repeat_words(docs)
    return docs.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")).drop("__text", "__words", "__lines")


def _normal(line: Column) -> Column:
    """Case, digits and spacing don't tell lines apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(spaced(F.lower(line)), "[1-9]", "0"), " {2,}", " "))


def _name(docs: DataFrame, text: str, host: str, doc_id: str) -> dict[str, Column]:
    return {"__doc": F.col(doc_id), "__host": F.coalesce(F.col(host).cast("string"), F.lit("\x00")), "__hash": F.xxhash64(F.col(text))}


def line_verdicts(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", limits: Limits = Limits(), which: bool = False) -> DataFrame:
    """(__doc, __host, __hash, __gone) of the documents with frequent lines, one row each; with ``which`` also __often, the hashes of these."""
    rows = docs.select(*[c.alias(n) for n, c in _name(docs, text, host, doc_id).items()], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    # What counts as one document; one without doc_id is named by its text.
    one = F.col("__hash") if limits.copies_once else F.coalesce(F.when(F.col("__doc").isNotNull(), F.xxhash64("__doc")), F.col("__hash"))
    rows = rows.withColumn("__one", one)
    counted = F.filter(F.transform(F.split("__text", "\n", -1), lambda x: F.struct(x.alias("line"), word_count(x).alias("words"))), lambda x: x["words"] > 0)
    # Rows may be alike: the mark tells their lines apart.
    lines = rows.select("__doc", "__host", "__hash", "__one", F.monotonically_increasing_id().alias("__row"), counted.alias("__lines"))
    lines = lines.withColumn("__n", F.aggregate("__lines", F.lit(0).cast("long"), lambda n, x: n + x["words"]))
    lines = lines.select("__doc", "__host", "__hash", "__one", "__row", "__n", F.inline("__lines"))
    lines = lines.groupBy("__doc", "__host", "__hash", "__one", "__row", "__n", F.xxhash64(_normal(F.col("line"))).alias("line")).agg(F.sum("words").alias("words"))
    lines = cut(lines)
    seen = lines.groupBy("__host", "line", "__one").agg(F.lit(1).alias("one")).groupBy("__host", "line").agg(F.count(F.lit(1)).alias("n"))
    hosts = rows.groupBy("__host", "__one").agg(F.lit(1).alias("one")).groupBy("__host").agg(F.count(F.lit(1)).alias("docs"))
    often = seen.where(F.col("n") > limits.min_docs).join(hosts, "__host").where(F.col("n") > limits.share * F.col("docs")).select("__host", "line")
    # Cut, so that the join has plain shuffles, which adaptive execution may split at a hot line, where it isn't a broadcast.
    lost = lines.join(small(cut(often)), ["__host", "line"]).groupBy("__doc", "__host", "__hash", "__row", "__n")
    lost = lost.agg(F.sum("words").alias("lost"), *([F.collect_set("line").alias("__often")] if which else []))
    left = F.col("__n") - F.col("lost")
    lost = lost.withColumn("__gone", (left < limits.min_words) | (left < limits.min_share * F.col("__n")))
    # Rows alike have the same lines.
    return lost.groupBy("__doc", "__host", "__hash").agg(F.max("__gone").alias("__gone"), *([F.first("__often").alias("__often")] if which else []))


def _beside(docs: DataFrame, verdicts: DataFrame, text: str, host: str, doc_id: str) -> DataFrame:
    """docs with the further columns of their verdicts, null where there is none."""
    further = [c for c in verdicts.columns if c not in ("__doc", "__host", "__hash")]
    told = small(cut(verdicts)).select(F.col("__doc").alias("__d"), F.col("__host").alias("__o"), F.col("__hash").alias("__x"), *further)
    rows = docs.withColumns(_name(docs, text, host, doc_id))
    same = rows["__doc"].eqNullSafe(told["__d"]) & (rows["__host"] == told["__o"]) & (rows["__hash"] == told["__x"])
    return rows.join(told, same, "left").drop("__doc", "__host", "__hash", "__d", "__o", "__x")


def judge(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """All rows and columns, the base measures, and kept (false if base_failed or depleted).

    A null or empty text has no words and fails the base rules. Rows alike in
    doc_id, host and text get the same verdict, and rows of one doc_id count as
    one document; a null host is a host of its own. An empty table gives no
    rows; columns of the given names are replaced.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    gone = line_verdicts(docs, text, host, doc_id, limits).where("__gone").select("__doc", "__host", "__hash", "__gone")
    # Joined before the measures are taken: a filter on them would be pushed down and take them twice.
    rows = base_rules(_beside(docs, gone, text, host, doc_id), text)
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("__gone").isNull()).drop("__gone")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns; their frequent lines are removed and n_chars counted anew there.

    A null, empty or wordless text goes; equal rows go or stay together; an
    empty table gives no rows; an own column is returned as it is, whatever
    its name (names that start with __ are kept for the operators).
    """
    rows = packed(docs, text, host, doc_id)
    told = line_verdicts(rows, text, host, doc_id, limits, which=True)
    rows = _beside(rows, told, text, host, doc_id)
    # The row mark holds the filter where it stands: pushed down, it would copy the
    # nested window hashes into the condition and evaluate them many times.
    rows = base_rules(rows.where("NOT coalesce(__gone, false)"), text).withColumn("__stay", F.monotonically_increasing_id())
    rows = rows.where(~F.col("base_failed") & (F.col("__stay") >= 0))
    frequent = lambda x: F.array_contains("__often", F.xxhash64(_normal(x))) & x.rlike(NOT_SPACE)
    kept = F.array_join(F.filter(F.split(F.col(text).cast("string"), "\n", -1), lambda x: ~frequent(x)), "\n")
    hit = F.col("__often").isNotNull()
    rows = rows.withColumn("__clean", F.when(hit, kept).otherwise(F.col(text)))
    new = {text: F.col("__clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__own")["n_chars"])
    return unpacked(rows, docs, **new)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT *, row_number() OVER () AS r FROM d),
b AS (SELECT r, doc_id, host, text, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM u),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM u)),
dup AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
gap AS (SELECT r, least(8, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 8)) AS c FROM dup),
rep AS (SELECT r, sum(c)::BIGINT AS n_repeat_words FROM gap GROUP BY r),
l AS (SELECT r, doc_id, host, text, n_words, unnest(string_split(text, chr(10))) AS raw FROM b),
m AS (SELECT *, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS words,
    regexp_replace(regexp_replace(trim(regexp_replace(lower(raw), '[\x09-\x0D]', ' ', 'g')), '[1-9]', '0', 'g'), ' {2,}', ' ', 'g') AS line FROM l),
k AS (SELECT * FROM m WHERE words > 0),
f AS (SELECT host, line, count(DISTINCT coalesce('i' || doc_id, 't' || text)) AS n FROM k GROUP BY ALL),
h AS (SELECT host, count(DISTINCT coalesce('i' || doc_id, 't' || text)) AS docs FROM b GROUP BY host),
often AS (SELECT f.host, line FROM f JOIN h ON f.host = h.host WHERE n > 20 AND n > 0.001 * docs),
lost AS (SELECT r, any_value(n_words) AS n_words, sum(words) AS lost FROM k SEMI JOIN often ON k.host = often.host AND k.line = often.line GROUP BY r),
gone AS (SELECT r FROM lost WHERE n_words - lost < 20 OR n_words - lost < 0.3 * n_words),
o AS (SELECT b.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, gone.r IS NOT NULL AS is_gone
    FROM b LEFT JOIN rep ON b.r = rep.r LEFT JOIN gone ON b.r = gone.r)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT is_gone AS kept
FROM o
"""
