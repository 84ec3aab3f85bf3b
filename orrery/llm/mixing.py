"""Mixing sources to target weights with hash-random keys and distributed prefix sums.

Every document gets a hash-random key. Within a source the key space is cut
into even ranges; the sums of the ranges and the sums inside each range add up
to the prefix sum of every document, so no source, however large, is summed in
one task. A source is taken as often as its budget holds it, and once more in
key order up to the exact rest of the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import SPACE_CHARS, packed, table, unpacked, word_count

#: Documents that a key range holds about.
RANGE_ROWS = 20_000


def _marked(docs: DataFrame, ranges: int, text: str, source: str, doc_id: str) -> DataFrame:
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    part = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges
    return docs.withColumns(
        {
            "__size": word_count(F.col(text)),
            "__source": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t")),  # null sorts last
            "__key": key,
            "__range": F.shiftright(part, 32).cast("int"),
            "__tie": F.xxhash64(F.col(text)),
        }
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(__source, source_size) -> also weight and target.

    The sources share ``share`` times all words by weight; none goes above
    ``most`` times its size, and what it can't take is shared by the others.
    Sorted by what a unit of weight may take, the sources before the level are
    full, and the first that the level doesn't fill fixes it.
    """
    everything = Window.partitionBy()
    order = Window.orderBy("__source")
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)) + 1))
    rows = rows.withColumn("most", most * F.col("source_size")).withColumn("per", F.col("most").cast("double") / F.col("weight"))
    before = Window.orderBy("per", "__source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(share).cast("double") * F.sum("source_size").over(everything).cast("double")
    rows = rows.withColumns(
        {
            "at": F.row_number().over(Window.orderBy("per", "__source")),
            "level": (total - F.coalesce(F.sum("most").over(before), F.lit(0)).cast("double"))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"),
        }
    )
    level = F.min(F.when(F.col("level") <= F.col("per"), F.struct("at", "level"))).over(everything)["level"]
    fair = level * F.col("weight").cast("double")
    return rows.select(
        "__source",
        "source_size",
        "weight",
        F.when(level.isNull() | (fair > F.col("most")), F.col("most").cast("double")).otherwise(fair).alias("target"),
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
) -> DataFrame:
    """All rows and columns, and size, source_size, target and taken (words, repeats counted).

    Sources in code-point order, null last, have the weights in turn. The whole
    words of a source's target are taken exactly: full epochs, then documents by
    key until the rest is used up, the last one in part. A null or empty text
    has size 0 and gives nothing. Rows of equal doc_id follow one another by
    size and text; rows alike in all three are interchangeable. An empty table
    gives no rows; columns of the given names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    ranges = max(1, -(-docs.count() // RANGE_ROWS))
    rows = _marked(docs, ranges, text, source, doc_id)
    sums = rows.groupBy("__source", "__range").agg(F.sum("__size").alias("__sum"))
    goals = targets(sums.groupBy("__source").agg(F.sum("__sum").alias("source_size")), weights, share, most)
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum").join(goals, "__source")
    rows = rows.join(sums, ["__source", "__range"])
    inside = Window.partitionBy("__source", "__range").orderBy("__key", F.col(doc_id), "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) DIV source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("__before"), F.lit(0)), F.col("__size"))
    return rows.select(*[docs[c] for c in docs.columns], F.col("__size").alias("size"), "source_size", "target", (epochs * F.col("__size") + last).cast("long").alias("taken"))


def _first_words(text: Column, n: Column) -> Column:
    """The text up to and with its n-th word and the white space behind it."""
    spaces = "".join(f"\\x{ord(c):02x}" for c in SPACE_CHARS)
    pieces = F.split(text, f"(?<=[{spaces}])(?=[^{spaces}])")
    lead = F.when(text.rlike(f"^[{spaces}]"), 1).otherwise(0)
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int") + lead), "")


def repeated(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **params) -> DataFrame:
    """The mixed documents themselves: a row for each time a document is taken, the last one cut to the words taken.

    Where a text is cut, n_chars is counted anew; other columns are returned as
    they are, whatever their names. A null, empty or wordless text has no words
    to take and no row; rows of equal doc_id are each taken for themselves; an
    empty table gives no rows.
    """
    rows = mix(packed(docs, text, source, doc_id), text, source, doc_id, **params).where("taken > 0")
    rows = rows.withColumn("__copy", F.explode(F.expr("sequence(CAST(1 AS BIGINT), CAST(ceil(taken / size) AS BIGINT))")))
    words = F.least(F.col("size"), F.col("taken") - (F.col("__copy") - 1) * F.col("size"))
    cut = words < F.col("size")
    rows = rows.withColumn("__part", F.when(cut, _first_words(F.col(text).cast("string"), words)).otherwise(F.col(text)))
    new = {text: F.col("__part")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("__part").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__own")["n_chars"])
    return unpacked(rows, docs, **new)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key, hash(text) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
p AS (SELECT *, 2 * source_size AS most, (2 * source_size)::DOUBLE / weight AS per FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY per, source NULLS LAST) AS k,
  (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY per, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER ()
    - coalesce(sum(weight) OVER (ORDER BY per, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM p),
g AS (SELECT source, source_size,
  least(most::DOUBLE, coalesce((SELECT arg_min(level, k) FROM l WHERE level <= per) * weight::DOUBLE, most::DOUBLE)) AS target
  FROM l),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size, d.h
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(greatest(budget - epochs * source_size - before_, 0), size))::BIGINT AS taken
FROM e
"""
