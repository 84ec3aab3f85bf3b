"""Secret scans: fixed patterns, and character Markov models for other random strings.

Two first-order Markov models over characters, one of random strings and one
of ordinary identifiers, are counted from labelled samples; a long token whose
mean log-likelihood ratio per step is above a threshold is reported. All is
DataFrame functions: matches come from regexp_extract_all, their places from
the lengths of the pieces that split() leaves between them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import packed, table, unpacked

#: Kinds in their order, with pattern, group whose length counts, and its least length.
KINDS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Cheap tests that every text with a span of the kind passes. A run of access or hex characters
#: that is long enough starts just where the run starts, so the counted forms find the same spans.
_MAY = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: What every text with an assigned secret holds, in a form that is quick to look for.
_GUARD = {"assign": r"[PpSsTtAa](?i:assword|asswd|ecret|oken|pi_?key)[\"']?\x20*[:=]"}
MARKOV, CANDIDATE = "markov", r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Letters of the models in order; any other character counts as the place before the first.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
SIZE = len(LETTERS) + 1
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _spans(text: Column, pattern: str, kind: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost matches that don't overlap, without those whose group is too short."""
    none = F.array().cast(f"array<{SPAN}>")
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    hits, held = (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), F.length) for g in (0, group))
    # split() leaves one piece more than there are matches; it has no match beside it.
    rows = F.zip_with(F.zip_with(pieces, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), held, lambda x, n: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), n.alias("held")))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.coalesce(x["hit"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["held"] >= least, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.when(text.rlike(_GUARD.get(kind, pattern)), F.aggregate(rows, start, step, lambda a: a["out"])).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    return {kind: _spans(text, _MAY.get(kind, pattern), kind, rank, group, least) for rank, (kind, pattern, group, least) in enumerate(KINDS)}


def labelled_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = 2000) -> DataFrame:
    """(token, random): a labelled sample from about ``most`` documents at most, chosen by hash.

    Values that the fixed patterns find are random strings, other words of 4
    letters and more are ordinary identifiers.
    """
    rows = max(1, docs.count())
    share = min(1 << 20, (most << 20) // rows + 1)
    some = docs.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(7)), F.lit(1 << 20)) < share).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    found = [F.regexp_extract_all("t", F.lit(_MAY.get(k, p)), F.lit(g)) for k, p, g, _ in KINDS]
    secret = some.select(F.explode(F.filter(F.concat(*found), lambda x: F.length(x) >= 16)).alias("token"), F.lit(True).alias("random"))
    rest = F.col("t")
    for kind, pattern, _, _ in KINDS:
        rest = F.regexp_replace(rest, _MAY.get(kind, pattern), " ")
    plain = some.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9_-]{4,}"), F.lit(0))).alias("token"), F.lit(False).alias("random"))
    return secret.union(plain)


def _places(token: Column) -> Column:
    """Each character's place in LETTERS, from 1 (0: none)."""
    return F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(LETTERS)))


def train(samples: DataFrame, lean: float = 5.0) -> list[float]:
    """Log-likelihood ratio of each step from one letter to the next, random against ordinary.

    Steps are counted in Spark; at most 2 * 63 * 63 counts reach the driver.
    A step leans on how common the letter it leads to is, as if that had been
    seen ``lean`` times after each letter: without samples all ratios are 0.
    """
    pairs = samples.withColumn("p", _places(F.col("token"))).where(F.size("p") > 1)
    pairs = pairs.select("random", F.explode(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: a * SIZE + b)).alias("step"))
    counts = {(r["random"], r["step"]): r["n"] for r in pairs.groupBy("random", "step").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = {}
    for kind in (True, False):
        n = [[counts.get((kind, a * SIZE + b), 0) for b in range(SIZE)] for a in range(SIZE)]
        letter = [sum(n[a][b] for a in range(SIZE)) + 0.5 for b in range(SIZE)]
        total = sum(letter)
        chance[kind] = [math.log((n[a][b] + lean * letter[b] / total) / (sum(n[a]) + lean)) for a in range(SIZE) for b in range(SIZE)]
    return [x - y for x, y in zip(chance[True], chance[False], strict=True)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per step."""
    table_ = F.expr("array(" + ",".join(f"{x!r}D" for x in model) + ")")
    p = _places(token)
    steps = F.zip_with(F.slice(p, F.lit(1), F.length(token) - 1), F.slice(p, F.lit(2), F.length(token) - 1), lambda a, b: F.get(table_, a * SIZE + b))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.length(token) - 1, F.lit(1))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7, model: list[float] | None = None) -> DataFrame:
    """All columns, and spans: array of (start, rank, kind, end), by start and kind; code points, end exclusive.

    Base spans are all kept; a token of 20 and more characters that overlaps
    none of them is added as markov if it holds a digit and a letter and its
    ratio is above the threshold. A null or empty text has no spans; rows that
    are repeated are each scanned; an empty table gives no rows; a column
    called spans is replaced.
    """
    model = model or train(labelled_tokens(docs, text, doc_id))
    rows = docs.drop("spans").withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumns({f"__{k}": c for k, c in base_spans(F.col("__t")).items()})
    rows = rows.withColumn("__base", F.concat(*[f"__{k}" for k, *_ in KINDS])).withColumn("__all", _spans(F.col("__t"), CANDIDATE, MARKOV, len(KINDS)))
    free = F.filter("__all", lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    rows = rows.withColumn("__free", free)
    token = lambda x: F.substr(F.col("__t"), x["start"] + 1, x["end"] - x["start"])
    odd = F.filter("__free", lambda x: token(x).rlike("[0-9]") & token(x).rlike("[A-Za-z]") & (ratio(token(x), model) > threshold))
    rows = rows.withColumn("spans", F.sort_array(F.concat("__base", odd)))
    return rows.drop("__t", "__base", "__all", "__free", *[f"__{k}" for k, *_ in KINDS])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mark: str = "[SECRET]", **params) -> DataFrame:
    """The documents with a mark in place of each span (overlapping spans: one mark); n_chars is counted anew.

    A null text stays null; equal rows are redacted alike; an empty table gives
    no rows; other columns are returned as they are, whatever their names.
    """
    rows = scan(packed(docs, text, doc_id), text, doc_id, **params)
    whole = F.col(text).cast("string")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substr(whole, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        return F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] >= a["at"], F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"),
        )

    clean = F.aggregate("spans", begin, step, lambda a: F.concat(a["out"], F.substr(whole, a["at"] + 1)))
    hit = F.size("spans") > 0
    rows = rows.withColumn("__clean", F.when(hit, clean).otherwise(F.col(text)))
    new = {text: F.col("__clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__own")["n_chars"])
    return unpacked(rows, docs, **new)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in KINDS],
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] != MARKOV)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
