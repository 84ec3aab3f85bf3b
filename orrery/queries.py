"""A query for each operation on the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery import Frame, asc, desc, on, on_by, using, using_by, using_columns, using_columns_by

KEYS = {"events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "documents": "doc_id", "labels": "doc_id", "nation": "n_nationkey", "region": "r_regionkey"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NULLED = "SELECT event_id, user_id, event_type, value, nullif(event_type, 'error') AS v, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x FROM events"


def _query(sql: str):
    """Register a function of table -> Frame; what it returns is the result."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(lambda name: Frame.from_parquet(spark, f"{sf_dir}/{name}.parquet", KEYS.get(name, ())))
            return out.df if isinstance(out, Frame) else out

        QUERIES[fn.__name__] = run
        ORACLES[fn.__name__] = sql
        return run

    return add


def _nulled(t) -> Frame:
    """Events with two nullable columns: v (the type) and x (the value), null where the type is error."""
    events = t("events")
    f = events.with_column("v", events.series(F.nullif("event_type", F.lit("error"))))
    return f.with_column("x", f.series(F.when(F.col("event_type") != "error", F.col("value"))))


@_query("SELECT r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY r_name")
def revenue_by_region(t):
    orders = t("orders")
    sold = orders.filter(orders["o_orderstatus"].eq("F")).inner_join(t("customer"), using_columns("custkey", "o_custkey", "c_custkey"))
    sold = sold.inner_join(t("nation"), using_columns("nationkey", "c_nationkey", "n_nationkey")).inner_join(t("region"), using_columns("regionkey", "n_regionkey", "r_regionkey"))
    g = sold.group_by(sold["r_name"])
    return g.result("r_name", orders=g.sizes(), revenue=F.round(sold["o_totalprice"].sum(), 2))


@_query("SELECT o_orderstatus, o_orderkey FROM orders")
def select_project(t):
    return t("orders").select("o_orderstatus", "o_orderkey")


@_query("SELECT * EXCLUDE (o_orderpriority, o_orderdate) FROM orders")
def drop_columns(t):
    return t("orders").drop("o_orderpriority", "o_orderdate", "o_orderdate")


@_query("SELECT c_custkey AS customer_id, c_mktsegment FROM customer")
def rename_column(t):
    return t("customer").rename("c_custkey", "customer_id").select("customer_id", "c_mktsegment")


@_query("SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, o_custkey FROM orders")
def with_column(t):
    f = t("orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return f.with_column("o_totalprice", f["o_totalprice"].mul(2))


@_query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(t):
    f = t("orders")
    return f.filter(f["o_orderstatus"].eq("F"))


@_query("SELECT event_id FROM events WHERE length(event_type) = 4")
def filter_func(t):
    f = t("events")
    return f.filter_func(f["event_type"], lambda v: len(v) == 4).select("event_id")


@_query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount < l_tax")
def compare_rows(t):
    f = t("lineitem")
    return f.filter(f["l_discount"].lt(f["l_tax"])).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


for _name, _op in (("eq", "="), ("ne", "<>"), ("le", "<="), ("gt", ">"), ("ge", ">=")):

    def _rows(t, name=_name):
        f = t("lineitem")
        return f.filter(getattr(f["l_discount"], name)(f["l_tax"])).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")

    _rows.__name__ = f"compare_rows_{_name}"
    _query(f"SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount {_op} l_tax")(_rows)

for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):

    def _compared(t, name=_name):
        f = _nulled(t)
        return f.filter(getattr(f["v"], name)("purchase")).select("event_id", "v")

    _compared.__name__ = f"compare_value_{_name}"
    _query(f"SELECT event_id, v FROM ({_NULLED}) WHERE v {_op} 'purchase'")(_compared)


@_query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def between(t):
    f = t("lineitem")
    return f.filter(f["l_quantity"].between(10.0, 20.0)).select("l_orderkey", "l_quantity")


@_query("SELECT event_id FROM events WHERE event_type IN ('view', 'error')")
def in_list(t):
    f = t("events")
    return f.filter(f["event_type"].isin(["view", "error"])).select("event_id")


@_query("SELECT event_id FROM events WHERE upper(event_type) IN ('VIEW', 'ERROR')")
def in_using(t):
    f = t("events")
    return f.filter(f["event_type"].isin_using(F.lower, ["VIEW", "Error"])).select("event_id")


@_query(f"SELECT event_id FROM ({_NULLED}) WHERE v IS NULL")
def is_null(t):
    f = _nulled(t)
    return f.filter(f["v"].is_null()).select("event_id")


@_query(f"SELECT event_id FROM ({_NULLED}) WHERE v IS NOT NULL")
def is_not_null(t):
    f = _nulled(t)
    return f.filter(f["v"].is_not_null()).select("event_id")


@_query("SELECT count_if(isnan(value))::BIGINT AS n FROM events")
def is_nan(t):
    f = t("events")
    return f.aggregate(n=f["value"].is_nan().count())


@_query(f"SELECT event_id FROM ({_NULLED}) WHERE coalesce(x > 10, false)")
def as_mask(t):
    f = _nulled(t)
    return f.filter(f.series(F.col("x") > 10).as_mask()).select("event_id")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity > 30) OR l_discount = 0.05")
def mask_logic(t):
    f = t("lineitem")
    return f.filter((f["l_returnflag"].eq("R") & f["l_quantity"].gt(30)) | f["l_discount"].eq(0.05)).select("l_orderkey", "l_linenumber")


@_query(f"SELECT event_id FROM ({_NULLED}) WHERE NOT coalesce(v = 'view', false)")
def mask_not_null(t):
    f = _nulled(t)
    return f.filter(~f["v"].eq("view")).select("event_id")


@_query("SELECT count_if(l_quantity > 25)::BIGINT AS n, bool_or(l_quantity > 49) AS any_, bool_and(l_quantity > 0) AS all_ FROM lineitem")
def mask_count(t):
    f = t("lineitem")
    q = f["l_quantity"]
    return f.aggregate(n=q.gt(25).count(), any_=q.gt(49).any(), all_=q.gt(0).all())


@_query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 20")
def head(t):
    return t("events").select("event_id", "value").head(20)


@_query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 20")
def tail(t):
    return t("events").select("event_id", "value").tail(20)


@_query("SELECT event_id FROM events ORDER BY event_id LIMIT 50 OFFSET 100")
def slice(t):  # noqa: A001
    return t("events").select("event_id").slice(100, 150)


@_query("WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT event_id, value FROM (VALUES (5), (1), (5)) w(i) JOIN e USING (i)")
def take(t):
    return t("events").select("event_id", "value").take([5, 1, 5])


@_query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_no FROM events")
def row_numbers(t):
    return t("events").select("event_id").numbered().df.withColumnRenamed("__row", "row_no")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def top_k(t):
    f = t("orders").select("o_orderkey", "o_totalprice")
    return f.top(25, desc(f["o_totalprice"]))


def _placed(f: Frame, *keys) -> DataFrame:
    """All rows with their place after a sort."""
    return Frame(f.sorted_by(*keys)).numbered().df.withColumnRenamed("__row", "pos")


@_query("SELECT event_id, row_number() OVER (ORDER BY event_type ASC NULLS LAST, value DESC NULLS LAST, event_id) - 1 AS pos FROM events")
def sort_multi(t):
    f = t("events")
    return _placed(f, asc(f["event_type"]), desc(f["value"])).select("event_id", "pos")


@_query(f"SELECT event_id, v, row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) - 1 AS pos FROM ({_NULLED})")
def sort_desc(t):
    f = _nulled(t)
    return _placed(f, desc(f["v"])).select("event_id", "v", "pos")


@_query(f"SELECT event_id, v, row_number() OVER (ORDER BY v DESC NULLS FIRST, event_id) - 1 AS pos FROM ({_NULLED})")
def sort_nulls_first(t):
    f = _nulled(t)
    return _placed(f, desc(f["v"]).nulls_first()).select("event_id", "v", "pos")


@_query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(t):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@_query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def distinct_by(t):
    f = t("events").select("user_id", "event_id", "event_type")
    return f.distinct_by(f["user_id"])


@_query("SELECT min(p_partkey) AS p_partkey FROM part GROUP BY lower(split_part(p_type, ' ', 1))")
def distinct_by_using(t):
    f = t("part")
    return f.distinct_by_using(f["p_type"], lambda c: F.lower(F.split_part(c, F.lit(" "), F.lit(1)))).select("p_partkey")


@_query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def concat(t):
    a = t("nation").select("n_nationkey", "n_name").rename("n_nationkey", "key").rename("n_name", "name")
    return a.concat(t("region").select("r_regionkey", "r_name").rename("r_regionkey", "key").rename("r_name", "name"))


@_query("SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(t):
    a, b = t("orders"), t("customer")
    return a.inner_join(b, on(a["o_custkey"], b["c_custkey"])).select("o_orderkey", "c_custkey", "c_mktsegment")


@_query("SELECT o_orderkey, o_custkey AS custkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def join_using_columns(t):
    return t("orders").inner_join(t("customer"), using_columns("custkey", "o_custkey", "c_custkey")).select("o_orderkey", "custkey", "c_acctbal")


@_query("SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id")
def left_join(t):
    return t("documents").select("doc_id", "lang").left_join(t("labels"), using("doc_id"))


def _sides(t):
    a, b = t("labels"), t("documents")
    return a.filter(a["toxic"].eq(1)).select("doc_id", "quality"), b.filter(b["lang"].eq("en")).select("doc_id", "lang")


@_query("SELECT b.doc_id, quality, lang FROM (SELECT * FROM labels WHERE toxic = 1) a RIGHT JOIN (SELECT * FROM documents WHERE lang = 'en') b ON a.doc_id = b.doc_id")
def right_join(t):
    a, b = _sides(t)
    return a.right_join(b, using("doc_id"))


@_query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, quality, lang FROM (SELECT * FROM labels WHERE toxic = 1) a FULL JOIN (SELECT * FROM documents WHERE lang = 'en') b ON a.doc_id = b.doc_id")
def full_join(t):
    a, b = _sides(t)
    return a.full_join(b, using("doc_id"))


@_query(f"SELECT event_id, n FROM ({_NULLED}) a JOIN (SELECT v, count(*) AS n FROM ({_NULLED}) GROUP BY 1) b ON a.v = b.v")
def join_null_keys(t):
    f = _nulled(t)
    g = f.group_by(f["v"])
    return f.inner_join(Frame(g.result("v", n=g.sizes()), "v"), using("v")).select("event_id", "n")


@_query("SELECT c_custkey, r_name FROM customer JOIN region ON lower(left(c_mktsegment, 1)) = lower(left(r_name, 1))")
def join_using_canon(t):
    first = lambda c: F.lower(F.substring(c, 1, 1))
    a, b = t("customer"), t("region")
    a, b = a.with_column("k", a["c_mktsegment"]), b.with_column("k", b["r_name"])
    return a.inner_join(b, using_by("k", first)).select("c_custkey", "r_name")


@_query("SELECT c_mktsegment AS name, c_custkey, r_regionkey FROM customer JOIN region ON upper(left(c_mktsegment, 1)) = upper(left(r_name, 1))")
def join_using_columns_canon(t):
    first = lambda c: F.lower(F.substring(c, 1, 1))
    return t("customer").inner_join(t("region"), using_columns_by("name", "c_mktsegment", "r_name", first)).select("name", "c_custkey", "r_regionkey")


@_query("SELECT c_custkey, r_regionkey FROM customer JOIN region ON lower(left(c_mktsegment, 1)) = lower(left(r_name, 1))")
def join_on_canon(t):
    first = lambda c: F.lower(F.substring(c, 1, 1))
    a, b = t("customer"), t("region")
    return a.inner_join(b, on_by(a["c_mktsegment"], b["r_name"], first)).select("c_custkey", "r_regionkey")


@_query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def semi_join(t):
    a, b = t("orders"), t("lineitem")
    return a.semi_join(b, on(a["o_orderkey"], b["l_orderkey"])).select("o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(t):
    a, b = t("orders"), t("lineitem")
    return a.anti_join(b, on(a["o_orderkey"], b["l_orderkey"])).select("o_orderkey")


@_query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross_join(t):
    return t("nation").select("n_name").cross_join(t("region").select("r_name"))


@_query("SELECT l_returnflag || l_linestatus AS flags, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY 1")
def group_sum(t):
    f = t("lineitem")
    return f.group_by(f.series(F.concat("l_returnflag", "l_linestatus"))).result("flags", s=F.round(f["l_quantity"].sum(), 2))


@_query("SELECT l_returnflag, CAST(sum(l_linenumber) AS INTEGER) AS s FROM lineitem GROUP BY 1")
def group_sum_int(t):
    f = t("lineitem")
    return f.group_by(f["l_returnflag"]).result("l_returnflag", s=f["l_linenumber"].sum())


@_query(f"SELECT v, count(*) AS n FROM ({_NULLED}) GROUP BY 1")
def group_null_key(t):
    f = _nulled(t)
    g = f.group_by(f["v"])
    return g.result("v", n=g.sizes())


@_query("SELECT event_type, min(event_id) AS first_id FROM events GROUP BY 1")
def group_keys(t):
    f = t("events")
    return f.group_by(f["event_type"]).in_first_seen_order("event_type", first_id=F.min("event_id"))


@_query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS m, min(value) AS mn, max(value) AS mx FROM events GROUP BY 1")
def group_result(t):
    f = t("events")
    g = f.group_by(f["event_type"])
    return g.result("event_type", n=g.sizes(), m=F.round(f["value"].mean(), 6), mn=f["value"].min(), mx=f["value"].max())


@_query("SELECT event_type, round(avg(value), 6) AS m FROM events GROUP BY 1")
def group_mean(t):
    f = t("events")
    return f.group_by(f["event_type"]).result("event_type", m=F.round(f["value"].mean(), 6))


@_query("SELECT user_id, min(value) AS mn, max(value) AS mx FROM events GROUP BY 1")
def group_min_max(t):
    f = t("events")
    return f.group_by(f["user_id"]).result("user_id", mn=f["value"].min(), mx=f["value"].max())


@_query(f"SELECT user_id, count(x) AS n FROM ({_NULLED}) GROUP BY 1")
def group_count_present(t):
    f = _nulled(t)
    return f.group_by(f["user_id"]).result("user_id", n=f["x"].count())


@_query(f"SELECT user_id, arg_min(x, event_id) FILTER (WHERE x IS NOT NULL) AS f, arg_max(x, event_id) FILTER (WHERE x IS NOT NULL) AS z FROM ({_NULLED}) GROUP BY 1")
def group_first_last(t):
    f = _nulled(t)
    return f.group_by(f["user_id"]).result("user_id", f=f["x"].first_present(), z=f["x"].last_present())


@_query(f"SELECT count(*) AS n FROM (SELECT DISTINCT v FROM ({_NULLED}))")
def group_count(t):
    f = _nulled(t)
    return f.group_by(f["v"]).count()


@_query("SELECT arg_min(lang, doc_id) AS lang, count(*) AS n FROM documents GROUP BY upper(lang)")
def group_by_using(t):
    f = t("documents")
    g = f.group_by_using(f["lang"], F.upper)
    return g.result("lang", n=g.sizes())


@_query("SELECT user_id, round(max(value) - min(value), 6) AS r FROM events GROUP BY 1")
def group_map_range(t):
    f = t("events")
    g = f.group_by(f["user_id"])
    return g.result("user_id", r=g.map(f["value"], lambda v: round(max(v) - min(v), 6), T.DoubleType()))


@_query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def group_frames(t):
    f = t("events")
    pick = lambda p: p.sort_values(["value", "event_id"], ascending=[False, True]).head(1)[["user_id", "event_id"]]
    return f.group_by(f["user_id"]).groups(pick, "user_id long, event_id long")


@_query(f"SELECT round(sum(x), 2) AS s, round(avg(x), 6) AS m, min(x) AS mn, max(x) AS mx, count_if(x IS NULL)::BIGINT AS nulls FROM ({_NULLED})")
def agg_basic(t):
    f = _nulled(t)
    x = f["x"]
    return f.aggregate(s=F.round(x.sum(), 2), m=F.round(x.mean(), 6), mn=x.min(), mx=x.max(), nulls=x.null_count())


@_query(f"SELECT arg_min(x, event_id) FILTER (WHERE x IS NOT NULL) AS f, arg_max(x, event_id) FILTER (WHERE x IS NOT NULL) AS z FROM ({_NULLED})")
def agg_first_last(t):
    f = _nulled(t)
    return f.aggregate(f=f["x"].first_present(), z=f["x"].last_present())


@_query("SELECT (SELECT event_id FROM events ORDER BY value, event_id LIMIT 1) AS i, (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 1) AS j")
def arg_min_max(t):
    f = t("events")
    return f.aggregate(i=f["value"].arg_min(F.col("event_id")), j=f["value"].arg_max(F.col("event_id")))


@_query("SELECT round(var_samp(l_quantity), 6) AS v, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem")
def variance(t):
    f = t("lineitem")
    return f.aggregate(v=F.round(f["l_quantity"].variance(), 6), sd=F.round(f["l_quantity"].stddev(), 6))


@_query("SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90, median(l_quantity) AS med FROM lineitem")
def quantile(t):
    f = t("lineitem")
    p = f["l_extendedprice"]
    out = f.quantiles(q25=(p, 0.25), q90=(p, 0.9), med=(f["l_quantity"], 0.5))
    return out.select(F.round("q25", 6).alias("q25"), F.round("q90", 6).alias("q90"), "med")


@_query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, median(l_quantity) AS med FROM lineitem GROUP BY 1")
def group_quantile(t):
    f = t("lineitem")
    return f.group_by(f["l_returnflag"]).result("l_returnflag", q25=F.round(f["l_extendedprice"].quantile(0.25), 6), med=f["l_quantity"].median())


@_query("SELECT l_orderkey, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1")
def reduce_fold(t):
    f = Frame(t("lineitem").df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return f.group_by(f["l_orderkey"]).result("l_orderkey", n=f["l_linenumber"].reduce(0, lambda a, x: a + x).cast("long"))


@_query(f"SELECT event_id, CASE WHEN x IS NOT NULL THEN round(sum(x) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) END AS cs FROM ({_NULLED})")
def cumsum(t):
    f = _nulled(t)
    return f.with_column("cs", f.series(F.round(f["x"].cum_sum(["user_id"]).expr, 4))).select("event_id", "cs")


@_query(f"SELECT event_id, CASE WHEN x IS NOT NULL THEN max(x) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END AS mx FROM ({_NULLED})")
def scan_running_max(t):
    f = _nulled(t)
    return f.with_column("mx", f["x"].scan(F.max, ["user_id"])).select("event_id", "mx")


@_query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN sum(CASE WHEN v IS NOT NULL THEN user_id END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) END::BIGINT AS cs FROM ({_NULLED})")
def cumsum_all(t):
    f = _nulled(t)
    users = f.series(F.when(F.col("v").isNotNull(), F.col("user_id")))
    return f.with_column("cs", users.cum_sum()).select("event_id", "cs")


@_query("SELECT event_id, max(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mx FROM events")
def scan_all(t):
    f = t("events")
    return f.with_column("mx", f["value"].scan(F.max, merge=F.greatest)).select("event_id", "mx")


@_query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def first_rows_unordered(t):
    """A frame without an order: the rows as stored decide, here by event_id."""
    f = Frame(t("events").df.coalesce(1).sortWithinPartitions("event_id"))
    return f.select("user_id", "event_id").distinct_by(f["user_id"])


@_query(f"SELECT user_id, arg_min(x, event_id) FILTER (WHERE x IS NOT NULL) AS f, arg_max(x, event_id) FILTER (WHERE x IS NOT NULL) AS z FROM ({_NULLED}) GROUP BY 1")
def group_first_last_hidden(t):
    """The order column is projected away before, and still orders the rows."""
    f = _nulled(t).select("user_id", "x")
    return f.group_by(f["user_id"]).result("user_id", f=f["x"].first_present(), z=f["x"].last_present())


@_query("SELECT value FROM events ORDER BY event_id LIMIT 20")
def head_hidden(t):
    return t("events").select("value").head(20)


@_query("SELECT * FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_orderkey LIMIT 10) UNION ALL SELECT * FROM (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 5)")
def concat_order(t):
    """The first 15 rows of ten rows and a whole table behind them."""
    a = t("orders").select("o_orderkey", "o_totalprice").rename("o_orderkey", "k").rename("o_totalprice", "p").head(10)
    return a.concat(t("customer").select("c_custkey", "c_acctbal").rename("c_custkey", "k").rename("c_acctbal", "p")).head(15)


def _value(series) -> DataFrame:
    """The values of a series with their places."""
    return series.to_frame().numbered().df.withColumnRenamed("__row", "pos")


_EVENTS = "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)"


@_query(f"SELECT pos, value FROM (VALUES (0, 7), (1, 2), (2, 7)) w(pos, i) JOIN {_EVENTS} USING (i)")
def series_take(t):
    return _value(t("events")["value"].take([7, 2, 7]))


@_query(f"SELECT pos, value FROM (VALUES (0, 7), (1, NULL), (2, 0)) w(pos, i) LEFT JOIN {_EVENTS} USING (i)")
def series_take_nullable(t):
    return _value(t("events")["value"].take_nullable([7, None, 0]))


@_query(f"SELECT i AS pos, value FROM {_EVENTS} WHERE i < 9")
def series_head(t):
    return _value(t("events")["value"].head(9))


@_query(f"SELECT i - (SELECT count(*) - 9 FROM events) AS pos, value FROM {_EVENTS} WHERE i >= (SELECT count(*) - 9 FROM events)")
def series_tail(t):
    return _value(t("events")["value"].tail(9))


@_query(f"SELECT i - 20 AS pos, value FROM {_EVENTS} WHERE i BETWEEN 20 AND 29")
def series_slice(t):
    return _value(t("events")["value"].slice(20, 30))


@_query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, value FROM events WHERE value > 50")
def series_filter(t):
    f = t("events")
    return _value(f["value"].filter(f["value"].gt(50)))


@_query(f"SELECT row_number() OVER (ORDER BY x NULLS LAST, event_id) - 1 AS pos, x AS value FROM ({_NULLED})")
def series_sorted(t):
    return _value(_nulled(t)["x"].sorted())


@_query(f"SELECT row_number() OVER (ORDER BY x DESC NULLS LAST, event_id) - 1 AS pos, x AS value FROM ({_NULLED})")
def series_sorted_descending(t):
    return _value(_nulled(t)["x"].sorted_descending())


@_query(f"SELECT row_number() OVER (ORDER BY length(v) NULLS LAST, event_id) - 1 AS pos, v AS value FROM ({_NULLED})")
def series_sorted_by(t):
    return _value(_nulled(t)["v"].sorted_by(F.length))


@_query("SELECT row_number() OVER (ORDER BY side, k) - 1 AS pos, name AS value FROM (SELECT 0 AS side, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region)")
def series_concat(t):
    return _value(t("nation")["n_name"].concat(t("region")["r_name"]))


@_query("SELECT true AS same, false AS moved, true AS near")
def series_equal(t):
    f = t("customer")
    a, b = f["c_acctbal"], f.series(F.col("c_acctbal") + 1e-9)
    same, moved, near = a.equal(a), a.equal(b), a.equal_by(b, lambda x, y: F.abs(x - y) < 1e-6)
    return f.base.sparkSession.createDataFrame([(same, moved, near)], "same boolean, moved boolean, near boolean")


@_query("SELECT l_returnflag, sum(l_orderkey)::BIGINT AS n FROM lineitem WHERE l_orderkey < 200 GROUP BY 1")
def reduce_long(t):
    f = Frame(t("lineitem").df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    f = f.filter(f["l_orderkey"].lt(200))
    return f.group_by(f["l_returnflag"]).result("l_returnflag", n=f["l_orderkey"].reduce(0, lambda a, x: a + x))


@_query(f"SELECT i AS row FROM {_EVENTS} WHERE event_type = 'error'")
def mask_rows(t):
    f = t("events")
    return f.mask_rows(f["event_type"].eq("error"))


@_query("SELECT l_orderkey, l_linenumber, l_extendedprice + l_tax AS a, l_extendedprice - l_discount AS s, l_extendedprice * l_discount AS m, l_extendedprice / l_quantity AS unit FROM lineitem")
def arith(t):
    f = t("lineitem")
    p = f["l_extendedprice"]
    for name, s in (("a", p.add(f["l_tax"])), ("s", p.sub(f["l_discount"])), ("m", p.mul(f["l_discount"])), ("unit", p.div(f["l_quantity"]))):
        f = f.with_column(name, s)
    return f.select("l_orderkey", "l_linenumber", "a", "s", "m", "unit")


@_query("SELECT o_orderkey, o_totalprice + 1.5 AS a, o_totalprice - 1.5 AS s, o_totalprice * 1.5 AS m, o_totalprice / 1.5 AS d FROM (SELECT o_orderkey, o_totalprice FROM orders)")
def arith_scalar(t):
    f = t("orders")
    p = f["o_totalprice"]
    for name, s in (("a", p.add(1.5)), ("s", p.sub(1.5)), ("m", p.mul(1.5)), ("d", p.div(1.5))):
        f = f.with_column(name, s)
    return f.select("o_orderkey", "a", "s", "m", "d")


@_query("SELECT l_orderkey, l_linenumber, CAST(-l_orderkey // l_linenumber AS BIGINT) AS q FROM lineitem")
def arith_intdiv(t):
    f = t("lineitem")
    return f.with_column("q", f["l_orderkey"].neg().div(f.series(F.col("l_linenumber").cast("long")))).select("l_orderkey", "l_linenumber", "q")


@_query("SELECT c_custkey, -c_acctbal AS neg, abs(c_acctbal) AS ab FROM customer")
def arith_neg_abs(t):
    f = t("customer")
    return f.with_column("neg", f["c_acctbal"].neg()).with_column("ab", f["c_acctbal"].abs()).select("c_custkey", "neg", "ab")


@_query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS sq, round(ln(p_retailprice), 6) AS ln, round(exp(p_size / 100.0), 6) AS ex, round(pow(p_retailprice, 0.5), 6) AS pw FROM part")
def math(t):
    f = t("part")
    p, size = f["p_retailprice"], f.series(F.col("p_size") / F.lit(100.0))
    for name, s in (("sq", p.sqrt()), ("ln", p.log()), ("ex", size.exp()), ("pw", p.pow(0.5))):
        f = f.with_column(name, f.series(F.round(s.expr, 6)))
    return f.select("p_partkey", "sq", "ln", "ex", "pw")


@_query(f"SELECT event_id, coalesce(v, '?') AS v FROM ({_NULLED})")
def fill_null(t):
    f = _nulled(t)
    return f.with_column("v", f["v"].fill_null("?")).select("event_id", "v")


@_query(f"SELECT v FROM ({_NULLED}) WHERE v IS NOT NULL")
def drop_null(t):
    f = _nulled(t)
    return f.filter(f["v"].is_not_null()).select("v")


@_query(f"SELECT event_id, upper(v) AS m FROM ({_NULLED})")
def map_values(t):
    f = _nulled(t)
    return f.with_column("m", f["v"].map(str.upper, T.StringType())).select("event_id", "m")


@_query(f"SELECT event_id, CASE WHEN v IS NULL THEN 'missing' WHEN v = 'view' THEN NULL ELSE upper(v) END AS m FROM ({_NULLED})")
def map_cells(t):
    f = _nulled(t)
    say = lambda v: "missing" if v is None else None if v == "view" else v.upper()
    return f.with_column("m", f["v"].map_cells(say, T.StringType())).select("event_id", "m")


@_query(f"SELECT event_id, CASE WHEN v <> 'view' THEN length(v) END AS m FROM ({_NULLED})")
def map_optional(t):
    f = _nulled(t)
    return f.with_column("m", f["v"].map_optional(lambda v: None if v == "view" else len(v), T.LongType())).select("event_id", "m")


@_query(f"SELECT event_id, v || '-' || user_id AS m FROM ({_NULLED})")
def map2(t):
    f = _nulled(t)
    return f.with_column("m", f["v"].map2(f["user_id"], lambda v, u: f"{v}-{u}", T.StringType())).select("event_id", "m")


@_query("SELECT event_id, event_type, value FROM events")
def csv_round_trip(t):
    from orrery.plans.ordinal import cut
    from orrery.sources import csv

    f = t("events").select("event_id", "event_type", "value")
    place = csv.scratch(f.df.sparkSession)
    csv.write(f, place)
    return cut(csv.read(f.df.sparkSession, place).df)
