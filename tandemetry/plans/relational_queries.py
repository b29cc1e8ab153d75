"""Queries on joins, sets, groupings and keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import order_statistics as S
from ..operators import relational as R
from .views import intervals, table


def set_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with clicks and purchases: both, either, only one."""
    ev = table(spark, sf_dir, "events")
    a = ev.filter((F.col("event_type") == "click") & (F.col("value") > 90)).select("user_id")
    b = ev.filter((F.col("event_type") == "view") & (F.col("value") > 90)).select("user_id")
    tagged = lambda df, name: df.select(F.lit(name).alias("kind"), "user_id")
    return tagged(a.intersect(b), "both").union(tagged(a.union(b).distinct(), "either")).union(tagged(a.subtract(b), "click_only")).union(tagged(a.exceptAll(b), "click_surplus"))


def lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per nation name through left lookups; what the dimension lacks shows as unknown."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    few = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 != 0).select("c_custkey", "c_nationkey")
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = orders.join(few, F.col("o_custkey") == F.col("c_custkey"), "left").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy(F.coalesce("n_name", F.lit("unknown")).alias("nation")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("o_totalprice")).alias("mean_price"))


def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without an order of over 400 000, by segment."""
    big = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 400000).select("o_custkey")
    cust = table(spark, sf_dir, "customer")
    on = F.col("c_custkey") == F.col("o_custkey")
    count = lambda df, side: df.groupBy(F.lit(side).alias("side"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return count(cust.join(big, on, "left_semi"), "with").union(count(cust.join(big, on, "left_anti"), "without"))


def key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's name as prefix and number; digits by place as well."""
    parts = R.key_parts(F.col("c_name"), r"([A-Za-z]+)#(\d{3})(\d{6})", ["prefix", "block", "number"])
    c = table(spark, sf_dir, "customer").select("c_custkey", parts.alias("k"), F.substring("c_name", 1, 3).alias("head"), F.substring_index("c_name", "#", 1).alias("before"))
    return c.select("c_custkey", "k.prefix", F.col("k.block").cast("int").alias("block"), F.col("k.number").cast("long").alias("number"), "head", "before")


def label_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with their end, numbered within owner and code; the end is taken before the pauses (code P) go away."""
    named = intervals(spark, sf_dir).filter(F.col("code") != "P")
    n = F.row_number().over(Window.partitionBy("owner", "code").orderBy("ord"))
    return named.select("owner", "ord", F.format_string("%s%02d", "code", n).alias("segment"), r6(F.col("end_s") - F.col("start_s")).alias("duration_s"))


LIMITS = (1000.0, 5000.0, 20000.0)


def duration_groupingsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute price mismatch within a year's orders: overall, by priority and by status in one pass."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    d = F.abs(F.col("o_totalprice") - 20 * F.col("c_acctbal"))
    rows = o.select("o_orderpriority", "o_orderstatus", d.alias("d"))
    aggs = [F.count(F.lit(1)).alias("n"), r6(F.avg("d")).alias("mean"), r6(F.stddev_samp("d")).alias("sd")]
    aggs += [r6(100 * F.avg(F.when(F.col("d") > x, 1.0).otherwise(0.0))).alias(f"over_{int(x)}") for x in LIMITS]
    groups = [[], ["o_orderpriority"], ["o_orderstatus"]]
    summary = R.grouping_summary(rows, groups, aggs)
    # the overall group is as large as the table: its order statistics come from ranges, not from one task
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), *((F.col(k) if k in g else F.lit(None).cast("string")).alias(k) for k in ("o_orderpriority", "o_orderstatus"))) for i, g in enumerate(groups))))
    keys = ["g.level", "g.o_orderpriority", "g.o_orderstatus"]
    q = S.quantiles(rows.select(each.alias("g"), "d").select(*keys, "d"), ["level", "o_orderpriority", "o_orderstatus"], "d", {"median": 0.5, "p95": 0.95})
    q = q.select(*(F.col(k).alias(f"_{k}") for k in ("level", "o_orderpriority", "o_orderstatus")), r6("median").alias("median"), r6("p95").alias("p95"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ("level", "o_orderpriority", "o_orderstatus")]
    return summary.join(q, on[0] & on[1] & on[2]).drop("_level", "_o_orderpriority", "_o_orderstatus")


def jitter_topk_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per event type without the largest 1 and 5 per cent of values."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    out = None
    for share in (0.0, 0.01, 0.05):
        kept = R.exclude_top(ev, "event_id", "value", share)
        part = kept.groupBy(F.lit(share).alias("excluded"), "event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.max("value")).alias("most"))
        out = part if out is None else out.unionByName(part)
    return out


def spearman_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of a user's value and hour of day per event type, ties sharing their mean rank."""
    ev = table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("a"), F.hour(F.col("ts").cast("timestamp")).alias("b"))
    ranks = S.ranked(ev, ["event_type"], ["a", "b"])
    return ranks.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("rank_a", "rank_b")).alias("rho"))


def kendall_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b of an order's priority and the floor of its price in thousands, per status."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("a"), F.floor(F.col("o_totalprice") / 1000).alias("b"))
    return S.kendall(o, ["o_orderstatus"], "a", "b").select("o_orderstatus", r6("kendall").alias("kendall"))


def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on one side only, orders against line items."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    side = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full_outer")
    return side.agg(F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"))


SQL = {
    "set_pairing": """WITH a AS (SELECT user_id FROM events WHERE event_type = 'click' AND value > 90), b AS (SELECT user_id FROM events WHERE event_type = 'view' AND value > 90)
 SELECT 'both' AS kind, user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', user_id FROM (SELECT * FROM a UNION SELECT * FROM b)
 UNION ALL SELECT 'click_only', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'click_surplus', user_id FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
    "lookup_left": """SELECT coalesce(n_name, 'unknown') AS nation, count(*)::BIGINT AS n, round(avg(o_totalprice), 6) + 0.0 AS mean_price FROM orders
 LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "semi_anti": """SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'with' ELSE 'without' END AS side, c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY ALL""",
    "key_parse": r"""SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#(\d{3})(\d{6})$', 1) AS prefix, regexp_extract(c_name, '^([A-Za-z]+)#(\d{3})(\d{6})$', 2)::INTEGER AS block,
 regexp_extract(c_name, '^([A-Za-z]+)#(\d{3})(\d{6})$', 3)::BIGINT AS number, substr(c_name, 1, 3) AS head, split_part(c_name, '#', 1) AS before FROM customer""",
    "label_intervals": """WITH o AS (SELECT o_custkey AS owner, o_orderstatus AS code, epoch_us(o_orderdate) / 1e6::DOUBLE AS s, row_number() OVER w AS ord, lead(epoch_us(o_orderdate) / 1e6::DOUBLE) OVER w AS e
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
 SELECT owner, ord, code || lpad((row_number() OVER (PARTITION BY owner, code ORDER BY ord))::VARCHAR, 2, '0') AS segment, round(e - s, 6) + 0.0 AS duration_s FROM o WHERE code <> 'P'""",
    "duration_groupingsets": f"""WITH r AS (SELECT o_orderpriority, o_orderstatus, abs(o_totalprice - 20 * c_acctbal) AS d FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT o_orderpriority, o_orderstatus, (CASE grouping(o_orderpriority, o_orderstatus) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END)::INTEGER AS level, count(*)::BIGINT AS n, round(avg(d), 6) + 0.0 AS mean, round(stddev_samp(d), 6) + 0.0 AS sd,
 round(quantile_cont(d, 0.5), 6) + 0.0 AS median, round(quantile_cont(d, 0.95), 6) + 0.0 AS p95, {", ".join(f"round(100 * avg(CASE WHEN d > {x} THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS over_{int(x)}" for x in LIMITS)}
 FROM r GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderstatus))""",
    "jitter_topk_exclusion": """WITH r AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS place, count(*) OVER () AS n FROM events), s(excluded) AS (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE))
 SELECT excluded, event_type, count(*)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean, round(max(value), 6) + 0.0 AS most FROM r, s WHERE place > ceil(n * excluded) GROUP BY ALL""",
    "spearman_association": """WITH e AS (SELECT event_type, floor(value) AS a, hour(ts) AS b FROM events), r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY a) + (count(*) OVER (PARTITION BY event_type, a) - 1) / 2.0::DOUBLE AS ra,
 rank() OVER (PARTITION BY event_type ORDER BY b) + (count(*) OVER (PARTITION BY event_type, b) - 1) / 2.0::DOUBLE AS rb FROM e) SELECT event_type, count(*)::BIGINT AS n, round(corr(ra, rb), 6) + 0.0 AS rho FROM r GROUP BY 1""",
    "kendall_association": """WITH o AS (SELECT o_orderstatus AS s, substring(o_orderpriority, 1, 1)::INT AS a, floor(o_totalprice / 1000) AS b FROM orders), c AS (SELECT s, a, b, count(*) AS c FROM o GROUP BY ALL),
 p AS (SELECT x.s, sum(sign(x.a - y.a) * sign(x.b - y.b) * x.c * y.c)::DOUBLE / 2 AS d FROM c x JOIN c y ON x.s = y.s GROUP BY 1), n AS (SELECT s, sum(c)::DOUBLE AS n FROM c GROUP BY 1),
 ta AS (SELECT s, sum(k::DOUBLE * (k - 1) / 2) AS t FROM (SELECT s, a, sum(c) AS k FROM c GROUP BY ALL) GROUP BY 1), tb AS (SELECT s, sum(k::DOUBLE * (k - 1) / 2) AS t FROM (SELECT s, b, sum(c) AS k FROM c GROUP BY ALL) GROUP BY 1)
 SELECT s AS o_orderstatus, round(d / sqrt(n * (n - 1) / 2 - ta.t) / sqrt(n * (n - 1) / 2 - tb.t), 6) + 0.0 AS kendall FROM p JOIN n USING (s) JOIN ta USING (s) JOIN tb USING (s)""",
    "alignment_check": """WITH b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT count(*) FILTER (b.k IS NULL)::BIGINT AS left_only, count(*) FILTER (o_orderkey IS NULL)::BIGINT AS right_only,
 count(*) FILTER (b.k IS NOT NULL AND o_orderkey IS NOT NULL)::BIGINT AS matched FROM orders FULL JOIN b ON o_orderkey = b.k""",
}
QUERIES = {f.__name__: f for f in (set_pairing, lookup_left, semi_anti, key_parse, label_intervals, duration_groupingsets, jitter_topk_exclusion, spearman_association, kendall_association, alignment_check)}
