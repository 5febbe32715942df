"""Lookups, chains, nearest neighbours and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.registry import Tables, query
from paperloom.sources.tables import written


#: Seconds of a bucket of spans: about as long as they are.
SPAN_BUCKET = 30 * 86400


@query("SELECT o_orderkey, o_custkey, c_name, c_name IS NULL AS broken FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def style_join(t: Tables) -> DataFrame:
    """A reference with the name it resolves to; a miss is kept and marked."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_name", F.col("c_name").isNull().alias("broken"))


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, l.doc_id IS NOT NULL AS overridden FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def override_join(t: Tables) -> DataFrame:
    """An override wins over the default."""
    labels = t.labels.select(F.col("doc_id").alias("k"), "quality")
    return t.documents.join(labels, F.col("doc_id") == F.col("k"), "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.col("k").isNotNull().alias("overridden"))


@query("SELECT n_nationkey, n_name, r_name AS base, CAST(1 AS BIGINT) AS steps FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, n_name, 'world', CAST(2 AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey")
def style_chain(t: Tables) -> DataFrame:
    """Each ancestor of a style along its based-on chain: nation, region, world; a cycle ends where it meets itself."""
    edges = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    edges = edges.unionByName(t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("world").alias("parent")))
    chain = ancestors(edges)
    names = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("ancestor"), F.col("r_name").alias("name"))
    named = chain.join(names, "ancestor", "left").withColumn("base", F.coalesce("name", "ancestor"))
    return t.nation.join(named, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")) == F.col("node")).select("n_nationkey", "n_name", "base", "steps")


def ancestors(edges: DataFrame) -> DataFrame:
    """``node, ancestor, steps`` along ``child, parent`` edges, however long the chain; a node that would come again ends it.

    Chains grow by doubling: those of up to ``m`` steps, joined with themselves where they are
    full, give those of up to ``2 m``, so a chain of a thousand takes ten rounds and each is one
    table.  Of several parents the least counts.  In a circle a node meets the same ancestors again
    after each turn, and the least number of steps counts, so chains end where they close.
    """
    step = edges.where("child <> parent").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("ancestor")).withColumn("steps", F.lit(1).cast("long"))
    now, reach = written(step, "chains"), 1
    while True:
        onward = now.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__far"), F.col("steps").alias("__more"))
        longer = now.where(F.col("steps") == reach).join(onward, "ancestor").where("node <> __far").select("node", F.col("__far").alias("ancestor"), (F.col("steps") + F.col("__more")).alias("steps"))
        both = written(now.unionByName(longer).groupBy("node", "ancestor").agg(F.min("steps").alias("steps")), "chains")
        reach *= 2
        if both.where(F.col("steps") == reach).isEmpty():
            return both
        now = both


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def rel_inner(t: Tables) -> DataFrame:
    """Reference to relationship to part; misses drop out."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def dangling(t: Tables) -> DataFrame:
    """Targets that nothing refers to."""
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def referenced(t: Tables) -> DataFrame:
    """Targets that something refers to."""
    return t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id")


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
n AS (SELECT *, max(p) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(p) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT user_id, event_id, CAST(CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN p - b <= a - p THEN b ELSE a END AS BIGINT) AS nearest FROM n WHERE event_type = 'error'""")
def nearest(t: Tables) -> DataFrame:
    """The nearest target beside each change, by distance among siblings; the one before wins a tie."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = t.events.select("user_id", "ts", "event_id", "event_type", F.row_number().over(w).cast("long").alias("p"))
    target = F.when(F.col("event_type") == "view", F.col("p"))
    rows = p.withColumns({"b": F.max(target).over(w.rowsBetween(Window.unboundedPreceding, -1)), "a": F.min(target).over(w.rowsBetween(1, Window.unboundedFollowing))})
    best = F.when(F.col("b").isNull() | (F.col("a") - F.col("p") < F.col("p") - F.col("b")), F.col("a")).otherwise(F.col("b"))
    return rows.where("event_type = 'error'").select("user_id", "event_id", best.alias("nearest"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, o_orderdate + to_days(CAST(10 + o_orderkey % 30 AS INTEGER)) AS z FROM orders)
SELECT x.o_custkey, x.o_orderkey AS one, y.o_orderkey AS other FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a < y.z AND y.a < x.z""")
def span_overlap(t: Tables) -> DataFrame:
    """Pairs of spans of one owner that overlap; half-open, so touching is none.

    Spans meet in buckets of time of their owner, and a pair counts in the bucket where the later
    one begins, so an owner with many spans is as many keys as its time has buckets.
    """
    s = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("a"), F.expr("o_orderdate + make_dt_interval(cast(10 + o_orderkey % 30 as int))").alias("z"))
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / SPAN_BUCKET)
    x = s.withColumn("bucket", F.explode(F.sequence(bucket(F.col("a")), bucket(F.col("z"))))).alias("x")
    y = s.withColumn("bucket", F.explode(F.sequence(bucket(F.col("a")), bucket(F.col("z"))))).alias("y")
    on = (F.col("x.o_custkey") == F.col("y.o_custkey")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.o_orderkey") < F.col("y.o_orderkey")) & (F.col("x.a") < F.col("y.z")) & (F.col("y.a") < F.col("x.z"))
    first = bucket(F.greatest("x.a", "y.a")) == F.col("x.bucket")
    return x.join(y, on).where(first).select(F.col("x.o_custkey"), F.col("x.o_orderkey").alias("one"), F.col("y.o_orderkey").alias("other"))


@query("WITH r AS (SELECT user_id, min(event_id) AS report FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT e.event_id, r.report FROM events e LEFT JOIN r ON e.user_id = r.user_id WHERE e.event_type = 'error'")
def op_annotate(t: Tables) -> DataFrame:
    """Each change with the first report of a successful operation on its target."""
    reports = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("report"))
    return t.events.where("event_type = 'error'").join(reports, "user_id", "left").select("event_id", "report")


@query("SELECT c_custkey, coalesce(n, 0) AS n, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = k")
def annotations(t: Tables) -> DataFrame:
    """Each target with its annotations, a row for each (one with null for none) and their number; a target with very many is no longer row than others."""
    counts = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    both = t.customer.join(counts, F.col("c_custkey") == F.col("k"), "left").join(t.orders.select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "o_orderkey")


@query("SELECT DISTINCT l_partkey AS key FROM lineitem")
def distinct_keys(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("key")).distinct()


@query("SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def except_keys(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("key")).subtract(t.lineitem.where("l_returnflag = 'R' and l_quantity > 45").select("l_partkey"))


@query("SELECT l_partkey AS key FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def except_all(t: Tables) -> DataFrame:
    """New violations beyond the baseline's, as multisets."""
    keys = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("key"))
    return keys("A").exceptAll(keys("R"))
