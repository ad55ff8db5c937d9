"""Relational queries over the star schema, as Spark SQL through the read-only gate, and the gate itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import joins as J
from millrace.operators import sketches as K
from millrace.operators import sqlgate as G
from millrace.operators import table_functions as TF
from millrace.plans.chunk_queries import CHUNKS_SQL
from millrace.sources import shared
from millrace.sources import tables as S

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
AMOUNT = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))"

#: Statements that Spark and DuckDB both take as they stand.
STATEMENTS = {
    # who bought most, for how much, and which of their items was worth most
    "sql_top_buyer": f"""WITH spent AS (SELECT o_custkey, SUM({AMOUNT}) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey),
        top AS (SELECT o_custkey, total FROM spent ORDER BY total DESC, o_custkey LIMIT 1),
        items AS (SELECT t.o_custkey, t.total, l_partkey, SUM({AMOUNT}) AS item_total FROM top t JOIN orders o ON o.o_custkey = t.o_custkey JOIN lineitem ON o.o_orderkey = l_orderkey GROUP BY t.o_custkey, t.total, l_partkey)
        SELECT c_custkey, c_name, CAST(i.total AS DOUBLE) AS total, p_partkey, p_name, CAST(item_total AS DOUBLE) AS item_total
        FROM items i JOIN customer ON c_custkey = i.o_custkey JOIN part ON p_partkey = i.l_partkey ORDER BY item_total DESC, p_partkey LIMIT 1""",
    "sql_join_inner": "SELECT n_name, r_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name",
    "sql_join_left": "SELECT c_custkey, COUNT(o_orderkey) AS n, COALESCE(MAX(o_orderpriority), 'none') AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_join_semi": "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
    "sql_join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_join_full": "SELECT c.k AS c_key, s.k AS s_key FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) c FULL OUTER JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c.k = s.k",
    "sql_join_theta": "SELECT r_name, CAST(b.lo AS DOUBLE) AS lo, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (SELECT -1000.0 AS lo, 2000.0 AS hi UNION ALL SELECT 2000.0, 6000.0 UNION ALL SELECT 6000.0, 100000.0) b ON c_acctbal >= b.lo AND c_acctbal < b.hi GROUP BY r_name, b.lo",
    "sql_agg": f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity, CAST(SUM({AMOUNT}) AS DOUBLE) AS amount, MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "sql_distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "sql_count_distinct": "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
    "sql_rollup": "SELECT r_name, n_name, COUNT(*) AS n, CAST(GROUPING(r_name) AS BIGINT) AS gr, CAST(GROUPING(n_name) AS BIGINT) AS gn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "sql_cube": "SELECT p_brand, p_size, COUNT(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_window_rank": "SELECT p_brand, p_partkey, CAST(rk AS BIGINT) AS rk, CAST(dr AS BIGINT) AS dr FROM (SELECT p_brand, p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS rk, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part) t WHERE rk <= 5",
    "sql_window_frame": "SELECT o_custkey, o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving FROM orders",
    "sql_window_lag": "SELECT o_custkey, o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders",
    "sql_ntile": "SELECT c_custkey, CAST(NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quarter FROM customer",
    "sql_union": "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sql_limit_offset": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20",
    "sql_subquery": "SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT 1.2 * AVG(d.c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)",
    "sql_in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "sql_case": "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class, COUNT(*) AS n, COUNT(CASE WHEN p_retailprice > 1000 THEN 1 END) AS dear FROM part GROUP BY 1",
    "sql_cte": "WITH a AS (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey), b AS (SELECT MAX(n) AS m FROM a) SELECT l_suppkey, n FROM a JOIN b ON n = m",
    "sql_strings": "SELECT c_custkey, UPPER(c_mktsegment) AS up, CAST(LENGTH(c_name) AS BIGINT) AS len, SUBSTRING(c_name, 1, 4) AS head, REPLACE(c_name, '#', '-') AS dashed, TRIM(CONCAT('  ', c_mktsegment, ' ')) AS trimmed FROM customer",
    "sql_dates": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS INT) AS d FROM orders",
    "sql_join_range": "SELECT a.event_id, COUNT(b.event_id) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL '1' HOUR WHERE a.event_type = 'purchase' GROUP BY a.event_id",
}


def _runner(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        G.register(spark, sf_dir, TABLES)
        return G.run_query(spark, STATEMENTS[name])

    return run


def sql_join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's latest click before or at its time: one ordered pass by user, no range join."""
    from pyspark.sql import Window

    events = S.table(spark, sf_dir, "events")
    past = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    click = F.max(F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))).over(past)
    return events.withColumn("c", click).where("event_type = 'purchase'").select("event_id", F.col("c.event_id").alias("click_id"))


def sql_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the distinct users: one over all rows beside an exact count would be kept for every type and user."""
    users = S.table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    ratio = F.try_divide(F.approx_count_distinct("user_id", 0.02), F.count("user_id"))
    # without any user both are 0
    return users.groupBy("event_type").agg(F.coalesce(F.abs(ratio - 1) < 0.1, F.lit(True)).alias("near"))


def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sql_join_range by running counts in ranges of users and time: no pair is made."""
    events = S.table(spark, sf_dir, "events")
    starts = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", (F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("stop"))
    return J.counts_in_intervals(starts, events.select("user_id", "ts"), "ts", "stop", "ts", ["event_id"], keys=("user_id",))


def join_interval_keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all users in the ten minutes after every error, without any equality."""
    events = S.table(spark, sf_dir, "events")
    starts = events.where("event_type = 'error'").select("event_id", "ts", (F.col("ts") + F.expr("INTERVAL '10' MINUTE")).alias("stop"))
    return J.counts_in_intervals(starts, events.select("ts", "event_type"), "ts", "stop", "ts", ["event_id"], by=("event_type",))


def join_asof_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sql_join_asof over ranges of user and time, however many rows a user has."""
    events = S.table(spark, sf_dir, "events")
    made = J.latest_before(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), events.where("event_type = 'click'"), "user_id", "ts", "event_id")
    return made.select("event_id", F.col("latest.tie").alias("click_id"))


def join_asof_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all users together: one key holds every row."""
    events = S.table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    made = J.latest_before(events.where("event_type = 'purchase'").select("event_id", "one", "ts"), events.where("event_type = 'click'"), "one", "ts", "event_id")
    return made.select("event_id", F.col("latest.tie").alias("click_id"))


def sketch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every day's events merged by type: the exact counts of users and the median, and whether they lie within
    the sketches' bounds."""
    events = S.table(spark, sf_dir, "events")
    days = events.withColumn("day", F.to_date("ts"))
    files = shared.saved(K.of_files(days, ["event_type", "day"], F.col("user_id"), F.col("value")), "sketches")
    whole = K.merged(files, ["event_type"])
    low, high = K.distinct_bounds(F.col("distinct_sketch"))
    least, most = K.quantile_bounds(F.col("value_sketch"), 0.5)
    bounds = whole.select("event_type", "rows", low.alias("low"), high.alias("high"), least.alias("least"), most.alias("most"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.percentile("value", 0.5).alias("median"))
    return exact.join(bounds, "event_type").select("event_type", "rows", "users", F.round("median", 6).alias("median"), F.col("users").between(F.col("low"), F.col("high")).alias("users_within"), F.col("median").between(F.col("least"), F.col("most")).alias("median_within"))


def sql_split_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fixed_window_chunks as a statement that calls a table function, through the gate."""
    G.register(spark, sf_dir, ("documents",))
    return G.run_query(spark, "SELECT doc_id AS file_id, chunk_index, content FROM documents, LATERAL split_fixed(text)", TF.register(spark))


#: What stands before and after a turn's text to make statements of all kinds.
FRAMES = [("", ""), ("select ", ""), ("  with a as (select 1) ", ";;"), ("select '", "'; select 2"), ("Select 'drop", " '"), ("explain ", "")]


def sql_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on statements made of every turn's text."""
    turns = S.table(spark, sf_dir, "conversations")
    frame = F.get(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in FRAMES]), ((F.col("conv_id") + F.col("turn")) % len(FRAMES)).cast("int"))
    made = turns.select("conv_id", "turn", G.verdict(F.concat(frame["a"], F.coalesce("text", F.lit("")), frame["b"])).alias("verdict"))
    return made.select("conv_id", "turn", F.coalesce("verdict", F.lit("ok")).alias("verdict"))


def sql_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    G.register(spark, sf_dir, TABLES)
    rows = [(t, c["cid"], c["name"]) for t, columns in G.describe(spark, "region, nation ,customer").items() for c in columns]
    return spark.createDataFrame(rows, "table_name string, cid int, name string")


QUERIES = {**{name: _runner(name) for name in STATEMENTS}, "sql_join_asof": sql_join_asof, "sql_approx_distinct": sql_approx_distinct, "sql_gate": sql_gate, "sql_describe": sql_describe,
           **{f.__name__: f for f in (join_interval, join_interval_keyless, join_asof_ranges, join_asof_one_key, sketch_bounds, sql_split_fixed)}}
_FRAMED = " ".join(f"WHEN {i} THEN '{a.replace(chr(39), chr(39) * 2)}' || coalesce(text, '') || '{b.replace(chr(39), chr(39) * 2)}'" for i, (a, b) in enumerate(FRAMES))
_BANNED = " OR ".join(f"contains(l, '{b}')" for b in G.BANNED)
ORACLES = {
    **STATEMENTS,
    "sql_join_asof": """SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        LEFT JOIN LATERAL (SELECT event_id FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) c ON true""",
    "join_interval": STATEMENTS["sql_join_range"],
    "join_interval_keyless": "SELECT a.event_id, b.event_type, COUNT(*) AS n FROM events a JOIN events b ON b.ts >= a.ts AND b.ts < a.ts + INTERVAL 10 MINUTE WHERE a.event_type = 'error' GROUP BY ALL",
    "join_asof_one_key": """SELECT event_id, (SELECT c.event_id FROM events c WHERE c.event_type = 'click' AND (c.ts, c.event_id) = last) AS click_id FROM (SELECT event_id, event_type,
        max(CASE WHEN event_type = 'click' THEN (ts, event_id) END) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM events) WHERE event_type = 'purchase'""",
    "sketch_bounds": "SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS median, true AS users_within, true AS median_within FROM events GROUP BY event_type",
    "sql_split_fixed": f"WITH {CHUNKS_SQL} SELECT file_id, chunk_index, content FROM chunks",
    "sql_approx_distinct": "SELECT DISTINCT event_type, true AS near FROM events",
    "sql_gate": f"""WITH g AS (SELECT conv_id, turn, CASE (conv_id + turn) % {len(FRAMES)} {_FRAMED} END AS query FROM conversations),
        q AS (SELECT conv_id, turn, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS q, lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g')) AS l FROM g)
        SELECT conv_id, turn, CASE WHEN q = '' THEN '{G.EMPTY}' WHEN {_BANNED} THEN '{G.WRITES}' WHEN contains(rtrim(q, ';'), ';') THEN '{G.SEVERAL}'
        WHEN NOT (starts_with(l, 'select') OR starts_with(l, 'with')) THEN '{G.NO_READ}' ELSE 'ok' END AS verdict FROM q""",
    "sql_describe": "SELECT table_name, (column_index - 1)::INT AS cid, column_name AS name FROM duckdb_columns() WHERE table_name IN ('region', 'nation', 'customer')",
}
ORACLES["join_asof_ranges"] = ORACLES["sql_join_asof"]
