"""Registered queries with the SQL that gives the same rows.

A query reads the whole tables of a directory. Versions, logs and replicas that the
operators need are derived from the tables by plain expressions, the same ones in the SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemirror.functions import clean, logs, serve
from tablemirror.operators import analytics as A
from tablemirror.operators import current as C
from tablemirror.operators import reconcile as R
from tablemirror.operators import range_tree
from tablemirror.operators import store as S
from tablemirror.session import shared_dir
from tablemirror.sources import scans
from tablemirror.streaming import changes, quota

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: The tables' columns, so that a query need not open files before it is planned.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return scans.snapshot_scan(spark, f"{d}/{name}.parquet", schema=SCHEMAS.get(name))


# derived tables and their SQL

REPLICA_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus,
        CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
        o_orderdate, o_orderpriority
    FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
    UNION ALL
    SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH')"""


def replica(spark: SparkSession, d: str) -> DataFrame:
    """A copy of orders that lacks some, has some more, and has old prices for others."""
    o = table(spark, d, "orders")
    stale = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    kept = o.where(~((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")))
    kept = kept.withColumn("o_totalprice", F.when(stale, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    more = o.where("o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return kept.unionByName(more)


CHANGES_SQL = """(SELECT o_orderkey, o_totalprice, 'i' AS _op, o_orderkey * 10 AS _seq FROM orders
    UNION ALL SELECT o_orderkey, o_totalprice + 5, 'u', o_orderkey * 10 + 1 FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, NULL, 'd', o_orderkey * 10 + 2 FROM orders WHERE o_orderpriority = '5-LOW'
    UNION ALL SELECT o_orderkey, o_totalprice + 9, 'i', o_orderkey * 10 + 3 FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F')"""


def change_log(spark: SparkSession, d: str) -> DataFrame:
    """A change feed over orders: inserts, updates, deletes and rows that come back."""
    o, price, key = table(spark, d, "orders"), F.col("o_totalprice"), F.col("o_orderkey")

    def part(rows: DataFrame, amount, op: str, n: int) -> DataFrame:
        return rows.select("o_orderkey", amount.alias("o_totalprice"), F.lit(op).alias("_op"), (key * 10 + n).alias("_seq"))

    return (
        part(o, price, "i", 0)
        .union(part(o.where("o_orderstatus = 'O'"), price + 5, "u", 1))
        .union(part(o.where("o_orderpriority = '5-LOW'"), F.lit(None).cast("double"), "d", 2))
        .union(part(o.where("o_orderpriority = '5-LOW' AND o_orderstatus = 'F'"), price + 9, "i", 3))
    )


RAW_SQL = """(SELECT *, 'b1' AS _sync_batch_id, o_orderdate AS _sync_timestamp, 0 AS _sync_deleted, o_orderkey AS _sync_seq FROM orders
    UNION ALL SELECT o_orderkey, o_custkey, 'X', o_totalprice * 2, o_orderdate, o_orderpriority, 'b2', o_orderdate + INTERVAL 1 DAY, 0, o_orderkey
    FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT *, 'b3', o_orderdate + INTERVAL 2 DAY, 1, o_orderkey FROM orders WHERE o_orderstatus = 'P')"""


def raw_versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as three loads: all, changed ones, and tombstones."""
    o = table(spark, d, "orders")

    def load(rows: DataFrame, batch: str, days: int, deleted: int) -> DataFrame:
        at = F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAY")
        lined = clean.with_lineage(rows, batch, "", at, F.col("o_orderkey")).drop("_sync_schema_fingerprint")
        return lined.withColumn("_sync_deleted", F.lit(deleted))

    again = o.where("o_orderstatus = 'O'").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") * 2})
    return load(o, "b1", 0, 0).unionByName(load(again, "b2", 1, 0)).unionByName(load(o.where("o_orderstatus = 'P'"), "b3", 2, 1))


COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS row_count FROM {t}" for t in TABLES)


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return scans.exact_counts({t: table(spark, d, t) for t in TABLES})


#: The replica's side of a comparison of tables: no region, one table more, orders as derived.
REPLICA_COUNTS_SQL = f"""SELECT * FROM ({COUNTS_SQL}) WHERE table_name NOT IN ('region', 'orders')
    UNION ALL SELECT 'orders', count(*)::BIGINT FROM {REPLICA_SQL} UNION ALL SELECT 'old_orders', count(*)::BIGINT FROM orders"""


def replica_counts(spark: SparkSession, d: str) -> DataFrame:
    names = {t: table(spark, d, t) for t in TABLES if t not in ("region", "orders")}
    return scans.exact_counts(names | {"orders": replica(spark, d), "old_orders": table(spark, d, "orders")})


#: The same by customer, so that many names have to agree: orders of each one, and those of the replica that are not urgent.
CUSTOMERS_SQL = "SELECT 'c' || o_custkey AS table_name, count(*)::BIGINT AS row_count FROM orders GROUP BY 1"
KEPT_SQL = f"SELECT 'c' || o_custkey AS table_name, count(*)::BIGINT AS row_count FROM {REPLICA_SQL} WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'F' GROUP BY 1"


def customer_counts(orders: DataFrame) -> DataFrame:
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("table_name")
    return orders.groupBy(name).agg(F.count(F.lit(1)).alias("row_count"))


def kept_counts(spark: SparkSession, d: str) -> DataFrame:
    return customer_counts(replica(spark, d).where("o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'F'"))


def shop_join(fact: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Customers with the name of their nation."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", "n_name")


# scans and sources


@query("SELECT * FROM orders")
def src1_snapshot_scan(spark, d):
    return table(spark, d, "orders")


@query("""SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) > (100, 2, 0, 0, 0.0)
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 1000""")
def src2_keyset_page(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return scans.keyset_page(table(spark, d, "lineitem"), keys, [100, 2, 0, 0, 0.0], 1000)


@query("SELECT * FROM orders WHERE (o_orderkey, o_custkey) > (500, 3)")
def src3_resume_scan(spark, d):
    return scans.resume_scan(table(spark, d, "orders"), ["o_orderkey", "o_custkey"], [500, 3])


@query("""SELECT p.*, (SELECT count(*) FROM orders) > 150 AS has_more
    FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50) p""")
def src4_offset_page(spark, d):
    return scans.offset_page(table(spark, d, "orders"), ["o_orderkey"], 100, 50)


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def src5_incremental_scan(spark, d):
    return scans.incremental_scan(table(spark, d, "events"), "ts", "2024-01-15 00:00:00")


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-14 12:00:00'")
def src5_incremental_lookback(spark, d):
    return scans.incremental_scan(table(spark, d, "events"), "ts", "2024-01-15 00:00:00", timedelta(hours=12))


@query(COUNTS_SQL)
def src10_exact_counts(spark, d):
    return source_counts(spark, d)


@query(COUNTS_SQL)
def src11_fast_counts(spark, d):
    return scans.fast_counts(spark, {t: f"{d}/{t}.parquet" for t in TABLES})


@query("""SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders
    WHERE o_orderstatus = 'O' AND o_totalprice > 1000.0 AND o_orderpriority <> '?' GROUP BY 1""")
def src13_run_query(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("src13_orders")
    sql = "SELECT o_orderpriority, count(*) AS n FROM src13_orders WHERE o_orderstatus = ? AND o_totalprice > ? AND o_orderpriority <> '?' GROUP BY 1"
    return scans.run_query(spark, sql, ["O", 1000.0])


# rows as clients read them


@query("""SELECT '{"o_orderkey":"' || o_orderkey || '","o_custkey":"' || o_custkey || '","o_orderstatus":"' || o_orderstatus
    || '","o_orderpriority":"' || o_orderpriority || '","o_totalprice":' || o_totalprice || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000')
    || '","open":' || CASE WHEN o_orderstatus = 'O' THEN 'true' WHEN o_orderstatus = 'F' THEN 'false' ELSE 'null' END || '}' AS json FROM orders""")
def snk15_json_rows(spark, d):
    still = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("open")
    names = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    return serve.json_rows(table(spark, d, "orders").select(*names, still))


@query("""SELECT event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, user_id::VARCHAR AS user_id, event_type, props,
    CASE WHEN value > 50 THEN '1' ELSE '0' END AS is_large, upper(hex(encode(event_type))) AS type_bytes FROM events""")
def snk16_text_rows(spark, d):
    e = table(spark, d, "events")
    more = {"is_large": F.col("value") > 50, "type_bytes": F.col("event_type").cast("binary")}
    return serve.text_rows(e.withColumns(more).drop("value"))


# cleaning and lineage


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate::DATE END AS day, o_orderdate AS at,
    upper(hex(encode(o_orderstatus))) AS status_hex, CASE WHEN o_totalprice > 1000 THEN 1 ELSE 0 END::TINYINT AS large,
    base64(encode(o_orderpriority)) AS priority, ascii(o_orderstatus)::VARCHAR AS bits FROM orders""")
def prj2_normalize(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "0000-00-00").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.hex(F.col("o_orderstatus").cast("binary")).alias("status_hex"),
        (F.col("o_totalprice") > 1000).alias("large"),
        F.col("o_orderpriority").cast("binary").alias("priority"),
        F.col("o_orderstatus").cast("binary").alias("bits"),
    )
    declared = {"day": "date", "at": "datetime", "large": "tinyint(1)", "priority": "blob", "bits": "bit(8)"}
    return clean.normalize(o, declared)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
    CASE WHEN o_custkey % 48 >= 24 THEN NULL ELSE (o_custkey % 48)::VARCHAR || ':30:00' END AS time FROM orders""")
def prj3_sanitize(spark, d):
    day = F.when(F.col("o_orderstatus") == "P", "0000-00-00").when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    time = F.concat((F.col("o_custkey") % 48).cast("string"), F.lit(":30:00"))
    return table(spark, d, "orders").select("o_orderkey", clean.sanitize(day, "date").alias("day"), clean.sanitize(time, "time").alias("time"))


@query("""SELECT *, 'b1' AS _sync_batch_id, ts AS _sync_timestamp, 0::TINYINT AS _sync_deleted, 'f' AS _sync_schema_fingerprint, event_id AS _sync_seq
    FROM events""")
def prj4_with_lineage(spark, d):
    return clean.with_lineage(table(spark, d, "events"), "b1", "f", F.col("ts"), F.col("event_id"))


@query("""SELECT event_id, 'e-' || event_id AS _change_uid, ts AS _change_source_ts,
    CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS _change_type,
    CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS _change_is_deleted, ts AS _change_synced_at FROM events""")
def prj5_change_metadata(spark, d):
    kind = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    uid = F.concat(F.lit("e-"), F.col("event_id").cast("string"))
    found = clean.with_change_metadata(table(spark, d, "events"), uid, F.col("ts"), kind)
    return found.select("event_id", "_change_uid", "_change_source_ts", "_change_type", "_change_is_deleted", "_change_synced_at")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {RAW_SQL} WHERE _sync_deleted = 0")
def prj6_live_rows(spark, d):
    return clean.live_rows(raw_versions(spark, d))


@query("""SELECT event_id, props, '{"type":"' || event_type || '","user":' || user_id || '}' AS facts FROM events""")
def prj7_json_text(spark, d):
    e = table(spark, d, "events").select("event_id", "props", F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")).alias("facts"))
    return clean.json_text(e, ["props", "facts"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'CUSTOMER#%1_'")
def prj11_like_filter(spark, d):
    return clean.like_filter(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "CUSTOMER#%1_")


@query("""SELECT * FROM orders WHERE o_totalprice > 500 AND o_totalprice < 400000 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'
    AND o_orderpriority LIKE '1%' AND o_orderstatus >= 'F' AND o_custkey IS NOT NULL AND o_orderstatus = 'O'""")
def prj12_predicates(spark, d):
    return table(spark, d, "orders").where(
        "o_totalprice > 500 AND o_totalprice < 400000 AND o_orderdate BETWEEN TIMESTAMP_NTZ '1995-01-01' AND TIMESTAMP_NTZ '1996-12-31' "
        "AND o_orderpriority LIKE '1%' AND o_orderstatus >= 'F' AND o_custkey IS NOT NULL AND o_orderstatus = 'O'"
    )


@query("""SELECT '[' || l_orderkey || ',' || l_linenumber || ',"' || l_returnflag || '"]' AS last_key FROM lineitem
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_returnflag DESC LIMIT 1""")
def prj13_last_key(spark, d):
    return clean.last_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])


@query("SELECT s_name, s_suppkey, s_nationkey::BIGINT AS s_nationkey, NULL::VARCHAR AS s_phone FROM supplier")
def prj14_align_columns(spark, d):
    from pyspark.sql import types as T

    target = T._parse_datatype_string("s_name string, s_suppkey bigint, s_nationkey bigint, s_phone string")
    return clean.align_columns(table(spark, d, "supplier"), target)


# joins


@query("""SELECT n_name AS grp, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def jn1_join_revenue(spark, d):
    o = table(spark, d, "orders")
    return A.join_revenue(o, shop_join(o, spark, d), F.col("o_custkey") == F.col("c_custkey"), "n_name", "o_totalprice")


@query("SELECT c_custkey AS parent_id, count(o_orderkey)::BIGINT AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def jn2_count_per_parent(spark, d):
    return A.count_per_parent(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey")


@query("""SELECT o_orderdate::DATE AS day, n_name AS region, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= DATE '1998-01-01' - INTERVAL 700 DAY GROUP BY 1, 2""")
def jn3_star_revenue(spark, d):
    o = table(spark, d, "orders")
    on = F.col("o_custkey") == F.col("c_custkey")
    return A.star_revenue(o, shop_join(o, spark, d), on, "o_orderdate", "o_totalprice", "n_name", "1998-01-01", 700)


@query("SELECT i AS id, 'row-' || i AS val FROM range(1, (SELECT count(*) FROM orders) + 1) t(i)")
def jn4_generate_rows(spark, d):
    return A.generate_rows(spark, table(spark, d, "orders").count()).select("id", "val")


@query(f"""SELECT table_name FROM ({COUNTS_SQL} UNION ALL {CUSTOMERS_SQL})
    WHERE table_name NOT IN (SELECT table_name FROM ({REPLICA_COUNTS_SQL} UNION ALL {KEPT_SQL}))""")
def jn5_pending_tables(spark, d):
    have = replica_counts(spark, d).union(kept_counts(spark, d))
    return R.pending_tables(source_counts(spark, d).union(customer_counts(table(spark, d, "orders"))), have)


@query(f"""SELECT coalesce(s.table_name, r.table_name) AS table_name,
    CASE WHEN r.table_name IS NULL THEN 'missing' WHEN s.table_name IS NULL THEN 'orphaned' ELSE 'both' END AS presence
    FROM ({COUNTS_SQL}) s FULL JOIN ({REPLICA_COUNTS_SQL}) r ON s.table_name = r.table_name""")
def jn6_table_presence(spark, d):
    return R.table_presence(source_counts(spark, d), replica_counts(spark, d))


@query("""WITH s AS (SELECT DISTINCT o_orderstatus AS table_name, o_orderpriority AS column_name FROM orders),
    r AS (SELECT DISTINCT o_orderstatus AS table_name, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN '6-NEW' ELSE o_orderpriority END AS column_name FROM orders)
    SELECT *, 'missing' AS diff FROM (SELECT * FROM s EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM r EXCEPT SELECT * FROM s)""")
def jn7_column_diff(spark, d):
    o = table(spark, d, "orders")
    s = o.select(F.col("o_orderstatus").alias("table_name"), F.col("o_orderpriority").alias("column_name")).distinct()
    renamed = F.when((F.col("table_name") == "F") & (F.col("column_name") == "5-LOW"), "6-NEW").otherwise(F.col("column_name"))
    return R.column_diff(s, s.withColumn("column_name", renamed))


RECONCILED_SQL = f"""SELECT coalesce(s.table_name, r.table_name) AS table_name, s.row_count AS source_count, r.row_count AS replica_count,
    coalesce(s.row_count, 0) - coalesce(r.row_count, 0) AS difference, s.row_count IS NOT DISTINCT FROM r.row_count AS matches
    FROM ({COUNTS_SQL}) s FULL JOIN ({REPLICA_COUNTS_SQL}) r ON s.table_name = r.table_name"""


@query(RECONCILED_SQL)
def jn8_reconcile_counts(spark, d):
    return R.reconcile_counts(source_counts(spark, d), replica_counts(spark, d))


@query(f"""SELECT table_name FROM ({REPLICA_COUNTS_SQL} UNION ALL {CUSTOMERS_SQL})
    WHERE table_name NOT IN (SELECT table_name FROM ({COUNTS_SQL} UNION ALL {KEPT_SQL}))""")
def jn9_missing_targets(spark, d):
    tracked = replica_counts(spark, d).union(customer_counts(table(spark, d, "orders")))
    return R.missing_targets(tracked, source_counts(spark, d).union(kept_counts(spark, d)))


JN10_SQL = f"""SELECT coalesce(s.o_orderkey, r.o_orderkey) AS o_orderkey,
    CASE WHEN r.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS diff
    FROM orders s FULL JOIN {REPLICA_SQL} r ON s.o_orderkey = r.o_orderkey
    WHERE r.o_orderkey IS NULL OR s.o_orderkey IS NULL OR s.o_totalprice <> r.o_totalprice"""


@query(JN10_SQL)
def jn10_row_diff(spark, d):
    return R.row_diff(table(spark, d, "orders"), replica(spark, d), ["o_orderkey"])


@query(JN10_SQL)
def jn10_row_diff_by_ranges(spark, d):
    """The same rows, by digests of key ranges first; rows are read where ranges differ."""
    return range_tree.row_diff_by_ranges(table(spark, d, "orders"), replica(spark, d), ["o_orderkey"], leaf_rows=500)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'changed' ELSE 'missing' END AS diff FROM lineitem
    WHERE l_orderkey BETWEEN (SELECT max(l_orderkey) - 40 FROM lineitem) AND (SELECT max(l_orderkey) - 30 FROM lineitem) AND l_linenumber >= 3
    GROUP BY ALL HAVING count(*) = 1""")
def jn10_few_differences(spark, d):
    """A composite key, and differences in one narrow range only: the rest is compared by its digests."""
    line = table(spark, d, "lineitem")
    # keys that repeat are not keys; written, as a source is, so that a pass over ranges reads these and joins nothing
    once = line.join(line.groupBy("l_orderkey", "l_linenumber").count().where("count = 1"), ["l_orderkey", "l_linenumber"]).drop("count")
    path = f"{shared_dir(spark)}/mirror/once-{uuid.uuid4().hex}"
    once.write.parquet(path)
    once = spark.read.schema(once.schema).parquet(path)
    top = line.agg(F.max("l_orderkey")).first()[0]
    here = F.col("l_orderkey").between(top - 40, top - 30)
    copy = once.where(~(here & (F.col("l_linenumber") > 3)))
    copy = copy.withColumn("l_tax", F.when(here & (F.col("l_linenumber") == 3), F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    return range_tree.row_diff_by_ranges(once, copy, ["l_orderkey", "l_linenumber"], leaf_rows=500)


# aggregates


@query("SELECT count(*)::BIGINT AS n FROM orders")
def ag1_total_count(spark, d):
    return A.total_count(table(spark, d, "orders"))


@query("SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F'")
def ag2_filtered_count(spark, d):
    return A.filtered_count(table(spark, d, "orders"), F.col("o_orderstatus") == "F")


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n, round(avg(o_totalprice), 2) AS avg_amount FROM orders GROUP BY 1")
def ag3_by_status(spark, d):
    return A.by_status(table(spark, d, "orders"), "o_orderstatus", "o_totalprice")


@query("""SELECT o_orderpriority AS dim_1, o_orderstatus AS dim_2, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY 1, 2 ORDER BY 4 DESC, 1, 2 LIMIT 20""")
def ag4_by_two_dims(spark, d):
    return A.by_two_dims(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("""SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS revenue
    FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY 1, 2""")
def ag5_monthly_revenue(spark, d):
    return A.monthly_revenue(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "1995-01-01", "1997-01-01")


@query("""SELECT o_custkey AS user_id, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""")
def ag6_top_spenders(spark, d):
    return A.top_spenders(table(spark, d, "orders"), "o_custkey", "o_totalprice")


@query("""SELECT o_orderpriority AS region, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS avg_amount,
    min(o_totalprice) AS min_amount, max(o_totalprice) AS max_amount, count(DISTINCT o_custkey)::BIGINT AS users FROM orders GROUP BY 1""")
def ag7_regional_analytics(spark, d):
    return A.regional_analytics(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_custkey")


@query("""SELECT count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS avg_amount,
    min(o_totalprice) AS min_amount, max(o_totalprice) AS max_amount FROM orders""")
def ag8_order_stats(spark, d):
    return A.order_stats(table(spark, d, "orders"), "o_totalprice")


@query("SELECT count(*)::BIGINT AS row_count, max(o_orderkey)::VARCHAR AS max_key, sum(o_orderkey)::VARCHAR AS sum_o_orderkey FROM orders")
def ag9_key_checksum(spark, d):
    return R.key_checksum(table(spark, d, "orders"), ["o_orderkey"])


@query("SELECT count(*)::BIGINT AS row_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS change_token FROM events")
def ag10_table_snapshot(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.date_trunc("second", "ts"))
    return R.table_snapshot(e, "ts").withColumn("change_token", F.substring("change_token", 1, 19))


RESULTS_SQL = """(SELECT event_id::VARCHAR AS table_name, CASE WHEN event_type IN ('error', 'purchase') THEN 'error' ELSE 'success' END AS status,
    CASE WHEN event_type = 'click' THEN 'full' ELSE 'incremental' END AS mode, user_id AS records FROM events)"""


@query(f"""SELECT count(*) FILTER (status = 'success')::BIGINT AS succeeded, count(*) FILTER (status <> 'success')::BIGINT AS failed,
    coalesce(sum(records) FILTER (status = 'success'), 0)::BIGINT AS records, count(*) FILTER (mode = 'incremental')::BIGINT AS by_watermark,
    count(*) FILTER (mode = 'full')::BIGINT AS sequential FROM {RESULTS_SQL}""")
def ag11_sync_totals(spark, d):
    results = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("table_name"),
        F.when(F.col("event_type").isin("error", "purchase"), "error").otherwise("success").alias("status"),
        F.when(F.col("event_type") == "click", "full").otherwise("incremental").alias("mode"),
        F.col("user_id").alias("records"),
    )
    return R.sync_totals(results)


VALIDATION_SQL = f"""SELECT count(*)::BIGINT AS total, count(*) FILTER (matches)::BIGINT AS matching,
    count(*) FILTER (NOT matches AND source_count IS NOT NULL AND replica_count IS NOT NULL)::BIGINT AS mismatched,
    count(*) FILTER (source_count IS NULL OR replica_count IS NULL)::BIGINT AS errors FROM ({RECONCILED_SQL})"""


@query(VALIDATION_SQL)
def ag12_validation_summary(spark, d):
    return R.validation_summary(R.reconcile_counts(source_counts(spark, d), replica_counts(spark, d)))


@query(f"""WITH c AS (SELECT _seq - _seq // 10 * 10 AS batch, _op FROM {CHANGES_SQL}),
    e AS (SELECT batch, count(*) FILTER (_op = 'i')::BIGINT AS inserts, count(*) FILTER (_op = 'u')::BIGINT AS updates, count(*) FILTER (_op = 'd')::BIGINT AS deletes
    FROM c GROUP BY 1) SELECT *, sum(inserts) OVER w::BIGINT AS total_inserts, sum(updates) OVER w::BIGINT AS total_updates,
    sum(deletes) OVER w::BIGINT AS total_deletes FROM e WINDOW w AS (ORDER BY batch)""".replace("OVER w::BIGINT", "OVER w"))
def ag14_change_counters(spark, d):
    log = change_log(spark, d).withColumn("batch", F.col("_seq") - F.floor(F.col("_seq") / 10) * 10)
    return changes.change_counters(log, "batch")


@query("SELECT count(*)::BIGINT AS total_rows, count(DISTINCT (l_orderkey, l_linenumber))::BIGINT AS distinct_keys FROM lineitem")
def ag15_distinct_keys(spark, d):
    return A.distinct_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT floor(value)::BIGINT AS bucket, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def ag16_bucket_histogram(spark, d):
    return A.bucket_histogram(table(spark, d, "events"), "value")


@query("SELECT ts::DATE AS day, count(*)::BIGINT AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def ag17_daily_counts(spark, d):
    return A.daily_counts(table(spark, d, "events"), "ts", "2024-01-10")


@query("""SELECT p_brand AS category, count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS total
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def ag18_category_totals(spark, d):
    return A.category_totals(table(spark, d, "lineitem"), table(spark, d, "part"), "l_partkey", "p_partkey", "p_brand", "l_extendedprice")


@query("""SELECT count(*)::BIGINT AS n, round(avg(o_totalprice), 2) AS avg_amount FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'""")
def ag19_range_stats(spark, d):
    return A.range_stats(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "1995-01-01", "1995-12-31")


@query("""SELECT round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most,
    count(DISTINCT l_partkey)::BIGINT AS keys, count(*) FILTER (l_returnflag = 'R')::BIGINT AS n_if,
    round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS total_if FROM lineitem""")
def ag20_simple_aggs(spark, d):
    return A.simple_aggs(table(spark, d, "lineitem"), "l_extendedprice", "l_partkey", F.col("l_returnflag") == "R")


# windows, top-k, sets

LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
CURRENT_LINES = """SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1"""


@query(CURRENT_LINES)
def wn1_current_rows(spark, d):
    return C.current_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER)


@query(f"""SELECT * FROM (SELECT * FROM {RAW_SQL} QUALIFY row_number() OVER (PARTITION BY o_orderkey
    ORDER BY _sync_timestamp DESC, _sync_batch_id DESC, _sync_seq DESC) = 1) WHERE _sync_deleted = 0""")
def wn1_current_versions(spark, d):
    return C.current_rows(raw_versions(spark, d), ["o_orderkey"], deleted=F.col("_sync_deleted") == 1)


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def wn2_latest_state(spark, d):
    return C.latest_state(table(spark, d, "events"), "user_id", "event_id")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS row_num FROM orders")
def wn3_rank_in_group(spark, d):
    ranked = C.rank_in_group(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return ranked.select("o_orderkey", "o_custkey", "row_num")


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def st1_top_k(spark, d):
    return A.top_k(table(spark, d, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@query("""(SELECT 'first' AS which, o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1)
    UNION ALL (SELECT 'last', o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1)""")
def st3_first_last(spark, d):
    return A.first_last(table(spark, d, "orders"), "o_orderkey", ["o_orderkey", "o_custkey"])


@query("""SELECT p.*, (SELECT count(*) FROM events WHERE event_type = 'click')::BIGINT AS total
    FROM (SELECT * FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20) p""")
def st4_log_page(spark, d):
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    return A.log_page(table(spark, d, "events"), order, F.col("event_type") == "click", 50, 20)


@query("SELECT * FROM events WHERE event_id > 100 AND event_type IN ('click', 'view') ORDER BY event_id DESC LIMIT 1000")
def st5_log_tail(spark, d):
    return A.log_tail(table(spark, d, "events"), "event_id", "event_type", 100, ["click", "view"])


@query(COUNTS_SQL)
def so1_counts_union(spark, d):
    return A.counts_union({t: table(spark, d, t) for t in TABLES})


@query(f"SELECT table_name FROM ({COUNTS_SQL}) UNION SELECT table_name FROM ({REPLICA_COUNTS_SQL})")
def so2_all_table_names(spark, d):
    return A.all_names(source_counts(spark, d), replica_counts(spark, d), "table_name")


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def so3_name_difference(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return A.name_difference(c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k")), "k")


# scalar functions


@query("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, date_trunc('day', o_orderdate)::TIMESTAMP AS day,
    (o_orderdate::DATE + 5)::DATE AS later, (o_orderdate::DATE - 7)::DATE AS earlier, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%g') AS txt,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate::DATE END AS parsed FROM orders""")
def scalar_date(spark, d):
    text = F.when(F.col("o_orderstatus") == "P", "2024-00-15").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day"),
        F.date_add("o_orderdate", 5).alias("later"), F.date_sub("o_orderdate", 7).alias("earlier"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS").alias("txt"), clean.clean_date(text).alias("parsed"),
    )


@query("""SELECT c_custkey, c_name || '/' || c_mktsegment AS joined, upper(trim('  ' || c_name)) AS up, regexp_replace(c_name, '[0-9]+', '?', 'g') AS masked,
    c_name LIKE 'Customer%' AS has_prefix, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS picked, format('{:,}', c_custkey) AS grouped
    FROM customer""")
def scalar_string(spark, d):
    pick = F.elt(((F.col("c_custkey") % 3) + 1).cast("int"), F.lit("a"), F.lit("b"), F.lit("c"))
    return table(spark, d, "customer").select(
        "c_custkey", F.concat("c_name", F.lit("/"), "c_mktsegment").alias("joined"), F.upper(F.trim(F.concat(F.lit("  "), "c_name"))).alias("up"),
        F.regexp_replace("c_name", "[0-9]+", "?").alias("masked"), F.col("c_name").startswith("Customer").alias("has_prefix"),
        pick.alias("picked"), F.format_number("c_custkey", 0).alias("grouped"),
    )


@query("""SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT AS whole, l_partkey % 7 AS rest, round(l_extendedprice, 1) AS rounded,
    l_quantity::VARCHAR::DOUBLE AS back, try_cast(l_returnflag AS INTEGER) AS none, if(l_discount > 0.05, 'YES', 'NO') AS cheap FROM lineitem""")
def scalar_math(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor("l_extendedprice").cast("long").alias("whole"), (F.col("l_partkey") % 7).alias("rest"),
        F.round("l_extendedprice", 1).alias("rounded"), F.col("l_quantity").cast("string").cast("double").alias("back"),
        F.col("l_returnflag").try_cast("int").alias("none"), F.when(F.col("l_discount") > 0.05, "YES").otherwise("NO").alias("cheap"),
    )


@query("""SELECT event_id, props ->> '$.k' AS k, upper(hex(encode(event_type))) AS hexed, base64(encode(event_type)) AS coded, sha256(event_type) AS digest,
    decode(unhex(hex(encode(event_type)))) AS back, props IS NULL AS no_props FROM events""")
def scalar_json_binary(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.hex(F.col("event_type").cast("binary")).alias("hexed"),
        F.base64(F.col("event_type").cast("binary")).alias("coded"), F.sha2("event_type", 256).alias("digest"),
        F.unhex(F.hex(F.col("event_type").cast("binary"))).cast("string").alias("back"), F.isnull("props").alias("no_props"),
    )


# change feeds


@query(f"""WITH b AS (SELECT o_custkey::VARCHAR AS table_name, count(*) AS c, max(o_totalprice)::BIGINT::VARCHAR AS k FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    n AS (SELECT o_custkey::VARCHAR AS table_name, count(*) AS c, max(o_totalprice)::BIGINT::VARCHAR AS k FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
    j AS (SELECT coalesce(b.table_name, n.table_name) AS table_name, b.c AS bc, n.c AS nc, b.k AS bk, n.k AS nk FROM b FULL JOIN n ON b.table_name = n.table_name),
    a AS (SELECT *, CASE WHEN nc IS NULL THEN 'vanished' WHEN bc IS NULL THEN 'full' WHEN nc < bc THEN 'full'
      WHEN nc > bc OR bk <> nk THEN 'incremental' ELSE 'none' END AS action FROM j)
    SELECT table_name, action, CASE WHEN action = 'incremental' THEN greatest(nc - bc, 0) ELSE 0 END::BIGINT AS inserts,
      CASE WHEN action = 'incremental' AND nc = bc THEN 1 ELSE 0 END::BIGINT AS updates,
      CASE WHEN action = 'full' AND nc < bc THEN bc - nc ELSE 0 END::BIGINT AS deletes FROM a""")
def sm1_plan_cycle(spark, d):
    def snapshot(rows: DataFrame) -> DataFrame:
        token = F.round(F.max("o_totalprice")).cast("long").cast("string")
        return rows.groupBy(F.col("o_custkey").cast("string").alias("table_name")).agg(F.count(F.lit(1)).alias("row_count"), token.alias("change_token"))

    o = table(spark, d, "orders")
    return changes.plan_cycle(snapshot(o.where("o_orderstatus <> 'P'")), snapshot(o.where("o_orderpriority <> '5-LOW'")))


@query(f"SELECT o_orderkey FROM {REPLICA_SQL} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def sm4_detect_deletes(spark, d):
    return changes.detect_deletes(table(spark, d, "orders"), replica(spark, d), ["o_orderkey"])


@query(f"""SELECT o_orderkey, o_totalprice, _op, _seq FROM (SELECT * FROM {CHANGES_SQL}
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY _seq DESC) = 1) WHERE _op <> 'd'""")
def sm5_current_from_changes(spark, d):
    return C.current_from_changes(change_log(spark, d), ["o_orderkey"])


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS client, epoch_us(ts) AS ts_us, value AS cost,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT client, n, ts_us, cost, 0.0::DOUBLE AS used, 0.0 + cost > 200.0 AS limited, ts_us // 86400000000 AS w,
            CASE WHEN cost > 200.0 THEN 0.0 ELSE cost END::DOUBLE AS cur, 0.0::DOUBLE AS prev FROM e WHERE n = 1
        UNION ALL
        SELECT client, n, ts_us, cost, used, used + cost > 200.0, w, CASE WHEN used + cost > 200.0 THEN cur ELSE cur + cost END, prev
        FROM (SELECT *, prev * (1 - (ts_us % 86400000000) / 86400000000) + cur AS used
            FROM (SELECT e.client, e.n, e.ts_us, e.cost, e.ts_us // 86400000000 AS w,
                CASE WHEN e.ts_us // 86400000000 = r.w THEN r.cur ELSE 0.0 END AS cur,
                CASE WHEN e.ts_us // 86400000000 = r.w THEN r.prev WHEN e.ts_us // 86400000000 = r.w + 1 THEN r.cur ELSE 0.0 END AS prev
                FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1)))
    SELECT client, ts_us, cost, used, limited FROM r""")
def sm11_quota_replay(spark, d):
    e = table(spark, d, "events").withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return quota.quota_replay(e, "user_id", "ts_us", "value", 24 * 3600 * 1_000_000, 200.0, "event_id")


@query("""SELECT * FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'click')
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts DESC) = 1""")
def sm12_dedup_versions(spark, d):
    e = table(spark, d, "events")
    return changes.dedup_versions(e.union(e.where("event_type = 'click'")), ["event_id"], ["ts"])


# validation

DETAILS_SQL = f"""SELECT 'orders' AS table_name, s.c AS source_count, s.m AS source_max_id, s.x AS source_checksum, r.c AS replica_count,
    r.m AS replica_max_id, r.x AS replica_checksum, '' AS missing_columns, '' AS extra_columns, true AS in_source, true AS in_replica
    FROM (SELECT count(*)::BIGINT AS c, max(o_orderkey)::VARCHAR AS m, sum(o_orderkey)::VARCHAR AS x FROM orders) s,
    (SELECT count(*)::BIGINT AS c, max(o_orderkey)::VARCHAR AS m, sum(o_orderkey)::VARCHAR AS x FROM {REPLICA_SQL}) r"""
CLASSIFIED_SQL = f"""SELECT *, CASE WHEN source_max_id <> replica_max_id THEN 'max_id' WHEN source_checksum <> replica_checksum THEN 'checksum'
    WHEN source_count <> replica_count THEN 'row_count' ELSE 'ok' END AS reason FROM ({DETAILS_SQL})"""


@query(f"""WITH s AS ({CUSTOMERS_SQL}), r AS ({KEPT_SQL}) SELECT count(*)::BIGINT AS total, count(*) FILTER (s.row_count = r.row_count)::BIGINT AS matching,
    count(*) FILTER (s.row_count <> r.row_count)::BIGINT AS mismatched, count(*) FILTER (s.row_count IS NULL OR r.row_count IS NULL)::BIGINT AS errors
    FROM s FULL JOIN r ON s.table_name = r.table_name""")
def vl1_validate_counts(spark, d):
    """Every customer's orders against the replica's."""
    return R.validation_summary(R.reconcile_counts(customer_counts(table(spark, d, "orders")), kept_counts(spark, d)))


@query(DETAILS_SQL)
def vl2_table_details(spark, d):
    return R.table_details("orders", table(spark, d, "orders"), replica(spark, d), ["o_orderkey"])


#: Pairs of tables, one for each reason that tables can differ for.
SIDES_SQL = """(SELECT 'same' AS table_name, true AS in_source, true AS in_replica, '' AS missing_columns, '' AS extra_columns,
        c AS source_count, c AS replica_count, m AS source_max_id, m AS replica_max_id, k || ',' || n AS source_checksum, k || ',' || n AS replica_checksum FROM f
    UNION ALL SELECT 'other_second_key', true, true, '', '', c, c, m, m, k || ',' || n, k || ',' || n2 FROM f
    UNION ALL SELECT 'not_copied', true, false, '', '', c, NULL, m, NULL, k || ',' || n, NULL FROM f
    UNION ALL SELECT 'left_over', false, true, '', '', NULL, c, NULL, m, NULL, k || ',' || n FROM f
    UNION ALL SELECT 'narrower', true, true, 'l_tax', '', c, c, m, m, k || ',' || n, k || ',' || n FROM f
    UNION ALL SELECT 'wider', true, true, '', 'more', c, c, m, m, k || ',' || n, k || ',' || n FROM f
    UNION ALL SELECT 'shorter', true, true, '', '', c, c2, m, m2, k || ',' || n, k2 || ',' || n3 FROM f
    UNION ALL SELECT 'doubled', true, true, '', '', c, 2 * c, NULL, NULL, NULL, NULL FROM f)"""
SIDES_SQL = f"""WITH f AS (SELECT count(*)::BIGINT AS c, max(l_orderkey)::VARCHAR AS m, sum(l_orderkey)::VARCHAR AS k, sum(l_linenumber)::VARCHAR AS n,
    sum(l_linenumber + 1)::VARCHAR AS n2, count(*) FILTER (l_orderkey % 2 = 0 AND l_orderkey < t)::BIGINT AS c2,
    max(l_orderkey) FILTER (l_orderkey % 2 = 0 AND l_orderkey < t)::VARCHAR AS m2, sum(l_orderkey) FILTER (l_orderkey % 2 = 0 AND l_orderkey < t)::VARCHAR AS k2,
    sum(l_linenumber) FILTER (l_orderkey % 2 = 0 AND l_orderkey < t)::VARCHAR AS n3 FROM lineitem, (SELECT max(l_orderkey) AS t FROM lineitem))
    SELECT *, CASE table_name WHEN 'same' THEN 'ok' WHEN 'other_second_key' THEN 'checksum' WHEN 'not_copied' THEN 'missing_table' WHEN 'left_over' THEN 'orphaned_table'
    WHEN 'narrower' THEN 'missing_columns' WHEN 'wider' THEN 'extra_columns' WHEN 'shorter' THEN 'max_id' ELSE 'row_count' END AS reason FROM {SIDES_SQL}"""


@query(SIDES_SQL)
def vl3_reasons(spark, d):
    """Missing, left over, narrower, wider, shorter, doubled and equal copies of one table, and one that differs in its second key column only."""
    line, keys = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    top = line.agg(F.max("l_orderkey")).first()[0]
    pairs = [
        ("same", line, line, keys),
        ("other_second_key", line, line.withColumn("l_linenumber", F.col("l_linenumber") + 1), keys),
        ("not_copied", line, None, keys),
        ("left_over", None, line, keys),
        ("narrower", line, line.drop("l_tax"), keys),
        ("wider", line, line.withColumn("more", F.lit(1)), keys),
        ("shorter", line, line.where((F.col("l_orderkey") % 2 == 0) & (F.col("l_orderkey") < top)), keys),
        ("doubled", line, line.unionAll(line), []),
    ]
    details = [R.table_details(name, a, b, k) for name, a, b, k in pairs]
    return R.classify_mismatch(reduce(DataFrame.unionByName, details))


@query(CLASSIFIED_SQL)
def vl3_classify_mismatch(spark, d):
    return R.classify_mismatch(vl2_table_details(spark, d))


@query(f"SELECT * FROM ({CLASSIFIED_SQL}) WHERE table_name LIKE '%order%' AND reason <> 'ok'")
def vl4_filter_validation(spark, d):
    return R.filter_validation(vl3_classify_mismatch(spark, d), "ORDER", only_bad=True)


PROFILES_SQL = """SELECT 'events' AS table_name, count(*)::BIGINT AS row_count, count(DISTINCT event_id)::BIGINT AS distinct_keys, 0::BIGINT AS null_marks,
    'event_id' AS key_columns, 'append-only' AS watermark_quality, count(DISTINCT event_id) = count(*) AS key_is_unique, 0 AS unsupported FROM events
    UNION ALL SELECT 'orders', count(*)::BIGINT, count(DISTINCT o_orderkey)::BIGINT, count(*)::BIGINT, 'o_orderkey', 'none',
    count(DISTINCT o_orderkey) = count(*), 0 FROM orders"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    e = R.profile_table("events", table(spark, d, "events"), ["event_id"], "ts")
    return e.unionByName(R.profile_table("orders", table(spark, d, "orders"), ["o_orderkey"], None))


@query(PROFILES_SQL)
def vl5_profile_tables(spark, d):
    return _profiles(spark, d).drop("first_mark", "last_mark")


@query(f"""SELECT count(*)::BIGINT AS tables, count(*) FILTER (key_columns <> '')::BIGINT AS with_key,
    count(*) FILTER (watermark_quality <> 'none')::BIGINT AS with_watermark, sum(unsupported)::BIGINT AS unsupported, sum(row_count)::BIGINT AS rows
    FROM ({PROFILES_SQL})""")
def vl6_profile_summary(spark, d):
    return R.profile_summary(_profiles(spark, d))


# logs

STATEMENTS_SQL = """(SELECT event_id, ts, value, CASE event_type WHEN 'click' THEN 'SELECT *  FROM t WHERE id = ' || user_id
    ELSE 'select name from u where x = ''' || event_type || ''' and y = 1.5' END AS stmt FROM events)"""
NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(stmt, '''[^'']*''', '?', 'g'), '\\b[0-9]+(\\.[0-9]+)?\\b', '?', 'g'), '\\s+', ' ', 'g'))"


def _statements(spark: SparkSession, d: str) -> DataFrame:
    one = F.concat(F.lit("SELECT *  FROM t WHERE id = "), F.col("user_id").cast("string"))
    two = F.concat(F.lit("select name from u where x = '"), F.col("event_type"), F.lit("' and y = 1.5"))
    stmt = F.when(F.col("event_type") == "click", one).otherwise(two)
    return table(spark, d, "events").select("event_id", "ts", "value", stmt.alias("stmt"))


@query(f"SELECT event_id, {NORMAL} AS pattern FROM {STATEMENTS_SQL}")
def ql1_normalize_sql(spark, d):
    return _statements(spark, d).select("event_id", logs.normalize_sql(F.col("stmt")).alias("pattern"))


@query(f"""SELECT {NORMAL} AS pattern, count(*)::BIGINT AS runs, round(avg(value), 3) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, max(ts) AS last_run
    FROM {STATEMENTS_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def ql2_pattern_stats(spark, d):
    log = _statements(spark, d).withColumn("p", logs.normalize_sql(F.col("stmt")))
    return logs.pattern_stats(log, "p", "value", "ts")


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'read' WHEN event_type = 'view' THEN 'write'
    WHEN event_type = 'purchase' THEN CASE WHEN user_id > 10 THEN 'other' ELSE 'read' END ELSE 'other' END AS kind FROM events""")
def ql3_classify_statement(spark, d):
    user = F.col("user_id").cast("string")
    locked = F.when(F.col("user_id") > 10, " FOR UPDATE").otherwise(";")
    stmt = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("-- a\n select * from t where id = "), user))
        .when(F.col("event_type") == "view", F.concat(F.lit("/* b */ Insert into t values ("), user, F.lit(")")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("SELECT ';' FROM t"), locked))
        .otherwise(F.concat(F.lit("SELECT 1; DELETE FROM t WHERE id = "), user))
    )
    return table(spark, d, "events").select("event_id", logs.classify_statement(stmt).alias("kind"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'query' WHEN 'purchase' THEN 'auth' ELSE CASE WHEN user_id % 2 = 0 THEN 'read' ELSE 'write' END END AS category
    FROM events""")
def ql4_classify_endpoint(spark, d):
    path = F.when(F.col("event_type") == "click", "/api/query").when(F.col("event_type") == "purchase", "/api/auth/login").otherwise("/api/tables/x")
    verb = F.when(F.col("user_id") % 2 == 0, "GET").otherwise("POST")
    return table(spark, d, "events").select("event_id", logs.classify_endpoint(verb, path).alias("category"))


@query("""SELECT doc_id, (2 + CASE WHEN length(text) > 5000 THEN 2 WHEN length(text) > 2000 THEN 1 ELSE 0 END)::INTEGER AS cost FROM documents""")
def ql5_request_cost(spark, d):
    return table(spark, d, "documents").select("doc_id", logs.request_cost(F.lit("query"), F.col("text")).alias("cost"))


# upkeep


@query(CURRENT_LINES)
def mt2_vacuum_versions(spark, d):
    return C.vacuum_versions(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER)


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-23 00:00:00'")
def mt3_prune_log(spark, d):
    from datetime import datetime

    return S.prune_log(table(spark, d, "events"), "ts", 7, datetime(2024, 1, 30))[0]


@query("""SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, NULL::DOUBLE AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def mt5_add_new_columns(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return S.add_new_columns(c, s)


#: Names with the kind that the specification gives a table of few rows by that name.
NAMED_KINDS = {
    "user_activity": "fact", "audit": "fact", "orderHistory": "fact", "history": "fact", "page_events": "fact", "transactions": "fact", "change_log": "fact",
    "sync_metadata": "metadata", "sync_log": "metadata", "catalog": "dimension", "prevention": "dimension", "users": "dimension", "settings": "dimension",
}
_NAMED = " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*)::BIGINT AS row_count, '{kind}' AS kind FROM nation" for name, kind in NAMED_KINDS.items())


@query(f"""SELECT *, CASE WHEN table_name = 'region' THEN 'metadata' WHEN table_name = 'events' OR row_count > 50000 THEN 'fact' ELSE 'dimension' END AS kind
    FROM ({COUNTS_SQL}) UNION ALL {_NAMED}""")
def pd1_classify_tables(spark, d):
    """Tables by their names and sizes, and one by the user's word."""
    few = table(spark, d, "nation").agg(F.count(F.lit(1)).alias("row_count"))
    named = few.select(F.explode(F.array(*map(F.lit, NAMED_KINDS))).alias("table_name"), "row_count")
    return R.classify_tables(source_counts(spark, d).unionByName(named), overrides={"region": "metadata"})


@query("""SELECT event_id, user_id, ts::DATE AS snapshot_date FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, event_id DESC) = 1""")
def pd3_dedup_by_partition(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("snapshot_date"))
    return S.dedup_by_partition(e, ["user_id"], "snapshot_date", ["event_id"])


@query(f"""SELECT year(l_shipdate)::INTEGER AS year, month(l_shipdate)::INTEGER AS month, count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS revenue
    FROM ({CURRENT_LINES}) GROUP BY 1, 2""")
def flagship(spark, d):
    """Raw versions, their current view, and monthly revenue over it."""
    return A.monthly_revenue(wn1_current_rows(spark, d), "l_shipdate", "l_extendedprice")
