"""The purchase-to-pay roles that the warehouse tables play, as DataFrames with declared types.

Request lines are versions: several rows may share (pr_id, line_no). Money and quantities are decimals from the scan on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = {"A": "approved", "R": "rejected", "N": "pending"}
HEADER_STATUS = {"F": "approved", "P": "rejected", "O": "pending"}


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _named(column: str, names: dict[str, str]):
    out = F
    for key, value in names.items():
        out = out.when(F.col(column) == key, value)
    return out


def request_line_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored version of every request line; ``version`` orders them, the rest of the row breaks ties."""
    li = scan(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("pr_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("vendor_id"),
        F.col("l_quantity").cast("decimal(18,4)").alias("requested_qty"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        _named("l_returnflag", STATUS).alias("status"), (F.col("l_tax") >= 0.08).cast("int").alias("is_deleted"), F.col("l_shipdate").alias("version"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") % 4 != 0), F.col("l_quantity")).otherwise(0).cast("decimal(18,4)").alias("approved_qty"),
    )


LINE_KEYS = ("pr_id", "line_no")
#: Later versions first; no two stored rows agree in all of these.
LINE_ORDER = ("version", "item_id", "vendor_id", "requested_qty", "price")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pr_id"), F.col("o_custkey").alias("requester_id"), _named("o_orderstatus", HEADER_STATUS).alias("status"),
        F.to_date("o_orderdate").alias("pr_date"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.when(F.col("o_orderkey") % 17 == 0, 1).otherwise(0).alias("is_deleted"),
    )


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of purchase orders: one order per vendor and month, any number of lines for a request line."""
    li = scan(spark, folder, "lineitem").where("l_linestatus = 'F'")
    return li.select(
        (F.col("l_suppkey") * 100 + F.month("l_shipdate")).alias("po_id"), F.col("l_suppkey").alias("vendor_id"), F.col("l_orderkey").alias("pr_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("decimal(18,4)").alias("ordered_qty"), F.col("l_extendedprice").cast("decimal(18,2)").alias("unit_price"),
        (F.col("l_tax") >= 0.08).cast("int").alias("is_deleted"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name_en"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 11 == 0, 1).otherwise(0).alias("is_deleted"),
    )


def vendors(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"), F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("balance"))


def commands(spark: SparkSession, folder: str) -> DataFrame:
    """Actions on documents in time order: the user id is the document, the event type the action."""
    return scan(spark, folder, "events").select("event_id", F.col("user_id").alias("document_id"), F.col("event_type").alias("action"), F.col("ts").alias("at"), "value")


#: The same roles for DuckDB, as the head of an oracle's WITH clause.
SQL = """
lv AS (
    SELECT l_orderkey AS pr_id, l_linenumber AS line_no, l_partkey AS item_id, l_suppkey AS vendor_id,
           CAST(l_quantity AS DECIMAL(18,4)) AS requested_qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
           CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' WHEN 'N' THEN 'pending' END AS status,
           CAST(l_tax >= 0.08 AS INT) AS is_deleted, l_shipdate AS version,
           CAST(CASE WHEN l_returnflag = 'A' AND l_linenumber % 4 <> 0 THEN l_quantity ELSE 0 END AS DECIMAL(18,4)) AS approved_qty
    FROM lineitem),
ln AS (
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, line_no
        ORDER BY version DESC, item_id DESC, vendor_id DESC, requested_qty DESC, price DESC) AS rn FROM lv) WHERE rn = 1),
rq AS (
    SELECT o_orderkey AS pr_id, o_custkey AS requester_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' WHEN 'O' THEN 'pending' END AS status,
           CAST(o_orderdate AS DATE) AS pr_date, o_orderpriority AS priority, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
           CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS is_deleted
    FROM orders),
ol AS (
    SELECT l_suppkey * 100 + month(l_shipdate) AS po_id, l_suppkey AS vendor_id, l_orderkey AS pr_id, l_linenumber AS line_no, l_partkey AS item_id,
           CAST(l_quantity AS DECIMAL(18,4)) AS ordered_qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price, CAST(l_tax >= 0.08 AS INT) AS is_deleted
    FROM lineitem WHERE l_linestatus = 'F'),
it AS (
    SELECT p_partkey AS item_id, p_name AS name_en, p_type AS category, p_brand AS brand, p_size AS size,
           CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS is_deleted
    FROM part),
ve AS (SELECT s_suppkey AS vendor_id, s_name AS vendor_name, s_nationkey AS nation_id, s_acctbal AS balance FROM supplier),
cm AS (SELECT event_id, user_id AS document_id, event_type AS action, ts AS at, value FROM events)
"""
