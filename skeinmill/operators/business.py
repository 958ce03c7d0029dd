"""Parameterised business lookups and their guards.

A lookup's rows are capped at ``MAX_ROWS`` by its contract. Inventory stands on
shipped quantities: a SKU is a part, a warehouse a supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.runtime import table

MAX_ROWS, MAX_SKUS, MAX_DAYS = 200, 50, 30
# Words and patterns that mark a business question.
INTENT_WORDS = ("库存", "现货", "可售", "仓库", "订单", "发货", "物流", "签收", "商品", "产品", "型号", "类目", "sku", "stock", "inventory", "order", "shipment", "delivery", "product")
SKU = r"(?i)\b(?:SKU[-_A-Za-z0-9]*|[A-Z]{1,8}[-_]\d{2,}[A-Z0-9-_]*)\b"
ORDER_NUMBER = r"(?i)\b(?:SO|PO|ORDER|ORD)[-_]?\d{4,}[A-Z0-9-_]*\b"


def is_select_template(sql: str) -> bool:
    """A template may be one SELECT or WITH statement without an inner semicolon."""
    body = sql.strip().rstrip(";").strip()
    return body.lower().startswith(("select ", "with ")) and ";" not in body


def run_template(spark: SparkSession, sql: str, args: dict) -> DataFrame:
    if not is_select_template(sql):
        raise ValueError("only one SELECT or WITH statement is allowed")
    return spark.sql(sql.strip().rstrip(";"), args=args).limit(MAX_ROWS)


def has_business_intent(text: Column) -> Column:
    low = F.lower(text)
    found = text.rlike(SKU) | text.rlike(ORDER_NUMBER)
    for word in INTENT_WORDS:
        found = found | low.contains(word)
    return found


def date_window_code(start: Column, end: Column, days: int = MAX_DAYS) -> Column:
    """OK, INVALID_TIME_RANGE or TIME_RANGE_TOO_LARGE; what does not parse is not judged. Exactly ``days`` days pass."""
    seconds = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return F.when(seconds < 0, "INVALID_TIME_RANGE").when(seconds > days * 86_400, "TIME_RANGE_TOO_LARGE").otherwise("OK")


def inventory(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(F.col("l_partkey").alias("sku"), F.col("l_suppkey").alias("warehouse_code")).agg(F.sum("l_quantity").alias("quantity"))


def inventory_lookup(lineitem: DataFrame, sku: int, warehouse: int | None = None) -> DataFrame:
    rows = lineitem.where(F.col("l_partkey") == sku)
    return inventory(rows if warehouse is None else rows.where(F.col("l_suppkey") == warehouse)).orderBy("sku", "warehouse_code").limit(MAX_ROWS)


def inventory_batch(lineitem: DataFrame, skus: list[int], warehouse: int | None = None) -> DataFrame:
    rows = lineitem.where(F.col("l_partkey").isin(skus[:MAX_SKUS]))
    return inventory(rows if warehouse is None else rows.where(F.col("l_suppkey") == warehouse))


def q_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(table(spark, sf_dir, "lineitem"))


def q_inventory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory_lookup(table(spark, sf_dir, "lineitem"), 7)


def q_inventory_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory_batch(table(spark, sf_dir, "lineitem"), list(range(1, 61)))


def order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milestones of every order; lines are added up before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("lines"), F.count_if(F.col("l_linestatus") == "F").alias("lines_done"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def product_lookup(spark: SparkSession, sf_dir: str, keyword: str = "a", category: str | None = None) -> DataFrame:
    part = table(spark, sf_dir, "part").where(F.lower("p_name").contains(keyword.lower()))
    part = part if category is None else part.where(F.col("p_type") == category)
    return part.select("p_partkey", "p_name", "p_brand", "p_type").orderBy("p_partkey").limit(MAX_ROWS)


def date_window_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span from an order's date to its last shipment."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    both = table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", date_window_code(F.col("o_orderdate"), F.col("last_ship")).alias("code"))


QUESTIONS = ["SKU-12 in store?", "ab_1234x", "so12345 please", "ORD 77", "stock of A", "hello", "订单到哪了", "weather", "the border"]


def business_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(q,) for q in QUESTIONS], "text string")
    whole = asked.unionByName(table(spark, sf_dir, "conversations").where("role = 'user'").select("text"))
    return whole.groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.max(has_business_intent(F.col("text"))).alias("business"))


def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An administrator's SELECT template over registered tables."""
    for name in ("orders", "lineitem", "customer", "nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"skeinmill_{name}")
    sql = """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM skeinmill_lineitem JOIN skeinmill_orders ON l_orderkey = o_orderkey
        JOIN skeinmill_customer ON o_custkey = c_custkey JOIN skeinmill_nation ON c_nationkey = n_nationkey JOIN skeinmill_region ON n_regionkey = r_regionkey WHERE o_orderstatus = :status GROUP BY r_name"""
    return run_template(spark, sql, {"status": "O"})


_INV = "SELECT l_partkey AS sku, l_suppkey AS warehouse_code, sum(l_quantity) AS quantity FROM lineitem {} GROUP BY 1, 2"
_QV = ", ".join(f"('{q}')" for q in QUESTIONS)
_WORDS = " OR ".join(f"contains(lower(text), '{w}')" for w in INTENT_WORDS)
QUERIES = {
    "inventory_all": (q_inventory, _INV.format("")),
    "inventory_lookup": (q_inventory_lookup, _INV.format("WHERE l_partkey = 7")),
    "inventory_batch_lookup": (q_inventory_batch, _INV.format("WHERE l_partkey BETWEEN 1 AND 50")),
    "order_status": (order_status, """SELECT o_orderkey, o_orderstatus, lines, lines_done, first_ship, last_ship FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, count_if(l_linestatus = 'F')::BIGINT AS lines_done,
        min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""),
    "product_lookup": (product_lookup, "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_partkey LIMIT 200"),
    "date_window_guard": (date_window_guard, """SELECT o_orderkey, CASE WHEN s < 0 THEN 'INVALID_TIME_RANGE' WHEN s > 30 * 86400 THEN 'TIME_RANGE_TOO_LARGE' ELSE 'OK' END AS code
        FROM (SELECT o_orderkey, floor(epoch(max(l_shipdate))) - floor(epoch(any_value(o_orderdate))) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""),
    "business_intent": (business_intent, f"""WITH q AS (SELECT text FROM (VALUES {_QV}) v(text) UNION ALL SELECT text FROM conversations WHERE role = 'user')
        SELECT md5(text) AS text_md5, bool_or(regexp_matches(text, '{SKU}') OR regexp_matches(text, '{ORDER_NUMBER}') OR {_WORDS}) AS business FROM q GROUP BY 1"""),
    "sql_template": (region_revenue, """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' GROUP BY 1"""),
}
