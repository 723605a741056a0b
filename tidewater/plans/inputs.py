"""Job inputs derived by Spark from the test tables.

The job consumes CSV directories; the test tables are Parquet without nulls.
These functions write CSV inputs from them (under the session's shared
folder), with nulls injected by a rule on the row key so that the expected
output can be computed independently in SQL.  Whole tables are used.

Rules (also used by the SQL oracles):
  price  = l_extendedprice, null when l_orderkey % 2 = 0
  seller = l_suppkey,       null when l_orderkey % 3 = 0
  status = l_linestatus,    null when l_orderkey % 5 = 0
  NaN variant: price is NaN when it would not be null and l_orderkey % 7 = 0
  unparsable variant: price is the text "n/a" when it would not be null and
  l_orderkey % 11 = 0
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

_CACHE: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_job_rows(spark: SparkSession, sf_dir: str, nan_prices: bool = False) -> DataFrame:
    """The job's input rows derived from ``lineitem`` by the rules above."""
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    price = F.when(key % 2 == 0, F.lit(None).cast("double")).otherwise(F.col("l_extendedprice"))
    if nan_prices:
        price = F.when((key % 2 != 0) & (key % 7 == 0), F.lit(float("nan"))).otherwise(price)
    return li.select(
        key.alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").alias("quantity"),
        price.alias("price"),
        F.when(key % 3 == 0, F.lit(None)).otherwise(F.col("l_suppkey")).alias("seller"),
        F.when(key % 5 == 0, F.lit(None)).otherwise(F.col("l_linestatus")).alias("status"),
        F.col("l_returnflag").alias("return_flag"),
    )


def write_csv_input(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def _cached(spark: SparkSession, key: tuple, build) -> str:
    root_key = (spark.conf.get("spark.checkpoint.dir", None),) + key
    if root_key not in _CACHE:
        path = scratch_path(spark, "inputs", *[str(k).strip("/").replace("/", "_") for k in key])
        build(path)
        _CACHE[root_key] = path
    return _CACHE[root_key]


def lineitem_csv(spark: SparkSession, sf_dir: str, nan_prices: bool = False) -> str:
    """CSV directory of the job input derived from ``lineitem``."""
    return _cached(spark, ("lineitem", sf_dir, nan_prices),
                   lambda p: write_csv_input(lineitem_job_rows(spark, sf_dir, nan_prices), p))


def unparsable_price_csv(spark: SparkSession, sf_dir: str) -> str:
    """The ``lineitem`` input with ``price`` written as the text ``n/a`` where
    it would hold a value and l_orderkey % 11 = 0: under a declared DOUBLE
    those rows do not parse and go to quarantine."""
    def build(p):
        rows = lineitem_job_rows(spark, sf_dir)
        bad = (F.col("order_key") % 11 == 0) & F.col("price").isNotNull()
        write_csv_input(rows.withColumn(
            "price", F.when(bad, F.lit("n/a")).otherwise(F.col("price").cast("string"))), p)
    return _cached(spark, ("lineitem-unparsable", sf_dir), build)


def whole_price_csv(spark: SparkSession, sf_dir: str) -> str:
    """The ``lineitem`` input with ``price`` rounded down: inferred as whole numbers."""
    def build(p):
        rows = lineitem_job_rows(spark, sf_dir)
        write_csv_input(rows.withColumn("price", F.floor("price")), p)
    return _cached(spark, ("lineitem-whole", sf_dir), build)


def mixed_header_csv(spark: SparkSession, sf_dir: str) -> str:
    """The ``lineitem`` input in three folders by order_key % 3: as it is; ``seller, price,
    status`` first and a column more; and without ``status``."""
    def build(p):
        rows = lineitem_job_rows(spark, sf_dir)
        part = F.col("order_key") % 3
        write_csv_input(rows.filter(part == 0), f"{p}/a")
        write_csv_input(rows.filter(part == 1).select("seller", "price", "status", "order_key", "line_number",
                                                      F.lit("x,y").alias("note")), f"{p}/b")
        write_csv_input(rows.filter(part == 2).drop("status"), f"{p}/c")
    return _cached(spark, ("lineitem-headers", sf_dir), build)


def blank_lineitem_csv(spark: SparkSession, sf_dir: str) -> str:
    """Every ``lineitem`` row with price, seller and status all empty (the other
    columns kept).  A run over it reads the whole table and is EMPTY."""
    def build(p):
        rows = lineitem_job_rows(spark, sf_dir).withColumns({
            "price": F.lit(None).cast("double"),
            "seller": F.lit(None).cast("bigint"),
            "status": F.lit(None).cast("string"),
        })
        write_csv_input(rows, p)
    return _cached(spark, ("lineitem-blank", sf_dir), build)


def events_csv(spark: SparkSession, sf_dir: str) -> str:
    """CSV directory of ``events``; ``ts`` is written as text and inferred back."""
    def build(p):
        ev = table(spark, sf_dir, "events").select(
            "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
            "user_id", "event_type", "value")
        write_csv_input(ev, p)
    return _cached(spark, ("events", sf_dir), build)
