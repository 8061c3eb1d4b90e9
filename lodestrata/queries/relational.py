"""Plain relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.queries.registry import query
from lodestrata.sources.tables import table


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"
)
def star_pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2,
        ).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order")
    )


@query(
    "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM customer JOIN orders ON "
    "c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
)
def star_revenue_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    c, o, l, n = (table(spark, folder, x) for x in ("customer", "orders", "lineitem", "nation"))  # noqa: E741
    # Lines are summed by order before they meet the customers: the join carries a row an order.
    by_order = l.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    joined = o.join(
        by_order, F.col("l_orderkey") == F.col("o_orderkey"),
    ).join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))
