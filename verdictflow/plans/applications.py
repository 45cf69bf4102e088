"""Applications made from the order table, one per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.schemas import APPLICATION_FILE_SCHEMA

_USED = {
    "_c0": "CASE WHEN o_totalprice >= 400000 THEN 'A13' WHEN o_orderstatus = 'F' THEN 'A11' "
    "WHEN o_orderstatus = 'O' THEN 'A12' ELSE 'A14' END",
    "_c1": "CAST(4 + o_orderkey % 69 AS INT)",
    "_c2": "concat('A3', CAST(substr(o_orderpriority, 1, 1) AS INT) - 1)",
    "_c3": "concat('A4', o_custkey % 11)",
    "_c4": "o_totalprice / 25",
    "_c20": "CASE WHEN o_custkey % 10 < 3 THEN 2 ELSE 1 END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coded_applications(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    """Order key and the 21 fields of an application file.

    The purposes include two codes without a label; amounts have a fraction. With
    ``tasks`` given, the rows are dealt over as many tasks while they are narrow.
    """
    unused = {
        f.name: f"concat('A', {i}, 1 + o_custkey % 4)" if f.dataType.typeName() == "string" else "CAST(1 + o_custkey % 4 AS INT)"
        for i, f in enumerate(APPLICATION_FILE_SCHEMA)
    }
    fields = {**unused, **_USED}
    orders = table(spark, sf_dir, "orders")
    orders = orders.repartition(tasks) if tasks else orders
    return orders.select("o_orderkey", *[F.expr(e).alias(n) for n, e in fields.items()])
