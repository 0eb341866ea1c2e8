"""Generated tables to try advice on: a small shop of any size, and the rows on which rewrites of predicates are held against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_735_689_600) - seconds)


def shop(spark: SparkSession, orders: int = 200_000) -> dict[str, DataFrame]:
    """orders, order_item (two each), users (a tenth as many) and user_address (three for each user and thirty), from row numbers alone, so they are the same each time."""
    i = F.col("id")
    users = max(1, orders // 10)
    return {
        "orders": spark.range(1, orders + 1).select(
            "id", (i * 7919 % users + 1).alias("user_id"), (i * 31 % 500 + 1).alias("shop_id"), F.concat(F.lit("NO"), F.lpad(i.cast("string"), 12, "0")).alias("order_no"),
            _pick(["PAID", "NEW", "SENT", "DONE", "CANCELLED"], i), (i * 13 % 100000 / 100).cast("decimal(12,2)").alias("amount"), F.when(i % 9 == 0, F.concat(F.lit("remark "), i.cast("string"))).alias("remark"),
            _at(i * 97 % 31_536_000).alias("create_time"), F.when(i % 5 != 1, _at(i * 97 % 31_536_000 - 60)).alias("pay_time"),
        ).toDF("id", "user_id", "shop_id", "order_no", "status", "amount", "remark", "create_time", "pay_time"),
        "order_item": spark.range(1, 2 * orders + 1).select("id", F.ceil(i / 2).alias("order_id"), (i * 17 % 5000 + 1).alias("sku_id"), (i % 4 + 1).cast("int").alias("quantity"), (i * 29 % 20000 / 100).cast("decimal(12,2)").alias("price")),
        "users": spark.range(1, users + 1).select("id", F.concat(F.lit("1"), F.lpad((i * 7 % 10_000_000_000).cast("string"), 10, "3")).alias("mobile"), F.concat(F.lit("user"), i.cast("string")).alias("name"), (i % 6).cast("int").alias("level"), _at(i * 311 % 94_608_000).alias("create_time")),
        "user_address": spark.range(1, 3 * users + 31).select("id", (i * 3 % users + 1).alias("user_id"), _pick(["north", "south", "east", "west", "centre"], i).alias("city"), F.concat(F.lit("street "), (i % 900).cast("string")).alias("detail"), (i % 3 == 0).cast("int").alias("is_default")),
    }


def edge_rows(spark: SparkSession) -> DataFrame:
    """k, code, amount, made: ends of days, months and years, a leap day, wildcards, blanks and nulls."""
    rows = [
        (1, "ab", "5.00", "2024-02-29 00:00:00"), (2, "abc", "4.00", "2024-02-29 23:59:59"), (3, "a%", "6.00", "2024-03-01 00:00:00"), (4, "a_c", "-5.00", "2023-12-31 23:59:59"), (5, "AB", "5.50", "2024-01-01 00:00:00"),
        (6, None, None, None), (7, "", "0.00", "2024-12-31 12:00:00"), (8, "ab ", "5.00", "2025-01-01 00:00:00"), (9, "a'b", "10.00", "1999-12-31 23:59:59"), (10, "ba", "4.99", "2024-02-28 23:59:59"),
    ]
    return spark.createDataFrame(rows, "k long, code string, amount string, made string").select("k", "code", F.col("amount").cast("decimal(10,2)").alias("amount"), F.to_timestamp("made").alias("made"))
