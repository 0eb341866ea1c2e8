"""The checks that advice rests on, run on real tables: equal rewrites, equal pages, selectivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(df: DataFrame, before: Column, after: Column, key: str) -> DataFrame:
    """n_before, n_after, n_differ of the rows that two predicates choose: one scan, no join, since both are columns of the same row."""
    chosen = df.select(F.coalesce(before, F.lit(False)).alias("x"), F.coalesce(after, F.lit(False)).alias("y"))
    return chosen.agg(F.count_if("x").alias("n_before"), F.count_if("y").alias("n_after"), F.count_if(F.col("x") != F.col("y")).alias("n_differ"))


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that only one of two results has, for results of different queries."""
    return a.select(*keys, F.lit(1).alias("side")).join(b.select(*keys), keys, "left_anti").unionByName(b.select(*keys, F.lit(2).alias("side")).join(a.select(*keys), keys, "left_anti"))


def page_by_offset(df: DataFrame, order: list[Column], offset: int, rows: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(rows)


def page_by_join(df: DataFrame, key: str, order: list[Column], offset: int, rows: int, *sort_columns: str) -> DataFrame:
    """The deferred join: the page is found on its key and sort columns alone, and only its rows are read whole."""
    page = df.select(key, *sort_columns).orderBy(*order).offset(offset).limit(rows).select(key)
    return df.join(F.broadcast(page), key)  # a page is as long as `rows` says


def page_after(df: DataFrame, sort: str, key: str, last_sort, last_key, rows: int) -> DataFrame:
    """The keyset form, for a falling sort column and key: what comes after the last row of the page before."""
    behind = (F.col(sort) < F.lit(last_sort)) | (F.col(sort) == F.lit(last_sort)) & (F.col(key) < F.lit(last_key))
    return df.where(behind).orderBy(F.desc(sort), F.desc(key)).limit(rows)


def prefix_selectivity(df: DataFrame, column: str, chars: int) -> DataFrame:
    return df.agg((F.countDistinct(F.substring(column, 1, chars)) / F.countDistinct(column)).alias("ratio"))


def selectivity(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct tuples without nulls for each row."""
    return df.agg((F.countDistinct(*columns) / F.count("*")).alias("ratio"))


def union_of_alternatives(df: DataFrame, *alternatives: Column) -> DataFrame:
    """The rows that any of the conditions chooses, once each: a branch for every condition, without what the branches before have, so that each can use an index or partition of its own."""
    out, before = None, F.lit(False)
    for condition in alternatives:
        held = F.coalesce(condition, F.lit(False))
        branch = df.where(held & ~before)
        out = branch if out is None else out.unionByName(branch)
        before = before | held
    return df.limit(0) if out is None else out


def with_match(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """EXISTS: the rows that have a match, once each."""
    return df.join(other, on, "left_semi")


def without_match(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """NOT EXISTS: the rows without a match; a null key matches nothing."""
    return df.join(other, on, "left_anti")
