"""Catalogs of tables, columns and indexes: JSON snapshots, or Spark's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JSON = (
    "struct<mysqlVersion:string,tables:array<struct<name:string,engine:string,charset:string,rowCountEstimate:bigint,"
    "columns:array<struct<name:string,type:string,length:bigint,nullable:boolean,charset:string>>,"
    "indexes:array<struct<name:string,columns:array<string>,unique:boolean,primary:boolean,subParts:array<int>>>>>>"
)
CATALOG = "name string, charset string, row_estimate bigint, columns array<struct<name:string,type:string,length:bigint,nullable:boolean,charset:string>>, indexes array<struct<name:string,columns:array<string>,unique:boolean,primary:boolean,sub_parts:array<int>>>"


class CatalogError(ValueError):
    pass


def catalog_from_json(spark: SparkSession, text: str) -> DataFrame:
    """A row for each table. All or nothing: what is missing is named. Names are lower-cased, but those of indexes."""
    root = spark.range(1).select(F.from_json(F.lit(text), JSON, {"mode": "PERMISSIVE"}).alias("root")).select("root.*")
    tables = root.select(F.posexplode_outer("tables").alias("i", "t"))
    missing = tables.select(
        F.array_compact(
            F.array(
                F.when(F.col("t").isNull(), F.lit("tables: at least one")),
                F.when(F.col("t").isNotNull() & F.col("t.name").isNull(), F.concat(F.lit("tables."), "i", F.lit(".name"))),
                F.when(F.col("t").isNotNull() & (F.coalesce(F.size("t.columns"), F.lit(-1)) < 1), F.concat(F.lit("tables."), "i", F.lit(".columns: at least one"))),
                F.when(F.exists("t.columns", lambda c: c["name"].isNull() | c["type"].isNull()), F.concat(F.lit("tables."), "i", F.lit(".columns: name and type"))),
                F.when(F.col("t").isNotNull() & F.col("t.indexes").isNull(), F.concat(F.lit("tables."), "i", F.lit(".indexes"))),
                F.when(F.exists("t.indexes", lambda x: x["name"].isNull() | (F.coalesce(F.size(x["columns"]), F.lit(-1)) < 1)), F.concat(F.lit("tables."), "i", F.lit(".indexes: name and at least one part"))),
            )
        ).alias("missing")
    )
    wrong = [m for r in missing.collect() for m in r["missing"]]  # as many rows as the catalog has tables
    if wrong:
        raise CatalogError("; ".join(wrong))
    columns = F.transform("t.columns", lambda c: F.struct(F.lower(c["name"]).alias("name"), F.lower(c["type"]).alias("type"), c["length"].alias("length"), c["nullable"].alias("nullable"), c["charset"].alias("charset")))
    indexes = F.transform("t.indexes", lambda x: F.struct(x["name"].alias("name"), F.transform(x["columns"], F.lower).alias("columns"), F.coalesce(x["unique"], F.lit(False)).alias("unique"), F.coalesce(x["primary"], F.lit(False)).alias("primary"), x["subParts"].alias("sub_parts")))
    known = tables.select(F.lower("t.name").alias("name"), F.coalesce("t.charset", F.lit("utf8mb4")).alias("charset"), F.col("t.rowCountEstimate").alias("row_estimate"), columns.alias("columns"), indexes.alias("indexes"))
    return spark.createDataFrame(known.collect(), CATALOG)  # rows instead of the whole text in every plan


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot file, read as a whole."""
    text = spark.read.format("text").option("wholetext", True).load(path).first()
    return catalog_from_json(spark, text["value"] if text else "{}")


def no_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOG)


def catalog_of_information_schema(tables: DataFrame, columns: DataFrame, statistics: DataFrame) -> DataFrame:
    """A catalog from rows as information_schema has them: TABLES (table_name, table_collation, table_rows), COLUMNS (table_name, column_name, ordinal_position,
    data_type, character_maximum_length, is_nullable, character_set_name) and STATISTICS (table_name, index_name, seq_in_index, column_name, sub_part, non_unique).

    A part without column_name is an expression. Names are lower-cased, but those of indexes; parts and columns keep their order.
    """
    name = F.lower("table_name").alias("name")
    cs = F.struct(F.lower("column_name").alias("name"), F.lower("data_type").alias("type"), F.col("character_maximum_length").cast("long").alias("length"), (F.upper("is_nullable") == "YES").alias("nullable"), F.col("character_set_name").alias("charset"))
    in_order = lambda item: F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"])
    listed = columns.groupBy(name).agg(in_order(F.struct("ordinal_position", cs.alias("value"))).alias("columns"))
    parts = statistics.groupBy(name, "index_name").agg(
        in_order(F.struct("seq_in_index", F.struct(F.lower("column_name").alias("c"), F.col("sub_part").cast("int").alias("p")).alias("value"))).alias("parts"), F.max("non_unique").alias("non_unique")
    )
    index = F.struct(
        F.col("index_name").alias("name"), F.transform("parts", lambda p: p["c"]).alias("columns"), (F.col("non_unique") == 0).alias("unique"), (F.upper("index_name") == "PRIMARY").alias("primary"), F.transform("parts", lambda p: p["p"]).alias("sub_parts")
    )
    # the primary key first, as the server keeps it, then by name
    indexes = parts.select("name", F.struct((F.upper("index_name") != "PRIMARY").alias("later"), F.col("index_name").alias("i"), index.alias("value")).alias("x")).groupBy("name").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["value"]).alias("indexes"))
    known = tables.select(name, F.coalesce(F.split("table_collation", "_")[0], F.lit("utf8mb4")).alias("charset"), F.col("table_rows").cast("long").alias("row_estimate"))
    none = F.array().cast("array<struct<name:string,columns:array<string>,unique:boolean,primary:boolean,sub_parts:array<int>>>")
    return known.join(listed, "name").join(indexes, "name", "left").select("name", "charset", "row_estimate", "columns", F.coalesce("indexes", none).alias("indexes"))


def catalog_json(catalog: DataFrame) -> DataFrame:
    """A row `value` of JSON for each table, in the form that catalog_from_json() takes between the brackets of "tables"."""
    indexes = F.transform("indexes", lambda x: F.struct(x["name"].alias("name"), x["columns"].alias("columns"), x["unique"].alias("unique"), x["primary"].alias("primary"), x["sub_parts"].alias("subParts")))
    return catalog.select(F.to_json(F.struct("name", "charset", F.col("row_estimate").alias("rowCountEstimate"), "columns", indexes.alias("indexes")), {"ignoreNullFields": "false"}).alias("value"))


def catalog_of_tables(tables: dict[str, DataFrame], primary: dict[str, list[str]] | None = None) -> str:
    """A JSON snapshot of DataFrames' schemas, with the given primary keys, in the order of names."""
    import json

    kinds = {"string": ("varchar", 255), "int": ("int", None), "bigint": ("bigint", None), "double": ("double", None), "timestamp": ("datetime", None), "timestamp_ntz": ("datetime", None), "date": ("date", None)}
    out = []
    for name, df in sorted(tables.items()):
        columns = [{"name": c, "type": kinds.get(k, ("text", None))[0], "length": kinds.get(k, ("text", None))[1]} for c, k in df.dtypes]
        keys = (primary or {}).get(name)
        out.append({"name": name, "columns": columns, "indexes": [{"name": "PRIMARY", "columns": keys, "unique": True, "primary": True}] if keys else []})
    return json.dumps({"tables": out})
