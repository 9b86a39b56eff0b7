"""What the session's catalog holds, behind the table functions of that kind; sizes are those of the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _listed(spark: SparkSession):
    """(schema, table) of all tables and views, temporary ones under the current schema."""
    for db in spark.catalog.listDatabases():
        for t in spark.catalog.listTables(db.name):
            yield (t.namespace[-1] if t.namespace else ""), t


def duckdb_tables(spark: SparkSession) -> DataFrame:
    rows = sorted({(s, t.name, bool(t.isTemporary)) for s, t in _listed(spark) if t.tableType not in ("VIEW", "TEMPORARY")})
    return spark.createDataFrame(rows, "schema_name string, table_name string, temporary boolean")


def duckdb_views(spark: SparkSession) -> DataFrame:
    rows = sorted({(s, t.name, bool(t.isTemporary)) for s, t in _listed(spark) if t.tableType in ("VIEW", "TEMPORARY")})
    return spark.createDataFrame(rows, "schema_name string, view_name string, temporary boolean")


def duckdb_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name, d.description or "") for d in spark.catalog.listDatabases()], "schema_name string, comment string")


def duckdb_columns(spark: SparkSession) -> DataFrame:
    rows = {}
    for s, t in _listed(spark):
        name = f"`{s}`.`{t.name}`" if s else f"`{t.name}`"
        for i, c in enumerate(spark.table(name).schema.fields):
            rows[s, t.name, i] = (s, t.name, c.name, i + 1, c.dataType.simpleString(), c.nullable)
    return spark.createDataFrame([rows[k] for k in sorted(rows)], "schema_name string, table_name string, column_name string, column_index int, data_type string, is_nullable boolean")


def duckdb_settings(spark: SparkSession) -> DataFrame:
    return spark.sql("SET -v").selectExpr("key AS name", "value", "meaning AS description")


def duckdb_functions(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW FUNCTIONS").selectExpr("function AS function_name")


def glob(spark: SparkSession, pattern: str) -> DataFrame:
    """The files that a pattern matches, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    rows = sorted(str(x.getPath().toString()).removeprefix("file:") for x in found or [] if x.isFile())
    return spark.createDataFrame([(r,) for r in rows], "file string")


METADATA: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (duckdb_tables, duckdb_views, duckdb_schemas, duckdb_columns, duckdb_settings, duckdb_functions, glob)}
