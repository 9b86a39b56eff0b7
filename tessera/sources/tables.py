"""Seeds and materialisations: tables, views and incremental models in the session catalog.

A table is written beside the old one and swapped by renames, so readers never see a half-written table. The old
one is dropped last: a failed swap puts it back, and one that was cut off is put back by the next use. The work of
writing is Spark's; no rows pass through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_name(name: str, default: str = "default") -> tuple[str, str]:
    db, _, table = name.rpartition(".")
    return db or default, table


def ensure_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{split_name(name)[0]}`")


def quoted(name: str) -> str:
    db, table = split_name(name)
    return f"`{db}`.`{table}`"


def drop(spark: SparkSession, name: str) -> None:
    db, table = split_name(name)
    if spark.catalog.tableExists(f"{db}.{table}"):
        kind = spark.catalog.getTable(f"{db}.{table}").tableType
        spark.sql(f"DROP {'VIEW' if kind == 'VIEW' else 'TABLE'} {quoted(name)}")


def _is_there(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(".".join(split_name(name)))


def exists(spark: SparkSession, name: str) -> bool:
    """Whether there is such a table or view; puts back a table whose swap was cut off between its renames."""
    db, table = split_name(name)
    if _is_there(spark, name):
        return True
    if _is_there(spark, f"{db}.{table}__old"):
        spark.sql(f"ALTER TABLE {quoted(f'{db}.{table}__old')} RENAME TO {quoted(name)}")
        return True
    return False


def write_table(spark: SparkSession, df: DataFrame, name: str) -> None:
    ensure_database(spark, name)
    db, table = split_name(name)
    staging = f"{db}.{table}__new"
    drop(spark, staging)
    df.write.format("parquet").saveAsTable(staging)
    old = f"{db}.{table}__old"
    if exists(spark, name):
        drop(spark, old)
        if spark.catalog.getTable(f"{db}.{table}").tableType == "VIEW":
            drop(spark, name)
        else:
            spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(old)}")
    try:
        spark.sql(f"ALTER TABLE {quoted(staging)} RENAME TO {quoted(name)}")
    except Exception:
        exists(spark, name)
        raise
    drop(spark, old)


def write_view(spark: SparkSession, sql: str, name: str) -> None:
    ensure_database(spark, name)
    if exists(spark, name) and spark.catalog.getTable(".".join(split_name(name))).tableType != "VIEW":
        drop(spark, name)
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(name)} AS {sql}")


def upsert(spark: SparkSession, new: DataFrame, name: str, keys: list[str]) -> int:
    """Rows of the table whose key isn't in the batch, then the batch, columns by position; the rows of the batch.

    The batch is written once, beside the table, so a model that reads the table itself is run once and before it
    changes. A null key deletes nothing and duplicates in the batch are kept, as a delete and insert would do.
    """
    old = spark.table(quoted(name))
    batch = new.toDF(*old.columns) if len(new.columns) == len(old.columns) else new
    if batch is new:
        raise ValueError(f"{name} has {len(old.columns)} columns, the batch {len(new.columns)}")
    batch = batch.select(*[F.col(f"`{c}`").cast(old.schema[c].dataType).alias(c) for c in old.columns])
    staged = "{}.{}__batch".format(*split_name(name))
    drop(spark, staged)
    batch.write.format("parquet").saveAsTable(staged)
    batch = spark.table(quoted(staged))
    try:
        n = batch.count()
        kept = old.join(batch.select(*keys).distinct(), keys, "left_anti").select(*old.columns)
        write_table(spark, kept.unionAll(batch), name)
    finally:
        drop(spark, staged)
    return n


def append(spark: SparkSession, new: DataFrame, name: str) -> None:
    old = spark.table(quoted(name))
    if len(new.columns) != len(old.columns):
        raise ValueError(f"{name} has {len(old.columns)} columns, the batch {len(new.columns)}")
    new.toDF(*old.columns).write.insertInto(".".join(split_name(name)))


def load_seeds(spark: SparkSession, folder: str, database: str = "default", infer: bool = True) -> dict[str, int]:
    """Each CSV file of a folder (not of its subfolders) becomes a table named after it; all text unless `infer`."""
    out = {}
    for f in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if f.lower().endswith(".csv"):
            df = spark.read.csv(os.path.join(folder, f), header=True, inferSchema=infer)
            name = f"{database}.{f[:-4]}"
            write_table(spark, df, name)
            out[name] = spark.table(quoted(name)).count()
    return out


def table_metadata(spark: SparkSession, name: str) -> dict:
    db, table = split_name(name)
    columns = [{"name": c.name, "type": c.dataType, "nullable": c.nullable, "position": i} for i, c in enumerate(spark.catalog.listColumns(f"{db}.{table}"))]
    return {"schema": db, "name": table, "columns": columns, "row_count": spark.table(quoted(name)).count()}
