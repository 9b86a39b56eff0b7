"""A session for the extended dialect: settings, and sql() that parses, rewrites and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.udfs import register
from tessera.plans.emit import Emitter
from tessera.plans.parser import parse

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "false", "spark.sql.timeType.enabled": "true"}
_READY: set[int] = set()


def prepare(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    if id(spark) not in _READY:
        register(spark)
        _READY.add(id(spark))
    return spark




def translate(sql: str, spark: SparkSession | None = None, dialect: str = "duckdb") -> str:
    """Spark SQL text of a statement; a session is needed where column names are."""
    return Emitter(spark).query(parse(sql, dialect))


def run_sql(spark: SparkSession, sql: str, dialect: str = "duckdb") -> DataFrame:
    return spark.sql(translate(sql, prepare(spark), dialect))


def register_tables(spark: SparkSession, sf_dir: str, names: list[str] = TABLES) -> None:
    """Temporary views over the Parquet tables of a folder."""
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
