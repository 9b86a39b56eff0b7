"""File readers behind the table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_files(spark: SparkSession, kind: str, path: str, options: dict[str, str] | None = None) -> DataFrame:
    given = {k: v for k, v in (options or {}).items()}
    if kind == "csv":
        base = {"header": "true", "inferSchema": "true"}
        if "delim" in given:
            given["sep"] = given.pop("delim")
        return spark.read.options(**{**base, **given}).csv(path)
    if kind == "text":
        return spark.read.option("wholetext", "true").text(path)
    return spark.read.format(kind).options(**given).load(path)


def jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table behind JDBC; with a partition column it is read in `partitions` ranges at once."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        r = r.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return r.load()
