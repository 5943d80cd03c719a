"""Table and file sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from packspark.sources.files import file_format


def database_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.databaseExists(name)


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{loc}")


def write_table(df: DataFrame, table: str, database: str | None = None, if_exists: str = "replace",
                fmt: str = "parquet", partition_by=None) -> str:
    """Replace or append a catalog table (the database is created when absent)."""
    mode = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}[if_exists]
    name = table
    if database:
        ensure_database(df.sparkSession, database)
        name = f"`{database}`.`{table}`"
    if mode == "overwrite" and df.sparkSession.catalog.tableExists(name):
        _replace_table(df, name, table, database, fmt, partition_by)
    else:
        _save(df, name, mode, fmt, partition_by)
    return name


def _save(df: DataFrame, name: str, mode: str, fmt: str, partition_by) -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.saveAsTable(name)


def _replace_table(df: DataFrame, name: str, table: str, database: str | None, fmt: str, partition_by) -> None:
    """Staged replace: the new rows go to a table of their own, which then takes the name.  A load that fails leaves
    the old table as it was, and ``df`` may read the table it replaces."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex[:12]
    staged, old = (f"`{database}`.`{table}_{k}_{mark}`" if database else f"`{table}_{k}_{mark}`" for k in ("new", "old"))
    try:
        _save(df, staged, "errorifexists", fmt, partition_by)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    except Exception:
        spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    spark.sql(f"DROP TABLE {old}")


def write_jdbc(df: DataFrame, url: str, table: str, if_exists: str = "replace", properties: dict | None = None) -> None:
    mode = {"replace": "overwrite", "append": "append"}[if_exists]
    df.write.jdbc(url, table, mode=mode, properties=properties or {})


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """File export (CSV with header, or parquet) in place of a spreadsheet."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def load_file_to_table(spark: SparkSession, path: str, table: str, database: str | None = None,
                       if_exists: str = "replace", schema=None, fmt: str | None = None) -> str:
    """Load a file or folder of CSV or parquet into a catalog table (database created when absent)."""
    if file_format(path, fmt) == "csv":
        r = spark.read.option("header", True)
        df = (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)
    else:
        df = spark.read.parquet(path)
    return write_table(df, table, database=database, if_exists=if_exists)
