"""Compressed JSON-lines message logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Message type codes and their names; other codes keep their number.
MSG_TYPES = {
    14: "ERROR",
    24: "STATUS",
    35: "CHARGE",
    37: "CHARGE",
    38: "CHARGE",
    40: "DCIR",
    41: "DCIR_VALUE",
    42: "DISCHARGE",
    43: "REST",
    46: "CHARGE",
    50: "WAVEFORM_CURRENT",
    51: "WAVEFORM_VOLTAGE",
    54: "CHARGE",
    59: "PACK_DATA",
    61: "OLIP_STATE",
    63: "ICA",
}


def msg_type_name(code):
    m = F.create_map(*[x for k, v in MSG_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(code).cast("int")], F.col(code).cast("string"))


def parse_log(df: DataFrame, sort: bool = True) -> DataFrame:
    """Flatten the nested ``data`` object into columns and name the message types."""
    d = df.select("*", "data.*").drop("data") if "data" in df.columns else df
    d = d.withColumn("msg_type", msg_type_name("msg_type"))
    return d.orderBy("time_stamp") if sort else d


def read_log(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sort: bool = True) -> DataFrame:
    """JSON lines (``.bz2`` / ``.gz`` decompressed by the source), one message per line."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return parse_log(r.json(path), sort=sort)
