"""Message logs as a stream: the same flatten + name mapping on ``readStream``.

The parse is stateless, so each micro-batch is processed independently; ordering by
time is a batch-side concern (sort the sink table when reading it).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from packspark.sources.logs import parse_log


def stream_log(spark: SparkSession, path: str, schema: T.StructType | str, sink: str, query_name: str = "logs",
               checkpoint: str | None = None, options: dict | None = None) -> StreamingQuery:
    """Start a streaming parse of JSON-lines logs arriving under ``path``."""
    src = spark.readStream.schema(schema).json(path)
    w = parse_log(src, sort=False).writeStream.queryName(query_name).format(sink).outputMode("append")
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    return w.start()
