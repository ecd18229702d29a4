"""Streaming ingestion: file versions that land in a folder keep a table current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.operators.store import Store, checkpointed, latest, upsert
from fathom.plans.index import build
from fathom.schema import FILES


def landing(spark: SparkSession, folder: str, schema: str = FILES, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def keep_current(stream: DataFrame, st: Store, table: str, schema: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Upserts each batch into a stored table by key; the last row by ``order`` counts, in whatever batch it comes."""

    def merge(batch: DataFrame, _: int) -> None:
        st.commit({table: latest(st.read(table, schema).unionByName(batch), [key], [F.col(order)])})

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(stream: DataFrame, st: Store, checkpoint: str) -> StreamingQuery:
    """Indexes files as they land; files not in a batch stay as they were."""

    def merge(batch: DataFrame, _: int) -> None:
        new = latest(batch, ["file_path"], [F.col("content_hash")])
        files = checkpointed(upsert(st.read("files", FILES), new, "file_path"))
        build(files, st, also={"files": files})

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
