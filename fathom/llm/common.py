"""What the operators of this subpackage share: tables, batches, checkpoints, words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a Python worker gets at a time: bytes bound a batch of very long texts.
BATCH_ROWS, BATCH_BYTES = 20_000, 4 << 20
#: Bytes that count as white space between words.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and a shared checkpoint folder (see shared_dir)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, else the context's checkpoint folder; without either a temporary one, on a single machine only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="fathom-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows go to the shared folder, where a lost executor doesn't matter."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """As cut(), but as a compressed table, for many or wide rows, in folders by some columns; also gives its path, for dropped()."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def in_groups(batches: Iterable[pa.RecordBatch], nbytes: int) -> Iterator[pa.Table]:
    """Joins small batches to tables of about ``nbytes``, for vectorised work."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= nbytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def identity(docs: DataFrame) -> DataFrame:
    """Adds _fathom_did and _fathom_th: which row a text is, by its id and the 64 bits of its hash (by the hash alone where the id is null)."""
    h = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("_fathom_th", h).withColumn("_fathom_did", F.coalesce(F.col("doc_id").cast("long"), h))


def release() -> None:
    """Gives memory that earlier tasks of this worker freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(value: str | None) -> bytes:
    """The text's UTF-8 bytes; null is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: What str.split() takes for white space beyond the six ASCII characters.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORDS = re.compile(WORD)


def words_of(text: str) -> list[str]:
    """Words between the six ASCII white-space characters, and no others."""
    return _WORDS.findall(text) if _ODD.search(text) else text.split()
