"""Job 1, incremental: keeps an inverted index current with the document files that land in a folder.

    python -m jobs.index_refresh --config jobs/index_refresh.json source=/data/docs target=/data/index checkpoint=/data/index-checkpoint

A file stream takes the files that its checkpoint hasn't seen, some per batch, and ends
when there are none left. A batch becomes a segment of the index (fathom.operators.postings), whose
number is the batch's: postings in folders by segment and bucket, rows and
dead rows by segment, and last the sums in ``stats``, without which a segment doesn't count. A batch that is
run again after a failure has the same files and overwrites the same partitions.

A document replaces the one of its id from former batches; one with a null text takes it
away. Of several in a batch the one with the greatest ``order`` column stays, then that of the
greatest text. Rows without an id can't be indexed, and are counted in the log.

Cost per run: the new files' texts once for the postings and once for their hashes and lengths, and the ids of the
index once, to find the rows that are replaced. Former segments aren't rewritten.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.operators import postings
from fathom.operators.store import checkpointed, prepared
from jobs.common import main, read_or_none

log = logging.getLogger("jobs.index_refresh")
SCHEMA = "doc_id long, text string"
FIELDS = ("content",)
PARTS = {"postings": (postings.POSTINGS, ["segment", "bucket"]), "rows": (postings.ROWS, ["segment"]), "gone": (postings.GONE, ["segment"]), "stats": (postings.STATS, ["segment"])}


def open_index(spark: SparkSession, target: str, id_type: str = "long", before: int | None = None) -> postings.Index | None:
    """The stored index, of the segments before a number if one is given; None where there is none yet."""
    stats = read_or_none(spark, f"{target}/stats", PARTS["stats"][0])
    if stats is None:
        return None
    if before is not None:
        stats = stats.where(F.col("segment") < before)
    whole = [r["segment"] for r in stats.select("segment").distinct().collect()]  # one row per segment
    if not whole:
        return None

    def part(name: str) -> DataFrame:
        schema = PARTS[name][0].format(id=id_type)
        schema += ", segment int"
        df = read_or_none(spark, f"{target}/{name}", schema)
        df = spark.createDataFrame([], schema) if df is None else df
        return df.where(F.col("segment").isin(whole))

    return postings.Index(part("postings"), part("rows"), part("gone"), stats, FIELDS)


def one_or_many(path: str) -> str:
    """A file stream takes a folder or a pattern: of a path that may be a single file, the pattern that matches just that."""
    return f"{path[:-1]}[{path[-1]}]" if path.endswith(".parquet") else path


def _write(df: DataFrame, target: str, name: str, segment: int) -> None:
    rows = df.drop("segment").withColumn("segment", F.lit(segment))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS[name][1]).parquet(f"{target}/{name}")


def refresh(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = SCHEMA, id_column: str = "doc_id", text_column: str = "text", order: str | None = None, files_per_batch: int = 100) -> dict:
    """Brings the index at ``target`` up to the files at ``source``; gives what it read and wrote."""
    prepared(spark)
    done = {"batches": 0, "documents": 0, "removed": 0, "without_id": 0}
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(one_or_many(source))
    id_type = files.schema[id_column].dataType.simpleString()
    columns = [F.col(id_column).alias("id"), F.col(text_column).alias("content"), (F.col(order) if order else F.lit(0)).alias("order")]

    def take(batch: DataFrame, number: int) -> None:
        given = batch.select(*columns)
        new = last_of(given.where("id IS NOT NULL"))
        kept = new.where("content IS NOT NULL")
        made = postings.postings_of(kept, FIELDS, None)
        _write(made, target, "postings", number)
        _write(postings.rows_of(kept, FIELDS), target, "rows", number)
        rows = spark.read.schema(PARTS["rows"][0].format(id=id_type) + ", segment int").parquet(f"{target}/rows").where(F.col("segment") == number)
        former = open_index(spark, target, id_type, before=number)
        if former is not None:
            _write(postings.replaced(new, postings.live_rows(former.rows, former.gone)), target, "gone", number)
        sums = postings.stats_of(number, rows)
        _write(sums, target, "stats", number)
        counts = given.agg(F.count_if(F.col("id").isNull()).alias("without_id"), F.count_if(F.col("id").isNotNull() & F.col("content").isNull()).alias("removed")).first()
        n = spark.read.schema(PARTS["stats"][0]).parquet(f"{target}/stats").where(F.col("segment") == number).first()["n"]
        done.update(batches=done["batches"] + 1, documents=done["documents"] + n, removed=done["removed"] + counts["removed"], without_id=done["without_id"] + counts["without_id"])
        log.info("batch %d: %d documents indexed, %d removals, %d rows without an id left out", number, n, counts["removed"], counts["without_id"])

    log.info("reading new files of %s", source)
    stream = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("wrote %s to %s", done, target)
    return done


def last_of(rows: DataFrame) -> DataFrame:
    """id and content, each id once. Only texts of ids that are there more than once are shuffled."""
    twice = checkpointed(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if twice.isEmpty():
        return rows.select("id", "content")
    last = Window.partitionBy("id").orderBy(F.desc_nulls_last("order"), F.desc_nulls_last("content"))
    some = rows.join(twice, "id", "left_semi").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return rows.join(twice, "id", "left_anti").select("id", "content").union(some.select("id", "content"))


def live_postings(spark: SparkSession, target: str, id_type: str = "long") -> DataFrame:
    """What the index holds: id, term, tf, dl, first_position."""
    index = open_index(spark, target, id_type)
    if index is None:
        return spark.createDataFrame([], f"id {id_type}, term string, tf long, dl long, first_position long")
    return index.live().select("id", "term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"), F.col("positions")[0].cast("long").alias("first_position"))


if __name__ == "__main__":
    main("index_refresh", __doc__, refresh)
