"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source_size copies. Their prefix sum
within the source, plus one offset per source, crosses integer boundaries; each
crossing emits the document once. The order is by size, in steps of a few per
cent, and then by a hash, so that each size class is drawn in proportion and the
words taken stay near the target.

The prefix sum is distributed: rows are counted by (source, size step, slot of
the hash), the counts are summed in order, and rows are numbered within a slot
only. A slot takes as many digits of the hash as it needs to hold about ``SLOT_ROWS``
rows of the largest step of any source, so a source that holds a third of all rows, or
rows of one size, are split however many there are.

Defined cases: a null text has size 0; a source whose words number 0 takes none;
null sources are one source, the last; null ids take part, told apart by their
text; repeated rows are drawn each, in one slot; very long texts count as a whole;
extra columns stay in the stage, but for names with ``_mix_`` in front, which the
operator uses; an empty table gives no row. Reruns agree: offsets and order are
hashes of the seed, the source and the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import cut, table

WEIGHTS = (1, 2, 3)
#: Targets stop at this multiple of what a source has.
MOST = 3
#: Rows of one source and size step that are numbered in one slot, about.
SLOT_ROWS = 20_000
SEED = "mix-1"


def sized(docs: DataFrame) -> DataFrame:
    """Adds the words of the text, the source as a key without nulls, the size step and the hash of the id (without one, of the text)."""
    size = F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")
    return (
        docs.withColumn("_mix_size", size)
        .withColumn("_mix_key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source")))
        .withColumn("_mix_step", F.expr("shiftleft(shiftright(_mix_size, greatest(length(bin(_mix_size)) - 6, 0)), greatest(length(bin(_mix_size)) - 6, 0))"))
        .withColumn("_mix_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))).cast("binary")))
    )


def targets(counts: DataFrame) -> DataFrame:
    """Per source: its size and target. Sources are capped in the order of 3 * size / weight.

    ``counts``: rows by (source key, size step, slot), with their words. Sources
    are taken to be few, as the weights are given by hand.
    """
    sources = counts.groupBy("_mix_key").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.substring("_mix_key", 1, 1).desc(), "_mix_key")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = sources.withColumn("w", weight).withColumn("r", (MOST * F.col("source_size")).cast("double") / F.col("w"))
    by_r = Window.orderBy("r", "_mix_key")
    level = ranked.select(
        "*",
        F.sum("source_size").over(Window.partitionBy(F.lit(1))).alias("total"),
        F.coalesce(F.sum(MOST * F.col("source_size")).over(by_r.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("w").over(by_r.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    ).withColumn("l", (F.col("total") - F.col("capped")).cast("double") / F.col("rest"))
    free = F.min(F.when(F.col("l") <= F.col("r"), F.struct("r", "_mix_key", "l"))).over(Window.partitionBy(F.lit(1)))
    return level.withColumn("level", free["l"]).select("_mix_key", "source_size", F.least((MOST * F.col("source_size")).cast("double"), F.col("level") * F.col("w")).alias("target"))


def offset(key):
    """One offset in [0, 1) per source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), key).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def digits(most: int) -> int:
    """Hexadecimal digits that split so many rows into slots of about SLOT_ROWS."""
    return next(d for d in range(1, 17) if most <= SLOT_ROWS * 16**d)


def copies(docs: DataFrame, narrow: DataFrame | None = None) -> DataFrame:
    """The rows with size, source_size, target and the number of copies, as ``_mix_`` columns.

    ``narrow``: the same rows, if they were sized before, for the counts.
    """
    rows = docs if "_mix_size" in docs.columns else sized(docs)
    narrow = rows if narrow is None else narrow
    most = narrow.groupBy("_mix_key", "_mix_step").count().agg(F.max("count")).first()[0] or 0
    slot = F.substring("_mix_hash", 1, digits(most))
    rows, narrow = rows.withColumn("_mix_slot", slot), narrow.withColumn("_mix_slot", slot)
    at = ["_mix_key", "_mix_step", "_mix_slot"]
    counts = narrow.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.sum("_mix_size").alias("words"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_mix_key").orderBy("_mix_step", "_mix_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts)
    plan = counts.withColumn("before", before).join(targets(counts), "_mix_key")
    plan = cut(plan.select(*at, F.col("before").alias("_mix_before"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"), offset(F.col("_mix_key")).alias("_mix_u")))
    number = F.row_number().over(Window.partitionBy(*at).orderBy("_mix_hash", "_mix_size"))
    out = rows.withColumn("_mix_rank", number).join(plan, at)
    each = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(0.0)
    rank = F.col("_mix_before") + F.col("_mix_rank")
    crossed = F.floor(rank * each + F.col("_mix_u")) - F.floor((rank - 1) * each + F.col("_mix_u"))
    return out.withColumn("_mix_copies", F.least(crossed, F.lit(MOST)).cast("long"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text"))
    return copies(rows).select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    names = docs.columns
    narrow = cut(sized(docs.select("doc_id", "text", "source")).drop("text"))
    mixed = copies(sized(docs), narrow)
    return mixed.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*names)


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS k, md5(coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))) AS h FROM documents),
b AS (SELECT *, greatest(length(bin(size)) - 6, 0) AS s FROM d),
s AS (SELECT k, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY k[1] DESC, k) - 1) % 3 + 1 AS w FROM d GROUP BY k),
r AS (SELECT *, (3 * source_size)::DOUBLE / w AS r FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY r, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY r, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS l FROM r),
v AS (SELECT l AS level FROM l WHERE l <= r ORDER BY r, k LIMIT 1),
t AS (SELECT k, source_size, least((3 * source_size)::DOUBLE, level * w) AS target, ('0x' || substr(md5('{SEED}' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l, v),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (size >> s) << s, h, size) AS rank FROM b),
c AS (SELECT doc_id, size, source_size, target, rank, u, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS e FROM n JOIN t USING (k))
SELECT doc_id, size, source_size, target, size * least(floor(rank * e + u) - floor((rank - 1) * e + u), 3)::BIGINT AS taken FROM c
"""
