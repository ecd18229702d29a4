"""Parents and children: links, levels, dirty propagation, context, roll-up of summaries.

Trees are shallow (file, class, function, chunk), so loops run a few joins; each
round is cut by a checkpoint, which executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import file_id


def link_orphans(snippets: DataFrame) -> DataFrame:
    """Rows whose parent is no row get their file as parent; the parent's signature comes along. Files keep none."""
    s = snippets.drop("parent_signature")
    known = snippets.select(F.col("id").alias("_id"))
    parent = F.when(F.col("type") == "file", F.lit(None)).when(F.col("_id").isNull(), file_id(F.col("file_path"))).otherwise(F.col("parent_id"))
    linked = s.join(known, F.col("parent_id") == F.col("_id"), "left").withColumn("parent_id", parent).drop("_id")
    signatures = snippets.select(F.col("id").alias("_id"), F.col("signature").alias("parent_signature"))
    return linked.join(signatures, F.col("parent_id") == F.col("_id"), "left").drop("_id").select(*snippets.columns)


def propagate_context(snippets: DataFrame) -> DataFrame:
    """parent_summary: the direct parent's summary."""
    p = snippets.select(F.col("id").alias("_id"), F.col("summary").alias("_s"))
    return snippets.join(p, F.col("parent_id") == F.col("_id"), "left").withColumn("parent_summary", F.coalesce("parent_summary", "_s")).drop("_id", "_s").select(*snippets.columns)


def children_lines(snippets: DataFrame) -> DataFrame:
    """parent_id and the "name: summary" lines of its children, by name and id; children without summary give none."""
    kids = snippets.where("parent_id IS NOT NULL AND parent_id <> id AND summary IS NOT NULL AND summary <> ''")
    known = snippets.select(F.col("id").alias("_id"))
    kept = kids.join(known, F.col("parent_id") == F.col("_id"), "left_semi")
    listed = kept.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("name", "id", F.concat_ws(": ", "name", "summary").alias("line")))).alias("l"))
    return listed.select("parent_id", F.col("l.line").alias("lines"))


def in_degree(rows: DataFrame) -> DataFrame:
    return rows.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"))


def heights(rows: DataFrame) -> DataFrame:
    """id and its height over its farthest leaf: the order in which summaries roll up. Rows in a cycle have none."""
    tree = rows.select("id", "parent_id").checkpoint()
    done = tree.join(tree.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(0).alias("height")).checkpoint()
    while True:
        open_ = tree.join(done, "id", "left_anti")
        kids = tree.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("p"), F.col("id").alias("kid")).join(done.select(F.col("id").alias("kid"), "height"), "kid", "left")
        ready = kids.groupBy("p").agg(F.count_if(F.col("height").isNull()).alias("missing"), F.max("height").alias("h")).where("missing = 0")
        new = open_.join(ready, F.col("id") == F.col("p")).select("id", (F.col("h") + 1).alias("height")).checkpoint()
        if new.isEmpty():
            return done
        done = done.union(new).checkpoint()


def dirty_closure(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed ids and all their ancestors."""
    tree = rows.select("id", "parent_id").checkpoint()
    found = front = changed.select("id").distinct().checkpoint()
    while not front.isEmpty():
        up = tree.join(front, "id", "left_semi").where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
        front = up.join(tree, "id", "left_semi").join(found, "id", "left_anti").checkpoint()
        found = found.union(front).checkpoint()
    return found


def roll_up(snippets: DataFrame, changed: DataFrame, summarise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Summaries from the leaves upwards; redone for changed rows, rows without one, and their ancestors.

    ``summarise(rows with id, name, type, content, docstring, signature, lines) -> (id, summary)``.
    """
    level = heights(snippets)
    need = snippets.where("summary IS NULL OR summary = ''").select("id").union(changed.select("id"))
    dirty = dirty_closure(snippets, need)
    known = snippets.select("id", "parent_id", "name", "summary").checkpoint()
    top = level.agg(F.max("height")).first()[0]
    for h in range((top if top is not None else -1) + 1):
        rows = snippets.join(level.where(F.col("height") == h), "id", "left_semi").join(dirty, "id", "left_semi")
        new = summarise(rows.join(children_lines(known).withColumnRenamed("parent_id", "_p"), F.col("id") == F.col("_p"), "left").drop("_p"))
        new = new.select(F.col("id").alias("_id"), F.col("summary").alias("_s")).checkpoint()
        known = known.join(new, F.col("id") == F.col("_id"), "left").select("id", "parent_id", "name", F.coalesce("_s", "summary").alias("summary")).checkpoint()
    s = known.select(F.col("id").alias("_id"), F.col("summary").alias("_s"))
    return snippets.join(s, F.col("id") == F.col("_id"), "left").withColumn("summary", F.col("_s")).select(*snippets.columns)
