"""Relations between snippets: symbols, containers, edges, placeholders, neighbours.

Interval joins carry the file as an equality, so they are hash joins with a
residual condition, and no file's spans meet another's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import file_id
from fathom.schema import SYMBOL_TYPES


def symbol_table(snippets: DataFrame, types: tuple[str, ...] = SYMBOL_TYPES) -> DataFrame:
    """name -> id of its first definition, in order of path, place and id."""
    rows = snippets.where(F.col("type").isin(*types) & F.col("name").isNotNull())
    return rows.groupBy("name").agg(F.min(F.struct("file_path", "start_byte", "id")).alias("f")).select("name", F.col("f.id").alias("id"))


def resolve(edges: DataFrame, symbols: DataFrame, target: str = "target") -> DataFrame:
    """target_id: the symbol's id, or the text itself; resolved says which."""
    s = symbols.select(F.col("name").alias("_name"), F.col("id").alias("_id"))
    out = edges.join(s, F.col(target) == F.col("_name"), "left")
    return out.withColumn("target_id", F.coalesce("_id", F.col(target))).withColumn("resolved", F.col("_id").isNotNull()).drop("_name", "_id")


def innermost(nodes: DataFrame, spans: DataFrame, strict: bool = False) -> DataFrame:
    """Each node (file_path, node_id, start, end) with the id of the smallest span around it; none gives null.

    ``strict``: a span equal to the node doesn't count.
    """
    s = spans.select(F.col("file_path").alias("_f"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("id").alias("_id"))
    around = (F.col("file_path") == F.col("_f")) & (F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e"))
    if strict:
        around &= (F.col("_s") != F.col("start")) | (F.col("_e") != F.col("end"))
    best = F.max(F.when(F.col("_id").isNotNull(), F.struct((F.col("_s") - F.col("_e")).alias("n"), F.col("_s").alias("s"), F.col("_id").alias("id")))).alias("b")
    return nodes.join(s, around, "left").groupBy(*nodes.columns).agg(best).select(*nodes.columns, F.col("b.id").alias("container_id"))


def exact_range(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """Each node with the id of the span that has its bounds; of several the greatest id."""
    s = spans.groupBy("file_path", "start", "end").agg(F.max("id").alias("span_id"))
    return nodes.join(s, ["file_path", "start", "end"], "left")


def without_nested(spans: DataFrame) -> DataFrame:
    """Drops spans that lie within an earlier and at least as large one of their file; of equals the first id stays."""
    order = Window.partitionBy("file_path").orderBy("start", F.desc("end"), "id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_r", reach).where(F.col("_r").isNull() | (F.col("_r") < F.col("end"))).drop("_r")


def placeholders(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node for each target that has none; its name is its id."""
    known = nodes.select(F.col("id").alias("_id"))
    missing = edges.select("target_id").distinct().join(known, F.col("target_id") == F.col("_id"), "left_anti")
    return missing.select(F.col("target_id").alias("id"), F.col("target_id").alias("name"), F.lit("placeholder").alias("type"), F.lit(None).cast("string").alias("file_path"))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose both ends are nodes."""
    ids = nodes.select(F.col("id").alias("_id"))
    kept = edges.join(ids, F.col("source_id") == F.col("_id"), "left_semi").join(ids, F.col("target_id") == F.col("_id"), "left_semi")
    return kept.dropDuplicates(["source_id", "target_id", "type"])


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id and its outgoing (type, target name) pairs, in order."""
    names = nodes.select(F.col("id").alias("_id"), F.col("name").alias("target"))
    pairs = edges.join(names, F.col("target_id") == F.col("_id")).select("source_id", F.struct("type", "target").alias("r"))
    return pairs.groupBy("source_id").agg(F.array_sort(F.collect_list("r")).alias("relations"))


def detach_delete(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of some files, and without the edges at either end of those."""
    gone = nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("_id"))
    kept = nodes.join(gone, F.col("id") == F.col("_id"), "left_anti")
    left = edges.join(gone, F.col("source_id") == F.col("_id"), "left_anti").join(gone, F.col("target_id") == F.col("_id"), "left_anti")
    return kept, left


def totals(nodes: DataFrame) -> DataFrame:
    """Nodes, local ones and placeholders."""
    p = F.col("type") == "placeholder"
    return nodes.agg(F.count(F.lit(1)).alias("total"), F.count_if(~p).alias("local"), F.count_if(p).alias("placeholders"))


# ---- edges from captures ----


def _upper_text(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def edges_from_captures(captures: DataFrame, snippets: DataFrame) -> DataFrame:
    """The edge table: rules over captures, with containers and symbols by joins.

    A file stands for what no definition contains. Assignments keep their text as
    target; all other targets resolve to a symbol where there is one.
    """
    defs = snippets.where(F.col("chunk_index").isNull())
    spans = defs.select("file_path", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "id")
    inner = defs.where("type <> 'file'").select("file_path", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "id")
    language = F.when(F.lower("file_path").endswith(".py"), "python").otherwise("c")
    c = captures.withColumn("lang", language)
    places = c.where(F.col("tag").isin("call", "assignment")).select("file_path", "tag", "text", "start", "end", "lang")
    held = innermost(places, spans)
    first = F.substring("text", 1, 1)
    instance = (F.col("lang") == "python") & (F.upper(first) == first) & (F.lower(first) != first) & ~F.col("text").contains(".")
    calls = held.where("tag = 'call'").select("file_path", F.col("container_id").alias("source_id"), F.col("text").alias("target"), F.when(instance, "instantiates").otherwise("calls").alias("type"))
    writes = (F.col("text").contains(".")) | F.col("text").contains("->") | _upper_text(F.col("text"))
    modifies = held.where((F.col("tag") == "assignment") & writes).select("file_path", F.col("container_id").alias("source_id"), F.col("text").alias("target"), F.lit("modifies").alias("type"))
    imports = c.where("tag = 'import'").select("file_path", file_id(F.col("file_path")).alias("source_id"), F.btrim("text", F.lit('"<>')).alias("target"), F.lit("imports").alias("type"))
    owned = c.where(F.col("tag").isin("base", "returns", "decorator")).select("file_path", "tag", "text", F.col("owner_start").alias("start"), F.col("owner_end").alias("end"))
    kinds = F.create_map(*[F.lit(x) for x in ("base", "inherits", "returns", "returns", "decorator", "decorated_by")])
    attributes = exact_range(owned, inner).select("file_path", F.col("span_id").alias("source_id"), F.col("text").alias("target"), kinds[F.col("tag")].alias("type"))
    definitions = c.where(F.col("tag").endswith(".def") & ~((F.col("tag") == "enum.def") & (F.col("lang") == "c"))).select("file_path", "start", "end")
    defines = exact_range(innermost(definitions, spans, strict=True), inner).select("file_path", F.coalesce("container_id", file_id(F.col("file_path"))).alias("source_id"), F.col("span_id").alias("target_id"), F.lit("defines").alias("type"), F.lit(True).alias("resolved"))
    named = reduce(DataFrame.unionByName, [calls, imports, attributes])
    symbols = symbol_table(snippets.where(F.col("chunk_index").isNull()))
    out = resolve(named, symbols).select("source_id", "target_id", "type", "file_path", "resolved")
    plain = modifies.select("source_id", F.col("target").alias("target_id"), "type", "file_path", F.lit(False).alias("resolved"))
    return out.unionByName(plain).unionByName(defines.select(*out.columns)).where("source_id IS NOT NULL AND target_id IS NOT NULL").dropDuplicates(["source_id", "target_id", "type"])
