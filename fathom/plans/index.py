"""The index pipeline: files to snippets, edges, summaries and vectors, kept current by content hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import embeddable_text
from fathom.models import Models
from fathom.operators import graph, hierarchy, postings, store
from fathom.operators.store import prepared
from fathom.schema import EDGES, ERRORS, MANIFEST, SNIPPETS, VECTORS
from fathom.sources.codebase import CAPTURE_ROW, parsed, read_codebase


UNREADABLE = "unreadable"


def document(use_summary: bool = True):
    return embeddable_text(*[F.col(c) for c in ("file_path", "name", "type", "parent_signature", "summary", "parent_summary", "content")], use_summary=use_summary)


def vectors_of(snippets: DataFrame, models: Models, cached: DataFrame | None = None) -> DataFrame:
    """Vector rows; those whose stored document is the same keep their vector."""
    rows = snippets.select("id", document(models.use_summary).alias("_text"), document().alias("document"), F.coalesce("name", F.lit("")).alias("name"), "type", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("start_line", F.lit(-1)).alias("start_line"), F.coalesce("end_line", F.lit(-1)).alias("end_line"), "is_skeleton")
    fields = ["document", "name", "type", "file_path", "start_line", "end_line", "is_skeleton"]
    if cached is None:
        return rows.select("id", models.embed(F.col("_text")).alias("embedding"), *fields)
    old = cached.select(F.col("id").alias("_id"), F.col("embedding").alias("_v"), F.col("document").alias("_d"))
    both = rows.join(old, (F.col("id") == F.col("_id")) & (F.col("document") == F.col("_d")), "left")
    return both.select("id", F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(models.embed(F.col("_text"))).alias("embedding"), *fields)


def build(files: DataFrame, st: store.Store, models: Models | None = None, chunk_size: int = 1000, summaries: bool = True, also: dict[str, DataFrame] | None = None) -> DataFrame:
    """Brings the store to the state of ``files``; gives each path's status.

    Only new and changed files are parsed. Edges of all files resolve anew against
    the whole symbol table, so an edge into a changed file isn't lost. Files that a
    parser couldn't read as they should be are listed in the table ``errors``. ``also``:
    further tables of the same version. The inverted index gets a segment of what changed in
    the indexed fields, in the same version, so it can't drift from the snippets.
    """
    models, spark = models or Models(), files.sparkSession
    prepared(spark)
    old = {name: st.read(name, schema) for name, schema in (("manifest", MANIFEST), ("snippets", SNIPPETS), ("captures", CAPTURE_ROW), ("vectors", VECTORS), ("errors", ERRORS))}
    files = files.checkpoint()
    # a file that can't be read now is no deleted one: it stays as it was, and is listed in errors
    unread = files.where("content_hash IS NULL").select("file_path")
    files = files.where("content_hash IS NOT NULL")
    manifest = files.select("file_path", "content_hash").unionByName(old["manifest"].join(unread, "file_path", "left_semi"))
    status = store.diff(manifest, old["manifest"]).checkpoint()
    moved = status.where("status <> 'unchanged'")
    fresh = files.join(moved.where("status <> 'deleted'"), "file_path", "left_semi")
    read = parsed(fresh, chunk_size).checkpoint()  # each file is parsed once
    made, captured = read.selectExpr("inline(snippets)"), read.selectExpr("inline(captures)")
    errors = store.delete_by_file(old["errors"].where(F.col("error") != UNREADABLE), moved).unionByName(read.where("error IS NOT NULL").select("file_path", "error")).unionByName(unread.withColumn("error", F.lit(UNREADABLE)))
    snippets = store.delete_by_file(old["snippets"], moved).unionByName(made).checkpoint()
    captures = store.delete_by_file(old["captures"], moved).unionByName(captured).checkpoint()
    snippets = hierarchy.link_orphans(snippets).checkpoint()
    if summaries:
        changed = snippets.join(moved, "file_path", "left_semi").select("id")
        snippets = hierarchy.roll_up(snippets, changed, models.summarise)
    snippets = hierarchy.propagate_context(snippets.withColumn("parent_summary", F.lit(None).cast("string"))).checkpoint()
    edges = graph.edges_from_captures(captures, snippets).checkpoint()
    nodes = snippets.select("id", "name", "type", "file_path")
    nodes = nodes.unionByName(graph.placeholders(edges, nodes))
    tables = {"manifest": manifest, "snippets": snippets, "captures": captures, "edges": graph.with_endpoints(edges, nodes), "nodes": nodes, "vectors": vectors_of(snippets, models, old["vectors"]), "errors": errors} | (also or {})
    words, drop = term_segment(st, snippets)
    st.commit(tables | words, {name: ["bucket"] for name in words if name.startswith("postings_")}, drop)
    return status


def _segments(names, kind: str) -> dict[int, str]:
    return {int(n.rpartition("_")[2]): n for n in names if n.startswith(f"{kind}_")}


def term_index(st: store.Store) -> postings.Index:
    """The stored inverted index over the snippets' names, contents and summaries."""
    spark, where = st.spark, st.tables(st.version())

    def all_of(kind: str, schema: str, numbered: bool) -> DataFrame:
        """The segments' tables one below the other; of a table in a segment's own folder its number is the column segment."""
        parts = [spark.read.schema(schema).parquet(f"{st.root}/{where[name]}").select("*", *([F.lit(n).alias("segment")] if numbered else [])) for n, name in sorted(_segments(where, kind).items())]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema + (", segment int" if numbered else ""))

    of = lambda spec: spec.format(id="string")
    return postings.Index(all_of("postings", of(postings.POSTINGS), True), all_of("rows", of(postings.ROWS), True), all_of("gone", of(postings.GONE), False), all_of("stats", postings.STATS, False))


def term_segment(st: store.Store, snippets: DataFrame) -> tuple[dict[str, DataFrame], tuple[str, ...]]:
    """The tables of a new segment that brings the inverted index to the state of the snippets, and those it replaces by merging small segments in."""
    spark, names = st.spark, st.tables(st.version())
    have = term_index(st)
    live = postings.live_rows(have.rows, have.gone)
    fresh, dead = postings.changes(snippets, live)
    dead, n_fresh = store.checkpointed(dead), fresh.count()
    if not n_fresh and dead.isEmpty():
        return {}, ()
    sizes = {r["segment"]: r["n"] for r in have.stats.collect()}  # one row per segment
    if sizes:
        made = snippets.join(F.broadcast(fresh) if n_fresh <= postings.BROADCAST_ROWS else fresh, "id", "left_semi")
    else:  # all of them, where they are read
        made = snippets.where("id IS NOT NULL")
    found = postings.postings_of(made)
    rows = store.checkpointed(postings.rows_of(made))
    new = max(_segments(names, "stats"), default=0) + 1
    old = [n for n in postings.to_merge(sizes | {new: n_fresh}) if n != new]
    gone = have.gone.unionByName(dead)
    if old:
        kept = postings.Index(have.postings.where(F.col("segment").isin(old)), have.rows.where(F.col("segment").isin(old)), gone, have.stats)
        found = found.unionByName(kept.live().drop("segment")).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(postings.SPREAD))).sortWithinPartitions("bucket", "term", F.desc("tf"), "dl", "id")
        rows = store.checkpointed(rows.unionByName(postings.live_rows(kept.rows, gone).drop("segment")))
        gone = gone.where(~F.col("dead_segment").isin(old))
    drop = [name for kind in ("postings", "rows", "stats") for n, name in _segments(names, kind).items() if n in old] + list(_segments(names, "gone").values())
    return {f"postings_{new}": found, f"rows_{new}": rows, f"gone_{new}": gone, f"stats_{new}": postings.stats_of(new, rows)}, tuple(drop)


def index_directory(spark: SparkSession, path: str, root: str, models: Models | None = None, recursive: bool = True, **options) -> DataFrame:
    return build(read_codebase(spark, path, recursive=str(recursive).lower()), store.Store(spark, root), models, **options)


def verify(st: store.Store) -> DataFrame:
    """Node totals, and whether snippets and vectors are the same rows."""
    from fathom.schema import NODES

    nodes, snippets, vectors = st.read("nodes", NODES), st.read("snippets", SNIPPETS), st.read("vectors", VECTORS)
    missing = snippets.select("id").join(vectors.select("id"), "id", "left_anti").count()
    return graph.totals(nodes).withColumn("without_vector", F.lit(missing))


def status(st: store.Store) -> DataFrame:
    """What the status page shows: counts, and whether anything is indexed."""
    return counts(st.read("snippets", SNIPPETS), st.read("edges", EDGES)).withColumn("version", F.lit(st.version()))


def counts(snippets: DataFrame, edges: DataFrame) -> DataFrame:
    """snippets, files, edges, and whether anything is indexed."""
    n = snippets.agg(F.count(F.lit(1)).alias("snippets"), F.count_distinct("file_path").alias("files"))
    return n.withColumn("edges", F.lit(edges.count())).withColumn("indexed", F.col("snippets") > 0)
