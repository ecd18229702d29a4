"""The stored index: what changed, upserts and deletes, versions of Parquet tables.

A version is a marker that says where each of its tables is: in the folder that its commit
wrote, which no other commit writes in, or in that of a former version. The marker is written
under another name and renamed last, to the number after the version that the commit began
with, which fails where that number is taken. So a job that dies leaves the former version whole,
a version has all tables of its commit or none, no path is written that a plan still reads, and
of two writers that began with the same version one gets a Conflict and begins anew.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_own: list[str] = []


def prepared(spark: SparkSession) -> None:
    """Sets the checkpoint folder that the session names; a temporary one only on a single machine."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="fathom-"))
        found = _own[0]
    context.setCheckpointDir(found)


def checkpointed(df: DataFrame) -> DataFrame:
    prepared(df.sparkSession)
    return df.checkpoint()


def diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """file_path and status: unchanged, changed, new or deleted, by content hash."""
    a = current.select("file_path", F.col("content_hash").alias("now"))
    b = manifest.select("file_path", F.col("content_hash").alias("before"))
    status = F.when(F.col("now").isNull(), "deleted").when(F.col("before").isNull(), "new").when(F.col("now") == F.col("before"), "unchanged").otherwise("changed")
    return a.join(b, "file_path", "full").select("file_path", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of their key; of repeated new keys the last by all columns stays."""
    last = latest(new, [key], [F.struct(*[c for c in new.columns if not c.startswith("metadata")])])
    return old.join(new.select(key), key, "left_anti").unionByName(last)


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def paths_of(rows: DataFrame) -> DataFrame:
    return rows.select("file_path").distinct()


def stale_paths(stored: DataFrame, current: DataFrame) -> DataFrame:
    return paths_of(stored).subtract(current.select("file_path"))


def lookup(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The rows of many ids, with what ``wanted`` says of each; of columns only those that are read reach the scan."""
    return rows.join(wanted, key)


def delete_by_file(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(paths.select("file_path").distinct(), "file_path", "left_anti")


class Conflict(RuntimeError):
    """Another writer committed a version since this commit began."""


class Store:
    """Versions of named tables under a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _marker(self, name) -> str:
        return f"{self.root}/versions/{name}"

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        fs, p = self._fs(f"{self.root}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def tables(self, version: int) -> dict[str, str]:
        """Where the tables of a version are, below the root."""
        if version == 0:
            return {}
        fs, p = self._fs(self._marker(version))
        reader = fs.open(p)
        try:
            return json.loads(bytes(reader.readAllBytes()).decode())
        finally:
            reader.close()

    def read(self, table: str, schema: str) -> DataFrame:
        """A table of the newest version; empty if that has none of the name."""
        where = self.tables(self.version()).get(table)
        if where is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{where}")

    def get(self, table: str, schema: str, ids: list, key: str = "id") -> DataFrame:
        """The rows of some ids; the filter reaches the scan."""
        return self.read(table, schema).where(F.col(key).isin(list(ids)))

    def commit(self, tables: dict[str, DataFrame], by: dict[str, list[str]] | None = None, drop: tuple[str, ...] = ()) -> int:
        """Writes a version with these tables, in folders by the columns ``by`` names; those it isn't given stay as they are, but for those to drop."""
        before = self.version()
        v = before + 1
        own = f"v{v}-{uuid.uuid4().hex[:12]}"
        kept = {name: path for name, path in self.tables(before).items() if name not in drop}
        try:
            for name, df in tables.items():
                df.write.partitionBy(*(by or {}).get(name, [])).parquet(f"{self.root}/{own}/{name}")
            self._claim(v, kept | {name: f"{own}/{name}" for name in tables})
        except Exception:
            fs, p = self._fs(f"{self.root}/{own}")
            fs.delete(p, True)
            raise
        return v

    def _claim(self, v: int, where: dict[str, str]) -> None:
        """Makes the version's marker, unless there is one: a rename that doesn't overwrite."""
        from py4j.protocol import Py4JJavaError

        fs, draft = self._fs(self._marker(f".draft-{uuid.uuid4().hex}"))
        out = fs.create(draft)
        out.write(bytearray(json.dumps(where).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(self._fs(self._marker(v))[1]), how)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {v} of {self.root} is another writer's") from e
            raise

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the tables and markers that none of the newest versions needs. Folders of numbers above the newest may be some writer's, and stay."""
        newest = self.version()
        fs, p = self._fs(self.root)
        if not newest:
            return
        held = [v for v in range(max(1, newest - keep + 1), newest + 1) if fs.exists(self._fs(self._marker(v))[1])]
        needed = {path for v in held for path in self.tables(v).values()}
        for s in fs.listStatus(p):
            n = s.getPath().getName()
            number = n[1:].split("-")[0]
            if n[:1] == "v" and number.isdigit() and int(number) <= newest:
                inside = [x.getPath() for x in fs.listStatus(s.getPath())]
                gone = [x for x in inside if f"{n}/{x.getName()}" not in needed]
                for x in [s.getPath()] if len(gone) == len(inside) else gone:
                    fs.delete(x, True)
        for s in fs.listStatus(self._fs(f"{self.root}/versions")[1]):
            n = s.getPath().getName()
            if n.isdigit() and int(n) not in held:
                fs.delete(s.getPath(), False)
