"""Tables that readers never see half written: replace, append, load of changes and by file.

A table is a folder with data folders and commits. A write goes to a data folder
of its own name, is counted while it is written, read back and compared; then
one rename puts its commit, a small file that lists the data folders, into
``_commits`` under the next number. Readers open the highest commit, so they see
the old table until that rename and the new one after it. A job that is killed
before leaves a folder that no commit names; a repeated write makes a folder of
its own, so nothing is there twice. Two writers that take the same number
collide at the rename, and the later one fails without having changed anything.
The last ``keep`` versions stay readable; ``vacuum`` deletes what none of them
names.

``load_changes`` keeps a snapshot in buckets of its key. A load compares the row
digests of the stored and of the new snapshot by a full outer join of (key,
digest) and writes only the buckets that hold a new, changed or gone key; the
commit names the other buckets' old folders.

``load_by_file`` keeps a reduction of every source file under the file's digest;
only new and replaced files are read again.

``assign_keys`` keeps a registry of surrogate keys: a natural key that it holds
keeps its number over all loads, new ones get the next numbers in their order.

Rename must be atomic and fail where the target exists, as on HDFS and local
file systems.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import with_surrogate_key
from ..session import ensure_checkpoint_dir
from .ingest import data_files
from .sinks import conform

BUCKET, DIGEST = "_bucket", "_digest"


class WriteConflict(RuntimeError):
    """Another writer committed the version that this one was to become."""


class IncompleteWrite(RuntimeError):
    """What was read back is not what was written."""


@dataclass(frozen=True)
class Commit:
    version: int
    schema: T.StructType
    parts: dict[str, str]  # name of a part (a bucket, or a folder of its own) → data folder


class VersionedTable:
    """A table under ``root``; every method reads the commits anew."""

    def __init__(self, spark: SparkSession, root: str, *, keep: int = 2):
        if keep < 1:
            raise ValueError("keep must be 1 or more")
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm = jvm
        self._fs = self._path("").getFileSystem(conf)

    # ------------------------------------------------------------------ files
    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), False)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    # ------------------------------------------------------------------ commits
    def versions(self) -> list[int]:
        return [int(n) for n in self._names("_commits") if n.isdigit()]

    def commit_of(self, version: int | None = None) -> Commit | None:
        """The newest commit, or the given one; None for a table without any."""
        known = self.versions()
        if not known:
            return None
        found = json.loads(self._text(f"_commits/{known[-1] if version is None else version:010d}"))
        return Commit(found["version"], T.StructType.fromJson(found["schema"]), found["parts"])

    def _commit(self, before: Commit | None, schema: T.StructType, parts: dict[str, str]) -> int:
        version = before.version + 1 if before else 1
        aside = f"_aside/{uuid.uuid4().hex}"
        self._put(aside, json.dumps({"version": version, "schema": schema.jsonValue(), "parts": parts}))
        target = self._path(f"_commits/{version:010d}")
        self._fs.mkdirs(self._path("_commits"))
        # The one step that readers notice.
        if self._fs.exists(target) or not self._fs.rename(self._path(aside), target):
            raise WriteConflict(f"version {version} of {self.root} exists")
        return version

    def _written(self, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        """``df`` in a new data folder, counted as written and as read back."""
        name = f"data-{uuid.uuid4().hex}"
        obs = Observation()
        writer = df.observe(obs, F.count(F.lit(1)).alias("n")).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}")
        wrote, there = obs.get["n"], self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}").count()
        if wrote != there:
            raise IncompleteWrite(f"{name}: {wrote} rows written, {there} read back")
        return name

    # ------------------------------------------------------------------ tables
    def read(self, version: int | None = None) -> DataFrame:
        found = self.commit_of(version)
        if found is None:
            raise ValueError(f"{self.root} has no committed version")
        if not any(found.parts.values()):
            return self.spark.createDataFrame([], found.schema)
        paths = sorted({f"{self.root}/{p}" for p in found.parts.values() if p})
        return self.spark.read.schema(found.schema).parquet(*paths)

    def replace(self, df: DataFrame, schema: T.StructType | None = None) -> int:
        """The table becomes ``df``; returns the new version."""
        before = self.commit_of()
        df = conform(df, schema) if schema is not None else df
        part = self._written(df)
        return self._commit(before, df.schema, {part: part})

    def append(self, df: DataFrame) -> int:
        """Adds the rows of ``df`` (conformed to the table's schema) as a folder of their own."""
        before = self.commit_of()
        if before is None:
            return self.replace(df)
        part = self._written(conform(df, before.schema))
        return self._commit(before, before.schema, before.parts | {part: part})

    def vacuum(self) -> list[str]:
        """Deletes commits beyond the last ``keep`` and data folders that none of the rest names.

        No other writer may be at work: its folder is not yet named either.
        """
        known = self.versions()
        for version in known[: -self.keep]:
            self._fs.delete(self._path(f"_commits/{version:010d}"), False)
        named = {p.split("/")[0] for v in known[-self.keep:] for p in self.commit_of(v).parts.values() if p}
        gone = [n for n in self._names("") if n.startswith("data-") and n not in named]
        for name in gone:
            self._fs.delete(self._path(name), True)
        return gone


# --------------------------------------------------------------------------- load of changes
@dataclass(frozen=True)
class Load:
    version: int
    counts: dict[str, int]  # new, changed, gone, same
    touched: list[int]      # buckets written


def row_digest(columns: Sequence[str]) -> Column:
    """Digest of a row's values with their names; NULL is a value of its own."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def compare_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, kind) by a full outer join of (key, digest): kind is new, changed, gone or same."""
    a = old.select(F.col(key).alias("_a"), F.col(DIGEST).alias("_da"))
    b = new.select(F.col(key).alias("_b"), F.col(DIGEST).alias("_db"))
    kind = (F.when(F.col("_da").isNull(), "new").when(F.col("_db").isNull(), "gone")
            .when(F.col("_da") != F.col("_db"), "changed").otherwise("same"))
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), kind.alias("kind"))


def load_changes(table: VersionedTable, snapshot: DataFrame, key: str, *, buckets: int = 64) -> Load:
    """Makes ``table`` hold ``snapshot`` (unique, non-NULL ``key``), writing the buckets that changed.

    The first load writes all of them. The number of buckets is that of the
    first load. To the driver come four counts and the touched buckets' numbers.
    """
    spark = table.spark
    ensure_checkpoint_dir(spark)
    before = table.commit_of()
    if before is not None:
        buckets = int(before.schema[BUCKET].metadata["buckets"])
    new = snapshot.withColumns({DIGEST: row_digest(snapshot.columns), BUCKET: F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")})
    new = new.checkpoint(eager=True)
    bad = new.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(key).isNull()).limit(3).collect()
    if bad:
        raise ValueError(f"{key}: {', '.join(repr(r[0]) for r in bad)} null or in several rows")
    if before is None:
        counts, touched = {"new": new.count()}, list(range(buckets))
    else:
        if [f.name for f in before.schema.fields] != new.columns:
            raise ValueError("the snapshot's columns differ from the table's: replace the table")
        kinds = compare_rows(table.read(), new, key)
        found = kinds.groupBy(F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias("b"), "kind").count().collect()
        counts = {}
        for r in found:  # four rows a bucket at most
            counts[r["kind"]] = counts.get(r["kind"], 0) + r["count"]
        touched = sorted({r["b"] for r in found if r["kind"] != "same"})
    counts = {k: counts.get(k, 0) for k in ("new", "changed", "gone", "same")}
    if before is not None and not touched:
        return Load(before.version, counts, [])
    fields = [T.StructField(f.name, f.dataType, f.nullable, {"buckets": buckets} if f.name == BUCKET else None) for f in new.schema.fields]
    # Two copies of the bucket number: one names the folder, one stays in the rows.
    rows = new.where(F.col(BUCKET).isin(touched)).withColumn("_folder", F.col(BUCKET))
    part = table._written(rows.repartition(F.col("_folder")), ["_folder"])
    full = {int(n.split("=")[1]) for n in table._names(part) if n.startswith("_folder=")}
    parts = {} if before is None else {b: p for b, p in before.parts.items() if int(b) not in touched}
    parts |= {str(b): f"{part}/_folder={b}" for b in touched if b in full}
    return Load(table._commit(before, T.StructType(fields), parts), counts, touched)


def current_rows(table: VersionedTable) -> DataFrame:
    """The table's rows without the columns that ``load_changes`` adds."""
    return table.read().drop(BUCKET, DIGEST)


# --------------------------------------------------------------------------- results kept per source file
FILE_KEY = "_file"


def file_keys(spark: SparkSession, path: str) -> dict[str, tuple[str, str]]:
    """Every data file under ``path`` → its URI, and a digest of URI, size and time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for file in data_files(spark, path):
        where = jvm.org.apache.hadoop.fs.Path(file)
        status = where.getFileSystem(conf).getFileStatus(where)
        uri = where.toUri().toString()
        out[file] = (uri, hashlib.sha1(f"{uri}:{status.getLen()}:{status.getModificationTime()}".encode()).hexdigest())
    return out


def load_by_file(table: VersionedTable, path: str, read: Callable[[list[str]], DataFrame],
                 build: Callable[[DataFrame, str], DataFrame]) -> list[str]:
    """Makes ``table`` hold ``build`` of every file under ``path``; only files that it does not yet
    know are read. Returns those.

    ``read`` opens files by their names; ``build(rows, key)`` reduces rows to some
    for each value of the column ``key`` (the file) and must keep it. A replaced
    file has another digest, so its old rows leave with it, as those of deleted
    files do. The driver's work grows with the number of files.
    """
    spark, before = table.spark, table.commit_of()
    now = file_keys(spark, path)
    old = before.parts if before else {}
    # A file without rows has no folder; an empty name marks it as read.
    fresh = {file: (uri, key) for file, (uri, key) in now.items() if key not in old}
    kept = {key: old[key] for _, key in now.values() if key in old}
    schema, parts = before.schema if before else None, {}
    if fresh:
        names = spark.createDataFrame(list(fresh.values()), "_uri string, _key string")
        rows = read(sorted(fresh))
        uri = F.regexp_replace(F.col("_metadata.file_path"), "^file:///", "file:/")
        rows = rows.select("*", uri.alias("_at")).join(F.broadcast(names) if len(fresh) < 10_000 else names, F.col("_at") == F.col("_uri"))
        out = build(rows.drop("_at", "_uri").withColumnRenamed("_key", FILE_KEY), FILE_KEY)
        schema = out.schema
        part = table._written(out.withColumn("_folder", F.col(FILE_KEY)), ["_folder"])
        full = {n.split("=")[1] for n in table._names(part) if n.startswith("_folder=")}
        parts = {key: f"{part}/_folder={key}" if key in full else "" for _, key in fresh.values()}
    if before is None and not fresh:
        raise ValueError(f"no data file under {path}")
    if kept | parts != old:
        table._commit(before, schema, kept | parts)
    return sorted(fresh)


# --------------------------------------------------------------------------- key registry
def assign_keys(registry: VersionedTable, df: DataFrame, natural: Sequence[str], key_name: str) -> DataFrame:
    """``df`` with the surrogate key of its ``natural`` columns, registered for good.

    Known natural keys keep theirs; new ones are numbered on from the largest,
    without gaps, in the order of the columns. A row with a NULL in a natural
    column has no key. The numbers come from the sorted set of new keys, so a
    retried task or a repeated load gives the same.
    """
    natural = list(natural)
    wanted = df.select(*natural).dropna(subset=natural).distinct()
    before = registry.commit_of()
    last = 0
    if before is not None:
        known = registry.read()
        last = known.agg(F.coalesce(F.max(key_name), F.lit(0))).first()[0]
        wanted = wanted.join(known.select(*natural), natural, "left_anti")
    fresh = with_surrogate_key(wanted, natural, key_name)
    fresh = fresh.select(*natural, (F.col(key_name) + last).cast("bigint").alias(key_name))
    if before is None or not fresh.isEmpty():
        registry.append(fresh)
    return df.join(registry.read(), natural, "left")
