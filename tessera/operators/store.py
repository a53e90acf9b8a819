"""Tables as stores: upsert, look-up, cascade, listing, change sets, and a keyed table with versions."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_KEY = re.compile(r"[a-zA-Z0-9_]+")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old without those whose key new has, and the rows of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table that has the key, without the rows of these ids."""
    return {n: t.join(ids.select(key).distinct(), key, "left_anti") if key in t.columns else t for n, t in tables.items()}


def listed(docs: DataFrame, filters: dict[str, object], order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of documents that meet all equalities."""
    for k, v in filters.items():
        if not _KEY.fullmatch(k):
            raise ValueError(f"not a name: {k}")
        docs = docs.where(F.col(k) == F.lit(v))
    return docs.orderBy(*order).offset(offset).limit(limit)


def change_set(before: DataFrame, after: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """(key, change): added, modified or deleted, by content hash; what is equal is left out. A null content is one of its own; null keys are left out."""
    hashed = lambda rows, name: rows.where(F.col(key).isNotNull()).select(key, F.coalesce(F.sha2(content, 256), F.lit("")).alias(name))
    a, b = hashed(before, "ha"), hashed(after, "hb")
    state = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "deleted").when(F.col("ha") != F.col("hb"), "modified")
    return a.join(b, key, "full_outer").select(key, state.alias("change")).where("change IS NOT NULL")


def applied(table: DataFrame, after: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table with the change set carried out."""
    kept = table.join(changes.select(key), key, "left_anti")
    fresh = after.join(changes.where("change <> 'deleted'").select(key), key, "left_semi")
    return kept.unionByName(fresh)


def by_ids(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows with the given ids, each once."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def updated(table: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table with the columns that `changes` has (one row an id) replaced where they are not null; other ids are left alone."""
    own = [c for c in changes.columns if c != key]
    new = changes.withColumnsRenamed({c: f"__new_{c}" for c in own})
    return table.join(new, key, "left").select(*(F.coalesce(f"__new_{c}", c).alias(c) if c in own else c for c in table.columns))


def ordered_chunks(chunks: DataFrame, limit: int = 1000) -> DataFrame:
    """The first chunks by document and place."""
    return chunks.orderBy("doc_id", "chunk_index").limit(limit)


def status(documents: DataFrame, chunks: DataFrame, source: str, key: str = "source") -> DataFrame:
    """(documents, chunks, has_source): how many there are, and whether a source is known."""
    found = F.coalesce(F.bool_or(F.col(key) == source), F.lit(False)).alias("has_source")
    return documents.agg(F.count("*").alias("documents"), found).crossJoin(chunks.agg(F.count("*").alias("chunks"))).select("documents", "chunks", "has_source")


def vectors_added(table: DataFrame, new: DataFrame, upsert: bool = True, key: str = "id") -> DataFrame:
    """Vectors with new ones: in place of those of equal id, or, without upsert, beside them."""
    return upserted(table, new, [key]) if upsert else table.unionByName(new)


class Backends:
    """Named ways to open a store: functions from a path to an object with read() and write()."""

    def __init__(self, **ways):
        self._ways = dict(ways)

    def register(self, name: str, way) -> None:
        self._ways[name] = way

    def names(self) -> list[str]:
        return sorted(self._ways)

    def open(self, name: str, *args, **kw):
        if name not in self._ways:
            raise KeyError(f"no store {name}; there are {', '.join(self.names())}")
        return self._ways[name](*args, **kw)


class KeyedTable:
    """A table upserted by key, as Parquet files of key buckets under one folder.

    A version is a manifest that names, for each bucket, the folder with its rows. A write reads and rewrites just the buckets that new keys fall into, then
    adds the next manifest by a rename, which either happens or does not: readers see the old or the new version, and a job that dies leaves the
    old one. Folders that no manifest of the last two versions names are deleted. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def manifest(self, back: int = 0) -> dict:
        """The newest version, or one of those before: {version, batch, schema, buckets: {bucket: folder}}."""
        found = []
        if self._fs.exists(self._at("versions")):
            found = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("versions")) if s.getPath().getName().endswith(".json"))
        if len(found) <= back:
            return {"version": 0, "batch": -1, "schema": None, "buckets": {}}
        stream = self._fs.open(self._at(f"versions/{found[-1 - back]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """The rows of the newest version."""
        now = self.manifest()
        if not now["buckets"]:
            raise FileNotFoundError(self.path)
        folders = sorted({f"{self.path}/{x}" for x in now["buckets"].values()})
        return self.spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(*folders)

    def upsert(self, new: DataFrame, batch: int | None = None) -> bool:
        """Puts rows in, in place of those of equal key; a batch number that was written before changes nothing."""
        now = self.manifest()
        if batch is not None and batch <= now["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        version, fresh = now["version"] + 1, new.withColumn("__bucket", bucket)
        touched = sorted(r[0] for r in fresh.select("__bucket").distinct().collect())  # at most `buckets`
        before = {str(b): now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]}
        rows = new
        if before:
            old = self.spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(*sorted({f"{self.path}/{x}" for x in before.values()}))
            rows = upserted(old, new, self.keys)
        folder = f"data/v{version:08d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        kept = now["buckets"] | {str(b): f"{folder}/__bucket={b}" for b in touched}
        self._publish({"version": version, "batch": now["batch"] if batch is None else batch, "schema": new.schema.json(), "buckets": kept})
        return True

    def _publish(self, manifest: dict) -> None:
        self._fs.mkdirs(self._at("versions"))
        draft, final = self._at(f"versions/.{manifest['version']:08d}.tmp"), self._at(f"versions/{manifest['version']:08d}.json")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"version {manifest['version']} was written by someone else")
        named = {x.split("/")[1] for m in (self.manifest(), self.manifest(1)) for x in m["buckets"].values()}
        for s in self._fs.listStatus(self._at("data")):
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)


def visible(rows: DataFrame, user: str | None, roles: list[str]) -> DataFrame:
    """Rows (acl_users, acl_roles) a user may see: no list means public; without any identity all rows are seen."""
    if user is None and not roles:
        return rows
    public = (F.coalesce(F.size("acl_users"), F.lit(0)) <= 0) & (F.coalesce(F.size("acl_roles"), F.lit(0)) <= 0)
    own = F.array_contains("acl_users", user) if user is not None else F.lit(False)
    shared = F.arrays_overlap("acl_roles", F.array(*map(F.lit, roles))) if roles else F.lit(False)
    return rows.where(public | F.coalesce(own, F.lit(False)) | F.coalesce(shared, F.lit(False)))
