"""Tables of the document store: schemas, keyed upserts, lookups, cascading deletes, and a log of segments.

A store is a log. Each change writes a segment: new rows of some tables as Parquet, and the keys of rows of older
segments that they replace or delete. A manifest for each version lists the segments, oldest first; readers take
the highest version, so a change is seen as a whole or not at all, and a change that another one has overtaken
fails without effect (`Conflict`). Reading merges: rows whose key a later segment has among its gone keys are left
out, by one anti-join with the gone keys alone. `compact` merges the newest segments once these have grown to the
size of the one before, and `vacuum` removes what only old versions need.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SCHEMAS = {
    "documents": "doc_id string, source_path string, source_type string, file_type string, title string, authors array<string>, year string, content_hash string, parser string, parser_version string, metadata map<string,string>, created_at timestamp, updated_at timestamp",
    "parent_chunks": "parent_id string, doc_id string, parent_index int, title string, source_path string, source_type string, file_type string, section_path string, section_level int, page_start int, page_end int, text string, metadata map<string,string>, content_hash string, created_at timestamp",
    "child_chunks": "child_id string, parent_id string, doc_id string, child_index int, title string, source_path string, source_type string, file_type string, section_path string, page_start int, page_end int, text string, embedding_text string, metadata map<string,string>, collection string, created_at timestamp",
    "assets": "asset_id string, parent_id string, doc_id string, asset_type string, asset_index int, label string, caption string, page_start int, page_end int, bbox array<map<string,string>>, file_path string, text_repr string, metadata map<string,string>, created_at timestamp",
    "references": "reference_id string, doc_id string, label string, raw_text string, title string, authors array<string>, year string, doi string, metadata map<string,string>, created_at timestamp",
    "child_vectors": "child_id string, document string, embedding array<float>, metadata map<string,string>",
    "failures": "path string, file_type string, content_hash string, reason string, message string, failed_at timestamp",
}
KEYS = {"documents": "doc_id", "parent_chunks": "parent_id", "child_chunks": "child_id", "assets": "asset_id", "references": "reference_id", "child_vectors": "child_id", "failures": "path"}
#: Columns that an update leaves as they are.
KEPT = {"documents": ("created_at",), "parent_chunks": ("created_at", "doc_id"), "child_chunks": ("created_at", "doc_id", "parent_id"), "assets": ("created_at",), "references": ("created_at",), "child_vectors": (), "failures": ()}


def upsert(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """New rows replace old ones of their key, but for the kept columns; of several new rows the last by all columns counts."""
    one = _one(new, key)
    joined = old.alias("o").join(one.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    there = F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"n.{c}", f"o.{c}")
        if c in kept:
            return F.coalesce(f"o.{c}", f"n.{c}")
        return F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*(value(c).alias(c) for c in old.columns))


def _one(rows: DataFrame, key: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.desc(F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def point(rows: DataFrame, column: str, value) -> DataFrame:
    return rows.where(F.col(column) == value).limit(1)


def in_order(rows: DataFrame, key: str, wanted: DataFrame, at: str = "at") -> DataFrame:
    """Rows of the wanted keys (key, at), each once, with the place of the first request."""
    first = wanted.groupBy(key).agg(F.min(at).alias(at))
    return rows.join(first, key)


def grouped(rows: DataFrame, key: str, wanted: DataFrame, order: tuple[str, ...], fields: tuple[str, ...], name: str = "items") -> DataFrame:
    """For each wanted key the ordered array of its rows, empty without any."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(f for f in fields if f not in order)))).alias(name))
    out = wanted.select(key).distinct().join(lists, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def search_documents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """All child chunks for an index build, in a total order."""
    places = parents.select("parent_id", "parent_index")
    return children.join(places, "parent_id", "left").select("child_id", "parent_id", "doc_id", "parent_index", "child_index", "embedding_text", "metadata")


def without(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of documents (and vectors without their child chunks)."""
    gone = doc_ids.select("doc_id").distinct()
    out = {n: t.join(gone, "doc_id", "left_anti") if "doc_id" in t.columns else t for n, t in tables.items() if n != "child_vectors"}
    if "child_vectors" in tables:
        out["child_vectors"] = tables["child_vectors"].join(tables["child_chunks"].join(gone, "doc_id").select("child_id").distinct(), "child_id", "left_anti")
    return out


def decoded(raw: Column, schema: str = "map<string,string>") -> Column:
    """JSON text as a map; empty for anything else."""
    return F.coalesce(F.from_json(raw, schema), F.from_json(F.lit("{}"), schema))


def encoded(value: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))


def flat_metadata(value: Column) -> Column:
    """Entries with a value, as text."""
    return F.map_filter(value, lambda k, v: v.isNotNull())


def counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """name, n of each table; a missing table has 0."""
    out = None
    for name, rows in tables.items():
        part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") if rows is not None else None
        if part is None:
            spark = next(t for t in tables.values() if t is not None).sparkSession
            part = spark.range(1).select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def working_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder that the driver and all executors share: in ``spark.checkpoint.dir``, which only local mode may leave unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(table: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again, for use in several places."""
    path = working_folder(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


@lru_cache(1)
def _local_folder() -> str:
    import atexit
    import shutil
    import tempfile

    folder = tempfile.mkdtemp(prefix="quirework-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


class Conflict(RuntimeError):
    """Another change has become the version that this one was to be; run it again."""


class Store:
    """A log of segments in a folder that Spark can write; ``schemas``, ``keys`` and ``kept`` name the tables, their keys and the columns that an upsert leaves."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str] | None = None, keys: dict[str, str] | None = None, kept: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schemas, self.keys, self.kept = schemas or SCHEMAS, keys or KEYS, (KEPT if kept is None else kept)

    # --- files ---

    def _path(self, name: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path, hadoop

    def remove(self, name: str) -> None:
        fs, path, _ = self._path(name)
        fs.delete(path, True)

    def _names(self, name: str) -> list[str]:
        fs, path, _ = self._path(name)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json")]

    def current(self) -> int | None:
        return max(self.versions(), default=None)

    def segments(self, version: int | None = None) -> list[dict]:
        """The segments of a version (the current one), oldest first: name, rows and gone (numbers by table)."""
        version = self.current() if version is None else version
        if version is None:
            return []
        lines = self.spark.read.text(f"{self.folder}/manifests/v{version:012d}.json", wholetext=True).first()[0]
        return json.loads(lines)["segments"]

    # --- reading ---

    def _numbered(self, name: str, kind: str, segments: list[dict], schema: str) -> DataFrame | None:
        """Rows of all segments with `__seq`, the place of the segment."""
        places = {s["name"]: k for k, s in enumerate(segments) if s[kind].get(name)}
        if not places:
            return None
        rows = self.spark.read.schema(schema).parquet(*(f"{self.folder}/segments/{s}/{kind}/{name}" for s in places))
        of = F.create_map(*(F.lit(x) for pair in places.items() for x in pair))
        return rows.withColumn("__seq", F.element_at(of, F.regexp_extract(F.col("_metadata.file_path"), "/segments/([^/]+)/", 1)))

    def gone(self, name: str, segments: list[dict]) -> DataFrame | None:
        """Keys of the table's rows that count no more, with the place of the segment that says so; null if there are none."""
        key = self.keys[name]
        kind = next(f.dataType.simpleString() for f in self.spark.createDataFrame([], self.schemas[name]).schema if f.name == key)
        found = self._numbered(name, "gone", segments, f"{key} {kind}")
        return None if found is None else found.groupBy(F.col(key).alias("__gone")).agg(F.max("__seq").alias("__until"))

    def live(self, name: str, segments: list[dict]) -> DataFrame:
        """The rows that count in segments, with `__seq`."""
        rows, gone = self._numbered(name, "rows", segments, self.schemas[name]), self.gone(name, segments)
        if rows is None:
            return self.spark.createDataFrame([], self.schemas[name] + ", __seq int")
        return rows if gone is None else rows.join(gone, (F.col(self.keys[name]) == F.col("__gone")) & (F.col("__seq") < F.col("__until")), "left_anti")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.live(name, self.segments(version)).drop("__seq")

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        segments = self.segments(version)
        return {n: self.live(n, segments).drop("__seq") for n in self.schemas}

    # --- changes ---

    def _publish(self, version: int, segments: list[dict]) -> int:
        """Makes the manifest of a version, whole and only once."""
        fs, path, hadoop = self._path(f"manifests/v{version:012d}.json")
        fresh = hadoop.Path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps({"segments": segments}).encode()))
        out.close()
        context = hadoop.FileContext.getFileContext(fs.makeQualified(path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(fresh), fs.makeQualified(path), none)
        except Exception as error:
            fs.delete(fresh, False)
            if fs.exists(path):
                raise Conflict(f"version {version} is there already") from error
            raise
        return version

    def _written(self, rows: dict[str, DataFrame], gone: dict[str, DataFrame], index=None) -> dict:
        """A new segment's entry; whatever fails, its folder goes."""
        name = uuid.uuid4().hex
        entry = {"name": name, "rows": {}, "gone": {}}
        try:
            for kind, tables in (("rows", rows), ("gone", gone)):
                for table, df in tables.items():
                    path = f"{self.folder}/segments/{name}/{kind}/{table}"
                    columns = self.spark.createDataFrame([], self.schemas[table]).columns if kind == "rows" else [self.keys[table]]
                    df.select(*columns).write.parquet(path)
                    if n := self.spark.read.schema(df.select(*columns).schema).parquet(path).count():
                        entry[kind][table] = n
            if index is not None:
                index(f"{self.folder}/segments/{name}", entry)
        except BaseException:
            self.remove(f"segments/{name}")
            raise
        return entry

    def commit(self, rows: dict[str, DataFrame], gone: dict[str, DataFrame], index=None, onto: list[dict] | None = None, version: int | None = None) -> int:
        """Adds a segment of rows and gone keys (of older segments); ``index`` gets its folder and entry once its tables are there.

        ``onto`` are the segments that the change has seen, of ``version``; without them, the current ones.
        """
        if onto is None:
            version = self.current()
            onto = self.segments(version)
        entry = self._written(rows, gone, index)
        if not entry["rows"] and not entry["gone"]:
            self.remove(f"segments/{entry['name']}")
            return version or 0
        try:
            return self._publish((version or 0) + 1, [*onto, entry])
        except BaseException:
            self.remove(f"segments/{entry['name']}")
            raise

    def add(self, tables: dict[str, DataFrame], index=None, without: DataFrame | None = None, drop: dict[str, DataFrame] | None = None, anew: bool = False) -> int:
        """Upserts rows by key in one change that also drops the documents of ``without`` (doc_id) and, by table, the keys of ``drop``.

        ``anew``: as if the store were empty.
        """
        version = self.current()
        before = [] if anew else self.segments(version)
        rows, gone = {}, {}
        dropped = self._keys_of(without, before) if without is not None else {}
        for name, new in tables.items():
            key, kept = self.keys[name], [c for c in self.kept.get(name, ()) if c != self.keys[name]]
            one, old = _one(new, key), self.live(name, before)
            if any(s["rows"].get(name) for s in before):
                there = old.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in kept))
                if name in dropped:
                    there = there.join(dropped[name].select(F.col(key).alias("__k")), "__k", "left_anti")
                joined = one.join(there, F.col(key) == F.col("__k"), "left")
                gone[name] = old.select(key).join(one.select(key), key, "left_semi")
                one = joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in kept else F.col(c) for c in new.columns))
            rows[name] = one
        for name, keys in (drop or {}).items():
            if any(s["rows"].get(name) for s in before):
                keys = self.live(name, before).select(self.keys[name]).join(keys, self.keys[name], "left_semi")
                dropped[name] = dropped[name].unionByName(keys) if name in dropped else keys
        for name, keys in dropped.items():
            gone[name] = gone[name].unionByName(keys).distinct() if name in gone else keys
        return self.commit(rows, gone, index, before, version)

    def _keys_of(self, doc_ids: DataFrame, segments: list[dict]) -> dict[str, DataFrame]:
        """The keys of all rows of documents (and of the vectors of their child chunks)."""
        wanted = doc_ids.select("doc_id").distinct()
        out = {}
        for name in self.schemas:
            if not any(s["rows"].get(name) for s in segments):
                continue
            rows = self.live(name, segments)
            if "doc_id" in rows.columns:
                out[name] = rows.join(wanted, "doc_id", "left_semi").select(self.keys[name])
            elif name == "child_vectors" and "child_chunks" in out:
                out[name] = rows.join(out["child_chunks"], "child_id", "left_semi").select("child_id")
        return out

    def delete(self, doc_ids: DataFrame) -> int:
        version = self.current()
        before = self.segments(version)
        return self.commit({}, self._keys_of(doc_ids, before), None, before, version)

    def reset(self) -> int:
        version = self.current()
        return self._publish((version or 0) + 1, [])

    # --- upkeep ---

    def compact(self, least: int = 4, index=None, whole: bool = False) -> int | None:
        """Merges the newest segments: all that together are as large as the one before them, if they are ``least`` or more.

        So each row is rewritten about once for each doubling of the store. Gone keys stay while there is an older
        segment that they speak of. The new version, or null if nothing was to do.
        """
        version = self.current()
        segments = self.segments(version)
        size = lambda s: sum(s["rows"].values()) + sum(s["gone"].values())
        start = 0 if whole else len(segments) - 1
        while start > 0 and size(segments[start - 1]) <= sum(map(size, segments[start:])):
            start -= 1
        run = segments[start:]
        if len(run) < (2 if whole else least) and not (whole and any(s["gone"] for s in run)):
            return None
        rows = {n: self.live(n, run) for n in self.schemas if any(s["rows"].get(n) for s in run)}
        gone = {}
        for name in self.schemas:
            found = self.gone(name, run) if start else None
            if found is not None:
                gone[name] = found.select(F.col("__gone").alias(self.keys[name]))
        entry = self._written(rows, gone, index)
        try:
            return self._publish((version or 0) + 1, [*segments[:start], *([entry] if entry["rows"] or entry["gone"] else [])])
        except BaseException:
            self.remove(f"segments/{entry['name']}")
            raise

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes all but the last ``keep`` versions, and the segments that only removed versions name; the segments removed."""
        versions = sorted(self.versions())
        old, kept = versions[:-keep], versions[-keep:]
        needed = {s["name"] for v in kept for s in self.segments(v)}
        unneeded = sorted({s["name"] for v in old for s in self.segments(v)} - needed)
        for name in unneeded:
            self.remove(f"segments/{name}")
        for v in old:
            self.remove(f"manifests/v{v:012d}.json")
        return unneeded
