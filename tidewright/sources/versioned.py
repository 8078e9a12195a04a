"""Tables in versions: a commit writes new files aside and becomes visible by one rename of a manifest.

A table's folder holds data/<commit>/<part>/ with Parquet files and manifests/<number>.json. A manifest names, for each part,
the folder of its rows, and says which commit keys are in. Readers take the manifest with the largest number. A writer
makes the next one under a name of its own and renames it; if that number is there already, another writer was faster, and
the commit is worked out again on what that one left. A writer that dies leaves files that no manifest names: readers never
see them, and vacuum() removes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import upsert_bars


class Conflict(Exception):
    """Another writer has committed the version."""


class _Folder:
    """The few file operations that are needed, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path.rstrip("/")
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> None:
        """Writes a file under another name and renames it; Conflict if the name is taken."""
        aside = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(aside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        none[0] = options.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.conf).rename(aside, self._at(name), none)
        except Exception as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def _latest(folder: _Folder) -> tuple[int, dict]:
    numbers = [int(n[:-5]) for n in folder.names("manifests") if n.endswith(".json")]
    if not numbers:
        return -1, {"parts": {}, "keys": [], "schema": None}
    return max(numbers), json.loads(folder.read(f"manifests/{max(numbers):012d}.json"))


def version(spark: SparkSession, path: str) -> int:
    """Number of the newest commit, -1 without one."""
    return _latest(_Folder(spark, path))[0]


def manifest(spark: SparkSession, path: str) -> dict:
    """parts, keys, schema, and the provenance (rows and content hash) of the newest commit."""
    return _latest(_Folder(spark, path))[1]


def content_hash(df: DataFrame) -> DataFrame:
    """One row: rows, and a hash of 120 bits that doesn't depend on their order."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    half = lambda at: F.pmod(F.coalesce(F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)), F.lit(1 << 60).cast("decimal(20,0)"))
    return df.agg(F.count("*").alias("rows"), half(1).cast("long").alias("a"), half(16).cast("long").alias("b"))


def _part(columns: list[str]):
    return F.concat_ws(",", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[^A-Za-z0-9_.-]", "_"), F.lit("null"))) for c in columns])


def read(spark: SparkSession, path: str, keep=None) -> DataFrame:
    """The newest version; keep(part) chooses parts by name, such as 'symbol:A,year:2021', before any file is read."""
    folder = _Folder(spark, path)
    _, m = _latest(folder)
    if m["schema"] is None:
        raise FileNotFoundError(path)
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(m["schema"])
    files = sorted(f"{folder.path}/{at}" for part, at in m["parts"].items() if keep is None or keep(part))
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def commit(spark: SparkSession, path: str, make, by: list[str], key: str | None = None, tries: int = 5) -> int:
    """Puts in what make(old) gives, rows of whole parts (by names the columns that decide the part), where old(parts) reads
    parts of the newest version. Other parts stay. A key that is in already is not put in again. Gives the version."""
    folder = _Folder(spark, path)
    for _ in range(tries):
        number, m = _latest(folder)
        if key is not None and key in m["keys"]:
            return number
        new, commit_id = make(lambda parts, m=m: _parts(spark, folder, m, parts)), uuid.uuid4().hex
        at = f"data/{commit_id}"
        new.withColumn("part", _part(by)).repartition(*by).sortWithinPartitions(*by).write.partitionBy("part").parquet(f"{folder.path}/{at}")
        made = {_unescaped(n[5:]): f"{at}/{n}" for n in folder.names(at) if n.startswith("part=")}
        done = spark.read.schema(new.schema).parquet(*[f"{folder.path}/{x}" for x in made.values()]) if made else new.limit(0)
        c = content_hash(done).first()
        after = {"parts": m["parts"] | made, "keys": m["keys"] + ([key] if key is not None else []), "schema": json.loads(new.schema.json()), "commit": commit_id, "parent": number, "provenance": {"rows": c["rows"], "hash": f"{c['a']:015x}{c['b']:015x}"}}
        try:
            folder.put_new(f"manifests/{number + 1:012d}.json", json.dumps(after))
            return number + 1
        except Conflict:
            folder.delete(at)
    raise Conflict(f"{path}: {tries} other writers were faster")


def _unescaped(name: str) -> str:
    from urllib.parse import unquote

    return unquote(name)


def _parts(spark: SparkSession, folder: _Folder, m: dict, parts) -> DataFrame | None:
    """The rows of parts that are there, or None."""
    from pyspark.sql.types import StructType

    files = [f"{folder.path}/{m['parts'][p]}" for p in parts if p in m["parts"]]
    return spark.read.schema(StructType.fromJson(m["schema"])).parquet(*files) if files else None


def upsert(spark: SparkSession, path: str, new: DataFrame, by: list[str], key: str | None = None) -> int:
    """Adds bars; of bars with one symbol and ts the one that was there stays. Only parts that new touches are read and
    written again; they are listed on the driver, a name a part."""
    touched = [r["part"] for r in new.select(_part(by).alias("part")).distinct().collect()]

    def make(old):
        before = old(touched)
        return upsert_bars(before, new).select(new.columns) if before is not None else upsert_bars(new.limit(0), new).select(new.columns)

    return commit(spark, path, make, by, key)


def cell(spark: SparkSession, path: str, key: str, rows: DataFrame) -> int:
    """Puts the rows of one cell of a grid of runs in, once: a part of its own under the key."""
    return commit(spark, path, lambda old: rows.withColumn("cell", F.lit(key)), ["cell"], key)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Removes commits that none of the newest `keep` manifests names. Not to be run beside a writer."""
    folder = _Folder(spark, path)
    names = [n for n in folder.names("manifests") if n.endswith(".json")]
    used = {at.split("/")[1] for n in names[-keep:] for at in json.loads(folder.read(f"manifests/{n}"))["parts"].values()}
    gone = [c for c in folder.names("data") if c not in used]
    for c in gone:
        folder.delete(f"data/{c}")
    for n in names[:-keep]:
        folder.delete(f"manifests/{n}")
    return gone
