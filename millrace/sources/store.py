"""Versioned storage of named tables: Parquet folders under a manifest.

A save writes a new version folder and then one manifest file that names it,
so a reader sees the old version or the new one. The manifest holds row counts,
byte sizes, column lists and an order-free content hash of every table.
Files are reached through Hadoop's file systems, as Spark's own are.
"""

from __future__ import annotations

import contextlib
import json

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import CorruptStore, MillraceError

LOCK = "writer.lock"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def content_hash(df: DataFrame) -> str:
    """Sum of row hashes: equal for equal rows in any order."""
    cols = [F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
    total = df.agg(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    return f"{total['n']}:{total['h'] or 0}"


def _size(spark, path: str) -> int:
    fs, p, _ = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def _read_text(spark, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def save(spark: SparkSession, folder: str, tables: dict[str, DataFrame], meta: dict | None = None) -> dict:
    """Writes the tables as the next version and makes it the current one. Returns the manifest."""
    with writer(spark, folder):
        return _save(spark, folder, tables, meta)


def _save(spark: SparkSession, folder: str, tables: dict[str, DataFrame], meta: dict | None) -> dict:
    fs, root, Path = _fs(spark, folder)
    version = 1 + max([_version(x) for x in _names(fs, root) if x.startswith("v")], default=0)
    body = {"version": version, "meta": meta or {}, "tables": {}}
    for name, df in tables.items():
        path = f"{folder}/v{version}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        back = spark.read.parquet(path)
        body["tables"][name] = {"rows": back.count(), "bytes": _size(spark, path), "columns": back.columns, "hash": content_hash(back)}
    staged, final = Path(f"{folder}/manifest.staged"), Path(f"{folder}/manifest.json")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
    out.close()
    _replace(spark, fs, staged, final)
    return body


def _replace(spark: SparkSession, fs, staged, final) -> None:
    """Puts staged in the place of final in one step; file systems that have no such step delete first, and a reader finds the staged one meanwhile."""
    jvm = spark.sparkContext._jvm
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context.rename(staged, final, how)
        return
    except Py4JError:
        if not fs.exists(staged):
            raise
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(staged, final):
        raise CorruptStore("the manifest could not be put in place")


@contextlib.contextmanager
def writer(spark: SparkSession, folder: str):
    """Holds the folder's lock; another writer meanwhile is an error. A lock left by a lost driver is taken away by break_lock."""
    fs, root, Path = _fs(spark, folder)
    fs.mkdirs(root)
    lock = Path(f"{folder}/{LOCK}")
    try:
        out = fs.create(lock, False)
    except Py4JError as x:
        raise MillraceError(f"{folder} is being written by another") from x
    out.write(bytearray(spark.sparkContext.applicationId.encode()))
    out.close()
    try:
        yield
    finally:
        fs.delete(lock, False)


def break_lock(spark: SparkSession, folder: str) -> bool:
    """Takes a lock away, and says whether there was one."""
    fs, _, Path = _fs(spark, folder)
    return fs.delete(Path(f"{folder}/{LOCK}"), False)


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether anything was ever saved in the folder: a manifest or a version."""
    fs, root, _ = _fs(spark, folder)
    return any(x.startswith("manifest.") or _version(x) for x in _names(fs, root))


def _names(fs, root) -> list[str]:
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def _version(name: str) -> int:
    return int(name[1:]) if name[:1] == "v" and name[1:].isdigit() else 0


def manifest(spark: SparkSession, folder: str) -> dict:
    fs, _, Path = _fs(spark, folder)
    for name in ("manifest.json", "manifest.staged"):  # a crash between delete and rename leaves the staged one
        if fs.exists(Path(f"{folder}/{name}")):
            try:
                return json.loads(_read_text(spark, f"{folder}/{name}"))
            except json.JSONDecodeError as x:
                raise CorruptStore(f"{name} can't be read") from x
    raise CorruptStore(f"no manifest in {folder}")


def load(spark: SparkSession, folder: str, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    body = manifest(spark, folder)
    found = {}
    for name, want in body["tables"].items():
        path = f"{folder}/v{body['version']}/{name}"
        fs, p, _ = _fs(spark, path)
        if not fs.exists(p):
            raise CorruptStore(f"table {name} is missing")
        df = spark.read.parquet(path)
        if df.columns != want["columns"]:
            raise CorruptStore(f"columns of {name} differ from the manifest")
        if verify and (_size(spark, path) != want["bytes"] or content_hash(df) != want["hash"]):
            raise CorruptStore(f"content of {name} differs from the manifest")
        found[name] = df
    return found, body


def validate(spark: SparkSession, folder: str) -> dict:
    return load(spark, folder)[1]


def size_report(spark: SparkSession, folder: str) -> dict[str, int]:
    return {name: t["bytes"] for name, t in manifest(spark, folder)["tables"].items()}


def clean(spark: SparkSession, folder: str) -> list[str]:
    """Removes versions that the manifest does not name; returns their names."""
    keep = f"v{manifest(spark, folder)['version']}"
    fs, root, Path = _fs(spark, folder)
    gone = sorted(x for x in _names(fs, root) if _version(x) and x != keep)
    for name in gone:
        fs.delete(Path(f"{folder}/{name}"), True)
    return gone
