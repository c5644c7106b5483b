"""Stored tables with a manifest: what is published is whole, and of the kind that a reader expects.

A table is a folder of ``data-<id>`` folders of Parquet files and ``manifest-<number>`` files. The
manifest of the highest number names the data folder, its files with their lengths, the schema, the
number of rows, a format version and the state of the sources it was built from. Data are written
and checked first; renaming the manifest into place publishes them, so a table that is half written is
never seen, and a file that was lost or cut afterwards is noticed on reading.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import changed_at


class CheckFailed(ValueError):
    """A table breaks a check of its write, or its files or schema are not those of its manifest."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    """Names and lengths of the data files of a folder."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return {}
    return {f.getPath().getName(): f.getLen() for f in fs.listStatus(at) if not f.getPath().getName().startswith(("_", "."))}


def observed_write(df: DataFrame, path: str, checks: dict[str, Column] | None = None, facts: dict[str, Column] | None = None, drop: list[str] | None = None) -> dict[str, int]:
    """Write ``df`` (less ``drop``) as Parquet and return what the same pass observed: ``rows``, ``facts`` and the violations of each of ``checks``.

    ``checks`` are conditions that no row may meet. If one does, what was written is removed and ``CheckFailed`` raised.
    """
    checks, seen = checks or {}, Observation()
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts, *[c.alias(n) for n, c in (facts or {}).items()]).drop(*(drop or [])).write.mode("overwrite").parquet(path)
    found = {k: v or 0 for k, v in seen.get.items()} or {n: 0 for n in ("rows", *checks, *(facts or {}))}
    if broken := {n: found[n] for n in checks if found[n]}:
        at, fs = _fs(df.sparkSession, path)
        fs.delete(at, True)
        raise CheckFailed(f"rows that break checks: {broken}")
    return found


def publish(df: DataFrame, path: str, checks: dict[str, Column] | None = None, drop: list[str] | None = None) -> dict[str, int]:
    """``observed_write`` beside ``path``, moved to ``path`` in place of what is there only if no check is broken."""
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    found = observed_write(df, staged, checks, drop=drop)
    (old, fs), (new, _) = _fs(spark, path), _fs(spark, staged)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"could not move {staged} to {path}")
    return found


def _newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and path of the newest manifest."""
    at, fs = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    numbers = sorted(int(n.split("-")[1]) for n in names if n.startswith("manifest-"))
    return (numbers[-1], f"{path}/manifest-{numbers[-1]:09d}") if numbers else (0, None)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the newest manifest of a table says; None where there is no table."""
    _, name = _newest(spark, path)
    return None if name is None else json.loads(spark.read.text(name, wholetext=True).first()[0])


def save(df: DataFrame, path: str, kind: str, version: int, *, source: dict | None = None, checks: dict[str, Column] | None = None, facts: dict[str, Column] | None = None) -> DataFrame:
    """Write and publish a table of a ``kind`` and format ``version``, built from ``source``; returns it read again.

    Of two writers at once one publishes and the other raises. Data of older manifests stay for readers that are under way.
    """
    spark, data = df.sparkSession, f"data-{uuid.uuid4().hex}"
    number, _ = _newest(spark, path)
    found = observed_write(df, f"{path}/{data}", checks, facts)
    what = {"kind": kind, "version": version, "source": source or {}, "data": data, "files": _files(spark, f"{path}/{data}"), "schema": json.loads(df.schema.json()), "rows": found.pop("rows"), "observed": found}
    hidden, fs = _fs(spark, f"{path}/.{data}")
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
    out.close()
    final, _ = _fs(spark, f"{path}/manifest-{number + 1:09d}")
    if fs.exists(final) or not fs.rename(hidden, final):
        raise CheckFailed(f"{path} was published by another writer meanwhile")
    return load(spark, path, kind, version)


def schema_of(what: dict) -> T.StructType:
    """The schema that a manifest gives."""
    return T.StructType.fromJson(what["schema"])


def whole(spark: SparkSession, path: str, what: dict) -> None:
    """Raises if the data of a manifest are not all there."""
    if _files(spark, f"{path}/{what['data']}") != what["files"]:
        raise CheckFailed(f"files of {path} are not those that were published")


def load(spark: SparkSession, path: str, kind: str, version: int, *, schema: T.StructType | None = None) -> DataFrame:
    """The table, if it is whole and of this kind, version and, if given, schema; else ``CheckFailed``."""
    what = manifest(spark, path)
    if what is None:
        raise CheckFailed(f"{path} holds no published table")
    if (what["kind"], what["version"]) != (kind, version):
        raise CheckFailed(f"{path} holds {what['kind']} of version {what['version']}, not {kind} of version {version}")
    kept = schema_of(what)
    if schema is not None and [(f.name, f.dataType) for f in kept] != [(f.name, f.dataType) for f in schema]:
        raise CheckFailed(f"{path} has columns {kept.simpleString()}, not {schema.simpleString()}")
    whole(spark, path, what)
    return spark.read.schema(kept).parquet(f"{path}/{what['data']}")


def state_of(spark: SparkSession, *paths: str) -> dict[str, list[int]]:
    """Size and time of change of source files, to tell whether a table built from them is still good."""
    found = {}
    for path in paths:
        at, fs = _fs(spark, path)
        found[path] = [fs.getContentSummary(at).getLength(), changed_at(spark, path)]
    return found


def fresh(spark: SparkSession, path: str, kind: str, version: int, source: dict) -> bool:
    """Whether a table of this kind and version is there, built from the sources as they are now."""
    what = manifest(spark, path)
    return what is not None and (what["kind"], what["version"], what["source"]) == (kind, version, source)
