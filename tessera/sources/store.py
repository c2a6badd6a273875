"""Results of an analysis as Parquet tables: replaced unit by unit, bundled with a manifest, merged so that the later analysis stands."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.move import latest

#: What a bundle may hold at most: tables, and bytes of them all.
MOST_TABLES, MOST_BYTES = 200, 50 << 30
FORMAT = 1


class BadBundle(ValueError):
    """A bundle that can't be taken in."""


def save(df: DataFrame, path: str, by: str = "unit") -> None:
    """Replaces the rows of the units that `df` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def export_bundle(tables: dict[str, DataFrame], path: str, about: dict | None = None) -> dict:
    """Writes each table below a new folder, then a manifest with its rows and columns; a folder without one is no bundle."""
    spark = next(iter(tables.values())).sparkSession
    manifest = {"format": FORMAT, "about": about or {}, "tables": {}}
    for name, df in tables.items():
        _checked(name)
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        manifest["tables"][name] = {"rows": spark.read.parquet(f"{path}/{name}").count(), "columns": df.columns}
    _write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def _checked(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]{1,64}", name):
        raise BadBundle(f"not a name of a table: {name!r}")
    return name


def import_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle after checks of its manifest: format, names, number, size, rows and columns."""
    fs, p = _fs(spark, path)
    got = spark.read.option("wholetext", True).text(f"{path}/manifest.json").head() if fs.exists(_fs(spark, f"{path}/manifest.json")[1]) else None
    try:
        manifest = json.loads(got.value) if got else {}
    except json.JSONDecodeError as e:
        raise BadBundle(f"the manifest can't be read: {e}") from e
    if manifest.get("format") != FORMAT or not isinstance(manifest.get("tables"), dict):
        raise BadBundle("no manifest of a known format")
    if len(manifest["tables"]) > MOST_TABLES:
        raise BadBundle(f"more than {MOST_TABLES} tables")
    if fs.getContentSummary(p).getLength() > MOST_BYTES:
        raise BadBundle(f"more than {MOST_BYTES} bytes")
    out = {}
    for name, said in manifest["tables"].items():
        df = spark.read.parquet(f"{path}/{_checked(name)}")
        if df.columns != said["columns"] or df.count() != said["rows"]:
            raise BadBundle(f"{name} isn't as the manifest says")
        out[name] = df
    return out


def merge_bundles(have: DataFrame, more: DataFrame, keys: list[str], at: str = "analyzed_at") -> DataFrame:
    """Of each key the later analysis; of equals what was there. Merging twice changes nothing."""
    both = have.withColumn("_own", F.lit(1)).unionByName(more.withColumn("_own", F.lit(0)))
    return latest(both, keys, [F.col(at).desc_nulls_last(), F.col("_own").desc()]).drop("_own")
