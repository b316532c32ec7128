"""Settings: defaults under given values, as a dictionary and as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {"base_url": "", "api_key": "", "model": "", "cache_dir": ""}


def load(text: str | None) -> dict[str, str]:
    """Defaults under the values of a JSON text; a damaged text counts as none."""
    try:
        given = json.loads(text or "{}")
    except ValueError:
        given = {}
    return {**DEFAULTS, **(given if isinstance(given, dict) else {})}


def dump(config: dict[str, str]) -> str:
    return json.dumps({k: v.strip() if isinstance(v, str) else v for k, v in config.items()}, ensure_ascii=False, indent=2)


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(spark: SparkSession, path: str, config: dict[str, str]) -> None:
    """Writes settings as UTF-8 JSON to any file system that Spark knows, in place of what was there."""
    where, fs = _file(spark, path)
    out = fs.create(where, True)
    try:
        out.write(dump(config).encode())
    finally:
        out.close()


def read(spark: SparkSession, path: str) -> dict[str, str]:
    """Settings of a file; defaults if there is none."""
    where, fs = _file(spark, path)
    rows = spark.read.text(path, wholetext=True).first() if fs.exists(where) else None
    return load(rows.value if rows else None)


def cache_folder(spark: SparkSession, config: dict[str, str], default: str) -> str:
    """Where the cache lies: the folder that the settings name, made if it is missing, or the default.

    Emptying ``cache_dir`` goes back to the default.
    """
    folder = config.get("cache_dir") or default
    where, fs = _file(spark, folder)
    fs.mkdirs(where)
    return folder


def is_configured(config: dict[str, str]) -> bool:
    return all(config.get(k) for k in ("base_url", "api_key", "model"))


def merge(given: DataFrame, defaults: DataFrame) -> DataFrame:
    """(name, value) of both tables; a given value wins."""
    g, d = given.select("name", F.col("value").alias("g")), defaults.select("name", F.col("value").alias("d"))
    return g.join(d, "name", "full").select("name", F.coalesce("g", "d").alias("value"))
