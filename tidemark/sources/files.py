"""Readers and writers of files: archives, triangles with a file or folder for each location, schedules, result tables.

Files are listed, read and written by Spark alone, so they may lie in any store that it knows.
"""

from __future__ import annotations

import csv
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import ARCHIVE, map_columns
from ..models import MODELS, rounded, run
from ..storage import scratch

#: Formats of a triangle's files; of those that a folder holds the first is read, the others are older copies.
FORMATS = ("parquet", "csv.gz", "csv")
#: Names of files beside a triangle's own.
SIDECARS = ("schedule", "summary", "settings", "inventory", "test_dates", "genuine_rows", "raw_source", "skipped_locations")
_TYPES = {"geo_value": "string", "reference_date": "date", "report_date": "date", "target_date": "date", "test_date": "date", "experiment_end_date": "date",
          "lag": "int", "target_lag": "int", "fold": "int", "training_days": "int", "testing_days": "int", "value": "double"}


def typed(df: DataFrame) -> DataFrame:
    """df with the columns that have a known type cast to it; what cannot be cast is null. Rows whose lags have fractions fail."""

    def whole(c: str):
        x = F.expr(f"try_cast(`{c}` AS double)")
        return F.when(x != F.floor(x), F.raise_error(F.concat(F.lit(f"{c} has fractions: "), x.cast("string")))).otherwise(x.cast("int"))

    return df.withColumns({c: whole(c) if c in ("lag", "target_lag") else F.expr(f"try_cast(`{c}` AS {t})") for c, t in _TYPES.items() if c in df.columns})


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names in a CSV file's first line, which is all that is read of it."""
    jvm = spark.sparkContext._jvm
    at, conf = jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()
    stream = at.getFileSystem(conf).open(at)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        line = reader.readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([(line or "").removeprefix("\ufeff")]), []))


def _read(spark: SparkSession, kind: str, paths: list[str], **options: str) -> DataFrame:
    """Files of a kind by the names of their columns, whatever their order; a column that a file does not have is null there.

    CSV files are grouped by their first lines, which are small and as many as the files; each group is read as one.
    """
    if kind == "parquet":
        return spark.read.options(mergeSchema="true", **options).parquet(*paths)
    groups: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        groups.setdefault(_header(spark, p), []).append(p)
    parts = [spark.read.options(header="true", enforceSchema="true", **options).schema(", ".join(f"`{c}` string" for c in names)).csv(own) for names, own in groups.items() if names]
    if not parts:
        raise ValueError(f"no header in {', '.join(paths)}")
    named = [part.withColumn("_file", F.col("_metadata.file_name")) for part in parts]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), named)


def _files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Paths of the files of a kind in a folder or of one file; their contents are not read."""
    found = spark.read.format("binaryFile").options(pathGlobFilter=f"*.{suffix}", recursiveFileLookup="true").load(folder)
    return sorted(r["path"] for r in found.select("path").collect())


def read_archive(spark: SparkSession, path: str, names: dict[str, str] | None = None, kind: str | None = None, denominator: str | None = None, lags: tuple[int, int] | None = None) -> DataFrame:
    """An archive from Parquet, CSV or gzipped CSV with a header; names maps each field to its column in the file.

    Columns geo_value, reference_date, report_date, value, and others that there are. Files of a folder may have them in
    any order. Without a geo_value, and without a name for it, all rows are of one location, 'all'. With a denominator,
    value is its share of that column, null where that is not above zero; with lags, reports of other lags are left out.
    """
    kind = kind or ("parquet" if path.rstrip("/").endswith("parquet") else "csv")
    df = _read(spark, kind, [path] if kind == "parquet" else _files(spark, path, "csv*")).drop("_file")
    if "geo_value" not in df.columns and "geo_value" not in (names or {}):
        df = df.withColumn("geo_value", F.lit("all"))
    df = typed(map_columns(df, {f: f for f in ARCHIVE} | (names or {})))
    if denominator:
        below = F.expr(f"try_cast(`{denominator}` AS double)")
        df = df.withColumn("value", F.when(below > 0, F.col("value") / below))
    if lags:
        df = df.withColumn("lag", F.datediff("report_date", "reference_date")).where(F.col("lag").between(*lags))
    return df


def read_triangles(spark: SparkSession, folder: str, sidecars: tuple[str, ...] = SIDECARS) -> DataFrame:
    """A triangle from a folder with a folder geo_value=... for each location, or a file named after each location.

    The first of FORMATS of which there are files is read; files whose names are in sidecars are not the triangle's, and
    are not looked into. Columns go by name: files may have them in any order, and some that others lack.
    """
    for suffix in FORMATS:
        own = [p for p in _files(spark, folder, suffix) if p.rpartition("/")[2].removesuffix(f".{suffix}") not in sidecars]
        if not own:
            continue
        kind = "parquet" if suffix == "parquet" else "csv"
        if any("/geo_value=" in p for p in own):
            return typed(_read(spark, kind, own, basePath=folder).drop("_file"))
        df = _read(spark, kind, own)
        name = F.col("_file") if "_file" in df.columns else F.col("_metadata.file_name")
        named = df.withColumn("geo_value", F.regexp_replace(name, rf"\.{suffix.replace('.', '[.]')}$", ""))
        return typed(named.drop("_file"))
    raise FileNotFoundError(f"no triangle in {folder}")


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """Origins from CSV: fold, test_date, target_lag, training_days, testing_days, experiment_end_date as far as they are there."""
    df = typed(_read(spark, "csv", _files(spark, path, "csv")).drop("_file"))
    if "test_date" not in df.columns:
        raise ValueError("a schedule needs a column test_date")
    return df


def write_tables(tables: dict[str, DataFrame], folder: str, by: tuple[str, ...] = ("method", "fold")) -> None:
    """Each table as Parquet in a folder of its name, in folders by those of `by` that it has; a large folder gets several files."""
    for name, df in tables.items():
        keys = [c for c in by if c in df.columns]
        out = df.hint("rebalance", *keys) if keys else df
        out.write.mode("overwrite").partitionBy(*keys).parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _given(name: str, df: DataFrame) -> DataFrame:
    return rounded(df, MODELS[name].digits)


def scan_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly archive, written as gzipped CSV under foreign names and read back."""
    at = _folder(spark, "archive")
    rows = run(spark, "archive_a", sf_dir).selectExpr("geo_value AS place", "reference_date AS event", "report_date AS issue", "value AS amount")
    rows.write.csv(at, header=True, compression="gzip")
    df = read_archive(spark, at, {"geo_value": "place", "reference_date": "event", "report_date": "issue", "value": "amount"})
    return _given("scan_archive", df.select("geo_value", "reference_date", "report_date", "value"))


def scan_mapped_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file with names of its own, written as CSV and read by those names, lags 0 to 240."""
    at = _folder(spark, "mapped")
    run(spark, "raw_file", sf_dir).write.csv(at, header=True)
    df = read_archive(spark, at, {"geo_value": "place", "reference_date": "event", "report_date": "issue", "value": "amount"}, lags=(0, 240))
    return _given("scan_mapped_archive", df.select("geo_value", "reference_date", "report_date", "lag", "value", F.col("seq").cast("long").alias("seq")))


def scan_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily archive with a folder for each location, written as CSV and, later, as gzipped CSV, which wins."""
    at = _folder(spark, "triangles")
    rows = run(spark, "archive_b", sf_dir)
    rows.selectExpr("geo_value", "reference_date", "report_date", "lag", "-1 AS value").limit(5).write.partitionBy("geo_value").csv(at, header=True)
    rows.write.mode("append").partitionBy("geo_value").csv(at, header=True, compression="gzip")
    return _given("scan_triangles", read_triangles(spark, at).select("geo_value", "reference_date", "report_date", "lag", "value"))


def scan_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "schedule")
    run(spark, "retraining_calendar", sf_dir).write.csv(at, header=True)
    return _given("scan_schedule", read_schedule(spark, at).select("fold", "test_date", "target_lag", "training_days", "testing_days", "experiment_end_date"))


def sink_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long predictions and reliability records, written by method and fold, and what is read back of them."""
    at = _folder(spark, "tables")
    write_tables({"predictions": run(spark, "long", sf_dir), "reliability": run(spark, "reliability_history", sf_dir)}, at)
    back = read_tables(spark, at, ("predictions", "reliability"))
    p = back["predictions"].groupBy("method", F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.avg("absolute_error_working").alias("mean_ae"))
    r = back["reliability"].groupBy("method", F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("records"))
    return _given("sink_tables", p.join(r, ["method", "fold"], "left"))


QUERIES = {f.__name__: f for f in (scan_archive, scan_mapped_archive, scan_triangles, scan_schedule, sink_tables)}
