"""Readers and writers of capture tables: headed CSV files, manifests, inventories and bundles of splits."""

from __future__ import annotations

import hashlib
import json
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import label_fine

MANIFEST = "data_dir string, label_column string, column_aliases map<string,string>, files array<struct<day: string, file: string, format: string, present: boolean, expected_attacks: long>>"


def _trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def _encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Encoding and files of a path: UTF-8 where every line is valid, ISO-8859-1 for the others. Lines are probed by executors; the driver gets a row for each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    out: dict[str, list[str]] = {}
    for file, valid in lines.groupBy("file").agg(F.bool_and("valid").alias("valid")).orderBy("file").collect():
        out.setdefault("UTF-8" if valid else "ISO-8859-1", []).append(unquote(file))
    return out


def read_flow_csv(spark: SparkSession, paths: list[str], encoding: str | None = None, label: str = "Label") -> DataFrame:
    """Headed CSV files as text columns with trimmed names, united by name; files whose columns differ are an error.

    Without an ``encoding`` each file, also of one folder, is read as UTF-8 if it is, and else as ISO-8859-1, so no sign is lost; with one, bytes
    that are not of it become U+FFFD. Numbers are left to ``coerce_numeric``, so there is no pass to infer types.
    """
    out = None
    for p in paths:
        files = {encoding: [p]} if encoding else _encodings(spark, p)
        if len(files) < 2:
            files = {next(iter(files), "UTF-8"): [p]}
        for name, these in files.items():
            df = _trimmed(spark.read.csv(these, header=True, encoding=name))
            if label not in df.columns:
                raise ValueError(f"{p} has no column {label}")
            out = df if out is None else out.unionByName(df)
    return out


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def read_manifest(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """The present files of a JSON manifest: aliases applied, ``label`` normalised, ``day`` added, united by name.

    The driver holds the manifest, one entry for each file. No file for the days is an error.
    """
    m = _manifest(spark, path).first()
    out = None
    for f in m.files:
        if not f.present or (days is not None and f.day not in days):
            continue
        where = f"{m.data_dir}/{f.file}"
        df = read_flow_csv(spark, [where], label=m.label_column) if f.format == "csv" else _trimmed(spark.read.format(f.format).load(where))
        # Every column becomes text, as CSV and other formats are united.
        df = df.withColumnsRenamed(dict(m.column_aliases or {})).withColumn("day", F.lit(f.day))
        df = df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t != "string"})
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("the manifest has no present file for these days")
    name = (m.column_aliases or {}).get(m.label_column, m.label_column)
    return out.withColumn("label", label_fine(F.col(name)))


def manifest_missing(spark: SparkSession, path: str) -> DataFrame:
    """(day, file, expected_attacks) of the files that are not present."""
    return _manifest(spark, path).select(F.inline("files")).where("not present").select("day", "file", "expected_attacks")


def _digests(piece: int):
    """(name, bytes, sha256) of files that a task reads piece by piece."""

    def run(batches):
        for batch in batches:
            found = []
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = pafs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with system.open_input_stream(name) as f:
                    while part := f.read(piece):
                        digest.update(part)
                found.append((path, size, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 3, (pa.string(), pa.int64(), pa.string()))], ["path", "bytes", "sha256"])

    return run


def file_inventory(spark: SparkSession, folder: str, glob: str = "*", whole: int = 1 << 28, piece: int = 1 << 23) -> DataFrame:
    """(name, bytes, sha256) of each file under the folder, read by executors.

    Files of up to ``whole`` bytes are read by Spark, in any store that it reads. Larger ones, of any size, are read in pieces of ``piece`` bytes through pyarrow's file systems
    (local or mounted, HDFS, S3, GCS), so a task's memory doesn't grow with them; a file is one task's work, as its digest is one chain.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", F.col("length").alias("bytes")).repartition("path").mapInArrow(_digests(piece), "path string, bytes long, sha256 string")
    return small.union(large).select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")


def inventory_totals(inventory: DataFrame) -> DataFrame:
    """(files, bytes) of a file_inventory."""
    return inventory.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def capture_name(path: Column) -> Column:
    """Last name of a path; of a folder that Spark has written, the folder's."""
    parts = F.split(path, "/")
    return F.url_decode(F.when(F.element_at(parts, -1).startswith("part-"), F.element_at(parts, -2)).otherwise(F.element_at(parts, -1)))


def tag_capture_day(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """df, fresh from a file reader, with day by the name of its file; names without a day stand for themselves."""
    name = capture_name(F.col("_metadata.file_path"))
    day = F.lit(None).cast("string")
    for k, v in mapping.items():
        day = F.when(name == k, v).otherwise(day)
    return df.select("*", F.coalesce(day, name).alias("day"))


def write_bundle(df: DataFrame, meta: dict, path: str) -> None:
    """Rows in a folder for each split, and the metadata as one JSON line."""
    df.write.partitionBy("split").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first().value)


def describe_bundle(df: DataFrame, y: str, config: dict | None = None) -> dict:
    """Metadata of a bundle: features and classes by name, rows and features of each split, and the configuration; one aggregate."""
    features = sorted(c for c in df.columns if c not in (y, "split"))
    rows = df.groupBy("split").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.col(y).cast("string"))).alias("classes")).orderBy("split").collect()  # a row for each split
    classes = sorted({c for r in rows for c in r.classes})
    return {"features": features, "classes": classes, "shapes": {r.split: [r.n, len(features)] for r in rows}, "config": config or {}}


def bundle_metadata(df: DataFrame, y: str, day: str) -> DataFrame:
    """(split, y, day, n): rows by split and class and by split and day, with the totals of each split."""
    return df.groupingSets([["split"], ["split", y], ["split", day]], "split", y, day).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
