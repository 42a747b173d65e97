"""Encodings of files, inventories of large files, bundles' metadata, wrapped models."""

import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import detectors
from tidewatch.sources import captures

SF = "/root/testdata/sf0.001"


def test_each_file_of_a_folder_has_its_encoding(spark, tmp_path):
    where = tmp_path / "a folder"
    where.mkdir()
    (where / "one file.csv").write_bytes("Label,f0\nCafé – x,1\n".encode())
    (where / "two+2.csv").write_bytes("Label,f0\nCafé,2\nplain,3\n".encode("latin-1"))
    (where / "three.csv").write_bytes(b"Label,f0\nplain,4\n")
    (where / "empty.csv").write_bytes(b"")
    got = {r.f0: r.Label for r in captures.read_flow_csv(spark, [str(where)]).collect() if r.f0}
    assert got == {"1": "Café – x", "2": "Café", "3": "plain", "4": "plain"}
    forced = [r.Label for r in captures.read_flow_csv(spark, [str(where / "two+2.csv")], encoding="UTF-8").collect()]
    assert "�" in forced[0]
    alone = captures.read_flow_csv(spark, [str(where / "two+2.csv"), str(where / "one file.csv")])
    assert {r.Label for r in alone.collect()} == {"Café", "plain", "Café – x"}


def test_inventory_equals_read_blob_whole_or_in_pieces(spark):
    want = sorted(duckdb.sql(f"select parse_filename(filename), size, sha256(content) from read_blob('{SF}/*.parquet')").fetchall())
    for whole in (1 << 28, 0, 5000):
        assert sorted(map(tuple, captures.file_inventory(spark, SF, "*.parquet", whole=whole, piece=1000).collect())) == want


def test_inventory_of_a_file_over_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)
    digest = hashlib.sha256()
    for _ in range(size >> 23):
        digest.update(bytes(1 << 23))
    digest.update(bytes(size & ((1 << 23) - 1)))
    assert list(captures.file_inventory(spark, str(tmp_path), "*.bin").first()) == ["big.bin", size, digest.hexdigest()]


def test_metadata_of_a_bundle(spark, tmp_path):
    df = spark.createDataFrame([("fit", "A", 1.0, 2.0), ("fit", "B", 1.0, 2.0), ("test", "C", 3.0, 4.0)], "split string, y string, g double, f double")
    meta = captures.describe_bundle(df, "y", {"seed": 42})
    assert meta == {"features": ["f", "g"], "classes": ["A", "B", "C"], "shapes": {"fit": [2, 2], "test": [1, 2]}, "config": {"seed": 42}}
    captures.write_bundle(df, meta, str(tmp_path / "b"))
    assert captures.read_bundle(spark, str(tmp_path / "b"))[1] == meta


def test_a_model_is_loaded_once_in_a_task(spark, tmp_path):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(rng.normal(size=(400, 2)).tolist(), "a double, b double").repartition(2)
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write("x")
        return lambda x: np.abs(x).sum(axis=1)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        out = detectors.wrap_model(load, df, df, ["a", "b"], k=3, embed_fn=lambda: lambda x: x[:, :1], load=True)
        fitted = len(open(log).read())
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(open(log).read()) - fitted <= 2  # one for each of two tasks, in many batches
    assert all(np.isclose(r.score, abs(r.a) + abs(r.b)) and r.embedding == [r.a, 0.0, 0.0] for r in rows)
    assert abs(np.mean([r.flag for r in rows]) - 0.05) < 0.01
    assert set(out.columns) == {"a", "b", "score", "flag", "trust", "embedding"}
