"""Token counts of documents in flat token files, by a scan for separators."""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import cut, map_batches, shared_dir

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before merging (the public pattern of this vocabulary).
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The end-of-document identifier: the vocabulary's first free one.
SEPARATOR = 50256
_DTYPE = np.dtype("<u2")


def _ranges(batches):
    """Each (stream, block, at, size) with its bytes, read by the task itself."""
    for batch in batches:
        for path, block, at, size in zip(*(c.to_pylist() for c in batch.columns)):
            system, name = pafs.FileSystem.from_uri(path)
            with system.open_input_file(name) as f:
                f.seek(at)
                raw = f.read(size)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int32()), pa.array([raw], pa.binary())], ["stream", "block", "tokens"])


def read_token_files(spark: SparkSession, path: str, block_tokens: int = 1 << 20, names: str = "*") -> DataFrame:
    """(stream, block, tokens) of flat files of little-endian 16-bit identifiers, of any size; of a folder those whose names fit ``names``.

    A file is a stream, named by its path; an odd last byte is left out, and an empty file has no block. Spark lists
    the files, and tasks read ranges of block_tokens identifiers each, spread evenly, so a large file is many tasks' work.
    Ranges are read by pyarrow's file systems (local or mounted, HDFS, S3, GCS).
    """
    width = _DTYPE.itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select(F.col("path").alias("stream"), (F.col("length") - F.col("length") % width).alias("n")).where("n > 0")
    cuts = files.select("stream", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block_tokens * width).cast("long"))).alias("block", "at"))
    cuts = cuts.select("stream", "block", "at", F.least(F.lit(block_tokens * width).cast("long"), F.col("n") - F.col("at")).alias("size"))
    dealt = cuts.repartition(F.xxhash64("stream", "block"))
    return map_batches(dealt, _ranges, "stream string, block int, tokens binary")


def _encode(ranks: str, folder: str, keep_ids: int):
    def run(batches):
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("flat", pat_str=_SPLIT, mergeable_ranks=merges, special_tokens={})
        task = TaskContext.get()
        stream, first, ended = f"part-{task.partitionId():06d}.bin", 0, []
        system, where = pafs.FileSystem.from_uri(folder)
        # Under a name of the attempt until it is whole: a task that runs again replaces the file.
        own = f"{where}/_{stream}-{task.taskAttemptId()}"

        def row():
            return pa.RecordBatch.from_arrays([pa.array([stream]), pa.array([first], pa.int64()), pa.array([ended], pa.list_(pa.int64()))], ["stream", "first_doc", "docs"])

        with system.open_output_stream(own) as out:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out.write(np.array([*encoding.encode_ordinary(text.as_py() or ""), SEPARATOR], _DTYPE).tobytes())
                    ended.append(doc_id)
                    if len(ended) >= keep_ids:
                        yield row()
                        first, ended = first + len(ended), []
        system.move(own, f"{where}/{stream}")
        if ended:
            yield row()

    return run


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """Write each partition's texts as one flat token file in folder (a URI that all executors reach; made here), and
    return (stream, first_doc, docs): a file's name, and the ids of its documents in order, first_doc the place of the first.

    A separator follows every text, empty and null ones too. Null ids stay, repeated rows are written each. The list is
    written beside the files. Partitions without rows, and so an empty table, give files without tokens.
    """
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return cut(map_batches(rows, _encode(ranks, folder, 4096), "stream string, first_doc long, docs array<long>"))


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS, block_tokens: int = 1 << 20) -> DataFrame:
    """(id, n_tokens) of every row: flat files in the shared folder, scanned for separators, and named by the order of writing."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    listed = write_token_files(docs, folder, id_col, text_col, ranks)
    counts = count_tokens(read_token_files(spark, folder, block_tokens, "part-*.bin"))
    counts = counts.withColumn("stream", F.element_at(F.split("stream", "/"), -1))
    names = listed.select("stream", "first_doc", F.posexplode("docs").alias("k", "id")).select("stream", (F.col("first_doc") + F.col("k")).alias("ordinal"), "id")
    return names.join(counts, ["stream", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")


def _scan(separator: int):
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n", "ends", "head", "tail", "inner")}
            for raw in batch.column(2):
                t = np.frombuffer(raw.as_buffer(), _DTYPE) if raw.is_valid else np.zeros(0, _DTYPE)
                at = np.flatnonzero(t == separator)
                out["n"].append(len(t))
                out["ends"].append(len(at))
                out["head"].append(int(at[0]) if len(at) else len(t))
                out["tail"].append(len(t) - 1 - int(at[-1]) if len(at) else len(t))
                out["inner"].append((np.diff(at) - 1).tolist())
            columns = [pa.array(out[k], pa.int64()) for k in ("n", "ends", "head", "tail")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(out["inner"], pa.list_(pa.int64()))], ["stream", "block", *out])

    return run


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(stream, ordinal, n_tokens, closed) of every document in blocks (stream, block, tokens).

    tokens are little-endian 16-bit identifiers; a separator ends a document and isn't counted.
    Each block is searched at once; a prefix scan over the blocks' few numbers carries the open
    document and the ordinal from block to block, whatever number of blocks a document spans. Tokens
    after a stream's last separator are a last document with closed = false. The scan's window
    holds one small row for each block of a stream; tokens never move.

    Null or empty blocks hold no tokens; a document without tokens counts 0; blocks are in order of
    block, of which a stream has each once; other columns are ignored. An empty table gives no rows.
    """
    found = cut(map_batches(blocks.select("stream", "block", "tokens"), _scan(separator), f"stream {blocks.schema['stream'].dataType.simpleString()}, block {blocks.schema['block'].dataType.simpleString()}, n long, ends long, head long, tail long, inner array<long>"))
    stream = Window.partitionBy("stream").orderBy("block")
    upto = stream.rowsBetween(Window.unboundedPreceding, 0)
    small = found.select("stream", "block", "ends", "head", "tail")
    small = small.withColumn("part", F.sum((F.col("ends") > 0).cast("long")).over(upto)).withColumn("before", F.sum("ends").over(upto) - F.col("ends"))
    small = small.withColumn("open", F.sum("tail").over(Window.partitionBy("stream", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    small = small.withColumn("carry", F.coalesce(F.lag("open").over(stream), F.lit(0).cast("long"))).withColumn("last", F.lead("block").over(stream).isNull())
    small = cut(small)
    first = small.where("ends > 0").select("stream", F.col("before").alias("ordinal"), (F.col("carry") + F.col("head")).alias("n_tokens"), F.lit(True).alias("closed"))
    inner = found.where("size(inner) > 0").select("stream", "block", "inner").join(small.select("stream", "block", "before"), ["stream", "block"])
    inner = inner.select("stream", "before", F.posexplode("inner").alias("k", "n_tokens")).select("stream", (F.col("before") + 1 + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    left = small.where("last and open > 0").select("stream", (F.col("before") + F.col("ends")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("closed"))
    return first.union(inner).union(left)
