"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, NOT_ALNUM, Slice, cut, map_batches, mix, prefix_hash, range_hash, texts

_U = np.uint64
_ONE, _TWO = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: Window starts that one cursor scans; long texts are scanned by many cursors side by side.
SEGMENT = 256


def word_hashes(piece):
    data = LOWER[piece.data]
    starts, ends, first = Slice(piece.first, data, piece.offsets).words(NOT_ALNUM)
    hashes = range_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, _U)
    return data, starts, ends, first, hashes


class Patterns:
    """Windows of one length m: shift table over blocks of words, and buckets by the last block."""

    def __init__(self, m: int, windows: dict[tuple[bytes, ...], list[str]]):
        self.m, self.block = m, min(2, m)
        self.words = list(windows)
        self.items = [windows[w] for w in self.words]
        flat = b"".join(b" ".join(w) + b" " for w in self.words)
        _, _, _, _, h = word_hashes(next(texts(pa.array([flat.decode()]))))
        h = h.reshape(-1, m)
        bits = int(np.clip(np.ceil(np.log2(len(h) * m * 8)), 12, 22))
        self.mask = _U((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.block + 1, np.int64)
        for j in range(self.block - 1, m):
            np.minimum.at(self.shift, (self.blocks(h[:, j - self.block + 1], h[:, j]) & self.mask).astype(np.int64), m - 1 - j)
        last = self.blocks(h[:, m - self.block], h[:, m - 1])
        order = np.argsort(last, kind="stable")
        self.last, self.order, self.hashes = last[order], order, h[order]

    def blocks(self, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mix(before * _ONE + at * _TWO) if self.block == 2 else at

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word indexes) and windows whose word hashes occur; no occurrence is missed."""
        m = self.m
        n = np.maximum(np.diff(first) - m + 1, 0)  # window starts of each text
        parts = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = first[text] + part * SEGMENT
        end = np.minimum(at + SEGMENT, first[text] + n[text])
        stops = []
        while len(at):
            block = self.blocks(h[at + m - self.block], h[at + m - 1])
            step = self.shift[(block & self.mask).astype(np.int64)]
            stops.append(at[step == 0])
            at = at + np.maximum(step, 1)
            at, end = at[at < end], end[at < end]
        at = np.concatenate(stops) if stops else np.zeros(0, np.int64)
        block = self.blocks(h[at + m - self.block], h[at + m - 1]) if len(at) else np.zeros(0, _U)
        lo, hi = np.searchsorted(self.last, block, "left"), np.searchsorted(self.last, block, "right")
        size = hi - lo
        where = np.repeat(at, size)
        which = np.repeat(lo, size) + np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)
        for j in range(m):
            same = h[where + j] == self.hashes[which, j]
            where, which = where[same], which[same]
        return where, self.order[which]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(shared, text_at: int):
    """The columns of each batch, and n_words, hits and items."""

    def run(batches):
        groups: list[Patterns] = shared.value
        for batch in batches:
            n_words, hits, items = [], [], []
            for piece in texts(batch.column(text_at)):
                data, starts, ends, first, h = word_hashes(piece)
                spans: dict[int, list] = {}
                found: dict[int, set] = {}
                raw = data.tobytes()
                for g in groups:
                    where, which = g.search(h, first)
                    row = np.searchsorted(first, where, "right") - 1
                    for a, w, r in zip(where.tolist(), which.tolist(), row.tolist()):
                        if all(raw[starts[a + j] : ends[a + j]] == x for j, x in enumerate(g.words[w])):
                            base = int(first[r])
                            spans.setdefault(r, []).append((a - base, a - base + g.m))
                            found.setdefault(r, set()).update(g.items[w])
                n_words += np.diff(first).tolist()
                for r in range(piece.n):
                    hits.append([{"start": a, "end": b} for a, b in _merge(spans.get(r, []))])
                    items.append(sorted(found.get(r, ())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))], [*batch.schema.names, "n_words", "hits", "items"])

    return run


def _blocks(bench: DataFrame, chars: int):
    """Items in blocks of about so many characters; the driver holds one block at a time."""
    block, size = [], 0
    for item, text in bench.toLocalIterator():
        block.append((item, text))
        size += len(text)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _patterns(block: list[tuple[str, str]], width: int) -> list[Patterns]:
    by_length: dict[int, dict[tuple, list]] = {}
    for piece_item, text in block:
        data, starts, ends, _, _ = word_hashes(next(texts(pa.array([text]))))
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts, ends)]
        m = min(width, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), []).append(piece_item)
    return [Patterns(m, w) for m, w in sorted(by_length.items())]


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    block_chars: int = 2_000_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """(id, n_words, n_hit, hits, items, contaminated, and the columns ``keep``) for every row of docs.

    Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z
    lower-cased. A window is ``width`` consecutive words of an item, or all of a
    shorter one. hits are the merged word ranges [start, end) that windows cover, n_hit
    their words, items the sorted ids (as strings) of items with a window in the text;
    contaminated when n_hit > 0 and 20 * n_hit >= n_words.

    The shift tables of one block of items (at most block_chars characters and one item
    more) are broadcast, and rows are searched where they lie. A larger benchmark takes a further
    pass over the texts for each block, from which only rows with hits are written; they join the last pass.

    Null or empty texts have no words and no hits; null or empty items no windows; a null
    item id reads 'null'; ties, repeated rows and items count once in a row's items.
    Other columns are ignored; ``keep`` may not name n_words, n_hit, hits, items or contaminated. Empty tables give no rows, or rows without hits.
    """
    spark = docs.sparkSession
    bench = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k_{c}") for c in keep or [] if c != text_col])
    own = F.xxhash64("id", "text")

    def scanned(df: DataFrame, block: list) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return map_batches(df, _scan(spark.sparkContext.broadcast(_patterns(block, width)), df.columns.index("text")), f"{schema}, n_words long, hits array<struct<start: long, end: long>>, items array<string>")

    earlier, last = [], []
    for block in _blocks(bench, block_chars):
        if last:
            found = scanned(rows.select("id", own.alias("row"), "text"), last).where("size(hits) > 0").select("id", "row", "hits", "items")
            earlier.append(cut(found.dropDuplicates(["id", "row"])))
        last = block
    out = scanned(rows, last)
    if earlier:
        more = reduce(DataFrame.union, earlier).groupBy(F.col("id").alias("more_id"), F.col("row").alias("more_row")).agg(F.flatten(F.collect_list("hits")).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items"))  # at most one row for each block
        out = out.withColumn("row", own).join(more, F.col("id").eqNullSafe(F.col("more_id")) & (F.col("row") == F.col("more_row")), "left")
        out = out.withColumn("hits", F.when(F.col("more_hits").isNull(), F.col("hits")).otherwise(_merged(F.array_sort(F.concat("hits", "more_hits")))))
        out = out.withColumn("items", F.when(F.col("more_items").isNull(), F.col("items")).otherwise(F.array_sort(F.array_union("items", "more_items"))))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    out = out.withColumn("n_hit", n_hit).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "hits", "items", "contaminated", *[F.col("text" if c == text_col else f"k_{c}").alias(c) for c in keep or []])


def _merged(spans: F.Column) -> F.Column:
    """Sorted spans with those that meet made one."""
    none = F.expr("cast(array() as array<struct<start: long, end: long>>)")

    def step(done, x):
        end = F.try_element_at(done, F.lit(-1))
        longer = F.struct(end["start"].alias("start"), F.greatest(end["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (end["end"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, none, step)
