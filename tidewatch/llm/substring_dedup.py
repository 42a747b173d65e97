"""Passages that an earlier document holds are removed: count-min prefilter, then exact grouping of what it estimates repeated."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SPACE, Slice, cut, discard, map_batches, mix, prefix_hash, range_hash, texts

_U = np.uint64
#: The two rows of the sketch hash by these.
_ROWS = (_U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93))
#: A run of candidate windows is cut before about one window in so many, chosen by its own words.
_CUT_EVERY = 16
#: Bytes of rows that make a chunk. A sketch counts the texts of one, and its rows stay together.
CHUNK_BYTES = 4 << 20
_PACKED = "chunk long, size long, packed binary"


class Windows:
    """The windows of a slice: words, their bytes joined by single spaces, and a hash for each window.

    The hash of a window is the smallest one of the runs of ``anchor`` words in it. Equal windows have equal hashes,
    and neighbours mostly share one, so a text has far fewer hashes than windows.
    """

    def __init__(self, piece: Slice, width: int, anchor: int):
        starts, ends, self.first = piece.words(SPACE)
        n = len(starts)
        self.lengths = ends - starts
        self.at = np.zeros(n + 1, np.int64)
        np.cumsum(self.lengths + 1, out=self.at[1:])
        self.flat = np.full(self.at[-1], 0x20, np.uint8)
        inside = np.flatnonzero(~SPACE[piece.data])
        self.flat[np.arange(len(inside)) + np.repeat(np.arange(n), self.lengths)] = piece.data[inside]
        self.row = np.repeat(np.arange(piece.n), np.diff(self.first))
        m = max(0, n - width + 1)
        p = prefix_hash(self.flat)
        i = np.arange(m + width - anchor if m else 0)
        self.gram = range_hash(p, self.at[i], self.at[i + anchor] - 1)
        self.hash = self.gram[:m].copy()
        for j in range(1, width - anchor + 1):
            np.minimum(self.hash, self.gram[j : j + m], out=self.hash)
        self.valid = np.arange(m) + width <= self.first[self.row[:m] + 1]
        self.width = width

    def of_each_row(self) -> np.ndarray:
        """The different hashes of each row."""
        at = np.flatnonzero(self.valid)
        h, r = self.hash[at], self.row[at]
        new = np.ones(len(at), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[new], r[new]
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        return h[new]

    def digests(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(n, 2) 128-bit digests of the words [begin, end)."""
        raw = self.flat.tobytes()
        found = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(self.at[begins].tolist(), (self.at[ends] - 1).tolist())]
        return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in either row of the sketch; the second row's cells follow the first's."""
    return [(mix(h ^ salt) & _U((1 << bits) - 1)).astype(np.int64) + (i << bits) for i, salt in enumerate(_ROWS)]


def _encoded(gaps: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """Numbers by sevens of bits, the lowest first, all but the last byte of each with the highest bit; in pieces that begin there."""
    sizes = np.ones(len(gaps), np.int64)
    k = 7
    while len(more := np.flatnonzero(gaps >> k)):
        sizes[more] += 1
        k += 7
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > k)
        out[ends[at] - sizes[at] + k] = gaps[at] >> 7 * k & 127 | np.where(sizes[at] > k + 1, 128, 0)
    edges, raw = np.append(np.append(0, ends)[begins], len(out)).tolist(), out.tobytes()
    return [raw[x:y] for x, y in zip(edges[:-1], edges[1:])]


def packed(sorted_cells: np.ndarray, block_bits: int) -> Iterator[tuple[int, bytes]]:
    """(block, bytes) of sorted different cells: the first one's place in the block, then gaps."""
    if not len(sorted_cells):
        return
    block = sorted_cells >> block_bits
    begins = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    gaps = np.diff(sorted_cells, prepend=0)
    gaps[begins] = sorted_cells[begins] & ((1 << block_bits) - 1)
    yield from zip(block[begins].tolist(), _encoded(gaps, begins))


def _all_unpacked(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all pieces, one piece after the other, each counted from its block's first; and how many each has."""
    steps = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.flatnonzero(steps < 128)
    begins = np.append(0, ends + 1)[:-1]
    sizes = ends + 1 - begins
    gaps = (steps[begins] & 127).astype(np.int64)
    for k in range(1, int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > k)
        gaps[at] |= (steps[begins[at] + k] & 127).astype(np.int64) << 7 * k
    edges = np.searchsorted(ends, np.append(0, np.cumsum([len(x) for x in pieces], dtype=np.int64)))
    total, n = np.append(0, np.cumsum(gaps)), np.diff(edges)
    return total[1:] - np.repeat(total[edges[:-1]], n), n


def unpacked(raw: bytes) -> np.ndarray:
    """The cells of one block, counted from its first."""
    return _all_unpacked([raw])[0]


def _block_bits(bits: int) -> int:
    """There are 64 blocks of cells, or as many that none has over 2 ** 25, as one task holds a block's."""
    return min(25, max(3, bits - 5))


def _pack(text_at: int):
    """Chunks of rows, each as one compressed Arrow stream. size: bytes of their texts."""

    def run(batches):
        part, seq, held, sizes, room = TaskContext.get().partitionId(), 0, [], 0, CHUNK_BYTES

        def made() -> pa.RecordBatch:
            rows, sink = pa.Table.from_batches(held).combine_chunks(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))) as out:
                out.write_table(rows)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([sizes]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "size", "packed"])

        for batch in batches:
            text = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.append(0, np.cumsum(text))
            filled = ends + np.arange(len(ends)) * max(16, int(batch.nbytes - ends[-1]) // max(1, len(text)))
            i = 0
            while i < len(text):
                j = min(len(text), max(i + 1, int(np.searchsorted(filled, filled[i] + room))))
                held.append(batch.slice(i, j - i))
                sizes, room, i = sizes + int(ends[j] - ends[i]), room - int(filled[j] - filled[i]), j
                if room <= 0:
                    yield made()
                    seq, held, sizes, room = seq + 1, [], 0, CHUNK_BYTES
        if held:
            yield made()

    return run


def _opened(raw: pa.Scalar) -> pa.RecordBatch:
    """The rows of a chunk."""
    return pa.ipc.open_stream(raw.as_buffer()).read_all().combine_chunks().to_batches()[0]


def _judged(rows: pa.RecordBatch) -> pa.Array:
    """The texts that windows are taken from: none of a row without an id."""
    if "id" not in rows.schema.names:
        return rows.column("text")
    return pc.if_else(pc.is_valid(rows.column("id")), rows.column("text"), pa.scalar(None, rows.column("text").type))


def _gathered(chunks: DataFrame, more: DataFrame, function: Callable[[int, pa.RecordBatch, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What function makes of each chunk, its rows and those of ``more`` that name it."""
    kinds = {f.name: f.dataType for f in more.schema if f.name != "chunk"}
    both = chunks.select("chunk", "packed", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    both = both.union(more.select("chunk", F.lit(None).cast("binary"), *kinds))

    def run(table: pa.Table) -> pa.Table:
        own = pc.is_valid(table["packed"])
        return function(table["chunk"][0].as_py(), _opened(table["packed"].filter(own)[0]), table.filter(pc.invert(own)))

    return both.groupBy("chunk").applyInArrow(run, schema)


def _sketch(width: int, anchor: int, bits: int):
    """The sketch of each chunk: for each block of cells those counted once at least and those counted twice."""
    block_bits = _block_bits(bits)

    def run(batches):
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = [Windows(piece, width, anchor).of_each_row() for piece in texts(_judged(_opened(raw)))]
                once: dict[int, bytes] = {}
                twice: dict[int, bytes] = {}
                for c in cells(np.concatenate(hashes), bits):
                    c, n = np.unique(c, return_counts=True)
                    once |= packed(c, block_bits)
                    twice |= packed(c[n > 1], block_bits)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(once), pa.int64()), pa.array(list(once), pa.int32()), pa.array(list(once.values()), pa.binary()), pa.array([twice.get(b, b"") for b in once], pa.binary())], ["chunk", "block", "once", "twice"])

    return run


def _merge(bits: int):
    """A block of all sketches: the cells that they together count twice or more, for each chunk those of its own."""
    block_bits = _block_bits(bits)

    def run(table: pa.Table) -> pa.Table:
        cell, n = _all_unpacked(table["once"].to_pylist())
        again, often = np.sort(cell), np.zeros(1 << block_bits, bool)
        often[again[1:][again[1:] == again[:-1]]] = True
        often[_all_unpacked(table["twice"].to_pylist())[0]] = True
        own = often[cell]
        cell, row = cell[own], np.repeat(np.arange(len(n)), n)[own]
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        gaps = np.diff(cell, prepend=0)
        gaps[begins] = cell[begins]
        at = pa.array(row[begins])
        return pa.table({"chunk": table["chunk"].take(at), "block": table["block"].take(at), "cells": pa.array(_encoded(gaps, begins), pa.binary())})

    return run


def counted(chunks: DataFrame, width: int, anchor: int, bits: int) -> DataFrame:
    """(chunk, block, cells): of each chunk's cells those that the merged sketch counts twice or more."""
    sketches = map_batches(chunks.select("chunk", "packed"), _sketch(width, anchor, bits), "chunk long, block int, once binary, twice binary")
    return sketches.groupBy("block").applyInArrow(_merge(bits), "chunk long, block int, cells binary")


class Repeated:
    """Cells that the merged sketch counts twice or more."""

    def __init__(self, column: DataFrame, width: int, anchor: int, bits: int):
        """Those of all rows of a table of one text column, on the driver. Tables of any size go by chunks: see ``counted``."""
        chunks = map_batches(column.toDF("text"), _pack(0), _PACKED)
        self._hold(counted(chunks, width, anchor, bits).toArrow(), bits)

    @classmethod
    def of(cls, found: pa.Table, bits: int) -> Repeated:
        """Those of one chunk, from its rows of ``counted``."""
        made = cls.__new__(cls)
        made._hold(found, bits)
        return made

    def _hold(self, found: pa.Table, bits: int) -> None:
        cell, n = _all_unpacked(found["cells"].to_pylist())
        first = found["block"].to_numpy().astype(np.int64) << _block_bits(bits)
        self.bits, self.known = bits, np.unique(cell + np.repeat(first, n))

    def has(self, h: np.ndarray) -> np.ndarray:
        """False only for hashes of fewer than two rows."""
        if not len(h) or not len(self.known):
            return np.zeros(len(h), bool)
        new = np.append(True, h[1:] != h[:-1])  # neighbours mostly share theirs
        out = np.ones(new.sum(), bool)
        for c in cells(h[new], self.bits):
            out &= self.known[np.minimum(np.searchsorted(self.known, c), len(self.known) - 1)] == c
        return out[np.cumsum(new) - 1]


def _segments(width: int, anchor: int, bits: int):
    """(s1, s2, id, chunk, row, start, n, text): runs of windows estimated repeated, with the digest of their words; a task sends a
    text once, as far as it remembers."""
    sent: set[bytes] = set()

    def run(chunk: int, rows: pa.RecordBatch, found: pa.Table) -> pa.Table:
        repeated, made = Repeated.of(found, bits), []
        for piece in texts(_judged(rows)):
            w = Windows(piece, width, anchor)
            likely = np.flatnonzero(w.valid)
            likely = likely[repeated.has(w.hash[likely])]
            new = np.ones(len(likely), bool)
            new[1:] = np.diff(likely) > 1
            new |= (w.gram[likely] >> _U(40)) % _U(_CUT_EVERY) == 0
            begins = np.flatnonzero(new)
            size = np.diff(np.append(begins, len(likely)))
            first = likely[begins]
            digest = w.digests(first, first + size + width - 1)
            raw, words = w.flat.tobytes(), []
            for d, a, b in zip(digest, w.at[first].tolist(), (w.at[first + size + width - 1] - 1).tolist()):
                name = d.tobytes()
                words.append(None if name in sent else raw[a:b])
                if len(sent) > 1 << 18:
                    sent.clear()
                sent.add(name)
            row = piece.first + w.row[first]
            columns = [pa.array(digest[:, 0]), pa.array(digest[:, 1]), rows.column("id").take(pa.array(row, pa.int64())), pa.array(np.full(len(row), chunk)), pa.array(row, pa.int32()), pa.array(first - w.first[w.row[first]], pa.int32()), pa.array(size, pa.int32()), pa.array(words, pa.binary()).cast(pa.string())]
            made.append(pa.RecordBatch.from_arrays(columns, ["s1", "s2", "id", "chunk", "row", "start", "n", "text"]))
        return pa.Table.from_batches(made)

    return run


def _expand(width: int, bits: int):
    """(k1, k2, rep, s1, s2, offs): the windows of segments that are estimated to be in two of them, each once with its places."""

    def run(chunk: int, rows: pa.RecordBatch, found: pa.Table) -> pa.Table:
        repeated, made = Repeated.of(found, bits), []
        for piece in texts(rows.column("text")):
            w = Windows(piece, width, width)
            likely = np.flatnonzero(w.valid)
            likely = likely[repeated.has(w.hash[likely])]
            digest, row = w.digests(likely, likely + width), w.row[likely]
            order = np.lexsort((digest[:, 1], digest[:, 0], row))
            digest, row, likely = digest[order], row[order], likely[order]
            new = np.ones(len(order), bool)
            new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)
            begins = np.flatnonzero(new)
            offs = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)), pa.int32()), pa.array(likely - w.first[row], pa.int32()))
            at = pa.array(piece.first + row[begins], pa.int64())
            columns = [pa.array(digest[begins, 0]), pa.array(digest[begins, 1]), *[rows.column(c).take(at) for c in ("rep", "s1", "s2")], offs]
            made.append(pa.RecordBatch.from_arrays(columns, ["k1", "k2", "rep", "s1", "s2", "offs"]))
        return pa.Table.from_batches(made)

    return run


def _cut_out(width: int):
    """Texts without the words that ranges of windows cover."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(chunk: int, rows: pa.RecordBatch, found: pa.Table) -> pa.Table:
        ranges = dict(zip(found["row"].to_pylist(), found["ranges"].to_pylist()))
        kept, total, gone, removed = [], [], [], []
        for piece in texts(rows.column("text")):
            w = Windows(piece, width, width)
            n = len(w.lengths)
            edge = np.zeros(n + 1, np.int64)
            for r in range(piece.n):
                for x in ranges.get(piece.first + r, ()):
                    edge[w.first[r] + x["start"]] += 1
                    edge[w.first[r] + x["start"] + x["n"] + width - 1] -= 1
            out = np.cumsum(edge)[:n] > 0
            raw = w.flat[np.repeat(~out, w.lengths + 1)].tobytes()
            ends = np.append(0, np.cumsum(np.where(out, 0, w.lengths + 1)))[w.first]
            kept += [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            covered = np.append(0, np.cumsum(out))
            total += np.diff(w.first).tolist()
            gone += np.diff(covered[w.first]).tolist()
            for a, b in zip(w.first[:-1], w.first[1:]):
                turn = np.flatnonzero(np.diff(out[a:b].astype(np.int8), prepend=0, append=0))
                removed.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2])])
        added = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, spans), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table([*rows.columns, *added], [*rows.schema.names, "n_words", "n_removed", "removed", "kept"])

    return run


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 13,
    anchor: int = 8,
    most_bits: int = 40,
    keep: list[str] | None = None,
) -> DataFrame:
    """(id, n_words, n_removed, removed, kept, and the columns ``keep``) of every row of docs.

    Words are runs of bytes other than white space. A window is ``width`` consecutive words of a text. Words
    in a window whose words are also a window of a row with a smaller id are removed; windows are judged on the texts
    as given. removed has the merged word ranges [start, end), kept the other words, joined by one space.

    docs is read once: its rows are written in compressed chunks, and a row is known by its chunk and place. Each chunk
    counts the window hashes of its rows (each row's different ones once) in a count-min sketch of two rows, and sends
    the cells that it counted. Blocks of cells are merged, each in one task; the merged sketch never underestimates, and of a
    chunk's cells those of 'two or more' go back to it. Runs of windows so estimated are cut into segments at places that
    their words choose, and equal segments are grouped by a 128-bit digest of their words: in all
    rows but that of the smallest id they go whole. Segments of that row are taken apart, sketched once more against one another, and the windows
    that remain are grouped exactly, by digest. So copies, however many, never meet as windows.

    The sketch has a cell in each row for each byte of text, and at most 2 ** most_bits of them; with fewer it only passes
    more windows on to the exact grouping. Nothing of it is broadcast or comes to the driver, so it keeps pace with the table.

    Null and empty texts have no words, and those of fewer than ``width`` words no windows. A row with a null id is kept whole and
    removes nothing. Rows of one id, or equal rows, don't remove one another's words. Other columns are ignored; ``keep`` may not
    name n_words, n_removed, removed or kept. An empty table gives no rows.
    """
    anchor = min(anchor, width)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k_{c}") for c in keep or [] if c != text_col])
    write = lambda df: cut(df, codec="zstd", free=True)

    def sketched(chunks: DataFrame, anchor: int) -> tuple[DataFrame, int]:
        bits = min(most_bits, max(10, int(chunks.agg(F.sum("size")).first()[0] or 0).bit_length()))
        return write(counted(chunks, width, anchor, bits)), bits

    chunks = write(map_batches(rows, _pack(1), _PACKED))
    found, bits = sketched(chunks, anchor)
    segments = write(_gathered(chunks, found, _segments(width, anchor, bits), "s1 long, s2 long, id long, chunk long, row int, start int, n int, text string"))
    discard(found)
    key = ["s1", "s2"]
    firsts = segments.groupBy(*key).agg(F.min("id").alias("rep"), F.first("text", ignorenulls=True).alias("text"))
    reps = write(map_batches(firsts, _pack(3), _PACKED))
    again, bits = sketched(reps, width)
    windows = write(_gathered(reps, again, _expand(width, bits), "k1 long, k2 long, rep long, s1 long, s2 long, offs array<int>"))
    discard(again, reps)
    shared = write(windows.groupBy("k1", "k2").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").drop("most"))
    late = windows.join(shared, ["k1", "k2"]).where("rep > least").groupBy(*key).agg(F.flatten(F.collect_list("offs")).alias("offs"))  # at most a segment's windows
    late = write(late)
    discard(windows, shared)
    judged = segments.drop("text").join(segments.groupBy(*key).agg(F.min("id").alias("rep")).join(late, key, "left"), key)
    whole = F.array(F.struct("start", "n"))
    ones = F.transform("offs", lambda o: F.struct((F.col("start") + o).alias("start"), F.lit(1).alias("n")))
    judged = judged.withColumn("hit", F.when(F.col("id") > F.col("rep"), whole).otherwise(ones)).where("hit is not null")
    ranges = judged.select("chunk", "row", F.explode("hit").alias("x")).groupBy("chunk", "row").agg(F.collect_set("x").alias("ranges"))  # at most a text's windows
    ranges = write(ranges)
    discard(late, segments)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = _gathered(chunks, ranges, _cut_out(width), f"{kinds}, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "removed", "kept", *[F.col("text" if c == text_col else f"k_{c}").alias(c) for c in keep or []])
