"""Language-model scoring by cross-entropy difference between a target and a background model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SPACE, cut, map_batches, mix, prefix_hash, range_hash, texts

#: Weight of the uniform prior of each word model, in tokens.
STRENGTH = 4.0
#: Bytes of text whose n-grams leave a task together; never over 65,536 texts.
CHUNK_BYTES = 8 << 20
#: Sums are added up in whole parts of a bit, so that they don't depend on the order of tasks.
PARTS = 1 << 26
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _grams(piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, its text, n_tokens of each text) of a slice: one of order 1 and one of order 2 for each token.

    A text with words is its words and an end, which also stands before the first. Even numbers are
    words (the end is 0), odd ones pairs.
    """
    starts, ends, first = piece.words(SPACE)
    n = np.diff(first)
    size = n + (n > 0)
    last = np.zeros(size.sum(), bool)
    last[np.cumsum(size)[n > 0] - 1] = True
    word, before = np.zeros(len(last), _U), np.zeros(len(last), _U)
    if len(starts):
        word[~last] = range_hash(prefix_hash(piece.data), starts, ends) << _U(1)
        before[1:] = word[:-1]
    pair = mix(before * _STEP + mix(word + _U(1))) | _U(1)
    text = np.repeat(np.arange(piece.n), size)
    return np.concatenate([word, pair]), np.concatenate([text, text]), size


def _places(known: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Index in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(gram), -1)
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    return np.where(known[at] == gram, at, -1)


def _bits(word: np.ndarray, count: np.ndarray, tokens: int, every: int) -> np.ndarray:
    """What one occurrence of an n-gram adds to a text's log2 probability, mean of both orders, in PARTS of a bit.

    Order 1 is log p of the word; order 2 is the log of the pair's share less, once for each word as the one before, its total.
    """
    low = STRENGTH / max(1, every)
    one = np.log2((count + low) / (tokens + STRENGTH)) - np.log2(count + STRENGTH)
    return np.rint(np.where(word, one, np.log2(count + low)) / 2 * PARTS).astype(np.int64)


def _sample_counts(batches):
    """(gram, n) of each task's rows of the sample."""
    for batch in batches:
        for piece in texts(pc.utf8_lower(batch.column(0).fill_null(""))):
            gram, n = np.unique(_grams(piece)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])


def _count(shared):
    """(place, n_all, n_target) of the frequent n-grams; place -1 has the tokens."""

    def run(batches):
        known = shared.value
        sums = np.zeros((2, len(known) + 1), np.int64)
        for batch in batches:
            target = np.asarray(batch.column(2).to_pylist(), bool)
            for piece in texts(pc.utf8_lower(batch.column(1).fill_null(""))):
                gram, text, size = _grams(piece)
                at, mine = _places(known, gram), target[piece.first : piece.first + piece.n]
                sums[0] += np.bincount(at[at >= 0], minlength=len(known) + 1)
                sums[1] += np.bincount(at[(at >= 0) & mine[text]], minlength=len(known) + 1)
                sums[:, -1] += size.sum(), size[mine].sum()
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == len(known), -1, at)), pa.array(sums[0, at]), pa.array(sums[1, at])], ["place", "n_all", "n_target"])

    return run


_PACKED = ["chunk", "bucket", "grams", "counts", "docs", "targets", "ids", "sizes", "sums"]


def _planes(grams: np.ndarray) -> bytes:
    """Sorted numbers byte by byte, the highest bytes of all first: those hardly differ, so a shuffle's compression finds them."""
    return grams.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(">u8").ravel().astype(_U)


def _pack(shared, buckets: int, kind: pa.DataType):
    """For each chunk of texts, a row for each bucket of n-grams: the distinct ones, how often each occurs and in which
    texts of the chunk; and a row (bucket below 0) of the texts' ids, tokens and sums over the frequent n-grams."""

    def run(batches):
        known, bits = shared.value
        part, seq = TaskContext.get().partitionId(), 0
        grams, docs, ids, targets, sizes, sums, held = [], [], [], [], [], [], 0

        def rows():
            chunk = part << 32 | seq
            gram, doc = np.concatenate(grams), np.concatenate(docs)
            order = np.argsort(gram, kind="stable")
            gram, doc = gram[order], doc[order].astype(np.uint16)
            at = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
            gram, n = gram[at], np.diff(np.append(at, len(gram)))
            bucket = ((gram >> _U(32)) * _U(buckets)) >> _U(32)
            flags = np.concatenate(targets).tobytes()
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(gram) else np.zeros(0, np.int64)
            ends, out = np.append(cuts, len(gram)), []
            for a, b in zip(ends[:-1], ends[1:]):
                to = at[b] if b < len(at) else len(doc)
                out.append((chunk, int(bucket[a]), _planes(gram[a:b]), n[a:b].astype(np.uint32).tobytes(), doc[at[a] : to].tobytes(), flags, None, None, None))
            out.append((chunk, -1 - part, None, None, None, None, ids, np.concatenate(sizes).tobytes(), np.concatenate(sums, axis=1).tobytes()))
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(kind), *[pa.binary()] * 2]
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 64]), kinds)], _PACKED)

        for batch in batches:
            names = batch.column(0).to_pylist()
            target = np.asarray(batch.column(2).to_pylist(), bool)
            for piece in texts(pc.utf8_lower(batch.column(1).fill_null(""))):
                gram, text, size = _grams(piece)
                at = _places(known, gram)
                hot = at >= 0
                # Sums as floats are exact: they stay far below 2**53.
                sums.append(np.array([np.bincount(text[hot], b[at[hot]], piece.n) for b in bits]).reshape(2, piece.n).astype(np.int64))
                grams.append(gram[~hot])
                docs.append(text[~hot] + len(ids))
                ids += names[piece.first : piece.first + piece.n]
                targets.append(target[piece.first : piece.first + piece.n])
                sizes.append(size.astype(np.int64))
                held += len(piece.data)
                if held >= CHUNK_BYTES or len(ids) > 65_536 - 1_000:  # a slice has at most a batch's rows
                    yield from rows()
                    grams, docs, ids, targets, sizes, sums, held, seq = [], [], [], [], [], [], 0, seq + 1
        if ids:
            yield from rows()

    return run


def _weigh(tokens: int, good: int, kind: pa.DataType):
    """A bucket's n-grams, of all chunks: counts, and what they add to each text of each chunk. Rows below 0 pass."""

    def run(table: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.binary(), pa.list_(kind), pa.binary(), pa.binary()]
        names = ["chunk", "docs", "ids", "sizes", "sums"]
        if table["bucket"][0].as_py() < 0:
            return table.select(names).cast(pa.schema(list(zip(names, kinds))))
        chunks = table["chunk"].to_pylist()
        gram = [_from_planes(x) for x in table["grams"].to_pylist()]
        n = [np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()]
        docs = [np.frombuffer(x, np.uint16) for x in table["docs"].to_pylist()]
        flags = [np.frombuffer(x, bool) for x in table["targets"].to_pylist()]
        mine = [np.add.reduceat(f[d].astype(np.int64), np.cumsum(k, dtype=np.int64) - k) for f, d, k in zip(flags, docs, n)]
        every, back = np.unique(np.concatenate(gram), return_inverse=True)
        back = back.ravel()
        word = every & _U(1) == 0
        total = np.bincount(back, np.concatenate(n), len(every))
        target = np.bincount(back, np.concatenate(mine), len(every))
        bits = [_bits(word, target, good, tokens), _bits(word, total, tokens, tokens)]
        out, at = [], 0
        for chunk, k, d in zip(chunks, n, docs):
            own = np.repeat(back[at : at + len(k)], k)
            at += len(k)
            size = int(d.max()) + 1
            held = np.flatnonzero(np.bincount(d, minlength=size))
            added = np.array([np.bincount(d, b[own], size)[held] for b in bits]).astype(np.int64)
            out.append((chunk, held.astype(np.uint16).tobytes(), None, None, added.tobytes()))
        return pa.table({m: pa.array(x, t) for m, x, t in zip(names, zip(*out), kinds)})

    return run


def _gather(kind: pa.DataType):
    """The texts of a chunk with all that its n-grams add."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes, sums = [], np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
        for row in table.filter(pc.is_valid(table["ids"])).to_pylist():
            ids, sizes = row["ids"], np.frombuffer(row["sizes"], np.int64)
            sums = np.frombuffer(row["sums"], np.int64).reshape(2, -1).copy()
        for docs, added in zip(table["docs"].to_pylist(), table["sums"].to_pylist()):
            if docs is not None:
                sums[:, np.frombuffer(docs, np.uint16)] += np.frombuffer(added, np.int64).reshape(2, -1)
        return pa.table({"id": pa.array(ids, kind), "n": pa.array(sizes), "target": pa.array(sums[0]), "background": pa.array(sums[1])})

    return run


def cross_entropy_difference(
    docs: DataFrame,
    target_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot: int = 1 << 17,
    sample_chars: int = 1 << 24,
    bucket_grams: int = 1 << 22,
    broadcast_ids: int = 1_000_000,
) -> DataFrame:
    """(id, n_tokens, ce_target, ce_background, ce_difference) for every row, in bits a token.

    Two models over one vocabulary, all words of docs: the background counts every text of docs,
    the target those whose id is in target_ids. A token is a word of the lower-cased text, between
    white space, or the end of a text with words. An entropy is the mean of those of order 1, p(word), and order 2,
    p(word | word before); both have a uniform prior of STRENGTH tokens, spread over as many words as docs has tokens (the
    vocabulary can't be larger). ce_difference = ce_target - ce_background, smaller for texts nearer to the target.

    All words and pairs are counted, so counts grow with the corpus. N-grams leave a task sorted, for about
    CHUNK_BYTES of text together, each with the texts it occurs in. They meet in buckets of about ``bucket_grams``
    occurrences, any number of them, are counted there, and what each text gets goes back to its chunk. N-grams
    with over 1 / (2 * ``hot``) of a sample (texts by hash, about ``sample_chars`` characters; at most 2 * ``hot``
    of them) are counted over all texts first and broadcast, so that no bucket holds a frequent one. The sample
    decides on the way only: counts and scores are the same for any. N-grams are known by 64-bit hashes. Target ids
    are broadcast up to ``broadcast_ids``; beyond, the texts are joined to them and written.

    Null or empty texts: 0 tokens and null entropies. Without target ids the target is
    uniform at both orders. Repeated rows count each and get a row each; null ids are no
    target; other columns are ignored. An empty table gives no rows. docs is read three times and must give the same rows.
    """
    spark = docs.sparkSession
    wanted = target_ids.select(F.col(id_col).alias("t")).where("t is not null").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    few = wanted.limit(broadcast_ids + 1).count() <= broadcast_ids
    marked = rows.join(F.broadcast(wanted) if few else wanted.hint("merge"), F.col("id") == F.col("t"), "left").select("id", "text", F.col("t").isNotNull().alias("target"))
    marked = marked if few else cut(marked)

    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    share = min(1.0, sample_chars / max(1, chars))
    u = F.pmod(F.xxhash64("id", "text", F.lit(29)), F.lit(1 << 30)) / (1 << 30)
    seen = cut(map_batches(rows.where(u < share).select("text"), _sample_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1"))
    # Each order has half of all n-grams; over 1 / hot of one is over 1 / (2 * hot) of both.
    least = max(1.0, (seen.agg(F.sum("n")).first()[0] or 0) / (2 * hot))
    known = np.sort(np.array([r.gram for r in seen.where(F.col("n") > least).select("gram").toLocalIterator()], np.int64).view(_U))

    shared = spark.sparkContext.broadcast(known)
    found = map_batches(marked, _count(shared), "place long, n_all long, n_target long").groupBy("place").agg(F.sum("n_all").alias("a"), F.sum("n_target").alias("t"))
    counts = np.zeros((2, len(known) + 1), np.int64)
    for r in found.toLocalIterator():
        counts[:, r.place] = r.a, r.t
    tokens, good = (int(x) for x in counts[:, -1])
    word = known & _U(1) == 0
    model = spark.sparkContext.broadcast((known, [_bits(word, counts[1, :-1], good, tokens), _bits(word, counts[0, :-1], tokens, tokens)]))

    id_type = docs.schema[id_col].dataType.simpleString()
    kind = rows.select("id").limit(0).toArrow().schema.field(0).type
    buckets = max(1, -(-2 * tokens // bucket_grams))
    packed = map_batches(marked, _pack(model, buckets, kind), f"chunk long, bucket int, grams binary, counts binary, docs binary, targets binary, ids array<{id_type}>, sizes binary, sums binary")
    weighed = packed.groupBy("bucket").applyInArrow(_weigh(tokens, good, kind), f"chunk long, docs binary, ids array<{id_type}>, sizes binary, sums binary")
    out = weighed.groupBy("chunk").applyInArrow(_gather(kind), f"id {id_type}, n long, target long, background long")
    per = lambda c: F.when(F.col("n") > 0, -F.col(c) / PARTS / F.col("n"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), per("target").alias("ce_target"), per("background").alias("ce_background"), (per("target") - per("background")).alias("ce_difference"))
