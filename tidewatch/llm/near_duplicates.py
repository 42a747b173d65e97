"""MinHash near-duplicates by a chosen-path set similarity join."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, SPACE, cut, discard, map_batches, mix, prefix_hash, range_hash, texts
from .graph import components

_U = np.uint64
#: Numbers that a signature holds; each is the smallest of one hash function over the set.
SIGNATURE = 64
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, (2, SIGNATURE), dtype=np.uint64) | _U(1)
_WORD = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)


def shingle_sets(piece, width: int):
    """For every text of a slice, the sorted distinct hashes of its shingles."""
    data = LOWER[piece.data]
    starts, ends, first = piece.words(SPACE)
    if not len(starts):
        for _ in range(piece.n):
            yield np.zeros(0, _U)
        return
    words = range_hash(prefix_hash(data), starts, ends)
    runs = np.zeros(max(0, len(words) - width + 1), _U)
    for k in range(width):
        runs += words[k : k + len(runs)] * _WORD[k]
    runs = mix(runs)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:  # the whole sequence; its length keeps it apart from full shingles
            yield mix((words[a:b] * _WORD[: b - a]).sum(keepdims=True) + _U(b - a))
        else:
            yield np.zeros(0, _U)


def signature(shingles: np.ndarray) -> bytes:
    low = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096, None] * _SEEDS[0] + _SEEDS[1]
        low = np.minimum(low, (part.min(axis=0) >> _U(32)).astype(np.uint32))
    return low.tobytes()


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: a sum and an exclusive or of mixed members."""
    if not len(shingles):
        return 0, 0
    m = mix(shingles + _U(len(shingles)))
    return int(np.add.reduce(m).astype(np.int64)), int(np.bitwise_xor.reduce(mix(m)).astype(np.int64))


def _sign(width: int):
    def run(batches):
        for batch in batches:
            n, high, low, sigs = [], [], [], []
            for piece in texts(batch.column(1)):
                for s in shingle_sets(piece, width):
                    key = set_key(s)
                    n.append(len(s))
                    high.append(key[0])
                    low.append(key[1])
                    sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sigs, pa.binary())], ["id", "row", "n", "h1", "h2", "sig"])

    return run


def _sets(width: int):
    """The set of each wanted row (id, text, h1, h2), once in a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            out: tuple[list, list] = ([], [])
            for i, s in enumerate(x for piece in texts(batch.column(1)) for x in shingle_sets(piece, width)):
                if ids[i] not in seen and set_key(s) == wanted[i]:
                    seen.add(ids[i])
                    out[0].append(ids[i])
                    out[1].append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["id", "shingles"])

    return run


def _paths(trees: int, rows: int):
    """Root branches: each tree selects ``rows`` positions and branches on their minwise tokens."""
    pick = np.array([np.random.default_rng(1000 + t).choice(SIGNATURE, rows, replace=False) for t in range(trees)])

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, SIGNATURE).astype(_U)
            key = np.zeros((len(sig), trees), _U) + np.arange(1, trees + 1, dtype=_U)
            for r in range(rows):
                key = mix(key * _WORD[r] + sig[:, pick[:, r]])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), trees))], ["path", "id"])

    return run


def _branch(children: int):
    """Children of a node: positions follow from the node alone, so all its documents select the same ones."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, SIGNATURE)
            node = batch.column(0).to_numpy().view(_U)
            made, row = [], np.arange(len(sig))
            for c in range(children):
                at = mix(node + _U(c + 1)) % _U(SIGNATURE)
                made.append(mix(mix(node + _U(c + 1)) + sig[row, at.astype(np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64)), pa.array(np.tile(batch.column(1).to_numpy(), children))], ["path", "id"])

    return run


def _alike(least: float):
    """Pairs whose signatures agree often enough to be worth a full comparison."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, SIGNATURE) for i in (2, 3))
            keep = pa.array((a == b).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return run


def _block(percent: int):
    """Links between the documents of two blocks, on full sets; of each document's, one for each component."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        if len(left) and len(right):
            x, y = ([np.frombuffer(v.as_buffer(), _U) for v in t["shingles"].combine_chunks()] for t in (left, right))
            nx, ny = np.array([len(v) for v in x]), np.array([len(v) for v in y])
            fx, fy = np.concatenate(x), np.concatenate(y)
            common = np.intersect1d(fx, fy)
            shared = np.zeros((len(x), len(y)))
            rx, ry = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
            for i in range(0, len(common), 16384):
                part = common[i : i + 16384]
                held = []
                for flat, row, n in ((fx, rx, len(x)), (fy, ry, len(y))):
                    at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
                    hit = part[at] == flat
                    m = np.zeros((n, len(part)), np.float32)
                    m[row[hit], at[hit]] = 1
                    held.append(m)
                shared += held[0] @ held[1].T
            alike = 100 * shared >= percent * (nx[:, None] + ny - shared)
            ids, others, cx, cy = left["id"].to_numpy(), right["id"].to_numpy(), left["c"].to_numpy(), right["c"].to_numpy()
            alike &= cx[:, None] != cy
            for r in np.flatnonzero(alike.any(axis=1)):
                found = np.flatnonzero(alike[r])
                for k in found[np.unique(cy[found], return_index=True)[1]]:
                    out[0].append(min(ids[r], others[k]))
                    out[1].append(max(ids[r], others[k]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def compare_blocks(members: DataFrame, sets: DataFrame, percent: int, rows: int = 128) -> DataFrame:
    """Links (a, b) of each group's odd documents with all its documents of other components.

    members has (key, ruled, id, c, odd). Both sides fall into blocks of about ``rows`` documents;
    each pair of blocks is one task's work on their full sets, and only links leave it.
    """
    keys = ["key", "ruled"]
    sizes = members.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("n_all"), F.ceil(F.sum(F.col("odd").cast("int")) / rows).alias("n_odd"))
    ready = cut(members.join(sizes, keys).join(sets, "id"))
    at = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    fields = [*keys, "x", "y", "id", "c", "shingles"]
    left = ready.where("odd").withColumn("x", at("n_odd", 1)).withColumn("y", every("n_all")).select(*fields)
    right = ready.withColumn("y", at("n_all", 2)).withColumn("x", every("n_odd")).select(*fields)
    by = [*keys, "x", "y"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_block(percent), "a long, b long")


def _attach(rows: DataFrame, classes: DataFrame, value: str) -> DataFrame:
    """rows with the value of their class (n, h1, h2). A class with over 1 / 1,024 of the rows, so one of at most 1,023, is broadcast."""
    keys = ["n", "h1", "h2"]
    total = classes.agg(F.sum("k")).first()[0] or 0
    names = [F.col(c).alias(f"c_{c}") for c in keys]
    hot = classes.where(F.col("k") * 1024 > total).select(*names, F.col(value).alias("hot"), F.lit(True).alias("is_hot"))
    rare = classes.where(F.col("k") * 1024 <= total).select(*[F.col(c).alias(f"r_{c}") for c in keys], F.col(value).alias("rare"))
    same = lambda p: (F.col("n") == F.col(f"{p}_n")) & (F.col("h1") == F.col(f"{p}_h1")) & (F.col("h2") == F.col(f"{p}_h2"))
    found = rows.join(F.broadcast(hot), same("c"), "left").drop("c_n", "c_h1", "c_h2")
    # Rows that are done, or have no words, are dealt by themselves.
    away = F.when(F.col("is_hot") | (F.col("n") == 0), -F.abs(F.xxhash64("id", "row")) - 1).otherwise(F.col("n"))
    found = found.withColumn("to", away).join(rare, (F.col("to") == F.col("r_n")) & (F.col("h1") == F.col("r_h1")) & (F.col("h2") == F.col("r_h2")), "left")
    return found.select(*rows.columns, F.coalesce("hot", "rare").alias(value))


def _row_hash(id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


#: Bits of the filter below: at most 2**20 numbers of 64.
_FILTER_BITS = 1 << 26


def _likely_in(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows with maybe, true for every row whose column is in keys (of the same name) and, by chance, for few others.

    A bit for each key, 64 bits a row, is broadcast: at most 1,048,576 rows at any size. With more keys than bits it only filters less.
    """
    at = F.pmod(F.col(column), F.lit(_FILTER_BITS))
    bits = keys.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("_bits"))
    found = rows.withColumn("_at", at).join(F.broadcast(bits), F.shiftright("_at", 6) == F.col("_word"), "left")
    maybe = F.coalesce(F.expr("(_bits & shiftleft(1L, cast(_at & 63 as int))) <> 0"), F.lit(False))
    return found.select(*rows.columns, maybe.alias("maybe"))


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, trees: int, small: int, levels: int, children: int) -> tuple[DataFrame, DataFrame]:
    """(id, row, n, h1, h2) of every row, and (n, h1, h2, node, rep, k, group) of every set that isn't empty: its number, smallest
    id, rows, and the smallest number that links reach. Numbers rise with the smallest id, nulls last."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _row_hash(id_col, text_col).alias("row"))
    signed = cut(map_batches(base, _sign(width), "id long, row long, n long, h1 long, h2 long, sig binary"))
    equal = ["n", "h1", "h2"]
    named = signed.where("n > 0").groupBy(*equal).agg(F.min("id").alias("rep"), F.min("row").alias("row"), F.count("*").alias("k"), F.min("sig").alias("sig"))
    reps = cut(named.repartitionByRange(F.asc_nulls_last("rep")).sortWithinPartitions(F.asc_nulls_last("rep"), *equal).withColumn("id", F.monotonically_increasing_id()))
    spent: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        spent.append(cut(df))
        return spent[-1]

    def nodes(paths: DataFrame) -> DataFrame:
        """Members of nodes of two and more, with the node's size and its first member by hash."""
        sized = paths.groupBy("path").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id", "path"), "id")).alias("head")).where("size > 1")
        return paths.join(sized.select("path", "size", F.col("head.id").alias("head")), "path")

    def all_pairs(members: DataFrame) -> DataFrame:
        left, right = members.select("path", F.col("id").alias("a")), members.select("path", F.col("id").alias("b"))
        return left.join(right, "path").where("a < b").select("a", "b")

    def likely(pairs: DataFrame) -> DataFrame:
        """Distinct pairs that sizes and signatures allow."""
        x = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        y = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        both = pairs.distinct().join(x, "a").join(y, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        return map_batches(both.select("a", "b", "sa", "sb"), _alike((percent - 25) / 100), "a long, b long")

    first = kept(nodes(map_batches(reps.select("id", "sig"), _paths(trees, 2), "path long, id long")))
    heads = first.where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    found = kept(likely(heads.union(all_pairs(first.where(F.col("size") <= small)))))
    large = first.where(F.col("size") > small).select("path", "id")

    need = found.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id")).distinct()
    wanted = kept(reps.join(need, "id", "left_semi").select("row", "id", "h1", "h2"))
    # Only texts that are likely wanted are shuffled.
    texts_of = _likely_in(base.select("row", "text"), "row", wanted).where("maybe").join(wanted, "row").select("id", "text", "h1", "h2")
    sets = kept(map_batches(texts_of, _sets(width), "id long, shingles binary").dropDuplicates(["id"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        return map_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb"), _confirm(percent), "a long, b long")

    def across(pairs: DataFrame, merged: DataFrame) -> DataFrame:
        """Pairs that no link has merged yet."""
        x, y = merged.select(F.col("node").alias("a"), F.col("component").alias("ca")), merged.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        return pairs.join(x, "a", "left").join(y, "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b")

    links = kept(confirmed(found.select("a", "b")))
    merged = components(links)

    rest, blocks = [], []
    for level in range(1, levels + 1):
        if large.isEmpty():
            break
        of = large.join(merged, large.id == merged.node, "left").select("path", "id", F.coalesce("component", "id").alias("c"))
        parts = of.groupBy("path", "c").agg(F.count("*").alias("k"))
        mixed = parts.groupBy("path").agg(F.sum("k").alias("size"), F.max(F.struct("k", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        open_ = kept(of.join(mixed.select("path", "size", F.col("main.k").alias("k"), F.col("main.c").alias("main")), "path"))
        # Nodes that one component rules meet as one group, whichever tree they are of.
        ruled = F.lit(False) if level == levels else F.col("size") < 2 * F.col("k")
        blocks.append(open_.where(ruled).select(F.col("main").alias("key"), F.lit(True).alias("ruled"), "id", "c", (F.col("c") != F.col("main")).alias("odd")))
        if level == levels:
            blocks.append(open_.select(F.col("path").alias("key"), F.lit(False).alias("ruled"), "id", "c", F.lit(True).alias("odd")))
            break
        deeper = open_.where(~ruled).select("path", "id").join(reps.select("id", "sig"), "id").select("path", "id", "sig")
        below = kept(nodes(map_batches(deeper, _branch(children), "path long, id long")))
        rest.append(kept(likely(all_pairs(below.where(F.col("size") <= small)))))
        large = below.where(F.col("size") > small).select("path", "id")
    more = []
    if rest:
        more.append(kept(confirmed(across(reduce(DataFrame.union, rest).distinct(), merged))))
    if blocks:
        more.append(kept(compare_blocks(reduce(DataFrame.union, blocks).distinct(), sets, percent)))
    more = [x for x in more if not x.isEmpty()]
    if more:
        merged = components(reduce(DataFrame.union, [links, *more]))
    classes = reps.join(merged, reps.id == merged.node, "left").select(*equal, F.col("id").alias("node"), "rep", "k", F.coalesce("component", "id").alias("group"))
    classes = cut(classes)
    discard(*spent, reps)
    return signed.drop("sig"), classes


def _joined_by_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(group, whole): groups that hold sets of one id are one; only groups that others join."""
    several = signed.where("n > 0 and id is not null").groupBy("id").agg(F.min("h1").alias("a1"), F.max("h1").alias("b1"), F.min("h2").alias("a2"), F.max("h2").alias("b2")).where("a1 <> b1 or a2 <> b2")
    ids = cut(several.select("id"))
    if ids.isEmpty():
        return signed.sparkSession.range(0).select(F.col("id").alias("group"), F.col("id").alias("whole"))
    own = cut(_attach(signed.where("n > 0").join(ids, "id", "left_semi"), classes, "group").select("id", "group").distinct())
    heads = own.groupBy("id").agg(F.min("group").alias("head"))
    return components(own.join(heads, "id").select(F.col("group").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("group"), F.col("component").alias("whole"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    trees: int = 16,
    small: int = 8,
    levels: int = 3,
    children: int = 2,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased,
    ASCII white space between words); a shorter text is one shingle. Documents are
    linked when 100 * intersection >= percent * union, on the full sets.

    Equal sets fall together first, by aggregation, and one representative goes on.
    Every tree branches the representatives by two selected minwise tokens. In a
    node of up to ``small`` documents all pairs are candidates; a larger node first links
    its members to one of them, another one in each node. Links found so far merge documents,
    and a large node whose members are merged already is done. Others branch on, ``children``
    selected tokens at a time. Large nodes that one component rules (over half of the members)
    and those of the last level are compared in blocks on full sets, all documents outside
    the ruling component with all others: no node is cut short, and no pairs are listed. A pair at the threshold shares a root node with probability
    1 - (1 - 0.75**2)**trees, 0.999998 for 16 trees. Candidates whose signatures agree
    in less than percent - 25 of a hundred positions (over 4 standard deviations below)
    are left out; all others are compared on full sets.

    Null or empty text, and text of white space only: n_shingles 0, its own component.
    A null id gets the component of its equals (null if none has an id) and kept = false.
    Rows that repeat an id each get a row and are linked with each other, whatever their texts (if they have words).
    Other columns are ignored. Empty table: no rows.
    """
    signed, classes = _linked(docs, id_col, text_col, width, percent, trees, small, levels, children)
    joined = _joined_by_id(signed, classes)
    classes = classes.join(joined, "group", "left").withColumn("group", F.coalesce("whole", "group"))
    least = classes.groupBy("group").agg(F.min("rep").alias("component_id"))
    of_class = cut(classes.join(least, "group").select("n", "h1", "h2", "k", "component_id"))
    out = _attach(signed, of_class, "component_id")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id, nulls last, then of the smallest hash of id and text.

    Groups are of texts, whatever their ids, with options as of near_duplicates. Texts without words are in no group and stay.
    Of rows that repeat id and text one stays, the smallest by its other columns. An empty table gives no rows.
    """
    o = {"width": 5, "percent": 75, "trees": 16, "small": 8, "levels": 3, "children": 2} | options
    signed, classes = _linked(docs, id_col, text_col, **o)
    grouped = cut(_attach(signed.where("n > 0"), classes, "group").groupBy("group", F.col("id").isNull().alias("none"), "id", "row").agg(F.count("*").alias("rows")))
    best = grouped.groupBy("group").agg(F.min(F.struct("none", "id", "row")).alias("b"), F.sum("rows").alias("all")).where("all > 1")
    head = best.select("group", F.col("b.id").alias("first_id"), F.col("b.row").alias("first"))
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("row") == F.col("first"))
    shared = cut(grouped.join(head, "group").select("id", "row", stays.alias("stays"), "rows"))
    # Rows alone in their group go straight through; the others meet their decision, by id and hash.
    rows = _likely_in(docs.withColumn("_row", _row_hash(id_col, text_col)), "_row", shared.select(F.col("row").alias("_row")))
    alone = rows.where("not maybe").select(*docs.columns)
    decided = shared.select(F.col("id").alias("_of"), F.col("row").alias("_shared"), F.col("stays").alias("_stays"), F.col("rows").alias("_rows"))
    met = rows.where("maybe").withColumn("_id", F.col(id_col).cast("long"))
    met = met.join(decided, (F.col("_row") == F.col("_shared")) & F.col("_id").eqNullSafe(F.col("_of")), "left")
    single = met.where("_shared is null or (_stays and _rows = 1)").select(*docs.columns)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    first = met.where("_stays and _rows > 1").groupBy("_id", "_row").agg(F.min(F.struct(id_col, text_col, *others)).alias("x")).select("x.*")
    return alone.union(single).union(first.select(*docs.columns))
