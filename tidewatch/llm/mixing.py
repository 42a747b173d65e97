"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import cut

_WORDS = r"[^\\x20\\x09-\\x0D]+"

#: The block table is broadcast up to so many rows of about 100 bytes.
_BROADCAST_ROWS = 100_000
#: Rows of a block where a table is so large that 1,024 blocks would hold more.
BLOCK_ROWS = 65_536


def water_fill(sizes: list[int], weights: list[int], most: int) -> list[float]:
    """Targets that share sum(sizes) by weight; none is above most times its size, and
    the excess goes to the others by weight until none is above."""
    open_ = {i for i, s in enumerate(sizes) if s > 0}
    targets = [0.0] * len(sizes)
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ -= over
    return targets


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts: each tree node halves its shards and draws the left
    half's blocks without replacement from the node's counts, so columns sum to quotas exactly."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        n = int(counts.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(counts, n, method="marginals") if counts.sum() else counts
        node(lo, mid, left)
        node(mid, hi, counts - left)

    node(0, shards, quotas.astype(np.int64))
    return out


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    blocks: int | None = None,
    shards: int = 16,
    seed: int = 17,
    keep: list[str] | None = None,
) -> DataFrame:
    """(id, size, source_size, target, taken, draws, and the columns ``keep``) for every row.

    size counts the runs of non-space in the text (null: 0). Sources, sorted by code point
    with null last, weigh ``weights`` in turn and share all sizes; a target stops at ``most`` times
    its source's size and the excess is shared again. draws array<struct<pass, shard>>
    says in which output shards a row's copies go; taken = size * number of draws.

    Rows fall into ``blocks`` blocks of their source by hash (None: 1,024, and one more for every BLOCK_ROWS rows
    beyond 1,024 times as many, so a block stays small at any size). A source draws all its blocks
    as often as its target holds it whole; then permuted blocks up to the rest, and of the block
    on the border permuted rows, so taken misses the target by at most half a row.
    The splitting tree deals each source's block draws to the shards; a shard takes the next ones of
    the source's permuted draws, so draws are disjoint and no row has more than ``most``.

    The driver holds one row for each source and shard (a mixture names its sources); windows
    run over at most ``blocks`` rows of a source or one block's rows. Rows without words have
    size 0 and go with their block. Equal seeds give equal results for any partitioning; rows equal
    in id and text share a block and, on a border, an order. Null ids and sources are values like others. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.expr(f"regexp_count(x, '{_WORDS}')").cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("x"), *[F.col(c).alias(f"k_{c}") for c in keep or []])
    rows = rows.withColumn("size", size).withColumn("h", F.xxhash64("id", "x", F.lit(seed)))
    rows = cut(rows.drop("x"))
    blocks = blocks or max(1024, rows.count() // BLOCK_ROWS)
    rows = rows.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int")).withColumn("h", F.xxhash64("h", F.lit(seed + 1)))

    per_block = cut(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    totals = {r.source: (int(r.words), int(r.n)) for r in per_block.groupBy("source").agg(F.sum("words").alias("words"), F.count("*").alias("n")).toLocalIterator()}
    names = sorted((s for s in totals if s is not None)) + [s for s in totals if s is None]
    sizes = [totals[s][0] for s in names]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    whole = [int(t // s) if s else 0 for t, s in zip(targets, sizes)]
    spare = [t - w * s for t, w, s in zip(targets, whole, sizes)]
    plan = spark.createDataFrame([(n, s, float(t), w, float(r)) for n, s, t, w, r in zip(names, sizes, targets, whole, spare)], "source string, source_size long, target double, whole int, spare double")

    by_source = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed)), "block")
    sized = per_block.alias("p").join(plan.alias("q"), F.expr("p.source <=> q.source")).select("p.*", "q.whole", "q.spare", "q.source_size", "q.target")
    sized = sized.withColumn("before", F.sum("words").over(by_source.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    # A block of the last, partial pass goes whole, or up to the words that are still missing.
    sized = cut(sized.withColumn("missing", F.when(F.col("before") < F.col("spare"), F.col("spare") - F.col("before"))).withColumn("border", F.col("missing") < F.col("words")))

    drawn = sized.withColumn("n", F.col("whole") + F.col("missing").isNotNull().cast("int")).where("n > 0")
    quota = {r.source: int(r.n) for r in drawn.groupBy("source").agg(F.sum("n").alias("n")).toLocalIterator()}
    ends = np.cumsum(split_quotas(np.array([quota.get(n, 0) for n in names], np.int64), shards, seed), axis=0).T.tolist()
    dealt = spark.createDataFrame(list(zip(names, ends)), "source string, ends array<long>")
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", "pass", F.lit(seed + 2)), "block", "pass")
    draws = drawn.select("source", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pass")).withColumn("at", F.row_number().over(order) - 1)
    draws = draws.alias("p").join(dealt.alias("q"), F.expr("p.source <=> q.source")).select("p.*", F.expr("size(filter(ends, e -> e <= at))").alias("shard"))
    draws = draws.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    table = sized.alias("p").join(draws.alias("q"), F.expr("p.source <=> q.source and p.block = q.block"), "left").select("p.source", "p.block", "p.source_size", "p.target", "p.whole", "p.missing", "p.border", "q.draws")

    if len(names) * blocks <= _BROADCAST_ROWS:  # as many rows at most, whatever the corpus; else Spark deals both sides
        table = F.broadcast(cut(table))
    out = rows.alias("p").join(table.alias("q"), F.expr("p.source <=> q.source and p.block = q.block")).select("p.*", "q.source_size", "q.target", "q.whole", "q.missing", "q.border", "q.draws")
    in_block = Window.partitionBy("source", "block").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = out.where("border").withColumn("upto", F.sum("size").over(in_block)).withColumn("last", F.col("upto") - F.col("size") / 2 <= F.col("missing")).drop("upto")
    rest = out.where("border is null or not border").withColumn("last", F.lit(True))
    out = rest.unionByName(edge)
    all_draws = F.coalesce("draws", F.expr("cast(array() as array<struct<pass: int, shard: int>>)"))
    out = out.withColumn("draws", F.when(F.col("last"), all_draws).otherwise(F.filter(all_draws, lambda d: d["pass"] < F.col("whole"))))
    taken = (F.col("size") * F.size("draws")).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "draws", *[F.col(f"k_{c}").alias(c) for c in keep or []])


def write_order(planned: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: a row for each draw with its shard, rows of a shard together and shuffled within it.

    A shard is spread over as many tasks as shuffle partitions allow, by a hash of the row, so
    it is never one task's work; ``shard`` and ``place`` give the reading order.
    """
    spark = planned.sparkSession
    each = planned.withColumn("draw", F.explode("draws")).drop("draws")
    each = each.withColumn("shard", F.col("draw.shard")).withColumn("pass", F.col("draw.pass")).drop("draw")
    each = each.withColumn("place", F.xxhash64(F.col(id_col), "pass", "shard", F.lit(seed)))
    n = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return each.repartitionByRange(n, "shard", "place").sortWithinPartitions("shard", "place")
