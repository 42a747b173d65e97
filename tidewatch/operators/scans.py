"""Linear recursions by key as associative scans: one key's rows spread over as many tasks as all rows do."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import grouped_sums, stored

#: (a, c, more) for the rows of a batch and their places in their keys (0 first): the state moves to a * state + c; more are columns to carry along.
Steps = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]
#: (maps, more): as Steps, with one row of numbers for each map.
Maps = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]]
#: The maps that a first and a second map come to, row by row; it must be associative.
Then = Callable[[np.ndarray, np.ndarray], np.ndarray]


def composed(maps: np.ndarray, group: np.ndarray, then: Then) -> np.ndarray:
    """For each row the one map that its group's maps up to it come to, rows of a group one after the other.

    By doubling: after each turn a row's map covers twice as many rows, in as many turns as the longest group has binary places.
    """
    maps = maps.copy()
    step, longest = 1, int(np.bincount(group).max(initial=0))
    while step < longest:
        on = np.flatnonzero(group[step:] == group[:-step]) + step
        maps[on] = then(maps[on - step], maps[on])
        step *= 2
    return maps


def affine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """x -> a * x + c, as a then c, component by component."""
    w = first.shape[1] // 2
    return np.concatenate([second[:, :w] * first[:, :w], second[:, w:] + second[:, :w] * first[:, w:]], axis=1)


def _composed(key: str, cols: list[str], maps: Maps, then: Then, none: np.ndarray, more: list[str]):
    """Rows with their number in the partition and the map from their key's first row here to before them; a batch's last row has the map to after it."""

    def run(batches):
        seq, last, carried = 0, None, None
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            k = pdf[key]
            new = ((k != k.shift()) & ~(k.isna() & k.shift().isna())).to_numpy()
            new[0] = carried is None or not (k.iloc[0] == last or (pd.isna(k.iloc[0]) and pd.isna(last)))
            group = np.cumsum(new) - int(new[0])
            own, found = maps(pdf[cols].to_numpy(float), pdf["_place"].to_numpy())
            own = composed(own, group, then)
            if not new[0]:  # the batch goes on with the last key
                on = group == 0
                own[on] = then(np.tile(carried, (int(on.sum()), 1)), own[on])
            before = np.tile(none, (n, 1))
            before[1:] = own[:-1]
            before[new] = none
            if not new[0]:
                before[0] = carried
            carried, last = own[-1], k.iloc[-1]
            added = {"_seq": np.arange(seq, seq + n), "_before": list(before), "_to": [None] * (n - 1) + [carried]}
            seq += n
            yield pdf.assign(**added, **{name: list(found[name]) for name in more})

    return run


def scan(df: DataFrame, key: str, order: list[str], cols: list[str], maps: Maps, then: Then, none: list[float], more: tuple[str, ...] = (), placed: bool = False) -> DataFrame:
    """(key, order, cols, _place, the arrays ``more``, _before, _start): each row's two maps, from its key's first row to its range, and on to before it.

    A row moves its key's state by a map, given as numbers; ``none`` is the map that changes nothing. Maps compose associatively:
    rows are dealt by ranges of (key, order), each task composes its own, and only the key that goes on from one
    range to the next passes a map on, as _start (null: ``none``; the driver holds one map for each range). So a key with any share of the rows is the work of many
    tasks. With ``placed`` each row's place in its key is counted first, for maps that depend on it; otherwise places are 0.
    """
    rows = df.select(key, *order, *[F.col(c).cast("double").alias(c) for c in cols if c not in (key, *order)])
    if placed:
        ones = rows.withColumn("_one", F.lit(1).cast("long"))
        rows = grouped_sums(ones, [key], order, ["_one"]).withColumn("_place", F.col("cum__one") - 1).select(*rows.columns, "_place")
        along = [key, "_place"]
    else:
        rows, along = rows.withColumn("_place", F.lit(0).cast("long")), [key, *order]
    dealt = rows.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_part", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    arrays = ", ".join(f"`{c}` array<double>" for c in ("_before", "_to", *more))
    local = stored(dealt.mapInPandas(_composed(key, cols, maps, then, np.array(none, float), list(more)), f"{kinds}, _seq long, {arrays}"))

    ends = local.groupBy("_part").agg(F.min(F.struct("_seq", key)).alias("first"), F.max(F.struct("_seq", key, "_to")).alias("last"))
    held, begins = None, []
    same = lambda x, y: x == y or (x is None and y is None)
    for part, first, last in sorted(ends.collect()):  # one row for each range
        goes_on = held is not None and same(first[1], held[0])
        if goes_on:
            begins.append((part, first[1], held[1].tolist()))
        to = np.array(last[2], float)
        if goes_on and same(first[1], last[1]):  # the range is all that key's
            to = then(held[1][None], to[None])[0]
        held = (last[1], to)
    key_type = dict(df.dtypes)[key]
    carried = df.sparkSession.createDataFrame(begins, f"_p int, _k {key_type}, _start array<double>")
    met = local.join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return met.select(*dict.fromkeys([key, *order, *cols]), "_place", *more, "_before", "_start")


def affine_scan(df: DataFrame, key: str, order: list[str], cols: list[str], start: list[float], steps: Steps, more: tuple[str, ...] = (), placed: bool = False) -> DataFrame:
    """(key, order, cols, _place if placed, before, and the arrays ``more``): the state of each key before each of its rows, in order.

    A key's state (one number for each of cols) begins at ``start``, and each row moves it to a * state + c: a scan of affine maps.
    """
    w = len(cols)

    def maps(z: np.ndarray, place: np.ndarray) -> tuple:
        a, c, found = steps(z, place)
        return np.concatenate([a, c], axis=1), found

    found = scan(df, key, order, cols, maps, affine, [1.0] * w + [0.0] * w, more, placed)
    moved = lambda m, x: F.transform(F.arrays_zip(F.slice(m, 1, w).alias("a"), F.slice(m, w + 1, w).alias("c"), x.alias("x")), lambda t: t["a"] * t["x"] + t["c"])
    begin = F.array(*[F.lit(float(x)) for x in start])
    at_range = F.when(F.col("_start").isNull(), begin).otherwise(moved(F.col("_start"), begin))
    return found.select(*dict.fromkeys([key, *order, *cols]), *(["_place"] if placed else []), moved(F.col("_before"), at_range).alias("before"), *more)


def spread_after(place: np.ndarray, p0: float, r: np.ndarray, q: float, growth: float) -> np.ndarray:
    """(rows, features): a filter's variance after so many rows, p -> (growth * p + q) r / (growth * p + q + r) each, from p0, by its closed form."""
    k = place[:, None].astype(float)
    if q == 0 and growth == 1:
        return p0 * r / (r + k * p0)
    # Fixed points of the map, the one it goes to and the other; distances to them shrink by a ratio.
    half = (growth * r - q - r) / (2 * growth)
    root = np.sqrt(half**2 + r * q / growth)
    near, other = half + root, half - root
    ratio = (growth * other + q + r) / (growth * near + q + r)
    slower = np.abs(ratio) > 1
    near, other, ratio = np.where(slower, other, near), np.where(slower, near, other), np.where(slower, 1 / ratio, ratio)
    gap = (near - other) / (p0 - other)
    w = ratio**k * (1 - gap)
    return near + (near - other) * w / (ratio**k * gap - np.expm1(k * np.log(ratio)))
