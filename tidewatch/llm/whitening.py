"""Whitening of embeddings: exact integer scatter from bit planes, then one eigendecomposition for each length of vector."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import map_batches

_U = np.uint64
_LIMB = 32
#: A task sends its sums on after so many rows, so that they stay below 2 ** 63.
_FLUSH = 1 << 24
#: Numbers of a block of rows.
_BLOCK = 1 << 21
#: Squared lengths of vectors (numbers of their scatter) that one pass takes together.
_PASS = 1 << 25


def scaled(column: pa.Array, dims: np.ndarray, scale: int, shift: int):
    """(dim, row numbers, floor(scale * c) + shift as int64) for each length of the vectors of a batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        part = column if len(rows) == len(dims) else column.take(pa.array(rows))
        x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
        yield int(dim), rows, np.floor(scale * x).astype(np.int64) + shift


class Scatter:
    """Sums of products of non-negative integer columns, from bit planes packed across rows.

    Bit p of each column's rows fills one word for 64 rows. The product sum of two columns is the sum over their planes
    p and q of 2 ** (p + q) times the set bits that the planes share; sums are kept in limbs of 32 binary places.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.column = np.repeat(np.arange(len(bits)), bits)
        self.plane = np.arange(len(self.column)) - np.repeat(np.cumsum(bits) - bits, bits)
        limbs = 2 * int(bits.max(initial=1)) // _LIMB + 1
        self.sums = np.zeros((limbs, len(bits), len(bits)), np.int64)
        self.rows = 0

    def add(self, x: np.ndarray) -> None:
        """Rows of x, uint64, below 2 ** bits of its column each."""
        self.rows += len(x)
        x = np.concatenate([x, np.zeros((-len(x) % 64, x.shape[1]), _U)])
        words = np.empty((len(self.column), len(x) // 64), _U)
        for p in range(int(self.bits.max(initial=0))):
            has = np.flatnonzero(self.bits > p)
            packed = np.packbits(((x[:, has] >> _U(p)) & _U(1)).astype(np.uint8), axis=0)
            words[np.flatnonzero(self.plane == p)] = np.ascontiguousarray(packed.T).view(_U)
        begins = np.cumsum(self.bits) - self.bits
        for i, (d, p) in enumerate(zip(self.column.tolist(), self.plane.tolist())):
            j = int(begins[d])  # columns from d on, with all their planes
            shared = np.bitwise_count(words[i] & words[j:]).sum(axis=1, dtype=np.int64)
            power = p + self.plane[j:]
            np.add.at(self.sums, (power // _LIMB, d, self.column[j:]), shared << (power % _LIMB))

    def taken(self) -> list[tuple[int, int, int, int]]:
        """(limb, i, j, sum) of what was added, which starts anew."""
        limb, i, j = np.nonzero(self.sums)
        out = list(zip(limb.tolist(), i.tolist(), j.tolist(), self.sums[limb, i, j].tolist()))
        self.sums[:] = 0
        self.rows = 0
        return out


def _bounds(scale: int, shift: int):
    """(dim, i, n, low, high, sum in two parts): of each component of each length, over the rows of a task."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for dim, rows, x in scaled(batch.column(1), batch.column(0).to_numpy(), scale, shift):
                low, high = x.min(axis=0), x.max(axis=0)
                upper, lower = (x >> _LIMB).sum(axis=0), (x & ((1 << _LIMB) - 1)).sum(axis=0)
                if dim not in found:
                    found[dim] = [len(rows), low, high, upper, lower]
                else:
                    n, a, b, u, v = found[dim]
                    found[dim] = [n + len(rows), np.minimum(a, low), np.maximum(b, high), u + upper, v + lower]
        for dim, (n, *columns) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(np.full(dim, n)), *map(pa.array, columns)], ["dim", "i", "n", "low", "high", "upper", "lower"])

    return run


def _products(known: dict, scale: int, shift: int):
    """(dim, limb, i, j, part): a task's scatter of each length, as far as it isn't 0."""

    def run(batches):
        made: dict[int, Scatter] = {}

        def sent(dim: int):
            rows = made[dim].taken()
            columns = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array([dim] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64())))], ["dim", "limb", "i", "j", "part"])

        for batch in batches:
            for dim, _, x in scaled(batch.column(1), batch.column(0).to_numpy(), scale, shift):
                low, bits = known[dim]
                if dim not in made:
                    made[dim] = Scatter(bits)
                step = max(64, _BLOCK // dim // 64 * 64)
                for s in range(0, len(x), step):
                    made[dim].add((x[s : s + step] - low).astype(_U))
                if made[dim].rows > _FLUSH:
                    yield sent(dim)
        for dim in made:
            yield sent(dim)

    return run


class Whitening:
    """What is known of the vectors of one length: n, the lows and sums of their integers, exact covariance, components."""

    def __init__(self, n: int, low: list[int], high: list[int], sums: list[int], products: np.ndarray, k: int):
        d = len(low)
        self.n, self.low = n, np.array(low, np.int64)
        self.shifted = [s - n * a for s, a in zip(sums, low)]
        s = np.array(self.shifted, object)
        centred = n * products - np.outer(s, s)
        self.covariance = np.array([[int(a) / (n * n) for a in row] for row in centred.tolist()]).reshape(d, d)
        trace = sum(int(centred[i, i]) for i in range(d)) / (n * n)
        value, vector = np.linalg.eigh(self.covariance)
        order = np.argsort(-value, kind="stable")[:k]
        self.value, self.vector = value[order], vector[:, order]
        self.varies = self.value > 1e-12 * max(trace, 1e-300)
        self.explained = self.value / trace if trace else np.full(len(order), np.nan)
        self.mean = np.array([int(a) / n for a in self.shifted])
        self.most = n * max((b - a for a, b in zip(low, high)), default=0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components); NaN for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = ((x - self.low) - self.mean) @ self.vector / np.sqrt(np.where(self.varies, self.value, np.nan))
        return out

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sums of (n * x - S) ** 2, exact; null from 10 ** 38 on."""
        if self.most**2 * x.shape[1] < 1 << 63:
            y = self.n * (x - self.low) - np.array(self.shifted, np.int64)
            return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
        y = self.n * (x - self.low).astype(object) - np.array(self.shifted, object)
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in (y * y).sum(axis=1)], pa.decimal128(38, 0))


def _moments(models: dict, scale: int, shift: int):
    """(dim, i, j, part): sums of whitened values (j is -1) and of their products, over the rows of a task."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in scaled(batch.column(1), batch.column(0).to_numpy(), scale, shift):
                w = models[dim].whitened(x)[:, models[dim].varies]
                found[dim] = found.get(dim, 0.0) + np.column_stack([w.sum(axis=0), w.T @ w])
        for dim, m in found.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim)), pa.array(i.ravel()), pa.array(j.ravel() - 1), pa.array(m.ravel())], ["dim", "i", "j", "part"])

    return run


def _apply(models: dict, errors: dict, scale: int, shift: int):
    def run(batches):
        for batch in batches:
            for dim, rows, x in scaled(batch.column(1), batch.column(0).to_numpy(), scale, shift):
                m = models[dim]
                k, n = len(m.value), len(rows)
                if not k:
                    continue
                w = m.whitened(x)
                each = pa.array(np.repeat(np.arange(n), k))
                explained = np.tile(m.explained, n)
                columns = [
                    *(c.take(pa.array(rows)).take(each) for c in batch.columns[2:]),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, m.n)),
                    m.deviation(x).take(each),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(explained, from_pandas=True),
                    pa.array(np.full(n * k, errors[dim])),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[2:], "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000, keep: list[str] | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, and the columns ``keep``): each vector on the first
    components of all vectors, each divided by its deviation.

    Entries c become integers x = floor(scale * c) + shift; n counts the vectors, S are the sums of x. Each
    dimension's x less its smallest value is packed in bit planes across rows; AND-popcounts of planes, weighted by powers of two, give
    the products' sums without rounding, and they are centred as integers, n * P - S S^T, before the one division and
    eigh. deviation is the sum over dimensions of (n * x - S) ** 2, exact (decimal(38, 0); null from 10 ** 38 on).
    Components are numbered from 1 by falling eigenvalue e; explained is e over the trace. identity_error is measured on the
    whitened values: the largest absolute entry of their covariance minus the identity, over components with variance (0 if there is none).

    Vectors that are null, or hold null or non-finite entries, or one whose x doesn't fit in 62 bits, take no part. Vectors of each length are
    whitened by themselves; those without entries give no rows. A component without variance (all vectors equal, or fewer than components)
    has whitened null. Null and repeated ids stay as they are, and each row counts. Other columns are ignored;
    ``keep`` may not name the columns above. An empty table gives no rows.

    The driver and each task hold a matrix of length x length for each length of vector, whatever the number of rows; lengths whose
    matrices are more than 2 ** 25 numbers together take further passes.
    """
    spark = vectors.sparkSession
    top = float(1 << 62)
    odd = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(F.floor(F.lit(float(scale)) * c.cast("double")) + float(shift)) >= top) | (F.abs(c.cast("double")) >= top))
    names = {c: f"k_{c}" for c in [id_col, *(keep or [])]}
    good = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~odd)
    rows = good.select(F.size(vector_col).alias("dim"), F.col(vector_col).alias("v"), *[F.col(c).alias(k) for c, k in names.items()])
    only = rows.select("dim", "v")

    parts = map_batches(only, _bounds(scale, shift), "dim long, i long, n long, low long, high long, upper long, lower long")
    bounds = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("upper").alias("upper"), F.sum("lower").alias("lower"))
    known: dict[int, list] = {}
    for dim, _i, *rest in bounds.orderBy("dim", "i").collect():  # a row for each component
        known.setdefault(dim, []).append(rest)

    passes: list[list[int]] = []
    room = 0
    for dim in sorted(known):
        if not passes or room < dim * dim:
            passes.append([])
            room = _PASS
        passes[-1].append(dim)
        room -= dim * dim

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in names.values()) + ", component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double"
    order = [F.col(names[id_col]).alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error", *[F.col(names[c]).alias(c) for c in keep or []]]
    out = spark.createDataFrame([], schema).select(*order) if not passes else None
    for dims in passes:
        some = lambda df: df.where(F.col("dim").isin(dims)) if len(passes) > 1 else df  # noqa: B023, E731
        shifts = {d: (np.array([x[1] for x in known[d]], np.int64), np.array([(x[2] - x[1]).bit_length() for x in known[d]])) for d in dims}
        products = map_batches(some(only), _products(shifts, scale, shift), "dim int, limb int, i int, j int, part long")
        upper, lower = F.sum(F.shiftright("part", 31)), F.sum(F.col("part").bitwiseAND((1 << 31) - 1))
        sums = {d: np.zeros((d, d), object) for d in dims}
        for d, limb, i, j, a, b in products.groupBy("dim", "limb", "i", "j").agg(upper, lower).collect():  # a row or a few for each pair of dimensions
            sums[d][i, j] += ((a << 31) + b) << (_LIMB * limb)
        models = {}
        for d in dims:
            whole = np.triu(sums[d]) + np.triu(sums[d], 1).T
            n, lows, highs = known[d][0][0], [x[1] for x in known[d]], [x[2] for x in known[d]]
            models[d] = Whitening(n, lows, highs, [(x[3] << _LIMB) + x[4] for x in known[d]], whole, components)
        errors = dict.fromkeys(dims, 0.0)
        measured: dict[int, dict] = {}
        for d, i, j, x in map_batches(some(only), _moments(models, scale, shift), "dim long, i long, j long, part double").groupBy("dim", "i", "j").agg(F.sum("part")).collect():  # components squared
            measured.setdefault(d, {})[i, j] = x / models[d].n
        for d, m in measured.items():
            errors[d] = max((abs(x - m[i, -1] * m[j, -1] - (i == j)) for (i, j), x in m.items() if j >= 0), default=0.0)
        made = map_batches(some(rows), _apply(models, errors, scale, shift), schema).select(*order)
        out = made if out is None else out.union(made)
    return out
