"""Row-local score, trust, vector and decision expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trust_score(score: Column, flag: Column, mu: float, scale: float, slope: float = 1.0) -> Column:
    """Sigmoid of the standardised score, its argument clipped to 30; inverted where not flagged."""
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * (score - mu) / scale))
    p = 1 / (1 + F.exp(-z))
    return F.when(flag == 1, p).otherwise(1 - p)


def physical_score(adi: Column, threshold: float) -> Column:
    r = adi / threshold
    return r / (1 + r)


def class_from_probs(probs: Column, classes: list[str], benign: str = "BENIGN") -> Column:
    """struct<label, attack_prob, alarm>: first largest probability, 1 - p(benign), and label is not benign."""
    names = F.array(*[F.lit(c) for c in classes])
    label = F.element_at(names, F.array_position(probs, F.array_max(probs)).cast("int"))
    attack = 1 - F.element_at(probs, classes.index(benign) + 1)
    return F.struct(label.alias("label"), attack.alias("attack_prob"), (label != benign).cast("int").alias("alarm"))


def response_bin(r: Column, n: int = 3) -> Column:
    """[-1, 1] in n equal bins, values outside in the end ones."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((r + 1) / 2 * n))).cast("int")


def decision_reward(cls: Column, resp: Column, y: Column, flag: Column, focus: Column) -> Column:
    """Reward of a logged decision: class right or wrong, a specialist's hit, the response
    against what happened, and agreement with the detector's flag."""
    right = F.when(cls == y, 1.0).otherwise(-1.0)
    hit = F.when((cls == y) & (cls == focus), 0.5).otherwise(0.0)
    # Rewards of monitor, limit, block.
    attack, benign = F.array(*map(F.lit, (0.5, 0.75, 1.0))), F.array(*map(F.lit, (0.5, -0.25, -1.0)))
    at = F.greatest(F.lit(0), F.least(F.lit(2), resp)).cast("int") + 1
    response = F.when(y == 0, F.element_at(benign, at)).otherwise(F.element_at(attack, at))
    agree = F.when((cls != 0).cast("int") == flag, 0.2).otherwise(-0.2)
    return F.struct((right + hit).alias("class_reward"), (response + agree).alias("response_reward"))


def pack_signal(score: Column, flag: Column, trust: Column, embedding: Column, k: int) -> Column:
    """[score, flag, trust] and the embedding, padded with zeros or cut to k."""
    padded = F.slice(F.concat(embedding, F.array_repeat(F.lit(0.0), k)), 1, k)
    return F.concat(F.array(score.cast("double"), flag.cast("double"), trust.cast("double")), padded)


def topk_abs_embedding(vector: Column, k: int = 4) -> Column:
    """The k entries largest in absolute value, signs kept, ties by place, padded with zeros."""
    placed = F.transform(vector, lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i"), x.alias("x")))
    best = F.transform(F.slice(F.array_sort(placed), 1, k), lambda s: s["x"])
    return F.slice(F.concat(best, F.array_repeat(F.lit(0.0), k)), 1, k)


def reshape_sequence(features: Column, n: int) -> Column:
    """(T, F) array of arrays with T * F = n, T the largest divisor from min(n, 16) to 4, else (n, 1)."""
    t = next((t for t in range(min(n, 16), 3, -1) if n % t == 0), n)
    width = n // t
    return F.transform(F.sequence(F.lit(0), F.lit(t - 1)), lambda i: F.slice(features, i * width + 1, width))


def inject_bias(z: Column, places: list[int], bias: float, when: Column) -> Column:
    """A constant added at some positions (from 0) where ``when`` holds."""
    at = F.array(*[F.lit(p) for p in places])
    return F.when(when, F.transform(z, lambda x, i: F.when(F.array_contains(at, i), x + bias).otherwise(x))).otherwise(z)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm(a) * norm(b))
