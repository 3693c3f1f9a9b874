"""Multi-bit and binary quantization of vectors.

Multi-bit: each vector is tried at a grid of scales; a coordinate's level is
clamp(round(v * scale * (L - 1)), 0, L - 1), its reconstruction level / (L - 1) / scale,
and the scale of least squared error is kept, the first of equals.  Negative
coordinates therefore reconstruct to 0.  All of it is FLOAT arithmetic in built-in
expressions.  Binary: a bit for each dimension, set where the value reaches the
dimension's threshold, its median over the training rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import col, cosine, inner_product, l2


@dataclass(frozen=True)
class Params:
    """Bits for a coordinate and the grid of scales."""

    bits: int = 4
    scales: int = 12
    low: float = 0.5
    high: float = 2.0

    def __post_init__(self) -> None:
        if self.bits not in (2, 3, 4, 5, 7, 8):
            raise ValueError(f"unsupported number of bits: {self.bits}")

    @property
    def levels(self) -> int:
        return 2**self.bits

    @property
    def compression(self) -> float:
        return 32 / self.bits

    @property
    def values_per_byte(self) -> int:
        return 8 // self.bits

    def grid(self) -> list[float]:
        return scale_grid(self.low, self.high, self.scales)

    @classmethod
    def preset(cls, bits: int) -> Params:
        return cls(8, 16, 0.7, 1.5) if bits == 8 else cls(bits)


def scale_grid(low: float, high: float, n: int) -> list[float]:
    """n evenly spaced scales; one is the middle."""
    return [(low + high) / 2] if n == 1 else [low + (high - low) * i / (n - 1) for i in range(n)]


def levels(v: Column | str, scale: Column | float, n_levels: int) -> Column:
    """Integer levels at one scale."""
    scale = F.lit(float(scale)).cast("float") if isinstance(scale, (int, float)) else scale
    top = F.lit(float(n_levels - 1)).cast("float")
    return F.transform(col(v), lambda x: F.least(F.greatest(F.round(x * scale * top), F.lit(0.0).cast("float")), top).cast("int"))


def reconstruct(q: Column | str, scale: Column | float, n_levels: int) -> Column:
    scale = F.lit(float(scale)).cast("float") if isinstance(scale, (int, float)) else scale
    top = F.lit(float(n_levels - 1)).cast("float")
    # Spark divides floats as doubles; each quotient rounded to a float is the quotient of FLOAT arithmetic.
    return F.transform(col(q), lambda x: ((x.cast("float") / top).cast("float") / scale).cast("float"))


def squared_error(v: Column | str, q: Column | str, scale: Column | float, n_levels: int) -> Column:
    pairs = F.zip_with(col(v), reconstruct(q, scale, n_levels), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def quantize(v: Column | str, params: Params = Params()) -> Column:
    """struct(levels, scale, bits, dimensions) at the scale of least error."""
    v = col(v)
    tried = [
        F.struct(squared_error(v, levels(v, s, params.levels), s, params.levels).alias("error"), F.lit(i).alias("at"), F.lit(float(s)).cast("float").alias("scale"))
        for i, s in enumerate(params.grid())
    ]
    best = F.least(*tried) if len(tried) > 1 else tried[0]
    # One element through a lambda, so that the search runs once and not for each coordinate.
    found = F.transform(
        F.array(best["scale"]),
        lambda s: F.struct(levels(v, s, params.levels).alias("levels"), s.alias("scale"), F.lit(params.bits).cast("tinyint").alias("bits"), F.size(v).alias("dimensions")),
    )
    return F.when(v.isNotNull(), found[0])


def reconstructed(q: Column | str, params: Params) -> Column:
    return F.transform(F.array(col(q)), lambda x: reconstruct(x["levels"], x["scale"], params.levels))[0]


def quantized_distance(metric: str, a: Column | str, b: Column | str, params: Params) -> Column:
    """l2, cosine or negative inner product of the reconstructions."""
    x, y = reconstructed(a, params), reconstructed(b, params)
    return {"l2": l2, "cosine": cosine, "ip": lambda p, q: -inner_product(p, q)}[metric](x, y)


def level_distance(a: Column | str, b: Column | str) -> Column:
    """L2 over the levels, without their scales."""
    return l2(col(a)["levels"], col(b)["levels"])


def packed_bytes(dims: Column | int, bits: int) -> Column:
    """Bytes of the packed levels: only 2 and 4 bits share bytes."""
    dims = F.lit(dims) if isinstance(dims, int) else dims
    return F.ceil(dims / (8 // bits)).cast("int") if bits in (2, 4) else dims.cast("int")


def compression_ratio(dims: Column | int, bits: int) -> Column:
    """Bytes of the floats over packed bytes, scale and width."""
    n = F.lit(dims) if isinstance(dims, int) else dims
    return n * 4 / (packed_bytes(n, bits) + 5)


#: Values of a dimension fall into so many ranges of equal width.
RANGES = 1024


def thresholds(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(pos, threshold): the exact median of each dimension; vectors must agree in length.

    A histogram tells in which ranges the middle values of a dimension lie; only values of
    those are ranked, so no task holds all values of a dimension.
    """
    values = df.where(F.col(column).isNotNull()).select(F.posexplode_outer(column).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    fine = F.when(F.abs("v") < float("inf"), F.col("v"))
    edges = values.groupBy("pos").agg(F.min(fine).alias("lo"), F.max(fine).alias("hi"), F.count("*").alias("rows"), F.count("v").alias("n")).orderBy("pos").collect()  # a row a dimension
    if not edges:
        raise ValueError("no vectors to train thresholds on")
    if len({e.rows for e in edges}) > 1 or (edges[0].pos is None and len(edges) > 1):
        raise ValueError(f"dimension mismatch: vectors of at most {edges[-1].pos + 1} dimensions")
    if edges[0].pos is None:
        return values.where(F.lit(False)).select("pos", F.col("v").alias("threshold"))
    lo, hi = _constant([e.lo or 0.0 for e in edges], "double"), _constant([e.hi or 0.0 for e in edges], "double")
    share = F.when(hi > lo, (F.col("v") - lo) / (hi - lo)).otherwise(0.0)
    place = F.when(F.isnan("v") | (F.col("v") == float("inf")), RANGES + 1).when(F.col("v") == float("-inf"), -1).otherwise(F.floor(share * RANGES).cast("int"))
    placed = values.where("v IS NOT NULL").select("pos", "v", place.alias("range"))
    # Ranks of the middle values, from 0; one and the same for an odd number.
    n = _constant([e.n for e in edges], "long")
    lower, upper = F.floor((n - 1) / 2), F.floor(n / 2)
    counts = placed.groupBy("pos", "range").agg(F.count("*").alias("size"))
    up_to = Window.partitionBy("pos").orderBy("range")
    counts = counts.withColumn("before", F.sum("size").over(up_to) - F.col("size")).where((F.col("before") <= upper) & (F.col("before") + F.col("size") > lower))
    middle = {r.pos: r for r in counts.groupBy("pos").agg(F.min("range").alias("first"), F.max("range").alias("last"), F.min("before").alias("before")).collect()}  # a row a dimension
    first, last, before = (_constant([middle[e.pos][x] if e.pos in middle else 0 for e in edges], "long") for x in ("first", "last", "before"))
    ranked = placed.where((F.col("range") >= first) & (F.col("range") <= last)).withColumn("at", before + F.row_number().over(Window.partitionBy("pos").orderBy("v")) - 1)
    found = ranked.groupBy("pos").agg(F.avg(F.when((F.col("at") == lower) | (F.col("at") == upper), F.col("v"))).alias("threshold"))
    none = [e.pos for e in edges if not e.n]
    return found.unionByName(df.sparkSession.createDataFrame([(x, None) for x in none], "pos int, threshold double")) if none else found


def _constant(values: list, kind: str) -> Column:
    """The value of the row's ``pos``, from a constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")[F.col("pos")]


def threshold_list(df: DataFrame, column: str = "embedding") -> list[float]:
    """The thresholds on the driver: one number for each dimension."""
    return [r.threshold for r in thresholds(df, column).orderBy("pos").collect()]


def binary(v: Column | str, at: list[float]) -> Column:
    """One boolean for each dimension."""
    return F.zip_with(col(v), F.array(*[F.lit(float(t)) for t in at]), lambda x, t: x.cast("double") >= t)


def binary_words(v: Column | str, at: list[float]) -> Column:
    """The bits in 64-bit words, lowest first, for fast comparison."""
    v = col(v)
    words = []
    for lo in range(0, len(at), 64):
        own = F.array(*[F.lit(float(t)) for t in at[lo : lo + 64]])
        bits = F.zip_with(F.slice(v, lo + 1, 64), own, lambda x, t: F.when(x.cast("double") >= t, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b)))
    return F.array(*words)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits of two word arrays."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
