"""Vector functions as Column builders and as SQL temporary functions.

Distances accumulate in double, from built-in expressions only, so a filter, projection
or top-k around them stays one Catalyst plan.  Vectors of different length raise.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(values: list[float]) -> Column:
    """A query vector as a constant."""
    bad = [v for v in values if v is None or not np.isfinite(v)]
    if bad:
        raise ValueError("a query vector holds NaN or infinite values")
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<float>")


def same_dimensions(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).when(
        a.isNotNull() & b.isNotNull(), F.raise_error(F.concat(F.lit("dimension mismatch: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))).cast("double")
    )


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return same_dimensions(a, b, _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2_squared(a, b))


def inner_product(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return same_dimensions(a, b, _dot(a, b))


def negative_inner_product(a: Column | str, b: Column | str) -> Column:
    return -inner_product(a, b)


def norm(a: Column | str) -> Column:
    return F.sqrt(_fold(F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column | str, b: Column | str, strict: bool = False) -> Column:
    """1 - cos; 1 where a vector has no length (an error if ``strict``)."""
    a, b = col(a), col(b)
    size = norm(a) * norm(b)
    zero = F.raise_error(F.lit("zero vector")).cast("double") if strict else F.lit(1.0)
    return same_dimensions(a, b, F.when(size == 0, zero).otherwise(1 - _dot(a, b) / F.when(size != 0, size)))


def normalize(a: Column | str, strict: bool = False) -> Column:
    """The vector at length 1; a zero vector as it is (an error if ``strict``)."""
    a = col(a)
    n = norm(a)
    zero = F.raise_error(F.lit("zero vector")).cast("array<float>") if strict else a.cast("array<float>")
    return F.when(n == 0, zero).otherwise(F.transform(a, lambda x: (x.cast("double") / F.when(n != 0, n)).cast("float")))


def dimensions(a: Column | str) -> Column:
    return F.size(col(a))


def is_finite(a: Column | str) -> Column:
    return F.forall(col(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def with_dimensions(a: Column | str, n: int) -> Column:
    a = col(a)
    return F.when(F.size(a) == n, a).when(a.isNotNull(), F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {n}, got "), F.size(a).cast("string"))).cast("array<float>"))


def validated(a: Column | str) -> Column:
    a = col(a)
    return F.when(is_finite(a), a).when(a.isNotNull(), F.raise_error(F.lit("vector holds NaN or infinite values")).cast("array<float>"))


def parse(text: Column | str) -> Column:
    """'[1.0, 2.0]' to a vector; brackets are needed and bad numbers raise."""
    text = F.trim(col(text))
    value = F.from_json(text, "array<float>")
    fine = text.startswith("[") & text.endswith("]") & value.isNotNull() & F.forall(value, lambda x: x.isNotNull())
    return F.when(fine, value).when(text.isNotNull(), F.raise_error(F.concat(F.lit("bad vector literal: "), text)).cast("array<float>"))


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    """Ascending distance of a metric: l2, cosine or ip (negative inner product)."""
    return {"l2": l2, "cosine": cosine, "ip": negative_inner_product}[metric](a, b)


def _number(x: float) -> str:
    return np.format_float_positional(np.float32(x), unique=True, trim="-")


def _mapped(one, kind: str):
    """An Arrow function that maps the values that are not null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else one(v))

    return F.pandas_udf(run, kind)


def format_vector(a: Column | str) -> Column:
    """[1,2.5,3.75]: no spaces, integers without a point."""
    return _mapped(lambda v: "[" + ",".join(map(_number, v)) + "]", "string")(col(a))


def to_binary(a: Column | str) -> Column:
    """Dimensions and a zero as big-endian 32-bit integers, then big-endian floats."""
    return _mapped(lambda v: struct.pack(">II", len(v), 0) + np.asarray(v, ">f4").tobytes(), "binary")(col(a))


def _unpacked(data: bytes) -> np.ndarray:
    n = struct.unpack(">I", data[:4])[0] if len(data) >= 8 else -1
    if n < 0 or len(data) != 8 + 4 * n:
        raise ValueError("binary vector of wrong length")
    out = np.frombuffer(data, ">f4", offset=8).astype("f4")
    if not np.isfinite(out).all():
        raise ValueError("vector holds NaN or infinite values")
    return out


def from_binary(data: Column | str) -> Column:
    return _mapped(lambda b: _unpacked(bytes(b)), "array<float>")(col(data))


SQL = {
    "l2_distance": ("DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), 0D, (s, z) -> s + z))"),
    "inner_product": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, z) -> s + z)"),
    "negative_inner_product": ("DOUBLE", "-aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, z) -> s + z)"),
    "cosine_distance": (
        "DOUBLE",
        "coalesce(1D - try_divide(aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, z) -> s + z), "
        "sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))), 1D)",
    ),
}


def inline_sql(name: str, a: str, b: str) -> str:
    """The distance of two SQL expressions spelled out: SQL functions may not stand in ORDER BY."""
    body = re.sub(r"\b[ab]\b", lambda m: f"({a})" if m.group() == "a" else f"({b})", SQL[name][1])
    return f"IF(size({a}) = size({b}), {body}, CAST(raise_error('dimension mismatch') AS DOUBLE))"


def register_sql(spark: SparkSession) -> None:
    """l2_distance, inner_product, negative_inner_product, cosine_distance, l2_norm, vector_dims, l2_normalize, vector_parse."""
    for name, (kind, body) in SQL.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS {kind} RETURN "
            f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) = size(b) THEN {body} ELSE CAST(raise_error('dimension mismatch') AS DOUBLE) END"
        )
    for name, kind, body in (
        ("l2_norm", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))"),
        ("vector_dims", "INT", "size(a)"),
        ("l2_normalize", "ARRAY<FLOAT>", "transform(a, x -> CAST(coalesce(try_divide(CAST(x AS DOUBLE), sqrt(aggregate(a, 0D, (s, y) -> s + CAST(y AS DOUBLE) * y))), x) AS FLOAT))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>) RETURNS {kind} RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_parse(s STRING) RETURNS ARRAY<FLOAT> RETURN from_json(trim(s), 'array<float>')")


def pack_levels(a: Column | str, bits: int) -> Column:
    """Packed integer levels: 2 bits lowest first, 4 bits high half first, other widths a byte each."""

    def one(v) -> bytes:
        q = np.asarray(v, np.uint8)
        if bits == 2:
            q = np.pad(q, (0, -len(q) % 4)).reshape(-1, 4)
            q = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
        elif bits == 4:
            q = np.pad(q, (0, -len(q) % 2)).reshape(-1, 2)
            q = q[:, 0] << 4 | q[:, 1]
        return q.astype(np.uint8).tobytes()

    return _mapped(one, "binary")(col(a))


def unpack_levels(data: Column | str, bits: int, dims: int) -> Column:
    """The inverse of ``pack_levels`` for vectors of ``dims`` levels."""

    def one(b) -> np.ndarray:
        q = np.frombuffer(bytes(b), np.uint8)
        if bits == 2:
            q = np.stack([q & 3, q >> 2 & 3, q >> 4 & 3, q >> 6], axis=1).ravel()
        elif bits == 4:
            q = np.stack([q >> 4, q & 15], axis=1).ravel()
        return q[:dims].astype(np.int32)

    return _mapped(one, "array<int>")(col(data))
