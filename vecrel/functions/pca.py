"""Principal components of a vector column: training over all rows, projection as an expression.

Training takes two scans, one for the mean and one for the scatter around it.  Tasks add
up their rows by matrix products and hand on one number for each cell, which are summed in
partial aggregates; the driver receives dims * dims numbers whatever the table holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import col


@dataclass(frozen=True)
class PCA:
    """Mean, components (largest variance first, one a row) and the variance along each."""

    mean: list[float]
    components: list[list[float]]
    variances: list[float]
    total: float

    @classmethod
    def train(cls, df: DataFrame, k: int, column: str = "embedding") -> PCA:
        """The first k components over all vectors; null vectors take no part.

        Of a component's two signs the one that makes its largest coordinate positive is kept.
        """
        rows = df.where(F.col(column).isNotNull()).select(column)
        about = rows.agg(F.count("*").alias("n"), F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi")).first()
        if about.n < 2:
            raise ValueError("at least two vectors are needed")
        if about.lo != about.hi:
            raise ValueError(f"dimension mismatch: {about.lo} and {about.hi}")
        dims = about.hi
        if not 1 <= k <= dims:
            raise ValueError(f"components must be 1 to {dims}")
        mean = _summed(rows, dims, lambda x: x.sum(0)) / about.n
        scatter = _summed(rows, dims * dims, lambda x: (x - mean).T @ (x - mean)).reshape(dims, dims)
        if not np.isfinite(scatter).all():
            raise ValueError("a vector holds null, NaN or infinite values")
        values, vectors = np.linalg.eigh(scatter / (about.n - 1))
        order = np.argsort(-values, kind="stable")
        kept = vectors[:, order[:k]].T
        kept *= np.where(np.take_along_axis(kept, np.abs(kept).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
        return cls(mean.tolist(), kept.tolist(), np.maximum(values[order[:k]], 0.0).tolist(), float(np.trace(scatter)) / (about.n - 1))

    @property
    def explained(self) -> float:
        """Share of the whole variance that the components hold."""
        return sum(self.variances) / self.total if self.total else 1.0

    def project(self, v: Column | str) -> Column:
        """The coordinates along the components, as an array of doubles; null for null."""
        v = col(v)
        checked = F.when(F.size(v) == len(self.mean), v).when(v.isNotNull(), F.raise_error(F.lit("dimension mismatch")).cast("array<float>"))
        mean, components = (F.from_json(F.lit(json.dumps(x)), kind) for x, kind in ((self.mean, "array<double>"), (self.components, "array<array<double>>")))
        off = F.zip_with(checked, mean, lambda x, m: x.cast("double") - m)
        # One element through a lambda, so that the difference is taken once and not for each component.
        along = F.transform(F.array(off), lambda d: F.transform(components, lambda w: F.aggregate(F.zip_with(d, w, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)))
        return F.when(v.isNotNull(), along[0])


def _summed(rows: DataFrame, cells: int, of) -> np.ndarray:
    """The sum over all batches of an array of ``cells`` numbers that ``of`` makes of a matrix of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            if len(batch):
                flat = batch.column(0).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                total += of(flat.reshape(len(batch), -1)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], ["cell", "value"])

    found = rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").collect()  # a row a cell
    return np.array([r.value for r in found])
