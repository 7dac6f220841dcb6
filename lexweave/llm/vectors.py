"""What the two vector operators share: reading vectors, k-means, and packing rows of vectors into blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(column: str) -> Column:
    """Whether a vector is not null, not empty, not zero and holds finite numbers only."""
    v = F.col(column).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(embeddings: DataFrame, *columns: str) -> DataFrame:
    """The columns and the vector v of each row with a usable vector; floats stay floats, all else is doubles."""
    kind = "array<float>" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "array<double>"
    return embeddings.where(is_usable("embedding")).select(*columns, F.col("embedding").cast(kind).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a float64 matrix."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    k = min(k, len(points))
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        order = np.argsort(near, kind="stable")
        some, begin = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(points[order], begin, axis=0)
        centres[some] = sums / np.diff(np.append(begin, len(points)))[:, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def sample_matrix(vectors: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors, those of smallest content hash: a bounded sample that does not depend on partitioning."""
    rows = vectors.select("v").orderBy(F.xxhash64("v")).limit(most).toArrow()
    return matrix(rows.column("v").combine_chunks()) if rows.num_rows else np.zeros((0, 0))
