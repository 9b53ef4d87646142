"""Vector similarity to a small, size-checked set of category prototypes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------------------------
NORM_FLOOR = 1e-9
CALIBRATION_START, CALIBRATION_SPAN = 0.25, 0.55
CATEGORY_SIMILARITY = 0.55
# -------------------------------------------------------------------------------------------------
MAX_PROTOTYPES = 1_000  # a few sentences per category; a larger set is a mistake, not a model


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def cosine(left: Column, right: Column) -> Column:
    """Cosine in double precision; a zero vector gives 0 instead of a division by zero."""
    a, b = _doubles(left), _doubles(right)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return _dot(a, b) / F.greatest(norms, F.lit(NORM_FLOOR))


def calibrate(similarity: Column) -> Column:
    """Similarity as a percentage; null stays null (greatest and least would skip it)."""
    percent = (similarity - CALIBRATION_START) / CALIBRATION_SPAN * 100
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent))
    return F.when(similarity.isNotNull(), F.bround(bounded, 2))


@dataclass(frozen=True)
class Prototypes:
    categories: tuple[str, ...]
    vectors: tuple[tuple[float, ...], ...]

    @staticmethod
    def read(df: DataFrame) -> Prototypes:
        """Bring prototypes (category, vector) to the driver after checking how many there are."""
        rows = df.select(
            F.col("category").cast("string"), _doubles(F.col("vector")).alias("vector")
        ).limit(MAX_PROTOTYPES + 1).collect()
        if len(rows) > MAX_PROTOTYPES:
            raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
        rows = sorted(rows, key=lambda row: (row["category"], tuple(row["vector"])))
        return Prototypes(
            tuple(row["category"] for row in rows),
            tuple(tuple(row["vector"]) for row in rows),
        )


SIMILARITY_TYPE = "array<double>"


def similarities(vector: Column, prototypes: Prototypes) -> Column:
    """Best cosine per category, in the order of ``category_names``.

    One matrix product per Arrow batch; vectors never leave the map stage, so there is no join.
    """
    matrix = np.array(prototypes.vectors, dtype=np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    names = category_names(prototypes)
    member = [np.array([c == name for c in prototypes.categories]) for name in names]

    @F.pandas_udf(SIMILARITY_TYPE)
    def best(batch: pd.Series) -> pd.Series:
        known = np.flatnonzero(batch.notna())
        out: list = [None] * len(batch)
        if len(known):
            rows = np.stack(batch.to_numpy()[known]).astype(np.float64)
            lengths = np.sqrt((rows * rows).sum(axis=1))
            cosines = rows @ matrix.T / np.maximum(np.outer(lengths, norms), NORM_FLOOR)
            per_category = np.column_stack([cosines[:, m].max(axis=1) for m in member])
            for at, values in zip(known, per_category, strict=True):
                out[at] = values
        return pd.Series(out, dtype=object)

    return best(vector)


def category_names(prototypes: Prototypes) -> tuple[str, ...]:
    return tuple(sorted(set(prototypes.categories)))


@dataclass(frozen=True)
class VectorScorer:
    """Scorer over a stored vector column; plugs into ``enrich``."""

    prototypes: Prototypes
    revision: str
    column: str = "embedding"

    def __call__(self, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(name) for name in category_names(self.prototypes)])
        close = F.filter(
            F.arrays_zip(F.col("_similar").alias("similarity"), names.alias("name")),
            lambda pair: pair["similarity"] >= CATEGORY_SIMILARITY,
        )
        return (
            df.withColumn("_similar", similarities(F.col(self.column), self.prototypes))
            .withColumns(
                {
                    "semantic_score": calibrate(F.array_max("_similar")),
                    "semantic_categories": F.sort_array(
                        F.transform(close, lambda pair: pair["name"])
                    ),
                    "model_revision": F.lit(self.revision),
                }
            )
            .drop("_similar")
        )


def mean_pool(
    df: DataFrame, keys: Sequence[str], vector: str, mask: str, dimensions: int
) -> DataFrame:
    """Masked mean of token vectors per key, scaled to unit length.

    One partial sum per dimension is combined map-side, so a hot key shuffles one row per task.
    """
    weight = F.col(mask).cast("double")
    sums = [
        F.sum(F.element_at(_doubles(F.col(vector)), at) * weight).alias(f"_s{at}")
        for at in range(1, dimensions + 1)
    ]
    pooled = df.groupBy(*keys).agg(F.sum(weight).alias("_n"), *sums)
    means = F.array(
        *[F.col(f"_s{at}") / F.greatest(F.col("_n"), F.lit(NORM_FLOOR))
          for at in range(1, dimensions + 1)]
    )
    scaled = pooled.select(*keys, means.alias("_mean")).withColumn(
        "_norm", F.greatest(F.sqrt(_dot(F.col("_mean"), F.col("_mean"))), F.lit(NORM_FLOOR))
    )
    return scaled.select(
        *keys, F.transform("_mean", lambda value: value / F.col("_norm")).alias("vector")
    )
