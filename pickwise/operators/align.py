"""Aligning the candidate library with its label table, and dense candidate ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.operators.scale import global_index


def last_per_id(library: DataFrame, order: str, key: str = "smiles") -> DataFrame:
    """Duplicate ids: the last row in file order wins."""
    others = [c for c in library.columns if c not in (key, order)]
    return library.groupBy(key).agg(F.max_by(F.struct(order, *others), order).alias("_row")).select(
        key, F.col(f"_row.{order}").alias(order), *[F.col(f"_row.{c}").alias(c) for c in others]
    )


def align(labels: DataFrame, library: DataFrame, library_order: str, key: str = "smiles") -> DataFrame:
    """Label rows whose id is in the library, in the label table's own order and multiplicity.

    The library side is unique per id after ``last_per_id``, so a frequent id only repeats label
    rows; adaptive skew handling splits such a key.
    """
    return labels.join(last_per_id(library, library_order, key), key)


def require_overlap(aligned: DataFrame) -> DataFrame:
    """An empty overlap is an input error."""
    if aligned.isEmpty():
        raise ValueError("no ids in common between the library and the label table")
    return aligned


def assign_pool_idx(rows: DataFrame, order: str) -> DataFrame:
    """Dense ``pool_idx`` in row order."""
    return global_index(rows, [order], "pool_idx")


def build_labels(library: DataFrame, scores: DataFrame, key: str = "smiles") -> DataFrame:
    """Library rows with a score, in library multiplicity; rows with missing properties are left out."""
    return library.join(scores, key).filter(F.col("qed").isNotNull() & F.col("sa").isNotNull())


def build_labels_report(library: DataFrame, scores: DataFrame, key: str = "smiles") -> DataFrame:
    """Counts behind ``build_labels``: scanned, unscored, invalid and kept rows."""
    scored = F.col("score").isNotNull()
    valid = F.col("qed").isNotNull() & F.col("sa").isNotNull()
    return library.join(scores, key, "left").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~scored).alias("n_unscored"),
        F.count_if(scored & ~valid).alias("n_invalid"),
        F.count_if(scored & valid).alias("n_kept"),
    )


def alignment_report(library: DataFrame, features: DataFrame, key: str = "pool_idx") -> DataFrame:
    """Row counts of both sides and the keys found on one side only."""
    left = library.groupBy(key).agg(F.count(F.lit(1)).alias("_l"))
    right = features.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    return left.join(right, key, "full").agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("n_library"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("n_features"),
        F.count_if(F.col("_r").isNull()).alias("n_missing_features"),
        F.count_if(F.col("_l").isNull()).alias("n_unknown_features"),
    )


def require_aligned(library: DataFrame, features: DataFrame, key: str = "pool_idx") -> None:
    report = alignment_report(library, features, key).first()
    if report.n_library != report.n_features or report.n_missing_features or report.n_unknown_features:
        raise ValueError(f"library and features differ: {report.asDict()}")
