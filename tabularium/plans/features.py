"""Final feature set: checked against the manifest, reduced, imputed and described."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabularium.operators import relate
from tabularium.operators.matrix import hybrid_pca
from tabularium.operators.skew import grouped_quantiles


def final_feature_set(
    features: DataFrame, manifest: DataFrame, key: str, cls: str, core: Sequence[str], residual: Sequence[str], n_components: int = 3
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(feature set, role per column, name-value metadata).

    Fails when a key repeats, is on one side only, or carries another class in the manifest.
    """
    for side, frame in (("features", features), ("manifest", manifest)):
        twice = relate.duplicate_keys(frame, [key]).limit(5).collect()
        if twice:
            raise ValueError(f"{side} repeat {key}: {[r[key] for r in twice]}")
    alone = relate.reconcile(features, manifest, key).limit(5).collect()
    if alone:
        raise ValueError(f"keys on one side only: {[tuple(r) for r in alone]}")
    other = relate.label_conflicts(features, manifest, key, cls).limit(5).collect()
    if other:
        raise ValueError(f"class differs: {[tuple(r) for r in other]}")
    reduced, loadings = hybrid_pca(features, [key, cls], core, residual, n_components)
    columns = [c for c in reduced.columns if c not in (key, cls)]
    medians = grouped_quantiles(reduced, [], columns, [0.5]).first()
    final = reduced.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c][0] if medians[c] else None).cast("double")) for c in columns})
    components = [c for c in columns if c.startswith("PC_Residual_")]
    spark = features.sparkSession
    roles = spark.createDataFrame(
        [(c, "core" if c in core else "component" if c in components else "other") for c in columns], "feature STRING, role STRING"
    )
    explained = loadings.agg(F.max("cumulative").alias("v")).first()["v"]
    counts = manifest.agg(F.count("*").cast("string").alias("n_rows"), F.count_distinct(cls).cast("string").alias("n_classes"))
    metadata = counts.withColumns({
        "n_core": F.lit(str(len(core))), "n_residual": F.lit(str(len(residual))), "n_components": F.lit(str(len(components))),
        "explained_variance": F.lit(None if explained is None else f"{explained:.6f}"),
    })
    metadata = metadata.unpivot([], metadata.columns, "name", "value")
    return final, roles, metadata
