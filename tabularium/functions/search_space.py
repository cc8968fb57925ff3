"""Search-space text to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SPACE = "MAP<STRING, STRUCT<type: STRING, low: DOUBLE, high: DOUBLE, log: BOOLEAN, choices: ARRAY<STRING>>>"


def parse(df: DataFrame, column: str) -> DataFrame:
    """One row per parameter. Numbers need low and high, categories need choices; anything else is an error."""
    others = [c for c in df.columns if c != column]
    rows = df.select(*others, F.explode(F.from_json(column, SPACE)).alias("parameter", "s"))
    kind = F.col("s.type")
    numeric = kind.isin("float", "int")
    problem = (
        F.when(numeric & (F.col("s.low").isNull() | F.col("s.high").isNull()), "low and high are required")
        .when((kind == "categorical") & (F.coalesce(F.size("s.choices"), F.lit(0)) < 1), "choices are required")
        .when(~F.coalesce(kind.isin("float", "int", "categorical"), F.lit(False)), "unknown type")
    )
    checked = F.when(problem.isNull(), kind).otherwise(
        F.raise_error(F.concat("parameter", F.lit(": "), problem)).cast("string")
    )
    return rows.select(
        *others, "parameter", checked.alias("kind"), F.when(numeric, F.col("s.low")).alias("low"), F.when(numeric, F.col("s.high")).alias("high"),
        F.coalesce("s.log", F.lit(False)).alias("log_scale"), F.coalesce("s.choices", F.array().cast("array<string>")).alias("choices"),
    )
