"""Checks that labels and later observations stay out of a table, and the JSON report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Columns that carry the truth, and columns known only after disbursement.
TRUTH = ("ring_id", "human_id", "is_kiosk")
LATER = ("n_missed", "max_dpd", "mean_dpd", "sum_dpd", "miss_rate", "ever_dpd30", "first_missed")


def validate_observable(df: DataFrame) -> DataFrame:
    """Return ``df``; raise ValueError if a column carries a label."""
    bad = [c for c in df.columns if c.lower() in TRUTH or c.lower().startswith("label")]
    if bad:
        raise ValueError(f"label columns among the observables: {bad}")
    return df


def validate_at_application(df: DataFrame) -> DataFrame:
    """Return ``df``; raise ValueError if a column is only known after disbursement."""
    bad = [c for c in df.columns if c.lower() in LATER]
    if bad:
        raise ValueError(f"columns from after the application: {bad}")
    return df


def write_split(df: DataFrame, labels: list[str], key: str, folder: str, name: str) -> None:
    """Write observables to ``folder/raw`` and distinct labels to ``folder/labels``."""
    df.drop(*labels).write.mode("overwrite").parquet(f"{folder}/raw/{name}.parquet")
    df.select(key, *labels).dropDuplicates().write.mode("overwrite").parquet(f"{folder}/labels/{name}.parquet")


def write_report(df: DataFrame, path: str) -> None:
    """Write a small result as JSON lines."""
    df.write.mode("overwrite").json(path)
