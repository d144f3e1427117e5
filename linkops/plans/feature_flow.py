"""Slot files to labelled, split feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, sampling
from ..sources import sinks, slots


def features_from_files(spark: SparkSession, path: str, pattern: str = "*", success_value: int = 1, target: float = 10.0,
                        max_files: int | None = None, names_metadata: bool = True) -> DataFrame:
    """Mixed delimited files to the canonical feature table, with their source file."""
    def of_one_kind(frame: DataFrame) -> DataFrame:
        """Files of one header decide by themselves which columns they have and which defaults they need."""
        named = features.promote_sinr(features.canonical_columns(frame))
        if names_metadata:
            named = slots.file_name_metadata(named, keep=True)
            named = named.withColumn("target_bler", F.coalesce("target_bler", F.lit(float(target)).cast("string")))
        return features.engineer(named, success_value, target)

    out = slots.scan_slot_files(spark, path, pattern, max_files, of_one_kind)
    if "mod" in out.columns:
        out = features.modulation_codes(out)
    return features.align_schema(out, features.FEATURE_SCHEMA + ", source_file string")


def write_features(table: DataFrame, path: str, key, test_fraction: float = 0.2, seed: int = 42, mode: str = "error") -> None:
    """Train and test rows in one pass as partitions of one table."""
    sinks.write_split_parquet(sampling.random_split(table, test_fraction, key, seed), path, mode=mode)
