"""Messy slot columns to canonical features and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip
from ..session import small_side
from .ordered import chunked, row_numbers

# Alias to canonical column name.
ALIASES = {
    "slotpercnt": "slot_percent",
    "eleange": "ele_angle",
    "targetbler": "target_bler",
    "slot_index": "slot",
    "nslot": "slot",
    "slotidx": "slot",
    "elevation": "ele_angle",
    "elevation_angle": "ele_angle",
    "elevation_deg": "ele_angle",
    "elev": "ele_angle",
    "path_loss": "pathloss",
    "dl_cqi": "cqi",
    "cqi_dl": "cqi",
    "mcs_index": "mcs",
    "mcs_idx": "mcs",
    "mcsidx": "mcs",
    "transport_block_size": "tbs",
    "transportblocksize": "tbs",
    "tb_size": "tbs",
    "tbs_bytes": "tbs",
    "window_len": "window",
    "filter_window": "window",
    "win": "window",
    "ackresult": "ack_result",
    "ackstatus": "ack_status",
    "ack_nack": "ack_result",
    "harq_ack": "ack_status",
    "ack": "ack_status",
    "block_error_rate": "bler",
    "blerrate": "bler",
    "bler_percent": "bler",
}

# SINR columns that may stand in for ``snr``, best first.
SINR_PREFERENCE = ["dl_sinr", "dl_sinr_db", "sinr", "sinr_db", "ul_sinr", "ul_sinr_db"]

# Canonical column types.
NUMERIC_TYPES = {
    "snr": "double", "pathloss": "double", "cqi": "int", "mcs": "int", "tbs": "double", "tcr": "double",
    "bler": "double", "target_bler": "double", "slot": "bigint", "slot_percent": "double",
    "ele_angle": "double", "window": "double", "blkerr": "tinyint",
}

# Feature table columns in order.
FEATURE_ORDER = [
    "snr", "snr_round", "snr_bin05", "snr_clip", "pathloss", "pathloss_round", "cqi", "ele_angle",
    "slot_percent", "slot", "window", "target_bler", "mod_code", "snr_cqi", "snr_pathloss", "mcs",
    "tbs", "tcr", "bler", "blkerr", "label_pass",
]

FEATURE_SCHEMA = (
    "snr double, snr_round double, snr_bin05 double, snr_clip double, pathloss double, pathloss_round double, "
    "cqi int, ele_angle double, slot_percent double, slot bigint, window double, target_bler double, "
    "mod_code int, snr_cqi double, snr_pathloss double, mcs int, tbs double, tcr double, bler double, "
    "blkerr tinyint, label_pass tinyint"
)


def canonical_name(name: str) -> str:
    plain = re.sub(r"[^0-9A-Za-z]+", "_", name.strip()).lower().strip("_")
    return ALIASES.get(plain, plain)


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename to canonical names; several sources of one name are coalesced in column order."""
    sources: dict[str, list[str]] = {}
    for name in df.columns:
        sources.setdefault(canonical_name(name), []).append(name)
    return df.select([
        (F.coalesce(*[F.col(f"`{n}`") for n in names]) if len(names) > 1 else F.col(f"`{names[0]}`")).alias(target)
        for target, names in sources.items()
    ])


def promote_sinr(df: DataFrame, file_order: bool = False) -> DataFrame:
    """Give a frame without ``snr`` one from its SINR columns; the source columns used are dropped.

    Default: first non-null in order of preference. ``file_order`` renames the first such column instead.
    """
    if "snr" in df.columns:
        return df
    if file_order:
        present = [c for c in df.columns if c in SINR_PREFERENCE][:1]
    else:
        present = [c for c in SINR_PREFERENCE if c in df.columns]
    if not present:
        return df
    return df.withColumn("snr", F.coalesce(*[F.col(c) for c in present])).drop(*present)


def clean_text(name: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(name).cast("string"), r"^\s+|\s+$", ""), r"^'+|'+$", "")


def clean_cast(df: DataFrame, int_via_double: bool = False) -> DataFrame:
    """Strip blanks and quotes and cast known columns; what does not parse is null.

    ``int_via_double`` also accepts integers written with a decimal point.
    """
    casts = {}
    for name, kind in NUMERIC_TYPES.items():
        if name in df.columns:
            text = clean_text(name)
            if int_via_double and kind in ("int", "bigint", "tinyint"):
                casts[name] = F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
            else:
                casts[name] = text.try_cast(kind)
    return df.withColumns(casts) if casts else df


def ack_to_blkerr(df: DataFrame) -> DataFrame:
    """``blkerr`` (1 = acknowledged) from the first acknowledgement column present, when there is none yet."""
    if "blkerr" in df.columns:
        return df
    if "ack_result" in df.columns:
        value = F.when(F.upper("ack_result") == "ACK", 1).otherwise(0)
    elif "ack_status" in df.columns:
        value = (F.col("ack_status").try_cast("tinyint") == 1).cast("tinyint")
    elif "ack" in df.columns:
        number = F.col("ack").try_cast("tinyint")
        value = F.when(number.isNotNull(), number == 1).otherwise(F.upper(F.col("ack").cast("string")) == "ACK")
    else:
        return df
    return df.withColumn("blkerr", value.cast("tinyint"))


def default_target(df: DataFrame, target: float = 10.0) -> DataFrame:
    """Literal target where the column is missing. The default is percent-like and kept as it is."""
    return df if "target_bler" in df.columns else df.withColumn("target_bler", F.lit(float(target)))


def derived_features(df: DataFrame) -> DataFrame:
    """Rounded, binned, clipped and product features of the columns present."""
    have = set(df.columns)
    new = {}
    if "snr" in have:
        new["snr_round"] = F.rint("snr")
        new["snr_bin05"] = F.floor(F.col("snr") * 2) / 2
        new["snr_clip"] = clip("snr", -20.0, 50.0)
    if "pathloss" in have:
        new["pathloss_round"] = F.rint("pathloss")
    if {"snr", "cqi"} <= have:
        new["snr_cqi"] = F.col("snr") * F.col("cqi").cast("double")
    if {"snr", "pathloss"} <= have:
        new["snr_pathloss"] = F.col("snr") * F.col("pathloss")
    return df.withColumns(new) if new else df


def modulation_codes(df: DataFrame, column: str = "mod", out: str = "mod_code") -> DataFrame:
    """Dense code of a text category over its sorted distinct values: stable under any partitioning."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = row_numbers(chunked(values, [], [column]), out).drop("_chunk", "_idx").withColumn(out, F.col(out).cast("int"))
    return df.join(small_side(codes), column, "left")


def pass_label(df: DataFrame, success_value: int = 1) -> DataFrame:
    """``label_pass``: rate at or below target and block through. ``success_value`` sets the flag polarity.

    The default 1 treats ``blkerr = 1`` as acknowledged; simulator files write 1 for a failed block and need 0.
    """
    if not {"bler", "target_bler", "blkerr"} <= set(df.columns):
        return df
    passed = (F.col("bler") <= F.col("target_bler")) & (F.col("blkerr") == success_value)
    return df.withColumn("label_pass", passed.cast("tinyint"))


def feature_columns(df: DataFrame, keep=()) -> DataFrame:
    return df.select([c for c in FEATURE_ORDER if c in df.columns] + [c for c in keep if c in df.columns])


def align_schema(df: DataFrame, schema: str = FEATURE_SCHEMA) -> DataFrame:
    """Exact columns, order and types of ``schema``; missing ones null, unparsable values null."""
    fields = [part.strip().split() for part in schema.split(",")]
    return df.select([
        (F.col(n).try_cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields
    ])


def engineer(df: DataFrame, success_value: int = 1, target: float = 10.0, file_order: bool = False,
             int_via_double: bool = False) -> DataFrame:
    """Canonical names to labelled features, column-wise; works on batch and streaming frames."""
    named = promote_sinr(canonical_columns(df), file_order)
    typed = default_target(ack_to_blkerr(clean_cast(named, int_via_double)), target)
    if "mod" in typed.columns:
        typed = typed.withColumn("mod", clean_text("mod"))
    return pass_label(derived_features(typed), success_value)


def numeric_filter(df: DataFrame, ranges=None, equals=None, below=None, not_null=()) -> DataFrame:
    """Row filters by range, equality, upper bound and presence; all of them reach the Parquet scan."""
    for name in not_null:
        df = df.where(F.col(name).isNotNull())
    for name, (low, high) in (ranges or {}).items():
        df = df.where(F.col(name).between(low, high))
    for name, value in (equals or {}).items():
        df = df.where(F.col(name) == value)
    for name, value in (below or {}).items():
        df = df.where(F.col(name) < value)
    return df


def find_column(df: DataFrame, part: str) -> str:
    """First column whose name contains ``part``, any case."""
    for name in df.columns:
        if part.lower() in name.lower():
            return name
    raise KeyError(part)


def split_grid_label(df: DataFrame, column: str, row: str = "grid_row", letter: str = "grid_col") -> DataFrame:
    return df.withColumns({
        row: F.regexp_extract(column, r"(\d+)", 1).try_cast("int"),
        letter: F.regexp_extract(column, r"([A-Za-z])", 1),
    })
