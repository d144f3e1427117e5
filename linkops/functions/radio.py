"""Radio constants, table frames and closed-form link columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .expr import clip, col

# Modulation order and code rate x 1024 per MCS index 0..27.
MCS_TABLE = [
    (2, 120), (2, 157), (2, 193), (2, 251), (2, 308), (2, 379), (2, 449), (2, 526), (2, 602), (2, 679),
    (4, 340), (4, 378), (4, 434), (4, 490), (4, 553), (4, 616),
    (6, 438), (6, 466), (6, 517), (6, 567), (6, 616), (6, 666), (6, 719),
    (8, 567), (8, 616), (8, 666), (8, 719), (8, 772),
]

# 4-bit CQI tables of TS 38.214 (modulation order, code rate x 1024, efficiency), CQI 1..15.
CQI_TABLES = {
    "table1": [
        (2, 78, 0.1523), (2, 120, 0.2344), (2, 193, 0.3770), (2, 308, 0.6016), (2, 449, 0.8770),
        (2, 602, 1.1758), (4, 378, 1.4766), (4, 490, 1.9141), (4, 616, 2.4063), (6, 466, 2.7305),
        (6, 567, 3.3223), (6, 666, 3.9023), (6, 772, 4.5234), (6, 873, 5.1152), (6, 948, 5.5547),
    ],
    "table2": [
        (2, 78, 0.1523), (2, 193, 0.3770), (2, 449, 0.8770), (4, 378, 1.4766), (4, 490, 1.9141),
        (4, 616, 2.4063), (6, 466, 2.7305), (6, 567, 3.3223), (6, 666, 3.9023), (6, 772, 4.5234),
        (6, 873, 5.1152), (8, 711, 5.5547), (8, 797, 6.2266), (8, 885, 6.9141), (8, 948, 7.4063),
    ],
    "table3": [
        (2, 30, 0.0586), (2, 50, 0.0977), (2, 78, 0.1523), (2, 120, 0.2344), (2, 193, 0.3770),
        (2, 308, 0.6016), (2, 449, 0.8770), (2, 602, 1.1758), (4, 378, 1.4766), (4, 490, 1.9141),
        (4, 616, 2.4063), (6, 466, 2.7305), (6, 567, 3.3223), (6, 666, 3.9023), (6, 772, 4.5234),
    ],
}

# Modulation name per order.
MODULATION = {2: "QPSK", 4: "16QAM", 6: "64QAM", 8: "256QAM"}

# Gentle CQI 0..15 to MCS mapping of the table baseline.
CQI_TO_MCS = [0, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23, 25, 26, 27]

MCS_MIN, MCS_MAX = 0, len(MCS_TABLE) - 1

# Physical constants (SI) and orbit constants of the geometry columns.
EARTH_RADIUS_M = 6371000.0
EARTH_MASS_KG = 5.9720e24
GRAVITATION = 6.67384e-11
LIGHT_SPEED = 299792458.0


def efficiency(mcs: int) -> float:
    """Spectral efficiency of one index; unknown indexes count 0."""
    if MCS_MIN <= mcs <= MCS_MAX:
        order, rate = MCS_TABLE[mcs]
        return order * (rate / 1024)
    return 0.0


def efficiency_column(mcs) -> Column:
    """Spectral efficiency as an array lookup: no join, unknown index gives 0."""
    table = F.array(*[F.lit(efficiency(m)) for m in range(MCS_MAX + 1)])
    index = col(mcs).cast("int")
    return F.when((index >= MCS_MIN) & (index <= MCS_MAX), F.element_at(table, index + 1)).otherwise(F.lit(0.0))


def mcs_frame(spark: SparkSession) -> DataFrame:
    rows = [(m, order, rate / 1024, efficiency(m)) for m, (order, rate) in enumerate(MCS_TABLE)]
    return spark.createDataFrame(rows, "mcs int, qm int, rate double, eff double")


def cqi_frame(spark: SparkSession) -> DataFrame:
    rows = []
    for table, entries in CQI_TABLES.items():
        rows.append((table, 0, None, None, None))
        rows += [(table, cqi, *entry) for cqi, entry in enumerate(entries, start=1)]
    return spark.createDataFrame(rows, "table string, cqi int, qm int, rate_x1024 int, efficiency double")


def with_mcs_entry(df: DataFrame, mcs: str = "mcs") -> DataFrame:
    """Attach order, rate and efficiency of the MCS table (28 rows, broadcast); unknown index gives 0."""
    table = mcs_frame(df.sparkSession).withColumnRenamed("mcs", "_mcs")
    joined = df.join(F.broadcast(table), F.col(mcs) == F.col("_mcs"), "left").drop("_mcs")
    return joined.withColumns({
        "qm": F.coalesce("qm", F.lit(0)),
        "rate": F.coalesce("rate", F.lit(0.0)),
        "eff": F.coalesce("eff", F.lit(0.0)),
    })


def with_cqi_entry(df: DataFrame, cqi: str = "cqi", table: str = "table1") -> DataFrame:
    """Attach the CQI table row (48 rows, broadcast); CQI 0 is raised to 1, null CQI has no row."""
    entries = (
        cqi_frame(df.sparkSession)
        .where(F.col("table") == table)
        .select(F.col("cqi").alias("_cqi"), "qm", "rate_x1024", "efficiency")
        .withColumn("modulation", modulation_name("qm"))
    )
    return df.join(
        F.broadcast(entries), F.when(F.col(cqi).isNotNull(), F.greatest(F.col(cqi).cast("int"), F.lit(1))) == F.col("_cqi"), "left"
    ).drop("_cqi")


def modulation_name(order) -> Column:
    expr = F.lit(None).cast("string")
    for value, name in MODULATION.items():
        expr = F.when(col(order) == value, name).otherwise(expr)
    return expr


def cqi_to_mcs(cqi, mapping: str = "round", scale: float = 2.7, offset: float = 0.0,
               mcs_min: int = MCS_MIN, mcs_max: int = MCS_MAX) -> Column:
    """Baseline CQI to MCS mapping: ``round``, ``linear`` or ``table``, clamped."""
    value = col(cqi).cast("double")
    if mapping == "round":
        mapped = F.rint(value)
    elif mapping == "linear":
        mapped = F.rint(F.lit(float(scale)) * value + F.lit(float(offset)))
    elif mapping == "table":
        index = clip(F.rint(value), 0.0, float(len(CQI_TO_MCS) - 1)).cast("int")
        mapped = F.element_at(F.array(*[F.lit(m) for m in CQI_TO_MCS]), index + 1)
    else:
        raise ValueError(f"unknown mapping {mapping!r}")
    return clip(mapped.cast("int"), mcs_min, mcs_max)


# --- unit conversions and labels of the log flow -------------------------------------------------

def rsrp_dbm(raw) -> Column:
    return col(raw).cast("double") - 156


def rsrq_db(raw) -> Column:
    return col(raw) / 2 - 43


def sinr_db(raw) -> Column:
    return col(raw) / 2 - 23


def ack_text(ack, other: str = "UNKNOWN") -> Column:
    value = col(ack)
    return (F.when(value == 1, "ACK").when(value == 0, "NACK").when(value == 2, "DTX").otherwise(other))


def transmission_type(nrtx, retransmission: str = "retransmission") -> Column:
    return F.when(col(nrtx) > 0, retransmission).otherwise("new")


def rnti_text(rnti) -> Column:
    return F.format_string("0x%04x", col(rnti))


def throughput_mbps(tbs) -> Column:
    """Bytes of one transport block as Mbit (binary kilo, decimal mega)."""
    return col(tbs) * 8 / 1024 / 1000


def trueput_mbps(tbs, ack_status) -> Column:
    return F.when(col(ack_status) == 1, throughput_mbps(tbs)).otherwise(F.lit(0.0))


def slot_rate_kbps(tbs, blkerr, success_value: int = 0) -> Column:
    """Slot rate: block size in kbit when the block got through. ``success_value`` fixes the flag polarity."""
    return F.when(col(blkerr) == success_value, col(tbs)).otherwise(F.lit(0)) / 1000


def legacy_kbps(tbs, divisor: int = 1024) -> Column:
    return col(tbs) * 8 / divisor


# --- link geometry --------------------------------------------------------------------------------

def coverage_seconds(orbit_height_m: float = 600e3) -> float:
    """Time a satellite stays in view for a zero minimum elevation."""
    radius = EARTH_RADIUS_M + orbit_height_m
    period = 2 * math.pi * radius ** 1.5 / math.sqrt(GRAVITATION * EARTH_MASS_KG)
    half_angle = 90 - math.degrees(math.asin(EARTH_RADIUS_M / radius))
    return period * half_angle / 180


def elevation_per_slot(orbit_height_m: float = 600e3) -> float:
    return 180 / (coverage_seconds(orbit_height_m) * 1000)


def with_link_geometry(df: DataFrame, slot: str = "slot", altitude_m: float = 600e3,
                       carrier_hz: float = 2e9, orbit_height_m: float = 600e3) -> DataFrame:
    """Elevation, slant range and free-space path loss of a slot index, as pure column arithmetic."""
    elevation = F.col(slot) * F.lit(elevation_per_slot(orbit_height_m))
    vertical = F.lit(EARTH_RADIUS_M) * F.sin(F.radians(F.col("elevation_deg")))
    slant = F.sqrt(vertical * vertical + F.lit(altitude_m ** 2 + 2 * EARTH_RADIUS_M * altitude_m)) - vertical
    wavelength = LIGHT_SPEED / carrier_hz
    loss = F.lit(20.0) * F.log10(F.lit(4 * math.pi / wavelength) * F.col("slant_m"))
    return (df.withColumn("elevation_deg", elevation).withColumn("slant_m", slant)
            .withColumn("pathloss_db", loss))


def next_csi_slot(slot, period: int, offset: int) -> Column:
    """First slot at or after ``slot`` in which a report may be sent."""
    return (F.lit(period) * F.ceil((col(slot) - F.lit(offset)) / F.lit(period)) + F.lit(offset)).cast("bigint")
