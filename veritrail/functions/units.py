"""Normalisation of units of measure by an alias table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alias -> (symbol, dimension). All factors to the base unit are 1.
ALIASES = {
    "%": ("percent", "dimensionless"), "мас.%": ("percent", "mass_fraction"), "масс.%": ("percent", "mass_fraction"),
    "wt.%": ("percent", "mass_fraction"), "mg/l": ("mg/L", "concentration"), "мг/л": ("mg/L", "concentration"),
    "мг/дм3": ("mg/L", "concentration"), "мг/дм³": ("mg/L", "concentration"), "g/l": ("g/L", "concentration"),
    "г/л": ("g/L", "concentration"), "г/дм3": ("g/L", "concentration"), "г/дм³": ("g/L", "concentration"),
    "г/т": ("g/t", "mass_fraction"), "ppm": ("ppm", "mass_fraction"), "мм": ("mm", "length"), "mm": ("mm", "length"),
    "см": ("cm", "length"), "cm": ("cm", "length"), "мкм": ("um", "length"), "µm": ("um", "length"), "нм": ("nm", "length"),
    "м/с": ("m/s", "velocity"), "m/s": ("m/s", "velocity"), "°c": ("degC", "temperature"), "c": ("degC", "temperature"),
    "с": ("degC", "temperature"), "k": ("K", "temperature"), "а/м2": ("A/m^2", "current_density"),
    "а/м²": ("A/m^2", "current_density"), "a/m2": ("A/m^2", "current_density"), "a/m²": ("A/m^2", "current_density"),
    "т/сут": ("t/day", "mass_flow_rate"), "t/d": ("t/day", "mass_flow_rate"), "м3/ч": ("m^3/hour", "volume_flow_rate"),
    "м³/ч": ("m^3/hour", "volume_flow_rate"), "квт·ч/т": ("kWh/t", "energy_consumption"),
    "kwh/t": ("kWh/t", "energy_consumption"), "па": ("Pa", "pressure"), "кпа": ("kPa", "pressure"),
    "мпа": ("MPa", "pressure"), "bar": ("bar", "pressure"), "мин": ("minute", "time"), "ч": ("hour", "time"),
    "h": ("hour", "time"), "сут": ("day", "time"), "безразм.": ("dimensionless", "dimensionless"),
    "dimensionless": ("dimensionless", "dimensionless"),
}
#: Base units that are read as themselves where no alias fits: symbol -> dimension.
PLAIN = {"m": "length", "km": "length", "kg": "mass", "g": "mass", "t": "mass", "s": "time", "Pa": "pressure", "kPa": "pressure", "MPa": "pressure", "A": "current", "V": "potential", "W": "power", "J": "energy"}


def unit_key(unit: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.btrim(unit)), F.lit("−"), F.lit("-")), r"\s+", "")


def normalize(rows: DataFrame, unit_col: str) -> DataFrame:
    """rows with symbol, dimension and valid. The alias table (under 100 rows, fixed) is broadcast."""
    spark = rows.sparkSession
    table = [(k, s, d) for k, (s, d) in ALIASES.items()] + [(k.lower(), k, d) for k, d in PLAIN.items() if k.lower() not in ALIASES]
    known = spark.createDataFrame(table, "_key string, symbol string, dimension string")
    keyed = rows.withColumn("_key", unit_key(F.col(unit_col)))
    found = keyed.join(F.broadcast(known), "_key", "left")
    return found.select(
        *[F.col(f"`{c}`") for c in rows.columns], F.coalesce("symbol", F.btrim(unit_col)).alias("symbol"), F.coalesce("dimension", F.lit("unknown")).alias("dimension"),
        F.col("symbol").isNotNull().alias("valid"),
    )
