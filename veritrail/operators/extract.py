"""Rule extraction of facts from elements: the deterministic stand-in for a model, behind the same interface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import numeric_mentions

FACT = "element_id string, kind string, name string, value double, unit string, quote string, confidence double"


def measurements(elements: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, value, unit, confidence of each number in a text."""
    found = elements.select(id_col, F.explode(numeric_mentions(F.col(text_col))).alias("m"))
    return found.select(id_col, "m.value", "m.unit", F.when(F.col("m.unit").isNotNull(), 0.75).otherwise(0.5).alias("confidence"))


def extracted(elements: DataFrame, backend: Callable | None = None) -> DataFrame:
    """Facts (columns of FACT) of elements (element_id, text). backend: a function of an iterator of pandas frames, as
    mapInPandas takes it, for a model; without one the rules above are used."""
    if backend is not None:
        return elements.mapInPandas(backend, FACT)
    rows = elements.select("element_id", "text", F.explode(numeric_mentions(F.col("text"))).alias("m"))
    return rows.select("element_id", F.lit("measurement").alias("kind"), F.lit("value").alias("name"), "m.value", "m.unit", F.substring("text", 1, 200).alias("quote"),
                       F.when(F.col("m.unit").isNotNull(), 0.75).otherwise(0.5).alias("confidence"))
