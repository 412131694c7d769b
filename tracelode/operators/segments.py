"""Segment metadata as intervals: the input of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.instants import int_to_ms


def segment_spans(segmeta: DataFrame) -> DataFrame:
    """``virtual_table_name, first_ms, last_ms`` with bounds of any unit cut to ms.

    Segments without name, without an instant as a bound, or reversed cover nothing."""
    return segmeta.select("virtual_table_name", int_to_ms(F.col("earliest_epoch_ms")).alias("first_ms"), int_to_ms(F.col("latest_epoch_ms")).alias("last_ms")).where("virtual_table_name is not null and first_ms <= last_ms")
