"""Cleaning as a chain of steps, with records and characters counted after each in one pass.

A null sequence stays null through changes and is dropped by the first condition; it counts as a record
without characters until then. An empty table has counts of 0 (null sums for characters).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """A change of the sequence, a condition to keep the record, or both (change first)."""

    name: str
    change: Callable[[Column], Column] | None = None
    keep: Callable[[Column], Column] | None = None


def clean(rows: DataFrame, seq: str, steps: list[Step]) -> DataFrame:
    """Records that pass all steps, changed by them; a null condition drops a record."""
    for step in steps:
        if step.change:
            rows = rows.withColumn(seq, step.change(F.col(seq)))
        if step.keep:
            rows = rows.where(step.keep(F.col(seq)))
    return rows


def clean_counts(rows: DataFrame, seq: str, steps: list[Step]) -> DataFrame:
    """step (0: input), name, records and chars left after each step, by one aggregation."""
    now = rows.select(F.col(seq).alias("s"), F.lit(True).alias("alive"))
    sums, names = [], ["input"]
    for i, step in enumerate([Step("input"), *steps]):
        s = step.change(F.col("s")) if step.change else F.col("s")
        now = now.withColumn("s", s)
        if step.keep:
            now = now.withColumn("alive", F.col("alive") & F.coalesce(step.keep(F.col("s")), F.lit(False)))
        now = now.withColumn(f"a{i}", F.col("alive").cast("long")).withColumn(f"c{i}", F.when(F.col("alive"), F.length("s")).otherwise(0))
        names += [step.name] if i else []
        sums.append(F.struct(F.lit(i).alias("step"), F.lit(names[i]).alias("name"), F.sum(f"a{i}").alias("records"), F.sum(f"c{i}").alias("chars")))
    return now.agg(F.array(*sums).alias("steps")).select(F.inline("steps"))
