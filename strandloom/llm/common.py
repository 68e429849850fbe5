"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share. Only where that is unset on a
    single machine (tests) a temporary folder is made; a cluster's executors wouldn't share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="strandloom-")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``: the fold of a row."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


def sampled(df: DataFrame, key: str, rows: int, size: str | None = None, characters: int = 0) -> DataFrame:
    """About ``rows`` rows of ``df`` at most, and about ``characters`` in all by its column ``size``, the same
    ones each time: those whose hashed key is under a threshold that follows from the counts. For fitting
    classifiers only."""
    found = df.agg(F.count("*").alias("n"), (F.sum(size) if size else F.lit(0)).alias("held")).first()
    share = min(rows / max(found["n"], 1), characters / max(found["held"] or 0, 1) if size else 1.0)
    if share >= 1:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over at least as many partitions as shuffles use, whatever its files look like."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns) if columns else df.repartition(n)


def join_hot(rows: DataFrame, table: DataFrame, key: str, parts: int = 512) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has a row for each ``key``. Keys that hold more than
    1 / ``parts`` of the rows (so fewer than ``parts`` of them) are joined where the rows lie, so no
    task gets all rows of such a key. Both are read twice; pass what is written."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    hot = [r[0] for r in counts.where(F.col("n") > max(64, rows.count() // parts)).select(key).collect()]  # fewer than parts
    if not hot:
        return rows.join(table, key)
    here = F.col(key).isin(hot)
    return rows.where(here).join(F.broadcast(table.where(here)), key).unionByName(rows.where(~here).join(table.where(~here), key))


ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
}


def slices(batch: pa.RecordBatch, rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``size`` bytes of text (a row at least)."""
    held = np.zeros(batch.num_rows + 1, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            held[1:] += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    held = np.cumsum(held)
    at = 0
    while at < batch.num_rows:
        end = min(at + rows, max(at + 1, int(np.searchsorted(held, held[at] + size, side="right")) - 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def parts_of(texts: list[str | None], rows: int = 1024, size: int = 8 << 20) -> Iterator[list[str | None]]:
    """A list in parts of at most ``rows`` texts and about ``size`` characters (a text at least)."""
    part: list[str | None] = []
    held = 0
    for text in texts:
        if part and (len(part) == rows or held + len(text or "") > size):
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text or "")
    if part:
        yield part


def sorted_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches that lie in the order of ``column``, cut anew so that all rows of a value are in one:
    what is held is a batch and the value that it ends in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        if held and held[-1].column(column)[-1].as_py() != values[0].as_py():
            yield pa.concat_batches(held)
            held = []
        first = values.index(values[-1]).as_py()  # of the last value
        if first > 0:
            yield pa.concat_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.concat_batches(held)


def map_lists(df: DataFrame, make: Callable[[], Callable[..., list]], schema: dict[str, str], keep: str | None = None) -> DataFrame:
    """Batches of ``df`` as Python lists, one argument per column, to lists of the new columns.

    ``make`` runs once per task and returns the function, so that what it sets up (tables, models)
    serves all of the task's batches. ``keep`` names a column of ``df`` that goes first into the
    result untouched; the function then returns a list of source row numbers first. Arrow batches
    keep null integers exact, which pandas columns don't.
    """
    names = df.columns
    kinds = {**({keep: df.schema[keep].dataType.simpleString()} if keep else {}), **schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in slices(batch):
                out = each(*(part.column(i).to_pylist() for i, name in enumerate(names) if name != keep))
                first = [part.column(names.index(keep)).take(pa.array(out.pop(0), pa.int64()))] if keep else []
                yield pa.RecordBatch.from_arrays(first + [pa.array(v, ARROW[kind]) for v, kind in zip(out, schema.values(), strict=True)], names=[*kinds])

    return df.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in kinds.items()))
