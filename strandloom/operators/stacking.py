"""Alignments grown from similarities: all hits of a query laid over each other, column by column.

A hit is a pair of gapped strings against a stretch of its query. Where hits have characters between two of the query's,
the alignment gets as many columns there as the longest of them needs. These widths are added up from the insertions of
all hits by (query, place), which is at most the query's length a query; each hit, and the query itself, is then
spread out by itself. So no alignment is ever gathered, however many hits a query has.

Edge cases. Hits with a null in any column, or whose strings have different lengths, are left out, as are hits of no known
query and those that reach beyond it. A query without hits is a row of its own. Repeated hits are rows each. Inserted
characters stand to the left in their columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _signs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def insertions(begin: int, query: str) -> tuple[np.ndarray, np.ndarray]:
    """Before which of the query's characters (from 0) a hit that begins at ``begin`` has characters that the query
    lacks, and how many."""
    gap = _signs(query) == ord("-")
    before = begin + np.cumsum(~gap)[gap]
    return np.unique(before, return_counts=True)


def spread_out(begin: int, query: str, subject: str, places: np.ndarray, widths: np.ndarray, length: int) -> str:
    """The row of a hit in the alignment of a query of ``length`` characters with ``widths`` more columns before
    some ``places`` of it."""
    extra = np.zeros(length + 1, np.int64)
    extra[places] = widths
    column = np.arange(length + 1) + np.cumsum(extra)  # of each character of the query, and the end
    gap = _signs(query) == ord("-")
    at = begin + np.cumsum(~gap)  # how many characters of the query come up to and with each column
    run = np.arange(len(gap)) - np.maximum.accumulate(np.where(gap, -1, np.arange(len(gap)))) - 1 if len(gap) else np.zeros(0, np.int64)
    line = np.full(int(column[length]), ord("-"), np.uint32)
    line[np.where(gap, column[np.minimum(at, length)] - extra[np.minimum(at, length)] + run, column[np.maximum(at - 1, 0)])] = _signs(subject)
    return line.tobytes().decode("utf-32-le")


def stacked(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query, subject (null for the query itself) and row of the alignment of each query (query, seq) with its hits
    (query, subject, q_begin from 0, q_gapped, s_gapped); rows of a query are of one length."""
    known = queries.where("query IS NOT NULL AND seq IS NOT NULL").groupBy("query").agg(F.min("seq").alias("seq"))
    own = hits.select("query", "subject", "q_begin", "q_gapped", "s_gapped").dropna()
    bases = F.length(F.translate("q_gapped", "-", ""))
    own = own.where((F.length("q_gapped") == F.length("s_gapped")) & (F.col("q_begin") >= 0))
    own = own.join(known.select("query", F.length("seq").alias("n")), "query").where(F.col("q_begin") + bases <= F.col("n"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [insertions(b, q) for b, q in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n = [len(p) for p, _ in found]
            if sum(n):
                rows = pa.array(np.repeat(np.arange(len(n)), n), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *(pa.array(np.concatenate(x).astype(np.int32)) for x in zip(*found, strict=True))], names=["query", "place", "width"])

    kind = queries.schema["query"].dataType.simpleString()
    wide = own.where(F.instr("q_gapped", "-") > 0).select("query", F.col("q_begin").cast("int"), "q_gapped").mapInArrow(counts, f"query {kind}, place int, width int")
    widths = wide.groupBy("query", "place").agg(F.max("width").alias("width")).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "width"))).alias("extra"))
    plain = known.select("query", F.lit(None).cast(hits.schema["subject"].dataType).alias("subject"), F.lit(0).alias("q_begin"), F.col("seq").alias("q_gapped"), F.col("seq").alias("s_gapped"), F.length("seq").alias("n"))
    rows = own.select("query", "subject", F.col("q_begin").cast("int").alias("q_begin"), "q_gapped", "s_gapped", "n").unionByName(plain).join(widths, "query", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for begin, q, s, n, extra in zip(*(batch.column(name).to_pylist() for name in ("q_begin", "q_gapped", "s_gapped", "n", "extra")), strict=True):
                places, wide = (np.array([x[k] for x in extra or ()], np.int64) for k in ("place", "width"))
                made.append(spread_out(begin, q, s, places, wide, n))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("subject"), pa.array(made, pa.string())], names=["query", "subject", "row"])

    return rows.mapInArrow(run, f"query {kind}, subject {hits.schema['subject'].dataType.simpleString()}, row string")
