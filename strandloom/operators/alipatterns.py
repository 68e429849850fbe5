"""Search patterns made from alignments: what is alike in all rows is spelled out, what pairs is bound, the rest
becomes gaps of as many characters as the rows have there.

The result is a pattern of ``patterns.find_pattern`` that all rows it was made from match (gaps taken out):

* runs of at least ``least_run`` columns without gaps and with at most ``most_bases`` different bases are ambiguity
  codes;
* helices, runs of at least ``least_helix`` neighbouring column pairs without gaps (of a pairing mask), become a named
  element on the left and its complement on the right, by the pairs A-U, G-C and G-U, with as many
  mismatches as the worst row has;
* all between is ``least...most`` characters.

Columns are counted by (alignment, column), lengths and mispairs by row, so no alignment is gathered; what a
task sees of one at a time are its columns' summaries and its elements.

Edge cases. Null alignments and rows take no part; rows of unequal length have gaps behind their end. Case doesn't
count and U is T. Pairs that cross earlier ones, or whose columns an earlier helix has, are left out. An alignment without a
run or a helix has a null pattern. Helper columns begin with ``__sl_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import AMBIGUITY

RULE = "r1={au,ua,gc,cg,gu,ug}"
_PAIRS = ("AT", "TA", "GC", "CG", "GT", "TG")
PART = "ali string, k int, kind string, first int, last int, partner int, codes string"


def helices(pairs: list[tuple[int, int]], whole: set[int], least: int) -> list[tuple[int, int, int]]:
    """(first column, last column, number of pairs) of runs of stacked pairs in ``whole`` columns, none of which
    crosses or overlaps an earlier one."""
    found: list[tuple[int, int, int]] = []
    run: list[tuple[int, int]] = []
    for pair in [*sorted(p for p in pairs if p[0] in whole and p[1] in whole and p[0] < p[1]), (-9, -9)]:
        if run and pair == (run[-1][0] + 1, run[-1][1] - 1):
            run.append(pair)
            continue
        if len(run) >= least:
            found.append((run[0][0], run[0][1], len(run)))
        run = [pair]
    kept: list[tuple[int, int, int]] = []
    used: set[int] = set()
    for first, last, n in found:
        own = {*range(first, first + n), *range(last - n + 1, last + 1)}
        crosses = any((a < first < b) != (a < last < b) for a, b, _ in kept)
        if len(own) == 2 * n and not own & used and not crosses:
            kept.append((first, last, n))
            used |= own
    return kept


def parts_of(columns: dict[int, tuple[bool, str]], width: int, pairs: list[tuple[int, int]], least_run: int, most_bases: int, least_helix: int) -> list[tuple[str, int, int, int, str]]:
    """(kind, first, last, partner, codes) of the elements of an alignment from left to right. ``columns``: for each
    column whether a row has a gap there, and its different bases in order. Columns count from 0."""
    whole = {c for c, (gap, _) in columns.items() if not gap}
    arms: dict[int, tuple[str, int, int]] = {}  # first column: kind, last column, number of the helix
    for k, (first, last, n) in enumerate(helices(pairs, whole, least_helix), 1):
        arms[first] = ("left", first + n - 1, k)
        arms[last - n + 1] = ("right", last, k)
    taken = {c for a, (_, b, _) in arms.items() for c in range(a, b + 1)}
    told = {c: AMBIGUITY[bases] for c, (gap, bases) in columns.items() if not gap and c not in taken and bases in AMBIGUITY and len(bases) <= most_bases}
    out: list[tuple[str, int, int, int, str]] = []
    at = gap = 0

    def close(upto: int) -> None:
        if gap < upto:
            out.append(("gap", gap, upto - 1, 0, ""))

    while at < width:
        end = at
        while end in told:
            end += 1
        if at in arms:
            close(at)
            kind, last, k = arms[at]
            out.append((kind, at, last, k, ""))
            at = gap = last + 1
        elif end - at >= least_run:
            close(at)
            out.append(("run", at, end - 1, 0, "".join(told[c] for c in range(at, end))))
            at = gap = end
        else:
            at = max(end, at + 1)
    close(width)
    return out


def patterns_from_alignments(rows: DataFrame, ali: str, seq: str, pairs: DataFrame | None = None, least_run: int = 3, most_bases: int = 2, least_helix: int = 2) -> DataFrame:
    """ali, pattern of every alignment in ``rows`` (one row each of an alignment, as wide as it is). ``pairs`` (ali,
    beg, end: columns from 0) as from ``alignment.mask_pairs``."""
    text = F.translate(F.upper(F.col(seq)), "U~.", "T--")
    held = rows.where(F.col(ali).isNotNull() & F.col(seq).isNotNull()).select(F.col(ali).cast("string").alias("ali"), text.alias("__sl_s"))
    chars = held.select("ali", F.posexplode(F.filter(F.split("__sl_s", ""), lambda c: c != "")).alias("col", "ch"))
    sizes = held.groupBy("ali").agg(F.count("*").alias("rows"), F.max(F.length("__sl_s")).alias("width"))
    there = chars.where("ch <> '-'").groupBy("ali", "col", "ch").agg(F.count("*").alias("n"))
    columns = there.groupBy("ali", "col").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set("ch")), "").alias("bases"))
    summary = columns.join(sizes, "ali").groupBy("ali").agg(F.first("width").alias("width"), F.collect_list(F.struct("col", (F.col("n") < F.col("rows")).alias("gap"), "bases")).alias("columns"))
    if pairs is None:
        summary = summary.withColumn("pairs", F.array().cast("array<struct<beg:int,end:int>>"))
    else:
        own = pairs.select(F.col(ali).cast("string").alias("ali"), F.struct(F.col("beg").cast("int").alias("beg"), F.col("end").cast("int").alias("end")).alias("p")).groupBy("ali").agg(F.collect_list("p").alias("pairs"))
        summary = summary.join(own, "ali", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                columns = {c["col"]: (c["gap"], c["bases"]) for c in row.columns}
                folded = [(p["beg"], p["end"]) for p in row.pairs] if row.pairs is not None else []
                out += [(row.ali, k, *part) for k, part in enumerate(parts_of(columns, int(row.width), folded, least_run, most_bases, least_helix))]
            yield pd.DataFrame(out, columns=["ali", "k", "kind", "first", "last", "partner", "codes"])

    parts = summary.select("ali", "width", "columns", "pairs").mapInPandas(run, PART)
    other = parts.where("kind = 'left'").select("ali", "partner", F.col("first").alias("__sl_a"))
    elements = parts.join(other, ["ali", "partner"], "left")
    # What the rows have in each element: characters that are no gaps, and pairs that are none.
    span = F.rpad(F.substring("__sl_s", F.col("first") + 1, F.col("last") - F.col("first") + 1), F.col("last") - F.col("first") + 1, F.lit("-"))
    length = F.length(F.translate(span, "-", ""))
    mates = F.reverse(F.substring("__sl_s", F.col("__sl_a") + 1, F.col("last") - F.col("first") + 1))
    apart = F.size(F.filter(F.zip_with(F.split(mates, ""), F.split(span, ""), lambda x, y: F.concat(x, y)), lambda p: (p != "") & ~p.isin(*_PAIRS)))
    seen = held.join(elements, "ali").groupBy("ali", "k", "kind", "partner", "codes").agg(F.min(length).alias("least"), F.max(length).alias("most"), F.max(F.when(F.col("kind") == "right", apart)).alias("apart"))
    gap = F.concat(F.col("least"), F.lit("..."), F.col("most"))
    helix = F.concat(F.lit("r1~p"), F.col("partner"), F.when(F.col("apart") > 0, F.concat(F.lit("["), F.col("apart"), F.lit(",0,0]"))).otherwise(""))
    said = F.when(F.col("kind") == "run", F.col("codes")).when(F.col("kind") == "left", F.concat(F.lit("p"), F.col("partner"), F.lit("="), gap)).when(F.col("kind") == "right", helix).otherwise(F.when(F.col("most") > 0, gap))
    joined = seen.withColumn("said", said).groupBy("ali").agg(F.array_sort(F.collect_list(F.struct("k", "said", "kind"))).alias("all"))
    words = F.array_join(F.transform(F.filter("all", lambda x: x["said"].isNotNull()), lambda x: x["said"]), " ")
    told, folded = F.exists("all", lambda x: x["kind"].isin("run", "left")), F.exists("all", lambda x: x["kind"] == "left")
    made = joined.select("ali", F.when(told, F.concat(F.when(folded, RULE + " ").otherwise(""), words)).alias("pattern"))
    return held.select("ali").distinct().join(made, "ali", "left").withColumnRenamed("ali", ali)
