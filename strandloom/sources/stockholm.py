"""Stockholm alignments: many in a file, interleaved or not, with their features.

Spark's text reader cuts the files at the line that ends an alignment (``//``), wherever a split falls, so files of
any size are read side by side; an alignment is one record. Lines and features come apart in the JVM.

Edge cases. Text before the first header and after the last end is left out; an alignment that the file breaks off in is kept
with what there is. Lines may end in CR LF. Lines that are neither features nor sequences are left out. Two
alignments of one name are told apart by ``n``, a number in no order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """n, name (of #=GF ID, else AC), at and line of every line of every alignment."""
    records = spark.read.text(path, lineSep="\n//").select(F.concat(F.lit("\n"), F.translate("value", "\r", "")).alias("t"), F.monotonically_increasing_id().alias("n"))
    body = F.regexp_extract("t", r"(?s).*?\n# STOCKHOLM[^\n]*\n(.*)", 1)
    held = records.select("n", body.alias("t")).where("t <> ''")
    name = F.coalesce(*(F.nullif(F.regexp_extract("t", rf"(?:^|\n)#=GF +{tag} +([^\n]*?)[ \t]*(?:\n|$)", 1), F.lit("")) for tag in ("ID", "AC")))
    return held.select("n", name.alias("name"), F.posexplode(F.split("t", "\n")).alias("at", "line"))


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """n, name, k (the row's place in the alignment from 0), id and seq of all rows of the alignments."""
    rows = _lines(spark, path).where(r"line RLIKE '^[^#\\s]\\S*\\s+\\S+\\s*$'")
    parts = rows.select("n", "name", "at", F.regexp_extract("line", r"^(\S+)\s+(\S+)", 1).alias("id"), F.regexp_extract("line", r"^(\S+)\s+(\S+)", 2).alias("part"))
    return _joined(parts, ["n", "name", "id"]).withColumnRenamed("value", "seq").select("n", "name", "k", "id", "seq")


def read_stockholm_features(spark: SparkSession, path: str) -> DataFrame:
    """n, name, kind (GF, GS, GC, GR), id (of a row; else null), feature and value. Values of columns (GC, GR)
    are joined over blocks; those of several lines (GF, GS) by a blank."""
    lines = _lines(spark, path).where(r"line RLIKE '^#=G[FSCR][ \\t]'").withColumn("kind", F.substring("line", 3, 2))
    of_row = F.col("kind").isin("GS", "GR")
    shape = F.when(of_row, F.regexp_extract("line", r"^#=G.\s+(\S+)\s+(\S+)\s*(.*?)\s*$", 1))
    feature = F.when(of_row, F.regexp_extract("line", r"^#=G.\s+(\S+)\s+(\S+)\s*(.*?)\s*$", 2)).otherwise(F.regexp_extract("line", r"^#=G.\s+(\S+)\s*(.*?)\s*$", 1))
    value = F.when(of_row, F.regexp_extract("line", r"^#=G.\s+(\S+)\s+(\S+)\s*(.*?)\s*$", 3)).otherwise(F.regexp_extract("line", r"^#=G.\s+(\S+)\s*(.*?)\s*$", 2))
    parts = lines.select("n", "name", "kind", shape.alias("id"), feature.alias("feature"), "at", value.alias("part")).where("feature <> ''")
    keys = ["n", "name", "kind", "id", "feature"]
    columns = _joined(parts.where("kind IN ('GC', 'GR')"), keys).drop("k")
    return columns.unionByName(_joined(parts.where("kind IN ('GF', 'GS')"), keys, " ").drop("k"))


def _joined(parts: DataFrame, keys: list[str], between: str = "") -> DataFrame:
    """The parts of each key in the order of their lines, as ``value``, and the place of the key's first line among
    those of the alignment. A key's parts are a row's blocks, which one task holds; an alignment isn't."""
    both = parts.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), between).alias("value"), F.min("at").alias("__sl_at"))
    firsts = both.groupBy("n").agg(F.sort_array(F.collect_list("__sl_at")).alias("__sl_all"))
    return both.join(firsts, "n").withColumn("k", F.array_position("__sl_all", F.col("__sl_at")).cast("int") - 1).drop("__sl_at", "__sl_all")


def write_stockholm(rows: DataFrame, path: str, ali: str = "name", key: str = "id", seq: str = "seq", order: str | None = None, width: int | None = None) -> None:
    """Alignments as Stockholm text, one record each, rows in the order of a column (else of their ids); with
    ``width`` in blocks of as many columns. Blanks in ids become ``_``; rows with a null are left out. An
    alignment's rows meet in one task, as they do in a file's record."""
    line = F.struct(F.col(order or key).alias("o"), F.regexp_replace(F.col(key).cast("string"), r"\s", "_").alias("id"), F.col(seq).alias("s"))
    held = rows.where(F.col(ali).isNotNull() & F.col(key).isNotNull() & F.col(seq).isNotNull())
    grouped = held.groupBy(F.col(ali).cast("string").alias("ali")).agg(F.sort_array(F.collect_list(line)).alias("rows"), F.max(F.length(seq)).alias("n"))
    if width is None:
        body = F.array_join(F.transform("rows", lambda r: F.concat(r["id"], F.lit(" "), r["s"])), "\n")
    else:
        starts = F.sequence(F.lit(1), F.greatest("n", F.lit(1)), F.lit(width))
        body = F.array_join(F.transform(starts, lambda a: F.array_join(F.transform(F.filter("rows", lambda r: F.length(r["s"]) >= a), lambda r: F.concat(r["id"], F.lit(" "), F.substring(r["s"], a, F.lit(width)))), "\n")), "\n\n")
    grouped.select(F.concat(F.lit("# STOCKHOLM 1.0\n#=GF ID "), "ali", F.lit("\n\n"), body, F.lit("\n//")).alias("value")).write.mode("overwrite").text(path)
