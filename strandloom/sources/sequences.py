"""FASTA, FASTQ and similarity tables, read and written by Spark's text source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _header(line: Column) -> tuple[Column, Column]:
    return F.regexp_extract(line, r"^(\S+)", 1).alias("id"), F.nullif(F.trim(F.regexp_replace(line, r"^\S+", "")), F.lit("")).alias("info")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, info and seq; one-line and wrapped records. Records are split by the reader."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("r")).where(F.trim("r") != "")
    lines = F.split(F.regexp_replace("r", "\r", ""), "\n")
    return rows.select(*_header(lines[0]), F.array_join(F.slice(lines, 2, F.size(lines)), "").alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """id, info, seq and qual of four-line records.

    Lines are read split by split. A line's number in its file is its place in the split plus the
    lines of the splits before it, so records that cross splits are whole and no task reads a file.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", r"\r$", "").alias("line"), F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    splits = splits.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = lines.join(splits, ["file", "block"]).withColumn("no", F.col("base") + F.col("at") - F.col("first"))
    part = lambda i: F.max(F.when(F.col("no") % 4 == i, F.col("line")))
    r = numbered.groupBy("file", F.floor(F.col("no") / 4).alias("record")).agg(part(0).alias("h"), part(1).alias("seq"), part(3).alias("qual"))
    r = r.where(F.col("h").startswith("@") & F.col("qual").isNotNull())
    return r.select(*_header(F.expr("substring(h, 2)")), "seq", "qual")


def read_m8(spark: SparkSession, path: str) -> DataFrame:
    """BLAST's tabular matches; comment lines are skipped."""
    columns = "qid string, sid string, pct double, length int, mismatches int, gaps int, q_beg int, q_end int, s_beg int, s_end int, p_value double, score double"
    return spark.read.csv(path, sep="\t", schema=columns, comment="#")


def write_fasta(rows: DataFrame, path: str) -> None:
    rows.select(F.concat(F.lit(">"), "id", F.coalesce(F.concat(F.lit(" "), "info"), F.lit("")), F.lit("\n"), "seq")).write.text(path)


def write_fastq(rows: DataFrame, path: str) -> None:
    rows.select(F.concat(F.lit("@"), "id", F.coalesce(F.concat(F.lit(" "), "info"), F.lit("")), F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.text(path)


def read_similarities(spark: SparkSession, path: str) -> DataFrame:
    """qid, n_oligos and sims (array of id, pct) of a table of ``qid n id=pct id=pct``."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^(.*)=", 1).alias("id"), F.regexp_extract(x, r"=([^=]*)$", 1).cast("double").alias("pct"))
    return t.select(F.col("c")[0].alias("qid"), F.col("c")[1].cast("int").alias("n_oligos"), F.transform(F.filter(F.split(F.coalesce(F.get("c", F.lit(2)), F.lit("")), " "), lambda x: x != ""), pair).alias("sims"))


def read_mummer(spark: SparkSession, path: str) -> DataFrame:
    """query, strand, subject, s_begin, q_begin (both from 1) and length of MUMmer's maximal matches. A header line
    ``> name`` (or ``> name Reverse``) leads a query's matches, lines of three numbers, or of a subject's name and three.
    Files are cut at headers, wherever a split falls; other lines, as a query's length, are left out."""
    records = spark.read.text(path, lineSep="\n>").select(F.split(F.regexp_replace(F.translate("value", "\r", ""), "^>", ""), "\n").alias("l"))
    head = F.trim(F.get("l", 0))
    backwards = head.rlike(r"\sReverse$")
    lines = records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("query"), F.when(backwards, "-").otherwise("+").alias("strand"), F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("line"))
    found = lines.where(F.col("line").rlike(r"^\s*(\S+\s+)?[0-9]{1,18}\s+[0-9]{1,18}\s+[0-9]{1,18}\s*$"))
    part = lambda i: F.regexp_extract("line", r"^\s*(?:(\S+)\s+)?([0-9]+)\s+([0-9]+)\s+([0-9]+)\s*$", i)
    return found.select("query", "strand", F.nullif(part(1), F.lit("")).alias("subject"), *(part(i).cast("long").alias(n) for i, n in ((2, "s_begin"), (3, "q_begin"), (4, "length"))))
