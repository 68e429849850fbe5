"""Flat files of sequence databases, taxonomies and ontologies, tables, and what a file's format is.

Entries are split by Spark's text reader at their end marks, so a file of any size is read in parts
(uncompressed) and an entry is one row.

Edge cases. Line ends may be CR LF. A field that an entry lacks is null, or an empty array or sequence.
Text before the first and after the last end mark that holds no entry is left out; repeated entries are
rows of their own; an empty file gives an empty table. A malformed line of a table with a fixed
number of columns is an error where ``strict`` is set, else its missing fields are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _entries(spark: SparkSession, path: str, end: str) -> DataFrame:
    rows = spark.read.option("lineSep", end).text(path)
    return rows.select(F.regexp_replace("value", "\r", "").alias("e")).where(F.trim(F.regexp_replace("e", r"[\s/]", "")) != "")


def _field(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract("e", pattern, group)), F.lit(""))


def _joined(code: str) -> Column:
    """The text of all lines of a two-letter code, joined by blanks."""
    lines = F.regexp_extract_all("e", F.lit(rf"(?m)^{code} +(.*)$"), F.lit(1))
    return F.nullif(F.trim(F.array_join(F.transform(lines, lambda x: F.trim(x)), " ")), F.lit(""))


def _listed(text: Column, separator: str = r";\s*|\.$") -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def _bases(block: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(block, F.lit("")), r"[^A-Za-z*-]", ""))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """id, accession, definition, organism, taxonomy (an array) and seq (upper case) of each entry."""
    e = _entries(spark, path, "\n//")
    taxonomy = F.regexp_extract("e", r"(?m)^  ORGANISM +.*\n((?: {12}.*\n?)*)", 1)
    return e.where(F.col("e").rlike(r"(?m)^LOCUS ")).select(
        _field(r"(?m)^LOCUS +(\S+)").alias("id"),
        _field(r"(?m)^ACCESSION +(\S+)").alias("accession"),
        F.nullif(F.trim(F.regexp_replace(F.regexp_extract("e", r"(?m)^DEFINITION +((?:.*)(?:\n {12}.*)*)", 1), r"\s+", " ")), F.lit("")).alias("definition"),
        _field(r"(?m)^  ORGANISM +(.*)$").alias("organism"),
        _listed(F.trim(F.regexp_replace(taxonomy, r"\s+", " "))).alias("taxonomy"),
        _bases(F.regexp_replace(F.regexp_extract("e", r"(?s)(?:^|\n)ORIGIN[^\n]*\n(.*)$", 1), r"[0-9/]", "")).alias("seq"),
    )


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """id, accessions, description, keywords, organism, taxonomy, features (type, location, qualifiers as
    text) and seq of each entry."""
    e = _entries(spark, path, "\n//")
    blocks = F.regexp_extract_all("e", F.lit(r"(?m)^(FT {3}\S.*(?:\nFT {19}.*)*)"), F.lit(1))
    feature = lambda b: F.struct(
        F.regexp_extract(b, r"^FT +(\S+)", 1).alias("type"),
        F.regexp_replace(F.regexp_extract(b, r"(?s)^FT +\S+ +(.*?)(?:\nFT +/|$)", 1), r"\nFT +", "").alias("location"),
        F.regexp_replace(F.regexp_extract(b, r"(?s)\nFT +(/.*)$", 1), r"\nFT +", " ").alias("qualifiers"),
    )
    return e.where(F.col("e").rlike(r"(?m)^ID ")).select(
        _field(r"(?m)^ID +([^\s;]+)").alias("id"), _listed(_joined("AC")).alias("accessions"), _joined("DE").alias("description"), _listed(_joined("KW")).alias("keywords"),
        _field(r"(?m)^OS +(.*)$").alias("organism"), _listed(_joined("OC")).alias("taxonomy"), F.transform(blocks, feature).alias("features"),
        _bases(F.regexp_replace(F.regexp_extract("e", r"(?s)\nSQ [^\n]*\n(.*)$", 1), r"[0-9/]", "")).alias("seq"),
    )


def read_uniprot(spark: SparkSession, path: str) -> DataFrame:
    """id, accessions, name, genes, organism, tax_id, taxonomy, ec_numbers, references (database, key) and
    seq of each entry."""
    e = _entries(spark, path, "\n//")
    links = F.regexp_extract_all("e", F.lit(r"(?m)^DR +(\S+; *[^;\n]+);"), F.lit(1))
    return e.where(F.col("e").rlike(r"(?m)^ID ")).select(
        _field(r"(?m)^ID +(\S+)").alias("id"), _listed(_joined("AC")).alias("accessions"), _field(r"(?m)^DE +RecName: Full=([^;{\n]+)").alias("name"), _joined("GN").alias("genes"),
        F.regexp_replace(_joined("OS"), r"\.$", "").alias("organism"), F.expr(r"try_cast(nullif(regexp_extract(e, '(?m)^OX +NCBI_TaxID=([0-9]+)', 1), '') AS int)").alias("tax_id"),
        _listed(_joined("OC")).alias("taxonomy"), F.regexp_extract_all("e", F.lit(r"(?m)^DE +.*?EC=([0-9.n-]+)"), F.lit(1)).alias("ec_numbers"),
        F.transform(links, lambda x: F.struct(F.split(x, "; *")[0].alias("database"), F.split(x, "; *")[1].alias("key"))).alias("references"),
        _bases(F.regexp_extract("e", r"(?s)\nSQ [^\n]*\n(.*)$", 1)).alias("seq"),
    )


def _piped(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    parts = F.split(F.regexp_replace("value", r"\t\|\r?$", ""), r"\t\|\t", -1)
    at = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return spark.read.text(path).where(F.trim("value") != "").select(*(at(i).alias(n) for i, n in enumerate(names)))


def read_tax_nodes(spark: SparkSession, path: str) -> DataFrame:
    """tax_id, parent_id and rank of a dump of taxonomy nodes; the root's parent is null."""
    rows = _piped(spark, path, ["tax_id", "parent_id", "rank"])
    rows = rows.select(F.col("tax_id").cast("long").alias("tax_id"), F.col("parent_id").cast("long").alias("parent_id"), "rank")
    return rows.withColumn("parent_id", F.when(F.col("parent_id") != F.col("tax_id"), F.col("parent_id")))


def read_tax_names(spark: SparkSession, path: str) -> DataFrame:
    """tax_id, name, unique_name and name_type of a dump of taxonomy names."""
    rows = _piped(spark, path, ["tax_id", "name", "unique_name", "name_type"])
    return rows.withColumn("tax_id", F.col("tax_id").cast("long"))


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """id, name, definition, synonyms, parents (relation, id) and obsolete of the terms of an OBO file."""
    e = _entries(spark, path, "\n[").where(F.col("e").startswith("Term]"))
    of = lambda tag: F.regexp_extract_all("e", F.lit(rf"(?m)^{tag}: *(.*?) *$"), F.lit(1))
    bare = lambda x: F.trim(F.regexp_replace(x, r"\s*!.*$", ""))
    isa = F.transform(of("is_a"), lambda x: F.struct(F.lit("is_a").alias("relation"), bare(x).alias("id")))
    others = F.transform(of("relationship"), lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("relation"), bare(F.regexp_replace(x, r"^\S+\s+", "")).alias("id")))
    quoted = lambda x: F.regexp_extract(x, r'"((?:[^"\\]|\\.)*)"', 1)
    return e.select(
        F.get(of("id"), 0).alias("id"), F.get(of("name"), 0).alias("name"), F.nullif(quoted(F.get(of("def"), 0)), F.lit("")).alias("definition"),
        F.transform(of("synonym"), quoted).alias("synonyms"), F.concat(isa, others).alias("parents"), F.coalesce(F.get(of("is_obsolete"), 0) == "true", F.lit(False)).alias("obsolete"),
    )


def read_table(spark: SparkSession, path: str, needed: list[str], separator: str = "\t", strict: bool = True) -> DataFrame:
    """A table with a header line (which may begin with #) as strings, empty fields null. All of ``needed``
    must be among its columns; blank lines and later lines that begin with # are left out."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    head = lines.where(F.trim("value") != "").first()
    names = [x.strip() for x in head["value"].lstrip("# ").split(separator)] if head else []
    missing = [n for n in needed if n not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    body = lines.where((F.col("value") != head["value"]) & (F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split("value", separator, -1)
    if strict:
        parts = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), "value")))
    return body.select(parts.alias("p")).select(*(F.nullif(F.trim(F.get("p", F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """ID, F-tag and R-tag (null where the table has no such column) of a table of barcodes, upper case
    without blanks. At least one tag column is needed and every ID must occur once."""
    table = read_table(spark, path, ["ID"])
    tags = [c for c in ("F-tag", "R-tag") if c in table.columns]
    if not tags:
        raise ValueError(f"{path} has neither F-tag nor R-tag")
    if not table.groupBy("ID").count().where("count > 1").isEmpty():
        raise ValueError(f"{path} has repeated IDs")
    clean = lambda c: F.upper(F.regexp_replace(F.col(f"`{c}`"), r"\s", "")) if c in tags else F.lit(None).cast("string")
    return table.select("ID", clean("F-tag").alias("F-tag"), clean("R-tag").alias("R-tag"))


def detect_format(spark: SparkSession, path: str) -> str | None:
    """fasta, fastq, genbank, embl, obo, m8 or None, from a file's (or folder's) first lines."""
    lines = [r["value"] for r in spark.read.text(path).where(F.trim("value") != "").limit(4).collect()]
    first = lines[0] if lines else ""
    if first.startswith(">"):
        return "fasta"
    if first.startswith("@") and len(lines) > 2 and lines[2].startswith("+"):
        return "fastq"
    if first.startswith("LOCUS "):
        return "genbank"
    if first.startswith("ID  "):
        return "embl"
    if first.startswith(("format-version:", "[Term]")):
        return "obo"
    return "m8" if len(first.split("\t")) == 12 else None


def write_similarities(hits: DataFrame, path: str) -> None:
    """Lines of ``qid n id=pct id=pct ...``, the best first, from qid, n_oligos, rid and pct."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("pct")).alias("p"), F.col("rid").cast("string").alias("id"))))
    rows = hits.groupBy("qid", "n_oligos").agg(best.alias("sims"))
    shown = F.array_join(F.transform("sims", lambda x: F.concat(x["id"], F.lit("="), F.format_string("%.5f", -x["p"]))), " ")
    rows.select(F.concat_ws("\t", F.col("qid").cast("string"), F.col("n_oligos").cast("string"), shown)).write.text(path)


def write_table(rows: DataFrame, path: str, separator: str = "\t") -> None:
    """A table with a header line in each part file; nulls are empty."""
    rows.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns)).write.csv(path, sep=separator, header=True, nullValue="", emptyValue="")
