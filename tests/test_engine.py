"""Engine queries against their SQL, and operators on small inputs."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strandloom.functions.sequence import binomial, info_map, qualities, reverse_complement
from strandloom.operators import intervals, records, similarity
from strandloom.plans.cleaning import Step, clean
from strandloom.queries import QUERIES, SQL
from strandloom.sources import sequences
from strandloom.streaming.dereplicate import dereplicate_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def rows(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_fasta_and_fastq_round_trip(spark, tmp_path):
    made = spark.createDataFrame([("a", "x=1; y=2", "ACGT", "@III"), ("b", None, "GG", "I!")], "id string, info string, seq string, qual string")
    sequences.write_fasta(made, str(tmp_path / "fa"))
    assert sequences.read_fasta(spark, str(tmp_path / "fa")).orderBy("id").collect() == made.drop("qual").orderBy("id").collect()
    sequences.write_fastq(made, str(tmp_path / "fq"))
    assert sequences.read_fastq(spark, str(tmp_path / "fq")).orderBy("id").collect() == made.orderBy("id").collect()
    (tmp_path / "w.fa").write_text(">r1 note\nAC\nGT\n>r2\nTT\n")
    assert [tuple(r) for r in sequences.read_fasta(spark, str(tmp_path / "w.fa")).orderBy("id").collect()] == [("r1", "note", "ACGT"), ("r2", None, "TT")]
    (tmp_path / "s.tsv").write_text("q1\t9\ta=99.5 b=98\nq2\t0\t\n")
    assert [(r.qid, r.n_oligos, [tuple(x) for x in r.sims]) for r in sequences.read_similarities(spark, str(tmp_path / "s.tsv")).orderBy("qid").collect()] == [("q1", 9, [("a", 99.5), ("b", 98.0)]), ("q2", 0, [])]


def test_scalars(spark):
    r = spark.range(1).select(reverse_complement(F.lit("ACGTR")).alias("c"), qualities(F.lit("!I")).alias("q"), info_map(F.lit("a=1; b=x")).alias("m")).first()
    assert r.c == "YACGT" and r.q == [0, 40] and r.m == {"a": "1", "b": "x"}


def test_quality_trim(spark):
    t = spark.createDataFrame([("abcdefgh", [30] * 5 + [5] * 3), ("ab", [30, 30]), ("abcd", [2, 2, 2, 2])], "seq string, q array<int>")
    assert sorted(r.seq for r in records.trim_quality_end(t, "seq", "q", window=3, match=3).collect()) == ["", "", "abcde"]


def test_contained_sequence_scores_100(spark):
    t = spark.createDataFrame([("q", "ACGTACCATGCA")], "id string, seq string")
    refs = spark.createDataFrame([("r", "TTTACGTACCATGCATT"), ("s", "TTTTTTTTTTTTTTT")], "id string, seq string")
    assert [(r.rid, r.pct) for r in similarity.similarities(t, refs, k=4).collect()] == [("r", 100.0)]


def test_streaming_dereplication(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, seq string").parquet(str(tmp_path / "in"))
    q = dereplicate_stream(stream, "seq", "id").writeStream.format("memory").queryName("derep").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("derep").collect())) == [("a", 1, 2), ("b", 2, 1)]


def test_fastq_records_cross_splits(spark, tmp_path):
    (tmp_path / "a.fq").write_text("".join(f"@r{i} n={i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'@+!I' * (i % 7 + 1)}\n" for i in range(500)))
    (tmp_path / "b.fq").write_text("@s\r\nAC\r\n+\r\n@@\r\n")
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.id: r for r in sequences.read_fastq(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert len(got) == 501 and all((got[f"r{i}"].info, got[f"r{i}"].seq, got[f"r{i}"].qual) == (f"n={i}", "ACGT" * (i % 7 + 1), "@+!I" * (i % 7 + 1)) for i in range(500))
    assert got["s"].info is None and got["s"].seq == "AC" and got["s"].qual == "@@"


def test_m8(spark, tmp_path):
    (tmp_path / "m8").write_text("# a comment\nq\ts\t99.5\t10\t0\t0\t1\t10\t5\t14\t1e-30\t80.1\n")
    assert [(r.qid, r.pct, r.s_end, r.p_value) for r in sequences.read_m8(spark, str(tmp_path / "m8")).collect()] == [("q", 99.5, 14, 1e-30)]


def test_mates_merge_with_mismatches(spark):
    t = spark.createDataFrame([("AAACGTACGT", "CGTACCTGG"), ("AAAA", "CCCC"), ("", "AC"), (None, "A")], "f string, r string")
    assert [(r.overlap, r.merged) for r in records.merge_mates(t, "f", "r", 4, 0.8).collect()] == [(7, "AAACGTACGTGG"), (0, "AAAACCCC"), (0, "AC"), (0, None)]


def test_as_of_across_buckets(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 35), (3, "v", 9), (4, None, 9), (5, "u", 61)], "k long, g string, at long")
    right = spark.createDataFrame([("u", 4, 1), ("u", 12, 7), ("u", 12, 3), ("u", 36, 9), ("v", 10, 2)], "g string, at long, x long")
    got = {r.k: (r.found_at, r.found) for r in intervals.as_of(left, right, "k", "g", "at", "x", 10).collect()}
    assert got == {1: (4, 1), 2: (12, 7), 3: (None, None), 4: (None, None), 5: (36, 9)}


def test_binomial_and_clean(spark):
    r = spark.range(1).select(binomial(F.lit(4), F.lit(2), 0.5).alias("a"), binomial(F.lit(5000), F.lit(0), 0.5).alias("b"), binomial(F.lit(3), F.lit(3), 0.5).alias("c")).first()
    assert abs(r.a - 0.375) < 1e-12 and r.b == 0.0 and abs(r.c - 0.125) < 1e-12
    rows = spark.createDataFrame([("ACGT--",), ("A-",), (None,)], "s string")
    assert [x.s for x in clean(rows, "s", [Step("gaps", lambda s: F.translate(s, "-", "")), Step("length", keep=lambda s: F.length(s) > 2)]).collect()] == ["ACGT"]
