"""Every stage of the pipeline on odd tables, and the whole of it against its parts."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _key long, __size int, mark string, _row int, component long, copies int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    prose = "the cat sat on the mat and the dog lay by the door while rain fell on the {} town and people went home through streets of stone, number {}. "
    rows = [(i, prose.format(i, i) * (1 + i % 4), "en", f"s{i % 3}") for i in range(120)]
    rows += [(i, "### $$$ %%% " * (1 + i % 5), "en", "s1") for i in range(200, 240)]
    rows += [(300, None, "en", "s0"), (301, "", None, None), (302, " \n", "en", "s0"), (None, prose.format("far", "x"), "en", None), (5, prose.format(5, 5) * 2, "en", "s2"), (400, prose.format(7, 7) * 4, None, "s1"), (401, prose.format(7, 7) * 4 + "end", "en", "s1")]
    table = spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "m", 3, 4, 5) for r in rows], COLUMNS)
    table.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(i, 0, 0) for i in range(200, 240, 2)] + [(7, None, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_tables(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = stage(spark, docs, folder)
    assert got.count() and (name == "pack" or got.columns == docs.columns)
    if name != "pack":  # rows come through whole
        assert got.exceptAll(got).count() == 0 and got.select("doc_id", "text").distinct().exceptAll(docs.select("doc_id", "text").distinct()).count() == 0
        assert got.where("_key <> 1 OR __size <> 2 OR mark <> 'm' OR _row <> 3 OR component <> 4 OR copies <> 5").count() == 0
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_what_the_stages_keep(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    kept = ids(corpus_pipeline.language(spark, docs, folder))
    assert not {300, 301, 302} & set(kept) and set(range(120)) <= set(kept) and not set(range(200, 240)) & set(kept)
    kept = ids(corpus_pipeline.good(spark, docs, folder))
    assert set(range(120)) <= set(kept) and not set(range(200, 240)) & set(kept)
    kept = ids(corpus_pipeline.distinct(spark, docs, folder))
    assert None in kept and 400 not in kept and 401 not in kept and 7 in kept and 300 in kept and 301 not in kept
    words = lambda df: df.select("source", F.size(F.filter(F.split("text", "[ \t\n\x0b\f\r]+"), lambda x: x != "")).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    before, after = ({r.source: r.n for r in words(x).collect()} for x in (docs, corpus_pipeline.mixed(spark, docs, folder)))
    names = sorted((x for x in before if x is not None)) + [None]
    goal = mixing.targets([before[x] for x in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert all(abs(after.get(x, 0) - g) <= 0.15 * g + 30 for x, g in zip(names, goal, strict=True))


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    once, again = docs.toPandas(), corpus_pipeline.run(spark, folder).toPandas()
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, once[same].astype(object).values.tolist())) == sorted(map(str, again[same].astype(object).values.tolist()))
    assert again.groupby("sequence_id").length.sum().max() <= 2048 and again.sequence_id.nunique() == -(-again.length.sum() // 2048)


def test_cluster_without_a_shared_folder_is_an_error():
    from strandloom.llm.common import shared_folder

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match=re.escape("spark.checkpoint.dir")):
        shared_folder(Session())
