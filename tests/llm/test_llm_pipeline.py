"""Every stage of the pipeline on rows that are odd in some way."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score string, node int, `rank` string, `_whole` string, digest string"


def prose(r, n):
    return " ".join(r.choice("the of and to in is that for with as on by this from".split() + [f"w{r.randint(0, 3000)}" for _ in range(14)]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    r = random.Random(8)
    base = [prose(r, 120) for _ in range(30)]
    near = base[0].split(" ")
    near[60] = "changed"
    texts = [*base, None, "", " \n", "short", base[1], base[1].replace(" ", "  "), " ".join(near), prose(r, 9000)]
    ids = [*range(len(texts)), None, 5, 5]
    texts = [*texts, base[2], base[5], base[5]]  # no id; an id twice with its text
    rows = [(i, t, None, None, None, "s", 1, "k", "w", "d") for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, FIELDS).repartition(3)
    labels = [(i, 1, int(i % 9 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, folder


@pytest.mark.parametrize("stage", range(4))
def test_a_stage_gives_rows_as_they_are(spark, odd, stage):
    docs, folder = odd
    kept = corpus_pipeline.STAGES[stage][1](spark, docs, folder)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    given, left = Counter(map(tuple, docs.collect())), Counter(map(tuple, kept.collect()))
    assert left <= given and left
    ids = {x[0] for x in left}
    if corpus_pipeline.STAGES[stage][0] == "quality rules":
        assert not ids & {30, 31, 32, 33}
    if corpus_pipeline.STAGES[stage][0] == "exact dedup":
        assert {30, 1, 5} <= ids and not ids & {31, 34, 35, None} and [n for x, n in left.items() if x[0] == 5] == [given[x] for x in left if x[0] == 5]
    if corpus_pipeline.STAGES[stage][0] == "near dedup":
        assert {0, 1, 30, 31, None} <= ids and not ids & {34, 35, 36}


def test_the_last_stage_packs_every_row(spark, odd):
    docs, folder = odd
    packed = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert packed.where("piece = 0").count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_no_rows_give_no_rows(spark, odd, stage):
    docs, folder = odd
    none = spark.createDataFrame([], docs.schema)
    assert corpus_pipeline.STAGES[stage][1](spark, none, folder).count() == 0
