"""The pipeline's stages against brute force, and run() against the stages."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from glyphweave.llm import queries
from glyphweave.llm.encoding import encoder, vocabulary
from tests.llm.test_llm_queries import brute_components, brute_contamination, tricky


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's result, written and read again."""
    docs, out = queries.table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "jaccard", "decontamination", "secrets", "packing"]
    assert "pipeline" in __spark_entry__.queries()


def test_quality_keeps_clean_documents(sf, stages):
    docs, labels = pq.read_table(f"{sf}/documents.parquet").to_pandas(), pq.read_table(f"{sf}/labels.parquet").to_pandas()
    assert list(stages[0].columns) == list(docs.columns)
    kept = labels[labels.doc_id.isin(stages[0].doc_id)]
    assert (kept.quality == 1).mean() > 0.95
    assert labels[labels.quality == 1].doc_id.isin(stages[0].doc_id).mean() > 0.95


def test_one_of_each_group_stays(stages):
    before = stages[0]
    found = brute_components(list(zip(before.doc_id, before.text, strict=True)))
    assert sorted(stages[1].doc_id) == sorted({c for _, _, c in found})


def test_near_copies_share_four_fifths_of_five_words(spark, sf):
    rows = []
    for first, n in ((1, 49), (3, 48)):  # one word of 49 changed leaves 40 of 50 runs of five in common, one of 48 leaves 39 of 49
        words = [f"w{first}x{k}" for k in range(n)]
        rows += [(first, " ".join(words)), (first + 1, " ".join([*words[:20], "other", *words[21:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, sf).collect()) == [1, 3, 4]


def test_contaminated_documents_go(sf, stages):
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pandas()
    judged = brute_contamination(zip(stages[1].doc_id, stages[1].text, strict=True), list(zip(items.item_id, items.text, strict=True)))
    assert sorted(stages[2].doc_id) == sorted(r[0] for r in judged if not r[5])


def test_secrets_are_masked(stages):
    secret = re.compile(r'token = "[0-9a-f]{40}"')
    before, after = stages[2].set_index("doc_id").text, stages[3].set_index("doc_id").text
    assert sorted(before.index) == sorted(after.index)
    for d, t in before.items():
        assert after[d] == secret.sub('token = "[SECRET]"', t)
    assert (stages[3].n_chars == stages[3].text.str.len()).all()


def test_all_tokens_are_packed(stages):
    enc = encoder(vocabulary())
    want = {d: len(enc.ids(t)) + 1 for d, t in zip(stages[3].doc_id, stages[3].text, strict=True)}
    assert stages[4].groupby("doc_id").length.sum().to_dict() == want


def test_run_equals_the_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert len(got) == len(stages[4])
    for column in ("doc_tokens", "length"):
        assert got.groupby("doc_id")[column].sum().to_dict() == stages[4].groupby("doc_id")[column].sum().to_dict()
    whole = lambda df: df[df.length == df.doc_tokens].set_index("doc_id").ids_crc32
    both = whole(got).to_frame("a").join(whole(stages[4]).to_frame("b"), how="inner")
    assert len(both) > len(stages[3]) / 2 and (both.a == both.b).all()


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty and long texts, repeated rows, and columns with the operators' own names come back as they were."""
    docs = tricky(spark).withColumn("contaminated", F.lit("x")).withColumn("n_chars", F.length("text")).withColumn("field_0", F.lit(7)).withColumn("doc", F.lit(1))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
        kept[name] = len(rows)
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert kept["decontamination"] == kept["secrets"] == 12
    assert kept["jaccard"] == 10  # one of the two rows of document 3 goes, and one of the two alphabets
    pieces = corpus_pipeline.pack_sequences(spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == 11
