"""The pipeline's stages on a small table, each against what it promises."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from vecforge.llm import decontaminate, language, neardup


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(1)
    docs = docs.unionByName(odd.withColumn("text", F.lit(None).cast("string"))).unionByName(odd.withColumn("text", F.lit("12 34"))).unionByName(odd)
    out = [("input", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs))
    return dict(out)


def test_columns(stages):
    want = stages["input"].columns
    assert [df.columns == want for df in stages.values()] == [True, True, True, True, True, False]


def test_language_keeps_what_the_network_tells(stages):
    """The rows with letters and a score of LEAST_SCORE at least; nearly all of those with letters."""
    docs = stages["input"]
    scored = language.predict(docs, language.fit(docs)).where("lang_pred <> 'und'")
    letters = docs.where(F.rlike("text", F.lit(r"\p{L}"))).count()
    assert scored.count() == letters
    kept = stages["language_id"].count()
    assert kept == scored.where(F.col("score") >= corpus_pipeline.LEAST_SCORE).count() and kept >= 0.99 * letters


def test_language_rejects_what_the_network_cannot_tell(stages):
    docs = stages["input"]
    scores = sorted(r["score"] for r in language.predict(docs, language.fit(docs)).where("lang_pred <> 'und'").collect())
    middle = scores[len(scores) // 2]
    assert language.identify(docs, min_score=middle).count() == sum(x >= middle for x in scores) < len(scores)


def test_one_document_of_each_group(stages):
    groups = neardup.groups(stages["language_id"])
    assert stages["near_dedup"].count() == groups.select("component_id").distinct().count()
    assert neardup.groups(stages["near_dedup"]).where("not kept").count() == 0


def test_no_benchmark_left(spark, sf, stages):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.report(stages["benchmark_decontamination"], bench).where("contaminated").count() == 0
    found = decontaminate.report(stages["near_dedup"], bench).where("not contaminated").count()
    assert stages["benchmark_decontamination"].count() == found


def test_no_addresses_left(stages):
    after = stages["personal_data"]
    assert after.count() == stages["benchmark_decontamination"].count()
    assert after.where(F.rlike("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"))).count() == 0


def test_all_is_packed(stages):
    """By the tokenizer's own counts, an end id for each text with one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    need = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages["personal_data"].collect() if r["text"])
    assert stages["best_fit_packing"].agg(F.sum("n_tokens")).first()[0] == need
