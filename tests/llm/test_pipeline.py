"""The pipeline's stages against brute force and against each other."""

from collections import Counter

import corpus_pipeline
from strata.llm import gam, mixing, rules

from .test_operators import brute_components


def test_stages(spark, fixture_dir):
    labels = spark.read.parquet(f"{fixture_dir}/labels.parquet")
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, fixture_dir)
        path = f"{fixture_dir}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        if k < 4:
            assert after.columns == columns
        seen[name] = (before, [tuple(r) for r in after.collect()])
        docs = after

    before, after = seen["quality_rules"]
    stats = {r["doc_id"]: r for r in rules.op10_quality_rules(spark, fixture_dir).collect()}
    assert Counter(after) == Counter(r for r in before if stats[r[0]]["kept"])

    before, after = seen["quality_classifier"]
    kept = spark.read.parquet(f"{fixture_dir}/stage-quality_rules")
    model = gam.fit_quality(gam.with_features(kept), labels)
    good = model.score(gam.text_features([r[1] for r in before])) >= 0.5
    assert Counter(after) == Counter(r for r, g in zip(before, good, strict=True) if g)

    before, after = seen["ngram_join"]
    groups = brute_components({r[0]: r[1] for r in before}, 5, 80)
    assert Counter(after) == Counter(r for r in before if groups[r[0]][1] == r[0])

    before, after = seen["mixing"]
    taken = Counter(r[0] for r in after)
    sized = spark.read.parquet(f"{fixture_dir}/stage-ngram_join")
    again = Counter(r["doc_id"] for r in mixing.mixed(sized).collect())
    assert taken == again and max(taken.values()) <= 2 and set(after) <= set(before)

    before, after = seen["packing"]
    assert Counter(r[0] for r in after if r[1] == 0) == Counter(r[0] for r in before)


def test_run_gives_what_the_stages_give(spark, fixture_dir):
    out = corpus_pipeline.run(spark, fixture_dir)
    assert "sequence_id" in out.columns and out.count() > 0
