import random

import corpus_pipeline as c
from lodestone.llm import preference, quality_rules
from lodestone.llm.tokens import encoder_for, tokenizer_file


def corpus():
    rng = random.Random(4)
    syllables = ["ta", "re", "mi", "lo", "ken", "dra", "us", "ip"]
    fresh = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))
    good = [fresh(120) + "." for _ in range(60)]
    junk = [" ".join(w + rng.choice(["***", "###"]) for w in fresh(120).split()) for _ in range(20)]
    texts = good + junk + [good[3], good[5].replace("ta", "TA"), good[7] + " and more", None, "", "too short", "a b c " * 60]
    rows = [(i, t, "xx", "s", 7) for i, t in enumerate(texts)]
    labels = [(i, int(i < 60), 0) for i in range(80)]
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}-{name}")
        if name != "packing":
            assert docs.columns == before.columns
        kept.append({r.doc_id for r in docs.collect()})
    assert set(range(60)) <= kept[0] and set(range(60)) <= kept[1]
    assert not kept[1] & set(range(60, 80)) and not kept[0] & {83, 84, 85, 86}
    assert kept[2] == set(range(60)) == kept[3]
    encoder = encoder_for(tokenizer_file())
    total = sum(len(encoder.encode(rows[i][1])) // 4 + 1 for i in kept[2])
    pieces = c.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in pieces) == total and {r.doc_id for r in pieces} == kept[3]


def test_stages_on_nothing(spark, tmp_path):
    rows, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.createDataFrame([], schema)
    for _, stage in c.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_stage_verdicts_are_the_operators(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, row string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    out = c.quality_rules_stage(spark, docs, str(tmp_path))
    verdict = quality_rules.apply_rules(docs, quality_rules.trusted_ids(spark, str(tmp_path))).where("kept")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in verdict.collect()}
    out = c.quality_classifier_stage(spark, docs, str(tmp_path))
    verdict = preference.classify(docs, marks).where("predicted = 1")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in verdict.collect()}
