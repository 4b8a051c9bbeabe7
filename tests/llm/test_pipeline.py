"""The five stages on a small table, each against what it has to do."""

import random

import corpus_pipeline
from prosodia.llm import quality_rules, simhash
from prosodia.llm.common import publish


def table(spark, path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(70)
    rows = [(i, prose(150)) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[1][1] + " more")]
    rows += [(310 + i, prose(60) + "\n" + passage + "\n" + prose(60)) for i in range(3)]
    rows += [(400 + i, " ".join(w + "#$%" for w in prose(80).split())) for i in range(60)] + [(500, None), (501, ""), (502, "few words only")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows if i % 2], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return passage


def test_stages(spark, tmp_path):
    passage = table(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, publish(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    verdict = {r.doc_id for r in quality_rules.apply_quality_rules(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect() if r.kept}
    assert ids["quality_rules"] == verdict and not verdict & set(range(400, 503)) and set(range(302)) <= verdict
    assert set(range(300)) <= ids["quality_classifier"]
    comp = simhash.near_duplicates(kept["quality_classifier"]).collect()
    assert ids["simhash_near_dedup"] == {r.component_id for r in comp} and 300 not in ids["simhash_near_dedup"]
    left = [r.text for r in kept["suffix_array_dedup"].orderBy("doc_id").collect()]
    assert sum(passage in t for t in left) == 1 and len(left) == len(ids["simhash_near_dedup"])
    assert ids["best_fit_packing"] == ids["suffix_array_dedup"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["best_fit_packing"].count()


def test_edge_cases(spark, tmp_path):
    """An empty table, rows that repeat an id or are equal, null columns, and further columns whose names the stages use."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    labels = "doc_id bigint, quality int, toxic int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows = [(i, prose(80), "en", None, 0, 7, 8.0, "r", "s") for i in range(30)]
    rows += [rows[3], (3, prose(90), None, "s", None, 7, 8.0, "r", "s"), (None, prose(70), None, None, None, 7, 8.0, None, "s"), (40, None, None, None, None, 7, 8.0, "r", "s")]
    more = f"{schema}, _row int, _score double, row string, kept string"
    docs = spark.createDataFrame(rows, more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, publish(stage(spark, docs, f"{tmp_path}/none"), name)
        assert docs.columns == before.columns and docs.select("_row", "_score", "kept").distinct().collect() == [(7, 8.0, "s")]
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    assert ids == sorted([(False, i) for i in range(30)] + [(False, 3), (True, 0)])
