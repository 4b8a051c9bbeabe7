"""The pipeline's near-duplicates against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from prosodia.llm import common, similar_sets


def brute_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_roots(texts):
    sets, up = [brute_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = " ".join(word() for _ in range(9))
    out = [None, "", " \n", "One two", "one  two", "one two three", "a b c d e f g h", "a b c d e f g h i"]
    for n in (8, 9, 12, 30, 60, 150, 400):
        for _ in range(12):
            t = [word() for _ in range(n)]
            out.append(" ".join(t))
            for _ in range(3):  # changed words, as many as leave similarities on both sides of 0.8
                u = list(t)
                for _ in range(rng.randint(1, max(1, n // 30))):
                    u[rng.randrange(n)] = word()
                out.append(" ".join(u) + rng.choice(["", "", " " + line, " " + word()]))
    return out


def test_keep_one(spark, monkeypatch):
    found = texts()
    root = brute_roots(found)
    rows = [(i, t, "x") for i, t in enumerate(found)] + [(None, found[20], "x"), (20, found[20], "x"), (None, "alone " * 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra string").repartition(3)
    want = sorted({str(r) for r in root} | {"None"})
    for common in (1000, 5):  # with and without shingles that come last
        monkeypatch.setattr(similar_sets, "COMMON", common)
        got = corpus_pipeline.near_duplicates_stage(spark, docs, "")
        assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == want
    assert similar_sets.keep_one(docs.limit(0)).count() == 0


def test_verified_and_split_shards(spark):
    found = [t for t in texts() if t]
    sets = [similar_sets.shingles(t.encode()) for t in found]
    assert similar_sets.verified(sets).tolist() == brute_roots(found)
    rows = [(i, similar_sets.fingerprint(s), [1]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node bigint, fp binary, first array<bigint>")
    links = [(r.a, r.b) for r in similar_sets.candidates(df.select("node", "fp"), df.select("node", "first"), shard_rows=40).collect()]
    up = np.arange(len(sets))
    for _ in range(len(sets)):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    want = brute_roots(found)
    assert all(up[i] == up[r] for i, r in enumerate(want))


def test_rows_are_numbered(spark, tmp_path):
    """Rows from files are named by their places there, whatever is picked of them; others are written down. No two share a name."""
    spark.range(100).selectExpr("id", "array(1, 2) as two").repartition(3).write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    for docs, files in ((read, True), (read.where("id > 9").select("id"), True), (read.selectExpr("id", "explode(two) as x"), False), (read.unionByName(read), False), (read.join(read.select("id"), "id"), False), (spark.range(7), False)):
        rows = common.numbered(docs, "n")
        assert rows.select("n").distinct().count() == docs.count() and rows.drop("n").columns == docs.columns
        assert (rows.agg({"n.file": "max"}).first()[0] != 0) == files


def test_tasks_hold_few_texts(spark):
    """A published table has row groups of bounded size, and steps over whole texts see few rows at once; the session's numbers hold again afterwards."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from prosodia.llm import common

    texts = spark.range(0, 6000, 1, 1).select(F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(40)]).alias("text"))
    made = common.publish(texts, "texts")
    files = [f.removeprefix("file:") for f in made.inputFiles()]
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) >= 3 and made.count() == 6000
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = lambda batches: (b.select(["n"]) for b in batches_of(batches))

    def batches_of(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    with common.few_rows(spark):
        most = made.mapInArrow(seen, "n bigint").agg(F.max("n")).first()[0]
    assert most <= 1000 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
