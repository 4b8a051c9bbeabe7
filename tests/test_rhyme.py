"""Rhyme scores of real words, counts of rhyming pairs, patterns, colours and generated works."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosodia.functions import closeness as C
from prosodia.functions import generate, walk
from prosodia.functions import phonology as P
from prosodia.functions import rhyme as R
from prosodia.operators import babble, colours, phonology, resampling, rhyme
from prosodia.sources import xml

PART = "struct<onset:string,nucleus:string,coda:string,vowel:string>"
WORD = f"struct<n:int,np:int,s:{PART},f:{PART}>"
WORDS = "array<struct<idx:int,text:string,sy:string,wb:string,mf:string>>"


def random_words(rng, n):
    def syllable():
        v = rng.choice(["a", "e", "i", "o", "u", "ae", "au", "ü", "ẽ".replace("ẽ", "ẽ"), "ā"])
        plain = v.replace("̃", "").replace("̄", "")
        return (rng.choice(["", "t", "d", "st", "br", "l", "r", "z", "s"]), v, rng.choice(["", "s", "z", "nt", "m", "n", "x", "ks"]), plain[-1])

    out = []
    for _ in range(n):
        k = rng.randint(1, 4)
        s, f = syllable(), syllable()
        out.append((k, 0 if k == 1 else rng.randint(0, min(k - 1, 2)), f if k == 1 else s, f))
    return out


def spoken(*words):
    """Words of a line, given as (text, scansion[, elision])."""
    return [{"idx": i, "text": w[0], "sy": w[1], "wb": None, "mf": w[2] if len(w) > 2 else None} for i, w in enumerate(words)]


def test_sql_score_is_the_plain_one(spark):
    rng = random.Random(1)
    a, b = random_words(rng, 1500), random_words(rng, 1500)
    got = [r.s for r in rhyme.scored(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], f"i int, a {WORD}, b {WORD}"), {"s": ("a", "b")}).orderBy("i").collect()]
    assert got == pytest.approx([C.word(x, y) for x, y in zip(a, b, strict=True)], abs=1e-12)


def scored_by_hand(left, right):
    ends = [phonology.ending(P.line_words(spoken(w))[0]) for w in (left, right)]
    words = [(e["n"], e["np"], *(tuple(e[k][x] for x in ("onset", "nucleus", "coda", "vowel")) for k in "sf")) for e in ends]
    return C.word(*words)


@pytest.mark.parametrize(
    "left, right, want",
    [
        # equal in all: the stressed syllables 1, the last ones 1 x 1.3
        (("cano", "1b1c"), ("mano", "1b1c"), 1 + 1.3),
        # a and o are 0.6 alike; last syllables ris, ris
        (("maris", "1b1c"), ("moris", "1b1c"), 0.6 + 1.3),
        # o and u 0.75, both codas empty; last syllables 1.3
        (("toris", "1b1c"), ("turis", "1b1c"), 0.75 + 1.3),
        # monosyllables: twice the last syllables, e and a are 0.6 alike, the same onset 1.1 and coda 1.2
        (("res", "1A"), ("ras", "1A"), 2 * 0.6 * 1.1 * 1.2),
        # no reading in common but the vowel of the end: i and o 0.42, then onsets d and t close, codas empty 1.1; a and e 0.6
        (("cadi", "1b1c"), ("ceto", "1b1c"), 0.6 + 0.42 * 1 * 1.1),
    ],
)
def test_real_words(left, right, want):
    assert scored_by_hand(left, right) == pytest.approx(want)


@pytest.mark.parametrize("both", [False, True])
def test_hits_of_parts(both):
    rng = random.Random(2)
    x, y = random_words(rng, 150), random_words(rng, 130)
    cx, cy = np.array([rng.randint(1, 5) for _ in x]), np.array([rng.randint(1, 5) for _ in y])
    score = (lambda a, b: max(C.word(a, b), C.word(b, a))) if both else C.word
    want = sum(int(i) * int(j) for (a, i), (b, j) in itertools.product(zip(x, cx, strict=True), zip(y, cy, strict=True)) if score(a, b) >= 1.75)
    assert C.hits(C.Parts(x, cx), C.Parts(y, cy), both=both) == want > 0


def test_rates(spark):
    rng = random.Random(3)
    words = random_words(rng, 25)
    rows = [("ab"[i % 3 == 0], rng.choice(words)) for i in range(200)] + [("a", None), ("c", words[0])]
    df = spark.createDataFrame(rows, f"author string, word {WORD}").repartition(3)
    got = {r.author: (r.hits, r.tries) for r in rhyme.rate(df, None, ["author"]).collect()}
    by = {a: [w for x, w in rows if x == a and w] for a in "ab"}
    want = {a: (sum(max(C.word(p, q), C.word(q, p)) >= 1.75 for p, q in itertools.combinations(ws, 2)), len(ws) * (len(ws) - 1) // 2) for a, ws in by.items()}
    assert got == want
    cross = {r.author: (r.hits, r.tries) for r in rhyme.rate(df, df, ["author"]).collect()}
    assert cross["a"] == (sum(C.word(p, q) >= 1.75 for p in by["a"] for q in by["a"]), len(by["a"]) ** 2)
    drawn = {r.author: r.hits / r.tries for r in rhyme.sampled_rate(df, df, ["author"], 4000, 1).collect()}
    assert drawn["a"] == pytest.approx(cross["a"][0] / cross["a"][1], abs=0.03)
    either = {r.author: (r.hits, r.tries) for r in rhyme.brute_or_sampled(df, df, ["author"], 5000, 1).collect()}
    assert either["a"][1] == 50 and either["b"] == cross["b"]
    assert rhyme.rate(df.limit(0), None, ["author"]).count() == 0


def poem(spark):
    ws = [("arma", "1A1T"), ("cano", "2b2c"), ("maris", "3A3T")]
    lines = [[*ws, ("toris", "6A6X")], [*ws, ("turis", "6A6X")], [("dona", "1A1T"), ("mano", "2b3A"), ("res", "6X")], [*ws, ("moris", "6A6X")]]
    return spark.createDataFrame([("w", "s", 1, "1", i, str(i + 1), "HP"[i % 2], spoken(*ln)) for i, ln in enumerate(lines)], f"work string, author string, book_no long, book_title string, line_idx long, line_name string, metre string, words {WORDS}")


def test_word_ends(spark):
    got = phonology.word_ends(poem(spark).select("line_idx", "words")).orderBy("line_idx").collect()
    assert got[0].at.asDict() == {"first": 0, "ult": 3, "penult": 2, "antepenult": 1, "mid": None} and got[2].at.mid == 1
    assert got[0].ends.ult.f.asDict() == {"onset": "r", "nucleus": "i", "coda": "s", "vowel": "i"} and got[2].ends.ult.n == 1 and got[2].ends.mid is not None


def test_filters(spark):
    ends = phonology.word_ends(poem(spark).select("work", "line_idx", "metre", "words"))
    made = rhyme.build_filter([(0, "ult", 1, "ult"), (0, "first", 1, "first", ">", 2.0)], 2, "aa")
    assert [(r.start, round(r.score, 3)) for r in rhyme.gather(ends, made, ["work"]).collect()] == [(0, round(0.75 + 1.3 + 2.3, 3))]
    assert rhyme.scan_report(ends, made, ["work"], least=1).count() == 1
    with pytest.raises(ValueError):
        rhyme.build_filter([(0, "ult", 2, "ult")], 2, "outside")
    seen = {r.test: (r.t, r.f) for r in rhyme.scan(ends, {"aa": [(0, "ult", 1, "ult")], "low": [(0, "ult", 1, "ult", "<", 1.0)]}, ["work"]).collect()}
    assert seen["aa"] == (1, 2) and sum(seen["low"]) == 3


def test_colours_and_html(spark):
    lines = poem(spark)
    ends = phonology.word_ends(lines.select("book_no", "line_idx", "words"))
    links = rhyme.link(ends, rhyme.BASIC_VERTICAL, ["book_no"])
    found = {(r.line, r.i): r.colour for r in colours.colours(ends, links, "book_no").collect()}
    assert found[(0, 3)] is not None and all(c is None or 0 <= c < 36 for c in found.values())
    page = [r.html for r in colours.html(lines, colours.colours(ends, links, "book_no"), "book_no").orderBy("line").collect()]
    assert page[0].startswith('<p><span class="n">1:1</span> ') and f'<span class="c{found[(0, 3)]}">toris</span>' in page[0] and page[1].startswith('<p class="indent">')


def test_aligned(spark):
    assert phonology.align(["a bcd e", "aa b ẽ"]) == ["a  bcd e", "aa b   ẽ"]
    with pytest.raises(ValueError):
        phonology.align(["a b", "a"])
    rows = phonology.aligned(poem(spark).select("line_idx", "words")).orderBy("line_idx").first().aligned
    assert rows[0].split() == ["arma", "cano", "maris", "toris"] and rows[1].split()[0] == "1A1T" and len(rows) == 3
    made = phonology.phonemic_words(poem(spark).select("words")).first().words
    assert [w.text for w in made] == ["arma", "kano", "maris", "toris"]


def test_written(spark, tmp_path):
    lines = xml.books_as_works(poem(spark))
    assert {r.work for r in lines.select("work").collect()} == {"w 1"}
    xml.write_text(lines, f"{tmp_path}/plain")
    xml.write_text(lines, f"{tmp_path}/rows", aligned=True)
    plain, rows = (spark.read.option("lineSep", "\n\n").text(f"{tmp_path}/{k}").collect() for k in ("plain", "rows"))
    assert plain[0].value == "arma cano maris toris" and rows[0].value.split("\n")[1].split() == ["1A1T", "2b2c", "3A3T", "6A6X"]


def test_joinable():
    w = lambda text, sound, sy="1A", mf=None: {"text": text, "sound": sound, "sy": sy, "mf": mf}
    arma, est = w("arma", "arma", "1A1T"), w("est", "est", "2A", "PE")
    assert generate.joinable(None, arma, 0) and not generate.joinable(None, est, 1) and not generate.joinable(arma, arma, 0)
    assert generate.joinable(arma, est, 0.9) and not generate.joinable(arma, est, 0.1) and not generate.joinable(w("x", "ma", "1b"), est, 0.9)
    assert not generate.joinable(arma, w("et", "et"), 0) and generate.joinable(arma, w("cano", "kano"), 0)
    assert generate.joinable(w("a", "a", "1A", "SY"), w("et", "et"), 0) and not generate.joinable(w("a", "a", "1A", "SY"), w("te", "te"), 0)
    assert generate.joinable(w("c", "mos", "1b"), w("et", "et"), 0) and not generate.joinable(w("c", "mos", "1b"), w("te", "te"), 0)
    assert generate.joinable(est, w("te", "te"), 0) and not generate.joinable(arma, w("--", ""), 0)


def test_generated(spark):
    codes = [("canam", "1A1b1c"), ("tuba", "2A2T"), ("silet", "3A3T"), ("regis", "4A4T"), ("caesare", "5A5b5c"), ("romam", "6A6X")]
    rows = [(k, i, "H", spoken(*[(t + str("aeiou"[i % 5]), s) for t, s in codes])) for k in "xy" for i in range(6)]
    lines = spark.createDataFrame(rows, f"work string, line_idx int, metre string, words {WORDS}")
    made = babble.generate(lines, 5, 1, "work", parts=2).collect()
    again = babble.generate(lines.repartition(5), 5, 1, "work", parts=2).collect()
    assert sorted(map(repr, made)) == sorted(map(repr, again)) and {(r.work, r.replicate) for r in made} <= set(itertools.product("xy", range(5)))
    per = Counter((r.work, r.replicate) for r in made)
    assert max(per.values()) <= 6 and all("".join(w.sy for w in r.words) == "".join(s for _, s in codes) for r in made)
    assert babble.generate(lines.limit(0), 5, 1, "work").count() == 0


def test_generated_sounds_what_it_draws(spark, monkeypatch):
    """Of a source's words only those that are drawn are made and sounded; the works are those of a walk over all words, however they are packed."""
    rng, seen = random.Random(2), []
    words = sorted({("H", "".join(rng.choice("aeiourst") for _ in range(5)), s, None, f) for s in ("1A1T", "2A2b2c", "3A3T", "4A4T", "5A5b5c", "6A6X") for f in (None, "SY") for _ in range(200)}, key=lambda w: (w[0], w[1], w[2], w[4] or ""))
    table = pa.table({k: pa.array([w[i] for w in words], pa.string()) for i, k in enumerate(babble.FIELDS)})
    coded = lambda t: pa.table({k: t.column(k) if k == "text" else t.column(k).dictionary_encode() for k in babble.FIELDS})
    blobs = [babble._written(coded(table.take(list(range(k, len(words), 3))))) for k in range(3)]
    plain = generate.Source([{"text": t, "sy": s, "wb": b, "mf": f, "sound": babble.sounded(t, s, b, f)} for _, t, s, b, f in words], "H")
    sounded = babble.sounded
    monkeypatch.setattr(babble, "sounded", lambda *w: seen.append(w) or sounded(*w))
    have, one, two = babble._listed(blobs)["H"], random.Random(1), random.Random(1)
    assert [have.line(one) for _ in range(20)] == [plain.line(two) for _ in range(20)]
    assert 0 < len(seen) < 600 < len(words) and len(seen) == len(set(seen))


def test_parts_of_works_have_tasks_of_their_own(spark):
    """Parts are small in bytes and long in work, so Spark is not left to put them together."""
    lines = spark.createDataFrame(_couplets(), f"work string, line_idx int, metre string, words {WORDS}")
    plan = babble.generated_hits(lines, 5, 3, "work", TRIED, elegiac=True, parts=5)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "Exchange" in x and "_part" in x]
    assert len(dealt) == 1 and f"{babble.ROOM * 5}), REPARTITION_BY_NUM" in dealt[0]


def test_baselines_and_bounds(spark):
    ends = phonology.word_ends(poem(spark).select("work", "line_idx", "metre", "words"))
    within = babble.baselines(ends, "ult", ["work"], within="P").first().rate
    assert within is None or 0 < within <= 1
    cross = babble.baselines(ends, "ult", ["work"]).first()
    assert cross.rate is not None and 0 < cross.rate <= 1
    word = ends.select("work", F.col("ends.ult").alias("word"))
    b = babble.rate_bounds(word, word, ["work"], 21, 50, 3).first()
    assert 0 <= b.rate_low <= b.rate <= b.rate_high <= 1
    seen = spark.createDataFrame([("w", "aa", 3, 1)], "work string, test string, t long, f long")
    ci = spark.createDataFrame([("w", "aa", *range(1, 8))], "work string, test string, l99 int, l95 int, l90 int, mid int, h90 int, h95 int, h99 int")
    base = spark.createDataFrame([("w", "aa", 0.2, 0.1, 0.4)], "work string, test string, rate double, rate_low double, rate_high double")
    r = babble.examinate(seen, ci, base, ["work", "test"]).first()
    assert r.alternative == "greater" and r.conservative > r.binom > 0
    v = babble.vectorise(spark.createDataFrame([("w", "H", "aa", 0.5)], "work string, metre string, test string, pi double"), ["H-aa", "P-aa"], ["work"], spark.createDataFrame([("w", 9)], "work string, size long")).first()
    assert (v["H-aa"], v["P-aa"], v["size"]) == (0.5, 0.5, 9)


def test_draws_by_kinds(spark):
    rng = random.Random(4)
    rows = [(i, rng.random() < 0.3, rng.randint(0, 2)) for i in range(500)]
    feats = spark.createDataFrame([(i, int(a), b) for i, a, b in rows], "line_idx int, `1SP` int, ELC int")
    got = resampling.sampled_distribution(feats.repartition(4), 40, 60, 9).orderBy("replicate").collect()
    assert got == resampling.sampled_distribution(feats.coalesce(1), 40, 60, 9).orderBy("replicate").collect()
    assert np.mean([r["1SP"] for r in got]) == pytest.approx(np.mean([a for _, a, _ in rows]), abs=0.04)
    assert all((r["1SP"] * 40) == pytest.approx(round(r["1SP"] * 40)) for r in got)
    with pytest.raises(ValueError):
        resampling.sampled_distribution(feats, 501, 1, 1)


def test_nearby_is_the_plain_score(spark):
    """Links, colours and passages of whole groups in batches: by hand from plain scores, over lines whose sounds have odd letters; groups reach over
    batches."""
    from prosodia.functions.rhyme import THRESHOLD

    rng = random.Random(4)
    syl = lambda: (rng.choice(["", "t", "tr", "é", "s"]), *rng.choice([("a", "a"), ("ã", "a"), ("e", "e"), ("ae", "e"), ("ü", "ü"), ("", "")]), rng.choice(["", "s", "nt", "é", "m", "İ"]))
    word = lambda: None if rng.random() < 0.1 else (lambda o, p: (rng.choice([0, 1, 2, 3]), rng.choice([0, 1, 2]), (o[0], o[1], o[3], o[2]), (p[0], p[1], p[3], p[2])))(syl(), syl())
    rows = [(b, i, (word(), word(), word(), word()), (0, 5, 4, 2)) for b in range(3) for i in range(60)]
    part = "struct<onset:string,nucleus:string,coda:string,vowel:string>"
    kind = f"struct<n:int,np:int,s:{part},f:{part}>"
    df = spark.createDataFrame(rows, f"book_no bigint, line_idx bigint, ends struct<first:{kind},ult:{kind},penult:{kind},mid:{kind}>, at struct<first:int,ult:int,penult:int,mid:int>")
    best = {}
    of = {"first": 0, "ult": 1, "penult": 2, "mid": 3}
    for b in range(3):
        for i in range(60):
            for c, (p, q, n) in enumerate(rhyme.BASIC_VERTICAL):
                for k in range(n + 1):
                    if (k or p != q) and i + k < 60:
                        x, y = rows[b * 60 + i], rows[b * 60 + i + k]
                        score = C.word(x[2][of[p]], y[2][of[q]])
                        if score > THRESHOLD:
                            one, two, order = (b, i, x[3][of[p]]), (b, i + k, y[3][of[q]]), (score, -(i * 100 + c * 10 + k))
                            for u, v in ((one, two), (two, one)):
                                best[u] = max(best.get(u, ((-1, 0), None)), (order, v))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        links = rhyme.link(df, rhyme.BASIC_VERTICAL, ["book_no"])
        got = {(r.book_no, r.line, r.i): ((r.line2, r.j), r.score) for r in links.collect()}
        assert got == {u: (v[1:], order[0]) for u, (order, v) in best.items()} and len(got) > 10
        canon = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
        assert canon(colours.linked_colours(df, rhyme.BASIC_VERTICAL, "book_no")) == canon(colours.colours(df, links, "book_no"))
        one, two = rhyme.linked_score(df, rhyme.BASIC_VERTICAL, rhyme.END_BIAS, ["book_no"]), rhyme.score(df, links, rhyme.END_BIAS, ["book_no"])
        assert [tuple(r) for r in one.orderBy("book_no").collect()] == [pytest.approx(tuple(r)) for r in two.orderBy("book_no").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_generated_reads_lines_once(spark):
    """Works of so many lines need no sizes of their sources: the lines are read once, and sources without a name have no works."""
    rows = [(k, 0, "H", spoken(("canam", "1A1b1c"))) for k in ("x", None)]
    lines = spark.createDataFrame(rows, f"work string, line_idx int, metre string, words {WORDS}")
    made = babble.generate(lines, 2, 1, "work", lines_each=1)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString() and made.where("work is null").count() == 0


def test_plain_toy_words(spark):
    tokens = ["", "--", "Arma,", "strengths", "yes", "queue", "Aeneadum-que", "x1y2z", "Key", "facundissimus", "bcd", "a"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").selectExpr("i", f"{R.toy_word('t')} as w").orderBy("i").collect()
    assert [r.w.asDict(recursive=True) for r in got] == [R.toy(t) for t in tokens]


def _couplets():
    h = [("1A1T", "2A2T", "3A3T", "4A4T", "5A5b5c", "6A6X"), ("1A1b1c", "2A", "2T3A", "3T4A4T", "5A5b5c6A", "6X")]
    p = [("1A1b1c", "2A2T", "3A", "4A4b4c", "5A5b5c", "6X")]
    words = "arma virumque cano Troiae qui primus ab oris Italiam fato profugus Laviniaque venit litora multum ille terris iactatus alto".split()
    pick = lambda i, ss: spoken(*[(words[(i * 5 + k * (1 + i % 3)) % len(words)], s) for k, s in enumerate(ss)])
    return [(k, i, "HP"[i % 2], pick(i + 7 * (k == "y"), (h if i % 2 == 0 else p)[(i // 2) % (1 + (i % 2 == 0))])) for k in "xy" for i in range(120)]


TRIED = {"leo": rhyme.TESTS["leo"], "aa -1": rhyme.TESTS["aa -1"], "axa -1": rhyme.TESTS["axa -1"], "abab": rhyme.TESTS["abab"], "aa 0": rhyme.TESTS["aa 0"]}


def test_hits_of_generated_works(spark, monkeypatch):
    """Hits that are counted as works are made are those of a scan over the same lines, over blocks and however the source is dealt."""
    monkeypatch.setattr(walk, "BLOCK", 16)
    source = {m: sorted({tuple(w) for r in _couplets() if r[0] == "x" and r[2] == m for w in (tuple(x.values())[1:] for x in r[3])}, key=repr) for m in "HP"}
    table = pa.table({"metre": [m for m in "HP" for _ in source[m]], **{k: pa.array([w[i] for m in "HP" for w in source[m]], pa.string()) for i, k in enumerate(("text", "sy", "wb", "mf"))}})
    walks, ends = babble._source([babble._digest(table, R.toy, True)])
    whole = [w for m in "HP" for w in source[m]]
    by = {m: [whole[i] for i in walks[m].rows] for m in "HP"}
    seen, lines = {m: walks[m].lines for m in "HP"}, []

    def kept(m):
        def made(n, rng):
            found, size = seen[m](n, rng)
            size[3::11] = 0  # as if no line had been found
            lines.append((m, found, size))
            return found, size

        return made

    for m in "HP":
        walks[m].lines = kept(m)
    got = walk.work_hits(walks, ends, 100, True, np.random.default_rng(5), TRIED, "H", R.THRESHOLD)
    rows, at = [], {"H": 0, "P": 1}
    for m, found, size in lines:
        for ws, n in zip(found.tolist(), size.tolist(), strict=True):
            if n:
                own = [by[m][i] for i in ws[:n]]
                assert all(generate.joinable(a, b, 1) for a, b in itertools.pairwise([None, *[dict(text=t, sy=s, mf=f, sound=babble.alone(t, len(s) // 2, f)) for t, s, _, f in own]]))
                rows.append(("x", at[m], m, spoken(*[(t, s) for t, s, _, _ in own])))
            at[m] += 2
    scanned = rhyme.scan(rhyme.with_ends(spark.createDataFrame(rows, f"work string, line_idx int, metre string, words {WORDS}"), R.toy_word("x.text")), TRIED, ["work"], metre="H").collect()
    assert {k: v for k, v in got.items() if sum(v)} == {r.test: (r.t, r.f) for r in scanned} and len(scanned) == 5


def test_hits_do_not_depend_on_partitions(spark):
    lines = spark.createDataFrame(_couplets(), f"work string, line_idx int, metre string, words {WORDS}")
    one = babble.generated_hits(lines, 5, 3, "work", TRIED, elegiac=True, parts=2).collect()
    two = babble.generated_hits(lines.repartition(7), 5, 3, "work", TRIED, elegiac=True, parts=5).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and {(r.work, r.replicate) for r in one} == set(itertools.product("xy", range(5)))
    # as often as in works of the plain walk: the means of forty works each
    mean = lambda df: {(r.work, r.test): r.m for r in df.groupBy("work", "test").agg(F.avg(F.col("t") / (F.col("t") + F.col("f"))).alias("m")).collect()}
    plain = mean(rhyme.scan(rhyme.with_ends(babble.generate(lines, 40, 3, "work", elegiac=True), R.toy_word("x.text")), TRIED, ["work", "replicate"], metre="H"))
    new = mean(babble.generated_hits(lines, 40, 4, "work", TRIED, elegiac=True))
    assert plain.keys() == new.keys() and all(abs(plain[k] - new[k]) < 0.06 for k in plain)


def test_baselines_read_lines_once(spark):
    """Several baselines at once are those of one at a time, and sound each word once."""
    ends = phonology.word_ends(poem(spark).select("work", "line_idx", "metre", "words"))
    asked = {f"{m} {p}": (m, p, m, p) for m in "HP" for p in ("ult", "mid")} | {"cross ult": ("H", "ult", "P", "ult"), "leo": (None, "ult", None, "mid")}
    got = babble.baselines_of(ends, ["work"], asked)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == ends._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    for name, (m, p, _, q) in asked.items():
        more = {"other": q} if m is None else {"within": m} if name != "cross ult" else {}
        one = {r.work: r.rate for r in babble.baselines(ends, p, ["work"], **more).collect()}
        assert one == {r.work: r.rate for r in got.where(F.col("baseline") == name).collect()}


def test_kinds_leave_out_what_no_score_reads(spark):
    ends = phonology.word_ends(poem(spark).select("work", "line_idx", "metre", "words")).select("work", F.col("ends.ult").alias("word")).where("word is not null")
    other = ends.withColumn("word", F.expr("named_struct('n', case when word.n > 1 then word.n + 3 else word.n end, 'np', word.np, 's', named_struct('onset', 'zz', 'nucleus', word.s.nucleus, 'coda', word.s.coda, 'vowel', word.s.vowel), 'f', word.f)"))
    assert rhyme.rate(ends, other, ["work"]).collect() == rhyme.rate(ends, ends, ["work"]).collect()
    assert [c for c in ends.select(*rhyme._flat("word")).distinct().exceptAll(other.select(*rhyme._flat("word")).distinct()).collect()] == []


def test_vectorise_reads_once(spark):
    """Intervals of generated works are costly: they are worked out once."""
    from prosodia.operators import babble

    rows = spark.createDataFrame([("a", "H", "leo", 2.0), ("a", "H", "aa -1", None), ("a", "P", "leo", 3.0), ("b", "H", "leo", 4.0), ("b", "H", "axa", 9.0)], "work string, metre string, test string, pi double")
    costly = rows.mapInArrow(lambda batches: batches, rows.schema)
    got = babble.vectorise(costly, ["H-leo", "H-aa -1", "P-leo", "P-aa -1"], ["work"], spark.createDataFrame([("a", 5), ("b", 6)], "work string, size bigint"))
    assert got.columns == ["work", "H-leo", "H-aa -1", "P-leo", "P-aa -1", "size"]
    assert sorted(map(tuple, got.collect())) == [("a", 2.0, None, 3.0, None, 5), ("b", 4.0, None, 4.0, None, 6)]
    assert got._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
