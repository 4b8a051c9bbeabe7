"""Phonology, rhyme, statistics, generation and XML."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosodia.functions import generate, space
from prosodia.functions import phonology as P
from prosodia.functions import rhyme as R
from prosodia.functions import statistics as S
from prosodia.operators import rhyme

from .test_metre import H, frame, line


@pytest.mark.parametrize("word, want", [("contra", "con.tra"), ("asper", "as.per"), ("lixa", "li.xa"), ("iam", "jam"), ("deinde", "de.in.de"), ("anguis", "an.gu.is"), ("quoque", "quo.que"), ("abruptus", "a.brup.tus"), ("cui", "cui"), ("a", "a")])
def test_syllables(word, want):
    assert ".".join(P.syllables(word)) == want


@pytest.mark.parametrize("word, sy, mf, want", [("Troiae", "1A1T", None, ["Troi", "ae"]), ("uirum", "1b1c", None, ["vi", "rum"]), ("moenia", "1A1b1c", None, ["moe", "ni", "a"]), ("dehinc", "1A", None, ["deink"]), ("ille", "1A", "SY", ["il", "le"]), ("xyz", "1A1T2A", None, None)])
def test_fit(word, sy, mf, want):
    assert P.fitted(word, sy, mf) == want


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeghilmnoqrstuvx", min_size=1, max_size=12))
def test_syllables_keep_letters(word):
    made = "".join(P.syllables(word)).lower()
    assert made.replace("j", "i") == word.lower().replace("j", "i")


def test_elision_and_sounds():
    ws = P.line_words([dict(text="multum", sy="1A", wb=None, mf="SY"), dict(text="ille", sy="1T2A", wb="CM", mf=None)])
    assert [w.error for w in ws] == [None, None] and ws[0].syls[1] == "_"
    assert ws[1].syls[0].startswith("til")
    assert P.split_punct("(huc)") == ("(", "huc", ")") and P.split_punct("a-b") == ("", "a", "-")
    assert P.parts("tan")["nucleus"].endswith(P.TILDE) and P.parts("_")["onset"] == ""


def _score(spark, a, b):
    kind = "n int, np int, s struct<onset:string,nucleus:string,coda:string,vowel:string>, f struct<onset:string,nucleus:string,coda:string,vowel:string>"
    df = spark.createDataFrame([(a, b)], f"a struct<{kind.replace(' int', ':int').replace(' struct', ':struct')}>, b struct<{kind.replace(' int', ':int').replace(' struct', ':struct')}>")
    return rhyme.scored(df, {"s": ("a", "b")}).first().s


def test_word_score(spark):
    syl = lambda o, n, c: (o, n, c, n[-1:])
    two = (2, 1, syl("m", "o", "n"), syl("t", "e", "s"))
    assert _score(spark, two, two) == pytest.approx(2.3)
    one = (1, 0, syl("d", "o", "s"), syl("d", "o", "s"))
    assert _score(spark, one, one) == 2.0
    assert _score(spark, None, two) == 0.0
    s, z = (1, 0, syl("t", "a", "s"), syl("t", "a", "s")), (1, 0, syl("t", "a", "z"), syl("t", "a", "z"))
    assert _score(spark, s, z) > _score(spark, z, s)  # z answers only as the second letter


def test_tails():
    assert S.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert S.chi2_tail(31.410432844230918, 20) == pytest.approx(0.05, abs=1e-9)
    assert S.binomial_tail(8, 10, 0.5, "greater") == pytest.approx(56 / 1024)
    assert S.binomial_tail(2, 10, 0.5, "less") == pytest.approx(56 / 1024)
    assert S.binomial_tail(0, 5, 0.0, "greater") == 1.0


def test_contributions_sum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) * [1, 2, 3, 0]
    v, m, p = S.contributions(x[0], x.mean(axis=0), np.cov(x.T, bias=True))
    assert m == pytest.approx(v.sum()) and 0 <= p <= 1


def test_space(spark):
    assert space.place("spr") == pytest.approx(((space.CONSONANTS["s"] + 3 * space.CONSONANTS["p"]) / 4 + 3 * space.CONSONANTS["r"]) / 4)
    got = spark.sql(f"select {space.place_expr('c')} from values ('spr'), ('s'), ('') t(c)").collect()
    assert [r[0] for r in got] == pytest.approx([space.place("spr"), space.place("s"), 1.0])


def test_generator_scans():
    words = [dict(text=t, sound=t, sy=sy, mf=None) for t, sy in (("arma", "1A1T"), ("tela", "1A1T"), ("montes", "2A2T"), ("lentos", "2A2T"), ("currus", "3A3T"), ("fontes", "3A3T"), ("magnus", "4A4T"), ("tempora", "5A5b5c"), ("pulchras", "6A6X"), ("noctes", "6A6X"))]
    made = generate.Source(words, "H").line(random.Random(3))
    sy = "".join(w["sy"] for w in made)
    assert sy.startswith("1A") and sy.endswith("6X") and math.isclose(len(sy) / 2, 13)


XML = """<document><division title="I"><line name="1" metre="H" pattern="DSSS"><word sy="1A1b" wb="CF">Una</word><word sy="" mf="PE">est</word></line>
<line name="2a" metre="H" pattern="corrupt"><word sy="1A">x</word></line></division><division title="II"><line name="1" metre="P" pattern="DD-|DD-"><word sy="1A">y,</word></line></division></document>"""


def test_xml(spark, tmp_path):
    from prosodia.sources import xml

    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.xml").write_text('<document><line name="7" metre="H" pattern="SSSS"><word sy="1A">z</word></line></document>')
    rows = xml.read_poem(spark, [str(tmp_path / "a.xml"), str(tmp_path / "b.xml")], "w", "a").orderBy("line_idx").collect()
    assert [(r.book_no, r.book_title, r.line_idx, r.line_name) for r in rows] == [(1, "I", 0, "1"), (1, "I", 1, "2a"), (2, "II", 2, "1"), (3, None, 3, "7")]
    assert [tuple(w) for w in rows[0].words] == [(0, "Una", "1A1b", "CF", None), (1, "est", "", None, "PE")]
    frame_ = xml.hexameter_frame(xml.read_poem(spark, str(tmp_path / "a.xml"), "w", "a"))
    assert sorted(r.LN for r in frame_.collect()) == [1, 1, 2]
    xml.write_text(xml.read_poem(spark, str(tmp_path / "b.xml")), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        xml.read_poem(spark, [])


def test_stream(spark, tmp_path):
    from prosodia.streaming import verse_stream

    frame(spark, [line(H, i) for i in range(3)]).drop("meter").write.parquet(str(tmp_path / "in"))
    q = verse_stream.line_features(verse_stream.read_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("feats").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("feats").count() == 3


def test_strings(spark):
    from prosodia.functions import strings as T

    df = spark.createDataFrame([("ar ma  vi", ["ar", "ma", "vi"], "abcd", "abxd")], "t string, s array<string>, a string, b string")
    r = df.select(T.mark_places(F.col("t")).alias("m"), T.blank_places(F.col("t")).alias("k"), T.with_trailing_blanks(F.col("t"), F.col("s")).alias("w"), T.differences(F.col("a"), F.col("b")).alias("d"), T.unstressed(F.array(F.lit(1)), F.lit(3)).alias("u"), T.punctuation_to_blanks(F.lit("a,b")).alias("p"), T.stress_places(F.lit("- U -"), "-").alias("x")).first()
    assert r.m == [0, 1, 3, 4, 7, 8] and r.k == [2, 5, 6] and r.w == ["ar ", "ma  ", "vi"] and r.d == [2] and r.u == [0, 2] and r.p == "a b" and r.x == [0, 2]


def test_words_are_worked_out_once():
    """A batch's words by kind: each kind of word, and of run of elided words, is asked for once, and gives what its line gives."""
    import pyarrow as pa

    from prosodia.operators import phonology as O

    w = lambda text, sy, wb=None, mf=None: dict(idx=0, text=text, sy=sy, wb=wb, mf=mf)
    one = [w("multum", "1A", None, "SY"), w("ille", "1T2A", "CM"), w("et", "2T", "DI")]
    batch = [one, [], None, [w("et", "2T", "DI"), w("arma", "1A1T"), w("est", "", None, "PE")], one, [w("est", "", None, "PE"), w("multum", "1A", None, "SY")], [w(None, ""), w("xyz,", "1A1T2A")]]
    asked = []

    def value(run):
        asked.append(run)
        return [P.phonetic([x]) for x in P.line_words([dict(zip(O.FIELDS, r, strict=True)) for r in run])]

    v = O.Valued(pa.array(batch, pa.list_(pa.struct([("idx", pa.int32()), *((k, pa.string()) for k in O.FIELDS)]))), value)
    got = v.lists(v.column(v.values, pa.string())).to_pylist()
    assert got == [[P.phonetic([x]) for x in P.line_words(ws or [])] for ws in batch]
    assert len(asked) == len(set(asked)) and max(map(len, asked)) == 2


def test_impossible_readings_end_at_once(monkeypatch):
    """Numbers of syllables that no joining or parting of vowels can give are refused before any reading is tried."""
    monkeypatch.setattr(P, "syllables", lambda word: pytest.fail("a reading was tried"))
    assert P._fitted.__wrapped__("castrum", 1) is None and P._fitted.__wrapped__("men", 4) is None
