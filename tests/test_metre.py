"""Predicates, cleaning and features on small lines."""

import random

import pytest
from pyspark.sql import functions as F

from prosodia.functions import metre as M
from prosodia.operators import cleaning, features, search

WORDS = "array<struct<idx:int,text:string,sy:string,wb:string,mf:string>>"
SCHEMA = f"work string, author string, book_no bigint, book_title string, line_idx int, line_name string, metre string, meter string, pattern string, words {WORDS}"


def line(words, idx=0, book=1, metre="H", pattern="DSSS", meter=None, name=None):
    return ("w", "a", book, str(book), idx, name or str(idx + 1), metre, meter, pattern, [(k, t, sy, wb, mf) for k, (t, sy, wb, mf) in enumerate(words)])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


H = [("Una", "1A1b", "CF", None), ("canit", "1c2A", "CM", None), ("silvas", "2T3A", "CM", None), ("et", "3T", "DI", None), ("longas", "4A4T", "DI", None), ("tempora", "5A5b5c", "DI", None), ("vitas.", "6A6X", None, None)]


def test_caesura_classes(spark):
    rows = {
        "S": [("a", "1A1T", "DI", None), ("b", "2A2T3A", "CM", None), ("c", "3T", None, None)],
        "W": [("a", "2T3A3b", "CF", None), ("b", "3c", None, None)],
        "Q": [("a", "2T3A", None, "SY"), ("b", "3T", None, None)],
        "-": [("a", "2T3A3T", "DI", None)],
        None: [("a", "1A1T", "DI", None)],
    }
    df = frame(spark, [line(w, i) for i, w in enumerate(rows.values())])
    got = [r[0] for r in df.orderBy("line_idx").select(F.expr(M.caesura(3))).collect()]
    assert got == list(rows)
    assert df.where("line_idx = 2").select(F.expr(M.caesura(3, strict=True))).first()[0] == "-"


def test_line_predicates(spark):
    r = frame(spark, [line(H)]).select(*[F.expr(e).alias(n) for n, e in {"nucleus": M.caesurae(), "harmony": M.harmony(), "conf": M.ictus_conflicts(), "dia": M.diaereses(), "bd": M.bucolic_diaeresis(), "scan": M.raw_scansion(), "caps": M.capitals(), "fin": M.final_syllables(), "eli": M.elision_count()}.items()]).first()
    assert r.nucleus == "SS-" and r.dia == "FFTTT" and r.bd and r.caps == 1 and r.fin == 2.0 and r.eli == 0
    assert r.harmony == "HCCH" and r.conf == 2
    assert r.scan == "`1A1b `1c2A `2T3A 3T `4A4T `5A5b5c `6A6X"


def test_stress(spark):
    words = [("et", "1A1T", None, None), ("et,", "1A1T", None, None), ("adhuc", "1A1T", None, None), ("x", "", None, "SY"), ("multa", "1A1b1c", None, None), ("a", "1A1T2A", None, None), ("m", "1A", None, None), ("m", "1A", None, "SY"), ("abc", "1A1b1c", None, "SY")]
    got = frame(spark, [line(words)]).select(F.expr(M.raw_scansion())).first()[0].split(" ")
    assert got == ["1A1T", "`1A1T", "1A`1T", "_", "`1A1b1c", "1A`1T2A", "1A", "`1A", "`1A1b1c"]


def test_prodelision(spark):
    df = frame(spark, [line([("a", "1A1b1c", None, None), ("est", "", None, "PE")], 0), line([("est", "", None, "PE")], 1)])
    assert [r[0] for r in df.orderBy("line_idx").select(F.expr(M.final_syllables())).collect()] == [3.0, None]
    with pytest.raises(ValueError):
        M.diaeresis(6)


def test_clean_matches_greedy(spark):
    rng = random.Random(5)
    rows, want = [], []
    for book in range(60):
        metres = [rng.choice("HP") for _ in range(rng.randint(1, 12))]
        rows += [line(H, i, book, m) for i, m in enumerate(metres)]
        if "P" not in metres:
            want += [(book, i) for i in range(len(metres))]
            continue
        for i, m in enumerate(metres):  # a hexameter that another follows goes; a pentameter without one before it goes
            if m == "H" and not (i + 1 < len(metres) and metres[i + 1] == "H") or m == "P" and i and metres[i - 1] == "H":
                want.append((book, i))
    rows += [line(H, 50, 0, pattern=p) for p in ("corrupt", "not scanned", None)]
    got = [tuple(r) for r in cleaning.clean(frame(spark, rows).drop("meter"), ["book_no"]).select("book_no", "line_idx").collect()]
    assert sorted(got) == sorted(want)


def test_legacy_repair(spark):
    codes = "1A1b1c2A2T3A3T4A4b4c5A5b5c6A6X"
    rows = [line([("a", codes, None, None)], 0, metre="?", meter="E", pattern=""), line([("a", "1A1T2A2T3A4A4b4c5A5b5c6X", None, None)], 1, metre="?", pattern="x")]
    got = cleaning.clean(frame(spark, rows), ["book_no"]).orderBy("line_idx").select("metre", "pattern").collect()
    assert [tuple(r) for r in got] == [("H", "DSSD"), ("P", "SS-|DD-")]


def test_chunks_drop_the_short_tail(spark):
    feats = features.distribution(frame(spark, [line(H, i) for i in range(7)]), keys=["work", "line_idx"])
    got = features.chunk_means(feats, 3, ["work"], "line_idx").collect()
    assert len(got) == 2 and all(0 <= r["1CF"] <= 1 for r in got)


def test_search(spark):
    df = frame(spark, [line(H, 0, 1), line(H, 0, 2), line([("nil", "1A", None, None)], 1, 2)])
    assert search.grep(df, "SILV").count() == 2
    assert search.grep(df.drop("book_no"), "silv", distinct_text=True).count() == 1
    assert {r["ref"] for r in df.select(search.bookref().alias("ref")).collect()} == {" 1:1  ", " 2:1  ", " 2:2  "}
    with pytest.raises(ValueError):
        search.chunk_lines(df, 2, 3, ["book_no"])


def test_empty(spark):
    df = frame(spark, [])
    assert cleaning.clean(df, ["book_no"]).count() == 0
    assert features.distribution(df, keys=["work"]).count() == 0
