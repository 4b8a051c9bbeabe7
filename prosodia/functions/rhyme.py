"""Rhyme scores of two words as SQL expressions that Spark and other engines share.

A syllable is a struct of onset, nucleus, coda and vowel (its last vowel, ü for y); a word is a struct of n (syllables), np
(syllables after the stressed one), s (the stressed syllable) and f (the last). A missing word scores 0.
"""

from __future__ import annotations

import re

TILDE, MACRON = "̃", "̄"
THRESHOLD = 1.75
#: Likeness of vowels, by pairs.
VOWELS = "ieaouü"
LIKENESS = {
    "i": (1, 0.75, 0.5, 0.42, 0.4, 0.5),
    "e": (0.75, 1, 0.6, 0.5, 0.42, 0.5),
    "a": (0.5, 0.6, 1, 0.6, 0.42, 0.4),
    "o": (0.42, 0.5, 0.6, 1, 0.75, 0.35),
    "u": (0.4, 0.42, 0.42, 0.75, 1, 0.6),
    "ü": (0.5, 0.5, 0.4, 0.35, 0.6, 1),
}
#: Consonants that are close in a stressed or final coda and in a final onset; - stands for none.
CLOSE_CODA = {
    "-": "sfzhktp", "b": "ktpgdb", "k": "ktpgdb", "d": "ktpgdb", "f": "sfzh", "g": "ktpgdb", "h": "ktpgdb", "j": "jwlr", "l": "nmlr", "m": "nmlr",
    "n": "nmlr", "p": "ktpgdb", "r": "nmlr", "s": "sfzhkt", "t": "tdszk", "w": "w", "x": "x",
}
CLOSE_ONSET = {
    "b": "ktpgdb", "k": "gk", "d": "dt", "f": "sfzh", "g": "gk", "h": "sfzh", "j": "jwlr", "l": "r", "m": "nm", "n": "nm", "p": "tpdb", "r": "l", "s": "sfzht",
    "t": "sfzhkdr", "w": "jwlr", "x": "x", "-": "-",
}


def d(x: float) -> str:
    """A double literal in any dialect."""
    return f"{float(x)!r}e0"


def _close(table: dict[str, str], a: str, b: str) -> str:
    """Whether two letters are close; a letter that is no key of the table answers for itself only as the second of a pair."""
    pairs = [x + y for x in table for y in {*"-zabcdefghijklmnopqrstuvwxy"} if y in table[x] or y in table and x in table[y]]
    return f"concat({a}, {b}) in ({', '.join(repr(p) for p in sorted(pairs))})"


def _edge(x: str, last: bool) -> str:
    return f"coalesce(nullif(lower({'right' if last else 'left'}({x}, 1)), ''), '-')"


def plain(nucleus: str) -> str:
    return f"lower(translate({nucleus}, '{TILDE}{MACRON}', ''))"


def _at(values: list[float], place: str, spark: bool) -> str:
    """A number of a list by its place, from 1; null where there is none."""
    listed = ", ".join(map(d, values))
    return f"get(array({listed}), cast({place} - 1 as int))" if spark else f"([{listed}])[({place})::bigint]"


def nucleus_score(a: str, b: str, spark: bool = True) -> str:
    place = f"6 * (nullif(instr('{VOWELS}', {a}.vowel), 0) - 1) + nullif(instr('{VOWELS}', {b}.vowel), 0)"
    p, q = plain(f"{a}.nucleus"), plain(f"{b}.nucleus")
    nasal = f"(contains({a}.nucleus, '{TILDE}') <> contains({b}.nucleus, '{TILDE}'))"
    return f"""(case when {a}.nucleus = '' or {b}.nucleus = '' then {d(0)} else {_at([v for x in VOWELS for v in LIKENESS[x]], place, spark)} *
 case when length({p}) <> length({q}) then {d(0.7)} when {p} <> {q} and {a}.vowel = {b}.vowel then {d(0.7)} when {p} = {q} and {nasal} then {d(0.9)} else {d(1)} end end)"""


def _coda(a: str, b: str, empty: float) -> str:
    close = _close(CLOSE_CODA, _edge(f"{a}.coda", True), _edge(f"{b}.coda", True))
    return f"""case when {a}.coda = {b}.coda then case when {a}.coda <> '' then {d(1.2)} else {d(empty)} end
 when length({a}.coda) + length({b}.coda) > 2 then case when contains(lower({a}.coda), 's') and contains(lower({b}.coda), 's') then {d(0.95)} when {close} then {d(0.9)} else {d(0.8)} end
 when {close} then {d(0.95)} else {d(0.8)} end"""


def stressed_score(a: str, b: str, spark: bool = True) -> str:
    return f"least({nucleus_score(a, b, spark)} * ({_coda(a, b, 1)}), {d(1)})"


def final_score(a: str, b: str, spark: bool = True) -> str:
    close = _close(CLOSE_ONSET, _edge(f"{a}.onset", False), _edge(f"{b}.onset", False))
    onset = f"case when {a}.onset = {b}.onset then {d(1.1)} when length({a}.onset) + length({b}.onset) > 2 then case when {close} then {d(0.95)} else {d(0.85)} end when {close} then {d(1)} else {d(0.85)} end"
    return f"least({nucleus_score(a, b, spark)} * ({onset}) * ({_coda(a, b, 1.1)}), {d(1)})"


def word_score(a: str, b: str, spark: bool = False, final: str | None = None) -> str:
    """0 to 2.3. Where one word has one syllable after the stress and the other two, the last syllable of the longer tempers the ending.
    final: a column that holds the score of the last syllables, so that it is worked out once."""
    fa, fb = f"{a}.f", f"{b}.f"
    final = final or final_score(fa, fb, spark)
    longer = lambda field: f"(case when {a}.np > {b}.np then {fa}.{field} else {fb}.{field} end)"
    temper = f"case when {a}.np + {b}.np = 3 then case when length({plain(longer('nucleus'))}) > 1 or {longer('vowel')} in ('i', 'u', 'ü') then {d(0.73)} else {d(0.83)} end else {d(1)} end"
    ending = f"(case when {a}.np > 0 and {b}.np > 0 then {final} * case when {final} >= {d(0.75)} then {d(1.3)} else {d(1)} end * {temper} else {d(0)} end)"
    return f"case when {a} is null or {b} is null or {a}.n = 0 or {b}.n = 0 then {d(0)} when {a}.n = 1 and {b}.n = 1 then {final} * 2 else {stressed_score(f'{a}.s', f'{b}.s', spark)} + {ending} end"


def toy_word(text: str, spark: bool = True) -> str:
    """A word of a plain token, by its vowel groups, for tables without phonology: the first syllable counts as stressed."""
    t = f"regexp_replace(lower({text}), '[^a-z]', ''{'' if spark else ', ' + repr('g')})"
    count = f"{'size' if spark else 'len'}(regexp_extract_all({t}, '([aeiouy]+)', 1))"
    vowel = lambda x: f"replace(right({x}, 1), 'y', 'ü')"
    pack = (lambda **k: "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in k.items()) + ")") if spark else (lambda **k: "struct_pack(" + ", ".join(f"{n} := {v}" for n, v in k.items()) + ")")
    first, last = f"regexp_extract({t}, '([aeiouy]+)', 1)", f"regexp_extract({t}, '([aeiouy]+)[^aeiouy]*$', 1)"
    coda = f"case when {count} > 1 then regexp_extract({t}, '[aeiouy]+([^aeiouy])[^aeiouy]+[aeiouy]', 1) else regexp_extract({t}, '([^aeiouy]*)$', 1) end"
    s = pack(onset=f"regexp_extract({t}, '^([^aeiouy]*)', 1)", nucleus=first, coda=coda, vowel=vowel(first))
    f = pack(onset=f"regexp_extract({t}, '([^aeiouy]*)[aeiouy]+[^aeiouy]*$', 1)", nucleus=last, coda=f"regexp_extract({t}, '([^aeiouy]*)$', 1)", vowel=vowel(last))
    return pack(n=f"cast({count} as int)", np=f"cast(greatest(least({count} - 1, 2), 0) as int)", s=s, f=f)


_TOY = {k: re.compile(v) for k, v in (("not", "[^a-z]"), ("vowels", "[aeiouy]+"), ("last", "([^aeiouy]*)([aeiouy]+)([^aeiouy]*)$"), ("inner", "[aeiouy]+([^aeiouy])[^aeiouy]+[aeiouy]"), ("front", "^[^aeiouy]*"))}


def toy(text: str) -> dict:
    """toy_word of one token."""
    t = _TOY["not"].sub("", text.lower())
    groups, end = _TOY["vowels"].findall(t), _TOY["last"].search(t)
    onset, nucleus, coda = end.groups() if end else ("", "", t)
    inner = _TOY["inner"].search(t)
    first, n = groups[0] if groups else "", len(groups)
    syllable = lambda o, v, c: {"onset": o, "nucleus": v, "coda": c, "vowel": v[-1:].replace("y", "ü")}
    stressed = syllable(_TOY["front"].match(t)[0], first, (inner[1] if inner else "") if n > 1 else coda)
    return {"n": n, "np": max(min(n - 1, 2), 0), "s": stressed, "f": syllable(onset, nucleus, coda)}
