"""Metrical predicates of a line as SQL expressions.

A line's words are `words: array<struct<idx, text, sy, wb, mf>>`; sy is a run of two-letter syllable codes (foot, position). Predicates of
a word are written over a prefix `w` (a lambda's variable here, a table's alias in SQL checks); predicates of a line go through the words
with higher-order functions, so a line needs no shuffle. Where no word answers, the result is null; lines are to
be cleaned first.
"""

from __future__ import annotations

#: Words that carry no accent, and words accented on their last syllable.
UNACCENTED = ("at", "ac", "atque", "et", "sed", "igitur", "vel", "aut", "iam", "seu", "nam")
ACCENT_LAST = ("nostras", "illic", "adhuc", "tanton", "adduc")


def _in(x: str, values: tuple[str, ...]) -> str:
    return f"{x} in ({', '.join(repr(v) for v in values)})"


def elided(w: str = "w") -> str:
    return f"coalesce({w}.mf = 'SY', false)"


def caesura_code(n: int, strict: bool = False, w: str = "w") -> str:
    """What a word says about the caesura of foot n: S, W, Q or -, or null to go on to the next word."""
    ends = f"({w}.sy like '%{n}A' or {w}.sy like '%{n}b')"
    return f"""case when {w}.sy like '%{n}A' and {w}.wb is not null then 'S' when {w}.sy like '%{n}b' and {w}.wb is not null then 'W'
 when {ends} and {elided(w)} then '{'-' if strict else 'Q'}' when contains({w}.sy, '{n}T') or contains({w}.sy, '{n}c') then '-' when contains({w}.sy, '{n + 1}') then '-' end"""


def first(code: str) -> str:
    """The first non-null answer of the words."""
    return f"get(filter(transform(words, w -> {code}), x -> x is not null), 0)"


def caesura(n: int, strict: bool = False) -> str:
    return first(caesura_code(n, strict))


def caesurae(start: int = 2, end: int = 4, strict: bool = False) -> str:
    return f"concat({', '.join(caesura(n, strict) for n in range(start, end + 1))})"


def third_foot_caesura(strict: bool = True) -> str:
    return f"({caesura(3, strict)} <> '-')"


def elision_code(n: int, w: str = "w") -> str:
    return f"case when contains({w}.sy, '{n}T') or contains({w}.sy, '{n}c') then {elided(w)} end"


def elision_after_foot(n: int) -> str:
    return f"coalesce({first(elision_code(n))}, false)"


def diaeresis_word(n: int, w: str = "w") -> str:
    return f"(({w}.sy like '%{n}c' or {w}.sy like '%{n}T') and coalesce({w}.wb = 'DI', false))"


def diaeresis(n: int) -> str:
    if not 1 <= n <= 5:
        raise ValueError(f"no diaeresis after foot {n}")
    return f"exists(words, w -> {diaeresis_word(n)})"


def diaereses(start: int = 1, end: int = 5) -> str:
    return f"concat({', '.join(f'if({diaeresis(n)}, {chr(39)}T{chr(39)}, {chr(39)}F{chr(39)})' for n in range(start, end + 1))})"


def bucolic_diaeresis() -> str:
    return diaeresis(4)


def stress_back(w: str = "w") -> str:
    """How many codes before the end of sy the stressed one starts (1: the last); null without codes."""
    n = f"(length({w}.sy) // 2)" if w != "w" else f"(length({w}.sy) div 2)"
    return f"""case when length({w}.sy) = 0 then null when {_in(f'lower({w}.text)', ACCENT_LAST)} then 1 when {elided(w)} and {_in(f'right({w}.sy, 1)', ('A', 'T', 'X'))} then 1
 when {n} <= 2 then {n} when {_in(f'substr({w}.sy, length({w}.sy) - 2, 1)', ('A', 'T', 'X'))} then 2 else 3 end"""


def stress_code(w: str = "w") -> str:
    return f"substr({w}.sy, cast(length({w}.sy) - 2 * ({stress_back(w)}) + 1 as int), 2)"


def word_scansion(w: str = "w") -> str:
    """sy with a grave before the stressed code; _ for a word without codes."""
    at = f"cast(length({w}.sy) - 2 * ({stress_back(w)}) as int)"
    return f"""case when {w}.sy = '' then '_' when length({w}.sy) <= 2 and not {elided(w)} then {w}.sy when {_in(f'lower({w}.text)', UNACCENTED)} then {w}.sy
 else concat(substr({w}.sy, 1, {at}), '`', substr({w}.sy, {at} + 1)) end"""


def raw_scansion() -> str:
    return f"array_join(transform(words, w -> {word_scansion()}), ' ')"


def conflict_code(n: int, w: str = "w") -> str:
    """Whether the first word with the arsis of foot n is stressed elsewhere; null for words without it."""
    return f"case when contains({w}.sy, '{n}A') then {_in(f'lower({w}.text)', UNACCENTED)} or {stress_code(w)} <> '{n}A' end"


def conflict(n: int) -> str:
    return first(conflict_code(n))


def ictus_conflicts() -> str:
    return "(" + " + ".join(f"cast({conflict(n)} as int)" for n in range(1, 7)) + ")"


def harmony(feet: int = 4) -> str:
    return f"concat({', '.join(f'if({conflict(n)}, {chr(39)}C{chr(39)}, {chr(39)}H{chr(39)})' for n in range(1, feet + 1))})"


def elision_count() -> str:
    return f"size(filter(words, w -> {elided()}))"


def capitals() -> str:
    """Words whose first character is upper case."""
    return "size(filter(words, w -> substr(w.text, 1, 1) <> lower(substr(w.text, 1, 1))))"


def final_syllables() -> str:
    """Syllables of the last word; a prodelided last word without codes leans on the word before it. Null where the text's
    marking allows neither."""
    return "case when get(words, size(words) - 1).sy <> '' then length(get(words, size(words) - 1).sy) / 2.0 when get(words, size(words) - 1).mf = 'PE' and size(words) > 1 then length(get(words, size(words) - 2).sy) / 2.0 end"


def fourth_foot_code(w: str = "w") -> str:
    """The kind of the fourth foot's first break: its first matching word ending."""
    return f"case when {w}.sy like '%4A' then 'A' when {w}.sy like '%4b' then 'b' when {w}.sy like '%4c' then 'c' when contains({w}.sy, '4T') then 'T' end"


#: The feet that the features of each metre look at.
FEET = {"H": (1, 2, 3, 4), "P": (1, 2, 4, 5)}
FEATURES = [f"{n}{kind}" for kind in ("SP", "CF", "DI", "SC", "WC") for n in (1, 2, 3, 4)]


def feature(name: str) -> str:
    """One of FEATURES as 0 or 1: spondee, conflict, diaeresis, strong and weak caesura of a metre's n-th foot."""
    n, kind = int(name[0]), name[1:]

    def of(metre: str) -> str:
        foot = FEET[metre][n - 1]
        if kind == "SP":
            return f"substr(regexp_replace(pattern, '[^DS]', ''), {n}, 1) = 'S'"
        return {"CF": conflict(foot), "DI": diaeresis(foot), "SC": f"{caesura(foot)} = 'S'", "WC": f"{caesura(foot)} = 'W'"}[kind]

    return f"cast(coalesce(case metre when 'H' then {of('H')} when 'P' then {of('P')} end, false) as int)"


def build_pattern() -> str:
    """A line's pattern from its codes: D or S by the number of codes of each foot; pentameters have one code of foot 3."""
    sy = "array_join(transform(words, w -> w.sy), '')"
    codes = lambda n: f"(length({sy}) - length(replace({sy}, '{n}', '')))"
    foot = lambda n: f"case {codes(n)} when 2 then 'S' when 3 then 'D' end"
    return f"if({codes(3)} = 1, concat({foot(1)}, {foot(2)}, '-|', {foot(4)}, {foot(5)}, '-'), concat({', '.join(foot(n) for n in (1, 2, 3, 4))}))"


def repaired_metre() -> str:
    sy = "array_join(transform(words, w -> w.sy), '')"
    return f"case when contains({sy}, '6A6X') or contains({sy}, '6A6T7') then 'H' when not contains({sy}, '6A') then 'P' end"


def word_syllables(idx: int) -> str:
    """Syllables of word `idx` (from the end if below 0): an empty prodelided word answers with the one before it, an empty elided one with the next; null
    where there is none."""
    at = str(idx) if idx >= 0 else f"size(words) - {-idx}"
    before = f"filter(slice(words, 1, {at}), x -> x.sy <> '')"
    after = f"get(filter(slice(words, {at} + 2, size(words)), x -> x.sy <> ''), 0)"
    own = f"get(words, {at})"
    left = f"get({before}, size({before}) - 1)"
    return f"""case when {own}.sy <> '' then length({own}.sy) / 2 when {own}.mf = 'PE' and {at} > 0 then length({left}.sy) / 2
 when {own}.mf = 'SY' and {at} < size(words) - 1 then length({after}.sy) / 2 end"""
