"""The scores of functions.rhyme over columns of words: what closeness.word gives, for many pairs at once, with the same products in the same order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .closeness import _bare, _close
from .rhyme import CLOSE_CODA, CLOSE_ONSET, LIKENESS, TILDE, VOWELS

#: Letters that may be close; the place after them is of all others.
LETTERS = "-abcdefghijklmnopqrstuvwxyz"
_NEAR = {k: np.array([[_close(t, a, b) for b in LETTERS + "?"] for a in LETTERS + "?"]) for k, t in (("coda", CLOSE_CODA), ("onset", CLOSE_ONSET))}
_VOWELS = np.full((len(VOWELS) + 1, len(VOWELS) + 1), np.nan)
_VOWELS[:-1, :-1] = [LIKENESS[v] for v in VOWELS]


def _letter(x: str) -> int:
    return LETTERS.find(x or "-") if len(x) < 2 else -1


class Syllables:
    """Onsets, nuclei and codas of a column of syllables, as numbers."""

    def __init__(self, column: pa.Array):
        text = lambda f: pc.struct_field(column, f).dictionary_encode(null_encoding="encode")
        self.parts = {}
        for f, edge in (("onset", 0), ("coda", -1)):
            d = text(f)
            kinds = [x or "" for x in d.dictionary.to_pylist()]
            at = d.indices.to_numpy(zero_copy_only=False)
            of = lambda xs, t, at=at: np.array(xs, t)[at] if len(at) else np.empty(0, t)
            self.parts[f] = at, of([len(x) for x in kinds], np.int64), of(["s" in x.lower() for x in kinds], bool), of([_letter((x[:1] if edge == 0 else x[-1:]).lower()) for x in kinds], np.int64)
        nucleus, vowel = text("nucleus"), text("vowel")
        kinds, at = [x or "" for x in nucleus.dictionary.to_pylist()], nucleus.indices.to_numpy(zero_copy_only=False)
        plain = [_bare(x) for x in kinds]
        number = pd.factorize(np.array(plain, object))[0] if plain else np.empty(0, np.int64)
        self.vowel = vowel.indices.to_numpy(zero_copy_only=False)
        vowels = [VOWELS.find(x) if x is not None else -1 for x in vowel.dictionary.to_pylist()]
        long = np.array([len(x) > 1 for x in plain] or [False])
        high = np.array([x in ("i", "u", "ü") for x in vowel.dictionary.to_pylist()] or [False])
        self.place, self.heavy = np.array(vowels or [-1])[self.vowel], long[at] | high[self.vowel]
        self.there, self.plain, self.size = np.array([bool(x) for x in kinds] or [False])[at], number[at], np.array([len(x) for x in plain] or [0])[at]
        self.nasal = np.array([TILDE in x for x in kinds] or [False])[at]

    def nucleus(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = self.plain[a] == self.plain[b]
        factor = np.where((self.size[a] != self.size[b]) | (~same & (self.vowel[a] == self.vowel[b])), 0.7, np.where(same & (self.nasal[a] != self.nasal[b]), 0.9, 1.0))
        return np.where(self.there[a] & self.there[b], _VOWELS[self.place[a], self.place[b]] * factor, 0.0)

    def coda(self, a: np.ndarray, b: np.ndarray, empty: float) -> np.ndarray:
        kind, size, sibilant, edge = self.parts["coda"]
        near = _NEAR["coda"][edge[a], edge[b]]
        other = np.where(size[a] + size[b] > 2, np.where(sibilant[a] & sibilant[b], 0.95, np.where(near, 0.9, 0.8)), np.where(near, 0.95, 0.8))
        return np.where(kind[a] == kind[b], np.where(size[a] > 0, 1.2, empty), other)

    def onset(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        kind, size, _, edge = self.parts["onset"]
        near = _NEAR["onset"][edge[a], edge[b]]
        return np.where(kind[a] == kind[b], 1.1, np.where(size[a] + size[b] > 2, np.where(near, 0.95, 0.85), np.where(near, 1.0, 0.85)))


class Words:
    """A column of words, for scores of pairs of its places."""

    def __init__(self, column: pa.Array):
        self.there = column.is_valid().to_numpy(zero_copy_only=False)
        number = lambda f: pc.fill_null(pc.struct_field(column, f), 0).to_numpy(zero_copy_only=False)
        self.n, self.after = number("n"), number("np")
        self.stressed, self.final = Syllables(pc.struct_field(column, "s")), Syllables(pc.struct_field(column, "f"))
        #: Words that score above nothing.
        self.sound = self.there & (self.n != 0)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Scores of words at places a with those at b; 0 for a place below 0."""
        out = np.zeros(len(a))
        at = np.flatnonzero((a >= 0) & (b >= 0))
        at = at[self.sound[a[at]] & self.sound[b[at]]]
        a, b = a[at], b[at]
        f, s = self.final, self.stressed
        final = np.fmin(f.nucleus(a, b) * f.onset(a, b) * f.coda(a, b, 1.1), 1)
        p, q = self.after[a], self.after[b]
        temper = np.where(p + q == 3, np.where(np.where(p > q, f.heavy[a], f.heavy[b]), 0.73, 0.83), 1.0)
        ending = np.where((p > 0) & (q > 0), final * np.where(final >= 0.75, 1.3, 1.0) * temper, 0.0)
        out[at] = np.where((self.n[a] == 1) & (self.n[b] == 1), final * 2, np.fmin(s.nucleus(a, b) * s.coda(a, b, 1), 1) + ending)
        return out
