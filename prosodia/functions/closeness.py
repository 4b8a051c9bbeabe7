"""The rules of functions.rhyme over plain values, and counts of rhyming pairs by the parts that words consist of.

A word is (n, np, s, f) as there, a syllable (onset, nucleus, coda, vowel). Words share few parts: pairs of parts are scored once, and pairs of words
are looked up only where their endings are near enough to reach the threshold at all."""

from __future__ import annotations

import numpy as np

from .rhyme import CLOSE_CODA, CLOSE_ONSET, LIKENESS, MACRON, THRESHOLD, TILDE, VOWELS


def _bare(nucleus: str) -> str:
    return nucleus.replace(TILDE, "").replace(MACRON, "").lower()


def _close(table: dict[str, str], a: str, b: str) -> bool:
    return a in table and (b in table[a] or b in table and a in table[b])


def nucleus(a: tuple[str, str], b: tuple[str, str]) -> float:
    """a, b: nucleus and vowel."""
    (x, v), (y, w) = a, b
    if not x or not y or v not in LIKENESS or w not in VOWELS:
        return 0.0
    score, p, q = float(LIKENESS[v][VOWELS.index(w)]), _bare(x), _bare(y)
    if len(p) != len(q) or p != q and v == w:
        return score * 0.7
    return score * 0.9 if p == q and (TILDE in x) != (TILDE in y) else score


def coda(a: str, b: str, empty: float) -> float:
    if a == b:
        return 1.2 if a else empty
    close = _close(CLOSE_CODA, a[-1:].lower() or "-", b[-1:].lower() or "-")
    if len(a) + len(b) > 2:
        return 0.95 if "s" in a.lower() and "s" in b.lower() else 0.9 if close else 0.8
    return 0.95 if close else 0.8


def onset(a: str, b: str) -> float:
    if a == b:
        return 1.1
    close = _close(CLOSE_ONSET, a[:1].lower() or "-", b[:1].lower() or "-")
    if len(a) + len(b) > 2:
        return 0.95 if close else 0.85
    return 1.0 if close else 0.85


def word(a: tuple | None, b: tuple | None) -> float:
    """The score of two words."""
    if not a or not b or not a[0] or not b[0]:
        return 0.0
    (n, after, s, f), (m, later, t, g) = a, b
    final = min(nucleus((f[1], f[3]), (g[1], g[3])) * onset(f[0], g[0]) * coda(f[2], g[2], 1.1), 1.0)
    if n == 1 and m == 1:
        return 2 * final
    ending = 0.0
    if after and later:
        ending = final * (1.3 if final >= 0.75 else 1.0)
        if after + later == 3:
            longer = f if after > later else g
            ending *= 0.73 if len(_bare(longer[1])) > 1 or longer[3] in ("i", "u", "ü") else 0.83
    return min(nucleus((s[1], s[3]), (t[1], t[3])) * coda(s[2], t[2], 1), 1.0) + ending


class Parts:
    """Words by the numbers of their parts."""

    def __init__(self, words: list[tuple], counts: np.ndarray):
        keep = [i for i, w in enumerate(words) if w[0] == 1 or w[1] > 0]  # no other can reach the threshold
        self.counts = counts[keep]
        ends, starts, of, self.first = {}, {}, [], []
        for i in keep:
            n, after, s, f = words[i]
            of.append(ends.setdefault((f, after, n == 1), len(ends)))
            self.first.append(starts.setdefault((s[1], s[3], s[2]), len(starts)))
        self.ends, self.starts = list(ends), list(starts)
        order = np.argsort(of, kind="stable")
        self.order, self.cuts = order, np.searchsorted(np.array(of)[order] if of else np.empty(0, int), np.arange(len(self.ends) + 1))
        self.first = np.array(self.first, np.int64)


def _table(xs: list, ys: list, score) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores of distinct values, number of each x's value, number of each y's)."""
    a, b = {}, {}
    i, j = np.array([a.setdefault(x, len(a)) for x in xs], np.int64), np.array([b.setdefault(y, len(b)) for y in ys], np.int64)
    return np.array([[score(x, y) for y in b] for x in a], float).reshape(len(a), len(b)), i, j


def _starts(x: Parts, y: Parts) -> np.ndarray:
    """Scores of the stressed syllables of x with those of y."""
    near, i, j = _table([s[:2] for s in x.starts], [s[:2] for s in y.starts], nucleus)
    close, p, q = _table([s[2] for s in x.starts], [s[2] for s in y.starts], lambda a, b: coda(a, b, 1))
    return np.minimum(near[i][:, j] * close[p][:, q], 1)


def hits(a: Parts, b: Parts, threshold: float = THRESHOLD, both: bool = False) -> int:
    """Pairs of a word of a and one of b, weighted by their counts, that reach the threshold; both: in either order."""
    if not len(a.counts) or not len(b.counts):
        return 0
    of = lambda p, k: [e[0][k] for e in p.ends]

    def ending(x: Parts, y: Parts) -> tuple:
        parts = [_table([(e[0][1], e[0][3]) for e in x.ends], [(e[0][1], e[0][3]) for e in y.ends], nucleus), _table(of(x, 0), of(y, 0), onset), _table(of(x, 2), of(y, 2), lambda p, q: coda(p, q, 1.1))]
        return parts, _starts(x, y)

    ways = [(*ending(a, b), False)] + ([(*ending(b, a), True)] if both else [])
    after, mono = (np.array([e[k] for e in b.ends]) for k in (1, 2))
    heavy = np.array([len(_bare(e[0][1])) > 1 or e[0][3] in ("i", "u", "ü") for e in b.ends])
    total = 0
    for i, (f, own_after, own_mono) in enumerate(a.ends):
        found, own_heavy = [], len(_bare(f[1])) > 1 or f[3] in ("i", "u", "ü")
        for parts, _, turned in ways:
            final = np.ones(len(b.ends))
            for score, x, y in parts:
                final = final * (score[x, y[i]] if turned else score[x[i], y])
            final = np.minimum(final, 1)
            end = final * np.where(final >= 0.75, 1.3, 1.0)
            three = own_after + after == 3
            longer = np.where(own_after > after, own_heavy, heavy)
            end = np.where((own_after > 0) & (after > 0), end * np.where(three, np.where(longer, 0.73, 0.83), 1.0), 0.0)
            found.append((end, np.where(own_mono & mono, 2 * final, 0.0)))
        near = np.flatnonzero(np.any([(end >= threshold - 1) | (alone >= threshold) for end, alone in found], axis=0))
        if not len(near):
            continue
        rows = np.concatenate([b.order[b.cuts[j] : b.cuts[j + 1]] for j in near])
        j = np.repeat(near, b.cuts[near + 1] - b.cuts[near])
        for w in a.order[a.cuts[i] : a.cuts[i + 1]]:
            hit = np.zeros(len(rows), bool)
            for (_, starts, turned), (end, alone) in zip(ways, found, strict=True):
                start = starts[b.first[rows], a.first[w]] if turned else starts[a.first[w], b.first[rows]]
                hit |= np.where(own_mono & mono[j], alone[j], start + end[j]) >= threshold
            total += int(a.counts[w]) * int(b.counts[rows[hit]].sum())
    return total
