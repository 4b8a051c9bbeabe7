"""Online logistic mixing of hashed contexts over the tokens of one page (see context_mixing).

A token is a path of yes/no decisions. First, if what stands before it was seen (three words, or else two): is it the word that followed
there most often. If not, whether its word has a code; then down the prefix code of words, or, where it has none, byte by byte down a prefix
code of bytes, closed by a space. Each decision is predicted under several contexts: the first by how often the guess followed the
three words and the two; those of the code by the word before, the kinds of the two words before, and the code's own frequencies; those of
spelled bytes by the word so far, that after the word before, and the last two, three and four bytes with the kind of the word before. A context and the
place in the code are hashed to a slot that holds how often either answer was seen; near places of a code lie in one line of slots.

Learning goes once over the page's training items in the order of the hashes of the word before and of their own, in slices. The tables take a slice in; every
decision of it is predicted as if its own occurrence had not been counted (so are the guesses); the weights, one set for each gate (how well the
contexts are known, and the kind of decision), and the table that refines the sum take steps on the errors (online Newton
steps: the gradient over the curvature summed up so far). A guess that holds ends the path, so the tables below count what longer contexts did not foresee.
"""

from __future__ import annotations

import heapq
import math
from array import array

import numpy as np

STEPS, GATES = 33, 32
#: Items in a step, and what holds weights to where they start.
SLICE, RIDGE = 8_000, 200.0
#: Decisions whose slots are read at once, so that what is made of them stays in a core's cache.
NEAR = 1 << 14
#: Bytes by falling frequency in European prose; the rest are rarer still.
FREQUENT = b" etanirsoldhucmpgvfbzkqwyxj\xc3,.'-"
#: Where the nodes of the code of words begin, and the question whether a word has a code: the last place of the first group of nodes (see prefix_code), which is free.
FIRST_WORD = 256
ASK = FIRST_WORD + 7
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_STEP, _BACK = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, -1, 2**64))
_LEVELS = np.array([0, 1, 1, *[2] * 28, 3], np.int64)


def prefix_code(weights: list[float], node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a prefix code for things of these weights: each one's first place, its length; node (numbered from `node`) and bit by
    place; and the log-odds of bit 1 by node, from `node` on. Nodes go in groups of eight numbers: one, its two followers and their four (the last number is free),
    so that what is known of them under one context can lie together."""
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    n = len(weights)
    above, side = array("q", [-1]) * max(2 * n - 1, 0), array("B", [0]) * max(2 * n - 1, 0)
    odds = array("f")
    for k in range(n, 2 * n - 1):
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a] = above[b] = k
        side[b] = 1
        odds.append(math.log((wb + 0.25) / (wa + 0.25)))
        heapq.heappush(heap, (wa + wb, k))
    # a node's number is that of its group and its place there, as in a heap; those made last stand above
    number, groups = [0] * max(n - 1, 0), 1
    for k in range(2 * n - 3, n - 1, -1):
        up = number[above[k] - n]
        if up & 7 < 3:
            number[k - n] = (up & ~7) + 2 * (up & 7) + 1 + side[k]
        else:
            number[k - n], groups = 8 * groups, groups + 1
    by_node = np.zeros(8 * groups, np.float32)
    by_node[number] = odds
    first, length, nodes, bits = array("q"), array("q"), array("I"), array("B")
    for i in range(n):
        path, at = [], i
        while above[at] >= 0:
            path.append(at)
            at = above[at]
        first.append(len(nodes))
        length.append(len(path))
        nodes.extend(node + number[above[at] - n] for at in reversed(path))
        bits.extend(side[at] for at in reversed(path))
    return np.array(first, np.int64), np.array(length, np.int64), np.array(nodes, np.uint32), np.array(bits, np.uint8), by_node


def byte_weights() -> list[float]:
    weight = [1.0 + (30.0 if 0x80 <= b < 0xC0 else 5.0 if 33 <= b < 65 else 0.0) for b in range(256)]
    for r, b in enumerate(FREQUENT):
        weight[b] = 4000.0 / (r + 2)
    return weight


_BYTES = prefix_code(byte_weights(), 0)


def spread(code: tuple, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in `of`, node, bit) of the paths of things `of`."""
    first, length, nodes, bits = code[:4]
    n = length.take(of)
    item = np.repeat(np.arange(len(of)), n)
    at = (first.take(of) + n - np.cumsum(n)).take(item)
    at += np.arange(len(item))
    return item, nodes.take(at), bits.take(at)


def mixed(h: np.ndarray) -> np.ndarray:
    v = (h ^ (h >> np.uint64(32))) * _M1
    return v ^ (v >> np.uint64(29))


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct key, in the order of keys; number among these by place)."""
    order = np.argsort(key)
    new = np.empty(len(key), bool)
    new[:1] = True
    sorted_ = key.take(order)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    del sorted_
    number = np.empty(len(key), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], number


def level(n: np.ndarray) -> np.ndarray:
    """How well a context is known: 0 unseen, 1 once or twice, 2 up to 30 times, 3 more often."""
    return _LEVELS[np.minimum(n, 31)]


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    quarter = np.float32(0.25)
    return np.log((n1.astype(np.float32) + quarter) / (n0.astype(np.float32) + quarter))


class Mixer:
    """Tables of hashed contexts, gated weights and the table that refines, for one family of decisions."""

    def __init__(self, sizes: list[int], start: list[float]):
        """sizes: log2 of the slots of each table; start: weights before learning of the tables, then of given inputs."""
        self.counts = [np.zeros((1 << s, 2), np.float32) for s in sizes]  # of either answer; whole numbers
        self.sizes, n = sizes, len(start) + 1
        self.weights = np.repeat(np.array([*start, 0.0])[:, None], GATES, axis=1)
        self.curve = np.tile(RIDGE * np.eye(n), (GATES, 1, 1))
        self.seen = np.zeros((GATES * STEPS, 2))
        self.told = self.refining()

    def slots(self, hashes: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
        """Slots of contexts at places `node` of a code; the hashes are overwritten."""
        # a group of nodes has eight slots in a row: one line of a core's cache
        step, place = (node >> np.uint32(3)).astype(np.uint64) * _M1, (node & np.uint32(7)).astype(np.uint64)
        for h, size in zip(hashes, self.sizes, strict=True):
            h += step
            h *= _M2
            h >>= np.uint64(64 - size)
            h ^= place
        return [h.view(np.int64) for h in hashes]

    def _sum(self, slots: list[np.ndarray], given: list[np.ndarray], one: np.ndarray, gate: np.ndarray, own: int) -> tuple:
        """(inputs, order, cuts, sums, answers' signs, places in the refining table), in the order of gates, which the cuts part; inputs and sums are
        for the answer that came, `own` counts of it left out. The first and last table's levels are added to the gate."""
        came = one.astype(np.float32)
        sign = came * np.float32(2) - np.float32(1)
        x = np.empty((len(self.weights), len(sign)), np.float32)
        k = len(slots)
        gate = gate.copy()
        tables = [t.view(np.complex64).ravel() for t in self.counts]
        for lo in range(0, len(sign), NEAR):
            at = slice(lo, lo + NEAR)
            mine = came[at] * np.float32(-own) + np.float32(0.25)
            other = np.float32(0.5 - own) - mine
            for c, (table, slot) in enumerate(zip(tables, slots, strict=True)):
                pair, to = table.take(slot[at]), x[c, at]
                n0, n1 = pair.real + other, pair.imag + mine
                np.divide(n1, n0, out=to)
                np.log(to, out=to)
                to *= sign[at]
                if c in (0, k - 1):
                    n0 += n1
                    known = (n0 > 1).view(np.uint8) + (n0 > 3).view(np.uint8) + (n0 > 31).view(np.uint8)
                    gate[at] += known if c == 0 else known << 2
        for c, v in enumerate(given):
            x[k + c] = v * sign
        x[-1] = sign
        # by gate, so that each gate's weights are met in one product
        order = np.argsort(gate, kind="stable")
        cuts = np.searchsorted(gate.take(order), np.arange(GATES + 1, dtype=np.uint8))
        x, sign, weights = x.take(order, axis=1), sign.take(order), self.weights.astype(np.float32)
        z, base = np.empty(len(sign), np.float32), np.empty(len(sign), np.int64)
        for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                np.dot(weights[:, g], x[:, a:b], out=z[a:b])
                base[a:b] = g * STEPS + 16
        np.clip(z, -14, 14, out=z)
        base += np.clip(np.rint(z * sign * np.float32(2)), -16, 16).astype(np.int64)
        return x, order, cuts, z, sign, base

    def _cost(self, z: np.ndarray, sign: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.log1p(np.exp((z + sign * self.told[place]) * np.float32(-0.5)))

    def learn(self, slots: list[np.ndarray], given: list[np.ndarray], one: np.ndarray, gate: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Learn from decisions seen w times; the cost of each (in nats) before its own occurrence. `given` leave theirs out already."""
        add, bit = w.astype(np.float32), one.astype(np.int64)
        for table, slot in zip(self.counts, slots, strict=True):
            np.add.at(table.ravel(), (slot << 1) + bit, add)
        x, order, cuts, z, sign, place = self._sum(slots, given, one, gate, 1)
        cost = np.empty_like(z)
        cost[order] = self._cost(z, sign, place)
        miss = 1 / (1 + np.exp(z))
        w = w.take(order)
        error = w.astype(np.float32) * miss
        curve = error * (1 - miss)
        pull = np.zeros((GATES, len(x)))
        for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                v = x[:, a:b]
                self.curve[g] += (v * curve[a:b]) @ v.T
                pull[g] = v @ error[a:b]
        self.weights += np.clip(np.linalg.solve(self.curve, pull[:, :, None])[:, :, 0], -0.2, 0.2).T
        self.seen += np.bincount(2 * place + (sign > 0), w, 2 * GATES * STEPS).reshape(-1, 2)
        self.told = self.refining()
        return cost

    def cost(self, slots: list[np.ndarray], given: list[np.ndarray], one: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Cost of decisions (in nats) by all that was learnt."""
        _, order, _, z, sign, place = self._sum(slots, given, one, gate, 0)
        cost = np.empty_like(z)
        cost[order] = self._cost(z, sign, place)
        return cost

    def refining(self) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.tile((np.arange(STEPS) - 16) / 2, GATES)))
        return np.log((self.seen[:, 1] + 8 * p) / (self.seen[:, 0] + 8 * (1 - p))).astype(np.float32)


def followers(context: np.ndarray, word: np.ndarray, times: np.ndarray, apart: bool, together: bool = False) -> tuple[np.ndarray, ...]:
    """Of items of (context, word, training times), `apart` if no two have both alike, `together` if those that do come one after the other: by item the number of its context and how often its word follows there; a row of each
    context, as they are read together: the word that follows most often, the second, how often these do (32 bits each), and all words. Of equals that of the lower hash is first."""
    if apart:
        inverse, n, c, w = None, times, context, word
    else:
        if together:
            new = np.ones(len(word), bool)
            new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
            first, inverse = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - np.int32(1)
        else:
            first, inverse = distinct(mixed(context) + word)
        n = np.bincount(inverse, times, len(first)).astype(np.int32)
        c, w = context[first], word[first]
    # contexts by 40 bits of their hash, falling counts, hashes of words
    low = np.uint64((1 << 12) - 1)
    order = np.argsort((c & ~np.uint64((1 << 24) - 1)) | (low - np.minimum(n, 4095).astype(np.uint64)) << np.uint64(12) | w >> np.uint64(52))
    group = c[order] >> np.uint64(24)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    of = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(order))))
    total = np.add.reduceat(n[order], begin) if len(begin) else n
    next_ = np.minimum(begin + 1, len(order) - 1)
    there = (next_ != begin) & (of[next_] == np.arange(len(begin)))
    top, next_ = order[begin], order[next_]
    at = np.empty(len(order), np.int32)
    at[order] = of
    told = np.empty((len(begin), 4), np.uint64)
    told[:, 0], told[:, 1], told[:, 3] = w[top], w[next_], total
    told[:, 2] = n[top].astype(np.uint64) << np.uint64(32) | np.where(there, n[next_], 0).astype(np.uint64)
    if inverse is not None:
        at, n = at[inverse], n[inverse]
    return at, n, told


def pasts(word: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the past has of words (and their kinds) that are the second and third before."""
    h = mixed(word.astype(np.int64).view(np.uint64))
    kinds = (mixed(np.arange(256, dtype=np.uint64)) >> np.uint64(58) << np.uint64(10)).astype(np.uint16)
    return kinds.take(kind) | (h >> np.uint64(58) << np.uint64(4)).astype(np.uint16), (h >> np.uint64(60)).astype(np.uint16)


def past(two: np.ndarray, kind_two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """16 bits of the words two and three before: six of the kind of the first, six of its hash, four of the other's hash."""
    return pasts(two, kind_two)[0] | pasts(three, np.zeros(len(three), np.int64))[1]


class Items:
    """Distinct items of a page in the order in which they are learnt.

    word: number of the word's code, or -1; key: hash of the word; one: the word before (its number, negative for words without
    a code); part: which part of a frequent word before; past: of the two words before that one, by `past`; kind: of the word
    before; spelled: by item, where the word has no code or was seen once; times: in training; together: whether items that differ in nothing but the last four bits of
    the past come one after the other."""

    def __init__(self, word: np.ndarray, key: np.ndarray, one: np.ndarray, part: np.ndarray, past: np.ndarray, kind: np.ndarray, spelled: dict[int, bytes], times: np.ndarray, together: bool = False):
        # a page's items are many: what can be made of narrower columns is made when it is asked for
        self.word, self.key, self.times, self.spelled = word.astype(np.int32), key, times.astype(np.int32), spelled
        u = lambda x: x.astype(np.int64).view(np.uint64)
        self.one = mixed(u(one) * np.uint64(0x10001) + u(part))
        self.past, self.kind, self.together = past.astype(np.uint16), kind.astype(np.uint8), together

    def two(self) -> np.ndarray:
        """Contexts of the two words before."""
        return mixed(self.one + (self.past >> np.uint16(4)).astype(np.uint64) * _M2)

    def three(self) -> np.ndarray:
        """Contexts of the three words before."""
        return mixed(self.one + self.past.astype(np.uint64) * _M2 + np.uint64(1 << 41))

    def kinds(self, at: np.ndarray) -> np.ndarray:
        """Contexts of the kinds of the two words before items `at`."""
        return mixed(self.kind[at].astype(np.uint64) * np.uint64(64) + (self.past[at] >> np.uint16(10)).astype(np.uint64) + np.uint64(1 << 40))


class Page:
    """The model of one page."""

    def __init__(self, code: tuple, ask: float, items: Items, once: np.ndarray, tokens: int):
        """once: items whose word was seen once in training: learnt as spelled."""
        grow = max(12, round(math.log2(max(tokens, 1))))
        self.code, self.ask, self.items, self.once = code, ask, items, once
        self.guess = Mixer([], [0.4, 0.6])
        self.coded = Mixer([grow + 2, min(grow + 1, 20)], [0.3, 0.3, 0.4])
        self.bytes = Mixer([grow, grow, 18, 20, 20], [0.3, 0.3, 0.2, 0.3, 0.3])
        self.found = [followers(items.two(), items.key, items.times, False, items.together), followers(items.three(), items.key, items.times, True)]
        slot = (items.one >> np.uint64(44)).astype(np.int64)
        self.often = np.bincount(slot, items.times, 1 << 20)[slot] > 256
        # items alike but for what only guesses see: the tables meet them as one
        new = np.zeros(len(items.key), bool)
        for x in (items.one, items.key, items.past >> np.uint16(10), items.kind):
            new[1:] |= x[1:] != x[:-1]
        self.alike = np.cumsum(new, dtype=np.int32)

    def _each(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in `at` of the first of items alike, number among these by place)."""
        new = np.diff(self.alike.take(at), prepend=np.int32(-1)) != 0
        return np.flatnonzero(new), np.cumsum(new) - 1

    def _guesses(self, at: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(whether there is a guess, whether it holds, inputs, gates) of items, `own` counts of them left out."""
        key, told = self.items.key[at], []
        for of, n, by_context in self.found:
            row = by_context.take(of.take(at), axis=0)
            top, second, total = row[:, 0], row[:, 1], row[:, 3].astype(np.int64)
            n_top, n_second = (row[:, 2] >> np.uint64(32)).astype(np.int64), (row[:, 2] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            mine = n.take(at) if own else 0
            is_top = key == top
            left = np.where(is_top, n_top - (mine > 0), n_top)
            falls = is_top & (left < n_second)
            told.append((np.where(falls, second, top), np.where(falls, n_second, left), total - (mine > 0)))
        (w2, n2, t2), (w3, n3, t3) = told
        use3 = n3 > 0
        word = np.where(use3, w3, w2)
        x2 = np.where(word == w2, stretch(t2 - n2, n2), stretch(t2, np.zeros_like(t2)))
        x3 = np.where(use3, stretch(t3 - n3, n3), np.float32(0))
        gate = (level(t2) + 4 * level(t3) + 16 * self.often[at].astype(np.int64)).astype(np.uint8)
        return n2 > 0, word == key, [x2, x3], gate

    def _path(self, at: np.ndarray, word: np.ndarray) -> tuple[tuple, tuple]:
        """Decisions of items `at` with codes `word`: of the code and of bytes, each (item's place in `at`, slots, given inputs, answers, gates)."""
        items, n = self.items, len(at)
        has = np.flatnonzero(word >= 0)
        of, node, bit = spread(self.code, word[has])
        item = np.concatenate([np.arange(n), has.take(of)])
        one = np.concatenate([word >= 0, bit.astype(bool)])
        prior = np.concatenate([np.full(n, self.ask, np.float32), self.code[4].take(node - np.uint32(FIRST_WORD))])
        gate = np.full(len(item), 16, np.uint8)
        gate[:n] = 0
        node = np.concatenate([np.full(n, ASK, np.uint32), node])
        slots = self.coded.slots([items.one[at].take(item), items.kinds(at).take(item)], node)
        return (item, slots, [prior], one, gate), self._spelled(at, np.flatnonzero(word < 0))

    def _spelled(self, at: np.ndarray, rare: np.ndarray) -> tuple:
        items = self.items
        if not len(rare):
            none = np.empty(0, np.int64)
            return none, [none] * 5, [], none.astype(bool), none.astype(np.uint8)
        keys = [items.spelled[i] for i in at[rare].tolist()]
        raw = np.frombuffer(b"".join(w + b" " for w in keys), np.uint8)
        size = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
        start = np.cumsum(size) - size
        item = np.repeat(np.arange(len(keys)), size)
        place = np.arange(len(raw)) - start[item]
        x, n = raw.astype(np.uint64) + np.uint64(1), len(raw)
        before = items.kind[at[rare]][item].astype(np.uint64) + np.uint64(300)

        def back(j: int) -> np.ndarray:
            out = np.empty(n, np.uint64)
            out[j:] = x[: max(n - j, 0)]
            out[place < j] = before[place < j]
            return out

        up, down = np.full(n + 1, _STEP, np.uint64), np.full(n + 1, _BACK, np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:n])])
        so_far = mixed((sums[:n] - sums[start[item]]) * down[start[item]])
        after = mixed(so_far + items.one[at[rare]][item])
        h2 = (back(1) * np.uint64(1009) + back(2)) * np.uint64(1009) + before
        h3 = h2 * np.uint64(1009) + back(3)
        h4 = h3 * np.uint64(1009) + back(4)
        of, node, bit = spread(_BYTES, raw.astype(np.int64))
        slots = self.bytes.slots([h.take(of) for h in (after, mixed(h2), mixed(h3), mixed(h4), so_far)], node)
        return rare.take(item.take(of)), slots, [], bit.astype(bool), np.where(place[of] > 0, np.uint8(16), np.uint8(0))

    def learn(self) -> np.ndarray:
        """Learn from the items with times > 0; log10 probability of each (nan of others) when it was learnt, its own occurrence left out."""
        items = self.items
        out = np.full(len(items.word), np.nan)
        taught = np.flatnonzero(items.times > 0)
        for lo in range(0, len(taught), SLICE):
            at = taught[lo : lo + SLICE]
            w = items.times[at]
            cost = np.zeros(len(at))
            there, holds, given, gate = self._guesses(at, 1)
            k = np.flatnonzero(there)
            cost[k] += self.guess.learn([], [v[k] for v in given], holds[k], gate[k], w[k])
            k = np.flatnonzero(~(there & holds))
            first, number = self._each(at[k])
            own, below, times = at[k[first]], np.zeros(len(first)), np.add.reduceat(w[k], first) if len(k) else w[k]
            word = np.where(self.once[own], -1, items.word[own])
            for mixer, (item, slots, given, one, gate) in zip((self.coded, self.bytes), self._path(own, word), strict=True):
                if len(item):
                    below += np.bincount(item, mixer.learn(slots, given, one, gate, times.take(item)), len(own))
            cost[k] += below[number]
            out[at] = -cost / math.log(10)
        return out

    def log10(self, which: np.ndarray) -> np.ndarray:
        """log10 probability of items `which` by all that was learnt (0 of others)."""
        items = self.items
        out = np.zeros(len(items.word))
        for lo in range(0, len(which), SLICE):
            at = which[lo : lo + SLICE]
            cost = np.zeros(len(at))
            there, holds, given, gate = self._guesses(at, 0)
            k = np.flatnonzero(there)
            cost[k] += self.guess.cost([], [v[k] for v in given], holds[k], gate[k])
            k = np.flatnonzero(~(there & holds))
            first, number = self._each(at[k])
            own, below = at[k[first]], np.zeros(len(first))
            for mixer, (item, slots, given, one, gate) in zip((self.coded, self.bytes), self._path(own, items.word[own]), strict=True):
                if len(item):
                    below += np.bincount(item, mixer.cost(slots, given, one, gate), len(own))
            cost[k] += below[number]
            out[at] = -cost / math.log(10)
        return out
