"""The language model against a plain model of dictionaries, its sums, layouts and edge cases."""

import gc
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosodia.llm import common, context_mixing, mixing

rng = random.Random(5)
SYLLABLES = ["ba", "re", "ció", "th", "on", "lich"]
WORDS = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(120)]
SCHEMA = "doc_id bigint, text string, score string, _row int"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    texts = [" ".join(draw.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=draw.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " \n", texts[0], texts[0], "New-Word xyzzy", " ".join(draw.choices(WORDS, k=9000)), "x" * 30_000]
    return [(None if i == 9 else i, t, "clash", 7) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 7)]


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def teaches():
    return ~common.held_out(F.col("doc_id"), 1)


def scored(docs, **more):
    counts = common.publish(context_mixing.count_words(docs.where(teaches())), "counts")
    return context_mixing.score_texts(docs, counts, teaches(), **more)


def test_base_and_shape(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = scored(docs).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, len(tokens(t)), sum(w in c for w in tokens(t)), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    # copies are cheap by one another, and equal rows are equal
    alike = [r for r in got if r.doc_id == 3]
    assert len(alike) == 2 and alike[0].score == alike[1].score


@pytest.mark.parametrize("more", [{}, {"page": 500, "hot": 60, "common": 40}])
def test_layout_does_not_matter(spark, rows, more):
    docs = spark.createDataFrame(rows, SCHEMA)
    one, many = ({(r.doc_id, r.n_tokens): (r.score, r.bits_per_byte) for r in scored(docs.repartition(n), **more).collect()} for n in (1, 7))
    assert one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k], abs=1e-6) for k in one)


def test_empty(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert scored(none).count() == 0
    held = spark.createDataFrame([r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1], SCHEMA)
    got = scored(held).collect()  # nothing to learn from: every decision is even
    assert len(got) > 3 and {r.train_tokens for r in got} == {0} and all(r.score < 0 and r.n_known == 0 for r in got)


def test_query(spark, tmp_path):
    from prosodia.llm.registry import QUERIES

    spark.createDataFrame([(i, " ".join(WORDS[i : i + 20]), "en", "s", 5) for i in range(40)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_context_mixing"](spark, str(tmp_path))
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {(r.doc_id, r.held_out) for r in got.collect()} == {(i, zlib.crc32(str(i).encode()) % 5 == 1) for i in range(40)}


def page(seed=1, n=500):
    """A book and the columns of a page's distinct items."""
    draw = random.Random(seed)
    text = [draw.choice(WORDS).encode() for _ in range(n)]
    text += text[:60] + [draw.choice(WORDS).encode() for _ in range(20)]
    c = Counter(text)
    book = context_mixing.Book([(w, k) for w, k in c.most_common(60) if k > 2], len(text))
    rows = defaultdict(int)
    for i, w in enumerate(text):
        rows[(w, *(book.words.get(x, -2 - context_mixing.kind(x)) for x in (text[i - 1], text[i - 2])), context_mixing.kind(text[i - 3]))] += draw.choice([0, 1, 1, 3])
    text, one, two, third = (list(x) for x in zip(*rows, strict=True))
    number = np.array([book.words.get(w, -1) for w in text], np.int64)
    one, two, third = (np.array(x, np.int64) for x in (one, two, third))
    once = number == len(book.words) - 1  # as if its word had been seen once
    past = mixing.past(two, book.kinds_of(two), third).astype(np.int64)
    _, first = np.unique(np.array([f"{w} {a} {b}" for w, a, b in zip(text, one, past, strict=True)]), return_index=True)
    return book, number[first], one[first], one[first] % 2, past[first], book.kinds_of(one)[first], np.array(list(rows.values()))[first], [text[i] for i in first], once[first]


def plain(book, number, one, part, past, kinds, times, text, once, keys):
    """Online and last log10 probabilities of items, by dictionaries, decision by decision."""
    start = {"guess": [0.4, 0.6, 0.0], "coded": [0.3, 0.3, 0.4, 0.0], "bytes": [0.3, 0.3, 0.2, 0.3, 0.3, 0.0]}
    tables = {m: [defaultdict(lambda: [0, 0]) for _ in range(k)] for m, k in (("guess", 0), ("coded", 2), ("bytes", 5))}
    weights = {(m, g): np.array(s) for m, s in start.items() for g in range(mixing.GATES)}
    curve = {(m, g): mixing.RIDGE * np.eye(len(s)) for m, s in start.items() for g in range(mixing.GATES)}
    seen = defaultdict(lambda: [0.0, 0.0])
    n = len(number)
    level = lambda k: sum(k > m for m in (0, 2, 30))
    odds = lambda a, b: math.log((a + 0.25) / (b + 0.25))
    contexts = [[(one[i], part[i], past[i] >> 4) for i in range(n)], [(one[i], part[i], past[i]) for i in range(n)]]
    follow = [defaultdict(Counter) for _ in contexts]
    before = Counter()
    for i in range(n):
        before[one[i], part[i]] += times[i]
        for f, c in zip(follow, contexts, strict=True):
            f[c[i]][text[i]] += times[i]

    def path(code, i):
        first, length, nodes, bits = (x.tolist() for x in code[:4])
        return [(nodes[j], bits[j]) for j in range(first[i], first[i] + length[i])]

    def guess(i, own):
        out = []
        for f, c in zip(follow, contexts, strict=True):
            seen_ = f[c[i]]
            ranked = sorted(seen_, key=lambda w: (-seen_[w], keys[w]))[:2]
            mine = 1 if own and seen_[text[i]] else 0
            count = {w: seen_[w] - (mine if w == text[i] else 0) for w in ranked}
            top = ranked[1] if len(ranked) > 1 and count[ranked[0]] < count[ranked[1]] else ranked[0]
            out.append((top, count[top], sum(seen_.values()) - mine))
        return out

    def decisions(i, own):
        (w2, n2, t2), (w3, n3, t3) = guess(i, own)
        word = w3 if n3 else w2
        if n2:
            yield "guess", int(word == text[i]), [], [odds(n2, t2 - n2) if word == w2 else odds(0, t2), odds(n3, t3 - n3) if n3 else 0.0], level(t2) + 4 * level(t3) + 16 * (before[one[i], part[i]] > 256)
            if word == text[i]:
                return
        has = number[i] >= 0 and not (own and once[i])
        w = [(one[i], part[i]), (kinds[i], past[i] >> 10)]
        yield "coded", int(has), [(mixing.ASK, c) for c in w], [book.ask], 0
        if has:
            for node, bit in path(book.code, number[i]):
                yield "coded", bit, [(node, c) for c in w], [float(book.code[4][node - mixing.FIRST_WORD])], 16
            return
        line = text[i] + b" "
        for k, x in enumerate(line):
            back = [line[k - j] + 1 if k >= j else 300 + kinds[i] for j in (1, 2, 3, 4)]
            cs = [(line[:k], w[0]), (*back[:2], kinds[i]), (*back[:3], kinds[i]), (*back, kinds[i]), line[:k]]
            for node, bit in path(mixing._BYTES, x):
                yield "bytes", bit, [(node, c) for c in cs], [], 16 * (k > 0)

    def told(i, own):
        for m, bit, places, given, gate in decisions(i, own):
            y = 1 if bit else -1
            x, levels = [], []
            for t, key in zip(tables[m], places, strict=True):
                same, other = t[key][bit] - own, t[key][1 - bit]
                x.append(odds(same, other))
                levels.append(level(same + other))
            x = np.array([*x, *(y * v for v in given), y])
            g = (m, gate + (levels[0] + 4 * levels[-1] if levels else 0))
            z = min(14, max(-14, float(weights[g] @ x)))
            yield bit, y, x, g, z, (g, min(32, max(0, round(z * y * 2) + 16)))

    def refined(z, y, place):
        p = 1 / (1 + math.exp(-(place[1] - 16) / 2))
        a, b = seen[place]
        return (z + y * math.log((b + 8 * p) / (a + 8 * (1 - p)))) / 2

    taught = [i for i in range(n) if times[i]]
    online, last = np.full(n, np.nan), []
    online[taught] = 0
    for lo in range(0, len(taught), mixing.SLICE):
        now = taught[lo : lo + mixing.SLICE]
        for i in now:
            for m, bit, places, *_ in decisions(i, 1):
                for t, key in zip(tables[m], places, strict=True):
                    t[key][bit] += times[i]
        steps, after, costs = defaultdict(list), [], []
        for i in now:
            for bit, y, x, g, z, place in told(i, 1):
                costs.append((i, z, y, place))
                miss = 1 / (1 + math.exp(z))
                steps[g].append((times[i] * miss * x, times[i] * miss * (1 - miss) * np.outer(x, x)))
                after.append((place, bit, times[i]))
        for i, z, y, place in costs:
            online[i] -= math.log10(1 + math.exp(-refined(z, y, place)))
        for g, s in steps.items():
            curve[g] = curve[g] + sum(c for _, c in s)
            weights[g] = weights[g] + np.clip(np.linalg.solve(curve[g], sum(e for e, _ in s)), -0.2, 0.2)
        for place, bit, k in after:
            seen[place][bit] += k
    for i in range(n):
        last.append(-sum(math.log10(1 + math.exp(-refined(z, y, place))) for _, y, _, _, z, place in told(i, 0)))
    return online, np.array(last)


def model(args, tokens):
    book, number, one, part, past, kinds, times, text, once = args
    key = mixing.mixed(np.array([zlib.crc32(w) for w in text], np.uint64))
    told = {i: w for i, w in enumerate(text) if number[i] < 0 or once[i]}
    return mixing.Page(book.code, book.ask, mixing.Items(number, key, one, part, past, kinds, told, times), once, tokens), dict(zip(text, key.tolist(), strict=True))


def test_page_is_the_plain_one(monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 50)
    args = page()
    got, keys = model(args, 1 << 22)
    # slots enough that hardly any two contexts share one
    got.coded, got.bytes = mixing.Mixer([24, 24], [0.3, 0.3, 0.4]), mixing.Mixer([24] * 5, [0.3, 0.3, 0.2, 0.3, 0.3])
    online = got.learn()
    want_online, want = plain(*args, keys)
    assert np.array_equal(np.isnan(online), np.isnan(want_online))
    # a sum that rounding puts on the other side of a step of the refining table is all that may differ
    for a, b in ((online[~np.isnan(online)], want_online[~np.isnan(online)]), (got.log10(np.arange(len(want))), want)):
        assert (np.abs(a - b) < 1e-5).mean() > 0.95 and np.abs(a - b).max() < 0.3 and a.sum() == pytest.approx(b.sum(), rel=2e-3)


def test_probabilities_sum_to_one():
    args = page(3)
    book, number = args[:2]
    got, _ = model(args, 1 << 14)
    got.learn()
    n = len(book.counts)
    # after one place, were nothing known of the longer contexts: all coded words, and what is left for spelled ones
    for place in range(0, len(number), 97):
        coded = np.zeros(n)
        for mixer, (item, slots, given, bit, gate) in zip((got.coded, got.bytes), got._path(np.full(n, place), np.arange(n)), strict=True):
            if len(item):
                coded += np.bincount(item, mixer.cost(slots, given, bit, gate), n)
        got.items.spelled[place] = b""
        item, slots, given, bit, gate = got._path(np.array([place]), np.array([-1]))[0]
        assert np.exp(-coded).sum() + np.exp(-got.coded.cost(slots, given, bit, gate)).sum() == pytest.approx(1, abs=1e-4)


def test_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    by = scored(docs).groupBy(teaches().alias("taught")).agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_bytes").alias("bytes")).collect()
    assert len(by) == 2 and all(r.score > r.base for r in by)


def test_copies_are_told_apart(spark):
    draw = random.Random(4)
    words = ["".join(draw.choice(SYLLABLES) for _ in range(draw.randint(2, 7))) for _ in range(3000)]
    text = lambda seed: " ".join(random.Random(seed).choices(words, k=80))
    once = [(1000 + i, text(100 + i), "", 0) for i in range(100)]
    twice = [(2000 + i, text(i // 2), "", 0) for i in range(60)]
    got = {r.doc_id: r.bits_per_byte for r in scored(spark.createDataFrame(once + twice, SCHEMA).repartition(4)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    copies = [got[i] for i, *_ in twice if not held(i ^ 1)]
    assert max(copies) < 0.5 * min(got[i] for i, *_ in once)


def test_sums_by_gate_are_plain_sums():
    """Inputs are met with their gate's weights gate by gate; the costs are those of one decision at a time."""
    rng = np.random.default_rng(4)
    m = mixing.Mixer([6, 6], [0.3, 0.3, 0.4])
    m.weights += rng.normal(0, 0.1, m.weights.shape)
    for t in m.counts:
        t += rng.integers(0, 40, t.shape)
    slots, given = [rng.integers(0, 64, 300) for _ in range(2)], [rng.normal(0, 1, 300).astype(np.float32)]
    one, gate = rng.random(300) < 0.4, np.where(rng.random(300) < 0.5, np.uint8(16), np.uint8(0))
    x, order, cuts, z, sign, _ = m._sum(slots, given, one, gate, 0)
    for g in range(mixing.GATES):
        at = slice(cuts[g], cuts[g + 1])
        assert np.allclose(z[at], np.clip(np.einsum("ij,i->j", x[:, at], m.weights[:, g]), -14, 14), atol=1e-3)
    assert sorted(order) == list(range(300)) and ((sign > 0) == one[order]).all()


def test_words_are_found_by_hash(spark):
    """Words of many texts at once are those of plain splitting, with their numbers; counts are of the words themselves."""
    draw = random.Random(6)
    texts = [None, b"", b" ", b"\n\r", b"A", b" \x0b\x0cAz[@`{ \xc3\x89\xff\x00 q\r\n", b"x" * 3000 + b" " + b"X" * 3001] + [bytes(draw.choice(b"aBZ \n\t\xc2\xa0\x1c\x85") for _ in range(draw.randint(0, 30))) for _ in range(600)]
    want = [(t or b"").lower().split() for t in texts]
    counts = Counter(w for ws in want for w in ws)
    common = context_mixing.Book(counts.most_common(100), counts.total())
    for off in (0, 3):
        column, got = pa.array(texts, pa.binary()).slice(off), []
        for lo, k in context_mixing.slices(column, 300):
            raw, begins, ends, h, lengths, size = context_mixing.words_of(column.slice(lo, k))
            ws = [raw[a:z] for a, z in zip(begins, ends, strict=True)]
            assert common.numbers(h).tolist() == [common.words.get(w, -1) for w in ws]
            assert size.tolist() == [len(t or b"") for t in texts[off + lo : off + lo + k]]
            stops = np.cumsum(lengths)
            got += [ws[z - n : z] for n, z in zip(lengths.tolist(), stops.tolist(), strict=True)]
        assert got == want[off:]
    docs = spark.createDataFrame([(t if t is None else bytearray(t),) for t in texts], "text binary").repartition(3)
    assert {bytes(r.word): r.n for r in context_mixing.count_words(docs).collect()} == counts | {b"\n": len(texts)}


def test_page_and_book_take_little_memory():
    """An executor scores two pages at once beside its JVM: a page takes some 234 bytes a token at its peak, the book no object a word."""
    rng = np.random.default_rng(5)
    words = [f"w{i}".encode() for i in range(30_000)]
    tokens = np.minimum(rng.zipf(1.3, 300_000) - 1, 29_999)
    book = context_mixing.Book([(w, 30_002 - i) for i, w in enumerate(words)], 600_000_000)
    gc.collect()
    assert sum(len(gc.get_referents(x)) for x in vars(book).values() if isinstance(x, dict | list)) == 0
    batch = context_mixing.Batch(book, 1, 1 << 17)
    batch.add(list(range(300)), [i % 5 > 0 for i in range(300)], list(range(300)), tokens.astype(np.int64), [], np.full(300, 1000))
    parts = [x for _, x in batch.packed()]
    tracemalloc.start()
    got = context_mixing.score_page(book, parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(rows) for rows, _ in got) == 300 and all((s < 0).all() for _, s in got)
    assert peak < 260 * 300_000


def test_near_nodes_lie_together_and_items_alike_are_met_once(monkeypatch):
    """The slots of a node and of the six below it are in one line; items that only guesses tell apart take one path."""
    book, number, one, part, past, kinds, times, text, once = page(5)
    for code, base in ((book.code, mixing.FIRST_WORD), (mixing._BYTES, 0)):
        first, length, nodes, bits = (x.tolist() for x in code[:4])
        paths = [list(zip(nodes[a : a + n], bits[a : a + n], strict=True)) for a, n in zip(first, length, strict=True)]
        # each node after the same answers, and three in a row in one group
        at = {}
        assert all(at.setdefault(tuple(b for _, b in p[:k]), p[k][0]) == p[k][0] for p in paths for k in range(len(p))) and len(set(at.values())) == len(at)
        assert all(len({(node - base) >> 3 for node, _ in p[k : k + 3]}) == 1 for p in paths for k in range(0, len(p), 3))
    m = mixing.Mixer([12], [1.0])
    slots = m.slots([np.full(8, 12345, np.uint64)], np.arange(256, 264, dtype=np.uint32))[0]
    assert len(set((slots >> 3).tolist())) == 1 and sorted((slots & 7).tolist()) == list(range(8))
    # each item again with another past, which only the guesses see
    twice = lambda x, other=None: np.stack([x, x if other is None else other], axis=1).reshape(-1)
    text = [w for w in text for _ in range(2)]
    got, _ = model((book, twice(number), twice(one), twice(part), twice(past, past ^ 1), twice(kinds), twice(np.maximum(times, 1)), text, twice(once)), 1 << 14)
    met, path = [], mixing.Page._path
    monkeypatch.setattr(mixing.Page, "_path", lambda self, at, word: met.append(at) or path(self, at, word))
    got.learn()
    got.log10(np.arange(len(text)))
    assert all(len(set((at // 2).tolist())) == len(at) for at in met) and len(met) >= 2


def test_sums_of_a_batch():
    rng = np.random.default_rng(0)
    for low, high, n in ((1 << 40, (1 << 40) + 300, 5000), (0, 1 << 50, 2000)):
        rows, scores = rng.integers(low, high, n), rng.integers(-(10**9), 1, n)
        want = defaultdict(int)
        for r, s in zip(rows.tolist(), scores.tolist(), strict=True):
            want[r] += s
        got = context_mixing.summed(rows, scores)
        assert dict(zip(*(x.tolist() for x in got), strict=True)) == want


def test_pairs_are_found_among_neighbours():
    """Where equal pairs of context and word come one after the other, what follows a context is found without a sort of the pairs; it is the same."""
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 40, (500, 2)), axis=0)
    context, word = (mixing.mixed(pairs[:, i].astype(np.uint64) + np.uint64(77 + i)).repeat(3) for i in range(2))
    times = rng.integers(0, 5, len(word)).astype(np.int32)
    told = []
    for together in (False, True):
        at, n, rows = mixing.followers(context, word, times, False, together)
        told.append([(int(n[i]), *rows[at[i]].tolist()) for i in range(len(word))])
        assert all(k == times[(context == context[i]) & (word == word[i])].sum() for i, (k, *_) in enumerate(told[-1]))
        assert all(int(total) == times[context == context[i]].sum() for i, (*_, total) in enumerate(told[-1]))
    assert told[0] == told[1]
