"""Language-model scores by online logistic context mixing.

A text is its lower-cased (A-Z) words, then an end. The mixing itself is in `mixing`: every word is a path of yes/no decisions
(is it what followed here most often; the bits of its code; the bits of its bytes), each predicted under several hashed contexts (the words
before and their kinds; the last bytes and the word so far where a word is spelled), whose log-odds are summed by gated weights and refined.

Layout. One model of a whole corpus fits no machine, and its tables have to grow with the corpus. So occurrences are dealt to pages by
the word before, about PAGE tokens a page, and each page is learnt and scored by one task on its own: it holds all occurrences of
its contexts, so their counts are those of the whole corpus, and the number of pages follows the number of tokens. A word that occurs more than
HOT times is dealt in parts by the hash of the word before it, and if that one is as frequent, also by the hash of the document's
key: no group of equal words, pairs or passages meets in one page. Such a part is a context of its own, of some HOT tokens. Pages, parts and the
order of learning are functions of hashes and of the corpus' counts alone, so that scores do not depend on partitions; sums are of whole
ten-thousandths. The batches' parts of pages travel packed, and the pages' sums by document come back packed.

The COMMON most frequent words have a code; others are spelled (as rare words are in any vocabulary of bounded size), with byte
contexts of the page. The code is broadcast (under 80 MB whatever the corpus). Words are found by 64-bit hashes of their bytes, many at
once; the counts of words that are joined go by the words themselves. A word seen once in training is learnt as a spelled
one, so that the chance of new words is learnt from words that were new.

The score is what the online model gives: a held-out text's by all that was learnt, a training text's as learning met it, each
decision before its own occurrence was counted (and by what other texts, or other places, had taught by then). A text that has a copy elsewhere
is cheap by it, one that has none is not, whether or not it teaches.

The base score (add-half unigram) uses exact counts of all training words: those of words with a code are broadcast, the others are
joined by word, so common words do not travel. It gives every unknown word the same share, however many there are, so a model that has to
spell them costs more there.

Defined results: a null or empty text is only an end; repeated rows each get a row; null ids count as training rows; with no training rows
every decision is even; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .common import few_rows, held_out, publish, release_memory

#: Words that have a code, at most, and their greatest length in bytes.
COMMON, COMMON_BYTES = 262_144, 256
#: Tokens of a page, about; occurrences of a word in one part; tokens that a task packs at once.
PAGE, HOT, BATCH = 1 << 19, 1 << 17, 1 << 19
END = b"\n"
#: Number of what stands before a text; words without a code have lower ones, with their kind in the low byte.
START = -1
SCALE = 1e4


def kind(word: bytes) -> int:
    """Kind of a word: its first three bytes, hashed to one."""
    return crc32(word[:3]) & 255


def _table(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their places by slot, at most half of which are taken: each in the first free one from its upper bits on."""
    bits = max(4, len(h).bit_length() + 1)
    keys, places = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
    left, at = np.arange(len(h)), (h >> np.uint64(64 - bits)).astype(np.int64)
    while len(left):
        free = left[keys[at[left]] == 0]
        _, first = np.unique(at[free], return_index=True)
        taken = free[first]
        keys[at[taken]], places[at[taken]] = h[taken], taken
        left = left[places[at[left]] != left]
        at[left] = (at[left] + 1) & (len(keys) - 1)
    return keys, places


class Book:
    """The common words: number by hash, counts and kinds by number, and their code."""

    def __init__(self, counts: list[tuple[bytes, int]], total: int):
        self.letters = b"".join(w for w, _ in counts)
        self.cuts = np.cumsum([0, *(len(w) for w, _ in counts)], dtype=np.int64)
        self.keys, self.places = _table(hashes(np.frombuffer(self.letters, np.uint8), self.cuts[:-1], self.cuts[1:]))
        self.end = next((i for i, (w, _) in enumerate(counts) if w == END), None)
        self.counts = np.array([n for _, n in counts], np.int64)
        self.kinds = np.array([kind(w) for w, _ in counts], np.uint8)
        self.code = mixing.prefix_code([float(n) for _, n in counts], mixing.FIRST_WORD)
        coded = int(self.counts[self.counts > 1].sum())
        self.ask = math.log((coded + 0.5) / (total - coded + 0.5))

    @property
    def words(self) -> dict[bytes, int]:
        """Number by word. Made anew each time: workers hold the words as one run of bytes."""
        return {self.word(i): i for i in range(len(self.counts))}

    def word(self, number: int) -> bytes:
        return self.letters[self.cuts[number] : self.cuts[number + 1]]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words of these hashes, -1 of those without a code."""
        at = (h >> np.uint64(64 - (len(self.keys).bit_length() - 1))).view(np.int64)
        key = self.keys.take(at)
        out = np.where(key == h, self.places.take(at), -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            key = self.keys[at[left]]
            found = key == h[left]
            out[left[found]] = self.places[at[left[found]]]
            left = left[~found & (key != 0)]
        return out

    def kinds_of(self, number: np.ndarray) -> np.ndarray:
        """Kinds by number; 0 before a text."""
        out = (-number - 2) & 255
        out[number == START] = 0
        found = number >= 0
        out[found] = self.kinds[number[found]]
        return out

    def times(self, number: np.ndarray) -> np.ndarray:
        """Training occurrences; of what stands before a text as many as there are texts, of words without a code none."""
        out = np.zeros(len(number), np.int64)
        found = number >= 0
        out[found] = self.counts[number[found]]
        out[number == START] = 0 if self.end is None else self.counts[self.end]
        return out


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(raw: bytes, kind_: type) -> np.ndarray:
    size = np.dtype(kind_).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind_)


def slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of rows of about so many bytes: a longer row is alone."""
    ends = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), 1), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, stop - at
        at = stop


#: Powers of the hash of words and their inverses; longer words than LONG bytes are hashed one at a time.
_UP, LONG = 0xD1342543DE82EF95, 64
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_UP, pow(_UP, -1, 2**64))]
    return _POWERS


def hashes(letters: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes, never 0, of the words at these places of bytes."""
    if not len(begins):
        return np.empty(0, np.uint64)
    up, down = _powers(len(letters))
    sums = letters + np.uint64(1)
    sums *= up[: len(letters)]
    np.cumsum(sums, out=sums)
    h = sums[ends - 1]
    later = int(begins[0] == 0)  # there is nothing to take from a word at the start
    h[later:] -= sums[begins[later:] - 1]
    h *= down[begins]
    for i in np.flatnonzero(ends - begins > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(letters[begins[i] : ends[i]].tobytes())
    h = mixing.mixed(h) * mixing._M2
    h[h == 0] = 1
    return h


def words_of(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes of all texts, where words begin in them and end, hashes of the words, words by text, bytes by text); a null is an empty text."""
    column = pc.fill_null(column, b"")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size, lo, hi = np.diff(at), int(at[0]), int(at[-1])
    raw = b"" if lo == hi else column.buffers()[2].slice(lo, hi - lo).to_pybytes().lower()
    letters = np.frombuffer(raw, np.uint8)
    # 1 in a word: where that changes, or a text begins, words begin and end
    word = ((letters != 32) & (letters - np.uint8(9) > 4)).view(np.int8)
    first = (at[:-1] - lo)[size > 0]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= word[:-1] ^ 1
    begins[first] = word[first]
    ends[:-1] &= word[1:] ^ 1
    last = (at[1:] - lo - 1)[size > 0]
    ends[last] = word[last]
    begins, ends = np.flatnonzero(begins.view(bool)), np.flatnonzero(ends.view(bool)) + 1
    return raw, begins, ends, hashes(letters, begins, ends), np.diff(np.searchsorted(begins, at - lo)), size


class Batch:
    """Tokens of some texts, packed by page."""

    def __init__(self, book: Book, pages: int, hot: int):
        self.book, self.pages, self.hot = book, pages, hot
        self.number: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.rows: list[int] = []
        self.train: list[bool] = []
        self.mix: list[int] = []
        self.rare: list[bytes] = []
        self.size = 0

    def add(self, rows: list[int], train: list[bool], mix: list[int], number: np.ndarray, rare: list[bytes], lengths: np.ndarray) -> None:
        """number: by token, with negative ones in order for `rare`."""
        self.doc.append(np.repeat(np.arange(len(self.rows), len(self.rows) + len(rows)), lengths))
        self.rows += rows
        self.train += train
        self.mix += mix
        self.number.append(number)
        self.rare += rare
        self.size += len(number)

    def packed(self) -> Iterator[tuple[int, bytes]]:
        """(page, part): word, the one before and its part, the past of that one, text and whether it teaches, and spelled words."""
        if not self.size:
            return
        word, doc = np.concatenate(self.number).astype(np.int64), np.concatenate(self.doc).astype(np.int64)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        sizes = np.diff(np.append(starts, len(doc)))

        def before(j: int, x: np.ndarray, at_start: int) -> np.ndarray:
            out = np.empty_like(x)
            out[j:] = x[: max(len(x) - j, 0)]
            for i in range(j):  # the first places of texts
                out[(starts + i)[i < sizes]] = at_start
            return out

        one, two = before(1, word, START), before(2, word, START)
        # what the past has of each word is worked out once for it, not once for each place it has in a past
        of_two, of_three = mixing.pasts(word, self.book.kinds_of(word))
        start_two, start_three = (int(x[0]) for x in mixing.pasts(np.array([START]), self.book.kinds_of(np.array([START]))))
        past = before(2, of_two, start_two) | before(3, of_three, start_three)
        n = self.book.times(one)
        part = np.zeros(len(word), np.uint64)
        many = np.flatnonzero(n > self.hot)
        if len(many):
            by = mixing.mixed(two[many].view(np.uint64))
            both = np.flatnonzero(self.book.times(two[many]) > self.hot)
            by[both] ^= mixing.mixed(np.array(self.mix, np.int64).view(np.uint64)[doc[many[both]]])
            part[many] = mixing.mixed(by) % (-(-n[many] // self.hot)).astype(np.uint64)
        page = (mixing.mixed(mixing.mixed(one.view(np.uint64)) + part) % np.uint64(self.pages)).astype(np.int64)
        order = np.argsort(page.astype(np.uint16) if self.pages <= 1 << 16 else page, kind="stable")
        page, whose = page[order], doc[order]
        starts = np.diff(page, prepend=-1) != 0
        cuts = np.flatnonzero(starts).tolist() + [len(order)]
        new = starts | (np.diff(whose, prepend=-1) != 0)
        # planes of the bytes that travel, by token and by text of a page
        tokens, at = np.empty((15, len(order)), np.uint8), 0
        for x in (word.astype(np.int32), one.astype(np.int32), part.astype(np.int32), past):
            tokens[at : at + x.itemsize] = x.take(order).view(np.uint8).reshape(len(order), -1).T
            at += x.itemsize
        tokens[at] = new
        docs = np.empty((9, int(new.sum())), np.uint8)
        rows = np.array(self.rows, np.int64)[whose[new]]
        steps = np.diff(rows, prepend=0)
        of_page = starts[new]
        steps[of_page] = rows[of_page]
        docs[:8] = steps.view(np.uint8).reshape(len(rows), 8).T
        docs[8] = np.array(self.train, bool)[whose[new]]
        doc_cuts = np.append(np.flatnonzero(of_page), len(rows)).tolist()
        spelled = np.cumsum(word < 0)[order] - 1
        rare = word[order] < 0
        rare_cuts = np.concatenate([[0], np.cumsum(rare)])[cuts].tolist()
        texts = [self.rare[i] for i in spelled[rare].tolist()]
        pack = zstandard.ZstdCompressor(level=1)
        for k, (a, z) in enumerate(itertools.pairwise(cuts)):
            c, d = doc_cuts[k], doc_cuts[k + 1]
            head = np.array([z - a, d - c], np.int64).tobytes()
            yield int(page[a]), pack.compress(b"".join([head, tokens[:, a:z].tobytes(), docs[:, c:d].tobytes(), b" ".join(texts[rare_cuts[k] : rare_cuts[k + 1]])]))


def _unpacked(raw: bytes) -> tuple:
    """Word, the one before, its part, the past, place in `rows`, rows, whether they teach, spelled words."""
    n, docs = np.frombuffer(raw[:16], np.int64).tolist()
    at, out = 16, []
    for size, kind_ in ((4, np.int32), (4, np.int32), (4, np.int32), (2, np.uint16)):
        out.append(_unplanes(raw[at : at + size * n], kind_))
        at += size * n
    out.append(np.cumsum(np.frombuffer(raw[at : at + n], np.uint8), dtype=np.int32) - 1)
    at += n
    out.append(np.cumsum(_unplanes(raw[at : at + 8 * docs], np.int64)))
    out.append(np.frombuffer(raw[at + 8 * docs : at + 9 * docs], bool))
    words = raw[at + 9 * docs :]
    return *out, words.split(b" ") if words else []


def score_page(book: Book, parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part of a page (rows, score), the latter in parts of SCALE: learnt from the page's training tokens."""
    unpack = zstandard.ZstdDecompressor()
    got = [_unpacked(unpack.decompress(p)) for p in parts]
    word, one, part, past = (np.concatenate([g[i] for g in got]) for i in range(4))
    train = np.concatenate([g[6][g[4]] for g in got])
    texts = list(itertools.chain.from_iterable(g[7] for g in got))
    got = [(g[4], g[5]) for g in got]
    rare = np.flatnonzero(word < 0)
    u, m = (lambda x: x.astype(np.int64).view(np.uint64)), mixing.mixed
    what = u(word)
    if texts:
        what[rare] = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))
    what = m(what + np.uint64(1 << 50))
    # items that differ in nothing but the lower bits of the past, which only guesses see, come one after the other
    key = m(u(one))
    for x in (part, past >> np.uint16(10)):
        key += u(x)
        key = m(key)
    key = (key ^ what) & ~np.uint64(1023) | (past & np.uint16(1023)).astype(np.uint64)
    first, inverse = mixing.distinct(key)
    del key
    # context by context: what follows one word is learnt together, and its slots stay in a core's cache
    order = np.argsort(m(m(u(one[first])) + u(part[first])), kind="stable")
    back = np.empty(len(order), np.int32)
    back[order] = np.arange(len(order), dtype=np.int32)
    first, inverse = first[order], back[inverse]
    del order, back
    times = np.bincount(inverse, train, len(first)).astype(np.int32)
    number, what, one, part, past = np.maximum(word[first], -1), what[first], one[first], part[first], past[first]
    once = np.zeros(len(first), bool)
    if len(book.counts) and book.counts[-1] < 2:
        once = (number >= 0) & (book.counts[number] < 2)
    # items without a code, and where their words are in `texts`
    bare = np.flatnonzero(number < 0)
    told = {i: texts[s] for i, s in zip(bare.tolist(), np.searchsorted(rare, first[bare]).tolist(), strict=True)} | {i: book.word(number[i]) for i in np.flatnonzero(once).tolist()}
    items = mixing.Items(number, what, one, part, past, book.kinds_of(one), told, times, together=True)
    count = len(first)
    del number, what, word, one, part, past, times, texts, rare, bare, first, told
    page = mixing.Page(book.code, book.ask, items, once, len(inverse))
    learnt = page.learn()
    # held-out tokens, and those alone, by all that was learnt
    asked = np.zeros(count, bool)
    asked[inverse[~train]] = True
    last = page.log10(np.flatnonzero(asked))
    del page, items
    score = np.rint(np.where(train, learnt[inverse], last[inverse]) * SCALE)
    out, at = [], 0
    for idx, rows in got:
        out.append((rows, np.bincount(idx, score[at : at + len(idx)], len(rows)).astype(np.int64)))
        at += len(idx)
    return out


def summed(rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, each once, and the sums of their scores. Those of a batch lie close together, as their texts did."""
    low, width = int(rows.min()), int(rows.max()) - int(rows.min()) + 1
    if width > 4 * len(rows):
        row, inverse = np.unique(rows, return_inverse=True)
        width = len(row)
    else:
        inverse = rows - low
        row = np.flatnonzero(np.bincount(inverse, minlength=width)) + low
    total = np.zeros(width, np.int64)
    np.add.at(total, inverse, scores)
    return row, total if width == len(row) else total[row - low]


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all words and ends, lower-cased; tasks count first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[tuple], n: int) -> Iterator[pa.RecordBatch]:
            """Words of some texts, each once, and as many ends as texts."""
            size = [len(x) for x, *_ in held]
            raw = np.frombuffer(b"".join(x for x, *_ in held), np.uint8)
            begins, ends = (np.concatenate([x[i] + k for x, k in zip(held, np.cumsum([0, *size[:-1]]), strict=True)]) for i in (1, 2))
            first, number = mixing.distinct(np.concatenate([x[3] for x in held]))
            first, times = np.append(first, -1), np.append(np.bincount(number, minlength=len(first)), n)
            del number
            for lo in range(0, len(first), 100_000):
                own, k = first[lo : lo + 100_000], times[lo : lo + 100_000]
                is_end = own < 0
                begin = begins[own] if len(begins) else np.zeros(len(own), np.int64)
                length = np.where(is_end, 0, ends[own] - begin) if len(begins) else np.zeros(len(own), np.int64)
                stop = np.cumsum(length)
                letters = raw[np.arange(int(stop[-1])) + np.repeat(begin - (stop - length), length)].tobytes() + END
                # the end is the last of all
                stop[is_end] += 1
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.append(0, stop).astype(np.int32)), pa.py_buffer(letters)]), pa.array(k, pa.int64())], names=["word", "n"])

        held, size, texts = [], 0, 0
        for b in batches:
            column = b.column("_text")
            for lo, k in slices(column):
                held.append(words_of(column.slice(lo, k))[:4])
                size, texts = size + len(held[-1][0]), texts + k
                if size > 1 << 24:
                    yield from told(held, texts)
                    held, size, texts = [], 0, 0
        if held:
            yield from told(held, texts)
        held.clear()
        release_memory()

    return docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(each, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def book_of(counts: DataFrame, total: int, common: int = COMMON) -> Book:
    """The common words of counts (word, n)."""
    often = counts.where(F.octet_length("word") <= COMMON_BYTES).orderBy(F.col("n").desc(), "word").limit(common).toArrow()
    return Book(list(zip(often.column("word").to_pylist(), often.column("n").to_pylist(), strict=True)), total)


def score_texts(docs: DataFrame, counts: DataFrame, teaches: Column, key: str = "doc_id", page: int = PAGE, hot: int = HOT, common: int = COMMON) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row of
    docs(key, text), learnt from those that `teaches` holds for; counts as of count_words over these."""
    spark = docs.sparkSession
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, vocabulary = sums["n"] or 0, sums["v"]
    book = book_of(counts, total, common)
    sent = spark.sparkContext.broadcast(book)
    share_taught = docs.select(F.count("*").alias("all"), F.count(F.when(teaches, 1)).alias("taught")).first()
    # tokens of all rows, by those of the training rows
    tokens = total * share_taught["all"] / share_taught["taught"] if share_taught["taught"] else share_taught["all"]
    pages = max(1, math.ceil(tokens / page))
    kind_ = docs.schema[key].dataType.simpleString()
    names = ["page", "batch", "part", "_row", "_key", "n_tokens", "hits", "base", "n_bytes", "rare"]
    shape = f"_row bigint, _key {kind_}, n_tokens bigint, hits bigint, base double, n_bytes bigint, rare array<struct<word:binary,n:int>>"
    pair = pa.struct([("word", pa.binary()), ("n", pa.int32())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts, on pages by turns, and parts of pages."""
        book, batch = sent.value, None
        logs = np.append(np.log10(book.counts + 0.5), 0.0)
        end = -2 - ((crc32(END) & 0x3FFFFF) << 8 | kind(END)) if book.end is None else book.end
        none = lambda k, kinds: [pa.nulls(k, x) for x in kinds]
        about = [pa.int64(), None, pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pair)]

        def flushed() -> Iterator[pa.RecordBatch]:
            parts = list(batch.packed())
            for lo in range(0, len(parts), 64):
                ps = parts[lo : lo + 64]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in ps], pa.int32()), pa.array([batch.rows[0]] * len(ps), pa.int64()), pa.array([x for _, x in ps], pa.binary()), *none(len(ps), about)], names=names)

        for big in batches:
            about[1] = big.schema.field("_key").type
            for lo, k in slices(big.column("_text")):
                b = big.slice(lo, k)
                batch = batch or Batch(book, pages, hot)
                raw, begins, ends, h, lengths, size = words_of(b.column("_text"))
                # each text's words, then its end
                number = np.insert(book.numbers(h), np.cumsum(lengths), end)
                lengths = lengths + 1
                starts = np.cumsum(lengths) - lengths
                base = np.add.reduceat(logs.take(np.maximum(number, -1)), starts)
                hits = np.add.reduceat(number >= 0, starts, dtype=np.int64)
                new = np.flatnonzero(number < 0)
                doc = np.searchsorted(starts, new, "right") - 1
                is_end = new == starts[doc] + lengths[doc] - 1
                at = np.where(is_end, -1, new - doc)
                rare = [raw[x:y] if x < y else END for x, y in zip(np.append(begins, 0)[at].tolist(), np.append(ends, 0)[at].tolist(), strict=True)]
                number[new] = [-2 - ((crc32(w) & 0x3FFFFF) << 8 | kind(w)) for w in rare]
                # each text's words without a code, once
                h = np.append(h, np.uint64(0))[at]
                order = np.lexsort((h, doc))
                first = np.flatnonzero((np.diff(doc[order], prepend=-1) != 0) | (np.diff(h[order], prepend=np.uint64(0)) != 0))
                times = np.diff(np.append(first, len(order)))
                own = order[first]
                cuts = np.searchsorted(doc[own], np.arange(k + 1))
                rows = b.column("_row").to_pylist()
                batch.add(rows, b.column("_train").to_pylist(), b.column("_mix").to_pylist(), number, rare, lengths)
                flat_rare = pa.StructArray.from_arrays([pa.array([rare[i] for i in own.tolist()], pa.binary()), pa.array(times, pa.int32())], fields=list(pair))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r % pages for r in rows], pa.int32()), *none(k, [pa.int64(), pa.binary()]), b.column("_row"), b.column("_key"), pa.array(lengths, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat_rare)],
                    names=names,
                )
                if batch.size >= BATCH:
                    yield from flushed()
                    batch = None
        if batch is not None:
            yield from flushed()
        release_memory()

    def pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts as they are, and the sums of each part."""
        now, held, whose, told = None, [], [], []
        pack = zstandard.ZstdCompressor(level=1)

        def solved() -> Iterator[pa.RecordBatch]:
            raw = [pack.compress(_planes(np.diff(rows, prepend=0)) + _planes(score)) for rows, score in score_page(sent.value, held)]
            for lo in range(0, len(raw), 256):
                k = len(raw[lo : lo + 256])
                yield pa.RecordBatch.from_arrays([pa.array(whose[lo : lo + 256], pa.int64()), pa.array(raw[lo : lo + 256], pa.binary()), *[pa.nulls(k, t) for t in told]], names=names[1:])

        for b in batches:
            told = [b.schema.field(n).type for n in names[3:]]
            texts = b.filter(pc.is_valid(b.column("_row")))
            if texts.num_rows:
                yield pa.RecordBatch.from_arrays([texts.column(n) for n in names[1:]], names=names[1:])
            b = b.filter(pc.is_valid(b.column("part")))
            for p, w, x in zip(b.column("page").to_pylist(), b.column("batch").to_pylist(), b.column("part"), strict=True):
                if p != now and held:
                    yield from solved()
                    held, whose = [], []
                now = p
                held.append(x.as_py())
                whose.append(w)
        if held:
            yield from solved()
        release_memory()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        unpack = zstandard.ZstdDecompressor()

        def total_of() -> pa.RecordBatch:
            rows, scores = (np.concatenate(x) for x in zip(*held, strict=True))
            row, total = summed(rows, scores)
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(total)], names=["_row", "score"])

        for b in batches:
            for w, raw in zip(b.column("batch").to_pylist(), b.column("part"), strict=True):
                if w != now and held:
                    yield total_of()
                    held = []
                now = w
                x = unpack.decompress(raw.as_py())
                held.append((np.cumsum(_unplanes(x[: len(x) // 2], np.int64)), _unplanes(x[len(x) // 2 :], np.int64)))
        if held:
            yield total_of()

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.coalesce(teaches, F.lit(True)).alias("_train"), F.xxhash64(F.col(key).cast("string")).alias("_mix"), F.col("text").cast("binary").alias("_text"))
    coded = rows.mapInArrow(code, f"page int, batch bigint, part binary, {shape}").repartition(pages, "page").sortWithinPartitions("page")
    with few_rows(spark):
        paged = publish(coded.mapInArrow(pages_of, f"batch bigint, part binary, {shape}"), "pages")
    sums_ = paged.where("batch is not null").select("batch", "part").repartition("batch").sortWithinPartitions("batch").mapInArrow(added, "_row bigint, score bigint")
    part = paged.where("batch is null").select("_row", "_key", "n_tokens", "hits", "base", "n_bytes", "rare")
    rare = part.select("_row", F.explode("rare").alias("x")).select("_row", F.col("x.word").alias("word"), F.col("x.n").alias("times"))
    met = rare.join(counts, "word")
    # counts of rare words as whole numbers by count, so that the sum does not depend on the order of rows
    by = met.groupBy("_row").agg(F.sum("times").alias("more"), F.sum(F.round(F.log10(F.col("n") + 0.5) * 1e10).cast("bigint") * F.col("times")).alias("plus"))
    floor, share = math.log10(0.5), math.log10(total + 0.5 * (vocabulary + 1))
    out = part.drop("rare").join(by, "_row", "left").join(sums_, "_row").withColumn("n_known", F.col("hits") + F.coalesce("more", F.lit(0)))
    return out.select(
        F.col("_key").alias(key),
        "n_tokens",
        "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("plus") / 1e10, F.lit(0.0)) + (F.col("n_tokens") - F.col("n_known")) * floor - F.col("n_tokens") * share).alias("base_score"),
        (F.col("score") / SCALE).alias("score"),
        "n_bytes",
        (-F.col("score") / (SCALE * math.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    teaches = ~held_out(F.col("doc_id"), 1)
    with few_rows(spark):
        counts = publish(count_words(docs.where(teaches)), "word-counts")
    scored = score_texts(docs, counts, teaches)
    return scored.select("doc_id", held_out(F.col("doc_id"), 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
