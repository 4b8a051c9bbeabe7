"""Main text of web pages as the maximum-scoring run of words and tags.

A page becomes a sequence of units: words score above zero, tags below, and a whole boilerplate element (menu, header,
footer, sidebar, notice, advert, form, script, style, reader comments) counts as one negative unit whose text
never enters. A linear scan finds the contiguous run of greatest sum; the words of that run are the text.

A unit is told apart by where it stands: within an article or main element, outside of one on a page that has one, or on a page that has none.
The scores are log-odds of lying in the article, counted on labelled pages. No labelled pages come with the data, so
they are generated here from page layouts with known articles (labelled_pages); scores are clipped so that
words stay above zero (at most 1 on pages without such an element, where only the run itself tells blocks apart) and tags below. Tags that no labelled page has score next to nothing.

What is boilerplate is told by names before the scan: of elements, roles, and of class or id words (whole ones: every part of the
word has to be a mark or a filler, so that `side-by-side` or `notice-board` are none).

Text: character references are decoded once, white space in a block becomes one space, block elements and line breaks
part blocks, and blocks are joined by one space.

Defined results: null and empty pages, and pages without article words, give an empty text; unclosed elements end with
their parent, unclosed comments and scripts at the page's end; repeated rows each get a row; null ids and urls pass
through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Fixed values of HTML: elements without content, with raw text, and those that don't break a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of these ends where another of its group begins.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
#: Elements, roles and words of class or id that mark what is not the article, and parts that such words may also have.
BOILER = set("head nav header footer aside form script style title textarea noscript iframe xmp noembed noframes button select option template svg canvas object dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = set(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notices alert newsletter subscribe subscription signup login popup modal overlay sidebar side widget widgets related recommended
    teaser share sharing social breadcrumb breadcrumbs pagination pager menu nav navbar navigation topbar header masthead footer copyright
    comment comments comentarios commentaires kommentare disqus reply replies respond discussion toolbar search skip paywall""".split()
)
FILLERS = set(
    """site page main top bottom left right primary secondary global box bar list block container wrapper wrap area section slot unit inner outer
    panel buttons button links link posts post entry article articles items item content text form group col column row zone rail body
    mobile desktop sticky fixed js the my b c d""".split()
)
#: A tag's attributes may hold any character in quotes after an equals sign; an open quote is a character like others.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>|<[/a-zA-Z][^>]*\Z", re.S)
_ATTR = re.compile(r"""(?<![^\s"'/])([^\s"'/=>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])")


def _mark(word: str, inside: bool) -> bool:
    """Whether a class or id word names boilerplate; within an article a header is none."""
    parts = [p.lower() for p in _PART.findall(word)]
    marks = [p for p in parts if p in MARKS and not (inside and p in ("header", "masthead"))]
    return bool(marks) and all(p in MARKS or p in FILLERS for p in parts)


def _marked(name: str, attrs: str, inside: bool = False) -> bool:
    """Whether an element is boilerplate by its name or attributes; inside: it stands in an article or main element."""
    if name in BOILER:
        return True
    if not attrs or name in ("html", "body", "article", "main") and "class" not in attrs.lower():
        return False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            if value.lower() in ROLES:
                return True
        elif key in ("class", "id"):
            if name not in ("html", "body", "main") and any(_mark(w, inside) for w in value.split()):
                return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def units(page: str) -> list[tuple[str, str]]:
    """(kind, text): kind is `word` or `link` with a piece of text, `<name` or `</name`, `block`, or `boiler`."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool]] = []
    hidden = links = 0  # open boilerplate elements, open links
    at = 0

    def close(depth: int) -> None:
        nonlocal hidden, links
        while len(stack) > depth:
            name, mark = stack.pop()
            links -= name == "a"
            if mark:
                hidden -= 1
                if not hidden:
                    out.append(("boiler", ""))

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = "" if hidden else entities.unescape(page[at : m.start() if m else n])
        if text:
            out.append(("link" if links else "word", text))
        if not m:
            break
        at = m.end()
        end, name, attrs = m[1], m[2], m[3]
        if not name:
            continue
        name = name.lower()
        if end:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            marked = depth is not None and stack[depth][1]
            if depth is not None:
                close(depth)
            if not hidden and not marked:
                out.append(("</" + name, ""))
            continue
        if name == "body":
            close(next((k for k, (x, _) in enumerate(stack) if x == "head"), len(stack)))
        group = IMPLIED.get(name) or ({"p"} if name in ENDS_P else None)
        if group:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in group:
                    close(k)
                    break
                if stack[k][0] not in INLINE and stack[k][0] != "p":
                    break
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = stop.end()
            if not hidden:
                out.append(("boiler", ""))
            continue
        mark = _marked(name, attrs, any(x in ("article", "main") for x, _ in stack))
        if not hidden and not mark:
            out.append(("<" + name, ""))
        if name in VOID or attrs.endswith("/") and name not in ("a", "p", "div", "span"):
            continue
        if mark and name == "header" and any(x in ("article", "main") for x, _ in stack):
            inner = page[at : page.find("</header", at) if page.find("</header", at) >= 0 else n]
            mark = re.search(r"<h1[\s>]", inner, re.I) is None
        hidden += mark
        links += name == "a"
        stack.append((name, mark))
    close(0)
    return out


def placed(us: list[tuple[str, str]]) -> list[str]:
    """Kinds of units by where they stand: `in` an article or main element, `out` of one that the page has, or neither."""
    has = any(kind in ("<article", "<main") for kind, _ in us)
    depth, out = 0, []
    for kind, _ in us:
        depth -= kind in ("</article", "</main")
        out.append(f"in {kind}" if depth > 0 else f"out {kind}" if has else kind)
        depth += kind in ("<article", "<main")
    return out


def labelled_pages(n: int = 240, seed: int = 7) -> list[tuple[str, str, str]]:
    """(html before the article, the article, html after it) of pages of a few layouts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 2)}</a>'
    several = lambda a, b, f: "".join(f() for _ in range(r.randint(a, b)))
    blocks = [
        lambda: f"<p>{words(8, 60)}</p>",
        lambda: f"<p>{words(8, 60)} {link()} {words(4, 20)}</p>",
        lambda: f"<p>{words(8, 40)} <b>{words(1, 3)}</b> {words(2, 9)}",
        lambda: f"<p>{words(3, 20)}<br>{words(3, 20)}<br/>{words(1, 9)}</p>",
        lambda: f"<blockquote><p>{words(8, 60)}</p></blockquote>",
        lambda: f"<ul>{several(2, 9, lambda: f'<li>{words(1, 12)}</li>')}</ul>",
        lambda: f"<ol>{several(2, 9, lambda: f'<li><p>{words(1, 20)}</p></li>')}</ol>",
        lambda: f"<table>{several(1, 6, lambda: f'<tr><td>{word()}</td><td>{words(1, 3)}</td></tr>')}</table>",
        lambda: f"<dl>{several(1, 4, lambda: f'<dt>{word()}</dt><dd>{words(2, 9)}</dd>')}</dl>",
        lambda: f"<h2>{words(2, 6)}</h2><hr><p>{words(9, 40)}</p>",
        lambda: f"<div><p>{words(8, 60)}</p></div>",
        lambda: f'<section><h3>{words(1, 5)}</h3><div><p>{words(5, 40)}</p></div></section>',
        lambda: f"<figure><figcaption>{words(2, 9)}</figcaption></figure><pre><code>{words(2, 9)}</code></pre>",
        lambda: f'<div class="ad">{words(3, 12)}</div>',
    ]
    out = []
    for k in range(n):
        article = f"<h1>{words(3, 9)}</h1>" + several(2, 14, lambda: r.choice(blocks)())
        menu = several(3, 9, lambda: f"<li>{link()}</li>")
        before = r.choice([f"<nav><ul>{menu}</ul></nav>", f"<div><ul>{menu}</ul></div>", f"<header>{link()}</header><div>{link()} {link()}</div>", f"<div><p>{words(1, 6)}</p></div>"])
        after = r.choice([f"<footer>{words(3, 15)}</footer>", f"<div>{link()} {link()} {link()}</div><footer>{words(2, 8)}</footer>", f"<section><ul>{menu}</ul></section>", f"<div>{words(1, 4)}</div>"])
        a, b = [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ("<main><article>", "</article></main>"), ("<div><div>", "</div></div>")][k % 5]
        out.append((f"<html><head><title>{words(2, 8)}</title></head><body>{before}{a}", article, f"{b}{after}</body></html>"))
    return out


def learn_scores(pages: list[tuple[str, str, str]]) -> dict[str, float]:
    """Log-odds of each kind of unit, words counted one by one; above zero for words, below for the rest."""

    def count(page: str, lo: str, hi: str) -> tuple[Counter, Counter]:
        """Counts of the kinds of a page's units, all and of those between the marks."""
        found, whole, part, on = units(page), Counter(), Counter(), False
        for kind, (_, text) in zip(placed(found), found, strict=True):
            words = text.split()
            for w in words if words else [""]:
                if w in (lo, hi):
                    on = w == lo
                    continue
                if w or not text:
                    whole[kind] += 1
                    part[kind] += on
        return whole, part

    inside, outside = Counter(), Counter()
    for before, article, after in pages:
        whole, part = count(f"{before} \x01 {article} \x02 {after}", "\x01", "\x02")
        inside += part
        outside += whole - part
    base = math.log((sum(outside.values()) + 1) / (sum(inside.values()) + 1))
    scores = {}
    for where in ("", "in ", "out "):
        for k in {*(x.removeprefix(where) for x in {*inside, *outside} if where in x[: len(where)] and (where or x[:3] != "in " and x[:4] != "out ")), "word", "link", "boiler"}:
            odds = math.log((inside[where + k] + 0.5) / (outside[where + k] + 0.5)) + base
            if k in ("word", "link"):
                scores[where + k] = min(3.0 if where else 1.0, max(0.3 if k == "word" and where != "out " else 0.1, odds))
            else:
                scores[where + k] = max(-1.0 if k == "boiler" else -6.0, min(-0.02, odds))
    return scores


_SCORES: dict[str, float] = {}
#: The score of tags that no labelled page has.
UNKNOWN = -0.02


def scores() -> dict[str, float]:
    if not _SCORES:
        _SCORES.update(learn_scores(labelled_pages()))
    return _SCORES


def best_run(values: list[float]) -> tuple[int, int]:
    """First and last place (exclusive) of the contiguous run of greatest sum; empty if no value is above zero. Of equal
    runs the first, at its longest."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, v in enumerate(values):
        if run <= 0:
            run, start = 0.0, i
        run += v
        if run > best:
            best, found = run, (start, i + 1)
    return found


def extract(page: str, table: dict[str, float] | None = None) -> str:
    """The main text of a page."""
    table = table or scores()
    us = units(page)
    values = [table.get(kind, UNKNOWN) * (len(text.split()) if raw in ("word", "link") else 1) for kind, (raw, text) in zip(placed(us), us, strict=True)]
    lo, hi = best_run(values)
    parts = []
    for kind, text in us[lo:hi]:
        if kind in ("word", "link"):
            parts.append(text)
        elif kind == "boiler" or kind.lstrip("</") not in INLINE:
            parts.append(" ")
    return " ".join("".join(parts).split())


def extract_column(pages: DataFrame, html: str = "html", text: str = "text", length: str = "n_chars") -> DataFrame:
    """pages without html, with text and its length in code points; columns of these names are replaced."""
    keep = [f for f in pages.schema.fields if f.name not in (html, text, length)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py() or "") for x in b.column(html)]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[f.name for f in keep] + [text, length])

    return pages.select(*[f.name for f in keep], html).mapInArrow(each, StructType([*keep, StructField(text, StringType()), StructField(length, LongType())]))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_column(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
