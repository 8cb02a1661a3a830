"""Main text of HTML pages: boosted trees over the features of DOM nodes, and a decoding that is consistent over the tree.

Each element gets the log odds of being part of the article, from its own and its subtree's features: text and link density, tags,
attribute tokens, depth, and its place among its siblings. The decoding then calls each subtree in, out, or mixed, whatever makes the
sum of the log odds largest: below an element that is in nothing is out, and the other way round; only below a mixed one may
its children differ, at a price. The text of what is in is joined.

The trees learn on the driver from at most ``sample`` pages of which the article is known, those first by a hash of the url, and from pages
made from a rule (``made_pages``) that have what the sample may lack: sidebars, notices, forms, comments. Extraction is one narrow
pass in Arrow batches over whole pages.

Defined results: a null or empty html gives an empty text; unclosed and stray tags are repaired, a head without an end tag too; elements more than DEEPEST deep are
taken for siblings at that depth, with all their text; very long pages are read whole; scripts, styles, templates and the
head have no text; repeated rows give equal texts; null ids and urls are carried through; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import first_by_hash
from lexmill.llm.gbt import BoostedTrees

SAMPLE = 400
MIXED_PRICE = 1.0
DEEPEST = 400

# Fixed values of HTML: elements without content, without text, in running text, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title template noscript svg math iframe object audio video canvas select textarea".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
CLOSES |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
SCOPES = frozenset("html body table ul ol dl div article section main aside nav header footer form td th li blockquote".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
GROUPS = ["nav", "header", "footer", "aside", "article", "main", "section", "div", "p", "ul", "ol", "li", "form", "table", "blockquote"]

_TOKEN = re.compile(r"[a-z]+")
_BUCKETS = 24
_LONG_NUMBER = re.compile("&#([0-9]{8,})")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Page(HTMLParser):
    """Block elements of a page, in order: tag, parent, attribute tokens, links; and pieces of text: block, text, whether a block began before, whether linked.

    Elements in running text are no blocks: their text belongs to the block around them.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.tokens, self.links = ["#root"], [-1], [()], [0]
        self.pieces: list[tuple[int, str, bool, bool]] = []
        self.open = [0]
        self.silent = 0
        self.edge = True
        self.linked = False
        # a number that no character has stands for one, as in HTML; longer ones are more than int() reads
        self.feed(_LONG_NUMBER.sub(lambda m: f"&#{digits}" if len(digits := m[1].lstrip("0") or "0") < 8 else "&#1114112", html))
        self.close()
        self.weight = [0] * len(self.tag)
        for k, t, _, _ in self.pieces:
            self.weight[k] += len(t.strip())

    def parse_html_declaration(self, i: int) -> int:
        """An unknown ``<![``, which the parser gives up on, is a comment up to the next ``>``."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def _leave_head(self) -> None:
        """What can't stand in the head ends it, as its end tag may be left out."""
        if self.tag[self.open[-1]] == "head":
            self._pop(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in INLINE:
            if tag == "a":
                self.linked = any(name == "href" for name, _ in attrs)
                self.links[self.open[-1]] += self.linked
            return
        self.edge = True
        closes = CLOSES.get(tag)
        if closes:
            for k in range(len(self.open) - 1, 0, -1):
                t = self.tag[self.open[k]]
                if t in closes:
                    self._pop(k)
                    break
                if t in SCOPES and t not in closes:
                    break
        if tag in VOID:
            return
        words: tuple[str, ...] = ()
        for name, value in attrs:
            if value and name in ("class", "id", "role", "itemprop", "aria-label"):
                words += tuple(_TOKEN.findall(value.lower()))
        self.tag.append(tag)
        self.parent.append(self.open[-1] if len(self.open) < DEEPEST else self.open[DEEPEST - 1])
        self.tokens.append(words)
        self.links.append(0)
        self.open.append(len(self.tag) - 1)
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # an element of SVG or MathML ends where it says so, those without text in HTML don't
        ends = tag not in SILENT or tag in FOREIGN or self.silent and any(self.tag[k] in FOREIGN for k in self.open)
        if tag not in VOID and tag not in INLINE and ends and self.tag[self.open[-1]] == tag:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.linked = self.linked and tag != "a"
            return
        self.edge = True
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] == tag:
                self._pop(k)
                return

    def _pop(self, k: int) -> None:
        for n in self.open[k:]:
            self.silent -= self.tag[n] in SILENT
        del self.open[k:]

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._leave_head()
        if not self.silent:
            self.pieces.append((self.open[-1], data, self.edge, self.linked))
            self.edge = False

    def features(self) -> list[list[float]]:
        """A row for each element."""
        n = len(self.tag)
        own_text, links, marks, below, depth, children, place = self.weight, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n, [0] * n
        for k in range(1, n):
            p = self.parent[k]
            depth[k] = depth[p] + 1
            place[k] = children[p]
            children[p] += 1
        for k, t, _, linked in self.pieces:
            if linked:
                links[k] += len(t.strip())
            marks[k] += len(_PUNCTUATION.findall(t))
        text, longest = own_text[:], own_text[:]
        n_links = self.links[:]
        n_p = [int(t in ("p", "br")) for t in self.tag]
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            text[p] += text[k]
            links[p] += links[k]
            marks[p] += marks[k]
            below[p] += below[k]
            n_links[p] += n_links[k]
            n_p[p] += n_p[k]
            longest[p] = max(longest[p], longest[k])
        total = max(text[0], 1)
        # what an element inherits: the nearest ancestor of a telling kind, and the tokens on the way down
        kind, bag = [-1] * n, [frozenset()] * n
        rows = []
        for k in range(n):
            p = self.parent[k]
            tag = self.tag[k]
            above = kind[p] if k else -1
            kind[k] = GROUPS.index(tag) if tag in GROUPS[:7] else above
            bag[k] = (bag[p] if k else frozenset()) | {zlib.crc32(w.encode()) % _BUCKETS for w in self.tokens[k]}
            siblings = children[p] if k else 1
            rows.append(
                [
                    depth[k], place[k], siblings - place[k], siblings, place[k] / siblings, below[k], children[k], text[k], own_text[k], longest[k], text[k] / total, text[k] / below[k],
                    links[k] / max(text[k], 1), n_links[k] / below[k], marks[k] / max(text[k], 1) * 100, n_p[k], text[p] / total if k else 1.0, GROUPS.index(tag) if tag in GROUPS else (21 if tag[0] == "h" and tag[1:].isdigit() else 22),
                    above, kind[k], *(float(b in bag[k]) for b in range(_BUCKETS)),
                ]
            )
        return rows

    def decode(self, odds: list[float]) -> list[bool]:
        """Which elements are in; consistent over the tree."""
        n = len(self.tag)
        inside = [o * (1 + min(w, 2000) ** 0.5) for o, w in zip(odds, self.weight)]
        own = inside[:]
        mixed = [-MIXED_PRICE] * n  # sums of the children's best values
        best = [0.0] * n
        choice = [0] * n
        for k in range(n - 1, -1, -1):
            mixed[k] += abs(own[k])
            best[k], choice[k] = max((inside[k], 1), (-inside[k], 0), (mixed[k], 2)) if inside[k] or mixed[k] > 0 else (0.0, 0)
            if k:
                p = self.parent[k]
                inside[p] += inside[k]
                mixed[p] += best[k]
        keep = [False] * n
        settled = [2] * n
        for k in range(n):
            above = settled[self.parent[k]] if k else 2
            settled[k] = choice[k] if above == 2 else above
            keep[k] = settled[k] == 1 or (settled[k] == 2 and own[k] > 0)
        return keep

    def text(self, keep: list[bool]) -> str:
        out: list[str] = []
        gap = False
        for k, t, edge, _ in self.pieces:
            gap = gap or edge
            if keep[k]:
                if gap:
                    out.append(" ")
                out.append(t)
                gap = False
            else:
                gap = True
        return " ".join("".join(out).split())


def _known(page: Page, article: str) -> list[int | None]:
    """1 and 0 for elements whose text is, or isn't, nearly all of the article; None for others."""
    lines = {" ".join(x.split()) for x in article.split("\n")}
    whole = " ".join(article.split())
    n = len(page.tag)
    good, all_ = [0] * n, [0] * n
    for k, t, _, _ in page.pieces:
        t = " ".join(t.split())
        if t:
            all_[k] += len(t)
            if t in lines or (len(t) > 40 and t in whole) or (len(t) > 8 and whole.startswith(t)):
                good[k] += len(t)
    for k in range(n - 1, 0, -1):
        good[page.parent[k]] += good[k]
        all_[page.parent[k]] += all_[k]
    return [None if not a or 0.1 * a < g < 0.9 * a else int(g >= 0.9 * a) for g, a in zip(good, all_)]


def made_pages(count: int = 120, seed: int = 7) -> list[tuple[str, str]]:
    """Pages made from a rule, with their articles."""
    r = random.Random(seed)
    syllables = ["ka", "ri", "to", "men", "sol", "ve", "an", "ter", "lu", "dis", "po", "ran"]

    def words(n: int) -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(r.randint(1, 3))[:-1]}</a></li>' for i in range(n)) + "</ul>"

    extras = [
        lambda: f"<nav>{links(r.randint(3, 9))}</nav>",
        lambda: f'<div class="{r.choice(["menu", "nav", "breadcrumbs", "navigation"])}">{links(r.randint(3, 9))}</div>',
        lambda: f"<header><div>{words(4)}</div>{links(3)}</header>",
        lambda: f'<div id="header" class="banner">{words(5)}</div>',
        lambda: f'<aside class="sidebar"><h3>{words(2)}</h3>{links(5)}<p>{words(12)}</p></aside>',
        lambda: f'<div class="{r.choice(["sidebar", "related", "widget"])}"><h4>{words(2)}</h4>{links(4)}</div>',
        lambda: f'<div class="{r.choice(["ad", "ads", "advert", "sponsored", "promo"])}">{words(r.randint(4, 25))}</div>',
        lambda: f'<div class="{r.choice(["cookie notice", "notice", "consent", "alert"])}" role="alertdialog">{words(r.randint(8, 25))}<button>{words(1)}</button></div>',
        lambda: f'<form class="{r.choice(["newsletter", "search", "login"])}"><label>{words(3)}</label><input type="text"><button>{words(1)}</button></form>',
        lambda: f"<footer>&copy; {words(3)} &middot; {words(r.randint(5, 14))}</footer>",
        lambda: f'<div id="footer">{links(4)}<p>{words(8)}</p></div>',
    ]
    comments = lambda: f'<{"section" if r.random() < 0.5 else "div"} class="comments" id="comments"><h3>{words(2)}</h3>' + "".join(f'<div class="comment"><p>{words(r.randint(5, 40))}</p></div>' for _ in range(r.randint(1, 5))) + "</div>"
    out = []
    for _ in range(count):
        paragraphs = [words(r.randint(r.choice([2, 10]), 90)) for _ in range(r.randint(1, 9))]
        title = words(r.randint(3, 9))[:-1]
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        body = r.choice(["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main" class="post entry">{}</div>', '<main><article class="article">{}</article></main>', "{}", "{}"]).format(body)
        titled = r.random() < 0.7
        if not titled:
            body = body.replace(f"<h1>{title}</h1>", "")
        bare = r.random() < 0.25
        before = "".join(r.choice(extras)() for _ in range(0 if bare else r.randint(1, 4)))
        after = "".join(r.choice([*extras, comments])() for _ in range(0 if bare else r.randint(1, 4)))
        out.append((f"<html><head><title>{title}</title></head><body>{before}{body}{after}</body></html>", "\n".join([title] * titled + paragraphs)))
    return out


def train_extractor(pages: list[tuple[str, str]]) -> BoostedTrees:
    """Fit on (html, article) pairs."""
    x, y = [], []
    for html, article in pages:
        page = Page(html)
        for row, label in zip(page.features(), _known(page, article)):
            if label is not None:
                x.append(row)
                y.append(label)
    return BoostedTrees(rounds=40, depth=4, rate=0.3).fit(np.array(x, dtype=float).reshape(len(x), -1), np.array(y, dtype=float))


def extract(html: str | None, model: BoostedTrees) -> str:
    return extract_all([html], model)[0]


def extract_all(htmls: list[str | None], model: BoostedTrees) -> list[str]:
    """Main texts; the trees see the elements of all pages at once."""
    pages = [Page(h or "") for h in htmls]
    rows = [p.features() for p in pages]
    odds = model.decide(np.array([x for r in rows for x in r], dtype=float)).tolist()
    out, at = [], 0
    for page, r in zip(pages, rows):
        out.append(page.text(page.decode(odds[at : at + len(r)])))
        at += len(r)
    return out


def sample_articles(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``sample`` (html, article) pairs: pages whose url ends in the id of a document that holds their article."""
    key = F.regexp_extract("url", r"://[^/?#]*/[a-z]*/?(\d+)", 1)
    # the sample has a size bound, so it is broadcast
    picked = pages.filter("html IS NOT NULL AND url IS NOT NULL").select(key.alias("key"), "url", "html").filter("key != ''")
    picked = first_by_hash(picked, "url", sample)
    found = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("key"), "text").join(F.broadcast(picked), "key")
    # ids may repeat: one document a page, so that no more rows than pages go to the driver
    one = found.groupBy("url").agg(F.min(F.struct("html", "text")).alias("x")).select("url", "x.html", "x.text")
    rows = sorted((r["url"], r["html"], r["text"]) for r in one.collect())
    return [(h, t) for _, h, t in rows]


def extract_text(pages: DataFrame, model: BoostedTrees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("__html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = extract_all(part.column("__html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=[id_col, "url", "text", "n_chars"])

    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, url string, text string, n_chars long")
