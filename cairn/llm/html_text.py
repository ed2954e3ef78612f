"""Main text of web pages: flat text blocks with features of their neighbours, classified by a decision tree.

A page is cut at block-level tags into flat text blocks. Each block has its word count and link density, those of
the blocks before and after it, and marks of the elements that it stands in. A CART tree, trained here on the
blocks of the small labelled pages below, decides which blocks are main text. Where a page marks its article, the marks
settle nearly everything; on pages without such marks the counts and densities of a block and its neighbours do.

Defined results: null html is empty and gives the empty text; a page with no block gives the empty text; unclosed
and stray tags are closed as browsers do; a tag without an end ends before the next tag; text of an inline element with other
marks than its block (hidden, an advert, a fallback of media) is a block of its own, after that block; white space inside a
block becomes one space; repeated rows come back once each; an empty table gives an empty table; other columns are not read.
Time and memory are in proportion to the page, whatever it holds.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SLICE = 8 << 20

# HTML element names by role.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text that no tag ends but their own.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BOILER = frozenset("nav header footer aside form menu button dialog fieldset label legend".split())
#: What a browser doesn't show as text of the page.
UNSEEN = frozenset("noscript template object canvas audio video select datalist annotation annotation-xml desc metadata".split())
MAIN = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a part of a text: only the words of ADVERTS count in their class and id.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figure figcaption caption span b i em strong a u s small sub sup code q cite abbr mark font time".split())
HINTS = frozenset("ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion sidebar aside widget widgets related recommended recommendations popular trending share sharing social follow cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin register search breadcrumb breadcrumbs pagination pager menu nav navbar navigation header masthead topbar toolbar footer copyright legal disclaimer tags meta byline skip".split())
ADVERTS = frozenset("ad ads advert adverts advertisement adbox sponsor sponsored cookie cookies newsletter".split())
TALK = frozenset("comment comments reply replies respond disqus discussion".split())
#: A class of nothing but these names the main text, whatever other classes stand beside it.
BODY = frozenset("main content article post entry body story text".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
# End tags of these are optional: a start tag closes an open one of the same group.
CLOSED_BY = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "li", "dd", "dt", "button", "label", "legend", "caption", "option"}
SCOPES = frozenset("ul ol dl table div section article".split())

#: Comments and declarations, bogus end tags, and tags: quotes count after an equals sign only, and nothing is read twice.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?--!?>|.*\Z) | <[!?][^>]*+>? | </[^a-zA-Z][^>]*+>?
    | <(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>"'][^\s<>]*+)?+)*+)(?:>|(?=<)|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""(?<![^\s"'/])([^\s"'=<>/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_WORD = re.compile(r"\S+")
_ASKED = frozenset("class id role hidden style aria-hidden".split())

#: place: 0 in marked boilerplate, or outside the article that the page marks; 2 in that article; 1 where no mark says anything.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "heading")
#: In main text, in boilerplate (1: by a form or an unseen element, 2: by others), hinted at by class or id (2: among comments).
Marks = tuple[int, int, int]
Block = tuple[str, int, int, int, int, int, int]


def _hint(name: str, marks: dict[str, str]) -> int:
    """What class and id say of an element: 2 for talk, 1 for other boilerplate, 0 for nothing."""
    classes = f"{marks.get('class', '')} {marks.get('id', '')}".split()
    parts = [set(re.split(r"[_-]+", c)) for c in classes]
    words = set().union(*parts)
    if words & TALK:
        return 2
    if name in PARTS:
        return int(bool(words & ADVERTS))
    return int(bool(words & HINTS) and not any(p <= BODY for p in parts))


def blocks(page: str) -> list[Block]:
    """(text, words, linked words, in main, in boilerplate, hinted, heading) of each flat block, in page order."""
    out: list[Block] = []
    parts: list[tuple[str, bool, Marks]] = []
    stack: list[tuple[str, Marks]] = [("", (0, 0, 0))]
    held: Counter[str] = Counter()
    links, head, at, size = 0, 0, 0, len(page)

    def say(text: str) -> None:
        parts.append((entities.unescape(text) if "&" in text else text, links > 0, stack[-1][1]))

    def flush() -> None:
        # a block has its own marks; what an inline element marks otherwise follows as a block of its own
        for marks in dict.fromkeys([stack[-1][1], *(m for _, _, m in parts)]) if parts else ():
            own = [(p, a) for p, a, m in parts if m == marks]
            text = " ".join("".join(p for p, _ in own).split())
            if text:
                linked = sum(len(_WORD.findall(p)) for p, a in own if a)
                out.append((text, text.count(" ") + 1, linked, marks[0], min(marks[1], 1), min(marks[2], 1), head))
        parts.clear()

    def cut(k: int) -> None:
        for name, _ in stack[k:]:
            held[name] -= 1
        del stack[k:]

    def close(name: str) -> None:
        if held[name]:
            cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
                links = 0
                if name in HEADING:
                    head = 0
                close(name)
            elif name == "a":
                links = 0
            else:
                close(name)
            continue
        if name in RAW:
            if name in BLOCK:
                flush()
            if not (m[3].endswith("/") and held["svg"]):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name == "br":
            parts.append((" ", links > 0, stack[-1][1]))
            continue
        if name == "hr":
            flush()
            continue
        if name in VOID:
            continue
        if name == "a":
            links = 1
        if name in BLOCK:
            flush()
            head = 1 if name in HEADING else 0
            if name in ENDS_P:
                close("p")
            closed = CLOSED_BY.get(name, ())
            if any(held[x] for x in closed):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closed:
                        cut(k)
                        if name != "tr" or not any(held[x] for x in closed):
                            break
                    elif stack[k][0] in SCOPES:
                        break
        main, boiler, hint = stack[-1][1]
        marks = {k: v.strip("\"'").lower() for k, v in ((x.lower(), y) for x, y in _ATTR.findall(m[3])) if k in _ASKED} if m[3] else {}
        if "hidden" in marks or marks.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", marks.get("style", "")):
            boiler = 2
        own = _hint(name, marks) if marks else 0
        if name in MAIN and own < 2 and hint < 2 and boiler < 2:
            main, boiler, hint = 1, 0, 0
        else:
            if name in BOILER or name in UNSEEN or marks.get("role") in ROLES:
                boiler = max(boiler, 1 if name == "form" or name in UNSEEN else 2)
            if name not in ("html", "body"):
                hint = max(hint, own)
        if name in BLOCK or name == "svg" or (main, boiler, hint) != stack[-1][1]:
            if name != "a" or (main, boiler, hint) != stack[-1][1]:
                stack.append((name, (main, boiler, hint)))
                held[name] += 1
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row a block, in the order of FEATURES."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([f[1] for f in found], float)
        links = np.minimum(1, np.array([f[2] for f in found], float) / words)
        x[:, 0], x[:, 1] = words, links
        x[1:, 2], x[1:, 3], x[:-1, 4], x[:-1, 5] = words[:-1], links[:-1], words[1:], links[1:]
        main, boiler, hinted, x[:, 7] = np.array([f[3:7] for f in found]).T
        x[:, 6] = np.where((boiler > 0) | (hinted > 0), 0, np.where(main > 0, 2, 0 if main.any() else 1))
    return x


def written(layout: str) -> str:
    """A labelled page's html: {m7} is main text of seven words, {b7} is not."""
    return re.sub(r"\{([mb])(\d+)\}", lambda m: " ".join(["main" if m[1] == "m" else "boil"] * int(m[2])), layout)


def labelled(layouts: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    pages = [blocks(written(x)) for x in layouts]
    return np.concatenate([features(p) for p in pages]), np.array([f[0].startswith("main") for p in pages for f in p], float)


def _menu(n: int, words: int = 1) -> str:
    return "<ul>" + f"<li><a href=x>{{b{words}}}</a></li>" * n + "</ul>"


def _row(*cells: str) -> str:
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def _all_sorts(label: str, turn: int) -> str:
    """Blocks of all lengths and link densities, with lengths and an order of their own for each `turn`."""
    grown = lambda n: n + n * turn // 9
    made = [f"<p>{{{label}{grown(n)}}}</p>" for n in (1, 2, 6, 15, 25, 40, 70, 100, 300)]
    made += [f"<p><a>{{{label}{grown(n)}}}</a></p>" for n in (1, 1, 2, 3, 4, 6, 9, 14, 30, 60)]
    made += [f"<p>{{{label}{grown(n)}}} <a>{{{label}{k}}}</a></p>" for n, k in ((3, 1), (5, 5), (9, 1), (20, 4), (28, 2), (60, 20), (90, 10), (150, 5))]
    made += [f"<h2>{{{label}{grown(n)}}}</h2>" for n in (2, 8)]
    return "".join(made[(k * (2 * turn + 1) + turn) % len(made)] for k in range(len(made)))


# The labelled table: small pages made by hand for this library after common layouts. The text of a block is its label.
LAYOUTS = (
    # the article is marked; menus, adverts, notices, sidebars and footers of every length stand outside it
    f"<nav>{_menu(5)}</nav><div class=ad>{{b14}}</div><article><h1>{{m9}}</h1><p>{{m80}}</p><p>{{m1}}</p><p>{{m3}}</p><p>{{m150}}</p></article><footer>{{b9}}</footer>",
    f"<header><p>{{b2}}</p>{_menu(6)}</header><main><h1>{{m4}}</h1><p>{{m2}}</p><p>{{m30}} <a>{{m5}}</a> {{m20}}</p><ul><li>{{m6}}</li><li>{{m2}}</li><li>{{m12}}</li></ul></main><aside><h3>{{b2}}</h3>{_menu(4, 5)}<p>{{b70}}</p></aside><footer><p>{{b120}}</p></footer>",
    "<div class=notice>{b22}</div><nav><a>{b1}</a> <a>{b1}</a> <a>{b1}</a></nav><article><p>{m400}</p><p>{m1}</p></article><div class=ad>{b64}</div><footer>{b31}</footer>",
    "<div>{b45}</div><h3>{b3}</h3><p>{b120}</p><article><h1>{m10}</h1><p><a>{m1}</a></p><p><a>{m3}</a></p><p>{m60}</p><div class=ad>{b30}</div><p>{m45}</p><blockquote>{m25}</blockquote><p>{m5}</p></article><p>{b60}</p><p>{b4}</p>",
    "<article><h1>{m3}</h1><p>{m70}</p><h2>{m2}</h2><p>{m200}</p><div class=share><a>{b1}</a> <a>{b1}</a></div><p>{m90}</p><section class=comments><h2>{b3}</h2><p>{b40}</p><p>{b5}</p><p>{b150}</p></section></article><div class=related><h3>{b2}</h3>" + _menu(3, 8) + "</div>",
    "<form><p>{b6}</p><label>{b2}</label></form><article><table>" + _row("{m1}", "{m2}", "{m1}") * 3 + "</table><p>{m12}</p><form><label>{b3}</label><p>{b40}</p><button>{b1}</button></form><p>{m2}</p></article><div id=comments><p>{b80}</p><p>{b12}</p><p>{b1}</p></div><footer>{b60}</footer>",
    f"<div class=cookie>{{b35}}</div><div class=menu>{_menu(8)}</div><main><p>{{m500}}</p><h2>{{m1}}</h2><p>{{m1}}</p><div class=newsletter><h3>{{b4}}</h3><p>{{b20}}</p></div><p><a>{{m8}}</a></p></main><div class=sidebar><p>{{b90}}</p><p>{{b200}}</p></div>",
    "<article><p>{m1}</p></article><footer>{b300}</footer>",
    "<div class=ad>{b400}</div><article><p>{m3}</p></article><div class=comments><p>{b500}</p></div>",
    # what stands in an article is its text, and what stands outside or in a marked part is not, whatever it looks like
    f"<div>{_all_sorts('b', 1)}</div><article>{_all_sorts('m', 2)}</article><div>{_all_sorts('b', 3)}</div>",
    f"<nav>{_all_sorts('b', 4)}</nav><main>{_all_sorts('m', 5)}</main><footer>{_all_sorts('b', 6)}</footer>",
    f"<div class=ad>{_all_sorts('b', 7)}</div><article>{_all_sorts('m', 1)}<div class=ad>{_all_sorts('b', 9)}</div>{_all_sorts('m', 3)}<aside>{_all_sorts('b', 5)}</aside></article>",
    f"<main>{_all_sorts('m', 7)}<div class=comments>{_all_sorts('b', 2)}</div></main><div>{_all_sorts('b', 8)}</div>",
    f"<article>{_all_sorts('m', 9)}<form>{_all_sorts('b', 1)}</form>{_all_sorts('m', 4)}</article><div>{_all_sorts('b', 5)}</div>",
    # no marks at all: menus, texts and footers in plain divs
    f"<div>{_menu(6)}</div><div><h1>{{m8}}</h1><p>{{m40}}</p><p>{{m55}}</p><p>{{m3}}</p><p>{{m60}}</p></div><div><p>{{b9}}</p></div>",
    "<div><a>{b1}</a> <a>{b2}</a> <a>{b1}</a></div><div>{b4}</div><h2>{m5}</h2><div>{m25}</div><div>{m70}</div><div>{m2}</div><div>{m130}</div><div><a>{b2}</a></div><div><a>{b3}</a></div><div>{b8}</div>",
    "<table>" + _row("<a>{b1}</a>", "<a>{b2}</a>", "<a>{b1}</a>") + _row("<a>{b4}</a>", "<p>{m40}</p><p>{m90}</p><p>{m18}</p>") + _row("{b6}", "<a>{b3}</a>") + "</table>",
    f"<div>{_menu(4, 2)}</div><p>{{m30}} <a>{{m6}}</a> {{m12}}</p><p>{{m45}}</p><p>{{m1}}</p><p>{{m22}}</p><p>{{m300}}</p><h3>{{b3}}</h3>{_menu(5, 6)}<p>{{b12}}</p>",
    "<p>{m20}</p><p>{m50}</p><p>{m7}</p><p>{m28}</p>",
    "<p>{m90}</p>",
    f"<div class=menu>{_menu(3)}</div><h2>{{m4}}</h2><p>{{m14}}</p><p>{{m1}}</p><p>{{m10}} <a>{{m2}}</a> {{m8}}</p><p>{{m16}}</p><div class=footer>{{b6}}</div>",
    f"<div>{_menu(5)}</div><h1>{{m3}}</h1><p>{{m11}}</p><p>{{m2}}</p><p>{{m13}}</p><p>{{m9}} <a>{{m1}}</a> {{m3}}</p><div>{_menu(4)}</div>",
    "<h2>{m5}</h2><p>{m20}</p><p>{m1}</p><p>{m8} <a>{m1}</a> {m3}</p><aside><p>{b16}</p></aside><p>{m9} <a>{m1}</a> {m4}</p><p>{m1}</p><p>{m14}</p>",
    f"<div>{_menu(4)}</div><p>{{m18}}</p><p>{{m1}}</p><p>{{m9}} <a>{{m1}}</a></p><p>{{m24}}</p><p>{{m1}}</p><p>{{m15}} <a>{{m2}}</a></p>",
    "<h1>{m6}</h1><p>{m5}</p><p>{m60}</p><ul><li>{m9}</li><li>{m14}</li><li>{m11}</li></ul><p>{m35}</p><div><a>{b1}</a></div><div><a>{b1}</a></div><div><a>{b2}</a></div><div>{b5}</div>",
    "<div>{b3}</div><div><a>{b1}</a></div><div><a>{b1}</a></div><div>{b5}</div><div><a>{b3}</a></div><div>{m100}</div><div>{m4}</div><div>{m85}</div><div>{b6} <a>{b4}</a></div><div>{b3} <a>{b6}</a></div><div>{b11}</div>",
    f"<h3>{{b2}}</h3>{_menu(7, 4)}<h1>{{m7}}</h1><p>{{m26}}</p><p>{{m75}} <a>{{m2}}</a> {{m10}}</p><h2>{{m4}}</h2><p>{{m48}}</p><p>{{m33}}</p><p>{{b4}} <a>{{b2}}</a></p><p>{{b7}}</p>",
    "<div><a>{b5}</a> {b2}</div><div><a>{b6}</a> {b3}</div><div><a>{b4}</a> {b2}</div><div>{b3}</div><div><a>{b7}</a> {b1}</div>",
    "<div>{b2}</div><div>{b3}</div><div><a>{b1}</a> <a>{b1}</a></div><p>{m65}</p><p>{m17}</p><p>{m6}</p><p>{m80}</p><div>{b1}</div><div><a>{b2}</a></div>",
    # pages that mark their boilerplate only
    f"<nav>{_all_sorts('b', 3)}</nav><h1>{{m6}}</h1><p>{{m45}}</p><p>{{m80}}</p><div class=ad>{_all_sorts('b', 1)}</div><p>{{m30}}</p><p>{{m120}}</p><footer>{_all_sorts('b', 7)}</footer>",
    f"<footer>{_all_sorts('b', 2)}{_all_sorts('b', 6)}</footer><div class=sidebar>{_all_sorts('b', 4)}{_all_sorts('b', 8)}</div><p>{{m12}}</p><p>{{m1}}</p><p>{{m10}} <a>{{m1}}</a></p><aside>{{b14}}</aside>",
    f"<div class=menu>{_all_sorts('b', 9)}</div><p>{{m50}}</p><p>{{m4}}</p><p>{{m75}}</p><div class=comments>{_all_sorts('b', 5)}</div>",
    f"<nav>{_menu(5)}</nav><div><h1>{{m5}}</h1><p>{{m60}}</p><p>{{m18}}</p><p>{{m2}}</p><p>{{m90}}</p></div><footer><p>{{b30}}</p><p>{{b60}}</p></footer>",
    "<div class=sidebar><h3>{b2}</h3><p>{b50}</p></div><p>{m35}</p><p>{m110}</p><div class=ad>{b35}</div><p>{m70}</p><div class=comments><p>{b150}</p><p>{b4}</p></div><footer>{b20}</footer>",
    "<form><p>{b25}</p></form><div class=notice>{b12}</div><h1>{m4}</h1><p>{m95}</p><p>{m8}</p><p>{m40}</p><div class=footer><p>{b140}</p></div>",
)


#: Its rows: the features in their order, and whether the block is main text.
LABELLED = np.column_stack(labelled(LAYOUTS))


class Tree:
    """CART by Gini impurity; thresholds halfway between neighbouring values, the first best split wins."""

    def __init__(self, depth: int = 12):
        self.depth = depth
        self.feature, self.cut, self.left, self.right, self.share = [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(x, y, 0)
        self.arrays = tuple(np.array(v) for v in (self.feature, self.cut, self.left, self.right, self.share))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.feature)
        for v in (self.feature, self.cut, self.left, self.right, self.share):
            v.append(-1)
        self.share[at] = float(y.mean())
        best = None
        if 0 < y.mean() < 1 and depth < self.depth:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[:-1] + values[1:]) / 2:
                    side = x[:, f] <= cut
                    n, a, b = side.sum(), y[side].mean(), y[~side].mean()
                    loss = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                    if best is None or loss < best[0] - 1e-12:
                        best = loss, f, float(cut)
        if best is not None:
            _, self.feature[at], self.cut[at] = best
            side = x[:, self.feature[at]] <= self.cut[at]
            self.left[at] = self._grow(x[side], y[side], depth + 1)
            self.right[at] = self._grow(x[~side], y[~side], depth + 1)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, share = self.arrays
        at = np.zeros(len(x), dtype=int)
        for _ in range(self.depth):
            inner = feature[at] >= 0
            below = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(below, left[at], right[at]), at)
        return share[at] >= 0.5


@lru_cache(maxsize=1)
def trained() -> Tree:
    return Tree().fit(LABELLED[:, :-1], LABELLED[:, -1])


def main_blocks(page: str) -> list[str]:
    found = blocks(page)
    if not found:
        return []
    return [f[0] for f, good in zip(found, trained().predict(features(found)).tolist(), strict=True) if good]


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages without its html and with the main text, blocks joined by an empty line; `out` of the input is replaced."""
    pages = pages if out == html else pages.drop(out)
    schema = T.StructType([*[f for f in pages.schema if f.name != html], T.StructField(out, T.StringType())])
    names, html_at = [f.name for f in schema][:-1], pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, size, texts = 0, 0, []
            for i, h in enumerate(b.column(html_at)):
                texts.append("\n\n".join(main_blocks(h.as_py() or "")))
                size += len(texts[-1]) + 64
                if size > SLICE or i == b.num_rows - 1:
                    part = b.slice(begin, len(texts))
                    yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in names], pa.array(texts, pa.string())], [*names, out])
                    begin, size, texts = i + 1, 0, []

    return pages.mapInArrow(run, schema)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
