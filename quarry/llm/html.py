"""HTML extraction: flat text blocks judged by a decision tree.

A page is read as a flat list of text blocks.  A block has its word count and link density, those of its neighbours, and
what surrounds it: article or main, elements and names of menus, notices and the like, heading or paragraph.  A decision
tree, trained on the small labelled table ``LABELLED`` (pages and the texts of their main blocks), keeps or drops each
block; no element, name or length decides by itself.

The scanner takes one pass over the page.  Quotes only count where an attribute's value begins, as in browsers; where a
quote is never closed the tag ends at its first ``>``.

Defined results: null and empty html, and pages without a main block, give an empty text; unclosed elements end with
the page and a tag cut off by the end of the page is dropped; an unclosed script or style hides the rest; headings in the
header of an article are the article's, the rest of that header is not; repeated rows are each extracted; an empty table
gives an empty result; extra columns are kept by ``extracted``, but one with the name of the added column is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: The end of a comment, from its beginning, and of other markup that is no tag.
COMMENT, ODD = re.compile(r"<!--(?:-?>|(?s:.*?)--!?>)"), re.compile(r"..[^>]*>", re.DOTALL)
OPEN = re.compile(r"</?([a-zA-Z][^\s/>]*)")
TAG = re.compile(r"<(?=[a-zA-Z/!?])")
#: What may stand before an attribute, its name, and the sign before a value; an empty name ends the tag.
ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]*)(\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
#: Elements whose text is no text of the page.
RAW = frozenset("script style title textarea noscript template svg iframe object".split())
#: Those that hold plain characters up to their closing tag, and no markup.
ENDS = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for n in "script style title textarea noscript iframe".split()}
PAIRED = frozenset("script style title textarea noscript iframe template object".split())
BOILER = frozenset("nav header footer aside form menu button select dialog fieldset label option".split())
BODY = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button".split())
KEPT = frozenset("article main nav header footer aside form menu button select dialog fieldset div section ul ol dl table label span figure details".split())
#: Elements without their closing tag end where one of these begins.
IMPLIED = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "tr": {"tr", "tbody"}}
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Words of class names, ids and roles that speak of boilerplate, words that do so less clearly, and words of layouts.
STRONG = frozenset("ad ads advert advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices sidebar comment comments respond reply replies discussion menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar related recommended share sharing social newsletter subscribe subscription signup login popup modal overlay copyright pagination pager complementary contentinfo disqus".split())
WEAK = frozenset("header foot legal search widget tags alert side".split())
LAYOUT = frozenset("has no with without wrap wrapper layout content container page main".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "named", "element", "in_article", "heading", "paragraph", "outside")


def tokens(page: str):
    """(text, None, None) for texts, ("", name or "/name", attributes) for tags; comments and the like are left out."""
    at, size = 0, len(page)
    unclosed = set()  # quotes that do not occur any more
    while at < size:
        tag = TAG.search(page, at)
        less = tag.start() if tag else size
        if less > at:
            yield page[at:less], None, None
        if tag is None:
            return
        m = OPEN.match(page, less)
        if m is None:
            if less + 2 >= size:  # nothing follows
                yield page[less:], None, None
                return
            m = (COMMENT if page.startswith("<!--", less) else ODD).match(page, less)
            at = m.end() if m else size
            continue
        name, found, at = m[1].lower(), [], m.end()
        while True:
            key = ATTRIBUTE.match(page, at)
            at = key.end()
            if not key[1]:
                if at >= size:
                    return  # cut off
                break
            if key[2] is None:
                found.append((key[1].lower(), ""))
                continue
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = -1 if quote in unclosed else page.find(quote, at + 1)
                if end >= 0:
                    found.append((key[1].lower(), page[at + 1 : end]))
                    at = end + 1
                    continue
                unclosed.add(quote)
                at = page.find(">", at)
                if at < 0:
                    return
                break
            bare = BARE.match(page, at)
            found.append((key[1].lower(), bare[0]))
            at = bare.end()
        # a slash ends no element that is to have a closing tag
        closes = name not in PAIRED and page[at - 1] == "/" and not (found and found[-1][1].endswith("/"))
        at += 1
        if page[less + 1] == "/":
            yield "", "/" + name, None
            continue
        yield "", name, None if closes else found
        if name in ENDS and not closes:
            end = ENDS[name].search(page, at)
            at = size if end is None else end.end()
            if end is not None:
                yield "", "/" + name, None


def name_evidence(value: str) -> int:
    """What a class, id or role says: 0 nothing, 1 a word of a longer name, 2 an unclear name, 3 a clear one."""
    best = 0
    for name in value.split():
        words = set(re.split(r"[^a-z]+", name)) - {""}
        if words & STRONG:
            best = max(best, 1 if words & LAYOUT else 3)
        elif words & WEAK:
            best = max(best, 2 if len(words) == 1 else 1)
    return best


def blocks(page: str | None) -> list[tuple[str, list[float]]]:
    """Texts of a page's blocks with what the tree sees of each."""
    out: list[list] = []
    # element, its boilerplate mark (1: a header in an article, 2: others), evidence by names inside and around the article, article or main
    stack: list[tuple[str, int, int, int, str]] = []
    depth: Counter = Counter()
    link, kind, skip = 0, "", ""
    skipped = inner = 0  # elements open within the skipped one of its name, blocks open within a link
    holder = ""  # the block that a link began in
    texts: list[tuple[str, bool]] = []

    def flush():
        nonlocal texts
        if texts:
            whole = " ".join(entities.unescape("".join(t for t, _ in texts)).split())
            if whole:
                words = len(whole.split())
                linked = len(entities.unescape(" ".join(t for t, a in texts if a)).split())
                _, element, named, around, body = stack[-1] if stack else ("", 0, 0, 0, "")
                out.append([whole, words, min(1.0, linked / words), element, named, around, bool(body), kind in HEADING, kind in ("p", "blockquote", "pre")])
            texts = []

    for text, name, found in tokens(page or ""):
        if name is None:
            if not skip:
                texts.append((text, link > 0))
            continue
        closing = name[0] == "/"
        name = name[closing:]
        if skip:
            if name == skip:
                skipped += -1 if closing else 1 if found is not None else 0
                skip = skip if skipped else ""
            continue
        if name in RAW:
            if not closing and found is not None:
                skip, skipped = name, 1
            continue
        if name == "a":
            link, inner, holder = 0 if closing else 1, 0, kind
        if name in BLOCK:
            flush()
            kind = "" if closing else name
            if closing:  # a link ends with the block that it began in
                link, inner = (link, inner - 1) if inner else (0, 0)
            elif name in ("main", "nav") or name == holder and not inner and name in IMPLIED:
                link = 0
            elif name not in VOID:
                inner += 1
            if not closing and stack and name in IMPLIED.get(stack[-1][0], ()):
                depth[stack.pop()[0]] -= 1
        elif name == "br":
            texts.append((" ", False))
        if name in VOID or name in ("html", "body"):
            continue
        if closing:
            if depth[name]:
                flush()
                while True:
                    gone = stack.pop()[0]
                    depth[gone] -= 1
                    if gone == name:
                        break
        elif found is not None:
            _, element, named, around, body = stack[-1] if stack else ("", 0, 0, 0, "")
            if name in BOILER:
                element = max(element, 1 if name == "header" and body else 2)
            own, gone = 0, False
            for key, value in found:
                if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value.lower()):
                    element, gone = 2, True
                elif key in ("class", "id", "role", "aria-label") and (name in KEPT or (name in BLOCK and name != "h1")) and name not in BODY:
                    own = max(own, name_evidence(value.lower()))
            if gone and name not in BLOCK:  # a part of a block that is not shown
                skip, skipped = name, 1
                continue
            if name not in KEPT and not gone and own < 3 and not depth[name]:
                continue  # it says nothing, and ends nothing that does
            if name in BODY and body != "article":  # names around it need not speak of it
                named, around, body = 0, 0 if name == "main" else max(named, around), name
            named = max(named, own)
            if name == "span" and own:
                flush()
            stack.append((name, element, named, around, body))
            depth[name] += 1
    flush()
    # articles under a clear name, such as comments, are boilerplate where the page has another main text
    told = any(b[6] and not b[3] and b[4] < 3 and b[5] < 3 for b in out)
    marked = any(b[6] and b[3] < 2 for b in out)  # the page says where its article is
    rows = []
    for k, (text, words, links, element, named, around, body, heading, paragraph) in enumerate(out):
        before = out[k - 1][1:3] if k else (0, 0.0)
        after = out[k + 1][1:3] if k + 1 < len(out) else (0, 0.0)
        named = max(named, 3 if told and around == 3 else 0)
        rows.append((text, [float(x) for x in (words, links, *before, *after, named, element, body, heading, paragraph, marked and not body)]))
    return rows


def _labelled() -> list[tuple[str, list[str]]]:
    """A small labelled table: pages with and without marks of their article, texts of several lengths, and the texts of their main blocks."""
    story = "The ferry left the small harbour before dawn and crossed the bay while the town behind it was still asleep under rain".split()
    menu = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">Contact us today</a></li></ul></nav>'
    plain = '<ul><li><a href="/1">One</a></li><li><a href="/2">Two more</a></li><li><a href="/3">Three of them</a></li></ul>'
    rows = []
    for n in (1, 2, 3, 5, 7, 9, 14, 20, 30, 50, 80, 200):
        say = lambda k, n=n: " ".join(story[(k + j) % len(story)] for j in range(n)) + f" {k}."
        some = lambda k, m: " ".join(story[(k + j) % len(story)] for j in range(m)) + f" {k}."
        one, two, three = say(1), say(2), say(3)
        ad, foot = f'<div class="ad">{say(4)}</div>', f"<footer>&copy; {say(5)}</footer>"
        # pages that mark their article
        rows += [
            (f"<body>{menu}{ad}<article><h1>{one}</h1><p>{two}</p><p>{three}</p></article><div>{say(6)}</div><p>{say(7)}</p>{foot}</body>", [one, two, three]),
            (f"<body><header><h1>{say(6)}</h1></header>{menu}<article><h2><a href='/t'>{some(1, 4)}</a></h2><p>{one}</p><ul><li>{two}</li><li>{three} <a href='/x'>tea</a></li></ul></article><aside><h3><a href='/s'>{say(7)}</a></h3></aside>{foot}</body>", [some(1, 4), one, two, f"{three} tea"]),
            (f'<body><div id="cookie-notice"><p>{say(6)}</p></div><main><h2>{one}</h2><p>{two}</p><form><label>{say(7)}</label></form></main><div class="comments"><p>{say(8)}</p></div></body>', [one, two]),
            (f"<body>{menu}<article><p>{one}</p><div class='related'><a href='/r'>{say(6)}</a></div><p>{two} {one} {two} <a href='/s'>map</a></p></article></body>", [one, f"{two} {one} {two} map"]),
            (f'<body><article><h1>{one}</h1><section id="comments"><h2>{say(6)}</h2><p>{say(7)}</p></section></article>{foot}</body>', [one]),
            (f"<body><article><header><h1>{one}</h1><p>{say(6)}</p><span>{say(8)}</span></header><p>{two}</p><div class='share'>{say(7)}</div><p><a href='/w'>{three}</a></p></article>{foot}</body>", [one, two, three]),
            (f"<body><article><header><span>{say(6)}</span><h1>{one}</h1><h2>{two}</h2></header><header><p>{say(7)}</p></header><div>{three}</div></article></body>", [one, two, three]),
            (f"<body>{menu}<article><h1>{one}</h1><p class='ad'>{say(6)}</p><p>{two}</p><ul><li>{three}</li><li class='share'>{say(7)}</li></ul><p hidden>{say(8)}</p></article>{foot}</body>", [one, two, three]),
            (f"<body><main><section class='legal-news'><h2>{one}</h2><p>{two}</p></section><div class='widget-grid'><p>{three}</p></div><div class='search-list'><a href='/q'>{say(6)}</a></div></main></body>", [one, two, three]),
            (f"<body><main><div class='content-sidebar-wrap'><p>{one}</p><div class='sidebar'><p>{say(6)}</p></div><div>{two}</div></div></main>{foot}</body>", [one, two]),
            (f"<body><main><div class='search'><p>{some(6, 4)}</p></div><p>{one}</p><div class='legal'><p>{some(2, n + 25)}</p></div><div class='tags'><a href='/t'>{say(7)}</a></div></main></body>", [one, some(2, n + 25)]),
        ]
        # pages that do not: lengths and links speak, a block's own and its neighbours'
        long, longer = some(11, n + 20), some(12, n + 45)
        rows += [
            (f"<body>{plain}<div>{some(6, 3)}</div><h1>{some(1, 6)}</h1><p>{long}</p><p>{some(2, 2)}</p><p>{longer}</p><p>{some(3, 2)} <a href='/y'>tea</a></p><p>{long}</p>{plain}<p>{some(7, 4)}</p></body>",
             [some(1, 6), long, some(2, 2), longer, f"{some(3, 2)} tea", long]),
            (f"<body><div><a href='/1'>One</a> <a href='/2'>Two</a> <a href='/3'>{some(6, 2)}</a></div><div><h2>{some(1, 4)}</h2><div>{longer}</div><div>{long}</div></div><div><a href='/r'>{say(7)}</a></div><div>{some(8, 3)}</div></body>",
             [some(1, 4), longer, long]),
            (f"<body><table><tr><td><a href='/1'>Home</a></td><td>{some(6, 2)}</td><td>{long} <a href='/m'>more</a> {longer}</td></tr><tr><td><a href='/z'>{some(7, 9)}</a></td><td>{some(8, 2)}</td></tr></table></body>",
             [f"{long} more {longer}"]),
            (f"<body><div class='menu'><a href='/1'>One</a> <a href='/2'>Two</a></div><div class='content'><h1>{some(1, 5)}</h1><p>{long}</p><p>{longer}</p></div><div class='sidebar'><p>{long} {some(6, 3)}</p></div></body>",
             [some(1, 5), long, longer]),
            (f"<body>{one}</body>", [one]),
            (f"<body><p>{one}</p><p>{two}</p><p>{three}</p></body>", [one, two, three]),
            (f"<body><div>{some(1, 3)}</div><div>{longer}</div><div>{some(2, 1)}</div><div><a href='/n'>{say(6)}</a></div><div>{some(7, 5)}</div><div><a href='/o'>{say(8)}</a></div></body>", [some(1, 3), longer, some(2, 1)]),
        ]
        if n >= 9:
            rows.append((f"<body><p><a href='/p'>{say(6)}</a></p><p>{one}</p><p>{two}</p><p><a href='/top'>{say(7)}</a></p></body>", [one, two]))
    return rows


LABELLED = _labelled()


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10):
    """A CART tree by Gini impurity: (feature, cut, left, right) or a leaf's share of ones."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])  # the last row on the left of each cut
        if not len(at):
            continue
        left, n = at + 1.0, len(y)
        cost = ones[at] * (1 - ones[at] / left) + (ones[-1] - ones[at]) * (1 - (ones[-1] - ones[at]) / (n - left))
        k = int(cost.argmin())
        if best is None or cost[k] < best[0] - 1e-9:
            best = (cost[k], f, float(v[at[k]] + v[at[k] + 1]) / 2)
    if best is None:
        return float(y.mean())
    _, f, cut = best
    low = x[:, f] <= cut
    return (f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def decide(tree, row) -> float:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def described(tree) -> str:
    """The tree as text, one line per node."""
    if not isinstance(tree, tuple):
        return f"{tree:.2f}"
    f, cut, low, high = tree
    inner = lambda t: "\n".join("  " + line for line in described(t).split("\n"))
    return f"{FEATURES[f]} <= {cut:g}\n{inner(low)}\n{inner(high)}"


def train(labelled):
    """A tree from (page, texts of its main blocks); equal texts of a page are matched from its beginning."""
    rows, y = [], []
    for page, main in labelled:
        wanted = Counter(main)
        for text, row in blocks(page):
            rows.append(row)
            y.append(float(wanted[text] > 0))
    return grow(np.array(rows, dtype=np.float64), np.array(y)) if rows else 0.0


@lru_cache(1)
def default_tree():
    return train(LABELLED)


def extract(page: str | None, tree=None) -> str:
    tree = default_tree() if tree is None else tree
    return "\n".join(text for text, row in blocks(page) if decide(tree, row) >= 0.5)


def extracted(pages: DataFrame, html: str = "html", labelled=None, as_column: str = "main_text") -> DataFrame:
    """``pages`` with the main text in one more column."""
    shared = pages.sparkSession.sparkContext.broadcast(default_tree() if labelled is None else train(labelled))
    pages = pages.drop(as_column)
    at = pages.columns.index(html)

    def run(batches):
        tree = shared.value
        for batch in batches:
            found = [extract(p.as_py(), tree) for p in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, as_column])

    return pages.mapInArrow(run, pages.limit(0).withColumn(as_column, F.lit("")).schema)


def op2_extract(spark, sf_dir: str) -> DataFrame:
    found = extracted(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
