import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, common, decontaminate, embeddings, html, lm, minhash, mixing, toxicity, urls, warc

LONG = "tide " * 60_000
DOCS = "doc_id long, text string, source string, decon string, mix string, MIX_SIZE int, toxicity string, target double, doc string, body int"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", 1, "x", 1.0, "x", 1) for i, t, s in rows], DOCS)


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(base)]
    for k in range(12):
        near = base[k].split()
        near[int(rng.integers(60))] = "changed"
        rows.append((100 + k, " ".join(near).upper(), None))
        rows.append((200 + k, base[k], "s1"))
    return [*rows, (300, None, "s2"), (301, "", None), (302, "  \t\n", "s2"), (303, "one", "s0"), (304, "ONE", "s0"), (305, LONG, "s0"), (306, LONG, "s0"), (None, "null id", "s1"), (3, base[3], "s0")]


def test_word_hashes_match_across_chunks():
    import pyarrow as pa

    data, bounds = common.utf8(pa.array(["ab c", None, "c d\tab", ""]))
    s, e, first = common.word_spans(data, bounds, common.NONSPACE)
    h = common.hash_spans(data, s, e)
    assert first.tolist() == [0, 2, 2, 4, 4]
    assert h[0] == h[3] and h[1] != h[2]


# --- language model


class PlainAutomaton:
    """States and arcs as dictionaries; texts are read token by token; 0 is their beginning."""

    def __init__(self, texts, order):
        self.order, self.c = order, collections.Counter()
        for w in texts:
            whole = [0, *w]
            for k in range(len(w)):
                for n in range(1, order + 1):
                    if k - n >= -2:
                        self.c[tuple(whole[k - n + 2 : k + 2])] += 1
            self.c[(0,)] += 1
        self.total = sum(len(w) for w in texts)
        self.words = len({x for w in texts for x in w})

    def root(self, x):
        d = lm.DISCOUNT
        if not self.total:
            return 1.0
        return (self.c[(x,)] - d) / self.total if self.c[(x,)] else d * self.words / self.total

    def prior(self, h):
        return lm.PRIORS[min(len(h), len(lm.PRIORS)) - 1]

    def given(self, h, x):
        if not h:
            return self.root(x)
        m = self.prior(h)
        return (self.c[(*h, x)] + m * self.given(h[1:], x)) / (self.c[h] + m)

    def read(self, w):
        state, out = (0,) if self.total else (), 0.0
        for x in w:
            while state and not self.c[(*state, x)]:
                out += math.log10(self.prior(state) / (self.c[state] + self.prior(state)))
                state = state[1:]
            out += math.log10(self.given(state, x))
            state = (*state, x)[-(self.order - 1) :] if self.c[(*state, x)] else ()
        return out


def plain_tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_against_brute_force(spark, order):
    rows = [*corpus(), (900, "<s> w1 w2", None), (901, "x" * 50_000 + " w1", None), (902, "x" * 50_000 + " w1", None), (903, "x" * 49_999 + "y w1", None)]
    rng = np.random.default_rng(4)
    rows += [(1000 + k, " ".join(rng.choice(["a", "b", "c", "new"], 300)), None) for k in range(30)] + [(None, "null id", "s2")] * 3
    got = collections.defaultdict(list)
    for r in lm.score(docs(spark, rows), order=order).collect():
        got[r.doc_id].append(r)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    plain = PlainAutomaton([plain_tokens(t) for i, t, _ in rows if not held(i)], order)
    n, v, c = plain.total, plain.words, plain.c
    want = collections.defaultdict(list)
    for i, t, _ in rows:
        w = plain_tokens(t)
        want[i].append((held(i), len(w), sum(c[(x,)] > 0 for x in w), n, sum(math.log10((c[(x,)] + 1) / (n + v + 1)) for x in w), plain.read(w)))
    assert {i: sorted(map(tuple, (x[1:] for x in r))) for i, r in got.items()} == {i: [pytest.approx(x, rel=1e-9) for x in sorted(r)] for i, r in want.items()}


def test_lm_batches_do_not_change_scores(spark, monkeypatch):
    rows = [(k, "tide and stone " * (k % 7) + f"word{k % 5}", None) for k in range(60)] * 2
    key = lambda r: (r.doc_id, r.n_tokens, r.n_known, round(r.score, 9), round(r.base_score, 9))
    whole = sorted(key(r) for r in lm.score(docs(spark, rows).coalesce(1)).collect())
    monkeypatch.setattr(lm, "LEAST_BYTES", 150)
    monkeypatch.setattr(lm, "BATCH_BYTES", 300)
    assert lm._packed(docs(spark, rows), "doc_id", "text")[1].count() > 10
    assert sorted(key(r) for r in lm.score(docs(spark, rows)).collect()) == whole


def test_lm_empty(spark):
    assert lm.score(docs(spark, [])).count() == 0
    assert lm.score(docs(spark, [(2, None, None)])).first().n_tokens == 1
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = lm.score(docs(spark, [(held, "no training rows", None)])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 4, 0, 0, 0.0, 0.0)


def test_lm_probabilities_of_a_state_sum_to_one():
    plain = PlainAutomaton([["a", "b", "a", None], ["b", "a", None], ["a", "b", "b", None]], 3)
    for state in ((), ("a",), ("a", "b"), (0, "a"), ("b", "b")):
        assert sum(plain.given(state, x) for x in ("a", "b", None, "?")) == pytest.approx(1)


def test_lm_places_of_keys_with_equal_leading_bits():
    keys = np.array([2**63 + 5, 2**63 + 1, 7, 2**63 + 5, 2**63 + 3, 7, 2**63 + 1], np.uint64)
    place, rep = lm._places(np.tile(keys, 3))
    want, back = np.unique(np.tile(keys, 3), return_inverse=True)
    assert place.tolist() == back.tolist() and np.tile(keys, 3)[rep].tolist() == want.tolist()


# --- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><header>Top</header><nav><a href=/>Home</a></nav>
<div class="cookie-banner"><p>We use cookies</p></div><article><h1>Big &amp; small</h1><p>One  <b>two</b><br>three&nbsp;four.<p>Five<!-- <p>no</p> --></p><div class="ad"><p>Buy</p></div><form><p>Mail</p></form></article>
<section id="comments"><p>First!</p></section><aside><p>Side</p></aside><footer>&copy; x</footer></body></html>"""


def test_html_blocks(spark):
    assert html.extract(PAGE) == "Big & small\nOne two three four.\nFive"
    assert [html.extract(x) for x in (None, "", "<p", "<script>x", "plain words of a page without any markup at all")] == ["", "", "", "", "plain words of a page without any markup at all"]
    assert html.extract("<article><p>cut &am") == "cut &am"
    assert len(html.extract(f"<article><p>{LONG}</p></article>")) == len(LONG.strip())
    table = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "x")], "page_id long, html string, main_text string")
    assert sorted(r.main_text for r in html.extracted(table).collect()) == ["", *["Big & small\nOne two three four.\nFive"] * 2]
    assert html.extracted(table.limit(0)).count() == 0


@pytest.mark.parametrize("hidden", [
    "<script>for(i=0;i<n;i++){f(i)}</script>", "<SCRIPT>s='<!--'</Script >", "<style>a<b{}</style\n>", "<textarea>a<b 'c</textarea>", "<title>a<b</title>", "<noscript><img alt='</noscript>",
    "<script>x='</scripted>';i<n</script>", "<template><script>i<n</script><p>no</p></template>", "<svg><!-- </svg> --><style>a<b</style></svg>"])
def test_html_raw_elements_end_at_their_closing_tag(hidden):
    assert html.extract(f"<body>{hidden}<article><p>Story</p></article></body>") == "Story"
    assert html.extract(f"<body><article><p>One</p>{hidden}<p>Two</p></article></body>") == "One\nTwo"


@pytest.mark.parametrize("around", [
    '<div class="content-sidebar-wrap">', '<div class="page no-comments">', '<div class="has-sidebar">', '<div id="search">', '<section class="single widget"><div aria-label="Menu page">',
    '<div aria-hidden="false">', "<div data-hidden>", '<div title="the hidden bay" data-class="ad">'])
@pytest.mark.parametrize("body", ["article", "main"])
def test_html_names_around_the_article(around, body):
    assert html.extract(f"<body>{around}<{body}><h1>Head</h1><p>Story</p></{body}></div></section></body>") == "Head\nStory"


def test_html_boilerplate_around_articles_stays():
    story = "<article><h1>Head</h1><p>Story</p></article>"
    for page in (f"{story}<div class='comments'><article><p>First!</p></article></div>", f"<main>{story}<div id='comments' class='comments-area'><article><p>First!</p></article></div></main>",
                 f"{story}<nav><article><p>Tea</p></article></nav>", f"{story}<div hidden><article><p>Tea</p></article></div>", f"{story}<div style='display: none'><main>Tea</main></div>",
                 "<article><h1>Head</h1><p>Story</p><div class='comment-list'><article><p>First!</p></article></div></article>",
                 f"<div class='has-sidebar'>{story}<div class='sidebar'><p>Side</p></div></div>"):
        assert html.extract(f"<body>{page}</body>") == "Head\nStory", page


def test_html_tree_fits_its_table():
    tree = html.default_tree()
    assert all("\n".join(main) == html.extract(page, tree) for page, main in html.LABELLED)
    shown = html.described(tree)
    print(shown)
    assert all(f"{name} <=" in shown for name in ("words", "links", "links_before", "named", "element", "in_article"))


@pytest.mark.parametrize("page,text", [
    ("<p title=don't>Hello there reader</p>", "Hello there reader"), ("<article><p>cut</p><a href=\"x", "cut"), ('<article><p title="a>Story</p>', "Story"), ("<article><p a='b' c=d' e>Story</p>", "Story"),
    ("<main><section class='legal-news'><p>Story</p></section></main>", "Story"), ('<main><div class="search-results-article"><p>Story</p></div></main>', "Story"),
    ('<main><div class="widget-grid"><p>Story</p></div></main>', "Story"), ('<article><div title="hidden gems of Rome"><p>Tea</p></div><div data-valid="ad">two</div></article>', "Tea\ntwo"),
    ("<article><p>1 < 2 <3 and a<b c</p></article><", "1 < 2 <3 and a"), ("<article><p>a</ b>b<!x>c<?y?>d</p>", "abcd"), ("<article><p/>x<br/>y</article>", "x y"),
    ("<article><header><span>By me</span><h1>Head</h1></header><p>Story</p></article>", "Head\nStory"), ("<article><h1><a href=/x>Head</a></h1><p>Story</p></article>", "Head\nStory")])
def test_html_hostile_pages(page, text):
    assert html.extract(page) == text


def test_html_takes_linear_time():
    import time

    for page in ("<b " * 330_000 + "'", "<b a='" * 160_000, "<section>" * 60_000 + "</article>" * 60_000, "<" * 1_000_000, '<a href="' * 110_000, "<!--" * 250_000, "<div class='" + "a " * 400_000):
        began = time.perf_counter()
        html.extract(page)
        assert time.perf_counter() - began < 4


def plain_reader(page):
    """The blocks of the article of a page without unclosed scripts, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.out, self.now = 0, [], ""

        def flush(self):
            self.out, self.now = [*self.out, *([" ".join(self.now.split())] if self.now.split() else [])], ""

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in ("article", "p", "h1"):
                self.flush()
            self.now += " " if tag == "br" else ""

        def handle_endtag(self, tag):
            if tag in ("article", "p", "h1"):
                self.flush()
            self.inside -= tag == "article"

        def handle_data(self, data):
            self.now += data if self.inside else ""

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return "\n".join(reader.out)


def test_html_second_reader_agrees(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: plain_reader(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html.op2_extract(spark, sf).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_html_held_out_pages():
    """Pages of other words and forms than those of the table."""
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in "bcdfglmn" for b in ("ar", "el", "ion", "uth")]
    say = lambda a, b: " ".join(rng.choice(vocabulary, int(rng.integers(a, b)))) + f" {rng.integers(10**6)}"
    right = total = 0
    for k in range(300):
        paras = [say(2, 60) for _ in range(int(rng.integers(1, 6)))]
        head, others = say(3, 9), [say(1, 12) for _ in range(5)]
        inside = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in paras)
        links = "".join(f"<li><a href='/{j}'>{o}</a></li>" for j, o in enumerate(others[:3]))
        form = k % 5
        if form == 0:
            page = f"<header>{others[3]}</header><ol>{links}</ol><article class='post'>{inside}<footer>{others[4]}</footer></article><div class='sponsored-box'><p>{say(5, 60)}</p></div>"
        elif form == 1:
            page = f"<ul class='navbar-items'>{links}</ul><div class='layout-with-sidebar'><main>{inside}<div class='reader-comments'><p>{say(5, 60)}</p></div></main><div class='sidebar'>{others[3]}</div></div>"
        elif form == 2:
            page = f"<article>{inside}<form><p>{others[3]}</p></form></article><section class='related-stories'><h3>{others[4]}</h3><ul>{links}</ul></section>"
        else:
            paras = [say(20, 70) for _ in paras]
            inside = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in paras)
            page = f"<ul>{links}</ul>{inside}<div><ul>{links}</ul></div><p>{say(1, 4)}</p>" if form == 3 else f"<div><a href='/'>{others[3]}</a></div><div>{inside}</div><div><a href='/n'>{others[4]}</a> <a href='/m'>{others[2]}</a></div>"
        want, found = {head, *paras}, html.extract(f"<body>{page}</body>").split("\n")
        texts = [t for t, _ in html.blocks(f"<body>{page}</body>")]
        total += len(texts)
        right += sum((t in found) == (t in want) for t in texts)
    print(right, total)
    assert right >= 0.97 * total


# --- urls


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://x.com/fr/?q", "x.com", "/fr/", "com/", "allow"), ("http://b.net/es/9", "b.net", "/es/9", "net/es/", "block"), ("http://x.com", "x.com", "", None, None),
    ("http://xcom/", "xcom", "/", None, None), (None, "", "", None, None), ("no-scheme/x", "", "", None, None), ("ftp://net/fr/x", "net", "/fr/x", "net/fr/", "block")])
def test_url_rules(url, host, path, rule, verdict):
    assert urls.split_url(url) == (host, path)
    found = urls.Rules(urls.RULES).find(host, path)
    assert found == (None if rule is None else (rule, verdict))


#: Sites whose names are not in the labelled table, and words that only look like bad ones.
ORDINARY = """http://www.riverboats.org/history/12 http://docs.openfields.net/notes/a http://en.gardenwiki.org/tulips http://journal.mathhouse.org/2019/04 http://therapist-house.org http://sussex.ac.uk/
 http://freepress.org/article http://essexcounty.org/ http://download-manual.org/printer http://www.theatredorset.org/tickets http://winchester.org/en http://casinomuseum.org/history http://blog.tulo.example.org/de/84
 http://amberfield.net/x http://www.lindenhall.org/choir http://greenhill.co.uk/map""".split()
DOUBTFUL = """http://cheap-casino-pills.org/buy http://free-viagra-spam.net/win http://xxx-adult-bonus.org/free http://spam-farm.example.org/en/1 http://lottery-jackpot.biz/claim http://escort-service.ru/x
 http://hotpornpics.info/a http://crackedsoftware.biz/keygen http://seo-backlinks-cheap.com/ http://online-slots-bonus.info/ http://cheap-pills.example.net/x""".split()


def plain_probability(url, weights):
    """The score by a straight loop over n-grams."""
    host, path = "", ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = low(m[1]), m[2]
    found = set()
    for field, text in (("h", "^" + host + "$"), ("p", "^" + path + "$")):
        raw = text.encode()
        for n in urls.GRAMS:
            for k in range(len(raw)):
                if k + n <= len(raw):
                    found.add(zlib.crc32((field.encode() + raw[k : k + n])) % urls.SIZE)
    z = sum(weights[k] for k in found) / math.sqrt(max(1, len(found))) + weights[-1]
    return host, path, 1 / (1 + math.exp(-z))


def test_url_model_held_out(spark):
    df = spark.createDataFrame([(k, u, 1) for k, u in enumerate(ORDINARY + DOUBTFUL)], "page_id long, url string, judged int")
    got = {r.page_id: r.judged.verdict for r in urls.judged(df).collect()}
    right = sum(got[k] == ("allow" if k < len(ORDINARY) else "block") for k in got if not any(w in (ORDINARY + DOUBTFUL)[k] for w in (".com/",)))
    listed = [u for k, u in enumerate(ORDINARY + DOUBTFUL) if ".com/" not in u]
    assert right >= 0.95 * len(listed)
    assert urls.judged(df.limit(0)).count() == 0
    assert urls.judged(df, rules=[], labelled=[]).where("judged.verdict = 'block'").count() == 0


def test_url_scores_against_a_plain_version(spark, sf):
    weights = urls.train()
    odd = ["", None, "x", "http://", "://É.org/ü", "http://a" + "b" * 200_000 + ".org/" + "c" * 200_000, "HTTP://A.B/c?d#e", "HTTP://A.B/c?d#e"]
    table = spark.createDataFrame([(k, u) for k, u in enumerate(odd)], "page_id long, url string").union(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"))
    for r in urls.judged(table, rules=[("b/", "allow"), ("b/", "block")]).collect():
        host, path, want = plain_probability(r.url, weights)
        assert (r.judged.host, r.judged.path) == (host, path) and r.judged.score == pytest.approx(want, abs=1e-9)
        assert r.judged.verdict == ("allow" if r.judged.rule else "block" if r.judged.score >= 0.5 else "allow")
        assert (r.judged.rule == "b/") == ((host == "b" or host.endswith(".b")) and path.startswith("/"))  # of equal rules the first


# --- embeddings


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    p = embeddings.decode(x)
    d = ((x - p) ** 2).sum(axis=1)
    for v in embeddings.NEAR:
        assert (((x - p - v) ** 2).sum(axis=1) >= d - 1e-9).all()
    assert len(embeddings.NEAR) == 240 and d.max() <= 1 + 1e-9


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    near = np.repeat(base[:20], 4, axis=0) + rng.normal(size=(80, 16)) * 0.2
    vectors = np.concatenate([base, near, base[:10], base[:10]]).astype(np.float32).tolist()
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [1e-30] * 16]
    rows = [(k, v, "x") for k, v in enumerate(vectors + odd)] + [(None, vectors[0], "x")]
    got = {r.vec: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, digest string")).collect()}
    x = np.array(vectors, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    found, want = sum(got[k].n_links for k in range(len(x))), int(link.sum())
    assert want * 0.98 <= found <= want
    assert all(got[len(x) + k].n_links == 0 and got[len(x) + k].component == len(x) + k for k in range(len(odd)))
    assert got[0].component == 0 and got[None].component is None


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- warc


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    rows = [(1, "http://a/ b", "x"), (2, "http://a\r\n", "x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 300_000), (None, "u", "x"), (2, "again", "x"), (7, "u", "only")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.read(spark, warc.write(table, str(tmp_path / "w"))).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in got if r.page_id != 2) == [
        (-1, "revisit", 2, 1), (1, "revisit", 2, 1), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 600_000), (7, "response", None, 4)]
    assert [r.record_type for r in got if r.page_id == 2] == ["response"] * 2
    assert warc.read(spark, warc.write(table, str(tmp_path / "v"), least=2)).where("record_type = 'revisit'").count() == 0
    assert warc.read(spark, warc.write(table.limit(0), str(tmp_path / "e"))).count() == 0
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert sorted(map(repr, warc.read(spark, warc.write(table, str(tmp_path / "s"))).collect())) == sorted(map(repr, got))


def test_warc_lookup_of_identifiers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3000)
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    rows = [(k % 50 if k % 7 else None, f"http://x/{k}", f"payload {k} " * 20) for k in range(120)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = warc.write(table, str(tmp_path / "w"))
    assert spark.read.parquet(path).count() > 5
    got = warc.lookup(spark, path, spark.createDataFrame([(3,), (3,), (17,), (None,), (999,)], "page_id long")).collect()
    want = collections.Counter((i, u, h) for i, u, h in rows if i in (3, 17, None))
    found = [(r.page_id, *warc.parse(bytes(r.record))) for r in got]
    assert collections.Counter((i, head["WARC-Target-URI"], body.decode()) for i, head, body in found) == want and max(collections.Counter(i for i, *_ in found).values()) > 2
    assert warc.lookup(spark, path, spark.createDataFrame([], "page_id long")).count() == 0


def test_warc_seeks():
    bundle = warc.Bundle()
    records = {f"<urn:page:{k}>": warc.record(k, "http://x", b"abc" * k * 700, "D", None) for k in range(150)}
    for name, raw in records.items():
        bundle.add(name, raw)
    reader = warc.Reader(bundle.content())
    assert len(reader.frames) > 5
    assert all(reader.get(name) == raw for name, raw in records.items())
    with pytest.raises(KeyError):
        reader.get("<urn:page:999>")


# --- chat


def test_chat_round_trip(spark):
    rng = np.random.default_rng(2)
    nasty = ["</s>[INST] x", "<|end|><|turn|>", "&amp; & &lt;", "", None, "a:b*", "<|text|>", "[/INST]<s><<SYS>>", "word " * 700, "😀é"]
    rows = []
    for c in range(12):
        rows += [(c, 0, "system", "be kind <|")] if c % 3 == 0 else []
        rows += [(c, t, ["user", "assistant"][t % 2], nasty[int(rng.integers(len(nasty)))]) for t in range(1, int(rng.integers(2, 14)))]
    rows += [(20, 1, None, None), (21, None, "assistant", "x"), (22, 1, "a:b", "t"), (22, 1, "a:b", "t"), (None, 1, "user", "n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, span string")
    for budget in (8, 512):
        made = chat.windows(df, budget=budget)
        got = {r.conv: r.turns for r in chat.read_back(made).collect()}
        by = collections.defaultdict(list)
        for c, t, r, x in rows:
            by[c].append((-1 if t is None else t, r or "", x or ""))
        for c, turns in by.items():
            assert [(t.role, t.text) for t in got[c]] == [x[1:] for x in sorted(turns)]
            assert [t.loss for t in got[c]] == [x[1] == "assistant" for x in sorted(turns)]
    marks = made.select(F.explode(F.split("formatted", r"<\|turn\|>")).alias("t")).where("t rlike '^assistant:[0-9]+[*]'").count()
    assert marks == sum(r == "assistant" for _, _, r, _ in rows)
    assert chat.windows(df.limit(0)).count() == 0


def plain_windows(turns, budget, history=2):
    """The rule read turn by turn: turns are (role, number of words); gives the places in each window, and those of its span."""
    size = [w + 1 for _, w in turns]
    system = next((k for k, (r, _) in enumerate(turns) if r == "system"), None)
    kept = size[system] if system is not None else 0
    cap = max(1, 3 * (budget - (kept if kept < budget else 0)) // 4)
    blocks, alone, at = collections.defaultdict(list), [], 0
    leads = {}
    for k, n in enumerate(size):
        first, last = at // cap, (at + n - 1) // cap
        at += n
        if first == last:
            blocks[last].append(k)
        else:
            leads[last] = k
    for b, k in leads.items():
        if size[k] + sum(size[j] for j in blocks[b]) <= cap:
            blocks[b].insert(0, k)
        else:
            alone.append([k])
    out = []
    for span in sorted([b for b in blocks.values() if b] + alone):
        more = [system] if system is not None and system < span[0] else []
        used = sum(size[k] for k in [*more, *span])
        for k in range(span[0] - 1, max(-1, span[0] - 1 - history), -1):
            if k != system:
                used += size[k]
                if used > budget:
                    break
                more.append(k)
        out.append((sorted([*more, *span]), span))
    return out


@pytest.mark.parametrize("budget", [8, 40, 512])
def test_chat_windows_keep_the_budget(spark, budget):
    rng = np.random.default_rng(budget)
    rows = [(1, t, "user", "w " * 510) for t in range(4)]  # four turns that each fill a window
    rows += [(2, 0, "system", "s " * 600)] + [(2, t, "user", "w " * 20) for t in range(1, 40)]  # a system turn beyond the budget
    rows += [(3, t, ["system", "user", "assistant"][t % 3], "w " * 9) for t in range(300)]  # many system turns
    for c in range(10, 40):
        late = int(rng.integers(6))
        rows += [(c, t, "system" if t == late and c % 2 else ["user", "assistant"][t % 2], "w " * int(rng.integers(1, budget))) for t in range(int(rng.integers(1, 40)))]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=budget).collect()
    got = collections.defaultdict(dict)
    for r in made:
        got[r.conv][r.span - 1] = sorted((int(m[1]) - 1, bool(m[2])) for m in re.finditer(r"<\|turn\|>\w+:(\d+)(\*?)", r.formatted)), r.tokens
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(rows):
        by[c].append((r, len(x.split())))
    for c, turns in by.items():
        want = plain_windows(turns, budget)
        assert {span[0]: [(k, k in span and turns[k][0] == "assistant") for k in every] for every, span in want} == {s: x for s, (x, _) in got[c].items()}
        for every, span in want:
            size = sum(turns[k][1] + 1 for k in every)
            assert size == got[c][span[0]][1]
            head = [k for k in every if k < span[0] and turns[k][0] == "system"][:1]
            if size > budget:  # only a system turn that fills the budget, or one turn beside it
                system = sum(turns[k][1] + 1 for k in head)
                assert system >= budget or (len(span) == 1 and len(every) == len(head) + 1)
    assert sorted(k for every, span in plain_windows(by[3], budget) for k in span) == list(range(300))


# --- toxicity


def labelled(n=600):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("ba", "do", "ke", "mi", "ru", "sa", "te") for b in ("lo", "na", "rim", "sut", "vek")]
    rows, labels = [], []
    for k in range(n):
        text, toxic = rng.choice(words, 30).tolist(), int(k % 5 == 0)
        for at in rng.integers(30, size=3 * toxic):
            text[int(at)] = str(rng.choice(["grobian", "schnulf", "zonktar"]))
        rows.append((k, " ".join(text) + ".", "s"))
        labels.append((k, toxic))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled()
    rows += [(1000, None, None), (1001, "", None), (1002, LONG, None), (None, "x", None), (0, rows[0][1], "s")]
    got = toxicity.scored(docs(spark, rows), spark.createDataFrame([*labels, (7, None)], "doc_id long, toxic int")).select("doc_id", "toxicity").collect()
    assert len(got) == len(rows) and all(0 <= r.toxicity <= 1 for r in got)
    truth = dict(labels)
    out = [(r.toxicity >= 0.3, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(a == b for a, b in out) / len(out) > 0.97
    assert all(r.toxicity < 0.3 for r in got if r.doc_id in (1000, 1001, 1002))


def test_toxicity_without_labels(spark):
    d = docs(spark, [(1, "x", None)])
    assert toxicity.scored(d, spark.createDataFrame([], "doc_id long, toxic int")).first().toxicity < 0.3
    assert toxicity.scored(d.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_grammar_emits_clauses():
    g = toxicity.Grammar({"grobian": 2.0})
    m, n = g.matches("You are a grobian. He is not a grobian! The paper said that grobian. I will kill you; fine.")
    assert m[:, 1:].astype(int).tolist() == [[1, 0, 1, 0, 0], [1, 0, 1, 1, 0], [1, 0, 0, 0, 1], [0, 1, 1, 0, 0]]
    assert n > 0 and len(g.matches(None)[0]) == 0


def plain_matches(grammar, text):
    """Clauses read word by word, with the rules of the grammar spelled out."""
    T = toxicity
    out, clause = [], []

    def finish():
        match = [k for k, (c, _) in enumerate(clause) if c & T.MATCH]
        if match:
            near = lambda k, bits, reach: any(clause[j][0] & bits for j in range(max(0, k - reach), k))
            negated = [near(k, T.NEGATION, T.NEGATION_REACH) for k in match]
            reported = [near(k, T.REPORT | T.QUOTE, T.REPORT_REACH) or any(c & T.REPORT for c, _ in clause[k + 1 : k + 1 + T.REPORT_REACH]) for k in match]
            targeted = any(c & T.TARGET for c, _ in clause)
            weight = sum(w for _, w in clause) + sum(T.WEIGHTS[T.NEGATED] * n + T.WEIGHTS[T.REPORTED] * r + T.WEIGHTS[T.TARGETED] * targeted for n, r in zip(negated, reported, strict=True))
            out.append([pytest.approx(max(0.0, weight)), any(c & T.INSULT for c, _ in clause), any(c & T.THREAT for c, _ in clause), targeted, any(negated), any(reported)])
        clause.clear()

    for word in toxicity.TOKEN.findall((text or "").lower()):
        found = grammar.look(word)
        if found[0] == toxicity.END:
            finish()
        else:
            clause.append(found)
    finish()
    return out


def test_grammar_against_a_plain_walk():
    rng = np.random.default_rng(12)
    words = ["grobian", "kill", "hurt", "you", "not", "never", "said", "wrote", '"', ".", "!", "tea", "and", "the", "nicht", "sie", *["of"] * 12]
    grammar = toxicity.Grammar({"grobian": 2.0, "hur*": 1.0}, {"tea": 1.5})
    for _ in range(1500):
        text = " ".join(rng.choice(words, int(rng.integers(0, 60))))
        assert grammar.matches(text)[0].tolist() == plain_matches(grammar, text)


def test_grammar_reads_what_follows_and_composes():
    grammar = toxicity.Grammar({"grobian": 2.0})
    said = lambda text: grammar.matches(text)[0][:, 4:].astype(int).tolist()
    assert said("A grobian, said the man.") == [[0, 1]] and said("A grobian of the town that none of us had met once said") == [[0, 0]] and said("Not a grobian, wrote he") == [[1, 1]]
    marks = toxicity.compose(toxicity._negation(), toxicity._reported())
    assert marks.best([(toxicity.NEGATION, 0.0), (toxicity.INSULT, 2.0), (toxicity.REPORT, 0.0)]) == (0.5, [toxicity.INSULT | toxicity.NEGATED | toxicity.REPORTED])
    assert toxicity._targeted().best([(toxicity.INSULT, 1.0), (0, 0.0)]) == (1.0, [toxicity.INSULT]) and toxicity._targeted().best([]) == (0.0, [])
    assert grammar.clauses.best([(0, 0.0)] * 5) == (0.0, [])


def plain_learn(train):
    """Learned words, from lists."""
    tokens = lambda t: toxicity.TOKEN.findall((t or "").lower())
    pos, neg = (sum(y == k for _, y, _ in train) for k in (1, 0))
    targets = set(toxicity.WORDS[toxicity.TARGET].split())
    around, rows, aimed, seen = (collections.defaultdict(set) for _ in range(4))
    for row, y, t in train:
        if y:
            w = ["", *[x for x in tokens(t) if x[0].isalpha()], ""]
            for k in range(1, len(w) - 1):
                for f in toxicity.features_of(w[k]):
                    around[f].add((w[k - 1], w[k + 1]))
                    rows[f].add(row)
                    if w[k - 1] in toxicity.INTENT and targets & set(w[k + 1 : k + 3]) or w[k - 1] in targets and toxicity.INTENT & set(w[max(0, k - 3) : k]):
                        aimed[f].add(row)
        else:
            for x in set(tokens(t)):
                if x[0].isalpha():
                    for f in toxicity.features_of(x):
                        seen[f].add(row)
    rate, out = pos / (pos + neg), ({}, {})
    for f in around:
        p, n = min(len(around[f]), len(rows[f])), len(seen[f])
        share = p / (p + n)
        if p < 3 or share <= max(0.5, 2 * rate):
            continue
        if (p + n) * (share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if n else 0)) >= 14:
            out[2 * len(aimed[f]) >= len(rows[f])][f] = math.log((p + 0.5) / (n + 0.5)) - math.log(rate / (1 - rate))
    return out


def test_toxicity_learns_as_a_plain_version(spark, monkeypatch):
    rows, labels = labelled()
    rng = np.random.default_rng(9)
    train = []
    for k, (t, y) in enumerate(zip((r[1] for r in rows), (y for _, y in labels), strict=True)):
        threat = f" we {rng.choice(['will', 'shall', 'gonna', 'werde', 'vais'])} {rng.choice(['garvel', 'plorn'])} {rng.choice(['you', 'them', 'him', 'dich', 'vous'])}" if y and k % 2 else ""
        train.append((k, y, t + threat))
    train += [(10_000, 1, None), (10_001, 0, "")]
    table = spark.createDataFrame(train, "row long, y int, body string")
    pos, neg = sum(y for _, y, _ in train), sum(not y for _, y, _ in train)
    want = plain_learn(train)
    assert {"grobian", "schnulf", "zonktar"} <= set(want[0]) and {"garvel", "plorn"} <= set(want[1])
    for most in (300_000, 1):  # the features that are counted are sent around, or all are counted
        monkeypatch.setattr(toxicity, "SENT", most)
        for got, one in zip(toxicity.learn(table, pos, neg), want, strict=True):
            assert got == {f: pytest.approx(w) for f, w in one.items()}


def test_toxicity_fit_is_the_best_one(spark):
    rows, labels = labelled(300)
    grammar, w = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    used = [(grammar.vector(t), y) for (i, t, _), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([[*v, 1.0] for v, _ in used]), np.array([y for _, y in used])
    loss = lambda w: np.log1p(np.exp(-np.where(y == 1, 1, -1) * (x @ w))).sum() + 0.5 * (w[:-1] ** 2).sum() + 0.5e-6 * w[-1] ** 2
    assert all(loss(w) <= loss(w + d) + 1e-9 for d in np.random.default_rng(1).normal(size=(200, len(w))) * 0.01)


# --- mixing


def test_mixing(spark):
    rows = corpus()
    df = docs(spark, rows)
    got = mixing.mixed(df).select("doc_id", "text", "source", "mix").collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight, total = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values())
    target, capped = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in got:
        assert r.mix["source_size"] == sizes[r.source] and r.mix["target"] == pytest.approx(target[r.source])
        assert r.mix["copies"] in (math.floor(target[r.source] / sizes[r.source]), math.floor(target[r.source] / sizes[r.source]) + 1) and r.mix["copies"] <= 3
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed(df.repartition(5)).select("doc_id", "text", "source", "mix").collect()))
    assert mixing.emitted(df).count() == sum(r.mix["copies"] for r in got)
    known = mixing.mixed(df.withColumns({"known": mixing.sized(df), "told": mixing.digested()}), size="known", digest="told").select("doc_id", "text", "source", "mix").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, known))
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    for r in mixing.mixed(df).groupBy("source").agg(F.first("mix.target").alias("t"), F.sum(F.col("mix.size") * F.col("mix.copies")).alias("n")).collect():
        assert abs(r.n - r.t) < 0.05 * r.t


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mixing_draws_rows_of_one_id_each(spark, doc_id):
    rows = [(doc_id, f"text {k}", "a") for k in range(3000)] + [(k, "a b c", "b") for k in range(1000)]
    for r in mixing.mixed(docs(spark, rows)).groupBy("source").agg(F.first("mix.target").alias("t"), F.sum(F.col("mix.size") * F.col("mix.copies")).alias("n")).collect():
        assert abs(r.n - r.t) < 0.06 * r.t


# --- near duplicates


def exact_components(rows, size):
    sets = {}
    for k, (_, t, _) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        n = max(1, min(size, len(w)))
        sets[k] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and None not in (rows[a][0], rows[b][0]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k in sets:
        least.setdefault(find(k), []).append(rows[k][0])
    return sorted([(rows[k][0], len(sets[k]), None if rows[k][0] is None else min(x for x in least[find(k)])) for k in sets], key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(spark, size):
    rows = corpus()
    got = minhash.near_duplicates(docs(spark, rows), shingle=size).collect()
    assert sorted(map(tuple, got), key=repr) == exact_components(rows, size)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(9)
    words, rows = [f"w{k}" for k in range(300)], []
    base = rng.choice(words, 120).tolist()
    for k in range(150):
        t = list(base)
        for at in rng.integers(120, size=int(rng.integers(1, 14))):
            t[int(at)] = str(rng.choice(words))
        rows.append((k, " ".join(t), "s"))
    got = minhash.near_duplicates(docs(spark, rows), shingle=2).collect()
    assert sorted(map(tuple, got), key=repr) == exact_components(rows, 2)


@pytest.mark.parametrize("turn", [1, -1])
def test_near_duplicates_of_ids_with_several_texts(spark, turn):
    rng = np.random.default_rng(5)
    a, b, c, d = (rng.choice([f"w{k}" for k in range(400)], 60).tolist() for _ in range(4))
    near = lambda t: " ".join([*t[:-1], "changed"])
    a, b, c, d = map(" ".join, (a, b, c, d))
    rows = [(1, a, "s"), (1, b, "s"), (2, near(a.split()), "s"), (3, near(b.split()), "s"),  # two classes whose least id is 1, each with a link
            (4, c, "s"), (9, c, "s"), (9, d, "s"), (9, None, "s"), (10, near(d.split()), "s"), (11, "", "s"), (12, "alone here", "s"), (12, " ", "s"), (None, a, "s"), (None, c, "s")]
    got = minhash.near_duplicates(docs(spark, rows[::turn]), shingle=2).collect()
    want = {1: 1, 2: 1, 3: 1, 4: 4, 9: 4, 10: 4, 11: 11, 12: 12, None: None}
    assert sorted(repr((r.doc, r.component)) for r in got) == sorted(repr((i, want[i])) for i, *_ in rows)


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


# --- decontamination


def brute_hits(rows, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            phrases[tuple(w[k : k + n])].add(i)
    out = []
    for i, t, _ in rows:
        w, hit, found = word.findall(low(t)), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [10, 10**6])
def test_decontamination_against_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 500)
    rows = corpus()
    items = [(1, " ".join(rows[0][1].split()[5:30])), (2, " ".join(rows[1][1].split()[:4]).upper() + "!"), (30, rows[2][1].replace(" ", ", ")), (4, "w1"), (5, None), (6, "?!"), (7, " ".join(rows[0][1].split()[10:50])), (None, " ".join(rows[9][1].split()[20:45])), (None, "w2")]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, decon string")
    got = decontaminate.find(docs(spark, rows), bench, most=most).select("doc_id", "decon").collect()
    mine = sorted([(r.doc_id, r.decon["n_words"], sum(b - a for a, b in r.decon["spans"]), r.decon["items"]) for r in got], key=repr)
    assert mine == brute_hits(rows, items)
    assert decontaminate.find(docs(spark, rows), bench.limit(0)).where("size(decon.items) > 0").count() == 0
    assert decontaminate.find(docs(spark, []), bench).count() == 0


def test_fm_index():
    rng = np.random.default_rng(4)
    for sigma in (1, 2, 7, 300):
        seq = rng.integers(0, sigma, 500)
        seq = np.concatenate([seq, seq[100:300], np.zeros(40, dtype=np.int64)])
        index = decontaminate.FMIndex(seq, sigma)
        for n in (1, 3, 9):
            for at in rng.integers(0, len(seq) - n, 10):
                p = seq[at : at + n]
                lo, hi = index.search(p[None, :])
                want = [k for k in range(len(seq) - n + 1) if (seq[k : k + n] == p).all()]
                assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want
