"""Vector searches and page extraction against brute force, on odd rows and on empty tables."""

import numpy as np
import pytest

from assetloom.llm import html, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    out = [(i, (r.normal(size=12) * (1 + i % 7) ** (i % 3)).astype(np.float32).tolist()) for i in range(900)]
    same = r.normal(size=12).astype(np.float32).tolist()
    out += [(900 + i, same) for i in range(300)]  # one vector in a quarter of the rows
    out += [(1300, None), (1400, [1.0, None] + [0.0] * 10), (1500, [float("nan")] * 12), (1600, [float("inf")] + [0.0] * 11), (1700, [0.0] * 12), (1800, [1.0, 2.0]), (1900, []), (None, same), (20, same), (100, same)]
    return out


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def padded(v, as_int):
    x = np.array([*v, *[0.0] * (12 - len(v))], dtype=np.float64)
    return [int(np.floor(1024 * y)) for y in x[: len(v)]] + [0] * (12 - len(v)) if as_int else x


@pytest.mark.parametrize("block", [50, 8192])
def test_exact_top_k(spark, rows, block):
    from pyspark.sql import functions as F

    ok = frame(spark, rows).where(vectors.usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    mine = ok.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("v"))
    got = vectors.exact_top_k(spark, mine, F.col("id") % 100 == 0, block=block, query_block=3, longest=64).collect()
    held = [(i, padded(v, True)) for i, v in rows if i is not None and usable(v)]
    queries = {}
    for i, v in held:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    want = []
    for q, v in queries.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in held if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_pruning_by_coordinates_is_exact():
    r = np.random.default_rng(4)
    v = r.normal(size=(3000, 6))
    v = (v / np.linalg.norm(v, axis=1)[:, None] * r.uniform(1000, 1050, (3000, 1))).astype(np.int64)  # as in a band
    q = np.concatenate((v[:40] * 3, (r.normal(size=(10, 6)) * 500).astype(np.int64)))
    b, product = vectors.Bucket(np.arange(3000), v), v @ q.T
    theta = np.sort(product, axis=0)[-10].astype(float)
    found = {i: (ids.tolist(), s.tolist()) for i, ids, s in b.search(np.full(len(q), -1), q, theta, 10)}
    assert np.isfinite(b.switch)
    for i in range(len(q)):
        order = np.lexsort((np.arange(3000), -product[:, i]))[:10]
        assert found[i] == (order.tolist(), product[order, i].tolist())


def test_products_beyond_doubles():
    big = np.full((1, 4), 2**31, dtype=np.int64)
    assert vectors._products(big, np.array([[1, 1, 1, 3]])).tolist() == [[6 * 2**31]]
    assert vectors._products(big, big).tolist() == [[2**63 - 1]]
    least = np.full((1, 1), -(2**63), dtype=np.int64)
    assert vectors._products(least, least).tolist() == [[2**63 - 1]] and vectors._products(least, -(least + 1)).tolist() == [[-(2**63)]]


def test_neighbours(spark, rows):
    got = vectors.op6_near(spark, frame(spark, rows)).collect()
    held = [(i, padded(v, False)) for i, v in rows if i is not None and usable(v) and any(v)]
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    queries = {i for i, _ in held if i % 20 == 0}
    assert set(by) == queries
    hits = total = 0
    for q in sorted(queries - {20, 100})[::3]:
        v = next(w for i, w in held if i == q)
        scores = sorted((-(v * w).sum(), i) for i, w in held if i != q)
        mine = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += len({i for _, i in scores[:20]} & {r["vec_id"] for r in mine})
        total += 20
    assert hits >= 0.9 * total


@pytest.mark.parametrize("n", [10, 40])
def test_no_query_has_too_few_neighbours(spark, n):
    r = np.random.default_rng(9)
    far = r.normal(size=(n, 12)).astype(np.float32)
    far[1:] = -far[0] + far[1:] / 50  # all candidates lie opposite the query
    got = vectors.op6_near(spark, frame(spark, [(i, v.tolist()) for i, v in enumerate(far)])).collect()
    for q in range(0, n, 20):
        scores = sorted((-(far[q].astype(float) * far[i].astype(float)).sum(), i) for i in range(n) if i != q)[:20]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [x for x, _ in mine] == list(range(1, len(scores) + 1))
        assert q or [i for _, i in mine] == [i for _, i in scores]


def test_cells_are_visited_by_their_chance():
    """The estimate against counting: of points at a distance, so many fall into the cells that hold half the chance."""
    t, r = vectors.Tables(40, 1, 2, 1.0, 0.8), np.random.default_rng(0)
    q = r.normal(size=(20, 40))
    q /= np.linalg.norm(q, axis=1)[:, None]
    chance = t.success(0, q)
    assert np.allclose(chance.sum(axis=1), 1, atol=1e-6)
    hits = 0
    for i in range(20):
        step = r.normal(size=(500, 40))
        cells = t.cells(0, q[i] + 0.8 * step / np.linalg.norm(step, axis=1)[:, None])
        order = np.argsort(-chance[i])
        hits += np.isin(cells, order[: np.searchsorted(np.cumsum(chance[i][order]), 0.5) + 1]).mean() / 20
    assert 0.4 < hits < 0.75


@pytest.mark.parametrize("block", [40, 16384])
def test_neighbours_in_many_blocks(spark, rows, block):
    """Blocks of cells, split cells and several query blocks give the same as one block, but for what cells cut off."""
    from pyspark.sql import functions as F

    held = frame(spark, rows).where(vectors.usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
    mine = held.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    got = vectors.near(spark, mine, F.col("id") % 20 == 0, block=block, query_block=7 if block == 40 else 4096, success=2.0).collect()
    exact = [(i, padded(v, False)) for i, v in rows if i is not None and usable(v) and any(v)]
    for q in (40, 900, 1180):
        v = next(w for i, w in exact if i == q)
        want = sorted((-float((v * w).sum()), i) for i, w in exact if i != q)[:20]
        assert [i for _, i in want] == [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]  # all cells: exact


def test_empty_vectors(spark):
    assert vectors.op1_exact_top_k(spark, frame(spark, [])).count() == 0
    assert vectors.op6_near(spark, frame(spark, [])).count() == 0
    assert vectors.op1_exact_top_k(spark, frame(spark, [(100, [1.0])])).count() == 0
    assert len(vectors.op6_near(spark, frame(spark, [(20, [1.0]), (21, [2.0])])).collect()) == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><a href=/>Site</a> Slogan words here</header><nav><ul><li><a href=/a>Home</a><li><a>News</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies on this page and you agree to that</div><div class=ad>Buy now, it is very cheap</div>
<article><h1>A &amp; B</h1><p><b>First &lt;one&gt;
  of   two<br>lines.<p>Short.</p><blockquote>A quote with <a href=x>one link</a> in it &eacute;.</blockquote><aside>Read also: other things</aside>
<form><p>Subscribe here <input></p></form><section id="comments"><p>I think that this is a long comment of a reader.</p></section></article>
<aside>Side</aside><footer>&copy; all rights</footer></body></html>"""


def test_page():
    assert html.main_text(PAGE, html.trained()) == "A & B\n\nFirst <one> of two lines.\n\nShort.\n\nA quote with one link in it é."


def test_page_without_main_element():
    page = "<body><div id=menu><a>One</a> <a>Two</a></div><h1>Head</h1><div><p>Some words of the text.</p><p>And more of it here</div><ul><li><a>x</a><li><a>y</a></ul><div id='footer'>End</div>"
    assert html.main_text(page, html.trained()) == "Head\n\nSome words of the text.\n\nAnd more of it here"


def test_raw_elements_behind_letters_that_lower_case_lengthens():
    page = "<article><p>" + "\u0130" * 40 + "</p><SCRIPT>var x = '<p>no</p>';</ScRipt><p>All of this is main text.</p><style>p{}</STYLE><p>And so is this.</p></article>"
    assert [b.text for b in html.Parser(page).blocks] == ["\u0130" * 40, "All of this is main text.", "And so is this."]


MANY = "word " * 60


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<nav><a>x</a></nav><div class="content with-sidebar"><h1>Title of this</h1><p>{MANY}</p><p>Short one.</p></div><div class="sidebar"><p>Side words are here</p></div>', ["Title of this", MANY, "Short one."]),
        (f'<form id="aspnetForm"><div><a>Home</a> <a>News</a></div><div><h1>Title here</h1><p>{MANY}</p></div></form>', ["Title here", MANY]),
        (f'<article><header class="entry-header"><h1>The title</h1></header><p>{MANY}</p></article>', ["The title", MANY]),
        (f'<article><section class="legal-analysis"><h2>Law</h2><p>{MANY}</p></section><p>More.</p></article><footer>Legal</footer>', ["Law", MANY, "More."]),
        (f"<div class=zz><p>We use cookies on this page and you agree to it.</p></div><article><h1>A</h1><p>{MANY}</p></article><div><p>Sponsored: buy this thing now, it is cheap</p></div>", ["A", MANY]),
        (f"<article><p>One <button>Copy link</button> two {MANY}</p></article>", ["One two " + MANY]),
        (f"<div>{MANY}</div><article><p>One.</p><p><a href=x>Two</a></p><p>Three</p></article>", ["One.", "Two", "Three"]),
    ],
)
def test_ordinary_pages(page, want):
    assert html.main_text(f"<body>{page}", html.trained()) == "\n\n".join(w.strip() for w in want)


def test_the_tree_looks_at_words_and_neighbours():
    x, y = html.table()
    assert {"words", "links"} < html.trained().used() and html.trained().used() & {"words_before", "words_after", "links_before", "links_after"}
    assert (html.trained().predict(x) == y).mean() > 0.99
    words = html.Tree(x[:, :6], y)  # without any look at the page's structure
    assert (words.predict(x[:, :6]) == y).mean() > 0.9


@pytest.mark.parametrize("bad", ["<a '", "<![CDATA[", '<a "x', '<a b="x', "<!--", "<script>", "<", "</b>", "<b><div>", "<ul><span><li></li>", "<dd></dd>", "<table><td>"])
def test_broken_pages_take_linear_time(bad):
    import time

    began = time.process_time()
    html.main_text("<div>" * 20_000 + bad * (500_000 // len(bad)), html.trained())
    assert time.process_time() - began < 10  # about one second; a quadratic way takes minutes


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</p>", "<a href='", "<script>never closed", "<!-- never closed", "&#0;&bad;", "<p>" * 3000, "<div><span>" * 2000])
def test_broken_pages(page):
    assert isinstance(html.main_text(page, html.trained()), str)


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, None), (2, None, "", 1), (None, "x", "<article><p>" + "word " * 50_000, 2)], "page_id long, url string, html string, n_chars long")
    got = {(r["page_id"], r["n_chars"]) for r in html.op7_html_text(df).collect()}
    assert got == {(1, len(html.main_text(PAGE, html.trained()))), (2, 0), (None, 249_999)}
    assert html.op7_html_text(df.limit(0)).count() == 0


def held_out_pages():
    """24 pages of six templates that the table doesn't hold; blocks that begin with § are main text."""
    import random

    out = []
    for seed in range(10, 14):
        r = random.Random(seed)
        w = lambda a, b: " ".join(f"w{r.randrange(1000)}" for _ in range(r.randint(a, b)))
        p = lambda a=25, b=120: f"<p>§{w(a, b)}</p>"
        call = lambda: r.choice([f"<div>{w(6, 15)}</div>", f"<div>{w(4, 14)} <a href=x>{w(2, 4)}</a></div>", f"<div><a href=y>{w(4, 9)}</a></div>"])
        nav = f"<div><a>{w(1, 2)}</a> <a>{w(1, 2)}</a> <a>{w(1, 1)}</a></div>"
        out.append(f"<body>{nav}<article><header><h1>§{w(4, 9)}</h1></header>{p()}{p()}{call()}{p()}{p()}</article><footer>{w(5, 20)}</footer>")
        out.append(f"<body><main><h1>§{w(3, 8)}</h1><div>§{w(14, 30)}</div>{p(60)}{p()}{call()}{p(60)}<div class='discussion'><h3>{w(1, 1)}</h3>" + "".join(f"<p>{w(10, 60)}</p>" for _ in range(3)) + "</div></main>")
        out.append(f"<body><article><h1>§{w(5, 9)}</h1>{p()}{p()}{p()}<div><h4>{w(1, 2)}</h4>" + "".join(f"<div>{w(8, 40)}</div>" for _ in range(4)) + "</div></article>")
        out.append(f"<body>{nav}<div><h2>§{w(4, 9)}</h2>{p()}{p()}{call()}{p()}</div><div>{w(3, 8)}</div><p><a>{w(2, 3)}</a> <a>{w(2, 3)}</a>")
        out.append(f"<body><article><h1>§{w(4, 8)}</h1><section><h2>§{w(2, 4)}</h2>{p()}{p()}</section><section><h2>§{w(2, 4)}</h2>{p()}<ul><li>§{w(3, 9)}<li>§{w(3, 9)}</ul></section>{call()}</article>")
        out.append(f"<body><article><h1>§{w(4, 8)}</h1>{p(50)}<div>§{w(80, 140)}</div>{p(50)}{call()}</article><aside><p>{w(20, 60)}</p></aside>")
    return out


def test_held_out_pages_of_other_templates():
    right = blocks = differ = whole = 0
    for page in held_out_pages():
        parsed = html.Parser(page)
        x = html.features(parsed)
        want = [b.text.startswith("§") for b in parsed.blocks]
        got = html.trained().predict(x).tolist()
        flags = ((x[:, html.NAMES.index("inside")] == 1) & (x[:, html.NAMES.index("aside")] == 0)).tolist()
        blocks += len(want)
        right += sum(a == b for a, b in zip(got, want, strict=True))
        whole += got == want
        differ += sum(a != f for a, f in zip(got, flags, strict=True))
    assert whole >= 22 and right / blocks > 0.98 and differ >= 24


def test_features_equal_a_plain_reading():
    """Words and link density of a block and its neighbours, recounted from the marked-up page."""
    for page in held_out_pages():
        parsed = html.Parser(page)
        x = html.features(parsed)
        link = [b.link_words / b.words for b in parsed.blocks]
        size = [len(b.text.split()) for b in parsed.blocks]
        for i in range(len(size)):
            around = [v[j] if 0 <= j < len(v) else 0 for j in (i, i - 1, i + 1) for v in (size, link)]
            assert x[i, :6].tolist() == around
    assert {"words", "links", "words_before", "links_before", "words_after"} <= html.trained().used()
