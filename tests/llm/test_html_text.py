import itertools
import random

from tallybrook.llm import html_text as H

LONG = "A sentence that is long enough to be read as part of the main text of a page, with a comma. And one more."


def page(body, head="<title>The title</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style><script>var t = '</p><p>no</p>';</script></head><body>{body}</body></html>"


def test_article_without_the_rest():
    text = H.main_text(
        page(
            f"""<header><a href="/">Home</a></header><nav><ul><li><a href=a>One</a><li><a href="b>c">Two</a></ul></nav>
            <div class="cookie-notice">We use cookies. Accept them all, please, so that this site can work well for you.</div>
            <article><h1>Head &amp; shoulders</h1><p>{LONG}<br><p><b>Short</b> one.<!-- <p>no</p> --><ul><li>Item&nbsp;one</li><li>Item
            two</li></ul><form><p>Sign up now for our letter, it is free and comes weekly to you.</p></form>
            <section id="comments"><h2>Comments</h2><p>{LONG}</p></section></article>
            <aside><p>{LONG}</p></aside><div class="ad">{LONG}</div><footer>&copy; all rights reserved</footer>"""
        )
    )
    assert text == f"Head & shoulders\n{LONG}\nShort one.\nItem one\nItem two"


def test_plain_divisions():
    text = H.main_text(page(f'<div id="menu"><a href=x>A</a> <a href=y>B</a></div><div class="content"><h2>Title</h2><div>{LONG}</div><div>Yes.</div><div>{LONG}</div></div><div class="sidebar"><p>{LONG}</p></div>'))
    assert text == f"Title\n{LONG}\nYes.\n{LONG}"


def test_fallback_content_of_an_article_stays():
    for tag in ("object", "canvas", "audio", "video"):
        assert H.main_text(page(f"<article><p>{LONG}</p><{tag}><p>{LONG} Fallback.</p></{tag}></article>")) == f"{LONG}\n{LONG} Fallback."
    assert H.main_text(page(f"<article><p>{LONG} <svg><title>no</title><text>drawn words</text></svg></p></article>")).endswith("drawn words")


def test_odd_pages():
    for raw in ("", " ", "<", "<p", "<script>x", "<!-- x", "<nav>menu</nav>", "</p></p></div>"):
        assert H.main_text(raw) == "" or raw == "<p" or raw == "<"
    assert H.main_text(f"<p>{LONG}") == LONG
    assert H.main_text("<div>" * 3000 + LONG) == LONG
    many = H.main_text("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>")
    assert many.count("\n") == 4999


def test_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 9)
        costs = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(k, k + 1, rng.randint(0, 6)) for k in range(n - 1)] + [(a, b, rng.randint(0, 5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.2]

        def value(labels):
            return sum(c for c, x in zip(costs, labels) if x) + sum(w for a, b, w in edges if labels[a] != labels[b])

        assert value(H.minimum_cut(costs, edges)) == min(map(value, itertools.product((False, True), repeat=n)))


def test_tables(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in H.extract(df).collect())
    assert [x[3] for x in got] == [0, len(LONG), len(LONG), 0] and got[1][2] == LONG
    assert H.extract(df.where("false")).collect() == []


def test_words_of_layout_do_not_lose_the_article():
    story = "".join(f"<p>This is paragraph {k} of the story, and it is long enough to be one of the article's own, as anyone can see.</p>" for k in range(6))
    side = "<ul><li><a href=x>One</a></li><li><a href=x>Two</a></li></ul>"
    for wrapper in ('<div class="content-sidebar-wrap">', '<div id=page class="has-sidebar">', '<div class="header-banner share">'):
        for inner in ("<article>", "<main>", "<div>"):
            page = f"<html><body><nav>{side}</nav>{wrapper}{inner}{story}</{inner[1:-1]}><div class=sidebar>{side}</div></div></body></html>"
            got = H.main_text(page)
            assert all(f"paragraph {k} " in got for k in range(6)) and "Two" not in got, page
    said = "".join(f"<article><p>Comment {k} says that this is a very fine story, and that many more of them should be told.</p></article>" for k in range(20))
    got = H.main_text(f"<body><article>{story}</article><div class=comments>{said}</div></body>")
    assert "paragraph 5 " in got and "Comment" not in got
    assert "E = mc" in H.main_text(f"<article>{story}<p>Here <math><mi>E</mi> <mo>=</mo> <mi>mc</mi></math> is the formula that the whole of the long text is about.</p></article>")


def test_marked_pages():
    """Blocks of 200 invented pages a style whose kinds are known; the README has these figures."""
    from tests.llm import marked_pages

    for style in ("elements", "classes"):
        for kind, (_, share) in marked_pages.figures(H.main_text, style).items():
            assert share < 0.02 if kind in marked_pages.KINDS else share > 0.98, (style, kind, share)
    plain = marked_pages.figures(H.main_text, "plain")
    assert all(share > 0.98 for kind, (_, share) in plain.items() if kind not in marked_pages.KINDS)
    assert all(plain[kind][1] < 0.02 for kind in ("menu", "header", "footer", "form", "related"))


def test_damaged_pages_take_time_by_their_length():
    import time

    n = 1_000_000
    for unit in ("<a ", '<a "x>"', "<!-- ", "<! ", "<select>", "<div></p>", "<section><tr></tr>", "<li><p>x", '<p a="', "<script>", "<"):
        for tail in ("", ">"):
            began = time.process_time()
            H.main_text(unit * (n // len(unit)) + tail)
            assert time.process_time() - began < 20, unit


def test_damaged_markup_is_read_as_far_as_it_goes():
    assert H.main_text(f'<p title="x>{LONG}</p>') == H.main_text(f"<p>{LONG}</p>") == LONG
    assert H.main_text(f"<p title='a>b' class=x>{LONG}<!-- never closed {LONG}") == LONG
    assert H.main_text(f"<select><p>{LONG}</p>") == LONG
    assert H.main_text(f"<ul><li>{LONG}<section><li>{LONG}</section></ul></div></p>") == f"{LONG}\n{LONG}"
