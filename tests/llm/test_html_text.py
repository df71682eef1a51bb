import random
import re
import time

import pytest

from lattica.llm.html_text import extract, extract_pages

P = "A paragraph of the article, with commas, and with enough words to score, as articles have."
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>'


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words only", "plain words only"),
    (f"<nav><a href=x>Menu</a></nav><article><h1>T &amp; t</h1><p>{P}</p><p>x&nbsp;&lt;&#121;</p></article><footer>c</footer>", f"T & t\n\n{P}\n\nx <y"),
    (f'<div class="ad">{P}</div><div class="content"><p>{P}<p>{P} 2<br>on</div><div id="comments"><p>{P} no</div>', f"{P}\n\n{P} 2 on"),
    (f"<script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><main><p>{P}</p><form><p>{P}</p></form></main>", P),
    (f"<article><p>{P}</p><p>1 < 2 and 3 > 2</p></article>", f"{P}\n\n1 < 2 and 3 > 2"),
    (f"<div><ul><li><a href=a>one two</a></li><li><a href=b>three four</a></li></ul><p>{P}</p></div>", P),
    (f"<article><p>{P}</p></article><div hidden><p>{P}</p></div><div role=alert><p>{P}</p></div>", P),
    (f'<form id="page"><p>Menu text here, of the form, which is dropped</p><article><p>{P}</p></article></form>', P),
    (f'<form id="page"><div class="content"><p>{P}</p><p>{P}</p></div></form>', f"{P}\n\n{P}"),
    (f'<div class="layout has-sidebar"><div class="content"><p>{P}</p></div><div class="left-sidebar"><p>{P} no</p></div></div>', P),
    ("<article></article>", ""), ("<p>unclosed <b>tags <i>everywhere", "unclosed tags everywhere"), ("<" * 50, "<" * 50),
    ("a<b", "a<b"), ("<!-- open <p>x</p>", ""), ("<p>a<![CDATA[b]]>c</p>", "abc"), ("<p>x</p><script>y", "x"), ("<p title='a>b'>c</p>", "c"), ("<p title='a>b>c</p>", "b>c"),
])
def test_pages(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("inner, text", [
    (f'<h2 id="navigation">Navigation</h2><p>{P}</p><h2 id="related-work">Related work</h2><p>{P}</p>', f"Navigation\n\n{P}\n\nRelated work\n\n{P}"),
    (f'<p>{P}</p><section id="discussion"><h2>Discussion</h2><p>{P}</p></section>', f"{P}\n\nDiscussion\n\n{P}"),
    (f'<p>{P}</p><div class="footnotes"><p>1. A note.</p></div><div class="notice-period"><p>Three months.</p></div>', f"{P}\n\n1. A note.\n\nThree months."),
    (f"<p>{P} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, <label>so</label> it is.</p>", f"{P} x=2 holds, so it is."),
    (f"<p>{P}</p><h2>Sources</h2><ul><li><a href=a>The first source</a></li><li><a href=b>The second source</a></li></ul>", f"{P}\n\nSources\n\nThe first source\n\nThe second source"),
    (f"<header><h1>Title</h1><p>By somebody</p></header><p>{P}</p>", f"Title\n\nBy somebody\n\n{P}"),
    (f'<p>{P}</p><div class="ad-slot">Buy this now!</div><div class="notice">We use things.</div><section class="comments"><h2>Comments</h2><p>{P}</p></section><p>{P}</p>', f"{P}\n\n{P}"),
    (f'<p>{P}</p><div class="share-buttons"><a href=x>Share</a></div><ul class="related-posts"><li><a href=x>Another</a></li></ul><aside><p>{P}</p></aside>', P),
])
def test_articles(inner, text):
    assert extract(f"<body>{NAV}<header><h1>Site</h1></header><article>{inner}</article><footer>c</footer></body>") == text


@pytest.mark.parametrize("inner, text", [
    (f'<h1>Title</h1><div class="content"><p>{P}</p><p>{P}</p></div>', f"Title\n\n{P}\n\n{P}"),
    (f'<div class="content"><header><h1>Title</h1></header><p>{P}</p><p>{P}</p></div>', f"Title\n\n{P}\n\n{P}"),
    ("".join(f"<section><h2>Part {k}</h2><p>{P if k != 2 else 'Only short text here.'}</p></section>" for k in range(4)), "\n\n".join(f"Part {k}\n\n{P if k != 2 else 'Only short text here.'}" for k in range(4))),
    (f"<article><div><section>{f'<p>{P}</p>' * 5}</section><section><p>One short part, of its own.</p></section></div><h1>Late</h1></article>", "\n\n".join([P] * 5) + "\n\nOne short part, of its own.\n\nLate"),
    (f'<div class="content"><p>{P}</p><p>Sources:</p><ul><li><a href=a>First of the sources</a></li></ul></div>', f"{P}\n\nSources:\n\nFirst of the sources"),
])
def test_containers(inner, text):
    assert extract(f"<body>{NAV}<div id=wrap>{inner}</div><footer>c</footer></body>") == text


@pytest.mark.parametrize("part", ["<a ", "<script ", "<a b='", '<a b=">" ', "<b>", "<div>", "<p><b>", "<b></i>", "<li>", "<ul><li>", "<center><li>", "</p>", "<!--", "<![CDATA[", "<i><article><b></i>", "<article>", "</article>", "<td>x", "&", "<div>words, of text ", "<a href=x>", "<title>", "<section class=ad>x", "= '", "<p a= '>"])
def test_time_is_linear(part):
    begin = time.process_time()
    extract(part * ((1 << 19) // len(part)))
    assert time.process_time() - begin < 4


def test_random_markup_never_raises():
    draw = random.Random(6)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "text, ", P, "<a href=x>", "</a>", "<ul><li>", "</ul>", "<!--", "-->", "<", ">", "'", '"', "=", "&amp;", "<h1>", "</h1>", "<body>", "</body>", "<form>", "<header>", "<script>", "</script>", "<table><tr><td>", "<main>", "<![CDATA["]
    for _ in range(3000):
        extract("".join(draw.choice(parts) for _ in range(draw.randint(1, 60))))


def test_made_pages_precision_and_recall():
    """Whole pages whose article is known, in six layouts with marked parts around and inside it."""
    draw = random.Random(8)
    sentence = lambda: " ".join(draw.choice(("alpha", "beta,", "gamma", "delta", "of", "the,")) + str(draw.randint(0, 999)) for _ in range(draw.randint(6, 14))) + "."
    found = wanted = shared = 0
    for k in range(300):
        blocks, body = [], []
        for _ in range(draw.randint(2, 9)):
            kind = draw.choice("ppphlq")
            text = " ".join(sentence() for _ in range(draw.randint(1, 4) if kind == "p" else 1))
            blocks.append(text)
            body.append({"p": f"<p>{text}</p>", "h": f"<h2>{text}</h2>", "l": f"<ul><li>{text}</li></ul>", "q": f"<blockquote>{text}</blockquote>"}[kind])
        blocks.insert(0, " ".join(sentence() for _ in range(3)))
        body.insert(0, f"<p>{blocks[0]}</p>")
        for name in draw.sample(("ad", "comments", "newsletter-signup", "share-buttons", "cookie-banner"), 2):
            junk = f'<div class="{name}"><p>{sentence()}</p></div>'
            body.insert(draw.randint(1, len(body)), junk)
        inner, title = "".join(body), sentence()
        around = draw.choice(("<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<div><div id=story>{}</div></div>", "<section>{}</section>", "<table><tr><td>{}</td></tr></table>"))
        page = f"<html><body><header>{sentence()}</header>{NAV}{around.format(f'<h1>{title}</h1>' + inner)}<aside><p>{sentence()}</p></aside><footer>{sentence()}</footer></body></html>"
        words = lambda texts: set(re.findall(r"\w+", " ".join(texts)))
        got, want = words([extract(page)]), words([title, *blocks])
        found, wanted, shared = found + len(got), wanted + len(want), shared + len(got & want)
    assert shared / found > 0.97 and shared / wanted > 0.97, (shared / found, shared / wanted)


def test_frame(spark):
    rows = [(1, "u", f"<article><p>{P}</p></article>", "x"), (1, "u", f"<article><p>{P}</p></article>", "x"), (None, None, None, "x"), (2, "v", "<p>" + "long, words " * 20_000, "x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.n_chars) for r in got[:3]] == [(1, len(P)), (1, len(P)), (None, 0)] and got[3].n_chars == 20_000 * 12 - 1
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
