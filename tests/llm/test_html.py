import html
import re

import numpy as np
from terrane.llm import boosting
from terrane.llm import html as H

PAGE = """<html><body><header class="site-header"><a href="/">My Site</a><p>The best news site in town for you.</p></header>
<div id="menu"><a href=1>Home</a> <a href=2>World</a> <a href=3>Sport</a></div><div class="cookie-banner"><p>We use cookies. By continuing you accept our policy and all of the terms.</p><button>OK</button></div>
<div class="content"><h1>Great title</h1><p>First paragraph of the article, it has quite   a few words &amp; things in it.</p><div class="ad-slot">Buy this great product now for only ten dollars.</div>
<p>Third paragraph goes on and on.<ul><li>one item<li>two item</ul><form action=x><label>Your email</label><input><button>Subscribe</button></form></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href=x>Other story about cats</a></li></ul><p>Some promotional text in the sidebar, long enough to confuse.</p></div>
<section id="comments"><h2>Comments</h2><div class="comment"><b>Joe</b><p>I really liked this article, it was very informative and well written.</p></div></section>
<footer><p>Copyright 2024 My Site. All rights reserved.</p></footer></body></html>"""

# ruff: noqa: E501
TEXT = "This is a sentence of the main article text which goes on for a while. "
NOISE = "Boilerplate words here for nothing. "
TEMPLATES = {
"wp":f"""<body class="home"><div id="page"><header id="masthead"><div class="site-branding"><h1 class="site-title">Blog</h1><p class="site-description">{NOISE}</p></div><nav id="site-navigation"><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></nav></header><div id="content"><main id="main"><article id="post-1" class="post hentry"><header class="entry-header"><h1 class="entry-title">MAIN title</h1><div class="entry-meta">Posted on <a href=x>May 5</a> by <a href=y>Joe</a></div></header><div class="entry-content"><p>MAIN {TEXT}</p><p>MAIN {TEXT*3}</p><blockquote><p>MAIN quoted text</p></blockquote><div class="sharedaddy share"><a href=z>Tweet</a></div></div><footer class="entry-footer">Posted in <a href=q>News</a></footer></article><div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><p>{TEXT}</p></article></li><li class="comment"><article class="comment-body"><p>{TEXT*2}</p></article></li></ol><div id="respond"><form><textarea></textarea><p>{NOISE}</p></form></div></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent Posts</h2><ul><li><a href=1>One</a></li></ul></section><section class="widget"><p>{NOISE*3}</p></section></aside><footer id="colophon"><p>{NOISE}</p></footer></div></body>""",
"plain div":f"""<html><body><div class="top-bar">{NOISE}</div><div class="wrapper"><div class="col"><h2>MAIN head</h2><p>MAIN {TEXT}</p><p>MAIN {TEXT}</p><table><tr><td>MAIN a</td><td>MAIN b</td></tr></table><p>MAIN {TEXT*2}</p></div><div class="sidebar"><p>{NOISE*2}</p></div></div><div class="footer">{NOISE}</div></body></html>""",
"notice in article":f"""<body><nav><a href=1>x</a> <a href=2>y</a></nav><main><div class="alert notice">{NOISE*2}</div><article><h1>MAIN t</h1><p>MAIN short.</p><aside class="ad">{NOISE}</aside><p>MAIN {TEXT}</p><form><p>{NOISE}</p></form><ul><li>MAIN one</li><li>MAIN two</li></ul></article></main><section class="comments"><p>{TEXT*2}</p><p>{TEXT}</p></section><footer>x</footer></body>""",
"tiny":"<body><header>Site header words</header><article><p>MAIN one.</p></article><aside>side words here</aside><footer>foot words here</footer></body>",
"long comments":f"""<body><header><h1>Site</h1></header><article><h1>MAIN T</h1><p>MAIN {TEXT}</p></article><div class="comments">{''.join(f'<div class="comment"><p>{TEXT*4}</p></div>' for _ in range(12))}</div><footer>f</footer></body>""",
"no semantic":f"""<body><table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><h1>MAIN T</h1><p>MAIN {TEXT*3}</p><p>MAIN {TEXT*2}</p></td></tr></table><p>Copyright 2020 all rights.</p></body>""",
"section":f"""<body><div role="banner"><p>{NOISE}</p></div><div role="navigation"><ul><li><a href=1>q</a></li></ul></div><section class="story"><h1>MAIN T</h1><div>MAIN {TEXT}</div><div>MAIN {TEXT}</div><div class="promo">{NOISE}</div><div>MAIN {TEXT}<br>MAIN {TEXT}</div></section><div role="complementary">{NOISE*2}</div><div role="contentinfo">{NOISE}</div></body>""",
"cookie":f"""<body><div id="cookie-consent"><p>{NOISE*3}</p><button>Accept</button></div><header class="hdr"><div class="logo">Logo</div></header><div id="main-content"><h1>MAIN T</h1>{''.join(f'<p>MAIN {TEXT}</p>' for _ in range(8))}<div class="newsletter-signup"><p>{NOISE}</p></div><div class="related-posts"><h3>Related</h3><ul><li><a href=1>Other thing to read today</a></li></ul></div></div></body>""",
}


def test_templates():
    for name, got in zip(TEMPLATES, H.main_texts(list(TEMPLATES.values()), H.trained()), strict=True):
        assert all("MAIN" in x for x in got.split("\n")), name
        assert got.count("MAIN") == TEMPLATES[name].count("MAIN"), name


def test_hand_made_page():
    got = H.main_texts([PAGE], H.trained())[0]
    assert got == "Great title\nFirst paragraph of the article, it has quite a few words & things in it.\nThird paragraph goes on and on.\none item\ntwo item"


PARAGRAPHS = [" ".join(f"Sentence {i} of paragraph {k} tells the reader something about the matter at hand." for i in range(4)) for k in range(4)]
ARTICLE = "<h1>A title of the article</h1>" + "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
NAV, FOOT = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>', '<footer><p>Copyright 2024. All rights reserved.</p></footer>'
ITEMS = ["Two eggs", "One cup of milk", "A pinch of salt", "Mix all.", "Bake."]
WRAPPED = {
    **{f'<div class="{c}">': f'<div class="{c}">{ARTICLE}</div>' for c in ("with-sidebar", "layout", "menu-open", "has-sidebar content", "page with-nav no-footer", "sidebar-layout")},
    "main in with-sidebar": f'<div class="with-sidebar"><main><article>{ARTICLE}</article></main></div>',
    "form": f'<form id="f"><div class="content">{ARTICLE}</div></form>',
    "form around the page": f'<form method="post" action="./default.aspx" id="aspnetForm">{NAV}<div id="content">{ARTICLE}</div>{FOOT}</form>',
}


def test_articles_in_forms_and_in_elements_named_by_what_they_have():
    for name, body in WRAPPED.items():
        for page in (f"<html><body>{body}</body></html>", f"<html><body>{NAV}{body}{FOOT}</body></html>"):
            assert H.main_texts([page], H.trained())[0] == "\n".join(["A title of the article", *PARAGRAPHS]), name


def test_lists_of_a_few_words():
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in ITEMS) + "</ul>"
    for body, wanted in ((f"<main><h1>Pancakes for two</h1>{listed}</main>", ["Pancakes for two", *ITEMS]), (f"<main>{listed}</main>", ITEMS), (f"<article><h1>Pancakes</h1>{listed}<p>{PARAGRAPHS[0]}</p></article>", ["Pancakes", *ITEMS, PARAGRAPHS[0]])):
        assert H.main_texts([f"<html><body>{NAV}{body}{FOOT}</body></html>"], H.trained())[0] == "\n".join(wanted)


def test_given_pages():
    import duckdb

    rows = duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet' order by page_id").fetchall()
    wrong = []
    for (page, source), got in zip(rows, H.main_texts([r[1] for r in rows], H.trained()), strict=True):
        body = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|ul|li|div)>|<br>", re.sub(r"<[^<>]*\Z", "", body))]
        if got != "\n".join(x for x in blocks if x):
            wrong.append(page)
    assert not wrong


def test_decoding_is_consistent():
    nodes = H.Nodes()
    H.parse(PAGE, 0, nodes)
    rng = np.random.default_rng(0)
    parent = np.array(nodes.parent)
    for _ in range(20):
        kept = H.decode(nodes, rng.normal(size=len(parent)) * 3)
        assert all(kept[p] for p, k in zip(parent, kept, strict=True) if k and p >= 0)


def test_decoder_finds_the_best_choice():
    nodes = H.Nodes()
    H.parse("<div><p>a</p><p>b c</p></div><div>d</div>", 0, nodes)
    parent, n = nodes.parent, len(nodes.parent)
    margin = np.random.default_rng(7).normal(size=n) * 2
    weight = np.array([1 + np.log1p(t.count(" ") + 1 if t else 0) for t in nodes.text])
    best = max((c for c in range(1 << n) if all(not c >> i & 1 or parent[i] < 0 or c >> parent[i] & 1 for i in range(n))), key=lambda c: sum(margin[i] * weight[i] for i in range(n) if c >> i & 1))
    assert list(H.decode(nodes, margin)) == [bool(best >> i & 1) for i in range(n)]


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    f = boosting.fit(x, y)
    assert ((f.margin(x) > 0) == (y > 0)).mean() > 0.95


def test_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>just a fragment &lt;b&gt; of   text</p>"), (3, None, "<a href='x"), (4, "u", "<script>x</script>"), (5, "u", "<p>" + "long words here. " * 60000 + "</p>"), (6, "u", "<" * 5000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text) for r in H.extract_text(pages, out="text").collect()), key=str)
    assert [t for i, t in got if i in (1, 2, 4)] == ["", "", ""] and len(got) == len(rows)
    assert len(next(t for i, t in got if i == 5)) == 60000 * 17 - 1
    assert H.extract_text(pages.limit(0)).count() == 0


def test_deep_nesting_takes_proportional_time():
    import time

    from terrane.llm import html as H

    forest = H.trained()
    for tag, end in (("div", "</div>"), ("div", ""), ("b", ""), ("option", ""), ("p", ""), ("li", "")):
        began = time.time()
        H.main_texts([f"<{tag}>" * 60_000 + "words of some text" + end * 60_000], forest)
        assert time.time() - began < 6, tag


def test_raw_elements_without_an_end():
    from terrane.llm import html as H

    forest = H.trained()
    body = " ".join(f"Sentence number {i} of an article that is long enough to be one." for i in range(20))
    page = "<html><body><datalist><option value=a></datalist><article><p>{}</p></article><select><option>x</option></select></body></html>"
    assert H.main_texts([page.format(body)], forest) == [body]
    assert H.main_texts(["<body><iframe src=x><article><p>" + body + "</p></article>"], forest) == [body]
    assert H.main_texts(["<body><script>var x = 1; <article><p>" + body + "</p></article>"], forest) == [""]
