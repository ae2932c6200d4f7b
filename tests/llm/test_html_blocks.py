import html
import random
import re

from callscope.llm import html_blocks as H
from callscope.llm import queries


def article(page):
    """Brute force for the tables' pages: all that stands in <article>."""
    inner = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:h1|p|br|article)>", inner.group(1) if inner else "")
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_query_small(spark, sf_small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    got = queries.op6_html(spark, sf_small).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id])
        assert r.n_chars == len(r.text)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="article">
<header><h1>Site</h1><nav><ul><li><a href=/>Home</a><li><a href='/x>y'>News</a></ul></nav></header>
<div class="cookie-notice">We use cookies and so on, please accept all of them now.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First&nbsp;line
 with <b>bold</b> and <a href="/z">a link</a>.<p>Short.<div class="ad-slot"><p>Buy this now, it is cheap and long enough.</div>
<ul><li>one<li>two</ul><form><label>Name</label><input name=n><button>Send it</button></form><script>var a="</p><p>no</p>";</script>
<p>A &lt;tag&gt; &#233;&#x41; a<!-- hidden <p>x</p> -->b</p><section id="comments"><p>I like this long article very much, thank you.</p></section>
</article></main><aside>More about this and that, and some other things.</aside><footer>&copy; us</footer></body></html>"""


def test_page_with_all_kinds_of_blocks():
    tree = H.train_tree(*H.labelled())
    found = H.blocks(PAGE)
    kept = [b[0] for b, yes in zip(found, H.predict(tree, H.block_features(found))) if yes]
    assert kept == ["Title & more", "First line with bold and a link.", "Short.", "one", "two", "A <tag> éA ab"]


def test_tree_learns_its_table():
    x, y = H.labelled()
    assert (H.predict(H.train_tree(x, y), x) == y).mean() > 0.95


def test_unmarked_page():
    page = ("<body><div><a href=1>One</a></div><div><a href=2>Two</a> <a href=3>Three</a></div>"
            + "".join(f"<p>{'some words of the text ' * n}</p>" for n in (6, 9, 12)) + "<div><a href=4>Next</a></div></body>")
    found = H.blocks(page)
    kept = [b[0] for b, yes in zip(found, H.predict(H.train_tree(*H.labelled()), H.block_features(found))) if yes]
    assert kept == [("some words of the text " * n).strip() for n in (6, 9, 12)]


def test_edge_cases(spark):
    pages = [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "plain words", "<a href=\"x>y", "</div></p>text", "&am &amp &bogus; &#0;",
             "<article>" + "<p>word word</p>" * 60_000 + "</article>", "<div>" * 5000 + "deep", "<" * 50_000, "<a '" * 20_000]
    rows = [(i, None, p, "n") for i, p in enumerate(pages)] + [(0, "u", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert len(got) == len(pages)
    assert [got[i] for i in range(7)] == ["", "", "", "<", "<p", "", ""]
    assert got[7] == "plain words" and got[9] == "text" and got[12] == "deep"
    assert len(got[11].split("\n")) == 60_000
    assert H.extract(df.limit(0)).count() == 0


def kept(page):
    found = H.blocks(page)
    return [b[0] for b, yes in zip(found, H.predict(H.train_tree(*H.labelled()), H.block_features(found))) if yes]


def test_tree_needs_words_and_neighbours():
    used = {H.FEATURES[n[0]] for n in H.train_tree(*H.labelled()) if n[0] >= 0}
    assert "words" in used and used & {"words_before", "links_before"} and used & {"words_after", "links_after"}


def test_names_of_outer_sections_do_not_hide_the_text():
    long = ["some words of the text " * n for n in (6, 9, 12)]
    text = "".join(f"<p>{t}</p>" for t in long)
    want = [t.strip() for t in long]
    menu, end = "<div><a href=1>One</a></div><div><a href=2>Two</a></div>", "<div><a href=3>Next</a></div>"
    for page in (f'<div class="layout sidebar-left"><main><article>{text}</article></main></div>',
                 f'<div class="layout no-sidebar"><main><article>{text}</article></main></div>',
                 f'<section class="header-fixed"><article>{text}</article></section>',
                 f'<div class="comments-open"><main>{text}</main></div>',
                 f'<div id="content" class="with-sidebar">{text}</div>', f'<div id="content" class="sidebar-right">{text}</div>',
                 f'<div class="page has-banner">{menu}{text}{end}</div>', f'<div class="page sidebar-right">{menu}{text}{end}</div>'):
        assert kept(f"<body>{page}</body>") == want, page
    other = "<article><p>Another long article that nobody asked for on this page, with many words in it, twenty at the very least.</p></article>"
    for name in ("related", "comments"):
        assert kept(f'<main><article>{text}</article></main><div class="{name}">{other}</div>') == want
        assert kept(f'<article>{text}<section id="{name}">{other}</section></article>') == want
    assert kept(f'<body>{menu}{text}<div class="ad-slot"><p>Buy this now, it is cheap.</p></div>{end}</body>') == want


def _words(n):
    return " ".join(f"w{i}" for i in range(n))


def _link(n):
    return f"<a href=1>{_words(n)}</a>"


def _shape(page):
    return [len(t.split()) for t in kept(page)]


def test_text_beside_links_stays():
    page = f"<article><h1>{_words(4)}</h1><p>{_words(50)}</p><p>{_link(9)}</p><p>{_words(200)}</p><p>{_words(3)}</p></article>"
    assert _shape(page) == [4, 50, 9, 200, 3]
    assert _shape(f"<article><h2>{_link(4)}</h2><p>{_words(80)}</p></article>") == [4, 80]
    assert _shape(f"<article><ul><li>{_link(2)}<li>{_link(2)}</ul><p>{_words(50)}</p></article>") == [50]


def _random_page(r):
    out, long = [], 0
    for _ in range(r.randint(1, 12)):
        k = r.random()
        if k < 0.45:
            out.append(f"<p>{_words(r.randint(15, 300))}</p>")
            long += 1
        elif k < 0.6:
            out.append(f"<p>{_words(r.randint(1, 14))}</p>")
        elif k < 0.75:
            out.append(f"<p>{_link(r.randint(1, 30))}</p>")
        elif k < 0.85:
            out.append("<ul>" + "".join(f"<li>{_link(r.randint(1, 6))}" for _ in range(r.randint(1, 6))) + "</ul>")
        else:
            out.append(f"<h2>{_link(r.randint(1, 6))}</h2>")
    return "".join(out), long


def test_no_long_paragraph_is_dropped_whichever_page_is_left_out():
    r = random.Random(1)
    pages = [_random_page(r) for _ in range(120)]
    for out in range(-1, len(H.LABELLED)):
        rows = [p for i, p in enumerate(H.LABELLED) if i != out]
        tree = H.train_tree(*H.labelled(rows))
        for page, long in pages:
            for whole in (f"<main><article>{page}</article></main>", f"<body>{page}</body>"):
                found = H.blocks(whole)
                main = H.predict(tree, H.block_features(found))
                assert sum(b[1] >= 15 and b[2] == 0 and bool(yes) for b, yes in zip(found, main)) == long, (out, whole)


def test_names_of_single_blocks():
    text = f"<p>{_words(50)}</p>"
    assert _shape(f"<article>{text}<p class=advert>{_words(20)}</p><ul><li class=ad><p>{_words(5)}</p><li>{_words(6)}</ul></article>") == [50, 6]
    assert _shape(f"<article><h1 class='page-header'>{_words(5)}</h1><p class='content lead'>{_words(30)}</p>{text}</article>") == [5, 30, 50]
    assert _shape(f"<article>{text}<p hidden>{_words(20)}</p>{text}</article>") == [50, 50]
    assert _shape(f"<article><ul><li>{_words(20)}<ul><li class=promo>{_words(9)}</ul><li>{_words(21)}</ul>{text}</article>") == [20, 21, 50]


def test_comments_on_a_page_without_marks():
    text = f"<p>{_words(40)}</p><p>{_words(60)}</p>"
    assert _shape(f"<div>{text}</div><div class=comments><p>{_words(70)}</p><p>{_words(30)}</p></div>") == [40, 60]
    # a name around all of the text is that of the layout
    assert _shape(f'<div class="page comments-open"><div><a href=1>One</a></div>{text}</div>') == [40, 60]
