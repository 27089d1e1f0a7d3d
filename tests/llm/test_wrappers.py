"""Operator 9: wrappers against the text that pages were made of, and pages that are long or badly formed."""

import random
import time

import pytest

from granum.llm import wrapper_induction as w

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    """pages: (host, html)."""
    rows = [(i, f"http://{h}/{i}", page) for i, (h, page) in enumerate(pages)]
    return [r.text for r in sorted(w.main_text(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.page_id)]


def test_unmarked_pages_of_many_hosts(spark):
    """Hosts with templates of their own and no telling tag or name: what varies is the text, what doesn't is not."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    pages, want = [], []
    for host in range(12):
        top, bottom, side = [some(4) for _ in range(rnd.randint(1, 4))], some(6), some(9)
        menu = rnd.random() < 0.5
        for _ in range(rnd.randint(3, 9)):
            blocks = [some(5)] + [some(rnd.randint(8, 40)) for _ in range(rnd.randint(1, 12))]
            story = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
            links = "<div class=m1>" + "".join(f"<a href=/>{some(1)}</a> " for _ in range(6)) + "</div>" if menu else ""
            page = "<body>" + "".join(f"<div>{t}</div>" for t in top) + links + f"<div class=x{host}><div>{side}</div><section>{story}</section></div><table><tr><td>{bottom}</td></tr></table></body>"
            pages.append((f"h{host}.com", page))
            want.append("\n\n".join(blocks))
    assert texts(spark, pages) == want


def test_votes():
    story = "<p>" + "long story of many words " * 9 + "{0}</p>"
    plain = ("long story of many words " * 9 + "{0}").strip()

    def alone(page):
        return w.content(page.replace("@", story).format(7), [])

    assert alone("<body><div class='share'>Tell all</div>@</body>") == plain.format(7)
    assert alone("<body><div class='sidebar'>@</div></body>") == plain.format(7)  # it holds most of the text
    assert alone("<body><article>Short {0}</article><section id=comments>@</section></body>") == "Short 7"
    menu = "<ul>" + "<li><a href=/>Some place in the site</a>" * 9 + "</ul>"
    assert alone(f"<body><nav>{menu}</nav><p>rest</p></body>") == "rest"
    assert alone(f"<body><div class='menu'>{menu}</div><p>rest</p></body>") == "rest"
    assert alone(f"<body><p>rest</p>{menu}</body>").startswith("rest\n\nSome place")  # a list of links may be the text
    assert alone("<body><header>@</header></body>") == plain.format(7)


def test_tags_as_html_has_them():
    text = lambda page: w.content(page, [])
    assert text('<script src="a.js"/>var x=1;</script>said') == "said"
    assert text("<div/>one<p>two") == "one\n\ntwo"
    assert text("<a href=http://x.com/>one</a> two") == "one two"
    assert text("<svg/>one<svg><text>no</text></svg> two") == "one two"
    assert text("<p title='a > b'>one</p><p title=\"don't\">two") == "one\n\ntwo"
    assert text('<p title="open>one</p><p>two') == "one\n\ntwo"
    assert text("one < two <3 </ three") == "one < two <3 </ three"
    assert text("one<!-- > --> two<!--> three<? x ?> four<!-- five") == "one two three four"
    assert text("one <b unfinished") == "one"
    assert text("<noscript>no</noscript>one<textarea><p>no</textarea> two") == "one two"
    assert text("<div data-class='ad'>one</div>") == "one"


@pytest.mark.parametrize(
    "page",
    [
        '<a "' * 500_000,
        "<a b='\">" * 300_000,
        '<a b=">"' * 300_000,
        "<" * 1_000_000,
        "<!--" * 500_000,
        "<div>" * 300_000 + "</p>" * 300_000,
        "<td><section>" + "<x>" * 300_000 + "<tr></tr>" * 20_000,
        "".join(f"<h2>h{i}</h2><p>p{i}" for i in range(100_000)),
        "".join(f"<div class=c{i}>{i}</div><i2>x</i2>" for i in range(50_000)),
        "<p>" + "word " * 2_000_000,
    ],
    ids=lambda p: p[:12],
)
def test_long_pages_take_linear_time(page):
    other = "<body>" + "".join(f"<h2>a{i}</h2><div>b{i}</div><p>c{i}" for i in range(500))
    began = time.time()
    a, b = (w.skeleton(*w.parse(p))[0] for p in (page, other))
    assert max(len(a), len(b)) <= w.MOST_NODES
    w.align(a, b), w.align(b, a), w.align(a, a[:1])
    got = w.content(page, [w.wrapper(0, b, [])])
    assert time.time() - began < 25  # quadratic work would take hours
    if "h99999" in page:
        assert got == "\n\n".join(f"h{i}\n\np{i}" for i in range(100_000))
    if page.startswith("<p>word"):
        assert len(got) == 5 * 2_000_000 - 1


def test_worst_pair_of_trees_is_bounded():
    trees = []
    for seed in (1, 2):
        rnd = random.Random(seed)
        make = lambda d: f"<div>{rnd.random()}" + "".join(make(d - 1) for _ in range(rnd.randint(20, 28))) + "</div>" if d else f"<div>{rnd.random()}</div>"
        trees.append(w.skeleton(*w.parse(make(3)))[0])
    began = time.time()
    assert len(w.align(*trees)) > 300
    assert time.time() - began < 30


def test_folding_keeps_all_text():
    rnd = random.Random(3)
    page, n = "", 0
    for _ in range(5000):
        page += rnd.choice(["<div>", "</div>", "<p>", "<ul><li>", "</ul>", f"<section class=s{rnd.randrange(200)}>", "</section>"]) + f"t{n} "
        n += 1
    root, blocks = w.parse(page)
    rows, own = w.skeleton(root, blocks)
    assert sorted(b for x in own for b in x) == list(range(len(blocks))) and len(rows) <= w.MOST_NODES
    assert " ".join(blocks).split() == [f"t{i}" for i in range(n)]


def test_hard_pages(spark):
    rows = [(1, None, None, "q", 1), (1, None, None, "q", 1), (2, "x", "", "q", 2), (None, "http://a.b/", "<p>x", None, 3), (3, "http://a.b/", "<p>" + "y " * 300_000, "q", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, id int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in w.main_text(df).collect())
    assert got == [(0, "x", 1), (1, "", 0), (1, "", 0), (2, "", 0), (3, ("y " * 300_000).strip(), 599_999)]
    assert w.main_text(df.limit(0)).count() == 0


def test_simple_tree_matching():
    row = lambda label, parent, text: w.Row(label, parent, text, 1, 0, 0, 0, 0)
    a = [row("r", -1, 0), row("p", 0, 5), row("d", 0, 6), row("u", 2, 7)]
    b = [row("r", -1, 0), row("d", 0, 6), row("u", 1, 9), row("p", 0, 5)]
    assert sorted(w.align(a, b)) == [(0, 0), (2, 1), (3, 2)]
