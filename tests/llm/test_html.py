import random
import re
import time

import pytest
from helpers import PAGES, clash, empty

from tidemark.llm import html

LONG = "This paragraph, which is part of the article, goes on for a while, with commas, so that it counts as prose."
CASES = {
    "plain": (f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>T &amp; x</h1><p>{LONG}<p>{LONG}</article><footer>f</footer>", f"T & x\n{LONG}\n{LONG}"),
    "div": (
        f'<body><div id="sidebar"><p>{LONG}</p></div><div class="cookie-notice"><p>We use cookies, as all do.</p></div><div class="content"><p>{LONG}</p><p>a<br>b</p></div>'
        f'<div class="comments"><div class="comment"><p>{LONG} {LONG}</p></div></div>',
        f"{LONG}\na b",
    ),
    "script": (f'<article><script>var t="</p><p>no";</script><style>p{{}}</style><p>{LONG}</p><!-- <p>no</p> --><form><p>{LONG}</p><input></form><p>&#8364;&nbsp;1</p></article>', f"{LONG}\n€ 1"),
    "links": (f'<div><div class="x"><p><a href=/a>{LONG}</a></p><p><a href=/b>{LONG}</a></p></div><div class="y"><p>{LONG}</p><p>{LONG}</p></div></div>', f"{LONG}\n{LONG}"),
    "list": (f"<main><p>{LONG}</p><ul><li>one<li>two</ul><pre>x\n  y</pre><table><tr><td>c1<td>c2</table></main>", f"{LONG}\none\ntwo\nx y\nc1\nc2"),
    "cut": (f"<article><p>{LONG}</p><p>{LONG}</p><p>last <a hre", f"{LONG}\n{LONG}\nlast"),
    "wrapper": (f'<div class="has sidebar"><article><p>{LONG}</p></article><aside><p>{LONG}</p></aside></div>', LONG),
    "short": ("<nav>n</nav><div class=ad>buy this, now.</div><article><h1>Hi.</h1><p><b>Hi.<br></article>", "Hi.\nHi."),
    "none": ("<nav>x</nav><footer>y</footer>", ""),
    "form": (f'<body><form id="aspnetForm" action=x><div class="top menu">m</div><div class="content"><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><input type=hidden></form><footer>f</footer>', f"T\n{LONG}\n{LONG}"),
    "form around an article": (f"<form><nav>n</nav><article><p>{LONG}</p></article><select><option>o</select></form>", LONG),
    "form beside": (f"<article><p>{LONG}</p></article><form><p>{LONG} {LONG}</p><input></form>", LONG),
    "header": (f"<article><header><h1>T</h1><p class=byline>By One, today</p><time>now</time></header><p>{LONG}</p><footer>by</footer></article>", f"T\n{LONG}"),
    "open header": (f"<article><header><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article>", f"T\n{LONG}\n{LONG}"),
    "less than": (f"<article><p>{LONG}</p><p>{LONG} x <y and z", f"{LONG}\n{LONG} x <y and z"),
    "short ones beside": (f'<div id=c><div class="content"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><p>The end.</p></div>', f"{LONG}\n{LONG}\n{LONG}\nThe end."),
    "bad": ("</p></div><<>< & &bogus; <p", "<<>< & &bogus;"),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, want = CASES[name]
    assert html.main_text(page) == want


EIGHT = f"<p>{LONG}</p>" * 8
WHOLE = {
    "closing": (f"<article><section>{EIGHT}</section><section><p>One closing paragraph, short.</p></section></article>", [LONG] * 8 + ["One closing paragraph, short."]),
    "lead": (f"<article><p>Lead.</p><div class=body>{EIGHT}</div><ul><li>one<li>two</ul><table><tr><td>c</table></article>", ["Lead."] + [LONG] * 8 + ["one", "two", "c"]),
    "main": (f"<nav>n</nav><main><h1>T</h1><div><section>{EIGHT}</section></div><div><p>End.</p><div class=share>s</div></div></main><footer>f</footer>", ["T"] + [LONG] * 8 + ["End."]),
    "named": (f"<div id=wrap><div>Welcome.</div><div class=post><div>Lead.</div><div>{EIGHT}</div></div></div>", ["Lead."] + [LONG] * 8),
    "beside": (f"<div><p>Lead.</p><div>{EIGHT}</div><ul><li>one</ul></div>", ["Lead."] + [LONG] * 8 + ["one"]),
}


@pytest.mark.parametrize("name", WHOLE)
def test_nested_parts_are_kept(name):
    page, want = WHOLE[name]
    assert html.main_text(page).split("\n") == want


HEADS = {
    "body": f"<html><head><meta charset=utf-8><title>no</title><body class=x><article><p>{LONG}</article>",
    "first tag": f"<head><title>no</title><script>no</script><noscript><img src=x>no</noscript><article><p>{LONG}</article>",
    "paragraph": f"<head><link href=x><style>no</style><p>{LONG}",
    "text": f"<head><title>no</title>{LONG}",
    "closed": f"<head><template><p>no</p></template><title>no</title></head><body><p>{LONG}</p>",
}


@pytest.mark.parametrize("name", HEADS)
def test_head_without_an_end_tag(name):
    assert html.main_text(HEADS[name]) == LONG


def test_deep_and_long():
    page = "<article>" + "<div>" * 3000 + f"<p>{LONG}</p>" * 3 + "</article>"
    assert html.main_text(page) == "\n".join([LONG] * 3)
    assert len(html.main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")) == 20_000 * (len(LONG) + 1) - 1


def test_time_is_linear_in_depth():
    start = time.process_time()
    for tags in ("<div>", "<div><span>", "<p><b>", "<ul><li>", "<table><tr><td>", "<div></i></a></p>", "<header><form>"):
        html.main_text("<article>" + tags * 20_000 + f"<p>{LONG}</p>")
    assert time.process_time() - start < 20


def slow_points(root):
    """The points of all nodes by their definition, each from the whole tree below it."""
    seen = lambda n: [c for c in n.children if isinstance(c, html.Node) and not c.hidden]
    strings = lambda n: [re.sub(r"\s+", " ", c).strip() for c in n.children if isinstance(c, str)]
    size = lambda n: sum(map(len, strings(n))) + sum(map(size, seen(n)))
    linked = lambda n: size(n) if n.name == "a" else sum(map(linked, seen(n)))
    commas = lambda n: sum(len(re.findall("[,،、，]", t)) for t in strings(n)) + sum(map(commas, seen(n)))

    def given(n):
        loose = n.name in html.BLOCKS and n.name not in html.HEADINGS and any(isinstance(c, str) and c.strip() for c in n.children)
        inner = any(isinstance(c, html.Node) and c.name in html.PARAGRAPHS for c in n.children)
        if not size(n) or inner or not (n.name in html.PARAGRAPHS or loose):
            return None
        return (1 + commas(n) + min(size(n) / 100, 3)) * (1 - linked(n) / size(n)), n if n.name not in html.PARAGRAPHS else n.parent

    def walk(n):
        yield n
        for c in seen(n):
            yield from walk(c)

    points = {id(n): 0.0 for n in walk(root)}
    for n in walk(root):
        got = given(n)
        at = got and got[1]
        for level in range(html.LEVELS):
            if at is None or not got:
                break
            points[id(at)] = points.get(id(at), 0.0) + got[0] / (level + 1)
            at = at.parent
    for n in walk(root):
        points[id(n)] *= (1 - linked(n) / size(n) if size(n) else 1) * (1.5 if n.name in ("article", "main") or html.WANTED.search(n.names) else 1) * (0.5 if n.parent is None else 1)
    return points


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 5)):
        tag = rng.choice(["p", "div", "section", "ul", "li", "blockquote", "a", "span", "h2", "article", "table"])
        names = rng.choice(["", "", ' class="content"', ' id="sidebar"'])
        text = " ".join(rng.choice(["word", "more,", "text", "and so on,"]) for _ in range(rng.randint(0, 40)))
        out.append(f"<{tag}{names}>{text}{random_page(rng, depth + 1) if depth < 4 and rng.random() < 0.6 else ''}</{tag}>")
    return "".join(out)


def test_points_by_their_definition():
    rng, some = random.Random(6), 0
    for _ in range(60):
        root = html.parse(random_page(rng))
        want = slow_points(root)
        html.score(root)
        for n in html._walk(root):
            assert n.points == pytest.approx(want[id(n)])
            some += n.points > 0
    assert some > 500


def test_extract(spark):
    rows = [(i, f"http://h/{i}", page) for i, (page, _) in enumerate(CASES.values())] + [(50, None, None), (51, "u", ""), (51, "u", ""), (None, "u", "<p>x</p>")]
    df = clash(spark.createDataFrame(rows, PAGES))
    got = html.extract(df).collect()
    want = [(i, u, html.main_text(h)) for i, u, h in rows]
    assert sorted(((r["page_id"], r["url"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(empty(df)).count() == 0
