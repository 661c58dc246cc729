import random
import re
import time

import pytest

from lossframe.llm import html_text


@pytest.fixture(scope="module")
def model(spark):
    return html_text.trained(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


# Reader comments, menus, notices and drawings

SAID = "All of the words that stand here, one after the other, make up a part of the text. "
ARTICLE = "<h1>A title of some words</h1>" + "".join(f"<p>{SAID * 3} Part {i}.</p>" for i in range(5))
COMMENTS = {
    "short": "<p>nice post READER</p><p>i like it, thanks</p>",
    "long": f"<p>{SAID * 3} READER</p><p>{SAID * 4}</p>",
    "headed": f"<h3>Comments (2)</h3><p>READER {SAID * 2}</p><p>{SAID}</p>",
    "boxes": f"<div class=comment><p>READER {SAID * 2}</p></div><div class=comment><b>Ann</b><p>{SAID * 2}</p></div>",
    "list": f"<ol><li>READER {SAID * 2}</li><li>{SAID}</li></ol>",
    "nested": f"<article class=comment-body><div class=comment-content><p>READER {SAID * 2}</p></div><div class=reply><p>{SAID}</p></div></article>",
}


@pytest.mark.parametrize("form", COMMENTS)
@pytest.mark.parametrize("place", ["inside", "after"])
@pytest.mark.parametrize("box", ["<div class=comments>{}</div>", "<section class=\"comments\">{}</section>", "<div id=\"comments\" class=\"comments-area\">{}</div>"])
def test_reader_comments_are_left_out(model, form, place, box):
    comments = box.format(COMMENTS[form])
    inner = {"inside": f"<article>{ARTICLE}{comments}</article>", "after": f"<article>{ARTICLE}</article>{comments}"}[place]
    text = model.main_text(f"<html><body><header><h2>Site</h2></header>{inner}<footer>&copy; us</footer></body></html>")
    assert "READER" not in text and "thanks" not in text
    assert all(f"Part {i}." in text for i in range(5)) and text.startswith("A title of some words")


@pytest.mark.parametrize("names", ["post has-comments", "post comments-open", "with-sidebar post", "entry no-comments"])
def test_names_that_tell_what_a_page_has(model, names):
    text = model.main_text(f'<html><body class="{names}"><article class="{names}">{ARTICLE}</article></body></html>')
    assert all(f"Part {i}." in text for i in range(5))


@pytest.mark.parametrize("value", ["/x{}/", '"/x{}/"', "'/x{}'", "/x{}"])
@pytest.mark.parametrize("box", ["<ul>{}</ul>", "<div>{}</div>", "<nav>{}</nav>"])
def test_menus_are_left_out(model, value, box):
    links = "".join((f"<li><a href={value}>entry{{}}</a></li>" if "ul" in box else f"<a href={value}>entry{{}}</a>").format(i, i) for i in range(8))
    text = model.main_text(f"<html><body>{box.format(links)}<article>{ARTICLE}</article></body></html>")
    assert "entry" not in text and "Part 4." in text


def test_fallbacks_and_drawings_are_judged(model):
    page = lambda before, inside: model.main_text(f"<body>{before}<article>{ARTICLE}{inside}</article></body>")
    assert "JavaScript" not in page("<noscript>You need to enable JavaScript to run this app.</noscript>", "")
    assert "SHOWN" in page("", f"<noscript><p>{SAID * 2} SHOWN</p></noscript>")
    assert "Axis" in page("", "<figure><svg><path d='M 1 2'/><text>Axis of years</text></svg></figure>")
    assert "FRAME" in page("", f"<p>{SAID}<iframe>{SAID} FRAME</iframe></p>")


# Trees

def plain_tree(source):
    """(tag or text, parent) of each node, by plain searches of the whole stack."""
    nodes, stack = [("html", -1)], [0]
    tag = lambda k: nodes[stack[k]][0]
    for m in re.finditer(r"<(/?)([a-z0-9]+)((?:\s[^<>]*)?/?)>|([^<]+)", source):
        shut, name, attributes, text = m.groups()
        if text:
            nodes.append((text, stack[-1]))
            continue
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if tag(k) == name:
                    del stack[k:]
                    break
                if name not in html_text._BLOCK and tag(k) in html_text._BLOCK:
                    break
            continue
        drops = [(("p",), ("td", "th", "caption", "button", "object"))] if name in html_text._NO_P else []
        if name in html_text._CLOSES:
            drops.append((html_text._CLOSES[name][0].split(), html_text._CLOSES[name][1]))
        for tags, scope in drops:
            for k in range(len(stack) - 1, 0, -1):
                if tag(k) in tags:
                    del stack[k:]
                    break
                if tag(k) in scope:
                    break
        nodes.append((name, stack[-1]))
        drawn = name in ("svg", "math")
        for k in range(len(stack) - 1, 0, -1):
            if tag(k) in ("svg", "math", "foreignobject"):
                drawn = drawn or tag(k) != "foreignobject"
                break
        if name not in html_text._VOID and not (drawn and attributes.endswith("/") and "=" not in attributes):
            stack.append(len(nodes) - 1)
    return nodes


def test_trees_equal_a_plain_builder():
    rng = random.Random(9)
    names = "p div ul li ol i b a td tr table span dl dt dd svg path foreignobject br h2 article object em math".split()
    for _ in range(3000):
        parts = [rng.choice((f"<{(n := rng.choice(names))}>", f"</{rng.choice(names)}>", f"</{n}>", f"<{n} x=1/>", f"<{n}/>", f"<{n} y />", "word ")) for _ in range(rng.randint(1, 40))]
        page = html_text.Page("".join(parts))
        assert [(t or x, p) for t, x, p in zip(page.tag, page.text, page.parent)] == plain_tree("".join(parts)), parts


def test_no_element_is_too_deep():
    page = html_text.Page("<ul><li>" + "<i>" * 5000 + "x<li>y")
    items = [i for i, t in enumerate(page.tag) if t == "li"]
    assert len(items) == 2 and page.parent[items[0]] == page.parent[items[1]]


ODD = {
    "unclosed inline": lambda n: "<i>" * (n // 7) + "</b>" * (n // 7),
    "inline below a block": lambda n: "<i><div>" + "<b>" * (n // 7) + "</i>" * (n // 7),
    "unclosed raw": lambda n: "<button><xmp><template><select>x</noscript>" * (n // 42),
    "blocks": lambda n: "<div><p>" * (n // 8),
    "items": lambda n: "<ul><li>" + "<i>" * (n // 9) + "<li>x" * (n // 9),
    "slashes": lambda n: "<svg>" + "<a b=/ c/>" * (n // 10),
    "ends": lambda n: "</p></li></td>" * (n // 14),
    "quotes": lambda n: "<a b='" * (n // 12) + "<a b=\"" * (n // 12),
    "open marks": lambda n: "<!-- <a " * (n // 8),
    "names": lambda n: "<div class='comments menu'>" * (n // 26),
}


@pytest.mark.parametrize("kind", ODD)
def test_time_grows_with_the_page(kind):
    model, took = html_text.TreeModel(), []
    for n in (62_500, 1_000_000):
        t = time.perf_counter()
        model.main_text(ODD[kind](n))
        took.append(time.perf_counter() - t)
    assert took[1] < 60 * max(took[0], 0.02)


def test_repeated_rows(spark, frame):
    df = frame([(1, "u", "<article><p>a b c</p></article>", 3)] * 4 + [(None, None, None, None)], "page_id long, url string, html string, n_chars int")
    rows = html_text.extracted(df, html_text.trained(df)).collect()
    assert len(rows) == 5 and len({tuple(r) for r in rows}) == 2
