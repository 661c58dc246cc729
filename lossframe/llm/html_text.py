"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element and each run of text is a node that is content or not. A node's
own evidence is a sum of learned weights of its features (tag, class and id
words, share of the page's text, link density, length, punctuation); learned
potentials tie each node to its parent. One pass of sum-product messages up
and one down gives exact marginals, and the text runs more likely content than
not are the main text. Weights and potentials maximise the likelihood of
labelled pages: template pages whose parts are known, and up to
``MAX_PAGES`` given pages with an ``article`` or ``main`` landmark, which are
also learned from with the landmark taken away.

A node's named surroundings count too: the nearest ancestor whose tag, class, id
or role names a part of a page, any ancestor that names reader comments, and
whether it lies outside the page's ``article`` or ``main``.
Names that only tell what a page has (``has-comments``) are left out, as are
those of ``html`` and ``body``.

Scripts, styles, titles, templates and form controls are dropped when the page
is parsed. All else, drawings, formulas, frames and what stands in for scripts
or objects among them, is judged by the model. A slash ends a tag's element only
in drawings and formulas, and never as part of an unquoted value; an end tag
without an open element is passed over. Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined in page order by a line break; ``br`` ends a block too.

Cases: a null or blank page has the empty text; unclosed tags, comments and
references end with the page; markup without a landmark or known class is
judged by its other features; pages are taken whole, in time that grows with
their length; given pages of over ``MAX_NODES`` nodes are not learned from; repeated rows each get a
row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lossframe.llm.common import slices, table

MAX_PAGES = 120
TEMPLATES = 420
MAX_NODES = 2000
EPOCHS, RATE, L2 = 25, 0.1, 1e-3

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title template select button".split())
_FOREIGN = frozenset("svg math".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)),
           "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_NO_P = _BLOCK - {"body", "head", "html", "br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
# A quote opens a value only after "="; one that no quote closes is a letter like others, so the tag ends at its ">".
_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+'"
_TAG = re.compile(
    r"<(?:!--(?:.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|" + _VALUE + r"|[^\s\"'>][^\s>]*+)?+)*+)(?:>|\Z)|[!?][^>]*+(?:>|\Z))", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|" + _VALUE + ")", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_ATTRIBUTE = re.compile(r"[^\s=/>]+(?:\s*" + _VALUE + r"|[^\s\"'>][^\s>]*))?|[/=\"']")
# A name such as "has-comments" tells what a page has, not what the element is.
_TELLS = re.compile(r"(?:has|no|with|without|hide|show|is|enable|disable)[-_]|.*[-_](?:open|closed|enabled|disabled|hidden)$", re.I)


@lru_cache(4096)
def _names(attributes: str) -> tuple[str, ...]:
    """Words of the class, id and role attributes."""
    found = []
    for m in _NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            if not _TELLS.match(name):
                found += [w.lower() for w in _TOKEN.findall(name)]
    return tuple(dict.fromkeys(found))


class Open:
    """The open elements, innermost last, and for each tag those of its name, so that none is searched for."""

    def __init__(self):
        self.stack, self.at, self.blocks = [(0, "html")], {"html": [0]}, []

    def push(self, node: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((node, tag))

    def depth(self, tags) -> int:
        """Place of the innermost open element of ``tags``; 0, where ``html`` is, without one."""
        return max([self.at[t][-1] for t in tags if self.at.get(t)], default=0)

    def shut(self, depth: int) -> None:
        while len(self.stack) > depth:
            _, tag = self.stack.pop()
            self.at[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag: of an inline element it reaches no further than the innermost open block."""
        depth = self.depth((tag,))
        if depth and (tag in _BLOCK or not self.blocks or depth > self.blocks[-1]):
            self.shut(depth)

    def drop(self, tags, scope) -> None:
        """Close the innermost of ``tags`` that is open inside ``scope``."""
        depth = self.depth(tags)
        if depth > self.depth(scope):
            self.shut(depth)


def _shut_by_slash(attributes: str) -> bool:
    """Whether the tag's last slash stands alone, not in a value."""
    return attributes.endswith("/") and [m[0] for m in _ATTRIBUTE.finditer(attributes)][-1] == "/"


class Page:
    """Nodes in page order, parents first: tag ("" for text), parent, names, and for text its words and block."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names, self.text, self.block = ["html"], [-1], [()], [""], [0]
        open_, block, at, end, unclosed = Open(), 0, 0, len(source), set()
        while at < end:
            m = _TAG.search(source, at)
            if (start := m.start() if m else end) > at:
                self._text(source[at:start], open_.stack[-1][0], block)
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if name in _BLOCK:
                block += 1
            if m[1]:
                open_.close(name)
                continue
            if name == "html" and len(open_.stack) == 1:
                continue
            if name in _RAW:
                shut = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                if not shut:
                    unclosed.add(name)  # nor is there one further on
                if name in ("button", "select", "template") and not shut:
                    continue
                at = shut.start() if shut else end
                after = _TAG.match(source, at) if shut else None
                at = after.end() if after else at
                continue
            if name in _NO_P:
                open_.drop(("p",), ("td", "th", "caption", "button", "object"))
            if name in _CLOSES:
                tags, scope = _CLOSES[name]
                open_.drop(tags.split(), scope)
            self.tag.append(name)
            self.parent.append(open_.stack[-1][0])
            self.names.append((_names if len(m[3]) <= 4096 else _names.__wrapped__)(m[3]) if m[3] else ())  # long ones are not cached
            self.text.append("")
            self.block.append(block)
            foreign = name in _FOREIGN or open_.depth(_FOREIGN) > open_.depth(("foreignobject",))
            if name not in _VOID and not (foreign and m[3].endswith("/") and _shut_by_slash(m[3])):
                open_.push(len(self.tag) - 1, name)
            if name == "xmp":  # its text has no tags or references
                shut = None if name in unclosed else re.compile(r"</xmp(?=[\s/>])", re.I).search(source, at)
                if not shut:
                    unclosed.add(name)
                start, at = at, shut.start() if shut else end
                self._text(source[start:at], open_.stack[-1][0], block, plain=True)

    def _text(self, raw: str, parent: int, block: int, plain: bool = False) -> None:
        words = html.unescape(raw) if "&" in raw and not plain else raw
        self.tag.append("")
        self.parent.append(parent)
        self.names.append(())
        self.text.append(words)
        self.block.append(block)

    def kinds(self) -> list[str]:
        return ["text" if not t else "part" if _part(t, names)[:1] == ("near=junk",) else "element" for t, names in zip(self.tag, self.names)]

    def features(self) -> list[list[str]]:
        n = len(self.tag)
        size, linked, commas = [0] * n, [0] * n, [0] * n
        depth, in_link = [0] * n, [False] * n
        near, talk, mark = [()] * n, [False] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            near[i], talk[i] = near[p], talk[p]
            if self.tag[i] and self.tag[i] != "body":
                part = _part(self.tag[i], self.names[i])
                near[i] = part or near[p]
                talk[i] = talk[p] or not _TALK.isdisjoint(self.names[i])
            mark[i] = mark[p] or self.tag[i] in ("article", "main") and not talk[i]
            depth[i], in_link[i] = depth[p] + 1, in_link[p] or self.tag[i] == "a"
            if not self.tag[i]:
                t = self.text[i]
                size[i] = len(t.split()) if t else 0
                linked[i] = size[i] * in_link[i]
                commas[i] = t.count(".") + t.count(",") + t.count("。")
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            size[p] += size[i]
            linked[p] += linked[i]
            commas[p] += commas[i]
        total, marked = max(1, size[0]), any(mark)
        out = []
        for i in range(n):
            words = size[i]
            f = [f"size{words.bit_length()}", f"links{4 * linked[i] // words if words else 5}", f"stops{min(4, 16 * commas[i] // words) if words else 5}"]
            if self.tag[i]:
                f += ["tag=" + self.tag[i], f"share{8 * words // total}", f"depth{min(6, depth[i])}"]
                f += ["name=" + w for w in self.names[i]]
                f += [kind for kind, listed, tags in (("junk", _JUNK, _JUNK_TAGS), ("content", _CONTENT, ("article", "main")))
                      if self.tag[i] in tags or not listed.isdisjoint(self.names[i])]
                f = ["e" + x for x in f]
            else:
                up = self.tag[self.parent[i]]
                f = ["t" + x for x in f] + ["tin=" + up]
            f += near[i]
            if talk[i]:
                f.append("talk")
            if marked:
                f.append("inside" if mark[i] else "outside")
            out.append(f)
        return out

    def joined(self, chosen: list[bool]) -> str:
        blocks, at, parts = [], None, []
        for i, tag in enumerate(self.tag):
            if tag or not chosen[i]:
                continue
            if self.block[i] != at:
                blocks.append(parts)
                at, parts = self.block[i], []
            parts.append(self.text[i])
        blocks.append(parts)
        lines = (" ".join("".join(p).split()) for p in blocks)
        return "\n".join(x for x in lines if x)


KINDS = ("text", "element", "part")


class TreeModel:
    """Weights of features, and for each kind of child the potentials [parent][child].

    Kinds are text, elements, and elements that name a part of a page other than the article.
    """

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.pair = {kind: [[0.5, -0.5], [-0.5, 0.5]] for kind in KINDS}

    def beliefs(self, page: Page, features: list[list[str]]) -> tuple[list[float], list[float], list[float]]:
        """Log-odds of each node by all evidence; of each node by its subtree alone; of each one's parent without it."""
        get, n, parent, kinds = self.weight.get, len(page.tag), page.parent, page.kinds()
        sub = [sum([get(f, 0.0) for f in fs]) for fs in features]
        e = {k: [[math.exp(x) for x in row] for row in p] for k, p in self.pair.items()}
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):
            q = e[kinds[i]]
            b = math.exp(max(-30.0, min(30.0, sub[i])))
            sent[i] = math.log((q[1][1] * b + q[1][0]) / (q[0][1] * b + q[0][0]))
            sub[parent[i]] += sent[i]
        full, cavity = sub[:], [0.0] * n
        for i in range(1, n):
            q = e[kinds[i]]
            cavity[i] = full[parent[i]] - sent[i]
            c = math.exp(max(-30.0, min(30.0, cavity[i])))
            full[i] += math.log((q[1][1] * c + q[0][1]) / (q[1][0] * c + q[0][0]))
        return full, sub, cavity

    def main_text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        full, _, _ = self.beliefs(page, page.features())
        return page.joined([x > 0 for x in full])

    def fit(self, pages: list[tuple[Page, list[bool]]], epochs: int = EPOCHS) -> TreeModel:
        """Maximise the labels' likelihood by gradient steps, page after page, scaled by past gradients."""
        data = [(p, p.features(), y) for p, y in pages]
        past: dict = {}
        rng = random.Random(5)

        def step(key, table_, g: float) -> None:
            g -= L2 * table_.get(key, 0.0)
            past[key] = past.get(key, 0.1) + g * g
            table_[key] = table_.get(key, 0.0) + RATE * g / past[key] ** 0.5

        for _ in range(epochs):
            rng.shuffle(data)
            for page, features, y in data:
                full, sub, cavity = self.beliefs(page, features)
                grad: dict[str, float] = {}
                moved = {(kind, a, b): 0.0 for kind in KINDS for a in (0, 1) for b in (0, 1)}
                kinds = page.kinds()
                for i, fs in enumerate(features):
                    d = y[i] - 1 / (1 + math.exp(-max(-30.0, min(30.0, full[i]))))
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + d
                    if i:
                        kind = kinds[i]
                        q = self.pair[kind]
                        joint = [[math.exp(max(-30.0, min(30.0, a * cavity[i] + b * sub[i] + q[a][b]))) for b in (0, 1)] for a in (0, 1)]
                        z = sum(map(sum, joint))
                        for a in (0, 1):
                            for b in (0, 1):
                                moved[kind, a, b] += (y[page.parent[i]] == a and y[i] == b) - joint[a][b] / z
                for f, d in grad.items():
                    step(f, self.weight, d)
                flat = {k: self.pair[k[0]][k[1]][k[2]] for k in moved}
                for k, d in moved.items():
                    step(k, flat, d)
                for (kind, a, b), v in flat.items():
                    self.pair[kind][a][b] = v
        return self


# Words that name parts of pages other than the article; fixed values.
JUNK = ("nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget related recommended ad ads advert advertisement "
        "sponsor sponsored promo banner cookie cookies consent notice alert newsletter subscribe signup form login search comments comment reply respond disqus "
        "share social popup modal pagination pager tags meta byline toolbar skip legal copyright").split()
# Words that name the article; fixed values.
CONTENT = "article content post entry story main body text page single".split()
_JUNK, _CONTENT = frozenset(JUNK), frozenset(CONTENT)
_JUNK_TAGS = frozenset("nav aside footer form dialog menu head".split())


# Those that name reader comments; fixed values.
_TALK = frozenset("comment comments commentlist reply replies respond responses disqus discussion".split())


@lru_cache(4096)
def _part(tag: str, names: tuple[str, ...]) -> tuple[str, ...]:
    """Features of what lies in an element that names a part of a page: none if it names none."""
    junk = sorted(_JUNK.intersection(names) | _TALK.intersection(names))
    if junk or tag in _JUNK_TAGS:
        return ("near=junk", *(f"near={w}" for w in junk), *([f"near={tag}"] if tag in _JUNK_TAGS else []))
    return ("near=content",) if tag in ("article", "main") or not _CONTENT.isdisjoint(names) else ()


def landmark_labels(page: Page) -> list[bool] | None:
    """Content by the page's first landmark and the parts named as others inside it; None without a landmark."""
    root = next((i for i, t in enumerate(page.tag) if t in ("article", "main")), None)
    if root is None:
        return None
    y = [False] * len(page.tag)
    for i in range(root, len(page.tag)):
        inside = i == root or y[page.parent[i]]
        y[i] = inside and page.tag[i] not in _JUNK_TAGS and not (i != root and not (_JUNK | _TALK).isdisjoint(page.names[i]))
    return y


def templates(count: int, seed: int = 17) -> list[tuple[Page, list[bool]]]:
    """Labelled pages: parts in varied markup around and inside an article; ``data-c`` classes tell the labels and are taken out."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "er", "on", "th", "re", "in", "ou", "es", "la", "de", "ch", "ti")) for _ in range(rng.randint(1, 3)))
    said = lambda a, b: " ".join(word() + rng.choice(("", "", "", "", ",", ".")) for _ in range(rng.randint(a, b))) + "."
    link = lambda: f"<a href={rng.choice(('/x', '/x/', chr(34) + '/x/' + chr(34)))}>{word()} {word() if rng.random() < .4 else ''}</a>"
    links = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(a, b))) + "</ul>" if rng.random() < .7 else \
        "".join(f"{link()} " for _ in range(rng.randint(a, b)))
    fields = lambda: f"<label>{word()}</label><input name=q><p>{said(1, 8)}</p>"

    def paragraph(tiny: bool) -> str:
        body = said(1, 8) if rng.random() < (.8 if tiny else .25) else said(8, 40 if tiny else 90)
        if rng.random() < .15:
            body += f" <a href=/y>{word()}</a> {said(2, 12)}"
        if rng.random() < .15:
            body = f"<b>{body}" + ("</b>" if rng.random() < .5 else "<br>")
        kind = rng.random()
        if kind < .75:
            return f"<p>{body}</p>"
        return f"<h2>{said(1, 6)}</h2><p>{body}" if kind < .85 else f"<blockquote><p>{body}</p></blockquote>" if kind < .9 else \
            "<ul>" + "".join(f"<li>{said(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>" if kind < .95 else f"<div>{body}</div>"

    def comments() -> str:
        """Reader comments: plain or boxed, short or long, as a list, or with replies inside."""
        one = lambda: "".join(f"<p>{said(1, rng.choice((6, 40, 120)))}</p>" for _ in range(rng.randint(1, 3)))
        shape, several = rng.random(), range(rng.randint(1, 6))
        if shape < .35:
            return (f"<h3>{said(1, 3)}</h3>" if rng.random() < .4 else "") + "".join(one() for _ in several)
        if shape < .6:
            return "".join(f"<div class=comment>{f'<b>{word()}</b>' if rng.random() < .6 else ''}{one()}</div>" for _ in several)
        if shape < .8:
            items = "".join(f"<li>{one() if rng.random() < .5 else said(3, 60)}</li>" for _ in several)
            return items if rng.random() < .5 else f"<ul>{items}</ul>"
        return "".join(f'<article class="comment-body"><b>{word()}</b><div class="comment-content">{one()}</div>'
                       f'{f"<div class=reply>{one()}</div>" if rng.random() < .5 else ""}</article>' for _ in several)

    def junk(kind: str) -> str:
        tag, body = rng.choice((("nav", links(3, 9)), ("div", links(3, 9)))) if kind in ("nav", "menu", "navbar", "breadcrumb", "pagination", "tags") else \
            (rng.choice(("header", "div")), f"<h2>{said(1, 5)}</h2>" + (links(2, 6) if rng.random() < .5 else "")) if kind in ("header", "masthead", "topbar") else \
            (rng.choice(("footer", "div")), f"&copy; {said(2, 14)}" + (links(2, 5) if rng.random() < .4 else "")) if kind in ("footer", "copyright", "legal") else \
            (rng.choice(("aside", "div", "section")), f"<h3>{said(1, 4)}</h3>{links(2, 8)}<p>{said(4, 40)}</p>") if kind in ("sidebar", "related", "widget", "recommended") else \
            (rng.choice(("form", "div")), fields()) if kind in ("form", "login", "search", "newsletter", "subscribe", "signup") else \
            (rng.choice(("section", "div", "div", "ol")), comments()) if kind in _TALK else (rng.choice(("div", "section", "aside", "p")), said(3, 30))
        bare = tag in ("nav", "aside", "footer", "header", "form") and rng.random() < .5
        extra = rng.choice(("", "", "-box", " wide", "-1"))
        return f"<{tag} {'' if bare else rng.choice(('class', 'id')) + '=' + chr(34) + kind + extra + chr(34)} role=junkjunk>{body}</{tag}>"

    def aside() -> str:
        """Rarer content: drawings with labels, paragraphs in place of scripts."""
        kind = rng.random()
        return f"<figure><svg><path d=m/><text>{said(1, 4)}</text></svg></figure>" if kind < .04 else f"<noscript><p>{said(5, 40)}</p></noscript>" if kind < .07 else ""

    pages, unwanted = [], [*JUNK, *sorted(_TALK) * 2]
    for n in range(count):
        tiny = n % 5 == 0
        pick = lambda a, b: "".join(junk(rng.choice(unwanted)) for _ in range(rng.randint(a, b)))
        root = rng.choice(("article", "article", "main", "div", "div", "section", "td"))
        name = "" if root in ("article", "main") and rng.random() < .6 or rng.random() < .15 else rng.choice(("class", "id")) + f'="{rng.choice(CONTENT)}{rng.choice(("", "-body", " wide"))}"'
        inner = (f"<h1>{said(2, 9)}</h1>" if rng.random() < .8 else "") + "".join(
            paragraph(tiny) + (junk(rng.choice(unwanted)) if rng.random() < .15 else "") + aside() for _ in range(rng.randint(1, 3 if tiny else 14)))
        readers = lambda: junk(rng.choice(sorted(_TALK))) if rng.random() < .3 else ""
        inner += readers()
        head = f"<title>{said(2, 8)}</title><style>p{{margin:0}}</style>"
        middle = f"<{root} {name} role=goodgood>{inner}</{root}>"
        if root == "td":
            middle = f"<table><tr>{'<td>' + links(3, 6) if rng.random() < .5 else ''}{middle}</tr></table>"
        around = pick(0, 3) + middle + readers() + pick(0, 3)
        for _ in range(rng.choice((0, 0, 1, 2))):
            around = f'<div class="{rng.choice(("wrap", "container", "row", "page", "site"))}">{around}</div>'
        if rng.random() < .25:  # a notice in place of a script, outside the article
            notice = said(3, 12)
            around = f"<noscript role=junkjunk>{notice if rng.random() < .5 else f'<p>{notice}</p>'}</noscript>{around}"
        layout = f' class="{rng.choice(("has-sidebar", "single with-comments", "page no-header", "comments-open post"))}"' if rng.random() < .3 else ""
        page = Page(f"<html><head>{head}</head><body{layout}>{pick(0, 2)}{around}{pick(0, 2)}</body></html>")
        y = [False] * len(page.tag)
        for i in range(1, len(y)):
            y[i] = "goodgood" in page.names[i] or y[page.parent[i]] and "junkjunk" not in page.names[i]
        page.names = [tuple(w for w in names if w not in ("goodgood", "junkjunk")) for names in page.names]
        pages.append((page, y))
    return pages


def trained(pages: DataFrame, most: int = MAX_PAGES) -> TreeModel:
    """The model of the templates and of up to ``most`` given pages; the chosen ids are what is broadcast."""
    ids = pages.filter(F.col("html").rlike("(?i)<(article|main)[ >]") & F.col("page_id").isNotNull()).select("page_id")
    ids = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    chosen = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").orderBy("page_id", "html").limit(most).collect()
    data = templates(TEMPLATES)
    for k, r in enumerate(chosen):
        page = Page(r["html"])
        if len(page.tag) > MAX_NODES or not (y := landmark_labels(page)):
            continue
        if k % 2:
            page.tag = ["div" if t in ("article", "main") else t for t in page.tag]
        data.append((page, y))
    return TreeModel().fit(data)


def extracted(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in slices(parts):
            yield pd.Series([shared.value.main_text(x) for x in part], dtype=object)

    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, trained(pages))
