"""Composite text density by definition, over a tree built with Python's own parser; and what is the article when others talk more."""

import math
import random
from html.parser import HTMLParser

import pytest

from loomwright.llm import html_text

PARA = "<p>" + "This is a long paragraph of the article with many words in it, and it goes on for a while. " * 3 + "</p>"


class Tree(HTMLParser):
    def __init__(self, source):
        super().__init__()
        self.root = self.now = {"tag": "#root", "up": None, "kids": [], "own": 0, "at": 0}
        self.every = [self.root]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        self.now = {"tag": tag, "up": self.now, "kids": [], "own": 0, "at": len(self.every)}
        self.now["up"]["kids"].append(self.now)
        self.every.append(self.now)

    def handle_endtag(self, tag):
        self.now = self.now["up"]

    def handle_data(self, data):
        self.now["own"] += len(" ".join(data.split()))


def inside(n):
    return [n] + [x for k in n["kids"] for x in inside(k)]


def measures(n):
    """(characters, tags, characters in links, links) of an element, by walking all below it."""
    every = inside(n)
    in_link = lambda x: x is not None and (x["tag"] == "a" or in_link(x["up"]))
    return sum(x["own"] for x in every), len(every) - 1, sum(x["own"] for x in every if in_link(x)), sum(x["tag"] == "a" for x in every[1:])


def density(n, body):
    c, t, lc, lt = measures(n)
    body_c, _, body_lc, _ = measures(body)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + body_lc / max(1, body_c) * c + math.e)
    return max(0.0, c / max(1, t) * math.log(max(1.0, c / max(1, lc) * (max(1, t) / max(1, lt)))) / base)


def page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        words = " ".join(rng.choice(("alpha", "beta", "gamma", "delta.")) for _ in range(rng.randint(1, 30)))
        if kind < 0.4 and depth < 4:
            out.append(f"<div>{page(rng, depth + 1)}</div>")
        elif kind < 0.7:
            out.append(f"<p>{words}</p>")
        else:
            out.append(f"<p><a>{words}</a> {rng.choice(('', words))}</p>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_density_sums_and_choice_by_definition(seed):
    source = f"<html><body>{page(random.Random(seed))}</body></html>"
    tree, made = Tree(source), html_text._Page(source)
    body = tree.every[2]
    assert made.tag == [n["tag"] for n in tree.every]
    blocks = [n for n in tree.every if n["tag"] != "a"]
    values = {id(n): density(n, body) for n in blocks}
    for k, n in enumerate(tree.every):
        if n["tag"] != "a":
            assert made.density(k) == pytest.approx(values[id(n)], abs=1e-9)
    sums = {id(n): n["own"] + sum(values[id(k)] for k in n["kids"] if k["tag"] != "a") for n in blocks}
    # the subtree with the largest sum, its path's smallest density, and the best part of every subtree open to it
    head = max((n for n in inside(body) if n["tag"] != "a"), key=lambda n: (round(sums[id(n)], 9), -n["at"]))
    path, n = [values[id(body)]], head
    while n is not body:
        path.append(values[id(n)])
        n = n["up"]
    opened, todo = [], [body]
    while todo:
        n = todo.pop()
        if values.get(id(n), 0) >= min(path) > 0:
            opened.append(n)
            todo += [k for k in n["kids"] if k["tag"] != "a"]
    chosen = [head] + [max((x for x in inside(n) if x["tag"] != "a"), key=lambda x: (round(sums[id(x)], 9), -x["at"])) for n in opened]
    lines = [[n] for n in chosen]
    for line in lines:
        while line[-1]["up"]:
            line.append(line[-1]["up"])
    top = next(n for n in lines[0] if all(any(n is x for x in line) for line in lines))

    def texts(n):
        at = n["at"]
        last = at + len(inside(n))
        return " ".join(t for h, pieces in made.blocks if at <= h < last and (t := made._text_of(pieces)))

    assert html_text.main_text(source) == texts(top)


def many(n, name):
    return f"<div class={name}>" + "".join(f"<p>Number {k} is by somebody who has an opinion on everything and tells it at length.</p>" for k in range(n)) + "</div>"


@pytest.mark.parametrize("n", [1, 10, 40, 1000])
@pytest.mark.parametrize("name", ["comments", "sidebar", "related-posts", "widget"])
def test_others_never_take_the_place_of_the_article(n, name):
    text = " ".join(PARA[3:-4].split())
    for post in (f"<article><h1>Head</h1>{PARA}</article>", f"<div><h1>Head</h1>{PARA}</div>", f"<div><h1>Head</h1><div>{PARA}</div></div>", f"<main><h1>Head</h1>{PARA}</main>"):
        assert html_text.main_text(f"<html><body>{post}{many(n, name)}</body></html>") == f"Head {text}"
        assert html_text.main_text(f"<html><body>{many(n, name)}{post}</body></html>") == f"Head {text}"
    assert html_text.main_text(f"<body><article><p>Short.</p></article>{many(n, name)}</body>") == "Short."
    assert html_text.main_text(f"<body><div><p>Short.</p></div>{many(n, name)}</body>") == "Short."


def test_marked_elements_hold_the_article_where_nothing_else_is_read():
    text = " ".join(PARA[3:-4].split())
    assert html_text.main_text(f"<body><p>x</p><div class='content-sidebar'>{PARA}</div>{many(9, 'comments')}</body>") == "x " + text
    assert html_text.main_text(f"<body><div class='widget'>{PARA}</div>{many(9, 'comments')}</body>") == text
    assert html_text.main_text("<body><h1>Photo</h1><div class=comments><p>Nice picture!</p></div></body>") == "Photo"
    assert "Number 3" in html_text.main_text(f"<body>{many(9, 'comments')}</body>")


def test_parts_of_sentences_stay():
    assert html_text.main_text("<body><p>Area is <math><mi>x</mi><mo>=</mo><mn>4</mn></math> here.</p><p>Press <button>Start</button> to go on.</p><button>Menu</button></body>") == "Area is x=4 here. Press Start to go on."
    assert html_text.main_text("<body>" + "<div>" * 600 + "<p>Some real text here for you.</p><nav>home about</nav></body>") == "Some real text here for you."
