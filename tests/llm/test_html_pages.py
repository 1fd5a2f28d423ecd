"""Main text of generated pages whose article is known, of broken markup, and of very long and deep pages."""

import random
import time

import pytest

from granary.llm.html_text import main_blocks, minimum_cut

WORDS = "river stone market window letter garden winter signal bridge harbour common people always under between through".split()


def sentence(rng, words):
    return " ".join(rng.choices(WORDS, k=words)).capitalize() + "."


def prose(rng):
    """(markup, its blocks) of an article's inside."""
    out, blocks = [], []
    title = sentence(rng, 6)
    out.append(f"<h1>{title}</h1>")
    blocks.append(title)
    for k in range(rng.randint(3, 7)):
        text = " ".join(sentence(rng, rng.randint(8, 25)) for _ in range(rng.randint(2, 4)))
        shape = rng.randrange(6)
        if shape == 0:
            out.append(f"<p>{text}")  # its end tag may be left out
        elif shape == 1:
            out.append(f"<p title='the hidden river'>{text.replace('river', '<b>river</b>')}</p>")
        elif shape == 2:
            out.append(f'<div class="md:block hidden lg:flex"><p>{text}</p></div>')
        elif shape == 3:
            out.append(f"<p>{text}\n<select><option>A<option>B</select></p>")
        elif shape == 4:
            out.append(f'<p style="overflow: hidden ;">{text}</p><button>Copy</button>')
        else:
            out.append(f"<p>{text}</p><script>var x = '<p>none</p>';</script>")
        blocks.append(text)
    return "".join(out), blocks


def page(rng):
    inside, blocks = prose(rng)
    links = lambda n: "".join(f"<li><a href='/x'>{w}</a></li>" for w in rng.choices(WORDS, k=n))
    body = rng.choice([f"<article>{inside}</article>", f"<main>{inside}</main>", f'<div id="content">{inside}</div>', f'<div class="post-body"><section>{inside}</section></div>'])
    if rng.random() < 0.3:
        body = rng.choice(['<form action="/">{}</form>', '<div class="layout with-sidebar">{}</div>', "<table><tr><td>{}</td></tr></table>", "<div><div><div>{}</div></div></div>"]).format(body)
    before = [f"<nav><ul>{links(6)}</ul></nav>", f'<div class="cookie-consent">{sentence(rng, 9)} <button>Accept</button></div>', f"<header><a href='/'>{rng.choice(WORDS)}</a></header>", f'<div hidden>{sentence(rng, 12)}</div>', f"<div class='ad'>{sentence(rng, 7)}</div>"]
    after = [f"<aside><h2>Related</h2><ul>{links(5)}</ul></aside>", f"<footer>&copy; {sentence(rng, 5)}</footer>", f'<section id="comments"><p>{sentence(rng, 14)}</p><p>{sentence(rng, 20)}</p></section>', f"<form>{sentence(rng, 3)}<input name=q><select><option>a</select></form>", f'<p style="color:red;display:none">{sentence(rng, 15)}</p>']
    head = rng.choice(["<html><head><title>T</title></head><body>", "<head><title>T</title><body>", "<head><title>T</title>", "<!doctype html><body>", ""])
    some = lambda parts: "".join(rng.sample(parts, rng.randint(1, len(parts))))
    return head + some(before) + body + some(after) + rng.choice(["</body></html>", ""]), blocks


def test_generated_pages():
    for seed in range(300):
        html, want = page(random.Random(seed))
        assert main_blocks(html) == want, (seed, html)


PS = "".join(f"<p>Some words of an article that go on for a while, part {k}, and then come to their end.</p>" for k in range(4))
WANT = [f"Some words of an article that go on for a while, part {k}, and then come to their end." for k in range(4)]


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>T</title><body>{PS}</body>", f"<html><head><title>T</title>{PS}", f'<body><div class="md:block hidden lg:flex">{PS}</div>', f'<body><div title="the hidden river">{PS}</div>',
        f'<body><div style="overflow: hidden ;">{PS}</div>', f"<body><button>{PS}", f"<body><select><option>a<option>b{PS}", f"<body><video src=x>{PS}", f"<title>T{PS}", f"<textarea>{PS}", f"<div hidden>none</div>{PS}", f"<div aria-hidden='true'>none</div>{PS}",
        f"{PS}<p style='color:red; display : none'>none</p>", f"<svg><text>none</text></svg>{PS}", f"<template><p>none <template>none</template></template>{PS}", f"<p a='>none</p>{PS}".replace("a='>none", ">"), f"{PS}<script>none", f"{PS}<!-- none",
        PS.replace(" a while", " <select><option>none</select>a while"), PS.replace("<p>", "<p data-x='a > b'>"),
    ],
)
def test_silent_elements_leave_their_surroundings(html):
    assert main_blocks(html) == WANT


def test_an_unclosed_tag_is_text():
    assert main_blocks("<p>One is here. a < b and <i") == ["One is here. a < b and <i"]


LONG = [
    "<a " * 300_000, '<a b="' * 150_000 + ">", "<a b='>" * 100_000, "<div>" * 60_000 + "x", "<p>" * 100_000, "<b>" * 40_000 + "<div>x</div>" * 20_000, "<span>" * 20_000 + "x</a></i>" * 20_000, "<" * 500_000, "<title>" * 50_000, "<select>" * 50_000,
    "<noscript>" * 50_000 + "</noscript", "<td>" * 40_000 + "</a>" * 40_000, "<button>x" * 50_000 + "</button>", "<!--" * 100_000, "<svg>" * 50_000 + "</svg>", "<p>" + "word " * 400_000,
]


@pytest.mark.parametrize("k", range(len(LONG)))
def test_long_and_broken_pages_take_linear_time(k):
    began = time.perf_counter()
    main_blocks(LONG[k])
    assert time.perf_counter() - began < 10


def test_pages_of_many_blocks_take_about_linear_time():
    rng = random.Random(1)
    kinds = [lambda: "<li><a href=x>some link here</a></li>", lambda: "<p>Short one.</p>", lambda: "<div>a few words without end</div>", lambda: f"<p>{'word ' * rng.randint(3, 30)}.</p>"]
    began = time.perf_counter()
    assert main_blocks("<body>" + "".join(rng.choice(kinds)() for _ in range(40_000)))
    assert time.perf_counter() - began < 15


def test_flow_fills_every_path():
    """On trees of edges, the cut by dynamic programming."""
    rng = random.Random(4)
    for _ in range(60):
        n = 400
        gain = [rng.choice([0.0, rng.uniform(-2, 2)]) for _ in range(n)]
        edges = [(k, rng.randrange(max(0, k - 3), k), rng.uniform(0, 1.5)) for k in range(1, n)]
        cost = [[max(0.0, g), max(0.0, -g)] for g in gain]  # of the sink side, of the source side
        for a, b, c in reversed(edges):
            for side in (0, 1):
                cost[b][side] += min(cost[a][side], cost[a][1 - side] + c)
        labels = minimum_cut(gain, edges)
        got = sum(max(0.0, g) if not s else max(0.0, -g) for g, s in zip(gain, labels, strict=True)) + sum(c for a, b, c in edges if labels[a] != labels[b])
        assert got == pytest.approx(min(cost[0]))
