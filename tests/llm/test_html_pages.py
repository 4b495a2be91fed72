"""Made pages whose article is known, in several layouts, and pages that are large or deep."""

import html
import random
import time

from ledgerspark.llm import html_text

WORDS = "river stone market window garden paper village morning letter engine forest silver harbour winter bridge".split()


def sentence(draw):
    return " ".join(draw.choice(WORDS) for _ in range(draw.randint(8, 18))).capitalize() + draw.choice([".", " & more.", " < 5 > 3.", " é."])


def article(draw):
    """Blocks of text and their markup, with inline tags, references, breaks and ragged white space."""
    blocks, marks = [], []
    for k in range(draw.randint(4, 9)):
        a, b = sentence(draw), sentence(draw)
        blocks.append(f"{a} {b}")
        escape = html.escape if k % 2 else lambda s: s.replace("&", "&#38;").replace("<", "&lt;").replace(">", "&#x3E;")
        tag = "h2" if k == 2 else "p"
        inner = draw.choice([f"{escape(a)} <b>{escape(b)}</b>", f"{escape(a)}\n\t {escape(b)}", f"<span>{escape(a)}</span><br>{escape(b)}", f'{escape(a)} <a href="/x">{escape(b)}</a>'])
        marks.append(f"<{tag}>{inner}</{tag}>" if tag != "p" or k % 3 else f"<p>{inner}")
    return "\n".join(blocks), "".join(marks)


def page(draw, layout):
    text, marks = article(draw)
    noise = lambda: " ".join(sentence(draw) for _ in range(draw.randint(1, 3)))
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in draw.sample(WORDS, 8))
    comments = "".join(f'<div class="comment"><p>{html.escape(noise())}</p></div>' for _ in range(draw.randint(2, 6)))
    body = {
        0: f'<header><h1>Site</h1></header><nav><ul>{links}</ul></nav><div class="cookie-notice"><p>{html.escape(noise())}</p></div><main><article>{marks}</article><section id="comments">{comments}</section></main><aside><p>{html.escape(noise())}</p></aside><footer><p>{html.escape(noise())}</p></footer>',
        1: f'<div id="top" class="banner">{links}</div><div class="wrap"><div class="post-{draw.randint(100, 999)}">{marks}</div><div class="ad-slot"><p>{html.escape(noise())}</p></div><div class="sidebar"><p>{html.escape(noise())}</p></div></div><form><p>{html.escape(noise())}</p><input></form><div class="comments">{comments}</div>',
        2: f'<script>var a = "<p>no text</p>";</script><style>p {{ color: red }}</style><table><tr><td><div class="menu">{links}</div></td></tr></table><section class="story"><div class="text">{marks}</div></section><div role="complementary"><p>{html.escape(noise())}</p></div><div hidden><p>{html.escape(noise())}</p></div><!-- <p>{html.escape(noise())}</p> --><div class="disqus">{comments}</div>',
    }[layout]
    return text, f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"


def test_articles_of_three_layouts(spark):
    draw = random.Random(11)
    rows = [(i, f"https://host{i % 6}.example/{i}", *page(draw, i % 6 % 3)) for i in range(60)]
    df = spark.createDataFrame([(i, u, h) for i, u, _, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df.repartition(5)).collect()}
    wrong = [(i, got[i], t) for i, _, t, _ in rows if got[i] != t]
    assert not wrong, (len(wrong), wrong[0])


def test_repeated_empty_and_odd_rows(spark):
    _, h = page(random.Random(2), 0)
    rows = [(1, "https://a.example/1", h), (1, "https://a.example/1", h), (2, None, h), (None, "https://a.example/2", None), (3, "", ""), (4, "https://a.example/3", "plain & simple"), (5, "https://a.example/4", "<p>one<p>two")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    got = sorted(((r["page_id"] or 0), r["text"]) for r in html_text.extract(df).collect())
    text, _ = page(random.Random(2), 0)
    assert got == sorted([(1, text), (1, text), (2, text), (0, ""), (3, ""), (4, "plain & simple"), (5, "one\ntwo")])
    assert html_text.extract(df.where("page_id > 99")).count() == 0


def seconds(page):
    start = time.time()
    nodes, out = html_text.parse(page)
    path, _ = html_text.best_path(nodes, out)
    html_text.text_on(nodes, out, path)
    return time.time() - start


def test_large_and_deep_pages_cost_in_proportion():
    assert seconds("<script " * 125_000) < 2  # 1 MB
    assert seconds("<script x='" * 90_000) < 2
    assert seconds("<div>" * 20_000 + "word " * 50 + "</div>" * 20_000) < 2
    assert seconds("<ul>" * 20_000 + "<b>word</b> " * 20_000) < 3
    assert seconds("<span>" * 20_000 + "<p>some words here</p>" * 20_000) < 3
    assert seconds("<div class=a><p>word</div>" * 30_000) < 4
