"""The text-to-tag ratios decide: pages put together from known parts, ablation, deep nesting."""

import random
import time

import pytest

from ruleloom.llm import html

PROSE = "the of and a long story about people who went far away from their home in summer because they liked to walk".split()


def sentence(r, n):
    return " ".join(r.choice(PROSE) for _ in range(n)).capitalize() + "."


def page(r):
    """Random html and the text of its article, by construction."""
    blocks, shown = [], []
    title = sentence(r, 5)
    blocks.append(f"<h1>{title}</h1>")
    shown.append(title)
    for _ in range(r.randint(4, 9)):
        t = sentence(r, r.randint(25, 60))
        if r.random() < 0.3:
            h = sentence(r, 3)
            blocks.append(f"<h2 class='section-title'>{h}</h2>")
            shown.append(h)
        shown.append(f"{t} & so on")
        blocks.append(r.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>"]).format(f"{t} &amp;\n so <b>on</b>"))
    if r.random() < 0.5:
        blocks.insert(3, f"<div class='ad-slot'><p>{sentence(r, 12)}</p></div>")
    menu = "<ul>" + "".join(f"<li><a href=/{k}>{r.choice(PROSE)}</a></li>" for k in range(r.randint(4, 9))) + "</ul>"
    before = r.sample([f"<nav>{menu}</nav>", f"<div>{menu}</div>", f"<div class='cookie-notice'>{sentence(r, 10)}</div>", f"<header><p>{sentence(r, 4)}</p></header>", "<div><p>Home</p><p>News</p><p>Sport</p><p>Video</p></div>", "<script>if (a < b) { x('<p>no</p>') }</script>"], 4)
    after = r.sample([f"<div id='comments'><p>{sentence(r, 40)}</p></div>", f"<footer>{sentence(r, 9)}</footer>", f"<aside><p>{sentence(r, 30)}</p></aside>", "<div><p>Imprint</p><p>Jobs</p><p>Press</p></div>", f"<form><p>{sentence(r, 8)}</p><input></form>"], 3)
    outer = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<div class='layout no-sidebar'><article>", "</article></div>"), ("<div id='content'>", "</div>")])
    return f"<html><head><title>{sentence(r, 3)}</title><style>p {{}}</style></head><body>{''.join(before)}{outer[0]}{''.join(blocks)}{outer[1]}{''.join(after)}</body></html>", "\n".join(shown)


def test_query_on_pages_put_together(spark, tmp_path):
    r = random.Random(11)
    pages = [page(r) for _ in range(200)]
    spark.createDataFrame([(k, f"u{k}", p, "x") for k, (p, _) in enumerate(pages)], "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {x.page_id: x for x in html.op4_html_text(spark, str(tmp_path)).collect()}
    assert [k for k, (_, want) in enumerate(pages) if (got[k].text, got[k].n_chars, got[k].url) != (want, len(want), f"u{k}")] == []
    flat = [html.main_text(p, ratio=lambda chars, tags: 1.0) for p, _ in pages]  # without the ratios
    assert sum(x != want for x, (_, want) in zip(flat, pages)) > 20


@pytest.mark.parametrize("name, noise", [("sidebar", True), ("left sidebar", True), ("sidebar-left", True), ("adSlot", True), ("site-footer", True), ("no-sidebar", False), ("has-ads", False), ("shared", False), ("roadside", False), ("load", False)])
def test_whole_names(name, noise):
    assert html.named(name, html.NOISE) == noise


def test_a_name_that_holds_the_article_is_no_noise():
    lines = "".join(f"<p>Paragraph {k} of the article has quite some words in it.</p>" for k in range(5))
    for wrap in ("<form>{}</form>", "<div class='popup'>{}</div>", "<div class='layout no-sidebar'>{}</div>"):
        assert html.main_text("<body>" + wrap.format(f"<article><h1>T</h1>{lines}</article>") + "</body>").startswith("T\nParagraph 0")


def test_deep_pages_take_linear_time():
    n = 20_000
    for deep in ("<div>" * n + "x", "<div>x" * n, "<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "x</i>" * n, "<b>" * n + "<li><p>x</p>" * n):
        began = time.perf_counter()
        html.main_text(deep)
        assert time.perf_counter() - began < 5
