"""Pages written by hand, in markup that no line of the training generator has made."""

import itertools
import random

import numpy as np
import pytest

from lodestone.llm import crf
from lodestone.llm.dom_blocks import leaf_blocks

BODY = "Body text here one two three."

CASES = [
    ("<body><h1>T</h1><p>Body text here one two three.</p></body>", ["T", BODY]),
    ('<div id="wrapper"><div class="text"><p>Body text here one two three.</p></div></div>', [BODY]),
    ('<table><tr><td class="artikel"><p>Body text here one two three.</p></td></tr></table>', [BODY]),
    ("<nav><a href=/>Home</a></nav><div><div><p>Body text here one two three.</p></div></div><footer>Imprint</footer>", [BODY]),
    ("<article><h1>A title</h1><p>Body text here one two three.</p><footer>Filed under x</footer></article>", ["A title", BODY]),
    ("<article><p>Let <math><mi>x</mi></math> be small.</p><noscript><p>A picture of it.</p></noscript></article>", ["Let x be small.", "A picture of it."]),
    ("<script src=https://x.com/>alert(1)</script><p>After it came the text.</p>", ["After it came the text."]),
    ("<p>Let <svg><title>no</title><style/></svg> it be small.</p>", ["Let", "it be small."]),
    ("<p>a sentence.</p><!--><p>b sentence.</p><!-- x --><p>c sentence.</p>", ["a sentence.", "b sentence.", "c sentence."]),
    ("<p>a sentence.</p><!---><p>b sentence.</p><!-- x --!><p>c sentence.</p>", ["a sentence.", "b sentence.", "c sentence."]),
    ("<p>Tom &am<b>p;</b> Jerry are friends, &lt;b&gt; not.</p>", ["Tom &amp; Jerry are friends, <b> not."]),
    ("<svg><svg><text>in</text></svg><text>out</text></svg><p>The text of it is long.</p>", ["The text of it is long."]),
    ("<object><object>one</object>two</object><p>The text of it is long.</p>", ["The text of it is long."]),
    ("<template><p>a</p><template>b</template>c</template><p>The text of it is long.</p>", ["The text of it is long."]),
    ("<script>var a = '</scripty>'; b()</script ><p>The text of it is long.</p>", ["The text of it is long."]),
]

PAGES = [
    (
        """<!doctype html><html><head><title>Harbour</title><meta charset=utf-8></head><body class="home">
<div class="hdr"><a href="/">Harbour News</a> <a href="/s">Sport</a> <a href="/w">Weather</a></div>
<div class="lay"><div class="c8"><h1 class="hl">Ferry service returns after a long winter</h1>
<p class="by">The first boat left at seven in the morning, with forty people on board.</p>
<p>Its captain said that the ice had gone <i>earlier</i> than in other years &ndash; and that nobody missed it.</p>
<blockquote>We waited for five months.</blockquote><p>The timetable is the one of last summer.</p></div>
<div class="c4"><ul><li><a href="/1">Most read</a></li><li><a href="/2">Letters</a></li><li><a href="/3">Jobs</a></li></ul></div></div>
<footer><p>© Harbour News. All rights reserved.</p></footer></body></html>""",
        ["Ferry service returns after a long winter", "The first boat left at seven in the morning, with forty people on board.",
         "Its captain said that the ice had gone earlier than in other years – and that nobody missed it.", "We waited for five months.", "The timetable is the one of last summer."],
    ),
    (
        """<html><body><table width="100%"><tr><td><a href="a.html">Start</a><br><a href="b.html">Links</a></td><td>
<h2>How we built the shed</h2><p>We bought the wood in spring and let it dry until the end of August.</p>
<p>Then the walls went up in two days, and the roof in three.</p><ul><li>Twelve beams were used for the floor.</li><li>The door came from an old barn.</li></ul>
</td></tr></table></body></html>""",
        ["How we built the shed", "We bought the wood in spring and let it dry until the end of August.", "Then the walls went up in two days, and the roof in three.",
         "Twelve beams were used for the floor.", "The door came from an old barn."],
    ),
    (
        """<body><header><div><a href=/>Brot &amp; Salz</a></div><nav><a href=/r>Rezepte</a><a href=/k>Kontakt</a></nav></header><main><section><h1>Sauerteig für Anfänger</h1>
<p>Ein guter Teig braucht vor allem Zeit, und davon mehr als man denkt.</p><h2>Der Ansatz</h2><p>Man rührt Mehl und Wasser zu gleichen Teilen an.</p>
<form action=/n><label>E-Mail</label><input name=m><button>Bestellen</button></form><p>Nach drei Tagen riecht er mild und etwas nach Apfel.</p></section></main>
<section class="comments"><h3>2 Kommentare</h3><article><p>Bei mir hat es nicht geklappt.</p></article><article><p>Bei mir schon!</p></article></section><footer>Impressum</footer>""",
        ["Sauerteig für Anfänger", "Ein guter Teig braucht vor allem Zeit, und davon mehr als man denkt.", "Der Ansatz", "Man rührt Mehl und Wasser zu gleichen Teilen an.", "Nach drei Tagen riecht er mild und etwas nach Apfel."],
    ),
    (
        """<div id="page"><div id="top"><ul><li><a href=1>Inicio</a><li><a href=2>Noticias</a></ul></div><div id="main-story"><h1>La lluvia llega al valle</h1><p>Los campesinos esperaban el agua desde marzo.</p>
<p>Ahora el r&iacute;o baja lleno y el puente viejo est&aacute; cerrado.</p></div><div class="cookie-notice"><p>Usamos cookies para mejorar su visita.</p><button>Aceptar</button></div></div>""",
        ["La lluvia llega al valle", "Los campesinos esperaban el agua desde marzo.", "Ahora el río baja lleno y el puente viejo está cerrado."],
    ),
]


@pytest.mark.parametrize("page,want", CASES)
def test_small_pages(page, want):
    assert crf.main_text(crf.default_model(), page).split("\n") == want


def test_pages_by_hand():
    hit = found = wanted = 0
    for page, want in PAGES:
        got = crf.main_text(crf.default_model(), page).split("\n")
        hit += sum(t in want for t in got)
        found += len(got)
        wanted += len(want)
    assert hit >= 0.9 * found and hit >= 0.9 * wanted, (hit, found, wanted)


def test_held_out_varied_pages():
    model, rng, wrong, total = crf.default_model(), random.Random(77), 0, 0
    for _ in range(150):
        page, labels = crf.varied_page(rng)
        got = model.decode(leaf_blocks(page))
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong <= 0.04 * total


def test_likelihood_against_all_labellings():
    """At the end of a training the plain gradient, summed over every labelling, is close to none."""
    rng, pages = random.Random(9), []
    while len(pages) < 12:
        page, labels = crf.labelled_page(rng)
        if 2 <= len(labels) <= 8:
            pages.append((page, labels))
    model = crf.train(pages, steps=1500, l2=0.5)
    grad_w, grad_s = np.zeros_like(model.weights), np.zeros((2, 2))
    for page, gold in pages:
        blocks = leaf_blocks(page)
        rows = [[model.names[f] for f in ["bias", *crf.above_features(b.above), *crf.text_features(b)]] for b in blocks]
        every = list(itertools.product((0, 1), repeat=len(blocks)))
        score = lambda ys: sum(model.weights[r, y].sum() for r, y in zip(rows, ys)) + sum(model.steps[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023, E731
        logs = np.array([score(ys) for ys in every])
        shares = np.exp(logs - np.logaddexp.reduce(logs))
        for share, ys in [*zip(shares, every), (-1.0, gold)]:
            for r, y in zip(rows, ys):
                np.add.at(grad_w[:, y], r, share)
            for a, b in zip(ys, ys[1:]):
                grad_s[a, b] += share
    assert np.abs(grad_w / len(pages) + 0.05 * model.weights).max() < 5e-3
    assert np.abs(grad_s / len(pages) + 0.05 * model.steps).max() < 5e-3


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph number {i} goes on for a while, as such texts do.</p>" for i in range(30_000)) + "</article>"
    df = spark.createDataFrame([(1, "u", long, "x", 1), (2, "u", "<p>" + "word " * 400_000, "x", 1), (3, "u", "<" * 50_000 + "div" * 9, "x", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in crf.extract(df).collect()}
    assert got[1].text.count("\n") == 29_999 and got[2].n_chars == 5 * 400_000 - 1 and set(got) == {1, 2, 3}
