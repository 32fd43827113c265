import itertools
import random
import time

import numpy as np

from lodestone.llm import crf
from lodestone.llm.dom_blocks import leaf_blocks


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_leaf_blocks():
    assert texts(None) == texts("") == texts("<p> </p>") == []
    assert texts("a <b>b</b>\n c<p>d &amp;&nbsp;e<p>f<br>g") == ["a b c", "d & e", "f g"]
    assert texts('<script>var t="</p>";<p>x</script><style>p{}</style><!-- <p>no</p> -->yes<title>t</title>') == ["yes"]
    assert texts('<a title="x>y">k</a> 1 < 2 <p class=">">z') == ["k 1 < 2", "z"]
    assert texts("<p>open <div>in</div> after <script>cut") == ["open", "in", "after"]
    assert texts("x<!-- never closed <p>y") == ["x"]
    assert len(texts("<div>" * 3000 + "deep" + "<a \"" * 300)) == 1


def test_held_out_pages():
    model, rng, wrong, total = crf.default_model(), random.Random(1234), 0, 0
    for _ in range(100):
        page, labels = crf.labelled_page(rng)
        got = model.decode(leaf_blocks(page))
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong <= 0.02 * total


def test_viterbi_against_all_labellings():
    model, rng = crf.default_model(), random.Random(5)
    for _ in range(20):
        blocks = leaf_blocks(crf.labelled_page(rng)[0])[:9]
        unary = model.unary(blocks)

        def score(ys):
            return sum(u[y] for u, y in zip(unary, ys)) + sum(model.steps[a, b] for a, b in zip(ys, ys[1:]))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert np.isclose(score(model.decode(blocks)), score(best))


def test_extract(spark):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title &lt;</h1><p>One\n two.<p>Three.</article><section class='comments'><p>Nice post!</p></section><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5), (None, "u", page, 5), (1, "u", page, 5)], "page_id long, url string, html string, n_chars int")
    got = crf.extract(df).collect()
    assert len(got) == 5
    for r in got:
        want = "Title <\nOne two.\nThree." if r.page_id not in (2, 3) else ""
        assert (r.text, r.n_chars) == (want, len(want))
    assert crf.extract(df.limit(0)).count() == 0


def test_long_and_unclosed_quoted_values():
    for quote in "\"'":
        for n in (10, 5000, 300_000):
            value = "x" * n + "<p>leak</p>tail"
            assert texts(f"<div data-x = {quote}{value}{quote} id=a>one</div><p>two") == ["one", "two"]
    assert texts("<p title=it's>one</p><p>two</p><p>it's") == ["one", "two", "it's"]
    assert texts('<p a="1"">one</p><p>a "b"') == ["one", 'a "b"']
    assert texts("<p a='>one</p><p b=\">two") == ["one", "two"]
    began = time.process_time()
    leaf_blocks("<p a='>x" * 100_001 + '<p a=">x')
    leaf_blocks("<a " + 'x="><a " ' * 100_000 + "y='")
    assert time.process_time() - began < 20
