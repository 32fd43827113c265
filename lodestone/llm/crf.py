"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.dom_blocks import Block, leaf_blocks

#: Labelled pages a model is trained on, with telling elements and without; the seed and the steps of its training.
TRAINING_PAGES, VARIED_PAGES, TRAINING_SEED, STEPS = 500, 700, 17, 150


#: Elements that by their own meaning hold something else than an article's text.
FURNITURE = set("nav header footer aside form button select textarea menu dialog template svg video audio canvas object iframe".split())


# --- features -------------------------------------------------------------------------------------


def above_features(above: tuple) -> list[str]:
    """From the tags above a block and the words of their classes, ids and roles."""
    tags = [t for t, _ in above if t not in ("html", "body")]
    out = {f"in:{t}" for t in tags} | {f"word:{w}" for _, words in above for w in words}
    out |= {f"own:{tags[-1]}" if tags else "own:none", f"top:{tags[0]}" if tags else "top:none"}
    names = {w for _, words in above for w in words}
    furniture = any(t in FURNITURE for t in tags)
    if not furniture:
        out.add("free" if names else "bare")  # no element above says what it is, or no name does either
    return sorted(out)


def text_features(block: Block) -> list[str]:
    text = block.text
    n, words = len(text), text.count(" ") + 1
    out = [f"words:{min(words.bit_length(), 7)}"]
    if block.link_chars * 2 > n:
        out.append("linked")
    if text[-1] in ".!?:;\"'…。":
        out.append("sentence")
    if "©" in text or "(c)" in text[:4].lower():
        out.append("copyright")
    if "|" in text or "»" in text or "·" in text:
        out.append("bars")
    return out


# --- labelled pages -------------------------------------------------------------------------------


def _filler(rng: random.Random, low: int, high: int) -> str:
    letters = rng.choice(["etaoinshrdlu", "enirstadhulg", "esaitnruléèà", "eaosrnidlcóñ"])
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
    style = rng.random()
    if style < 0.06:
        words = [w.upper() + "!!" for w in words]
    elif style < 0.12:
        words = [w + rng.choice(["***", "###", "%%%", "$$$"]) for w in words]
    elif style < 0.16:
        words = [x for w in words for x in (w, "|")]
    elif style < 0.2:
        words = [words[0]] * len(words)
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "", "?"])


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A made-up page and the label of each of its leaf blocks (1: main text)."""
    html: list[str] = []
    labels: list[int] = []

    def put(markup: str, label: int, *texts: str) -> None:
        html.append(markup.format(*texts))
        labels.extend([label] * len(texts))

    def listed(tag: str, name: str) -> None:
        items = [_filler(rng, 1, 3) for _ in range(rng.randint(2, 8))]
        label = f' class="{name}"' if name else ""
        put(f"<{tag}{label}><ul>" + '<li><a href="/x">{}</a></li>' * len(items) + f"</ul></{tag}>", 0, *items)

    def aside(tag: str, names: list[str], low: int = 2, high: int = 30, inner: str = "") -> None:
        name = rng.choice(names)
        kind = rng.choice(["class", "id"])
        label = f' {kind}="{name}"' if name else ""
        open_, close = (f"<{inner}>", f"</{inner}>") if inner else ("", "")
        for _ in range(rng.randint(1, 2)):
            put(f"<{tag}{label}>{open_}" + "{}" + f"{close}</{tag}>", 0, _filler(rng, low, high))

    def extras(where: str) -> None:
        pool = {
            "top": [
                lambda: listed("nav", rng.choice(["", "menu", "navbar"])), lambda: listed("div", rng.choice(["menu", "nav", "topbar", "breadcrumb"])),
                lambda: aside("header", ["", "site-header", "masthead"], 1, 12, rng.choice(["", "p", "h2", "h1"])),
                lambda: aside("div", ["ad", "ads", "advert", "banner", "sponsored", "promo"]), lambda: aside("div", ["cookie-notice", "notice", "consent", "alert", "gdpr"], 5, 40, rng.choice(["", "p"])),
            ],
            "middle": [lambda: aside("div", ["ad", "advert", "sponsored", "promo", "newsletter", "share", "social", "related"]), lambda: aside("aside", ["", "sidebar"], 2, 40, rng.choice(["", "p"])), lambda: aside("form", ["", "subscribe", "search"], 1, 8, rng.choice(["", "label", "p"]))],
            "bottom": [
                lambda: aside("footer", ["", "site-footer"], 1, 30, rng.choice(["", "p"])), lambda: aside("div", ["footer", "copyright", "legal"], 2, 30),
                lambda: aside("aside", ["", "sidebar", "widget", "related"], 2, 40, rng.choice(["", "p", "div"])), lambda: listed("div", rng.choice(["related", "sidebar", "links", "widget"])),
                lambda: aside("section", ["comments", "comment-list", "discussion", "responses"], 3, 60, rng.choice(["p", "div", "article", "li"])),
                lambda: aside("div", ["comments", "comment", "reply", "disqus"], 3, 60, rng.choice(["", "p"])), lambda: aside("form", ["", "comment-form", "search", "login"], 1, 8, rng.choice(["", "label", "p"])),
                lambda: aside("div", ["ad", "advert", "cookie-banner", "newsletter", "modal", "popup"], 3, 30),
            ],
        }[where]
        for make in rng.sample(pool, rng.randint(0 if where == "middle" else 1, min(4, len(pool)))):
            make()

    html.append("<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>".replace("{{}}", "{}"))
    extras("top")
    shell, name = rng.choice([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post-content"), ("div", "entry"), ("section", "main-content"), ("div", "story")])
    html.append(f'<{shell} class="{name}">' if name else f"<{shell}>")
    for _ in range(rng.randint(1, 9)):
        markup, low, high = rng.choice(
            [("<p>{}</p>", 1, 120)] * 5 + [("<h1>{}</h1>", 1, 12), ("<h2>{}</h2>", 1, 10), ("<p><b>{}<br>", 1, 60), ("<p>{}", 1, 60), ("<blockquote>{}</blockquote>", 3, 40), ("<ul><li>{}</li></ul>", 1, 25), ("<div>{}</div>", 5, 80), ("<table><tr><td>{}</td></tr></table>", 1, 12), ("<pre>{}</pre>", 2, 40), ("<p><a href='/x'>{}</a></p>", 1, 8), ("<figure><figcaption>{}</figcaption></figure>", 2, 15)]
        )
        put(markup, 1, _filler(rng, low, high))
        if rng.random() < 0.1:
            extras("middle")
    html.append(f"</{shell}>")
    extras("bottom")
    if rng.random() < 0.8:
        html.append("</body></html>")
    return "".join(html), labels


def _sentences(rng: random.Random, low: int, high: int) -> str:
    letters = rng.choice(["etaoinshrdlu", "enirstadhulg", "esaitnruléèà", "eaosrnidlcóñ", "aeioukstnrm", "оеаинтсрвл"])
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    return " ".join(" ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", ".", ".", "!", "?", ":"]) for _ in range(rng.randint(1, 4)))


def _any_name(rng: random.Random) -> str:
    """Attributes that tell nothing: none, or made-up words."""
    made = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9)))
    kind = rng.choice(["", "", "class", "id"])
    return f' {kind}="{rng.choice([made(), made() + "-" + made(), "c" + str(rng.randint(1, 99)), "wrapper", "inner", "row", "col", "text", "box", "page"])}"' if kind else ""


def varied_page(rng: random.Random) -> tuple[str, list[int]]:
    """A made-up page whose main text stands in no telling element, with the label of each leaf block.

    Its place is the body, nested divisions, sections or cells with made-up names; what is not main
    text is told by its element, by links or by its wording, and may stand within the article.
    """
    html: list[str] = []
    labels: list[int] = []

    def put(markup: str, label: int, *texts: str) -> None:
        html.append(markup.format(*texts))
        labels.extend([label] * len(texts))

    short = lambda: _filler(rng, 1, 4).rstrip(".!?")

    def links(open_: str, close: str) -> None:
        items = [short() for _ in range(rng.randint(2, 8))]
        form = rng.choice(["<li><a href='/x'>{}</a></li>", "<p><a href='/x'>{}</a></p>", "<div><a href='/x'>{}</a></div>"])
        inner = form * len(items)
        put(open_ + (f"<ul>{inner}</ul>" if "<li>" in form else inner) + close, 0, *items)

    def junk(within: bool) -> None:
        kinds = [
            lambda: put("<footer>{}</footer>", 0, _filler(rng, 1, 14)), lambda: put("<footer><p>{}</p></footer>", 0, _sentences(rng, 2, 9)), lambda: links("<nav>", "</nav>"),
            lambda: put("<aside><p>{}</p></aside>", 0, _sentences(rng, 2, 12)), lambda: put("<form><label>{}</label><input><button>{}</button></form>", 0, short(), short()),
            lambda: put("<form><select><option>{}<option>{}</select><textarea>{}</textarea></form>", 0, short(), short(), short()), lambda: put("<button>{}</button>", 0, short()),
            lambda: put("<video src=v>{}</video>", 0, _sentences(rng, 2, 7)), lambda: put("<object data=o><p>{}</p></object>", 0, _sentences(rng, 2, 7)), lambda: put("<svg><text>{}</text></svg>", 0, short()),
            lambda: put("<template><div><p>{}</p></div></template>", 0, _sentences(rng, 2, 9)), lambda: put("<canvas>{}</canvas>", 0, _sentences(rng, 2, 6)), lambda: put("<iframe src=i>{}</iframe>", 0, _sentences(rng, 2, 6)),
            lambda: put('<div class="{{}}">{{}}</div>'.replace("{{}}", rng.choice(["ad", "advert", "sponsored", "promo", "newsletter", "share", "social", "related"]), 1).replace("{{}}", "{}"), 0, _sentences(rng, 2, 9)),
        ]
        outside = [
            lambda: put("<header>{}</header>", 0, short()), lambda: put("<header><h1>{}</h1><p>{}</p></header>", 0, short(), _sentences(rng, 1, 5)), lambda: links(f"<div{_any_name(rng)}>", "</div>"),
            lambda: put('<section class="comments"><h3>{}</h3><div><p>{}</p></div><div><p>{}</p></div></section>', 0, short(), _sentences(rng, 2, 12), _sentences(rng, 2, 12)),
            lambda: put(f"<div{_any_name(rng)}>" + "© {}</div>", 0, short()), lambda: links(f"<table{_any_name(rng)}><tr><td>", "</td></tr></table>"),
            lambda: put('<div id="comments"><ul><li>{}</li><li>{}</li></ul></div>', 0, _sentences(rng, 2, 12), _sentences(rng, 2, 9)), lambda: put('<div class="cookie-notice"><p>{}</p><button>{}</button></div>', 0, _sentences(rng, 3, 12), short()),
        ]
        pool = kinds if within else kinds[:5] + outside
        rng.choice(pool)()

    html.append("<html><head><title>t</title></head><body>" if rng.random() < 0.7 else "")
    for _ in range(rng.randint(0, 3)):
        junk(False)
    depth = rng.randint(0, 3)
    place = rng.random()
    opened = [rng.choice(["div", "div", "div", "section", "center"]) for _ in range(depth)]
    html.extend(f"<{t}{_any_name(rng)}>" for t in opened)
    if place < 0.2:
        html.append(f"<table{_any_name(rng)}><tr><td{_any_name(rng)}>")
    elif place < 0.5:
        html.append(rng.choice(["<article>", "<main>", f"<article{_any_name(rng)}>"]))
    plain_list = lambda: put("<ul><li>{}</li><li>{}</li></ul>", 1, _sentences(rng, 2, 9), _sentences(rng, 2, 9))
    for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 8])):
        html.append(rng.choice(["", "", "", f"<div{_any_name(rng)}>"]))
        wrapped = html[-1] != ""
        kind = rng.random()
        if kind < 0.6:
            put(rng.choice(["<p>{}</p>", "<p>{}", "<p{{}}>{}</p>".replace("{{}}", _any_name(rng)), "<p><b>{}</b></p>", "<p>{}<br></p>", "<noscript><p>{}</p></noscript>"]), 1, _sentences(rng, 1, 25))
        elif kind < 0.75:
            put(rng.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<h3>{}</h3>"]), 1, short())
        elif kind < 0.82:
            put(rng.choice(["<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>"]), 1, _sentences(rng, 2, 12))
        elif kind < 0.9:
            plain_list()
        else:
            put("<dl><dt>{}<dd>{}</dl>", 1, short(), _sentences(rng, 2, 9))
        if wrapped:
            html.append("</div>")
        if rng.random() < 0.12:
            junk(True)
    if 0.2 <= place < 0.5:
        html.append(rng.choice(["<footer>{}</footer>", ""]))
        if html[-1]:
            put(html.pop(), 0, _filler(rng, 1, 8))
        html.append("</article></main>")
    elif place < 0.2:
        html.append("</td></tr></table>")
    html.extend(f"</{t}>" for t in reversed(opened))
    for _ in range(rng.randint(0, 3)):
        junk(False)
    return "".join(html), labels


# --- the model ------------------------------------------------------------------------------------


class ChainCrf:
    """Two labels; a weight for every feature and label, and one for every step between labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps
        self._above: dict[tuple, tuple[float, float]] = {}

    def _score(self, features: list[str]) -> tuple[float, float]:
        rows = [self.names[f] for f in features if f in self.names]
        s = self.weights[rows].sum(axis=0)
        return float(s[0]), float(s[1])

    def unary(self, blocks: list[Block]) -> list[tuple[float, float]]:
        out = []
        for b in blocks:
            above = self._above.get(b.above)
            if above is None:
                if len(self._above) > 50_000:
                    self._above.clear()
                above = self._above[b.above] = self._score(["bias", *above_features(b.above)])
            key = tuple(text_features(b))
            text = self._above.get(key)
            if text is None:
                text = self._above[key] = self._score(list(key))
            out.append((above[0] + text[0], above[1] + text[1]))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi: the labels with the highest total weight (ties: main text)."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        back, best = [], (0.0, 0.0)
        for i, (u0, u1) in enumerate(self.unary(blocks)):
            if not i:
                best = (u0, u1)
                continue
            a, b, c, d = best[0] + s00, best[1] + s10, best[0] + s01, best[1] + s11
            back.append((int(b >= a), int(d >= c)))
            best = (max(a, b) + u0, max(c, d) + u1)
        if not blocks:
            return []
        labels = [int(best[1] >= best[0])]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[str, list[int]]], steps: int = STEPS, l2: float = 0.02) -> ChainCrf:
    """Maximum conditional likelihood (forward-backward gradients, Adam) on labelled pages.

    Pages whose number of labels is not that of their leaf blocks are refused.
    """
    names: dict[str, int] = {}
    rows, cols, gold, chains = [], [], [], []
    for page, labels in pages:
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("a page's labels don't match its blocks")
        if not blocks:
            continue
        chains.append(len(blocks))
        for b, y in zip(blocks, labels):
            for f in ["bias", *above_features(b.above), *text_features(b)]:
                rows.append(len(gold))
                cols.append(names.setdefault(f, len(names)))
            gold.append(y)
    y, longest = np.array(gold), max(chains)
    at = np.full((len(chains), longest), -1)
    k = 0
    for i, n in enumerate(chains):
        at[i, :n] = range(k, k + n)
        k += n
    live = at >= 0
    rows_, cols_ = np.array(rows), np.array(cols)
    want = np.zeros((len(names), 2))
    np.add.at(want, (cols_, y[rows_]), 1)
    pairs = np.zeros((2, 2))
    both = live[:, 1:] & live[:, :-1]
    np.add.at(pairs, (y[at[:, :-1][both]], y[at[:, 1:][both]]), 1)
    theta = np.zeros(2 * len(names) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        unary = np.zeros((len(y), 2))
        np.add.at(unary, rows_, w[cols_])
        u = np.where(live[..., None], unary[at], 0.0)
        f, b = np.zeros_like(u), np.zeros_like(u)
        f[:, 0] = u[:, 0]
        for i in range(1, longest):
            f[:, i] = np.where(live[:, i, None], np.logaddexp(f[:, i - 1, :1] + t[0], f[:, i - 1, 1:] + t[1]) + u[:, i], f[:, i - 1])
        for i in range(longest - 2, -1, -1):
            x = b[:, i + 1] + u[:, i + 1]
            b[:, i] = np.where(live[:, i + 1, None], np.logaddexp(x[:, :1] + t[:, 0], x[:, 1:] + t[:, 1]), 0.0)
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p = np.exp(f + b - z[:, None, None])
        expect = np.zeros((len(names), 2))
        np.add.at(expect, cols_, p[live][rows_])
        q = np.exp(f[:, :-1, :, None] + t + (u + b)[:, 1:, None, :] - z[:, None, None, None])[both].sum(axis=0)
        grad = np.concatenate([(expect - want).ravel(), (q - pairs).ravel()]) / len(chains) + l2 * theta / 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.15 * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ChainCrf(names, theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


@lru_cache(maxsize=1)
def default_model() -> ChainCrf:
    rng = random.Random(TRAINING_SEED)
    return train([labelled_page(rng) for _ in range(TRAINING_PAGES)] + [varied_page(rng) for _ in range(VARIED_PAGES)])


def main_text(model: ChainCrf, page: str | None) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, model.decode(blocks)) if y)


def extract(df: DataFrame, model: ChainCrf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; blocks of the main text joined by newlines.

    Null and empty pages, and pages without main text, give an empty text; repeated rows and ids are
    extracted each, extra columns are ignored whatever their names, an empty table gives no rows.
    Each page is read whole in one pass on its own task; the model (a few hundred weights) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(shared.value, x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
