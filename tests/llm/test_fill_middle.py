import hashlib
import re

from lodestone.llm import fill_middle

TEXTS = [
    None, "", "a", "\n", "one\ntwo\nthree", "one\ntwo\n", "é\n\n\nüñ́\n", "with <P> in it\nb", "<S>", "<M", "a<\nS>\nb\n", "x\r\ny\rz\n", " a\n\x0bb\n\0c\n",
    "<\n<\n<P\n" * 3, "line\n" * 5000, "long " * 300_000, "one\ntwo\nthree", "<<S\n>M>\n<M\n",
]
SHAPE = "doc_id long, text string, n string, form string, output string, h string, units string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "x", "psm", "y", "z", "u") for i, t in enumerate(texts)], SHAPE)


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or re.search("<[PSM]>", text) or c % 100 >= rate:
        return n, "plain", None, None, text
    if d % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_a_plain_version(spark):
    for first, options in ((0, {}), (1000, {"seed": 11, "rate": 60, "spm": 20})):
        texts = TEXTS * 4
        got = {r.doc_id: r for r in fill_middle.arrange(frame(spark, texts, first), with_restored=True, **options).collect()}
        assert len(got) == len(texts)
        forms = set()
        for i, t in enumerate(texts):
            r = got[i + first]
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(i + first, t, **options), (i, t)
            assert r.restored == (t or "")
            forms.add(r.form)
        assert forms == {"plain", "psm", "spm"}


def test_restore_and_digests(spark):
    df = frame(spark, TEXTS)
    back = fill_middle.restore(fill_middle.arrange(df)).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    for r in fill_middle.fill_digests(df).collect():
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.output_sha256, r.restored_sha256) == (sha(plain(r.doc_id, TEXTS[r.doc_id])[4]), sha(TEXTS[r.doc_id] or ""))


def test_odd_rows(spark):
    same = frame(spark, ["a\nb\nc\n"])
    rows = fill_middle.arrange(same.union(same)).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert fill_middle.arrange(frame(spark, [])).count() == 0 == fill_middle.fill_digests(frame(spark, [])).count()
    lone = spark.createDataFrame([(None, "a\nb\nc\n")], "doc_id long, text string")
    r = fill_middle.arrange(lone).first()
    assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (None, *plain(None, "a\nb\nc\n"))
