import re
import time

import numpy as np
import pytest

from stratavox.llm.language import _trigrams, identify, op9_language, text_scores, train, visible
from tests.conftest import SF2


def test_pages_get_their_declared_language_mostly(spark):
    rows = op9_language(spark, SF2).collect()
    assert len(rows) == spark.read.parquet(f"{SF2}/pages.parquet").count()
    assert np.mean([r.lang == r.declared for r in rows]) > 0.95
    assert np.mean([r.text_lang == r.declared for r in rows]) > 0.95
    assert all(0 < r.posterior <= 1 for r in rows)


def test_visible_text():
    html = b"<html><head><style>p{}</style><script>var t='</p>';</script></head><!-- no --><body><p>One <b>two</b></body>"
    assert bytes(visible(html)).split() == [b"One", b"two"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>5 < 6 and <3 <b>then</b> on</p>", "5 < 6 and <3 then on"), ("<i>a -> b</i> c > d <b>e</b>", "a -> b c > d e"), ("<a title='1 > 0' rel=\"<x>\">in</a> out", "in out"),
        ("<p title=don't>it's <b>so</b></p>", "it's so"), ("<p one <b>two</b> three", "<p one two three"), ("a <!-- b <i>c</i> d", "a <!-- b c d"),
        ("<a href=\"x>one <b>two</b> three", "one two three"), ("<?xml v?><!DOCTYPE html>x<br/>y</p >z", "xyz"), ("<", "<"), ("", ""), ("a<b", "a<b"),
    ],
)
def test_stray_brackets_hide_no_text(html, text):
    assert bytes(visible(html.encode())).decode() == text


def test_balanced_pages_show_what_depth_shows(spark):
    """On pages without a stray bracket the text is what lies outside of all brackets."""
    for r in spark.read.parquet(f"{SF2}/pages.parquet").select("html").collect():
        html = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", r.html or "")
        assert bytes(visible((r.html or "").encode())).decode() == re.sub("<[^<>]*>", "", html)


def test_unclosed_tags_take_time_in_proportion():
    began = time.monotonic()
    for piece in (b"<a ", b"<a =\"", b"<a x=\"<a ' ", b"<a='<"):
        visible(piece * 200_000)
    assert time.monotonic() - began < 20


def test_text_behind_a_stray_bracket_decides(spark):
    b = "xwrq zzpt qqvk " * 30
    df = spark.createDataFrame([(1, "http://h.test/", page("aa", f"5 < 6 {b}"))], "page_id long, url string, html string")
    r = identify(df, docs(spark)).collect()[0]
    assert (r.declared, r.text_lang, r.lang) == ("aa", "bb", "bb")


def docs(spark):
    words = {"aa": "kalo mira suno tevi", "bb": "xwrq zzpt qqvk jjxw"}
    return spark.createDataFrame([(i, " ".join([words[c]] * 20), c) for i in range(20) for c in words] + [(50, None, "aa"), (51, "kalo", None)], "doc_id long, text string, lang string")


def page(lang, text):
    return f"<html{f' lang={lang}' if lang else ''}><body><p>{text}</p></body></html>"


def test_evidence_is_fused(spark):
    a, b = "kalo mira suno " * 30, "xwrq zzpt qqvk " * 30
    rows = [
        (1, "http://h.aa/x", page("aa", a)), (2, "http://h.test/bb/x", page("bb", b)), (3, "http://h.test/", page(None, b)), (4, "http://h.test/aa/", page("aa", "")),
        (5, "http://lone.test/", page("aa", b)), (6, None, None), (7, "", ""), (8, "http://s.k.test/", ""), (8, "http://s.k.test/", ""), (9, "http://t.k.test/", page("bb", b)),
        (10, "http://h.test/", page("zz", a)), (None, "http://h.test/bb", page(None, "")),
    ]
    rows += [(100 + i, "http://b.many.test/", page("bb", b)) for i in range(60)] + [(200, "http://b.many.test/", ""), (201, "http://c.many.test/", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, prior string")
    got = {r.page_id: r for r in identify(df, docs(spark)).collect()}
    assert {k: got[k].lang for k in (1, 2, 3, 4, 9, 10)} == {1: "aa", 2: "bb", 3: "bb", 4: "aa", 9: "bb", 10: "aa"}
    assert got[5].declared == "aa" and got[5].lang == "bb"  # a long text outweighs a wrong declaration
    assert got[10].declared is None and got[None].suggested == "bb" and got[1].suggested == "aa"
    # Without evidence of its own a page follows its host, and a new host its parent domain.
    assert got[200].lang == "bb" and got[201].lang == "bb" and got[200].posterior > got[201].posterior > got[6].posterior
    assert len(got) == len({r[0] for r in rows})
    assert identify(df.limit(0), docs(spark)).count() == 0


def test_without_languages(spark):
    df = spark.createDataFrame([(1, "http://h/", "x")], "page_id long, url string, html string")
    r = identify(df, docs(spark).limit(0)).collect()[0]
    assert r.lang is None and r.posterior is None


def test_pages_without_evidence_have_no_vote(spark):
    b = "xwrq zzpt qqvk " * 30
    rows = [(i, "http://x.host.test/", page("bb", b)) for i in range(10)] + [(100 + i, "http://x.host.test/", "") for i in range(30)]
    got = identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs(spark)).collect()
    assert all(r.lang == "bb" for r in got) and all(r.posterior > 0.8 for r in got if r.page_id >= 100)
    alone = spark.createDataFrame([(1, "http://x.host.test/", "")], "page_id long, url string, html string")
    assert identify(alone, docs(spark)).collect()[0].posterior == pytest.approx(0.5)


def plain_posteriors(rows, languages, model):
    """Every page by itself: its scores, and the votes of all other pages at three levels."""
    pages = []
    for i, url, html in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2].lower()) if m else ("", "")
        labels = host.split(".")
        tag = re.search(r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2})""", html or "")
        said = tag[1].lower() if tag and tag[1].lower() in languages else None
        hint = next((s for s in path.split("/") if s in languages), None) or (labels[-1] if labels[-1] in languages else None)
        (score,), (any_text,) = text_scores([visible((html or "").encode())], model)
        for code, right in ((said, 0.9), (hint, 0.8)):
            if code:
                score = score + [np.log(right if c == code else (1 - right) / (len(languages) - 1)) for c in languages]
        p = np.exp(score - max(score))
        vote = np.rint(1e6 * p / p.sum()) / 1e6 if any_text or said or hint else np.zeros(len(languages))
        pages.append((i, host, ".".join(labels[1:]) if len(labels) > 2 else host, score, vote))
    for a, (i, host, parent, score, _) in enumerate(pages):
        prior = None
        for test in (lambda q: True, lambda q: q[2] == parent, lambda q: q[1] == host):  # noqa: B023
            n = np.zeros(len(languages)) + sum(q[4] for b, q in enumerate(pages) if b != a and test(q))
            prior = (n + 1) if prior is None else n + 20 * prior
            prior = prior / prior.sum()
        fused = score + np.log(prior)
        p = np.exp(fused - fused.max())
        yield i, languages[int(p.argmax())], float(p.max() / p.sum())


def test_posteriors_equal_brute_force(spark):
    made = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF2}/pages.parquet").limit(150).collect()]
    rows = made + [(1000 + i, "http://a.b.test/x", "" if i % 3 else page("fr" if i % 2 else None, "mot " * (i % 4))) for i in range(20)] + [(None, None, None), (7, "", "?"), (7, "", "?")]
    source = spark.read.parquet(f"{SF2}/documents.parquet")
    languages, model = train(source)
    want = sorted(plain_posteriors(rows, languages, model), key=str)
    got = sorted(((r.page_id, r.lang, r.posterior) for r in identify(spark.createDataFrame(rows, "page_id long, url string, html string"), source).collect()), key=str)
    assert [g[:2] for g in got] == [x[:2] for x in want]
    assert [g[2] for g in got] == pytest.approx([x[2] for x in want], rel=1e-6)


def test_a_very_long_page(spark):
    text = "kalo mira suno " * 400_000
    (r,) = identify(spark.createDataFrame([(1, "http://h/", page(None, text))], "page_id long, url string, html string"), docs(spark)).collect()
    assert r.lang == "aa"
    whole = np.concatenate(list(_trigrams(visible(text.encode()))))
    assert len(whole) == len(text) - 2


def test_many_languages_keep_the_model_bounded(spark):
    rows = [(i, f"w{i} " * 5, f"l{i}") for i in range(700)]
    languages, model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(languages) == 700 and model.size <= 1 << 24
