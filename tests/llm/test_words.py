import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavox.llm import words as w

TEXT = st.text(st.sampled_from("aAzZ09 \t\n\v\f\r.,!/:@[`{~éßÉ中  \x00\x7f"), max_size=40)


def found(texts, member):
    for i, j, raw, off in w.slices(pa.array(texts, pa.string()), most=16):
        x = w.Words(raw, off, member)
        blob = raw.tobytes()
        for k in range(j - i):
            yield [blob[a:b].decode() for a, b in zip(x.start[x.first[k] : x.first[k + 1]], x.end[x.first[k] : x.first[k + 1]])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_the_patterns(texts):
    assert list(found(texts, w.SPACED)) == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    lowered = [None if t is None else "".join(c.lower() if c.isascii() else c for c in t) for t in texts]
    assert list(found(lowered, w.LETTERED)) == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "") for t in lowered]
    upper = [x for x in found(texts, w.LETTERED)]
    assert [[y.lower() if y.isascii() else y for y in x] for x in upper] == [[y.lower() if y.isascii() else y for y in x] for x in found(texts, w.LETTERED)]


def test_hashes_depend_on_the_word_only_and_fold_ascii_case():
    def hashes(*texts):
        return np.concatenate([w.Words(r, o, w.SPACED).hash for _, _, r, o in w.slices(pa.array(texts))])

    a = hashes("one two one", "TWO two", "ONE")
    assert a[0] == a[2] == a[5] and a[1] == a[3] == a[4] and a[0] != a[1]
    many = hashes(" ".join(f"w{i}" for i in range(100_000)))
    assert len(np.unique(many)) == 100_000


def test_ngrams_depend_on_order():
    h = w.Words(np.frombuffer(b"a b b a a b", np.uint8), np.array([0, 11]), w.SPACED).hash
    g = w.ngram_hashes(h, 2)
    assert g[0] == g[4] and g[0] != g[2]
    assert len(w.ngram_hashes(h, 7)) == 0


def test_a_long_document_is_one_slice():
    t = "word " * 400_000
    (one,) = w.slices(pa.array([t]))
    assert len(w.Words(*one[2:], w.SPACED)) == 400_000


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 9))
def test_pieces_of_any_size_give_the_same_words(texts, piece):
    ((_, _, raw, off),) = w.slices(pa.array([*texts, "end"], pa.string()))
    before, whole = w.SLICE_BYTES, w.Words(raw, off, w.SPACED)
    grams = w.ngram_hashes(whole.hash, 3)
    try:
        w.SLICE_BYTES = piece
        cut = w.Words(raw, off, w.SPACED)
        assert all((getattr(cut, f) == getattr(whole, f)).all() for f in ("start", "end", "first", "hash"))
        assert (w.ngram_hashes(cut.hash, 3) == grams).all()
    finally:
        w.SLICE_BYTES = before
