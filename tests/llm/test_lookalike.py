"""What looks the same and what doesn't, the classes' transitivity, and pairs against brute force."""

import pytest

from loomline.llm.lookalike import Classes, Rewriter, look_alike_classes, look_alike_classes_of, look_alike_pairs, rewriting


@pytest.fixture(scope="module")
def form():
    return Rewriter(rewriting(look_alike_classes(), {"o": 5, "-": 5, " ": 9})).canonical


SAME = [
    ("velvet", "ｖｅｌｖｅｔ"), ("port", "рοrt"), ("a b", "a b"), ("a b", "a b"), ("a b", "a　b"), ("café", "café"), ("word", "wo​rd"), ("word", "w­ord﻿"),
    ("wo‍rd", "w⁠ord"), ("file office", "ﬁle oﬃce"), ("a-b", "a‐b"), ("a-b", "a‑b"), ("ガギ", "ｶﾞｷﾞ"), ("ガ", "ガ"), ("ёж", "ёж"), ("\U0001d41bold", "bold"),
    ("⚠", "⚠️"), ("a\nb", "a\r\nb"), ("ﬁ‌", "f‌i"), ("ệ", "ệ"), ("ệ", "е̣̂"), ("é", "e​́"), ("é", "ｅ́"), ("한글", "한글"),
]
DIFFERENT = [
    ("cafe", "café"), ("Word", "word"), ("m2", "m²"), ("1", "①"), ("0", "O"), ("l", "1"), ("I", "l"), ("a b", "a  b"), ("ab", "a b"), ("it's", "it’s"), ("-", "—"), ("👩💻", "👩‍💻"),
    ("て", "で"), ("α", "a"), ("rn", "m"), ("½", "1/2"), ("ſ", "s"), ("س‌ت", "ست"), ("ç", "c"), ("Ø", "ø"), ("ʏ", "y"), ("Å", "A"), ("a\tb", "a b"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same(form, a, b):
    assert form(a) == form(b)
    assert form(form(a)) == form(a)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(form, a, b):
    assert form(a) != form(b)


def test_classes_are_transitive_and_represented_by_the_most_frequent():
    c = Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        c.union(a, b)
    assert c.members() == [["a", "b", "c", "d"], ["x", "y"]]
    assert rewriting(c.members(), {"c": 3, "y": 1}) == {"a": "c", "b": "c", "d": "c", "x": "y"}
    assert rewriting([["ﬁ", "fi"], ["f", "ｆ"]], {}) == {"ﬁ": "fi", "ｆ": "f"}


def test_pairs(spark, form):
    texts = ["port", "рort", "port", "Port", "", None, "  ", "　 ", "a b", "a b", "рοrt", "x" * 50000 + "é", "x" * 50000 + "é"]
    rows = [(i, t, "n") for i, t in enumerate(texts)]
    expected = {(i, j) for i, a, _ in rows for j, b, _ in rows if i < j and a and b and a.strip() and b.strip() and a != b and form(a) == form(b)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, look string")
    got = [tuple(r) for r in look_alike_pairs(docs).collect()]
    assert set(got) == expected and len(got) == len(expected)
    classes = {r["doc_id"]: r["class_id"] for r in look_alike_classes_of(docs).collect()}
    assert classes == {0: 0, 1: 0, 2: 0, 3: 3, 8: 8, 9: 8, 10: 0, 11: 11, 12: 11}
    assert look_alike_pairs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("a, b", [("a․b…", "a.b..."), ("a‥", "a.."), ("‥․", "…"), ("паӏ", "паl"), ("ɡo", "go"), ("itʼs", "it’s"), ("1⁄2", "1/2"), ("1∕2", "1/2")])
def test_dot_leaders_and_more_shapes(a, b):
    rewriter = Rewriter(rewriting(look_alike_classes(), {}))
    assert rewriter.canonical(a) == rewriter.canonical(b)
