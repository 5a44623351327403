"""Shares within one document's size, caps, expectations, and no dependence on partitions' number for validity."""

import os
from collections import Counter

import pytest

from loomline.llm import mixing
from loomline.llm.mixing import Pivot, mix_sources, plan, transfer

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{mixing.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


def test_a_transfer_keeps_the_mass_and_settles_one():
    for pa, sa, pb, sb in ((0.3, 10, 0.6, 4), (0.5, 1, 0.5, 100), (0.9, 7, 0.8, 7)):
        for u in (0.0, 0.3, 0.7, 0.999):
            qa, qb = transfer(pa, sa, pb, sb, u)
            assert abs(qa * sa + qb * sb - pa * sa - pb * sb) < 1e-6
            assert {qa, qb} & {0.0, 1.0} and 0 <= qa <= 1 and 0 <= qb <= 1


def test_expectations_hold():
    hits = Counter()
    for seed in range(4000):
        pivot = Pivot(seed)
        for key, size, p in ((1, 5, 0.3), (2, 9, 0.3), (3, 2, 0.3), (4, 5, 0.3)):
            for k, _, uses in pivot.add(key, size, 0, p):
                hits[k] += uses
        if pivot.open:
            hits[pivot.open[0]] += pivot.open[3]
    assert all(abs(hits[k] / 4000 - 0.3) < 0.03 for k in (1, 2, 3, 4))


def test_plan_caps_copies():
    targets = [{"source": "a", "target_share": 0.5, "max_repeats": 3}, {"source": "b", "target_share": 0.5, "max_repeats": 1}, {"source": "none", "target_share": 0.0, "max_repeats": 2}]
    assert plan(targets, {"a": 100, "b": 900}) == {"a": (3, 0.0), "b": (0, 500 / 900), "none": (0, 0.0)}


@needs_vocabulary
@pytest.mark.parametrize("partitions, fan_in", [(1, 64), (13, 2)])
def test_shares(spark, partitions, fan_in):
    rows = [(i, "word " * (1 + i * 7 % 40), "big" if i % 3 else "small" if i % 2 else None) for i in range(400)]
    rows += [(1000, None, "big"), (1001, "", "small"), (1002, "other", "unlisted"), (1003, "last", "tiny")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, source string, n_tokens double").repartition(partitions)
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.65, 9), ("tiny", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats bigint")
    chosen, shares = mix_sources(docs, targets, fan_in=fan_in)
    got = {r["source"]: r for r in shares.collect()}
    largest = 50
    for source in ("big", "small"):
        assert abs(got[source]["actual_tokens"] - got[source]["target_tokens"]) <= largest
    assert got["tiny"]["actual_tokens"] == 2
    uses = {r["doc_id"]: (r["source"], r["uses"]) for r in chosen.collect()}
    assert len(uses) == chosen.count() and not {1000, 1001, 1002} & set(uses)
    assert uses[1003] == ("tiny", 2) and all(u <= {"big": 1, "small": 9, "tiny": 2}[s] for s, u in uses.values())
    assert {s for s, _ in uses.values()} == {"big", "small", "tiny"}


@needs_vocabulary
def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats bigint")
    chosen, shares = mix_sources(docs, targets)
    assert chosen.count() == 0 and [tuple(r) for r in shares.collect()] == [("a", 1.0, 0.0, 0, 0.0)]
