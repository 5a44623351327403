"""Formatting copies and near-duplicates against brute force."""

import random

import numpy as np
import pytest

from loomline.llm import near_duplicates as nd
from loomline.llm.format_copies import copies, copy_groups

RECORDS = [
    ("a", 1, "The Run, wrote: nothing"), ("a", 2, "the  run wrote nothing!"), ("a", 3, "the run wrote"), ("b", 4, "the run wrote nothing"), ("a", 5, None), ("a", 6, " ... "),
    ("a", 7, '{"Title": "One two", "note": "x"}'), ("a", 8, "note: X.\r\n\r\n title:one  TWO"), ("a", 9, '{"note":"one two","title":"x"}'), ("a", 10, '{"title": "One two", "note": 5}'),
    ("a", 11, "title: one two\nnote: x\nbroken line"), ("a", 12, "the run wrote nothing"), ("a", 13, '{"note": "x", "title": "one two"} tail'), ("a", 14, "origin id: x"), ("a", 15, "origin: id x"),
    ("a", 16, "ΤΙΣ γραμμές"), ("a", 17, "τις ΓΡΑΜΜΈΣ"), ("a", 18, "z" * 60000), ("a", 19, "Z" * 60000 + "."), ("a", 20, '{"a": "b", "a": "c"}'), ("a", 21, "a: c"), ("a", 22, ""), ("a", 23, "[" * 5000),
]


def test_copies(spark):
    table = spark.createDataFrame([(*r, 0) for r in RECORDS], "tbl string, id bigint, content string, n int")
    got = sorted(tuple(r) for r in copies(table).collect())
    assert got == [("a", 1, 2), ("a", 1, 12), ("a", 7, 8), ("a", 16, 17), ("a", 18, 19), ("a", 20, 21)]
    counts = {(r["tbl"], r["kept_id"]): r["n_rows"] for r in copy_groups(table).collect()}
    assert counts["a", 1] == 3 and counts["b", 4] == 1 and sum(counts.values()) == 19
    assert copies(table.limit(0)).count() == 0


def variants(rng, text, n):
    out = []
    for _ in range(n):
        words = text.split()
        for _ in range(rng.randint(0, max(1, len(words) // 5))):
            k = rng.randrange(len(words))
            if rng.random() < 0.3:
                words[k : k + 1] = []
            else:
                words[k] = "".join(rng.choice("abcdefgh") for _ in range(5))
            words = words or ["x"]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("words", [2, 6, 15, 40, 120])
def test_lists_of_every_size_find_similar_records(words):
    """Both tiers: pairs above the threshold share a run; the small ones by necessity."""
    rng, found, missed = random.Random(words), 0, 0
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(words))
        norm = ["".join(v.split()) for v in [text, *variants(rng, text, 8)]]
        norm = [t for t in norm if len(t) >= nd.GRAM]
        sets = [nd.gram_hashes(t) for t in norm]
        keys = [set(nd.run_keys(s[: nd.K], len(s)).tolist()) for s in sets]
        for i in range(len(norm)):
            for j in range(i):
                if nd.jaccard(norm[i], norm[j]) >= nd.THRESHOLD:
                    found += 1
                    missed += not keys[i] & keys[j]
                    assert nd.estimate(sets[i][: nd.ESTIMATE_K], sets[j][: nd.ESTIMATE_K]) >= nd.ESTIMATE_MIN
    assert found > 5 and missed <= (0 if words <= 6 else 0.01 * found)


@pytest.mark.parametrize("a, b, shared", [(400, 400, 331), (2000, 2000, 1648), (428, 300, 300), (100, 120, 91), (92, 92, 76)])
def test_long_records_at_the_threshold_share_a_list(a, b, shared):
    """5,000 pairs of sets with a similarity of 0.7 and little more: none is lost."""
    rng = np.random.default_rng(a + b)
    assert 0.7 <= shared / (a + b - shared) < 0.708
    for _ in range(5000):
        values = rng.integers(0, 1 << 32, a + b - shared, dtype=np.uint32)
        sets = [np.unique(v) for v in (values[:a], values[a - shared :])]
        x, y = (nd.run_keys(s[: nd.K], len(s)) for s in sets)
        assert np.intersect1d(x, y).size


def test_near_duplicates(spark):
    rng = random.Random(4)
    texts = []
    for k in range(25):
        base = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(rng.choice([2, 10, 50, 150])))
        texts += [base, base.upper() + " !", *variants(rng, base, 3)]
    texts += [None, "", "short", "1234567", "12345678", "1 2 3 4 5 6 7 8", "aaaaaaaaaa", "aaaaaaaaaaaaa", "é" * 30000, "é" * 30000 + "x"]
    norm = ["".join(c for c in (t or "").lower() if c.isalnum()) for t in texts]
    expected = {
        (i, j) for j in range(len(texts)) for i in range(j) if min(len(norm[i]), len(norm[j])) >= 8 and nd.jaccard(norm[i], norm[j]) >= 0.7
    }
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id bigint, content string, rep int")
    got = [tuple(r) for r in nd.near_duplicate_pairs(docs).collect()]
    assert len(got) == len(set(got)) and set(got) <= expected and len(got) >= 0.99 * len(expected)
    groups = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in nd.near_duplicate_groups(docs).collect()}
    assert all(groups[a][0] == groups[b][0] for a, b in got) and set(groups) == {i for i, t in enumerate(norm) if len(t) >= 8}
    assert nd.near_duplicate_pairs(docs.limit(0)).count() == 0 and nd.near_duplicate_groups(docs.limit(0)).count() == 0


def test_gram_hashes_are_of_sets():
    assert len(nd.gram_hashes("aaaaaaaaaaaa")) == 1
    text = "abcdefghijklmnopqrstuvwxyz🙂é"
    assert len(nd.gram_hashes(text)) == len(text) - 7
    assert np.array_equal(nd.gram_hashes(text + text)[:0], nd.gram_hashes("abcdefg"))


def test_contents_with_very_many_copies(spark):
    """Two similar contents of many copies each, and one content of 10^5 copies: every link, in many tasks, none of them far larger than the others."""
    from pyspark.sql import functions as F

    from loomline.operators.skew import expanded_pairs
    from loomline.plans.lineage import materialize

    text = "The ingestion pipeline of the northern archive reads every file twice before it writes a summary of the rows that it has skipped."
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(text)).otherwise(F.lit(text + " Again.")).alias("content"))
    assert nd.near_duplicate_pairs(docs).count() == 1200 * 1199 // 2
    many = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.when(F.col("id") % 3 == 0, "  ").otherwise("!")).alias("content"))
    groups = nd.near_duplicate_groups(many)
    assert groups.groupBy("group_id", "n_links").count().collect()[0][:] == (0, 99_999, 100_000)
    members = materialize(spark.range(5000).select((F.col("id") % 2).alias("rep"), F.col("id").alias("key")))
    pairs = materialize(spark.createDataFrame([(0, 1)], "a bigint, b bigint"))
    expanded = expanded_pairs(pairs, "a", "b", members, "rep", "key", 100)
    sizes = [r["count"] for r in expanded.repartition(8, "key_a", "key_b").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2500 * 2500 and expanded.distinct().count() == 2500 * 2500


def test_a_list_with_very_many_records(spark):
    """One passage in 10^4 records that are otherwise different makes one long list of candidates, and no wrong pair."""
    import random

    rnd = random.Random(4)
    passage = "all rights reserved by the northern archive"
    rows = [(i, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(160)) + passage) for i in range(10_000)] + [(10_000, passage + "x" * 3), (10_001, passage + "x" * 3 + "y")]
    found = nd.near_duplicate_pairs(spark.createDataFrame(rows, "doc_id bigint, content string")).collect()
    assert [tuple(r) for r in found] == [(10_000, 10_001)]


def test_one_form_with_very_many_spellings(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.lit("t").alias("tbl"), "id", F.concat(F.lit("One"), F.array_join(F.array_repeat(F.lit("."), (F.col("id") % 4000 + 1).cast("int")), ""), F.lit("two")).alias("content"))
    assert copy_groups(rows).collect()[0][:] == ("t", 0, 20_000)
