"""Every registered query over the smallest whole tables: columns, and rows where SQL or a library can tell."""

import os

import pytest

from loomline.llm.queries import QUERIES, SQL
from loomline.llm.tokenize import TOKENIZERS

COLUMNS = {
    "p1_found": ["id", "defect"], "p3_found": ["id_a", "id_b"], "p3_neighbours": ["id", "neighbour", "rank", "similarity"], "p4_found": ["doc_id_a", "doc_id_b"], "p4_groups": ["doc_id", "group_id", "n_links"],
    "p5_found": ["tbl", "kept_id", "copy_id"], "p5_groups": ["tbl", "kept_id", "n_rows"], "p6_ids": ["doc_id", "ids"], "p7_mix": ["doc_id", "source", "n_tokens", "uses"],
    "p7_shares": ["source", "target_share", "target_tokens", "actual_tokens", "actual_share"], "p7_balance": ["source", "within", "capped"], "p8_found": ["doc_id_a", "doc_id_b"], "p8_canonical": ["doc_id", "canonical"], "p8_classes": ["doc_id", "class_id", "n_forms", "n_rows"],
}


def test_all_queries_are_known():
    assert set(COLUMNS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, folder, name):
    if name[:2] in ("p6", "p7") and not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"):
        pytest.skip("no vocabulary files")
    df = QUERIES[name](spark, folder)
    assert df.columns == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    if name == "p6_ids":
        tokenizers = pytest.importorskip("tokenizers")
        t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
        t.encode_special_tokens = True
        texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
        assert {k: v for k, v in rows} == {k: t.encode(v, add_special_tokens=False).ids for k, v in texts.items()}
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and (name.startswith("p1") or all(r[-2] < r[-1] for r in rows))
    if name in SQL:
        duckdb = pytest.importorskip("duckdb")
        db = duckdb.connect()
        for file in os.listdir(folder):
            if file.endswith(".parquet"):
                db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
        found = db.sql(SQL[name]).df()[df.columns]
        assert sorted(rows) == sorted(map(tuple, found.values.tolist()))
