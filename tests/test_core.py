"""Configuration messages, strict records, skew-safe joins, components, registered queries."""

import random
import shutil

import pytest

from loomline import config
from loomline.errors import ConfigError, PipelineError
from loomline.operators.graph import connected_components
from loomline.operators.skew import blocked_pairs, hot_aware_lookup
from loomline.sources.strict_records import failed_records, load_valid, reason_of

BASE = {
    "name": "x", "source": {"type": "file", "format": "csv", "path": "a.csv"}, "sink": {"type": "console"}, "transforms": [],
}


def text(**changes):
    parts = {k: (dict(v) if isinstance(v, dict) else v) for k, v in BASE.items()} | changes
    out = [f"name: {parts['name']}"] if parts["name"] is not None else []
    for section in ("source", "sink", "checkpoint", "errorPolicy"):
        if parts.get(section) is not None:
            out += [f"{section}:", *(f"  {k}: {v}" for k, v in parts[section].items())]
    if parts["transforms"]:
        out.append("transforms:")
        for t in parts["transforms"]:
            lines = [f"{k}: {v}" for k, v in t.items()]
            out += [f"  - {lines[0]}", *(f"    {line}" for line in lines[1:])]
    return "\n".join(out) + "\n"


FILE, CSV = {"type": "file"}, {"type": "file", "format": "csv", "path": "a.csv"}
S3 = {"type": "file", "format": "csv", "path": "s3://b/k.csv", "endpoint": "e", "region": "r", "accessKeyEnv": "A", "secretKeyEnv": "S"}
PG = {"type": "postgres", "url": "jdbc:postgresql://h/d", "userEnv": "U", "passwordEnv": "P", "query": "select 1"}
QDRANT = {"type": "qdrant", "url": "http://q", "collection": "c", "idField": "id", "vectorField": "v"}


def t(**settings):
    return {"transforms": [settings]}


@pytest.mark.parametrize(
    "changes, message",
    [
        ({"name": None}, "Missing required field: name"), ({"source": None}, "Missing required field: source"), ({"sink": None}, "Missing required field: sink"),
        ({"source": {"format": "csv"}}, "Missing required field: source.type"), ({"source": {"type": "kafka"}}, "Unsupported source.type: kafka"), ({"sink": {"type": "kafka"}}, "Unsupported sink.type: kafka"),
        ({"source": {"type": "document-directory"}}, "source.type document-directory has been replaced by source.type: file with format: document"),
        ({"source": {"type": "s3"}}, "source.type s3 has been replaced by source.type: file with an s3:// path"),
        ({"source": FILE}, "Missing required field: source.path"), ({"source": CSV | {"format": "xml"}}, "Unsupported source.format: xml"),
        ({"source": CSV | {"path": "hdfs://a"}}, "source.path storage scheme hdfs:// is not yet supported"), ({"source": CSV | {"path": "GS://a"}}, "source.path storage scheme gs:// is not supported"),
        ({"source": CSV | {"bucket": "b"}}, "source.bucket is only supported for s3:// paths"), ({"source": S3 | {"bucket": "b"}}, "source.bucket is not supported for source.type: file; put the bucket in the s3:// path"),
        ({"source": S3 | {"prefix": "b"}}, "source.prefix is not supported for source.type: file; put the prefix in the s3:// path"), ({"source": S3 | {"pathStyleAccess": "maybe"}}, "Unsupported source.pathStyleAccess: maybe"),
        ({"source": CSV | {"documentType": "pdf"}}, "source.documentType is only supported for source.format: document"), ({"source": CSV | {"format": "document", "documentType": "doc"}}, "Unsupported source.documentType: doc"),
        ({"source": CSV | {"format": "document", "maxRowsPerSplit": 4}}, "source.maxRowsPerSplit is only supported for file formats csv and jsonl"), ({"source": CSV | {"maxRowsPerSplit": 0}}, "Invalid source.maxRowsPerSplit: 0"),
        ({"source": CSV | {"url": "x"}}, "source.url is only supported for JDBC source types"), ({"source": CSV | {"query": "x"}}, "source.query is only supported for JDBC source types"), ({"source": CSV | {"fetchSize": 5}}, "source.fetchSize is only supported for JDBC source types"),
        ({"source": PG | {"path": "x"}}, "source.path is only supported for local source types"), ({"source": PG | {"format": "csv"}}, "source.format is only supported for source.type: file"),
        ({"source": PG | {"url": "jdbc:mysql://h"}}, "source.url for source.type postgres must start with jdbc:postgresql:"), ({"source": PG | {"fetchSize": "many"}}, "Invalid source.fetchSize: many"),
        ({"source": {"type": "duckdb", "query": "select 1", "userEnv": "U"}}, "source.userEnv is not supported for source.type: duckdb"), ({"source": {"type": "duckdb"}}, "Missing required field: source.query"),
        ({"source": {"type": "duckdb", "query": "q", "url": "jdbc:x"}}, "source.url for source.type duckdb must start with jdbc:duckdb:"),
        ({"sink": {"type": "file"}}, "Missing required field: sink.path"), ({"sink": {"type": "file", "path": "o", "format": "xml"}}, "Unsupported sink.format: xml"), ({"sink": {"type": "file", "path": "o", "format": "csv", "mode": "merge"}}, "Unsupported sink.mode: merge"),
        ({"sink": {"type": "console", "timeoutMs": 5}}, "sink.timeoutMs is only supported for sink.type: qdrant, pgvector, or milvus"), ({"sink": {"type": "console", "payloadFields": "[a]"}}, "sink.payloadFields is only supported for sink.type: qdrant, pgvector, or milvus"),
        ({"sink": QDRANT | {"payloadFields": "[a, a]"}}, "Duplicate value in sink.payloadFields: a"), ({"sink": QDRANT | {"payloadFields": "[v]"}}, "sink.payloadFields must not include sink.vectorField: v"),
        ({"sink": QDRANT | {"timeoutMs": -1}}, "Invalid sink.timeoutMs: -1"), ({"sink": QDRANT | {"chunkIdMultiplier": 5}}, "sink.chunkIdMultiplier requires sink.chunkIndexField"), ({"sink": QDRANT | {"wait": "no"}}, "Unsupported sink.wait: no"),
        ({"errorPolicy": {"mode": "ignore"}}, "Unsupported errorPolicy.mode: ignore"), (t(type="sort"), "Unsupported transform.type: sort"), (t(type="select"), "Missing required field: transforms[0].fields"),
        (t(type="filter", field="a", op="like"), "Unsupported transforms[0].op: like"), (t(type="filter", field="a", op="equals"), "Missing required field: transforms[0].value"), (t(type="filter", field="a", op="less-than", value="x"), "Invalid transform.value: x"),
        (t(type="filter", field="a", op="min-length", minLength="-1"), "Invalid transform.minLength: -1"), (t(type="chunk", input="a", output="b", chunkSize=0), "Invalid transform.chunkSize: 0"), (t(type="chunk", input="a", output="b", chunkSize=3, overlap=-1), "Invalid transform.overlap: -1"),
        (t(type="chunk", input="a", output="b", chunkSize=3, overlap=3), "transform.overlap must be smaller than transform.chunkSize"), (t(type="chunk", input="a", output="b", chunkSize=3, dropInput="yes"), "Invalid transform.dropInput: yes"),
        (t(type="chunk", input="a", output="b", chunkSize=3, includeOffsets="1"), "Invalid transform.includeOffsets: 1"), (t(type="embedding", input="a", output="b", provider="x"), "Unsupported transforms[0].provider: x"),
        (t(type="mock-embedding", input="a", output="b", dimensions=0), "Invalid transform.dimensions: 0"), (t(type="mock-embedding", input="a", output="b", batchSize="x"), "Invalid transform.batchSize: x"),
        (t(type="embedding", input="a", output="b", provider="openai-compatible", model="m", apiKeyEnv="K", timeoutMs=0), "Invalid transform.timeoutMs: 0"), (t(type="replace", field="a"), "Missing required field: transforms[0].target"),
    ],
)
def test_messages(changes, message):
    with pytest.raises(ConfigError) as e:
        config.loads(text(**changes))
    assert str(e.value) == message


def test_grammar(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text(
        "# comment\nname: 'quoted' \nname: \"last\"\nignored\n  stray: x\nsource:\n  type: file\n  path: a # not a comment\n  format: csv\n   maxRowsPerSplit: 5\ntransforms:\n"
        "  - type: select\n    fields: [a, 'b']\n  -type: x\n  - type: replace\n    field: a\n    target: \" \"\n    replacement: ''\nsink:\n  type: file\n  path: out/x.csv\n  format: jsonl\n"
    )
    p = config.load(path)
    assert p.name == "last" and p.source.path == f"{tmp_path}/a # not a comment" and p.source.max_rows_per_split == 5
    assert [x.type for x in p.transforms] == ["select", "replace"] and p.transforms[0].fields == ["a", "b"] and p.transforms[1].target == " "
    assert p.sink.path == f"{tmp_path}/out/x.csv" and p.sink.mode == "overwrite" and p.state_dir is None and not p.skip_bad_records
    with pytest.raises(ConfigError, match="Pipeline config not found"):
        config.load(tmp_path / "none.yaml")
    path.write_text(text(source=CSV | {"path": "../a.csv"}))
    with pytest.raises(ConfigError, match="Local path escapes allowed directories: source.path"):
        config.load(path, restricted=True)
    path.write_text(text(checkpoint={"stateDir": "/elsewhere"}))
    with pytest.raises(ConfigError, match="Local path escapes allowed directories: checkpoint.stateDir"):
        config.load(path, restricted=True)
    assert config.scheme_of("S3://a") == "s3" and config.scheme_of("://a") is None and config.scheme_of("a/b") is None


# Strict records ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "record, reason",
    [
        ("1,a", None), ("+7, a ", None), (" 7\t,a\r\n", None), ('1,"a,b"', None), ('1,"a\nb"', None), ('"1","a ""q"""', None), ('1,a "q" b', None), ("1,a\\b", None), ("-9223372036854775808,x", None), ("0" * 30 + "1,x", None), ('1,"a"\n', None),
        ('1,"a', "quoting"), ('1,"a"b', "quoting"), ('"1"x,a', "quoting"), ('1,a,"b', "quoting"), ('1,"a" ', "quoting"), ('"', "quoting"), ('1,"a"\n\n', "quoting"),
        ("1", "column_count"), ("1,a,b", "column_count"), ("", "column_count"), ("\n", "column_count"), (None, "column_count"), ("1;a", "column_count"), ("1,a,", "column_count"), ('"1,a"', "column_count"),
        ("x,a", "value"), ("1.0,a", "value"), (",a", "value"), ("1,", "value"), ("1, 　\n", "value"), ('1,""', "value"), ("1,a�", "value"), ("9223372036854775808,a", "value"), ("١,a", "value"), (" 1,a", "value"), ("+,a", "value"), ("1_0,a", "value"),
    ],
)
def test_reasons(record, reason):
    assert reason_of(record) == reason


def test_the_strict_load_and_the_diagnosis_agree(spark):
    rng = random.Random(5)
    parts = ['"', ",", "a", "1", " ", "\n", "\r", "\t", "+", "-", "�", "　", " ", "9223372036854775807", '""', "é"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(8000)] + ["1,a", "1,b"] * 50
    made += ['1,"' + '""' * 100000 + '"', '"' * 100001, "1," + "x" * 1000000, None]
    table = spark.createDataFrame([(i, r, "other") for i, r in enumerate(made)], "rec_id bigint, record string, reason string")
    expected = {i: reason_of(r) for i, r in enumerate(made)}
    loaded = {r["rec_id"]: (r["id"], r["name"]) for r in load_valid(table).collect()}
    assert set(loaded) == {i for i, r in expected.items() if r is None} and loaded[made.index("1,a")] == (1, "a")
    assert loaded[len(made) - 4] == (1, '"' * 100000)
    assert {r["rec_id"]: r["reason"] for r in failed_records(table).collect()} == {i: r for i, r in expected.items() if r}
    assert failed_records(table.limit(0)).count() == 0 and load_valid(table.limit(0)).count() == 0


# Joins, pairs, components --------------------------------------------------------------------


def test_hot_aware_lookup(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 7}", i) for i in range(70)] + [(None, 1), ("missing", 2), ("hot", 0)]
    facts = spark.createDataFrame(rows, "k string, i int")
    dim = spark.createDataFrame([("hot", 501, "H")] + [(f"k{i}", 10, f"v{i}") for i in range(7)] + [("unused", 0, "x")], "k string, n bigint, v string")
    expected = sorted((k, i, "H" if k == "hot" else "v" + k[1]) for k, i in rows if k and k != "missing")
    for rows_per_salt in (1 << 20, 20):
        got = hot_aware_lookup(facts, dim, "k", "n", rows_per_salt)
        assert got.columns == ["k", "i", "v"] and sorted(tuple(r) for r in got.collect()) == expected


@pytest.mark.parametrize("block", [2000, 7, 1])
def test_blocked_pairs(spark, block):
    groups = {"a": range(40), "b": [50, 51], "c": [60], None: [70, 71]}
    table = spark.createDataFrame([(k, i, i % 3) for k, v in groups.items() for i in v], "g string, i int, x int")
    got = [tuple(r) for r in blocked_pairs(table, "g", "i", block).select("i_a", "i_b").collect()]
    assert sorted(got) == [(i, j) for i in range(40) for j in range(i + 1, 40)] + [(50, 51)]


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(0, 0), (None, 3)] + [(500, i) for i in range(501, 560)]
    parent = list(range(1000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert len(got) == len(nodes) and {r["node"]: r["component"] for r in got} == {x: root(x) for x in nodes}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


# Registered queries --------------------------------------------------------------------------


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import os

    from loomline.plans.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    db = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            db.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    wrong = []
    for name in SQL:
        ours, theirs = QUERIES[name](spark, folder).toPandas(), db.sql(SQL[name]).df()
        ours, theirs = (x[sorted(x.columns)].astype(str) for x in (ours, theirs))
        if sorted(ours.columns) != sorted(theirs.columns) or sorted(map(tuple, ours.values)) != sorted(map(tuple, theirs.values)):
            wrong.append(name)
    assert not wrong


def test_nothing_outside_imports_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for path in [*root.glob("loomline/**/*.py"), *root.glob("*.py"), *root.glob("tests/*.py")]:
        if "llm" not in path.parts and path.name not in ("__spark_entry__.py", "test_core.py"):
            assert "loomline.llm" not in path.read_text(), path
    assert shutil.which("python") and PipelineError
