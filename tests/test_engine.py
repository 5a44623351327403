"""Pipelines from file to file: sources, transforms, sinks, error policy, checkpoints, jobs, command line."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from loomline import cli, config, sinks
from loomline.config import Sink, Source, Transform
from loomline.errors import ConfigError, PipelineError, StageError
from loomline.operators.transforms import Chain
from loomline.plans import runner, splits
from loomline.plans.jobs import Jobs, job_state, job_states, schedulable
from loomline.plans.state import Checkpoint, Store, Task
from loomline.schema import LONG, STRING, field, row_type
from loomline.sources import open_source

ROW = row_type([field("id", LONG), field("content", STRING)])


def apply(spark, rows, *transforms, schema=ROW):
    chain = Chain(list(transforms), schema)
    return [tuple(r) for r in chain(spark.createDataFrame(rows, schema)).collect()], chain.schema.fieldNames()


def pipeline(tmp_path, body):
    path = tmp_path / "pipeline.yaml"
    path.write_text(body)
    return config.load(path)


# Transforms ----------------------------------------------------------------------------------


def test_trim_takes_control_characters_and_spaces_only(spark):
    rows, _ = apply(spark, [(1, "  Alpha  "), (2, "\tBeta\n"), (3, "\u00a0x\u2003"), (4, None), (5, "\x00\x1f y \r")], Transform("trim", field="content"))
    assert [r[1] for r in rows] == ["Alpha", "Beta", "\u00a0x\u2003", None, "y"]
    with pytest.raises(PipelineError, match="Transform field must be STRING: id"):
        apply(spark, [], Transform("trim", field="id"))


def test_select_rename_replace_lowercase(spark):
    rows, names = apply(
        spark, [(1, "ALPHA"), (2, "alphabet")],
        Transform("lowercase", field="content"), Transform("replace", field="content", target="ph", replacement="f"),
        Transform("rename", source="content", target="text"), Transform("select", fields=["text", "id"]),
    )
    assert rows == [("alfa", 1), ("alfabet", 2)] and names == ["text", "id"]
    assert apply(spark, [(1, "aaa")], Transform("replace", field="content", target="aa", replacement="b"))[0] == [(1, "ba")]
    assert apply(spark, [(1, "a.b")], Transform("replace", field="content", target="."))[0] == [(1, "ab")]
    for bad, message in (
        (Transform("select", fields=["id", "id"]), "Duplicate transform field: id"),
        (Transform("select", fields=["x"]), "Unknown transform field: x"),
        (Transform("rename", source="id", target="content"), "Duplicate transform field: content"),
        (Transform("lowercase", field="ID"), "Unknown transform field: ID"),
        (Transform("nothing"), "Unsupported transform.type: nothing"),
    ):
        with pytest.raises(PipelineError, match=message):
            Chain([bad], ROW)


@pytest.mark.parametrize(
    "op, extra, kept",
    [
        ("not-empty", {}, [1, 2, 5]), ("min-length", {"min_length": 5}, [1, 5]), ("contains", {"value": "et"}, [2]), ("starts-with", {"value": "Al"}, [1]),
        ("ends-with", {"value": "a"}, [1, 2]), ("equals", {"value": "Beta"}, [2]), ("not-equals", {"value": "Beta"}, [1, 3, 4, 5]),
    ],
)
def test_text_filters(spark, op, extra, kept):
    data = [(1, "Alpha"), (2, "Beta"), (3, ""), (4, "   "), (5, " 😀😀b "), (6, None)]
    assert [r[0] for r in apply(spark, data, Transform("filter", field="content", op=op, **extra))[0]] == kept


@pytest.mark.parametrize("op, kept", [("greater-than", [3]), ("greater-than-or-equal", [2, 3]), ("less-than", [1]), ("less-than-or-equal", [1, 2])])
def test_number_filters(spark, op, kept):
    data = [(1, "a"), (2, "b"), (3, "c"), (None, "d")]
    assert [r[0] for r in apply(spark, data, Transform("filter", field="id", op=op, value="2"))[0]] == kept
    with pytest.raises(PipelineError, match="Transform field must be LONG: content"):
        Chain([Transform("filter", field="content", op=op, value="1")], ROW)


def windows(text, size, overlap):
    units, out, start = text.encode("utf-16-le"), [], 0
    n = len(units) // 2
    while n:
        end = min(start + size, n)
        out.append((units[2 * start : 2 * end].decode("utf-16-le", "surrogatepass"), start, end))
        if end == n:
            break
        start += size - overlap
    return [("".join("?" if 0xD800 <= ord(c) < 0xE000 else c for c in t), a, b) for t, a, b in out]


@pytest.mark.parametrize("size, overlap", [(5, 1), (3, 0), (4, 3), (1, 0), (50, 10)])
def test_chunk(spark, size, overlap):
    data = [(7, "abcdefghij"), (8, ""), (9, None), (10, "x😀y😀zw"), (11, "ab"), (12, "é" * 13)]
    step = Transform("chunk", input="content", output="chunk", chunk_size=size, overlap=overlap, drop_input=True, include_offsets=True)
    rows, names = apply(spark, data, step)
    assert names == ["id", "chunk", "chunk_index", "chunk_start", "chunk_end"]
    assert rows == [(i, t, k, a, b) for i, text in data if text for k, (t, a, b) in enumerate(windows(text, size, overlap))]


def test_chunk_collisions():
    for bad, message in ((Transform("chunk", input="content", output="content", chunk_size=2), "content"), (Transform("chunk", input="content", output="chunk_index", chunk_size=2), "chunk_index")):
        with pytest.raises(PipelineError, match=f"Duplicate transform field: {message}"):
            Chain([bad], ROW)
    chain = Chain([Transform("chunk", input="content", output="content", chunk_size=2, drop_input=True)], ROW)
    assert chain.schema.fieldNames() == ["id", "content", "chunk_index"]


def test_embeddings_and_batch_size(spark):
    rows, _ = apply(spark, [(1, "Alpha")], Transform("mock-embedding", input="content", output="v", dimensions=4))
    assert rows[0][2] == [5.0, 6.0, 7.0, 8.0]
    assert Chain([], ROW).batch_size == 1
    assert Chain([Transform("mock-embedding", input="content", output="v", batch_size=7), Transform("embedding", input="content", output="w", batch_size=3)], ROW).batch_size == 3


class Server:
    """Answers requests with ``reply(path, body)`` -> (status, text) and keeps them."""

    def __init__(self, reply):
        seen = self.seen = []

        class Handler(BaseHTTPRequestHandler):
            def _any(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                seen.append((self.command, self.path, body, dict(self.headers)))
                status, text = reply(self.path, body)
                self.send_response(status)
                self.end_headers()
                self.wfile.write(text.encode())

            do_POST = do_PUT = _any

            def log_message(self, *_):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def test_http_embedding(spark, monkeypatch):
    monkeypatch.setenv("TEST_KEY", "k")

    def reply(path, body):
        return 200, json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1]} for i, t in reversed(list(enumerate(body["input"])))]})

    server = Server(reply)
    step = Transform("embedding", input="content", output="v", provider="openai-compatible", base_url=server.url, model="m", key_env="TEST_KEY", batch_size=2)
    rows, _ = apply(spark, [(i, "x" * i) for i in range(1, 6)], step)
    assert [r[2] for r in rows] == [[float(i), 1.0] for i in range(1, 6)]
    assert all(len(b["input"]) <= 2 and b["model"] == "m" and b["encoding_format"] == "float" for _, _, b, _ in server.seen)
    from loomline.operators.embedding import HttpProvider

    for text, message in (
        ('{"data": []}', "returned 0 embeddings but expected 1"), ('{"data": [{"index": 4, "embedding": [1]}]}', "index out of range: 4"),
        ('{"x": 1}', "did not contain"), ('{"data": [{"embedding": ["a"]}]}', "Invalid embedding value: a"),
    ):
        with pytest.raises(PipelineError, match=message):
            HttpProvider.vectors(text, 1)
    with pytest.raises(PipelineError, match="duplicate embedding index: 0"):
        HttpProvider.vectors('{"data": [{"index": 0, "embedding": [1]}, {"index": 0, "embedding": [1]}]}', 2)


# Sources -------------------------------------------------------------------------------------


def records(spark, source):
    rows = open_source(spark, source)
    return [tuple(r) for r in rows.df.orderBy("_seq").collect()], rows.schema


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id, content \n1,"Alpha, ""Beta""\nNext"\n\n2,Gamma\n 3 ,\nx,y\n5\n6,a,b\n')
    rows, schema = records(spark, Source("file", str(path), "csv"))
    assert schema.fieldNames() == ["id", "content"]
    assert rows == [
        (1, None, 1, 'Alpha, "Beta"\nNext'), (2, None, 2, "Gamma"), (3, None, 3, ""), (4, "Invalid CSV row at line 5: field id is not a long", None, "y"),
        (5, "Invalid CSV row at line 6: expected 2 columns but found 1", 5, ""), (6, "Invalid CSV row at line 7: expected 2 columns but found 3", 6, "a"),
    ]
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(PipelineError, match="CSV file is empty: "):
        records(spark, Source("file", str(tmp_path / "e.csv"), "csv"))
    with pytest.raises(PipelineError, match="Source file not found: "):
        records(spark, Source("file", str(tmp_path / "none.csv"), "csv"))


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    lines = [
        "", '{"id": 1, "content": "A", "n": 5}', '{"n": 6, "id": "7", "content": true}', '{"id": 2, "content": "x"', '{"id": 2, "content": "x", "n": 1, "z": 1}',
        '{"id": 2, "n": 1}', '{"id": 2, "content": {"t": 1}, "n": 1}', '{"id": 2, "content": null, "n": 1}', '{"id": 2, "content": "x", "n": 1.5}', '{"id": 3, "content": "{\\"t\\": 1}", "n": 1}', "[1]",
    ]
    path.write_bytes("\n".join(lines).encode() + b'\n{"id": 4, "content": "a\xffb", "n": 0}\n')
    rows, schema = records(spark, Source("file", str(path), "jsonl"))
    assert [(f.name, f.dataType) for f in schema] == [("id", LONG), ("content", STRING), ("n", LONG)]
    good = [r for r in rows if r[1] is None]
    assert [(r[0], *r[2:]) for r in good] == [(1, 1, "A", 5), (2, 7, "true", 6), (9, 3, '{"t": 1}', 1), (11, 4, "a\ufffdb", 0)]
    where = "Invalid JSONL row at line "
    assert [r[1] for r in rows if r[1]] == [
        where + "4: malformed JSON", where + "5: unexpected field z", where + "6: missing field content", where + "7: field content must be a scalar value",
        where + "8: field content must not be null", where + "9: field n is not a long", where + "11: expected JSON object",
    ]
    (tmp_path / "b.jsonl").write_text('{"id": 1, "content": {}}\n')
    with pytest.raises(PipelineError, match="line 1: field content must be a scalar value"):
        records(spark, Source("file", str(tmp_path / "b.jsonl"), "jsonl"))


PDF = b"%PDF-1.4\n1 0 obj<</Type/Page/Contents 2 0 R>>endobj\n2 0 obj<</Length 60>>stream\nBT /F1 12 Tf (Hello) Tj 0 -14 Td (World) Tj ET\nendstream endobj\ntrailer<<>>\n%%EOF\n"


def test_documents(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "b").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"one\xff")
    (root / "b" / "_c.MD").write_text("two")
    (root / "x.pdf").write_bytes(PDF)
    (root / "bad.pdf").write_bytes(b"nothing")
    (root / "skip.bin").write_text("?")
    rows, _ = records(spark, Source("file", str(root), "document"))
    assert [r[3] for r in rows] == ["a.txt", "b/_c.MD", "bad.pdf", "x.pdf"]
    assert [r[4] for r in rows if r[1] is None] == ["one\ufffd", "two", "Hello\nWorld\n"]
    assert rows[2][1].startswith("Document source read failed at bad.pdf: ")
    with pytest.raises(PipelineError, match=r"no supported documents: .* \(documentType: pdf\)"):
        records(spark, Source("file", str(root / "b"), "document", "pdf"))
    assert records(spark, Source("file", str(root / "a.txt"), "document"))[0][0][3] == "a.txt"


def test_sql_source(spark, tmp_path):
    spark.createDataFrame([(1, 2.5, "a"), (2, None, None)], "k int, v double, s string").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    query = f"select k, s, count(*) over () as n, v from read_parquet('{tmp_path}/t.parquet') order by k"
    rows, schema = records(spark, Source("duckdb", query=query))
    assert [f.dataType for f in schema] == [LONG, STRING, LONG, STRING]
    assert rows == [(1, None, 1, "a", 2, "2.5"), (2, None, 2, "", 2, "")]
    rows, _ = records(spark, Source("duckdb", query="select cast(null as int) as k"))
    assert rows[0][1] == "Invalid DuckDB row seq=1: field k is null"
    with pytest.raises(PipelineError, match="DuckDB source query failed: "):
        records(spark, Source("duckdb", query="select nothing from nowhere"))


# Pipelines -----------------------------------------------------------------------------------

COPY = """name: {name}
source:
  type: file
  format: csv
  path: in.csv
{more}sink:
  type: file
  format: {form}
  path: out/result.{form}
{end}"""


def test_select_and_rename_to_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,Alice\n2,Bob\n")
    p = pipeline(tmp_path, COPY.format(name="t", form="csv", end="", more="transforms:\n  - type: select\n    fields: [id, name]\n  - type: rename\n    from: name\n    to: user_name\n"))
    done = runner.run(spark, p, lambda _: None)
    assert (tmp_path / "out/result.csv").read_text() == "id,user_name\n1,Alice\n2,Bob\n"
    assert (done.rowsRead, done.rowsWritten, done.sourceSplits, done.sinkBatches, done.checkpointSeq, done.taskState) == (2, 2, 1, 2, 2, "COMPLETED")


def test_quoting_and_json_lines(spark, tmp_path):
    text = 'id,content\n1,"Alpha, ""Beta""\nNext"\n2,Gamma\n'
    (tmp_path / "in.csv").write_text(text)
    runner.run(spark, pipeline(tmp_path, COPY.format(name="t", form="csv", end="", more="")), lambda _: None)
    assert (tmp_path / "out/result.csv").read_text() == text
    (tmp_path / "in.csv").write_text('id,content\n7,"Alpha, ""Beta""\nNext\tLine \\b \x08 \x0c \\"\n')
    runner.run(spark, pipeline(tmp_path, COPY.format(name="t", form="jsonl", end="", more="transforms:\n  - type: mock-embedding\n    input: content\n    output: v\n    dimensions: 1\n")), lambda _: None)
    line = (tmp_path / "out/result.jsonl").read_text()
    assert line == '{"id":7,"content":"Alpha, \\"Beta\\"\\nNext\\tLine \\\\b \\u0008 \\u000c \\\\","v":[32.0]}\n'


def test_error_policy(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,Alice\n2\n3,Carol\n")
    shown = []
    with pytest.raises(StageError, match="Source stage failed: Invalid CSV row at line 3: expected 2 columns but found 1"):
        runner.run(spark, pipeline(tmp_path, COPY.format(name="t", form="csv", end="", more="")), shown.append)
    assert (tmp_path / "out/result.csv").read_text() == "id,name\n1,Alice\n"
    done = runner.run(spark, pipeline(tmp_path, COPY.format(name="t", form="csv", end="errorPolicy:\n  mode: skip-bad-records\n", more="")), shown.append)
    assert "Skipped bad record seq=2 error=Invalid CSV row at line 3: expected 2 columns but found 1" in shown
    assert (tmp_path / "out/result.csv").read_text() == "id,name\n1,Alice\n3,Carol\n"
    assert (done.rowsRead, done.rowsWritten, done.rowsFailed) == (3, 2, 1)


class Flaky:
    """Fails at the second batch of the first run."""

    batches, runs = [], 0

    def __init__(self, *_):
        Flaky.runs += 1
        self.mine = 0

    def open(self): ...
    def close(self): ...

    def write(self, rows, last_seq):
        self.mine += 1
        if Flaky.runs == 1 and self.mine == 2:
            raise RuntimeError("sink batch failed")
        Flaky.batches.append([r["id"] for r in rows])


def test_resume_after_a_failed_batch(spark, tmp_path):
    sinks.register("flaky", Flaky)
    (tmp_path / "in.csv").write_text("id,content\n" + "".join(f"{i},x\n" for i in range(1, 6)))
    step = Transform("mock-embedding", input="content", output="v", batch_size=2)
    p = config.Pipeline("resume", Source("file", str(tmp_path / "in.csv"), "csv", max_rows_per_split=2), [step], Sink("flaky"), str(tmp_path / "state"))
    with pytest.raises(StageError, match="^Sink stage failed: sink batch failed$"):
        runner.run(spark, p, lambda _: None)
    task = Checkpoint(str(tmp_path / "state"), "resume").task
    assert (task.state, task.checkpoint) == ("RUNNING", 2)
    done = runner.run(spark, p, lambda _: None)
    assert Flaky.batches == [[1, 2], [3, 4], [5]]
    assert (done.rowsWritten, done.rowsSkipped, done.checkpointSeq, done.taskState, done.sourceSplits) == (3, 2, 5, "COMPLETED", 3)
    again = runner.run(spark, p, lambda _: None)
    assert (again.rowsRead, again.checkpointSeq, again.taskState) == (0, 5, "COMPLETED")


def test_file_sink_is_exactly_once_after_a_rewind(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,content\n" + "".join(f"{i},x\n" for i in range(1, 7)))
    p = pipeline(tmp_path, COPY.format(name="once", form="csv", end=f"checkpoint:\n  stateDir: {tmp_path}/state\n", more=""))
    runner.run(spark, p, lambda _: None)
    store = Store(f"{tmp_path}/state")
    task = store.get("local-pipeline-once")
    store.put("local-pipeline-once", Task(task.task_id, state="RUNNING", attempt=1, checkpoint=3, version=9))
    runner.run(spark, p, lambda _: None)
    assert (tmp_path / "out/result.csv").read_text() == "id,content\n" + "".join(f"{i},x\n" for i in range(1, 7))


def test_batches_and_empty_flushes(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": 1, "content": "abcdefghij"}\n')
    steps = [Transform("chunk", input="content", output="chunk", chunk_size=5, overlap=1), Transform("mock-embedding", input="chunk", output="v", batch_size=32)]
    sinks.register("kept", lambda *_: Kept())
    p = config.Pipeline("c", Source("file", str(tmp_path / "in.jsonl"), "jsonl"), steps, Sink("kept"), str(tmp_path / "state"))
    done = runner.run(spark, p, lambda _: None)
    assert (done.rowsRead, done.rowsWritten, done.sinkBatches, done.checkpointSeq) == (1, 3, 1, 1)
    nothing = [Transform("filter", field="content", op="equals", value="no")]
    done = runner.run(spark, config.Pipeline("d", p.source, nothing, p.sink, str(tmp_path / "state")), lambda _: None)
    assert (done.rowsRead, done.rowsWritten, done.sinkBatches, done.checkpointSeq) == (1, 0, 0, 1)


class Kept:
    def open(self): ...
    def close(self): ...
    def write(self, rows, last_seq): ...


def test_console_and_mock_vector(spark, tmp_path):
    shown = []
    assert cli.main(["local-demo"], shown.append, spark) == 0
    assert shown[0] == "[Row] id=1, name=User-1" and len(shown) == 10
    shown.clear()
    assert cli.main(["ai-demo"], shown.append, spark) == 0
    assert shown[0] == "[AI Sink] Row ID: 1, Vector Dim: 4, First Val: 10.0000"


# Vector stores -------------------------------------------------------------------------------


def vector_pipeline(tmp_path, sink, step=None):
    (tmp_path / "in.csv").write_text("id,content\n7,Alpha\n8,Be\n")
    steps = [*([step] if step else []), Transform("mock-embedding", input="content", output="v", dimensions=2, batch_size=2)]
    return config.Pipeline("v", Source("file", str(tmp_path / "in.csv"), "csv"), steps, sink)


def test_qdrant(spark, tmp_path, monkeypatch):
    server = Server(lambda path, body: (200, '{"status":"ok"}'))
    sink = Sink("qdrant", url=server.url, collection="a b", id_field="id", vector_field="v", timeout_ms=5000)
    done = runner.run(spark, vector_pipeline(tmp_path, sink), lambda _: None)
    assert done.rowsWritten == 2
    points = sorted((p for _, _, b, _ in server.seen for p in b["points"]), key=lambda p: p["id"])
    assert points[0] == {"id": 7, "vector": [5.0, 6.0], "payload": {"id": 7, "content": "Alpha"}}
    assert server.seen[0][:2] == ("PUT", "/collections/a%20b/points?wait=true")
    chunked = Sink("qdrant", url=server.url, collection="c", id_field="id", vector_field="v", chunk_index_field="chunk_index", chunk_id_multiplier=1000)
    server.seen.clear()
    step = Transform("chunk", input="content", output="content", chunk_size=3, drop_input=True)
    runner.run(spark, vector_pipeline(tmp_path, chunked, step), lambda _: None)
    assert sorted(p["id"] for _, _, b, _ in server.seen for p in b["points"]) == [7000, 7001, 8000]
    failing = Server(lambda path, body: (500, "broken"))
    with pytest.raises(StageError, match="Sink stage failed: Qdrant upsert failed with status 500: broken"):
        runner.run(spark, vector_pipeline(tmp_path, Sink("qdrant", url=failing.url, collection="c", id_field="id", vector_field="v")), lambda _: None)
    over = Sink("qdrant", url=server.url, collection="c", id_field="id", vector_field="v", chunk_index_field="chunk_index", chunk_id_multiplier=2**63 - 1)
    with pytest.raises(StageError, match="Qdrant generated point id overflow for id 7 and chunk index 0"):
        runner.run(spark, vector_pipeline(tmp_path, over, step), lambda _: None)
    with pytest.raises(StageError, match="Qdrant sink requires VECTOR field: content"):
        runner.run(spark, vector_pipeline(tmp_path, Sink("qdrant", url="x", collection="c", id_field="id", vector_field="content")), lambda _: None)


def test_milvus(spark, tmp_path):
    server = Server(lambda path, body: (200, '{"code":0}'))
    sink = Sink("milvus", url=server.url, collection="c", id_field="id", vector_field="v")
    runner.run(spark, vector_pipeline(tmp_path, sink), lambda _: None)
    assert server.seen[0][1] == "/v2/vectordb/entities/upsert"
    data = sorted((d for _, _, b, _ in server.seen for d in b["data"]), key=lambda d: d["id"])
    assert data[0] == {"id": 7, "v": [5.0, 6.0], "content": "Alpha"}


def test_pgvector_sql(monkeypatch):
    from loomline.sinks.vector import _Pgvector, upsert_sql

    sink = Sink("pgvector", table="document_vectors", id_field="id", vector_field="embedding")
    sql = upsert_sql(sink, ["content"])
    assert sql == "INSERT INTO document_vectors (id, embedding, content) VALUES (?, ?::vector, ?) ON CONFLICT (id) DO UPDATE SET embedding = EXCLUDED.embedding, content = EXCLUDED.content"
    calls = []

    class Connection:
        def cursor(self):
            return self

        def executemany(self, *a):
            calls.append(a)

        def commit(self):
            calls.append("commit")

        def close(self):
            calls.append("close")

    _Pgvector(lambda *a: Connection(), ("u", "a", "b", 1), sql, ["content"])([{"_point_id": 7, "_vector": [1.0, 2.5], "content": "x"}])
    assert calls == [(sql, [(7, "[1.0,2.5]", "x")]), "commit", "close"]


# Planning, state, jobs -----------------------------------------------------------------------


def test_first_records_of_any_length(spark, tmp_path):
    long = "x" * 1_500_000
    for name, first in (("long", long), ("marks", "a\u2028b\u2029c\x85d")):
        (tmp_path / f"{name}.jsonl").write_bytes(f'\n{{"id":1,"content":"{first}"}}\r\n{{"id":2,"content":"y"}}\n'.encode())
        rows, schema = records(spark, Source("file", str(tmp_path / f"{name}.jsonl"), "jsonl"))
        assert schema.names == ["id", "content"] and [r[1:] for r in rows] == [(None, 1, first), (None, 2, "y")]
    (tmp_path / "long.csv").write_text(f"id,content,{long}\n1,{long},\n2,{'z' * 140_000}\n3,y,\n")
    rows, schema = records(spark, Source("file", str(tmp_path / "long.csv"), "csv"))
    assert schema.names == ["id", "content", long] and rows[0][3] == long and [r[1] for r in rows] == [None, "Invalid CSV row at line 3: expected 3 columns but found 2", None]


@pytest.mark.parametrize("rows", [0, 300, 1200, 4700])
def test_split_queries_plan_over_all_rows(spark, tmp_path, rows):
    from loomline.plans import queries

    spark.range(1, rows + 1).selectExpr("id AS rec_id", "id AS line_no").write.parquet(f"{tmp_path}/input_records.parquet")
    got = {r["rec_id"]: r["split"] for r in queries.s15_split_ranges(spark, str(tmp_path)).collect()}
    assert got == {i: f"file-part-{(i - 1) // 500}" for i in range(1, rows + 1)}


def test_splits_and_bundles():
    planned = splits.plan("file", 25, 10)
    assert [(s.id, s.start, s.end) for s in planned] == [("file-part-0", 1, 10), ("file-part-1", 11, 20), ("file-part-2", 21, 25)]
    assert [[s.id[-1] for s in b] for b in splits.bundles(planned, 2)] == [["0", "1"], ["2"]]
    assert splits.plan("file", 0, 10)[0].id == "file-0"


def test_runs_of_numbers(spark):
    edge = splits.BUCKET
    data = [(i,) for i in [1, 2, 3, 7, 7, edge - 2, edge - 1, edge, edge + 1, edge + 5, None]]
    found = sorted(tuple(r) for r in splits.runs(spark.createDataFrame(data, "n bigint"), "n").collect())
    assert found == [(1, 3, 3), (7, 7, 1), (edge - 2, edge + 1, 4), (edge + 5, edge + 5, 1)]


def test_job_states(spark):
    cases = {"a": ["COMPLETED"] * 2, "b": ["COMPLETED", "FAILED"], "c": ["FAILED", "CANCELLED"], "d": ["COMPLETED", "RUNNING"], "e": ["COMPLETED", None]}
    expected = {"a": "COMPLETED", "b": "FINISHED_WITH_ERRORS", "c": "FAILED", "d": None, "e": None}
    assert {k: job_state(v) for k, v in cases.items()} == expected and job_state([]) is None
    table = spark.createDataFrame([(k, s) for k, v in cases.items() for s in v], "job_id string, state string")
    assert {r["job_id"]: r["state"] for r in job_states(table).collect()} == expected


def test_jobs(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,content\n" + "".join(f"{i},x\n" for i in range(1, 8)))
    seen, lock = [], threading.Lock()

    class Once:
        failed = set()

        def __init__(self, *_): ...
        def open(self): ...
        def close(self): ...

        def write(self, rows, last_seq):
            with lock:
                if rows[0]["id"] == 4 and len(Once.failed) < 2:
                    Once.failed.add(len(Once.failed))
                    raise RuntimeError("not yet")
                seen.extend(r["id"] for r in rows)

    sinks.register("once", Once)
    p = config.Pipeline("job", Source("file", str(tmp_path / "in.csv"), "csv", max_rows_per_split=3), [], Sink("once"))
    jobs = Jobs(spark, str(tmp_path / "state"))
    job = jobs.submit(p, 3)
    assert len(jobs.tasks(job)) == 3 and jobs.status(job) is None
    assert jobs.run(job, p) == "COMPLETED" and sorted(seen) == list(range(1, 8))
    assert [t.attempt for t in jobs.tasks(job)] == [1, 3, 1]
    bad = config.Pipeline("bad", p.source, [Transform("trim", field="nothing")], Sink("once"))
    job = jobs.submit(bad, 2)
    assert jobs.run(job, bad) == "FAILED" and {t.error_code for t in jobs.failed(job)} == {"PERMANENT"}
    assert len(jobs.tasks(jobs.rerun_failed(job))) == 2
    assert [t.task_id for t in schedulable([Task("b"), Task("a", state="RUNNING"), Task("c", state="RUNNING")], {"a"})] == ["a", "b"]


def test_state_is_versioned(tmp_path):
    store = Store(str(tmp_path))
    store.put("a/b", Task("a/b"), -1)
    with pytest.raises(PipelineError, match="has changed"):
        store.put("a/b", Task("a/b"), 5)
    with pytest.raises(PipelineError, match="Illegal task transition: CREATED -> COMPLETED"):
        Task("x").to("COMPLETED")


def test_command_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,Alice\n")
    path = tmp_path / "p.yaml"
    path.write_text(COPY.format(name="t", form="csv", end="", more=""))
    shown = []
    assert cli.main(["validate", "-f", str(path)], shown.append, spark) == 0
    assert shown == ["Pipeline valid: t", "Source: file fields=2", "Transforms: 0", "Sink: file"]
    assert cli.main(["run", "-f", str(path), "--summary-json", str(tmp_path / "s.json")], shown.append, spark) == 0
    assert json.loads((tmp_path / "s.json").read_text())["rowsWritten"] == 1
    shown.clear()
    assert cli.main(["run", "-f", str(tmp_path / "none.yaml")], shown.append, spark) == 1
    assert shown == [f"Pipeline config not found: {tmp_path}/none.yaml"]
    assert cli.main(["benchmark", "--rows", "10", "--batch-sizes", "1,4"], shown.append, spark) == 0
    counted = json.loads(shown[-1])
    assert [c["sinkBatches"] for c in counted] == [10, 3] and all(c["rowsWritten"] == 10 for c in counted)


def test_recover_demo(spark):
    shown = []
    assert cli.main(["recover-demo"], shown.append, spark) == 0
    assert [x for x in shown if x.startswith("[Row]")] == [f"[Row] id={i}, name=User-{i}" for i in range(1, 11)]
    assert "Sink stage failed: simulated crash" in shown and "rowsSkipped=5" in shown[-1]


def test_registered_source(spark, tmp_path):
    from loomline import sources

    def make(session, source):
        rows = session.range(1, 1 + int(source.options["count"])).selectExpr("id as _seq", "cast(null as string) as _err", "id", "'x' as content")
        return sources.Rows(rows, ROW, "made", 2)

    sources.register("made", make)
    done = runner.run(spark, config.loads("name: m\nsource:\n  type: made\n  count: 5\nsink:\n  type: console\n"), lambda _: None)
    assert (done.rowsRead, done.rowsWritten, done.sourceSplits) == (5, 5, 3)


def test_streaming_folder(spark, tmp_path):
    from loomline.streaming.incremental import stream_folder

    source = tmp_path / "arriving"
    source.mkdir()
    (source / "1.json").write_text('{"id": 1, "content": " a "}\n{"id": 2, "content": " "}\n')
    steps, got = [Transform("trim", field="content"), Transform("filter", field="content", op="not-empty")], []

    def go():
        stream_folder(spark, str(source), ROW, steps, lambda df, i: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "state")).awaitTermination(60)

    go()
    (source / "2.json").write_text('{"id": 3, "content": "c"}\n')
    go()
    assert got == [(1, "a"), (3, "c")]
