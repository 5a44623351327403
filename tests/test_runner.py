"""Runs, jobs and sources whose rows must all arrive: numbers, commits, part files, records cut across tasks."""

import json
import os
import random
import threading

import pytest

from loomline import config, sinks, sources
from loomline.config import Sink, Source, Transform
from loomline.errors import PipelineError, StageError
from loomline.plans import runner
from loomline.plans.jobs import Jobs
from loomline.plans.splits import marks_before, with_batches
from loomline.plans.state import Checkpoint, Store, Task
from loomline.sources import open_source


def quiet(spark, p, **more):
    return runner.run(spark, p, lambda _: None, **more)


def numbers(path):
    return [json.loads(line)["id"] for line in open(path)]


def write_rows(tmp_path, n, name="in.jsonl"):
    (tmp_path / name).write_text("".join(f'{{"id":{i},"content":"x{i}"}}\n' for i in range(1, n + 1)))
    return Source("file", str(tmp_path / name), "jsonl", max_rows_per_split=25)


@pytest.mark.parametrize("partitions", ["2", "40"])
def test_no_row_of_a_query_is_lost(spark, tmp_path, partitions):
    spark.range(3000).selectExpr("id % 1000 AS k", "repeat(cast(id AS STRING), 50) AS t").repartition(5).write.parquet(f"{tmp_path}/t.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for order in ("", " ORDER BY k DESC"):
            source = Source("duckdb", query=f"SELECT k AS id, max(t) AS content FROM read_parquet('{tmp_path}/t.parquet') GROUP BY k{order}")
            rows = open_source(spark, source).df
            assert sorted(r[0] for r in rows.select("_seq").collect()) == list(range(1, 1001))
            done = quiet(spark, config.Pipeline("q", source, [], Sink("file", f"{tmp_path}/out.jsonl", "jsonl")))
            assert (done.rowsRead, done.rowsWritten, done.checkpointSeq) == (1000, 1000, 1000)
            assert sorted(numbers(f"{tmp_path}/out.jsonl")) == list(range(1000))
            if order:
                assert numbers(f"{tmp_path}/out.jsonl") == list(range(999, -1, -1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_source_is_read_once_whatever_the_splits(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def make(session, source):
        def seen(batches):
            for b in batches:
                reads.add(b.num_rows)
                yield b

        def number():
            from loomline.plans.lineage import materialize
            from loomline.schema import PIECE, PLACE

            df = session.range(1, 101, numPartitions=4).selectExpr("id", "'x' AS content").mapInArrow(seen, "id bigint, content string")
            return sources.Numbered(materialize(sources.placed(df).select(PIECE, PLACE, "id", "content")))

        from pyspark.sql import functions as F

        schema = config_row()
        return sources.Rows(number, schema, "once", 5, lambda df: df.select("_seq", F.lit(None).cast("string").alias("_err"), "id", "content"))

    sources.register("once-read", make)
    for end in ("", f"checkpoint:\n  stateDir: {tmp_path}/state\n"):
        before = reads.value
        p = config.loads(f"name: once\nsource:\n  type: once-read\nsink:\n  type: file\n  format: jsonl\n  path: {tmp_path}/o/\n{end}")
        done = quiet(spark, p, rows_per_commit=10)
        assert (done.rowsWritten, done.sourceSplits, reads.value - before) == (100, 20, 100)


def config_row():
    from loomline.schema import LONG, STRING, field, row_type

    return row_type([field("id", LONG), field("content", STRING)])


def test_a_source_with_gaps_in_its_numbers_is_refused(spark):
    def make(session, source):
        return sources.Rows(session.range(1, 6).selectExpr("id * 2 AS _seq", "cast(null AS string) AS _err", "id", "'x' AS content"), config_row(), "gap", 2)

    sources.register("gaps", make)
    with pytest.raises(StageError, match="Source stage failed: rows are numbered up to 10 from 1, but there are 5"):
        quiet(spark, config.loads("name: g\nsource:\n  type: gaps\nsink:\n  type: console\n"))


def test_a_sink_that_writes_too_few_rows_is_an_error(spark, tmp_path):
    class Loses:
        def __init__(self, *_): ...
        def open(self): ...
        def close(self): ...

        def write_table(self, df, batch_rows, first=1):
            return df.count() - 1

    sinks.register("loses", Loses)
    with pytest.raises(StageError, match="Sink stage failed: 30 rows were to be written, but 29 were"):
        quiet(spark, config.Pipeline("l", write_rows(tmp_path, 30), [], Sink("loses")))


@pytest.mark.parametrize("workers", [1, 4])
def test_a_job_writes_every_row_to_one_file(spark, tmp_path, workers):
    p = config.Pipeline("job", write_rows(tmp_path, 100), [], Sink("file", f"{tmp_path}/out/all.jsonl", "jsonl"))
    jobs = Jobs(spark, f"{tmp_path}/state")
    job = jobs.submit(p, 4)
    assert jobs.run(job, p, workers) == "COMPLETED"
    assert [t.rows_written for t in jobs.tasks(job)] == [25] * 4
    assert numbers(f"{tmp_path}/out/all.jsonl") == list(range(1, 101)) and os.listdir(f"{tmp_path}/out") == ["all.jsonl"]
    folder = config.Pipeline("folder", p.source, [], Sink("file", f"{tmp_path}/parts/", "csv"))
    job = jobs.submit(folder, 4)
    assert jobs.run(job, folder, workers) == "COMPLETED"
    assert open_source(spark, Source("file", f"{tmp_path}/parts", "csv")).df.orderBy("_seq").select("id").toPandas()["id"].tolist() == list(range(1, 101))
    added = config.Pipeline("added", p.source, [], Sink("file", f"{tmp_path}/out/all.jsonl", "jsonl", "append"))
    job = jobs.submit(added, 3)
    assert jobs.run(job, added, workers) == "COMPLETED" and numbers(f"{tmp_path}/out/all.jsonl") == [*range(1, 101)] * 2


def test_failed_tasks_of_a_job_are_run_again_and_joined(spark, tmp_path, monkeypatch):
    from loomline.sinks import file

    write, refuse = file.FolderSink.write_table, [True]

    def fails(self, df, batch_rows, first=1):
        if first == 26 and refuse[0]:
            raise ValueError("no room")
        return write(self, df, batch_rows, first)

    monkeypatch.setattr(file.FolderSink, "write_table", fails)
    p = config.Pipeline("again", write_rows(tmp_path, 100), [], Sink("file", f"{tmp_path}/all.jsonl", "jsonl"))
    jobs = Jobs(spark, f"{tmp_path}/state")
    job = jobs.submit(p, 4)
    assert jobs.run(job, p) == "FINISHED_WITH_ERRORS"
    failed = jobs.failed(job)
    assert [(t.start, t.end, t.attempt, t.error_code, t.error) for t in failed] == [(26, 50, 4, "RETRY_EXHAUSTED", "attempts=4; Sink stage failed: no room")]
    assert numbers(f"{tmp_path}/all.jsonl") == [*range(1, 26), *range(51, 101)]
    refuse[0] = False
    assert jobs.run(jobs.rerun_failed(job), p) == "COMPLETED" and numbers(f"{tmp_path}/all.jsonl") == list(range(1, 101))
    missing = config.Pipeline("missing", Source("file", str(tmp_path / "none"), "jsonl"), [], Sink("console"))
    jobs.store.put("m-task", Task("m-task", "m"), -1)
    assert jobs.run("m", missing) == "FAILED" and [(t.attempt, t.error) for t in jobs.failed("m")] == [(1, f"Source stage failed: Source file not found: {tmp_path}/none")]


def test_folder_sink_starts_over_and_resumes(spark, tmp_path):
    source, state = write_rows(tmp_path, 100), str(tmp_path / "state")
    p = config.Pipeline("f", source, [], Sink("file", f"{tmp_path}/out/", "jsonl"), state)
    read = lambda: open_source(spark, Source("file", f"{tmp_path}/out", "jsonl")).df.select("id").toPandas()["id"].tolist()
    assert quiet(spark, p, rows_per_commit=25).rowsWritten == 100 and len([d for d in os.listdir(tmp_path / "out") if d.startswith("rows-")]) == 4
    Store(state).put("local-pipeline-f", Task("local-pipeline-f", state="RUNNING", attempt=1, checkpoint=50))
    done = quiet(spark, p, rows_per_commit=25)
    assert (done.rowsWritten, done.rowsSkipped) == (50, 50) and sorted(read()) == list(range(1, 101))
    write_rows(tmp_path, 10)
    assert quiet(spark, config.Pipeline("g", source, [], p.sink)).rowsWritten == 10 and sorted(read()) == list(range(1, 11))
    assert quiet(spark, config.Pipeline("h", source, [], Sink("file", f"{tmp_path}/out/", "jsonl", "append"))).rowsWritten == 10 and len(read()) == 20


def test_commits_of_one_file_and_chunks_in_order(spark, tmp_path):
    p = config.Pipeline("c", write_rows(tmp_path, 60), [Transform("chunk", input="content", output="chunk", chunk_size=2, drop_input=True)], Sink("file", f"{tmp_path}/c.jsonl", "jsonl"), str(tmp_path / "s"))
    done = quiet(spark, p, rows_per_commit=25)
    lines = [json.loads(x) for x in open(tmp_path / "c.jsonl")]
    assert [(x["id"], x["chunk_index"]) for x in lines] == [(i, k) for i in range(1, 61) for k in range(1 if i < 10 else 2)]
    assert done.sinkBatches == 60 and [x.split(",")[0] for x in open(tmp_path / "c.jsonl.offsets")] == ["25", "50", "60"]


def test_batches_with_bad_records(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    bad = {i for i in range(1, 41_000) if rnd.random() < 0.02} | {1, 500, 501, 16_384, 16_385}
    rows = spark.range(1, 41_000).select(F.col("id").alias("_seq"), F.when(F.col("id").isin(sorted(bad)), "bad").alias("_err"))
    for per_split, size, after in ((500, 7, 250), (None, 9, 0)):
        expected, split, part, count = {}, None, 0, 0
        for i in range(after + 1, 41_000):
            now = (i - 1) // per_split if per_split else 0
            if now != split:
                split, part, count = now, 0, 0
            if i in bad:
                part, count = part + 1, 0
                expected[i] = (split, part, 0)
            else:
                expected[i] = (split, part, count // size)
                count += 1
        got = with_batches(rows, per_split, size, after).toPandas()
        assert {r[0]: r[2:] for r in got.itertuples(index=False, name=None)} == expected
    assert marks_before(rows, F.lit(False), [], "_seq").agg(F.max("_marks"), F.max("_last")).first()[:] == (0, None)


def csv_text(rnd, rows):
    out = ["id,content"]
    for i in range(rows):
        text = "".join(rnd.choice(["a", "b ", '"', ",", "\n", 'x"y', "zz", "ä"]) for _ in range(rnd.randint(0, 30)))
        kind = rnd.random()
        out.append(f'{i},"' + text.replace('"', '""') + '"' if kind < 0.5 else f'{i},plain {i} with a "stray" quote' if kind < 0.9 else "" if kind < 0.95 else f"{i}")
    return "\n".join(out) + "\n"


def test_csv_folders_and_files_cut_across_tasks(spark, tmp_path):
    rnd = random.Random(1)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a.csv", "b.csv", "deep/c.csv"):
        (tmp_path / "in" / name).write_text(csv_text(rnd, 1000))
    (tmp_path / "in" / "_not.csv").write_text("?")
    read = lambda path: [tuple(r) for r in open_source(spark, Source("file", str(path), "csv")).df.orderBy("_seq").collect()]
    single = [r[2:] for name in ("a.csv", "b.csv", "deep/c.csv") for r in read(tmp_path / "in" / name)]
    whole = read(tmp_path / "in")
    assert [r[2:] for r in whole] == single and [r[0] for r in whole] == list(range(1, len(single) + 1))
    assert [r[2:] for r in read(tmp_path / "in" / "[ab].csv")] == single[: len(read(tmp_path / "in" / "a.csv")) + len(read(tmp_path / "in" / "b.csv"))]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        assert read(tmp_path / "in") == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "with space").mkdir()
    (tmp_path / "with space" / "x.csv").write_text("id\n1\n")
    assert read(tmp_path / "with space" / "x.csv") == [(1, None, 1)]


def test_jsonl_folders_and_nested_values(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('\n{"id":1,"content":"x"}\n{"id":2,"content":{"content":"x"}}\n{"id":3,"content":"{\\"content\\":\\"x\\"}"}\n')
    (tmp_path / "in" / "b.jsonl").write_text('{"id":4,"content":["a"]}\n\n{"content":"[1]","id":5}\n{"id":6,"content":[1,}\n')
    rows = [tuple(r) for r in open_source(spark, Source("file", str(tmp_path / "in"), "jsonl")).df.orderBy("_seq").collect()]
    nested, where = "field content must be a scalar value", "Invalid JSONL row at line "
    assert [r[:2] for r in rows] == [(1, None), (2, f"{where}3: {nested}"), (3, None), (4, f"{where}5: {nested}"), (5, None), (6, f"{where}8: malformed JSON")]
    assert [(r[2], r[3]) for r in rows if not r[1]] == [(1, "x"), (3, '{"content":"x"}'), (5, "[1]")]


def test_state_has_one_winner(tmp_path):
    store, won, lost = Store(str(tmp_path)), [], []
    store.put("t", Task("t"), -1)

    def write(i):
        try:
            Store(str(tmp_path)).put("t", Task("t", rows_read=i, version=1), 0)
            won.append(i)
        except PipelineError:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 15 and store.get("t").rows_read == won[0]
    store.put("t", Task("t", version=0))
    assert store.get("t").version == 2 and len(store.scan()) == 1


def test_sql_of_another_dialect(spark, tmp_path):
    from loomline.sources.sql import to_spark

    assert to_spark(spark, "SELECT a // 2, '//', \"list(\" -- // list(x)\nFROM t WHERE list_contains(b, 'read_csv(''x'')')") == "SELECT a  div  2, '//', \"list(\" -- // list(x)\nFROM t WHERE array_contains(b, 'read_csv(''x'')')"
    assert to_spark(spark, "SELECT x::VARCHAR, cast(y AS VARCHAR(3)), date_diff('day', a, b) FROM t") == "SELECT x::string, cast(y AS VARCHAR(3)), datediff(day, a, b) FROM t"


def test_late_events_of_a_stream(spark, tmp_path):
    from loomline.streaming.incremental import session_counts, windowed_counts

    source, got = tmp_path / "events", []
    source.mkdir()

    def go():
        events = spark.readStream.schema("ts timestamp, kind string").json(str(source))
        query = windowed_counts(events, "ts", ["kind"], "10 minutes", "5 minutes").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        query.foreachBatch(lambda df, _: got.extend((r["start"].minute, r["kind"], r["rows"]) for r in df.collect())).trigger(availableNow=True).start().awaitTermination(60)

    event = lambda minute: f'{{"ts": "2024-01-01T00:{minute:02d}:00", "kind": "a"}}\n'
    (source / "1.json").write_text(event(1) + event(2) + event(31))
    go()
    (source / "2.json").write_text(event(3) + event(33))  # the first is behind the watermark of 00:26
    go()
    (source / "3.json").write_text(event(59))
    go()
    assert (0, "a", 2) in got and (30, "a", 2) in got
    rows = spark.createDataFrame([(1,), (2,), (20,)], "m int").selectExpr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) AS ts", "'a' AS kind")
    assert sorted(r["rows"] for r in session_counts(rows, "ts", ["kind"], "5 minutes", "1 hour").collect()) == [1, 2]


def test_embeddings_are_asked_for_once_a_flush(spark, tmp_path):
    from loomline.operators import embedding

    calls = tmp_path / "calls"

    def provider(t):
        def vectors(texts):
            with open(calls, "a") as f:
                f.write(f"{len(texts)}\n")
            return [[float(len(x))] for x in texts]

        return vectors

    embedding.register("counted", provider)
    (tmp_path / "in.jsonl").write_text("".join(f'{{"id":{i},"content":"{"abcdefgh"[: i % 4 * 2 + 1]}"}}\n' for i in range(1, 11)))
    steps = [Transform("chunk", input="content", output="chunk", chunk_size=2, drop_input=True), Transform("embedding", provider="counted", input="chunk", output="v", batch_size=4)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        done = quiet(spark, config.Pipeline("e", Source("file", str(tmp_path / "in.jsonl"), "jsonl"), steps, Sink("file", f"{tmp_path}/o.jsonl", "jsonl")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert (done.rowsRead, done.rowsWritten, done.sinkBatches) == (10, 25, 3)
    assert [int(x) for x in open(calls)] == [10, 10, 5]


def test_leases(spark, tmp_path):
    from loomline.plans.jobs import expired, schedulable

    p = config.Pipeline("lease", write_rows(tmp_path, 50), [], Sink("file", f"{tmp_path}/all.jsonl", "jsonl"))
    jobs = Jobs(spark, f"{tmp_path}/state", lease_ms=300)
    job = jobs.submit(p, 2)
    one, two = jobs.tasks(job)
    held = one.to("RUNNING", attempt=1, owner="another", lease_until=10**15)
    jobs.store.put(one.task_id, held, one.version)
    assert expired([held], 10**15) == {one.task_id} and not expired([held]) and schedulable([held]) == []
    assert jobs.run(job, p) is None and [t.state for t in jobs.tasks(job)] == ["RUNNING", "COMPLETED"]
    jobs.store.put(one.task_id, held.to("RUNNING", lease_until=1), held.version)
    assert jobs.run(job, p) == "COMPLETED" and numbers(f"{tmp_path}/all.jsonl") == list(range(1, 51))
    assert {t.owner for t in jobs.tasks(job)} == {jobs.owner} and [t.attempt for t in jobs.tasks(job)] == [2, 1]


def test_help_examples_and_demo_state(spark, tmp_path):
    from loomline import cli

    shown = []
    assert cli.main(["help"], shown.append, spark) == 0 and "recover-demo" in shown[0]
    shown.clear()
    assert cli.main(["examples"], shown.append, spark) == 0 and len(shown) == 3
    for text in shown:
        config.loads(text)
    assert cli.main(["recover-demo", "--state-dir", str(tmp_path / "kept")], shown.append, spark) == 0
    assert Store(str(tmp_path / "kept")).get("local-pipeline-recover-demo").state == "COMPLETED"


def pdf_with_object_streams():
    import zlib

    cmap = b"begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0003> <0020> <0010> <00e9> endbfchar 1 beginbfrange <0041> <005a> <0410> endbfrange"
    page = b"BT /F1 12 Tf [<00410042>-20<0043>] TJ 0 -14 Td <0010> Tj /F2 9 Tf [(on)-300(e \\(1\\))] TJ ET"
    inner = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F1 5 0 R/F2 6 0 R>>>>>>", 3: b"<</Type/Page/Contents 4 0 R>>", 5: b"<</Type/Font/Subtype/Type0/ToUnicode 7 0 R>>", 6: b"<</Type/Font/Subtype/Type1>>"}
    bodies, places = b"", []
    for n, body in inner.items():
        places.append(f"{n} {len(bodies)}")
        bodies += body + b" "
    head = " ".join(places).encode() + b" "
    packed = zlib.compress(head + bodies)
    stream = lambda n, data, more=b"": b"%d 0 obj<<%s/Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj\n" % (n, more, len(data), data)
    return b"%PDF-1.5\n" + stream(9, packed, b"/Type/ObjStm/N %d/First %d" % (len(inner), len(head))) + stream(4, zlib.compress(page)) + stream(7, zlib.compress(cmap)) + b"%%EOF\n"


def test_pdf_with_object_streams_and_wide_fonts():
    from loomline.sources.pdf import pdf_text

    assert pdf_text(pdf_with_object_streams()) == "АБВ\néon e (1)\n"
    for bad in (b"nothing", b"%PDF-1.4 /Encrypt", b"%PDF-1.4 1 0 obj endobj"):
        with pytest.raises(ValueError):
            pdf_text(bad)


def test_many_document_folders(spark, tmp_path, monkeypatch):
    from loomline.sources import documents

    monkeypatch.setattr(documents, "FOLDERS", 4)
    for i in range(6):
        for k in range(3):
            (tmp_path / f"d{i}" / "x" / "y").mkdir(parents=True, exist_ok=True)
            (tmp_path / f"d{i}" / "x" / "y" / f"{k}.md").write_text(f"{i}-{k}")
        (tmp_path / f"d{i}" / "_top.TXT").write_text("t")
    rows = [tuple(r) for r in open_source(spark, Source("file", str(tmp_path), "document")).df.orderBy("_seq").collect()]
    assert [r[3] for r in rows] == sorted([f"d{i}/x/y/{k}.md" for i in range(6) for k in range(3)] + [f"d{i}/_top.TXT" for i in range(6)]) and [r[2] for r in rows] == list(range(1, 25))
    assert open_source(spark, Source("file", f"file://{tmp_path}", "document", "text")).df.count() == 6


def test_workers_share_the_jobs_of_a_folder(spark, tmp_path):
    from loomline import cli

    write_rows(tmp_path, 100)
    text = "name: shared\nsource:\n  type: file\n  format: jsonl\n  path: in.jsonl\n  maxRowsPerSplit: 10\ntransforms:\n  - type: trim\n    field: content\nsink:\n  type: file\n  format: jsonl\n  path: out/all.jsonl\n"
    (tmp_path / "p.yaml").write_text(text)
    shown, state = [], str(tmp_path / "state")
    assert cli.main(["submit", "-f", str(tmp_path / "p.yaml"), "--state-dir", state, "--max-parallelism", "6", "--detach"], shown.append, spark) == 0
    assert len(shown) == 1 and not (tmp_path / "out").exists()
    workers = [Jobs(spark, state) for _ in range(2)]
    threads = [threading.Thread(target=w.work, args=(2,), kwargs={"wait_ms": 50}) for w in workers]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    tasks = Store(state).scan()
    assert {t.state for t in tasks} == {"COMPLETED"} and sum(t.rows_written for t in tasks) == 100 and numbers(tmp_path / "out/all.jsonl") == list(range(1, 101))
    assert cli.main(["worker", "--state-dir", state], shown.append, spark) == 0
    assert workers[0].pipeline_of(next(t.job_id for t in tasks if t.job_id)) == config.load(tmp_path / "p.yaml")


def test_folders_too_many_for_the_driver_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    from loomline.sources import documents

    monkeypatch.setattr(documents, "MOST_FOLDERS", 20)
    monkeypatch.setattr(documents, "FILES", 7)
    for i in range(60):
        (tmp_path / f"d{i}" / "e").mkdir(parents=True)
        (tmp_path / f"d{i}" / "e" / "x.txt").write_text(str(i))
    (tmp_path / "top.txt").write_text("top")
    (tmp_path / "linked").symlink_to(tmp_path / "d1")
    found = open_source(spark, Source("file", str(tmp_path), "document")).df.orderBy("_seq").collect()
    assert [(r["path"], r["content"]) for r in found] == sorted([("top.txt", "top"), *((f"d{i}/e/x.txt", str(i)) for i in range(60))])


def test_small_documents_share_batches(tmp_path):
    import pyarrow as pa

    from loomline.sources import documents

    n, names = 3000, ["_piece", "_place", "path", "full", "data"]
    data = [b"x" * (documents.CHARACTERS if i == 100 else 5) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(["0"] * n), pa.array(range(n)), pa.array([f"{i}.txt" for i in range(n)]), pa.array([None] * n, pa.string()), pa.array(data)], names)
    made = list(documents.extract([batch]))
    assert [x.num_rows for x in made] == [101, 2899]
    assert [c for x in made for c in x.column(1).to_pylist()] == list(range(n)) and [c.encode() for x in made for c in x.column(4).to_pylist()] == data


def test_thousands_of_documents_are_written_at_once(spark, tmp_path):
    from time import time

    from loomline.plans.queries import s3_documents

    spark.range(1, 4001).selectExpr("id AS doc_id", "if(id % 50 = 0, NULL, 'text ' || id) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    began = time()
    rows = {(r["id"], r["doc_id"], r["content"]) for r in s3_documents(spark, str(tmp_path)).collect()}
    assert time() - began < 40  # with a process for each file it was minutes
    order = sorted(range(1, 4001), key=lambda i: f"doc={i}/")
    assert rows == {(n, i, "\n" if i % 50 == 0 else f"text {i}\n") for n, i in enumerate(order, 1)}


def failing_from(number):
    """A source type of 100 rows in splits of 5; row 7 is bad, and rows from a number on can't be made."""
    from pyspark.sql import functions as F

    def make(session, source):
        bad = F.when(F.col("id") == 7, "bad")
        content = F.when(F.col("id") >= (number[0] or 1000), F.raise_error(F.lit("no such row"))).otherwise(F.concat(F.lit("x" * 9), F.col("id").cast("string")))
        rows = session.range(1, 101, numPartitions=4).select(F.col("id").alias("_seq"), bad.cast("string").alias("_err"), "id", content.alias("content"))
        return sources.Rows(rows, config_row(), "failing", 5)

    sources.register("failing", make)


def test_many_commits_are_made_by_one_round_of_jobs(spark, tmp_path, monkeypatch):
    failing_from([None])
    made, shown = [], []
    materialize = runner.materialize
    monkeypatch.setattr(runner, "materialize", lambda df: made.append(1) or materialize(df))
    p = config.Pipeline("r", Source("failing"), [], Sink("file", f"{tmp_path}/r.csv", "csv"), f"{tmp_path}/s", True)
    done = runner.run(spark, p, shown.append, 10)
    assert (done.rowsRead, done.rowsWritten, done.rowsFailed, done.checkpointSeq, done.sinkBatches, len(made)) == (100, 99, 1, 100, 99, 1)
    want = ["id,content", *(f"{i},xxxxxxxxx{i}" for i in range(1, 101) if i != 7)]
    assert (tmp_path / "r.csv").read_text().splitlines() == want and [x for x in shown if "bad" in x] == ["Skipped bad record seq=7 error=bad"]
    sizes = [tuple(map(int, x.split(","))) for x in open(tmp_path / "r.csv.offsets")]
    ends = [len("".join(f"{x}\n" for x in want[: 1 + n - (n >= 7)])) for n in range(10, 101, 10)]
    assert sizes == [*zip(range(10, 101, 10), ends)]
    Store(f"{tmp_path}/s").put("local-pipeline-r", Task("local-pipeline-r", state="RUNNING", attempt=1, checkpoint=37))
    done = quiet(spark, p, rows_per_commit=10)
    assert (done.rowsWritten, done.rowsSkipped, len(made)) == (70, 30, 2) and (tmp_path / "r.csv").read_text().splitlines() == want


def test_a_round_that_fails_keeps_the_commits_before(spark, tmp_path):
    number = [44]
    failing_from(number)
    p = config.Pipeline("f", Source("failing"), [], Sink("file", f"{tmp_path}/f.jsonl", "jsonl"), f"{tmp_path}/s", True)
    with pytest.raises(StageError, match="no such row"):
        quiet(spark, p, rows_per_commit=10)
    assert Checkpoint(f"{tmp_path}/s", "f").task.checkpoint == 40
    assert [x.split(",")[0] for x in open(tmp_path / "f.jsonl.offsets")] == ["10", "20", "30", "40"]
    number[0] = None
    assert quiet(spark, p, rows_per_commit=10).rowsSkipped == 40
    assert numbers(f"{tmp_path}/f.jsonl") == [i for i in range(1, 101) if i != 7]
