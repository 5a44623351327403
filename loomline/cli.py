"""Command line: run and validate pipelines, benchmark, demos, and jobs on a state folder."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from loomline import config
from loomline.errors import ConfigError, PipelineError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loomline", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, text in (("run", "run a pipeline file"), ("validate", "check a pipeline file without running it")):
        c = commands.add_parser(name, help=text)
        c.add_argument("-f", "--file", required=True)
        if name == "run":
            c.add_argument("--summary-json")
    c = commands.add_parser("benchmark", help="measure a CSV -> embedding -> counting sink pipeline")
    c.add_argument("--rows", type=int, default=128)
    c.add_argument("--batch-sizes", default="1,8,32,128")
    c.add_argument("--max-rows-per-split", type=int, default=0)
    c.add_argument("--format", choices=("json", "csv"), default="json")
    c.add_argument("--output")
    commands.add_parser("examples", help="show an example pipeline file")
    commands.add_parser("local-demo", help="ten generated rows on the console")
    commands.add_parser("ai-demo", help="ten generated documents with vectors on the console")
    c = commands.add_parser("recover-demo", help="a run that fails half-way, and the run that goes on behind its checkpoint")
    c.add_argument("--state-dir")
    commands.add_parser("help", help="show this text")
    c = commands.add_parser("submit", help="plan a job and run it")
    c.add_argument("-f", "--file", required=True)
    c.add_argument("--state-dir", required=True)
    c.add_argument("--max-parallelism", type=int, default=4)
    c.add_argument("--detach", action="store_true", help="leave the tasks to workers")
    c = commands.add_parser("worker", help="run the tasks of all jobs of a state folder, beside other workers")
    c.add_argument("--state-dir", required=True)
    c.add_argument("--max-parallelism", type=int, default=4)
    c.add_argument("--stay", action="store_true", help="go on waiting for jobs when all are done")
    c = commands.add_parser("status", help="state of one job, or of all")
    c.add_argument("--state-dir", required=True)
    c.add_argument("--job")
    c = commands.add_parser("recover", help="run the failed ranges of a job again")
    c.add_argument("-f", "--file", required=True)
    c.add_argument("--state-dir", required=True)
    c.add_argument("--job", required=True)
    return p


EXAMPLE = """name: notes-to-jsonl
source:
  type: file
  format: jsonl
  path: notes.jsonl
transforms:
  - type: trim
    field: content
  - type: filter
    field: content
    op: not-empty
  - type: chunk
    input: content
    output: chunk
    chunkSize: 500
    overlap: 50
sink:
  type: file
  format: jsonl
  path: out/chunks.jsonl
checkpoint:
  stateDir: .loomline/state
errorPolicy:
  mode: skip-bad-records
"""

SQL_EXAMPLE = """name: orders-by-customer
source:
  type: duckdb
  query: SELECT o_custkey AS id, count(*) AS orders FROM read_parquet('orders.parquet') GROUP BY o_custkey
sink:
  type: file
  format: csv
  path: out/orders/
"""
STORE_EXAMPLE = """name: documents-to-vectors
source:
  type: file
  format: document
  path: docs
transforms:
  - type: chunk
    input: content
    output: chunk
    chunkSize: 800
    overlap: 80
    dropInput: true
  - type: embedding
    provider: openai-compatible
    input: chunk
    output: embedding
    model: embedder
    baseUrl: http://localhost:8080/v1
    apiKeyEnv: EMBEDDING_KEY
    batchSize: 16
sink:
  type: qdrant
  url: http://localhost:6333
  collection: documents
  idField: id
  vectorField: embedding
  chunkIndexField: chunk_index
checkpoint:
  stateDir: .loomline/state
"""
EXAMPLES = (EXAMPLE, SQL_EXAMPLE, STORE_EXAMPLE)


def main(argv: list[str] | None = None, show=print, spark=None) -> int:  # noqa: ANN001
    """Exit code 0, or 1 with one message for an error that a user can mend."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if not e.code else 1
    try:
        return _command(args, show, spark)
    except (ConfigError, PipelineError) as e:
        show(str(e))
        return 1


def _command(args: argparse.Namespace, show, spark) -> int:  # noqa: ANN001
    if args.command == "examples":
        for text in EXAMPLES:
            show(text)
        return 0
    if args.command == "help":
        show(parser().format_help())
        return 0
    from loomline.plans import runner
    from loomline.plans.jobs import Jobs
    from loomline.session import session

    pipeline = config.load(args.file) if getattr(args, "file", None) else None
    spark = spark or session()
    if args.command == "run":
        done = runner.run(spark, pipeline, show)
        show(done.line())
        if args.summary_json:
            Path(args.summary_json).parent.mkdir(parents=True, exist_ok=True)
            Path(args.summary_json).write_text(json.dumps(asdict(done), indent=2) + "\n")
            show(f"Run Summary JSON: {args.summary_json}")
    elif args.command == "validate":
        for line in runner.validate(spark, pipeline):
            show(line)
    elif args.command == "benchmark":
        from loomline.plans.benchmark import benchmark, render

        text = render(benchmark(spark, args.rows, [int(b) for b in args.batch_sizes.split(",")], args.max_rows_per_split), args.format)
        if args.output:
            Path(args.output).parent.mkdir(parents=True, exist_ok=True)
            Path(args.output).write_text(text + "\n")
        else:
            show(text)
    elif args.command in ("local-demo", "ai-demo"):
        from loomline.sources import demo
        from loomline.operators import transforms
        from loomline.schema import LONG, STRING, field, row_type
        from loomline.sinks import console

        ai = args.command == "ai-demo"
        schema = row_type([field("id", LONG), field("content" if ai else "name", STRING)])
        chain = transforms.Chain([config.Transform("mock-embedding", input="content", output="embedding")] if ai else [], schema)
        df = chain(demo.documents(spark) if ai else demo.users(spark))
        sink = (console.MockVector if ai else console.Console)(config.Sink("console"), chain.schema, 0, show)
        sink.write(sink.render(df.orderBy("id")).collect(), 10)
    elif args.command == "recover-demo":
        _recover_demo(spark, show, args.state_dir)
    elif args.command == "submit":
        jobs = Jobs(spark, args.state_dir)
        job = jobs.submit(pipeline, args.max_parallelism)
        show(f"Submitted job: {job}")
        if not args.detach:
            show(f"Job {job} state={jobs.run(job, pipeline, args.max_parallelism, show)}")
    elif args.command == "worker":
        Jobs(spark, args.state_dir).work(args.max_parallelism, show, until_idle=not args.stay)
    elif args.command == "status":
        jobs = Jobs(spark, args.state_dir)
        for job, state in ({args.job: jobs.status(args.job)} if args.job else jobs.jobs()).items():
            show(f"Job {job} state={state or 'RUNNING'}")
    elif args.command == "recover":
        jobs = Jobs(spark, args.state_dir)
        job = jobs.rerun_failed(args.job)
        show(f"Job {job} state={jobs.run(job, pipeline, 4, show) if jobs.tasks(job) else 'COMPLETED'}")
    return 0


def _recover_demo(spark, show, state_dir: str | None = None) -> None:  # noqa: ANN001
    import tempfile

    from loomline import sinks
    from loomline.plans import runner
    from loomline.sinks import console

    class Fails(console.Console):
        left = 1

        def write(self, rows: list, last_seq: int) -> None:
            if last_seq > 5 and Fails.left:
                Fails.left -= 1
                raise RuntimeError("simulated crash")
            super().write(rows, last_seq)

    sinks.register("fails-once", Fails)
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "users.csv").write_text("id,name\n" + "".join(f"{i},User-{i}\n" for i in range(1, 11)))
        demo = config.Pipeline("recover-demo", config.Source("file", f"{folder}/users.csv", "csv"), [], config.Sink("fails-once"), state_dir or f"{folder}/state")
        try:
            runner.run(spark, demo, show)
        except PipelineError as e:
            show(str(e))
        show(runner.run(spark, demo, show).line())


if __name__ == "__main__":
    sys.exit(main())
