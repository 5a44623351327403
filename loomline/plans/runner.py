"""Running a pipeline: source, checks, transforms and sink as one plan, committed flush by flush or split by split."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import sinks
from loomline.config import Pipeline
from loomline.errors import PipelineError, StageError
from loomline.operators.transforms import Chain
from loomline.plans import splits
from loomline.plans.lineage import materialize, release, scope, shared_dir
from loomline.plans.state import COMPLETED, Checkpoint
from loomline.schema import BATCH, ERR, POSITION, SEQ
from loomline.sinks.file import commit_of
from loomline.sources import ROWS_PER_SPLIT, Rows, open_source

ROWS = "_b_rows"
LAST = 2**63 - 1
#: Commits of one run at most where a sink writes from tasks; a run of more rows commits more of them at a time.
MOST_COMMITS = 64
#: Source rows whose commits are made by the same Spark jobs, at least and where there are as many, and commits of one such round at most.
ROUND, MOST_OF_ROUND = 1 << 18, 10_000


@dataclass
class Summary:
    pipelineName: str
    rowsRead: int = 0
    rowsWritten: int = 0
    rowsFailed: int = 0
    rowsSkipped: int = 0
    checkpointSeq: int = 0
    taskState: str = COMPLETED
    sourceSplits: int = 0
    sinkBatches: int = 0
    durationMs: int = 0

    def line(self) -> str:
        return "Run Summary: " + " ".join(f"{k}={v}" for k, v in asdict(self).items() if k != "pipelineName")


@contextmanager
def stage(name: str, assembly: bool = False):  # noqa: ANN201
    """Errors get the name of the stage; with ``assembly``, of putting the pipeline together."""
    try:
        yield
    except StageError:
        raise
    except Exception as e:
        raise StageError(name, root_cause(e), assembly) from e


def root_cause(e: BaseException) -> str:
    """What a user should read of an error: of one from a task, the Python or Spark error's own message."""
    text = str(e).strip()
    for line in reversed(text.splitlines()):
        for mark in ("loomline.errors.PipelineError: ", "PipelineError: "):
            if mark in line:
                return line.split(mark, 1)[1].strip()
    if "USER_RAISED_EXCEPTION" in text:
        return text.split("USER_RAISED_EXCEPTION]", 1)[1].strip().split(" SQLSTATE")[0].splitlines()[0].strip()
    return text.splitlines()[0].strip() if text else type(e).__name__


def exact_session(spark: SparkSession) -> SparkSession:
    """A session like this one, with its settings and views, in which names are told apart by case."""
    shared_dir(spark)
    session = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    session.conf.set("spark.sql.caseSensitive", "true")
    return session


def run(
    spark: SparkSession, pipeline: Pipeline, show: Callable[[str], None] = print, rows_per_commit: int | None = None, only: tuple[int, int] | None = None, rows: Rows | None = None,
    sink_of: Callable | None = None,
) -> Summary:
    """Runs a pipeline to its end, or raises a :class:`StageError`; then what was written before stays.

    With a state folder the run goes on behind the last commit of an earlier one. A parallel sink
    commits ``rows_per_commit`` rows at a time (whole splits of 10,000 rows together at least, in at
    most :data:`MOST_COMMITS` commits), an ordered one each flush. ``only`` limits the run to a range of rows and ``rows`` is the
    opened source they come from (a task of a job); ``sink_of`` makes the sink in place of the registry.
    """
    if rows is None:
        spark = exact_session(spark)
    with scope(spark):
        return _run(spark, pipeline, show, rows_per_commit, only, rows, sink_of or sinks.create)


def _run(spark: SparkSession, pipeline: Pipeline, show: Callable[[str], None], rows_per_commit: int | None, only: tuple[int, int] | None, rows: Rows | None, sink_of: Callable) -> Summary:
    began = time.time()
    summary = Summary(pipeline.name)
    show(f"Starting pipeline: {pipeline.name}")
    if rows is None:
        with stage("Source", assembly=True):
            rows = open_source(spark, pipeline.source)
    with stage("Transform", assembly=True):
        chain = Chain(pipeline.transforms, rows.schema)
    checkpoint = None
    if pipeline.state_dir:
        with stage("Checkpoint"):
            checkpoint = Checkpoint(pipeline.state_dir, pipeline.name)
        if checkpoint.task.state == COMPLETED:
            summary.checkpointSeq = summary.rowsSkipped = checkpoint.task.checkpoint
            show(f"Pipeline Finished. rows=0 checkpoint={checkpoint.task.checkpoint} state=COMPLETED")
            return summary
    after = checkpoint.task.checkpoint if checkpoint else 0
    with stage("Sink", assembly=True):
        sink = sink_of(pipeline.sink, chain.schema, after + 1 if checkpoint else 0, show)
        sink.only = only
        sink.open()
    if checkpoint and getattr(sink, "position", None) is not None:
        after = min(after, sink.position)  # what the sink has lost since, or never had
    try:
        first, last = only or (1, LAST)
        after = max(after, first - 1)
        with stage("Source"):
            source = rows.between(first, last)
            facts = source.agg(F.count(SEQ).alias("rows"), F.max(SEQ).alias("last"), F.min(F.when(F.col(ERR).isNotNull(), F.col(SEQ))).alias("bad")).first()
            total, bad = facts["last"] or 0, None
            if facts["rows"] != max(0, total - first + 1):
                raise PipelineError(f"rows are numbered up to {total} from {first}, but there are {facts['rows']}")
            if facts["bad"] is not None and not pipeline.skip_bad_records:
                bad = source.where(F.col(ERR).isNotNull() & (F.col(SEQ) > after)).agg(F.min(F.struct(SEQ, ERR)).alias("x")).first()["x"]
        planned = splits.plan(rows.split_prefix, total, rows.rows_per_split)
        summary.sourceSplits, summary.rowsSkipped, summary.checkpointSeq = len(planned), after if checkpoint else 0, after
        end = total if bad is None else bad[SEQ] - 1
        sound = facts["bad"] is None or bad is not None and bad[SEQ] == facts["bad"]
        flushes = lambda a, b: splits.with_batches(rows.between(a, b), rows.rows_per_split, chain.batch_size, a - 1, sound)
        if hasattr(sink, "write_table"):
            size = rows.rows_per_split or chain.batch_size * -(-ROWS_PER_SPLIT // chain.batch_size)
            least = max(ROWS_PER_SPLIT, -(-(end - after) // MOST_COMMITS)) if rows_per_commit is None else rows_per_commit
            step = size * max(1, -(-least // size)) if checkpoint else max(1, total)
            # Flushes begin anew with each split only where there are splits, and a round that fails must not ask for embeddings again.
            if checkpoint and rows.rows_per_split and hasattr(sink, "write_steps") and not any(t.type == "embedding" for t in pipeline.transforms):
                commits = -(-max(ROUND, -(-(end - after) // MOST_COMMITS)) // step)
                _in_rounds(sink, flushes, chain, checkpoint, after, end, step, step * min(max(1, commits), MOST_OF_ROUND), summary, show)
            else:
                _parallel(sink, flushes, chain, checkpoint, after, end, step, summary, show)
        elif end > after:
            _ordered(sink, flushes(after + 1, end), chain, checkpoint, summary, show)
        done = summary.rowsRead
        if done != end - after:
            raise StageError("Source", f"{end - after} rows were to be read, but {done} were")
        if bad is not None:
            raise StageError("Source", bad[ERR])
        if checkpoint:
            with stage("Checkpoint"):
                checkpoint.complete()
        else:
            summary.checkpointSeq = max(total, after)
    finally:
        sink.close()
    summary.durationMs = int((time.time() - began) * 1000)
    show(f"Pipeline Finished. rows={summary.rowsWritten}")
    return summary


def _events(sink: object, batched: DataFrame, chain: Chain) -> DataFrame:
    """One stream in source order: output rows, the end of each flush with its rows, and bad records."""
    good = batched.where(F.col(ERR).isNull())
    out = sink.render(chain(good).withColumn(POSITION, F.monotonically_increasing_id())) if hasattr(sink, "render") else chain(good).withColumn(POSITION, F.monotonically_increasing_id())
    ends = good.groupBy(*BATCH).agg(F.max(SEQ).alias(SEQ), F.count("*").alias(ROWS)).withColumn(POSITION, F.lit(LAST))
    errors = batched.where(F.col(ERR).isNotNull()).select(SEQ, ERR, F.lit(-1).cast("bigint").alias(POSITION))
    return out.unionByName(ends, True).unionByName(errors, True).orderBy(SEQ, POSITION)


def _ordered(sink: object, batched: DataFrame, chain: Chain, checkpoint: Checkpoint | None, summary: Summary, show: Callable[[str], None]) -> None:
    waiting: list = []
    with stage("Transform"):
        events = _events(sink, batched, chain).toLocalIterator(prefetchPartitions=True)
    while True:
        with stage("Transform"):
            event = next(events, None)
        if event is None:
            break
        if event[ROWS] is not None:
            if waiting:
                with stage("Sink"):
                    sink.write(waiting, event[SEQ])
                summary.sinkBatches += 1
                summary.rowsWritten += len(waiting)
                waiting = []
            summary.rowsRead += event[ROWS]
        elif event[ERR] is not None:
            show(f"Skipped bad record seq={event[SEQ]} error={event[ERR]}")
            summary.rowsRead += 1
            summary.rowsFailed += 1
        else:
            waiting.append(event)
            continue
        summary.checkpointSeq = event[SEQ]
        if checkpoint:
            with stage("Checkpoint"):
                checkpoint.advance(event[SEQ])


def _parallel(sink: object, flushes: Callable[[int, int], DataFrame], chain: Chain, checkpoint: Checkpoint | None, after: int, end: int, step: int, summary: Summary, show: Callable[[str], None]) -> None:
    """Rows are written by tasks, ``step`` source rows a commit; commits end where a step's rows end, counted from row 1.

    Output rows become a table first: an embedding is asked for once, whatever happens in the sink.
    """
    while after < end:
        first, last = after + 1, min(end, (after // step + 1) * step)
        window = flushes(first, last)
        with stage("Source"):
            counts = window.agg(F.count(SEQ).alias("read"), F.count(ERR).alias("failed")).first()
        with stage("Transform"):
            out = materialize(chain(window.where(F.col(ERR).isNull())).withColumn(POSITION, F.monotonically_increasing_id()))
            made = out.groupBy(*BATCH).agg(F.count("*").alias("n")).agg(F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        with stage("Sink"):
            if made["rows"]:
                written = sink.write_table(out, max(chain.batch_size, 1), first)
                if written is not None and written != made["rows"]:
                    raise PipelineError(f"{made['rows']} rows were to be written, but {written} were")
            if hasattr(sink, "commit"):
                sink.commit(last)
        if counts["failed"]:
            for r in window.where(F.col(ERR).isNotNull()).select(SEQ, ERR).orderBy(SEQ).toLocalIterator():
                show(f"Skipped bad record seq={r[SEQ]} error={r[ERR]}")
        summary.sinkBatches += made["batches"]
        summary.rowsWritten += made["rows"]
        summary.rowsRead += counts["read"]
        summary.rowsFailed += counts["failed"]
        summary.checkpointSeq = after = last
        if checkpoint:
            with stage("Checkpoint"):
                checkpoint.advance(last)
        release(out)


def _in_rounds(sink: object, flushes: Callable[[int, int], DataFrame], chain: Chain, checkpoint: Checkpoint, after: int, end: int, step: int, most: int, summary: Summary, show: Callable[[str], None]) -> None:
    """As :func:`_parallel`, but tasks make the rows of many commits at once, ``most`` source rows. Each commit is then made on its own.

    Where a round fails before its first commit, its commits are run one by one, up to the one that fails.
    """
    while after < end:
        first, last = after + 1, min(end, (after // most + 1) * most)
        window, out = flushes(first, last), None
        try:
            counts = {r["k"]: r for r in window.groupBy(commit_of(step).alias("k")).agg(F.count(SEQ).alias("read"), F.count(ERR).alias("failed")).collect()}  # a row a commit
            out = materialize(chain(window.where(F.col(ERR).isNull())).withColumn(POSITION, F.monotonically_increasing_id()))
            batches = out.groupBy(commit_of(step).alias("k"), *BATCH).agg(F.count("*").alias("n")).groupBy("k").agg(F.count("*").alias("batches"), F.sum("n").alias("rows"))
            made = {r["k"]: r for r in batches.collect()}
            written = sink.write_steps(out, step)
        except Exception:
            release(*([out] if out is not None else []))
            _parallel(sink, flushes, chain, checkpoint, after, last, step, summary, show)
            after = last
            continue
        failed = any(r["failed"] for r in counts.values())
        bad = window.where(F.col(ERR).isNotNull()).select(SEQ, ERR).orderBy(SEQ).toLocalIterator() if failed else iter(())
        for k in range(after // step, (last - 1) // step + 1):
            count, here, upto = counts[k], made.get(k), min(last, (k + 1) * step)
            with stage("Sink"):
                if here:
                    found = next(written, None)
                    if found != (k, here["rows"]):
                        raise PipelineError(f"{here['rows']} rows of commit {k} were to be written, but {found} were")
                sink.commit(upto)
            for r in islice(bad, count["failed"]):
                show(f"Skipped bad record seq={r[SEQ]} error={r[ERR]}")
            summary.sinkBatches += here["batches"] if here else 0
            summary.rowsWritten += here["rows"] if here else 0
            summary.rowsRead += count["read"]
            summary.rowsFailed += count["failed"]
            summary.checkpointSeq = after = upto
            with stage("Checkpoint"):
                checkpoint.advance(upto)
        with stage("Sink"):
            if next(written, None):
                raise PipelineError("more rows were written than were made")
        release(out)


def validate(spark: SparkSession, pipeline: Pipeline) -> list[str]:
    """Checks a pipeline without running it: lines to show. Databases and remote stores are not opened."""
    from loomline.sources.paths import is_remote

    deferred = pipeline.source.type != "file" or is_remote(pipeline.source.path)
    lines = [f"Pipeline valid: {pipeline.name}"]
    fields = "deferred"
    if not deferred:
        with stage("Source"):
            rows = open_source(exact_session(spark), pipeline.source)
        with stage("Transform"):
            chain = Chain(pipeline.transforms, rows.schema)
        with stage("Sink"):
            sinks.create(pipeline.sink, chain.schema, 0, lambda _: None)
        fields = str(len(rows.schema.fields))
    return [*lines, f"Source: {pipeline.source.type} fields={fields}", f"Transforms: {len(pipeline.transforms)}", f"Sink: {pipeline.sink.type}"]
