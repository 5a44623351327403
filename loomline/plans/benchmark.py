"""The benchmark of the command line: a checkpointed CSV -> embedding -> counting sink pipeline at several batch sizes."""

from __future__ import annotations

import csv
import io
import json
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from loomline import sinks
from loomline.config import Pipeline, Sink, Source, Transform
from loomline.plans.runner import run


class CountingSink:
    """Counts batches and rows."""

    def __init__(self, *_: object):
        self.batches = self.rows = 0
        CountingSink.last = self

    def open(self) -> None: ...
    def close(self) -> None: ...

    def write(self, rows: list, last_seq: int) -> None:
        self.batches += 1
        self.rows += len(rows)


def benchmark(spark: SparkSession, rows: int, batch_sizes: list[int], rows_per_split: int = 0) -> list[dict]:
    """One record of counters for each batch size. Embeddings are made natively, so calls are those that a batched provider would get."""
    sinks.register("counting", CountingSink)
    out = []
    for size in batch_sizes:
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder, "rows.csv")
            path.write_text("id,content\n" + "".join(f"{i},Document-{i}\n" for i in range(1, rows + 1)))
            source = Source("file", str(path), "csv", max_rows_per_split=rows_per_split)
            step = Transform("embedding", input="content", output="embedding", provider="mock", dimensions=4, batch_size=size)
            done = run(spark, Pipeline(f"benchmark-{size}", source, [step], Sink("counting"), f"{folder}/state"), lambda _: None)
            batches = CountingSink.last.batches
            out.append(
                {
                    "rowCount": rows, "batchSize": size, "durationMs": done.durationMs, "rowsPerSecond": round(1000 * rows / max(1, done.durationMs), 3),
                    "embeddingBatchCalls": batches, "embeddingSingleCalls": 0, "rowsEmbedded": CountingSink.last.rows, "sinkBatchWrites": batches,
                    "rowsWritten": CountingSink.last.rows, "checkpointUpdates": batches, "summaryRowsWritten": done.rowsWritten, "sourceSplits": done.sourceSplits, "sinkBatches": done.sinkBatches,
                }
            )
    return out


def render(records: list[dict], form: str) -> str:
    if form == "json":
        return json.dumps(records, indent=2)
    text = io.StringIO()
    writer = csv.DictWriter(text, list(records[0]), lineterminator="\n")
    writer.writeheader()
    writer.writerows(records)
    return text.getvalue().rstrip("\n")
