"""Row transforms as functions of DataFrames, built from native expressions.

A transform is made from its settings and the row type before it, checks both, and gives a
function of the DataFrame and the row type after it. Hidden columns (``_seq``, ``_err``) pass.
Null strings pass trim, lowercase and replace as null, never pass a filter, and chunk to no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.config import Transform
from loomline.errors import PipelineError
from loomline.functions.strings import col, trimmed, utf16_length
from loomline.operators import embedding
from loomline.schema import BATCH, HIDDEN, LONG, STRING, VECTOR, field, kind_name, require, row_type

Step = tuple[Callable[[DataFrame], DataFrame], StructType]


def _hidden(df: DataFrame) -> list[Column]:
    return [F.col(h) for h in HIDDEN if h in df.columns]


def _others(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HIDDEN]


def _copied(schema: StructType) -> None:
    for f in schema.fields:
        if kind_name(f.dataType) not in ("LONG", "STRING", "VECTOR"):
            raise PipelineError(f"Unsupported transform data type: {kind_name(f.dataType)}")


def select(t: Transform, schema: StructType) -> Step:
    for i, name in enumerate(t.fields):
        if name in t.fields[:i]:
            raise PipelineError(f"Duplicate transform field: {name}")
    chosen = [require(schema, name) for name in t.fields]
    _copied(StructType(chosen))
    return lambda df: df.select(*_hidden(df), *map(col, t.fields)), row_type(chosen)


def rename(t: Transform, schema: StructType) -> Step:
    old = require(schema, t.source)
    if t.target != t.source and t.target in schema.fieldNames():
        raise PipelineError(f"Duplicate transform field: {t.target}")
    out = [field(t.target, old.dataType) if f is old else f for f in schema.fields]
    named = lambda c: col(c).alias(t.target) if c == t.source else col(c)
    return lambda df: df.select(*_hidden(df), *map(named, _others(df))), row_type(out)


def _in_place(t: Transform, schema: StructType, change: Callable[[Column], Column]) -> Step:
    require(schema, t.field, "STRING")
    changed = lambda c: change(col(c)).alias(c) if c == t.field else col(c)
    return lambda df: df.select(*_hidden(df), *map(changed, _others(df))), schema


def trim(t: Transform, schema: StructType) -> Step:
    """Takes away every character up to U+0020 at both ends, and no other white space."""
    return _in_place(t, schema, trimmed)


def lowercase(t: Transform, schema: StructType) -> Step:
    return _in_place(t, schema, F.lower)


def replace(t: Transform, schema: StructType) -> Step:
    """Replaces a literal, from the left, without overlaps."""
    if not t.target:
        raise PipelineError("Replace target must not be empty")
    return _in_place(t, schema, lambda c: F.replace(c, F.lit(t.target), F.lit(t.replacement)))


#: Predicates over a string column and their operand, and over a number.
TEXT_PREDICATES: dict[str, Callable[[Column, Transform], Column]] = {
    "not-empty": lambda c, t: F.length(trimmed(c)) > 0,
    "min-length": lambda c, t: utf16_length(trimmed(c)) >= t.min_length,
    "contains": lambda c, t: c.contains(t.value),
    "starts-with": lambda c, t: c.startswith(t.value),
    "ends-with": lambda c, t: c.endswith(t.value),
    "equals": lambda c, t: c == t.value,
    "not-equals": lambda c, t: c != t.value,
}
LONG_PREDICATES: dict[str, Callable[[Column, int], Column]] = {
    "greater-than": lambda c, v: c > v,
    "greater-than-or-equal": lambda c, v: c >= v,
    "less-than": lambda c, v: c < v,
    "less-than-or-equal": lambda c, v: c <= v,
}


def filter_rows(t: Transform, schema: StructType) -> Step:
    """Keeps the rows that satisfy one predicate. Predicates are native, so Catalyst pushes them below what made the rows."""
    if t.op in LONG_PREDICATES:
        require(schema, t.field, "LONG")
        if t.value is None:
            raise PipelineError(f"Filter value is required for {t.op}")
        try:
            bound = int(t.value)
        except ValueError:
            raise PipelineError(f"Filter value must be LONG: {t.value}") from None
        return lambda df: df.where(LONG_PREDICATES[t.op](col(t.field), bound)), schema
    if t.op not in TEXT_PREDICATES:
        raise PipelineError(f"Unsupported filter op: {t.op}")
    require(schema, t.field, "STRING")
    if t.value is None and t.op not in ("not-empty", "min-length"):
        raise PipelineError(f"Filter value is required for {t.op}")
    return lambda df: df.where(TEXT_PREDICATES[t.op](col(t.field), t)), schema


def chunk(t: Transform, schema: StructType) -> Step:
    """One row for each window of ``chunk_size`` UTF-16 units, ``chunk_size - overlap`` apart; the last ends with the text.

    Native as long as a text has no supplementary character, where UTF-16 units are characters;
    the others are cut by units in an Arrow batch function, half a pair becoming ``?``.
    """
    size, overlap = t.chunk_size, t.overlap
    if size <= 0:
        raise PipelineError("chunkSize must be positive")
    if overlap < 0:
        raise PipelineError("overlap must not be negative")
    if overlap >= size:
        raise PipelineError("overlap must be smaller than chunkSize")
    require(schema, t.input, "STRING")
    added = [t.output, "chunk_index", *(["chunk_start", "chunk_end"] if t.include_offsets else [])]
    kept = [f for f in schema.fields if not (t.drop_input and f.name == t.input)]
    for name in added:
        if name in [f.name for f in kept] or added.count(name) > 1:
            raise PipelineError(f"Duplicate transform field: {name}")
    _copied(StructType(kept))
    out = row_type([*kept, field(t.output, STRING), *(field(n, LONG) for n in added[1:])])
    step = size - overlap
    windows = _windows_of_units(size, step)

    def run(df: DataFrame) -> DataFrame:
        text = col(t.input)
        length = F.length(text).cast("bigint")
        count = F.when(length <= size, F.lit(1).cast("bigint")).otherwise(F.ceil((length - overlap) / step))
        native = F.transform(
            F.sequence(F.lit(0).cast("bigint"), count - 1),
            lambda i: F.struct(
                F.substr(text, (i * step + 1).cast("int"), F.lit(size)).alias("text"),
                i.alias("index"),
                (i * step).alias("start"),
                F.least(i * step + size, length).alias("end"),
            ),
        )
        wide = length != utf16_length(text)
        pieces = F.when(wide, windows(F.when(wide, text))).when(length > 0, native)
        rows = df.withColumn("_piece", F.explode(pieces))
        columns = [F.col("_piece.text").alias(t.output), F.col("_piece.index").alias("chunk_index")]
        if t.include_offsets:
            columns += [F.col("_piece.start").alias("chunk_start"), F.col("_piece.end").alias("chunk_end")]
        return rows.select(*_hidden(df), *(col(f.name) for f in kept), *columns)

    return run, out


def _windows_of_units(size: int, step: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<struct<text: string, index: bigint, start: bigint, end: bigint>>")
    def windows(texts):  # noqa: ANN001, ANN202
        def cut(text: str | None) -> list[dict] | None:
            if text is None:
                return None
            units, out, start = text.encode("utf-16-le"), [], 0
            total = len(units) // 2
            while total:
                end = min(start + size, total)
                part = units[2 * start : 2 * end].decode("utf-16-le", "surrogatepass")
                shown = "".join("?" if 0xD800 <= ord(c) < 0xE000 else c for c in part)
                out.append({"text": shown, "index": len(out), "start": start, "end": end})
                if end == total:
                    break
                start += step
            return out

        return texts.map(cut)

    return windows


def mock_embedding(t: Transform, schema: StructType) -> Step:
    """Appends ``dimensions`` numbers: the text's length and those that follow."""
    out = _with_vector(t, schema)
    values = lambda c: F.transform(F.sequence(F.lit(0), F.lit(t.dimensions - 1)), lambda i: (utf16_length(c) + i).cast("float"))
    return lambda df: df.withColumn(t.output, values(col(t.input))), out


def embed(t: Transform, schema: StructType) -> Step:
    """Appends the vector of a provider, asked by every task of its own.

    In a pipeline it is asked once for each flush, that is for all texts that ``batch_size`` source
    rows have become, whatever Arrow's own batches; a flush that two tasks share is asked for in two
    parts. Without flushes, ``batch_size`` texts are sent at a time. No text, no call.
    """
    if t.provider == "mock":
        return mock_embedding(t, schema)
    if t.batch_size <= 0:
        raise PipelineError("batchSize must be positive")
    out = _with_vector(t, schema)
    provider = embedding.create(t)

    def run(df: DataFrame) -> DataFrame:
        names = df.columns
        place = names.index(t.input)
        keys = [names.index(c) for c in BATCH] if set(BATCH) <= set(names) else []

        def asked(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [text for part in parts for text in part.column(place).to_pylist()]
            vectors = provider(texts)
            if len(vectors) != len(texts):
                raise PipelineError(f"Embedding provider returned {len(vectors)} vectors for {len(texts)} inputs")
            start = 0
            for part in parts:
                some = vectors[start : start + part.num_rows]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(some, pa.list_(pa.float32()))], [*names, t.output])
                start += part.num_rows

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                for start in range(0, batch.num_rows, t.batch_size):
                    yield from asked([batch.slice(start, t.batch_size)])

        def flushes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[pa.RecordBatch] = []
            flush = None
            for batch in source:
                found = list(zip(*(batch.column(k).to_pylist() for k in keys)))
                start = 0
                for i, key in enumerate(found):
                    if key != flush:
                        if i > start:
                            waiting.append(batch.slice(start, i - start))
                        if waiting:
                            yield from asked(waiting)
                        waiting, start, flush = [], i, key
                if start < len(found):
                    waiting.append(batch.slice(start))
            if waiting:
                yield from asked(waiting)

        return df.mapInArrow(flushes if keys else batches, StructType([*df.schema.fields, field(t.output, VECTOR)]))

    return run, out


def _with_vector(t: Transform, schema: StructType) -> StructType:
    require(schema, t.input, "STRING")
    if t.output in schema.fieldNames():
        raise PipelineError(f"Duplicate transform field: {t.output}")
    _copied(schema)
    return row_type([*schema.fields, field(t.output, VECTOR)])


#: Transforms by type. Further ones are added by :func:`register`.
TRANSFORMS: dict[str, Callable[[Transform, StructType], Step]] = {
    "select": select,
    "rename": rename,
    "trim": trim,
    "lowercase": lowercase,
    "replace": replace,
    "filter": filter_rows,
    "chunk": chunk,
    "mock-embedding": mock_embedding,
    "embedding": embed,
}


def register(name: str, make: Callable[[Transform, StructType], Step]) -> None:
    TRANSFORMS[name] = make


class Chain:
    """The transforms of a pipeline in their order, checked against the source's row type before any row flows."""

    def __init__(self, transforms: list[Transform], schema: StructType):
        self.steps, self.schema = [], schema
        for t in transforms:
            if t.type not in TRANSFORMS:
                raise PipelineError(f"Unsupported transform.type: {t.type}")
            step, self.schema = TRANSFORMS[t.type](t, self.schema)
            self.steps.append(step)
        preferred = [t.batch_size for t in transforms if t.type in ("embedding", "mock-embedding")]
        #: Source rows of a flush: the least that a transform prefers, 1 where none does.
        self.batch_size = min(preferred, default=1)

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df
