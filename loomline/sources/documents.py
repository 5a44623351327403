"""Documents of a folder or a single file: text, Markdown and PDF, one row each."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.config import Source
from loomline.errors import PipelineError
from loomline.plans.lineage import materialize
from loomline.schema import ERR, LONG, PIECE, PLACE, SEQ, STRING, field, row_type
from loomline.sources import Numbered, Rows, paths, placed

# Extensions of each kind of document.
EXTENSIONS = {"text": (".txt",), "markdown": (".md", ".markdown"), "pdf": (".pdf",)}
SCHEMA = row_type([field("id", LONG), field("path", STRING), field("content", STRING)])


def wanted(path: str, kind: str) -> bool:
    allowed = sum(EXTENSIONS.values(), ()) if kind == "auto" else EXTENSIONS[kind]
    return path.lower().endswith(allowed)


#: Folders that a local tree is cut into at least, where it has as many, for tasks to list.
FOLDERS = 256
#: Folders that the driver lists at most; where there are more of them on one level, tasks list that level.
MOST_FOLDERS = 10_000
#: Files, and characters of texts, that are enough for one batch of rows.
FILES, CHARACTERS = 1000, 1 << 20


def read(spark: SparkSession, source: Source) -> Rows:
    """(id, path, content) of the supported documents, sorted by relative path; one split. Names with a leading dot or underscore count in local folders.

    The driver knows folders only: tasks list them, read the documents and extract their texts. A
    document that can't be read is a bad record; a PDF without text gives an empty content.
    """
    kind, suffix = source.document_type, "" if source.document_type == "auto" else f" (documentType: {source.document_type})"
    root, remote = source.path.removeprefix("file://"), paths.is_remote(source.path)
    if not remote:
        if not os.path.exists(root):
            raise PipelineError(f"Document path not found: {root}")
        if os.path.isfile(root) and not wanted(root, kind):
            raise PipelineError(f"Document file is not a supported document: {root}{suffix}")
        if not os.path.isfile(root) and not any(wanted(name, kind) for name in _names(root)):
            raise PipelineError(f"Document directory has no supported documents: {source.path}{suffix}")

    def number() -> Numbered:
        found = _remote(spark, source.path) if remote else _local(spark, root)
        supported = F.lower("path").rlike("(" + "|".join(re.escape(e) for e in (sum(EXTENSIONS.values(), ()) if kind == "auto" else EXTENSIONS[kind])) + r")\z")
        # Paths are sorted by UTF-16 units.
        ordered = placed(found.where(supported).withColumn("_order", F.encode("path", "UTF-16BE")).orderBy("_order").drop("_order"))
        kept = f"{PIECE} string, {PLACE} bigint, {ERR} string, path string, content string"
        numbered = Numbered(materialize(ordered.select(PIECE, PLACE, "path", "full", "data").mapInArrow(extract, kept)))
        if not numbered.total:
            raise PipelineError(f"Document directory has no supported documents: {source.path}{suffix}")
        return numbered

    return Rows(number, SCHEMA, "document", finish=lambda rows: rows.select(SEQ, ERR, F.col(SEQ).alias("id"), "path", "content"))


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, texts, errors, size = 0, [], [], 0
        for i in range(batch.num_rows):  # contents can be large: a batch ends where it has enough of them
            rel, full, data = (batch.column(c)[i].as_py() for c in (2, 3, 4))
            text = error = None
            try:
                if data is None:
                    with open(full, "rb") as f:
                        data = f.read()
                text = document_text(rel, data)
            except Exception as e:
                error = f"Document source read failed at {rel}: {str(e).strip() or type(e).__name__}"
            texts.append(text)
            errors.append(error)
            size += len(text or "")
            if size >= CHARACTERS or i + 1 == batch.num_rows:
                done = batch.slice(first, i + 1 - first)
                yield pa.RecordBatch.from_arrays([done.column(0), done.column(1), pa.array(errors, pa.string()), done.column(2), pa.array(texts, pa.string())], [PIECE, PLACE, ERR, "path", "content"])
                first, texts, errors, size = i + 1, [], [], 0


def _raise(e: OSError) -> None:
    raise e


def _names(root: str) -> Iterator[str]:
    try:
        for _, _, files in os.walk(root, onerror=_raise):
            yield from files
    except OSError as e:
        raise PipelineError(f"Document directory scan failed: {root}: {e}") from None


def _local(spark: SparkSession, root: str) -> DataFrame:
    """(path, full, data) of all files of a local tree. The driver looks for folders until there are enough of them for tasks to go through."""
    if os.path.isfile(root):
        return spark.createDataFrame([(os.path.basename(root), root, None)], "path string, full string, data binary")
    tasks = 4 * spark.sparkContext.defaultParallelism
    whole, flat, shares = [root], [], 1
    while whole and len(whole) < FOLDERS:
        below = list(islice((e.path for folder in whole for e in os.scandir(folder) if e.is_dir(follow_symlinks=False)), MOST_FOLDERS + 1))
        if len(below) > MOST_FOLDERS:
            shares = min(tasks, FOLDERS)
            break
        flat, whole = flat + whole, below
    listed = spark.createDataFrame([(f, k, shares) for f in whole for k in range(shares)] + [(f, 0, 0) for f in flat], "folder string, share int, shares int")

    def files_of(folder: str, share: int, shares: int) -> Iterator[tuple[str, list[str]]]:
        """(folder, names of its files): of a folder alone where it has no shares, of all below it where it has one, else of a share of the folders in it."""
        if shares == 1:
            yield from ((at, files) for at, _, files in os.walk(folder, onerror=_raise))
            return
        at, folders, files = next(os.walk(folder, onerror=_raise))
        if share == 0:
            yield at, files
        for name in folders if shares else []:
            below = os.path.join(at, name)
            if crc32(os.fsencode(name)) % shares == share and not os.path.islink(below):
                yield from ((at, files) for at, _, files in os.walk(below, onerror=_raise))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rel, full = [], []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(rel, pa.string()), pa.array(full, pa.string()), pa.nulls(len(full), pa.binary())], ["path", "full", "data"])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    for at, files in files_of(*row):
                        inside = os.path.relpath(at, root).replace(os.sep, "/") if files else ""
                        full += [os.path.join(at, f) for f in files]
                        rel += files if inside == "." else [f"{inside}/{f}" for f in files]
                        if len(full) >= FILES:
                            yield made()
                            rel, full = [], []
                except OSError as e:
                    raise PipelineError(f"Document directory scan failed: {root}: {e}") from None
        yield made()

    return listed.repartition(min(len(whole) * shares + len(flat), tasks)).mapInArrow(walk, "path string, full string, data binary")


def _remote(spark: SparkSession, path: str) -> DataFrame:
    """(path, full, data) of the files of a remote folder, listed and read by Spark."""
    root = paths.spark_path(path).rstrip("/")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except Exception as e:
        raise PipelineError(f"S3 source list failed: {e}") from None
    full = F.col("path")
    rel = F.when(full.startswith(root + "/"), F.substr(full, F.lit(len(root) + 2))).otherwise(F.substring_index(full, "/", -1))
    return files.select(rel.alias("path"), full.alias("full"), F.col("content").alias("data"))


def document_text(path: str, data: bytes) -> str:
    """Text of a document; for PDF by an installed library where there is one, else by the small extractor below."""
    if not path.lower().endswith(".pdf"):
        return data.decode("utf-8", "replace")
    try:
        import pypdf
    except ImportError:
        from loomline.sources.pdf import pdf_text

        return pdf_text(data)
    import io

    return "".join((page.extract_text() or "") + "\n" for page in pypdf.PdfReader(io.BytesIO(data)).pages)
