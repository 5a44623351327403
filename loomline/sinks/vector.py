"""Vector stores. Rows are written by the tasks that made them; an upsert by id makes writing twice harmless."""

from __future__ import annotations

import json
import os
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.config import Sink
from loomline.errors import PipelineError
from loomline.functions.strings import col
from loomline.schema import kind_name
from loomline.sinks import require

POINT, VECTOR = "_point_id", "_vector"
#: Rows of a request at least. How rows are cut into requests changes nothing, as each is an upsert by id.
REQUEST_ROWS = 256


def payload_fields(sink: Sink, schema: StructType, label: str, with_id: bool) -> list[str]:
    """The chosen fields, or all but the vector (and, unless ``with_id``, the id), checked."""
    if sink.payload_fields is None:
        names = [f.name for f in schema.fields if kind_name(f.dataType) != "VECTOR" and (with_id or f.name != sink.id_field)]
    else:
        names = sink.payload_fields
    for i, name in enumerate(names):
        found = next((f for f in schema.fields if f.name == name), None)
        if name == sink.vector_field:
            raise PipelineError(f"{label} payload field must not be the vector field: {name}")
        if not with_id and name == sink.id_field:
            raise PipelineError(f"{label} payload field must not be the id field: {name}")
        if name in names[:i]:
            raise PipelineError(f"Duplicate {label} payload field: {name}")
        if found is None:
            raise PipelineError(f"{label} sink requires payload field: {name}")
        if kind_name(found.dataType) not in ("LONG", "STRING"):
            raise PipelineError(f"{label} sink does not support payload field type: {kind_name(found.dataType)}")
    return names


def batches(rows: Iterator[Row], size: int) -> Iterator[list[Row]]:
    batch: list[Row] = []
    for row in rows:
        batch.append(row)
        if len(batch) >= size:
            yield batch
            batch = []
    if batch:
        yield batch


def send(label: str, method: str, url: str, body: dict, headers: dict[str, str], timeout_ms: int) -> dict:
    request = urllib.request.Request(url, json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode(), {"Content-Type": "application/json", **headers}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout_ms / 1000) as answer:
            text = answer.read().decode(errors="replace")
    except urllib.error.HTTPError as e:
        raise PipelineError(f"{label} upsert failed with status {e.code}: {e.read().decode(errors='replace')[:1000]}") from None
    except OSError as e:
        raise PipelineError(f"{label} upsert failed: {e}") from None
    if not text.strip():
        raise PipelineError(f"{label} upsert returned empty response")
    try:
        found = json.loads(text)
        assert isinstance(found, dict)
        return found
    except (ValueError, AssertionError):
        raise PipelineError(f"{label} upsert returned invalid response: {text[:1000]}") from None


class _Store:
    label, with_id = "", True

    def __init__(self, sink: Sink, schema: StructType, resume_from: int, show: Callable[[str], None]):
        self.sink, self.schema = sink, schema
        require(schema, sink.id_field, "LONG", self.label)
        require(schema, sink.vector_field, "VECTOR", self.label)
        self.payload = payload_fields(sink, schema, self.label, self.with_id)

    def open(self) -> None:
        pass

    def close(self) -> None:
        pass

    def point_id(self):  # noqa: ANN201
        return col(self.sink.id_field)

    def write_table(self, df: DataFrame, batch_rows: int, first: int = 1) -> None:
        wanted = df.select(self.point_id().alias(POINT), col(self.sink.vector_field).alias(VECTOR), *map(col, dict.fromkeys(self.payload)))
        upsert, size = self.upsert, max(batch_rows, REQUEST_ROWS)

        def write(rows: Iterator[Row]) -> None:
            with upsert.opened() as send_batch:
                for batch in batches(rows, size):
                    send_batch(batch)

        wanted.foreachPartition(write)

    def key(self, label: str) -> str | None:
        """Read by the driver, so that a missing key fails before any job."""
        if not self.sink.key_env:
            return None
        value = os.environ.get(self.sink.key_env, "")
        if not value.strip():
            raise PipelineError(f"Missing {label} environment variable: {self.sink.key_env}")
        return value


class Qdrant(_Store):
    """Point ids are the id, or id x multiplier + chunk index; overflow and negative indexes are errors."""

    label = "Qdrant"

    def __init__(self, sink: Sink, schema: StructType, resume_from: int, show: Callable[[str], None]):
        super().__init__(sink, schema, resume_from, show)
        if not sink.collection.strip():
            raise PipelineError(f"Invalid qdrant collection: {sink.collection}")
        if sink.chunk_index_field:
            require(schema, sink.chunk_index_field, "LONG", self.label)
        key = self.key("Qdrant API key")
        place = urllib.parse.quote(sink.collection, safe="")
        self.url = f"{sink.url.rstrip('/')}/collections/{place}/points?wait={str(sink.wait).lower()}"
        self.upsert = _Qdrant(self.url, {"api-key": key} if key else {}, sink.timeout_ms, self.payload)

    def point_id(self):  # noqa: ANN201
        row_id = col(self.sink.id_field)
        if not self.sink.chunk_index_field:
            return row_id
        index, most = col(self.sink.chunk_index_field), F.lit(self.sink.chunk_id_multiplier).cast("bigint")
        negative = F.raise_error(F.concat(F.lit("Qdrant chunk index must not be negative: "), index.cast("string")))
        overflow = F.raise_error(
            F.concat(F.lit("Qdrant generated point id overflow for id "), row_id.cast("string"), F.lit(" and chunk index "), index.cast("string"))
        )
        whole = F.try_add(F.try_multiply(row_id, most), index)
        return F.when(index < 0, negative.cast("bigint")).when(whole.isNull() & row_id.isNotNull() & index.isNotNull(), overflow.cast("bigint")).otherwise(whole)


class _Http:
    """Requests need no connection that is kept."""

    def opened(self):  # noqa: ANN201
        return nullcontext(self)


class _Qdrant(_Http):
    def __init__(self, url: str, headers: dict[str, str], timeout_ms: int, payload: list[str]):
        self.url, self.headers, self.timeout_ms, self.payload = url, headers, timeout_ms, payload

    def body(self, rows: list[Row]) -> dict:
        return {"points": [{"id": r[POINT], "vector": list(r[VECTOR]), "payload": {n: r[n] for n in self.payload}} for r in rows]}

    def __call__(self, rows: list[Row]) -> None:
        answer = send("Qdrant", "PUT", self.url, self.body(rows), self.headers, self.timeout_ms)
        if answer.get("status") != "ok":
            raise PipelineError(f"Qdrant upsert returned status {answer.get('status')}")


class Milvus(_Store):
    label, with_id = "Milvus", False

    def __init__(self, sink: Sink, schema: StructType, resume_from: int, show: Callable[[str], None]):
        super().__init__(sink, schema, resume_from, show)
        key = self.key("Milvus token")
        headers = {"Authorization": f"Bearer {key}"} if key else {}
        self.upsert = _Milvus(f"{sink.url.rstrip('/')}/v2/vectordb/entities/upsert", headers, sink, self.payload)


class _Milvus(_Http):
    def __init__(self, url: str, headers: dict[str, str], sink: Sink, payload: list[str]):
        self.url, self.headers, self.sink, self.payload = url, headers, sink, payload

    def body(self, rows: list[Row]) -> dict:
        s = self.sink
        return {"collectionName": s.collection, "data": [{s.id_field: r[POINT], s.vector_field: list(r[VECTOR]), **{n: r[n] for n in self.payload}} for r in rows]}

    def __call__(self, rows: list[Row]) -> None:
        answer = send("Milvus", "POST", self.url, self.body(rows), self.headers, self.sink.timeout_ms)
        if answer.get("code") != 0:
            raise PipelineError(f"Milvus upsert returned code {answer.get('code')}")


class Pgvector(_Store):
    """Batched ``INSERT ... ON CONFLICT DO UPDATE`` by a DB-API connection that each task opens."""

    label, with_id = "Pgvector", False
    #: Opens a connection from (url, user, password, timeout in ms); tests and other drivers replace it.
    connect: Callable = None

    def __init__(self, sink: Sink, schema: StructType, resume_from: int, show: Callable[[str], None]):
        for what, name in (("table", sink.table), ("idField", sink.id_field), ("vectorField", sink.vector_field), *(("payloadFields", n) for n in sink.payload_fields or [])):
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name or ""):
                raise PipelineError(f"Invalid sink.{what}: {name}")
        super().__init__(sink, schema, resume_from, show)
        user, password = (os.environ.get(n) for n in (sink.user_env, sink.password_env))
        for name, value in ((sink.user_env, user), (sink.password_env, password)):
            if value is None:
                raise PipelineError(f"Missing pgvector environment variable: {name}")
        self.upsert = _Pgvector(type(self).connect or postgres_connection, (sink.url, user, password, sink.timeout_ms), upsert_sql(sink, self.payload), self.payload)


def upsert_sql(sink: Sink, payload: list[str]) -> str:
    names = [sink.id_field, sink.vector_field, *payload]
    marks = ", ".join(["?", "?::vector", *["?"] * len(payload)])
    updates = ", ".join(f"{n} = EXCLUDED.{n}" for n in names[1:])
    return f"INSERT INTO {sink.table} ({', '.join(names)}) VALUES ({marks}) ON CONFLICT ({sink.id_field}) DO UPDATE SET {updates}"


class _Pgvector:
    def __init__(self, connect: Callable, where: tuple, sql: str, payload: list[str]):
        self.connect, self.where, self.sql, self.payload = connect, where, sql, payload

    @contextmanager
    def opened(self):  # noqa: ANN201
        """One connection for all batches of a task, each batch a transaction."""
        try:
            connection = self.connect(*self.where)
        except Exception as e:
            raise PipelineError(f"Pgvector connection failed: {e}") from None
        try:
            yield lambda rows: self.write(connection, rows)
        finally:
            connection.close()

    def write(self, connection, rows: list[Row]) -> None:  # noqa: ANN001
        try:
            values = [(r[POINT], "[" + ",".join(repr(float(v)) for v in r[VECTOR]) + "]", *(r[n] for n in self.payload)) for r in rows]
            connection.cursor().executemany(self.sql, values)
            connection.commit()
        except Exception as e:
            raise PipelineError(f"Pgvector upsert failed: {e}") from None

    def __call__(self, rows: list[Row]) -> None:
        with self.opened() as write:
            write(rows)


def postgres_connection(url: str, user: str, password: str, timeout_ms: int):  # noqa: ANN201
    """A connection by an installed driver, with ``?`` for its placeholders."""
    import psycopg

    class Cursor(psycopg.Cursor):
        def executemany(self, sql: str, values: list) -> None:
            super().executemany(sql.replace("?", "%s"), values)

    return psycopg.connect(url.removeprefix("jdbc:"), user=user, password=password, connect_timeout=max(1, timeout_ms // 1000), cursor_factory=Cursor)
