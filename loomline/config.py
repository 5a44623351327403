"""The pipeline file: a small line grammar that looks like YAML, and the rules its settings obey.

Grammar: an unindented ``key: value`` is a top-level setting and ``key:`` opens a section; lines
with two spaces belong to the section; in ``transforms`` an item starts with ``  - `` and goes on
with four spaces. Whole-line comments start with ``#``. Every value is a string; one pair of outer
quotes goes. Lists are written ``[a, b]``. Other lines are ignored, and of repeated keys the last counts.
"""

from __future__ import annotations

import os
import re
import urllib.parse
from collections.abc import Mapping
from dataclasses import dataclass
from dataclasses import field as default
from pathlib import Path

from loomline.errors import ConfigError

SOURCE_TYPES = ("file", "postgres", "mysql", "duckdb")
SINK_TYPES = ("console", "mock-vector", "file", "qdrant", "pgvector", "milvus")
VECTOR_SINKS = ("qdrant", "pgvector", "milvus")
FILTER_OPS = (
    "not-empty", "min-length", "contains", "starts-with", "ends-with", "equals", "not-equals",
    "greater-than", "greater-than-or-equal", "less-than", "less-than-or-equal",
)
#: Confines local paths to the pipeline file's folder (and the repository's state folder) where set to true.
RESTRICT = "LOOMLINE_RESTRICT_LOCAL_PATHS"
STATE_FOLDER = ".loomline"


@dataclass(frozen=True)
class Source:
    type: str
    path: str | None = None
    format: str | None = None
    document_type: str = "auto"
    max_rows_per_split: int = 0
    url: str | None = None
    user_env: str | None = None
    password_env: str | None = None
    query: str | None = None
    fetch_size: int = 0
    endpoint: str | None = None
    region: str | None = None
    access_key_env: str | None = None
    secret_key_env: str | None = None
    path_style: bool = True
    options: Mapping[str, str] = default(default_factory=dict)


@dataclass(frozen=True)
class Transform:
    type: str
    fields: list[str] = default(default_factory=list)
    field: str | None = None
    source: str | None = None
    target: str | None = None
    replacement: str = ""
    input: str | None = None
    output: str | None = None
    op: str | None = None
    value: str | None = None
    min_length: int = 0
    chunk_size: int = 0
    overlap: int = 0
    drop_input: bool = False
    include_offsets: bool = False
    provider: str = "mock"
    dimensions: int = 4
    batch_size: int = 32
    base_url: str | None = None
    model: str | None = None
    key_env: str | None = None
    timeout_ms: int = 30000
    options: Mapping[str, str] = default(default_factory=dict)


@dataclass(frozen=True)
class Sink:
    type: str
    path: str | None = None
    format: str | None = None
    mode: str = "overwrite"
    url: str | None = None
    collection: str | None = None
    table: str | None = None
    id_field: str | None = None
    vector_field: str | None = None
    payload_fields: list[str] | None = None
    key_env: str | None = None
    user_env: str | None = None
    password_env: str | None = None
    wait: bool = True
    timeout_ms: int = 30000
    chunk_index_field: str | None = None
    chunk_id_multiplier: int = 0
    options: Mapping[str, str] = default(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    name: str
    source: Source
    transforms: list[Transform]
    sink: Sink
    state_dir: str | None = None
    skip_bad_records: bool = False


# Grammar -------------------------------------------------------------------------------------

TOP = re.compile(r"(?P<key>[^:]*?)\s*:\s*(?P<value>.*)")


def _pair(text: str) -> tuple[str, str]:
    found = TOP.fullmatch(text.strip())
    return (found["key"].strip(), found["value"].strip()) if found else (text.strip(), "")


def unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" else value


def parse(text: str) -> tuple[dict[str, str], dict[str, dict[str, str]], list[dict[str, str]]]:
    """Top-level settings, sections, and the list of transforms."""
    top: dict[str, str] = {}
    sections: dict[str, dict[str, str]] = {}
    transforms: list[dict[str, str]] = []
    into: dict[str, str] | None = None
    listing = False
    for line in re.split(r"\r\n|\n|\r", text):
        if not line.strip() or line.strip().startswith("#"):
            continue
        if line[0] != " ":
            key, value = _pair(line)
            listing, into = key == "transforms" and not value, None
            if value:
                top[key] = unquoted(value)
            elif not listing:
                into = sections[key] = {}
        elif listing and line.startswith("  - "):
            into = {}
            transforms.append(into)
            key, value = _pair(line[4:])
            if key:
                into[key] = unquoted(value)
        elif into is not None and line.startswith("    " if listing else "  "):
            key, value = _pair(line)
            into[key] = unquoted(value)
    return top, sections, transforms


# Rules ---------------------------------------------------------------------------------------


class Settings:
    """Settings of one section with the checks that all sections share."""

    def __init__(self, values: Mapping[str, str], prefix: str):
        self.values, self.prefix = values, prefix

    def text(self, key: str) -> str | None:
        value = self.values.get(key)
        return value if value is not None and value.strip() else None

    def need(self, key: str, literal: bool = False) -> str:
        value = self.values.get(key)
        if value is None or (not value if literal else not value.strip()):
            raise ConfigError(f"Missing required field: {self.prefix}.{key}")
        return value

    def choice(self, key: str, allowed: tuple[str, ...], default: str | None = None) -> str:
        value = self.need(key) if default is None else self.text(key) or default
        if value not in allowed:
            raise ConfigError(f"Unsupported {self.prefix}.{key}: {value}")
        return value

    def refuse(self, message: str, *keys: str) -> None:
        for key in keys:
            if self.text(key):
                raise ConfigError(message.replace("{key}", key))

    def number(self, key: str, shown: str, least: int, default: int | None = None, most: int = 2**31 - 1) -> int:
        value = self.text(key)
        if value is None:
            if default is None:
                raise ConfigError(f"Missing required field: {self.prefix}.{key}")
            return default
        if not re.fullmatch(r"[+-]?\d+", value.strip()) or not least <= int(value) <= most:
            raise ConfigError(f"Invalid {shown}: {value}")
        return int(value)

    def flag(self, key: str, default: bool, message: str) -> bool:
        value = self.text(key)
        if value is not None and value not in ("true", "false"):
            raise ConfigError(f"{message}: {value}")
        return default if value is None else value == "true"

    def names(self, key: str) -> list[str] | None:
        value = self.text(key)
        if value is None:
            return None
        inner = value.strip()
        inner = inner[1:-1] if inner.startswith("[") and inner.endswith("]") else inner
        return [unquoted(v) for v in inner.split(",")] if inner.strip() else []


def scheme_of(path: str) -> str | None:
    """The lower-case scheme of a URI, or null for a bare path."""
    place = path.find("://")
    return path[:place].lower() if place > 0 else None


class Paths:
    """Local paths are relative to the pipeline file, and can be confined to its folder."""

    def __init__(self, config: Path | None, restricted: bool | None = None):
        self.folder = config.absolute().parent if config else None
        self.restricted = os.environ.get(RESTRICT, "").lower() == "true" if restricted is None else restricted

    def local(self, path: str, name: str) -> str:
        joined = path if os.path.isabs(path) or self.folder is None else os.path.join(self.folder, path)
        joined = joined if os.path.isabs(path) and not self.restricted else os.path.normpath(joined)
        self.check(joined, name)
        return joined

    def state(self, path: str | None) -> str | None:
        """The state folder is not put under the pipeline file's unless paths are confined."""
        if not path or not path.strip() or not self.restricted:
            return path or None
        base = self.root() if Path(path).parts[:1] == (STATE_FOLDER,) else self.folder or Path.cwd()
        joined = os.path.normpath(os.path.join(base, path))
        self.check(joined, "checkpoint.stateDir")
        return joined

    def root(self) -> Path:
        here = self.folder or Path.cwd()
        return next((p for p in (here, *here.parents) if (p / ".git").exists()), here)

    def check(self, path: str, name: str) -> None:
        if not self.restricted:
            return
        whole = Path(os.path.normpath(os.path.abspath(path)))
        if not any(whole.is_relative_to(a) for a in (self.folder or Path.cwd(), self.root() / STATE_FOLDER)):
            raise ConfigError(f"Local path escapes allowed directories: {name}")


JDBC_PREFIX = {"postgres": "jdbc:postgresql:", "mysql": "jdbc:mysql:", "duckdb": "jdbc:duckdb:"}
S3_KEYS = ("bucket", "prefix", "endpoint", "region", "accessKeyEnv", "secretKeyEnv", "pathStyleAccess")


def load_source(s: Settings, paths: Paths) -> Source:
    kind = s.values["type"]
    if kind != "file":
        s.refuse("source.path is only supported for local source types", "path")
        s.refuse("source.format is only supported for source.type: file", "format")
        if kind == "duckdb":
            s.refuse("source.{key} is not supported for source.type: duckdb", "userEnv", "passwordEnv")
        s.refuse("source.documentType is only supported for source.format: document", "documentType")
        s.refuse("source.maxRowsPerSplit is only supported for file formats csv and jsonl", "maxRowsPerSplit")
        url = (s.text("url") or JDBC_PREFIX[kind]) if kind == "duckdb" else s.need("url")
        if not url.startswith(JDBC_PREFIX[kind]):
            raise ConfigError(f"source.url for source.type {kind} must start with {JDBC_PREFIX[kind]}")
        user, password = (None, None) if kind == "duckdb" else (s.need("userEnv"), s.need("passwordEnv"))
        return Source(kind, url=url, user_env=user, password_env=password, query=s.need("query"), fetch_size=s.number("fetchSize", "source.fetchSize", 1, 0))
    s.refuse("source.{key} is only supported for JDBC source types", "url", "userEnv", "passwordEnv", "query", "fetchSize")
    raw = s.need("path")
    scheme = scheme_of(raw)
    if scheme not in (None, "file", "s3"):
        raise ConfigError(f"source.path storage scheme {scheme}:// is not {'yet ' if scheme == 'hdfs' else ''}supported")
    remote: dict = {}
    if scheme == "s3":
        form = s.choice("format", ("csv", "jsonl", "document"))
        for key in ("bucket", "prefix"):
            s.refuse(f"source.{key} is not supported for source.type: file; put the {key} in the s3:// path", key)
        remote = {"endpoint": s.need("endpoint"), "region": s.need("region"), "access_key_env": s.need("accessKeyEnv"), "secret_key_env": s.need("secretKeyEnv")}
        remote["path_style"] = s.flag("pathStyleAccess", True, "Unsupported source.pathStyleAccess")
        path = raw
    else:
        s.refuse("source.{key} is only supported for s3:// paths", *S3_KEYS)
        path = paths.local(urllib.parse.unquote(urllib.parse.urlparse(raw).path) if scheme == "file" else raw, "source.path")
        form = s.choice("format", ("csv", "jsonl", "document"))
    if form == "document":
        s.refuse("source.maxRowsPerSplit is only supported for file formats csv and jsonl", "maxRowsPerSplit")
        return Source("file", path, form, s.choice("documentType", ("auto", "text", "markdown", "pdf"), "auto"), **remote)
    s.refuse("source.documentType is only supported for source.format: document", "documentType")
    return Source("file", path, form, max_rows_per_split=s.number("maxRowsPerSplit", "source.maxRowsPerSplit", 1, 0), **remote)


def load_sink(s: Settings, paths: Paths) -> Sink:
    kind = s.values["type"]
    if kind not in VECTOR_SINKS:
        s.refuse("sink.timeoutMs is only supported for sink.type: qdrant, pgvector, or milvus", "timeoutMs")
        s.refuse("sink.{key} is only supported for sink.type: qdrant", "chunkIndexField", "chunkIdMultiplier")
        s.refuse("sink.payloadFields is only supported for sink.type: qdrant, pgvector, or milvus", "payloadFields")
        if kind != "file":
            return Sink(kind, options=dict(s.values))
        path = paths.local(s.need("path"), "sink.path")
        return Sink(kind, path, s.choice("format", ("csv", "jsonl")), s.choice("mode", ("overwrite", "append"), "overwrite"))
    chunk_index, multiplier = None, 0
    wait = True
    if kind == "qdrant":
        wait = s.choice("wait", ("true", "false"), "true") == "true"
        chunk_index = s.text("chunkIndexField")
        if not chunk_index and s.text("chunkIdMultiplier"):
            raise ConfigError("sink.chunkIdMultiplier requires sink.chunkIndexField")
        multiplier = s.number("chunkIdMultiplier", "sink.chunkIdMultiplier", 1, 1_000_000, 2**63 - 1) if chunk_index else 0
    else:
        s.refuse("sink.{key} is only supported for sink.type: qdrant", "chunkIndexField", "chunkIdMultiplier")
    id_field, vector_field = s.need("idField"), s.need("vectorField")
    payload = s.names("payloadFields")
    for i, name in enumerate(payload or []):
        if name in payload[:i]:
            raise ConfigError(f"Duplicate value in sink.payloadFields: {name}")
        if name == vector_field:
            raise ConfigError(f"sink.payloadFields must not include sink.vectorField: {name}")
    target = {"table": s.need("table"), "user_env": s.need("userEnv"), "password_env": s.need("passwordEnv")} if kind == "pgvector" else {"collection": s.need("collection"), "key_env": s.text("apiKeyEnv")}
    timeout = s.number("timeoutMs", "sink.timeoutMs", 1, 30000)
    return Sink(
        kind, url=s.need("url"), id_field=id_field, vector_field=vector_field, payload_fields=payload, wait=wait, timeout_ms=timeout,
        chunk_index_field=chunk_index, chunk_id_multiplier=multiplier, **target,
    )


def load_transform(values: Mapping[str, str], place: str) -> Transform:
    s = Settings(values, place)
    kind = s.need("type")
    number = lambda key, least, default=None, most=2**31 - 1: s.number(key, f"transform.{key}", least, default, most)
    if kind == "select":
        names = s.names("fields")
        if not names or any(not n.strip() for n in names):
            raise ConfigError(f"Missing required field: {place}.fields")
        return Transform(kind, fields=names)
    if kind == "rename":
        return Transform(kind, source=s.need("from"), target=s.need("to"))
    if kind in ("trim", "lowercase"):
        return Transform(kind, field=s.need("field"))
    if kind == "replace":
        return Transform(kind, field=s.need("field"), target=s.need("target", literal=True), replacement=values.get("replacement") or "")
    if kind == "filter":
        op = s.choice("op", FILTER_OPS)
        least = number("minLength", 0) if op == "min-length" else 0
        value = s.need("value") if op not in ("not-empty", "min-length") else None
        if "than" in op and (not re.fullmatch(r"[+-]?\d+", value.strip()) or not -(2**63) <= int(value) < 2**63):
            raise ConfigError(f"Invalid transform.value: {value}")
        return Transform(kind, field=s.need("field"), op=op, value=value, min_length=least)
    if kind == "chunk":
        size, overlap = number("chunkSize", 1), number("overlap", 0, 0)
        if overlap >= size:
            raise ConfigError("transform.overlap must be smaller than transform.chunkSize")
        drop = s.flag("dropInput", False, "Invalid transform.dropInput")
        offsets = s.flag("includeOffsets", False, "Invalid transform.includeOffsets")
        return Transform(kind, input=s.need("input"), output=s.need("output"), chunk_size=size, overlap=overlap, drop_input=drop, include_offsets=offsets)
    if kind == "mock-embedding":
        return Transform(kind, input=s.need("input"), output=s.need("output"), dimensions=number("dimensions", 1, 4), batch_size=number("batchSize", 1, 32))
    if kind == "embedding":
        provider = s.choice("provider", ("mock", "openai-compatible"))
        common = {"input": s.need("input"), "output": s.need("output"), "batch_size": number("batchSize", 1, 32), "provider": provider}
        if provider == "mock":
            return Transform(kind, dimensions=number("dimensions", 1, 4), **common)
        url = s.text("baseUrl") or "https://api.openai.com/v1"
        return Transform(
            kind, dimensions=number("dimensions", 1, 0), timeout_ms=number("timeoutMs", 1, 30000), base_url=url, model=s.need("model"), key_env=s.need("apiKeyEnv"), **common
        )
    from loomline.operators import transforms

    if kind in transforms.TRANSFORMS:  # a registered one reads its own options
        return Transform(kind, options=dict(values))
    raise ConfigError(f"Unsupported transform.type: {kind}")


def loads(text: str, path: Path | None = None, restricted: bool | None = None) -> Pipeline:
    """The pipeline of a file's text. ``path`` is where relative paths start from."""
    from loomline import sinks, sources

    top, sections, items = parse(text)
    if not top.get("name", "").strip():
        raise ConfigError("Missing required field: name")
    for name in ("source", "sink"):
        if not sections.get(name):
            raise ConfigError(f"Missing required field: {name}")
    source, sink, paths = Settings(sections["source"], "source"), Settings(sections["sink"], "sink"), Paths(path, restricted)
    source.need("type"), sink.need("type")
    if source.values["type"] == "document-directory":
        raise ConfigError("source.type document-directory has been replaced by source.type: file with format: document")
    if source.values["type"] == "s3":
        raise ConfigError("source.type s3 has been replaced by source.type: file with an s3:// path")
    source.choice("type", (*SOURCE_TYPES, *sources.REGISTERED))
    sink.choice("type", (*SINK_TYPES, *sinks.REGISTERED))
    registered = source.values["type"] in sources.REGISTERED
    loaded = Source(source.values["type"], options=dict(source.values)) if registered else load_source(source, paths), load_sink(sink, paths)
    policy = Settings(sections.get("errorPolicy", {}), "errorPolicy").choice("mode", ("fail-fast", "skip-bad-records"), "fail-fast")
    state = paths.state(sections.get("checkpoint", {}).get("stateDir"))
    transforms = [load_transform(t, f"transforms[{i}]") for i, t in enumerate(items)]
    return Pipeline(top["name"], loaded[0], transforms, loaded[1], state, policy == "skip-bad-records")


def load(path: str | Path, restricted: bool | None = None) -> Pipeline:
    path = Path(path)
    if not path.is_file():
        raise ConfigError(f"Pipeline config not found: {path}")
    try:
        text = path.read_text("utf-8")
    except (OSError, UnicodeDecodeError):
        raise ConfigError(f"Failed to read pipeline config: {path}") from None
    return loads(text, path, restricted)
