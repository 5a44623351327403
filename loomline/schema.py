"""Row types of a pipeline: checked names, and the three types that reach one."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, FloatType, LongType, StringType, StructField, StructType

from loomline.errors import PipelineError

LONG, STRING, VECTOR = LongType(), StringType(), ArrayType(FloatType(), containsNull=False)
#: Hidden columns of a running pipeline: number in source order, a record's error, and the flush it belongs to.
SEQ, ERR = "_seq", "_err"
BATCH = ("_b_split", "_b_part", "_b_no")
#: The piece of a source that a row comes from, and its place there; what numbers are made of.
PIECE, PLACE = "_s_piece", "_s_place"
HIDDEN = (SEQ, ERR, *BATCH, PIECE, PLACE)
#: Order of the output rows of one source row.
POSITION = "_b_pos"


def field(name: str, kind: DataType, description: str | None = None) -> StructField:
    return StructField(name, kind, True, {"comment": description} if description else None)


def row_type(fields: list[StructField]) -> StructType:
    """A struct type with checked names: not blank, no two alike (case counts)."""
    seen: set[str] = set()
    for f in fields:
        if not f.name or not f.name.strip():
            raise PipelineError("Field name must not be blank")
        if f.name in HIDDEN:
            raise PipelineError(f"Field name is reserved: {f.name}")
        if f.name in seen:
            raise PipelineError(f"Duplicate field name: {f.name}")
        seen.add(f.name)
    return StructType(fields)


def kind_name(kind: DataType) -> str:
    return "LONG" if kind == LONG else "STRING" if kind == STRING else "VECTOR" if isinstance(kind, ArrayType) else kind.simpleString().upper()


def require(schema: StructType, name: str, kind: str | None = None) -> StructField:
    """The field of a transform, of the kind it must have."""
    found = next((f for f in schema.fields if f.name == name), None)
    if found is None:
        raise PipelineError(f"Unknown transform field: {name}")
    if kind and kind_name(found.dataType) != kind:
        raise PipelineError(f"Transform field must be {kind}: {name}")
    return found
