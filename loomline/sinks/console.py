"""Sinks that print a line for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.config import Sink
from loomline.functions.strings import col
from loomline.schema import HIDDEN, kind_name
from loomline.sinks import require


class _Lines:
    def __init__(self, sink: Sink, schema: StructType, resume_from: int, show: Callable[[str], None]):
        self.schema, self.show = schema, show

    def open(self) -> None:
        pass

    def close(self) -> None:
        pass

    def render(self, df: DataFrame) -> DataFrame:
        return df.select(*[c for c in df.columns if c in HIDDEN or c.startswith("_b_")], self.line().alias("_line"))

    def write(self, rows: list, last_seq: int) -> None:
        for row in rows:
            self.show(row["_line"])


class Console(_Lines):
    """``[Row] a=1, b=x``; a vector shows as ``?``."""

    def line(self):  # noqa: ANN201
        shown = {"LONG": lambda c: c.cast("string"), "STRING": lambda c: c}
        parts = []
        for f in self.schema.fields:
            value = shown.get(kind_name(f.dataType), lambda c: F.lit("?"))(col(f.name))
            parts.append(F.concat(F.lit(f"{f.name}="), F.coalesce(value, F.lit("null"))))
        return F.concat(F.lit("[Row] "), F.concat_ws(", ", *parts))


class MockVector(_Lines):
    """The id, the vector's size and its first value."""

    def __init__(self, sink: Sink, schema: StructType, resume_from: int, show: Callable[[str], None]):
        require(schema, "id", "LONG", "Mock vector")
        require(schema, "embedding", "VECTOR", "Mock vector")
        super().__init__(sink, schema, resume_from, show)

    def line(self):  # noqa: ANN201
        first = F.format_string("%.4f", F.try_element_at(col("embedding"), F.lit(1)))
        return F.concat(F.lit("[AI Sink] Row ID: "), col("id").cast("string"), F.lit(", Vector Dim: "), F.size("embedding").cast("string"), F.lit(", First Val: "), first)
