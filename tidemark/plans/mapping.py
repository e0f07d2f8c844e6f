"""Field mappings: which type and analyzer a column has, and how dotted paths reach into JSON columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """type: text, i64, u64, f64, bool, datetime, ip, bytes, json, concatenate.

    ``precision`` cuts datetime bounds (s, ms, us). A concatenate field holds the tokens of the fields in ``of``, by its own
    tokenizer. ``formats`` are the date patterns or the byte encoding (hex, base64) of the input.
    """

    type: str
    tokenizer: str = "default"
    record: str = "position"
    fast: bool = True
    precision: str = "us"
    path: str | None = None
    array: bool = False
    of: tuple[str, ...] = ()
    formats: tuple[str, ...] = ()
    with_dynamic: bool = False


@dataclass
class Mapping:
    """mode: strict (unknown fields are errors), lenient (unknown fields match nothing) or dynamic: unknown fields are looked
    up as paths in the column ``source``, the document's JSON text, and match nothing where there is no such column."""

    fields: dict[str, Field] = field(default_factory=dict)
    mode: str = "dynamic"
    default_fields: tuple[str, ...] = ()
    timestamp: str | None = None
    source: str | None = None

    @classmethod
    def infer(cls, df: DataFrame, **known: Field) -> Mapping:
        kinds = {T.StringType: "text", T.DoubleType: "f64", T.FloatType: "f64", T.BooleanType: "bool", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DateType: "datetime", T.BinaryType: "bytes"}
        out: dict[str, Field] = {}
        for f in df.schema.fields:
            array = isinstance(f.dataType, T.ArrayType)
            inner = f.dataType.elementType if array else f.dataType
            out[f.name] = known.get(f.name) or Field(kinds.get(type(inner), "json" if isinstance(inner, T.StructType | T.MapType) else "i64"), "raw" if array else "default", array=array)
        return cls(out, default_fields=tuple(n for n, f in out.items() if f.type == "text"))

    def find(self, name: str) -> tuple[Field, str, str | None] | None:
        """The field, its column and, within a JSON column, the path; None if there is no such field."""
        if name in self.fields:
            return self.fields[name], self.fields[name].path or name, None
        parts = name.split(".")
        for k in range(len(parts) - 1, 0, -1):
            top = ".".join(parts[:k])
            if top in self.fields:
                if self.fields[top].type != "json":
                    return None
                return self.fields[top], self.fields[top].path or top, "$." + ".".join(parts[k:])
        if self.mode == "dynamic" and self.source and not any(n.startswith(name + ".") for n in self.fields):
            return Field("json"), self.source, "$." + name
        if self.mode == "strict":
            raise KeyError(f"unknown field {name}")
        return None


def json_value(column: str, path: str) -> Column:
    """The value at a path of a JSON string column, as a string."""
    return F.get_json_object(F.col(f"`{column}`"), path)
