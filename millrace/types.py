"""Column types of plans: their spelling, their Spark types and how text becomes values."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import IllegalSchema, UnknownComparison

#: strptime directives and Spark's date pattern letters (fixed values)
DIRECTIVES = {"d": "dd", "m": "MM", "Y": "yyyy", "y": "yy", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "b": "MMM", "e": "d", "%": "%"}


@dataclass(frozen=True)
class Field:
    """kind: int, long, dec, char or date. width: bytes in a packed row. pattern: of dates, as strptime has it."""

    kind: str
    width: int
    pattern: str = ""

    @property
    def spark(self) -> T.DataType:
        return {"int": T.IntegerType(), "long": T.LongType(), "dec": T.DoubleType(), "char": T.StringType(), "date": T.TimestampType()}[self.kind]

    @property
    def spark_pattern(self) -> str:
        def one(m: re.Match) -> str:
            if m[1] not in DIRECTIVES:
                raise IllegalSchema(f"date directive %{m[1]} is not supported")
            return DIRECTIVES[m[1]]

        return re.sub("%(.)", one, self.pattern)


def parse_type(text: str) -> Field:
    """`int`, `long`, `dec`, `char(n)` or `date(format)`; the name may be longer and in any case."""
    head, _, rest = text.partition("(")
    name, inside = head.strip().lower(), rest.rpartition(")")[0]
    if name.startswith("int"):
        return Field("int", 4)
    if name.startswith("long"):
        return Field("long", 8)
    if name.startswith("dec"):
        return Field("dec", 8)
    if name.startswith("char"):
        if not inside.strip().isdigit():
            raise IllegalSchema(f"char needs a width: {text!r}")
        return Field("char", int(inside) + 1)
    if name.startswith("date"):
        return Field("date", 8, inside.strip().strip("'\""))
    raise IllegalSchema(f"unknown type {text!r}")


def field_of(kind: T.DataType) -> Field:
    """The field for a column that came with a Spark type."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return Field("int", 4)
    if isinstance(kind, T.LongType):
        return Field("long", 8)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Field("dec", 8)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Field("date", 8, "%Y-%m-%d")
    return Field("char", 256)


def from_text(value: Column, field: Field, lenient: bool = False) -> Column:
    """A text field as a value. Lenient: a number is its leading digits, or 0; a bad date is null."""
    if field.kind == "char":
        return F.substring(value, 1, field.width - 1)
    if field.kind == "date":
        pattern = F.lit(field.spark_pattern)
        return F.try_to_timestamp(value, pattern) if lenient else F.to_timestamp(value, field.spark_pattern)
    if not lenient:
        return F.trim(value).cast(field.spark)
    shape = r"^\s*([+-]?[0-9]*\.?[0-9]*(?:[eE][+-]?[0-9]+)?)" if field.kind == "dec" else r"^\s*([+-]?[0-9]+)"
    return F.coalesce(F.regexp_extract(value, shape, 1).try_cast(field.spark), F.lit(0).cast(field.spark))


def literal(text: str, field: Field) -> Column:
    """A plan's literal read by the column's own type: "4.5" for an int column is 4."""
    if field.kind in ("int", "long"):
        found = re.match(r"\s*[+-]?\d+", text)
        return F.lit(int(found[0]) if found else 0).cast(field.spark)
    if field.kind == "dec":
        return F.lit(float(text))
    return from_text(F.lit(text), field)


NUMBERS = {"int", "long", "dec"}
OPERATORS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    "==": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
}


def compare(a: Column, op: str, b: Column, left: Field, right: Field) -> Column:
    """Numbers compare with each other, texts with texts, dates with dates."""
    if op.strip() not in OPERATORS:
        raise UnknownComparison(f"operator {op!r}")
    if left.kind != right.kind and not {left.kind, right.kind} <= NUMBERS:
        raise UnknownComparison(f"{left.kind} with {right.kind}")
    return OPERATORS[op.strip()](a, b)
