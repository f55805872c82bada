"""Types of the language, and the conversions between them as Spark SQL texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .syntax import PipelineError

NAMED = {"bool": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "datetime": T.TimestampType()}
RANK = {T.ByteType: 0, T.ShortType: 0, T.IntegerType: 0, T.LongType: 1, T.FloatType: 2, T.DoubleType: 3}
NULL = T.NullType()
BOOL, INT, LONG, FLOAT, DOUBLE, STRING, TIME = (NAMED[n] for n in ("bool", "int", "long", "float", "double", "string", "datetime"))


@dataclass(frozen=True)
class Ex:
    """A bound expression: SQL text of its value, its type, and SQL text of its error (a string or null), if it can have one.

    simple: a column or a literal, which may stand in a text many times. level: how many steps of bound columns it needs.
    """

    sql: str
    type: T.DataType
    err: str | None = None
    simple: bool = False
    level: int = 0


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_numeric(t) -> bool:
    return type(t) in RANK or isinstance(t, T.DecimalType)


def is_integral(t) -> bool:
    return RANK.get(type(t), 9) <= 1


def is_time(t) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_array(t) -> bool:
    return isinstance(t, T.ArrayType)


def is_object(t) -> bool:
    return isinstance(t, (T.MapType, T.StructType, T.VariantType))


def is_null(t) -> bool:
    return isinstance(t, T.NullType)


def kind(t) -> str:
    """The language's name of a Spark type."""
    for name, n in NAMED.items():
        if t == n:
            return name
    if is_numeric(t):
        return "double" if isinstance(t, T.DecimalType) else "int"
    return "array" if is_array(t) else "object" if is_object(t) else "datetime" if is_time(t) else "null" if is_null(t) else "dynamic"


def promote(a, b):
    """Of two numeric types: int, long, float with float, else double."""
    ra, rb = RANK.get(type(a), 3), RANK.get(type(b), 3)
    if ra == rb == 2:
        return FLOAT
    return DOUBLE if max(ra, rb) >= 2 else LONG if max(ra, rb) == 1 else INT


def common(types: list):
    """A type that holds all branches of a conditional."""
    out = NULL
    for t in types:
        if is_null(out) or t == out:
            out = t
        elif not is_null(t):
            if is_numeric(t) and is_numeric(out):
                out = promote(t, out)
            elif is_time(t) and is_time(out):
                out = TIME
            elif is_array(t) and is_array(out):
                out = T.ArrayType(common([out.elementType, t.elementType]))
            else:
                raise PipelineError(f"branches of types {kind(out)} and {kind(t)}")
    return out


PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def parse_time(sql: str) -> str:
    return "coalesce(" + ", ".join(f"try_to_timestamp({sql}, '{p}')" for p in PATTERNS) + ")"


def show_time(sql: str) -> str:
    return f"date_format({sql}, 'yyyy-MM-dd HH:mm:ss')"


def number_text(sql: str, t) -> str:
    """Numbers as text; a whole double prints without its fraction."""
    return f"regexp_replace(cast({sql} as string), '\\\\.0$', '')" if not is_integral(t) else f"cast({sql} as string)"


def strict(sql: str, src, dst) -> str | None:
    """Numbers to numbers, text and time to each other; None where the strict rules have no such cast."""
    if src == dst or is_null(src):
        return f"cast({sql} as {dst.simpleString()})" if is_null(src) else sql
    if is_numeric(src) and is_numeric(dst):
        return f"try_cast({sql} as {dst.simpleString()})"
    if is_time(dst):
        return f"cast({sql} as timestamp)" if is_time(src) else parse_time(sql) if src == STRING else None
    if dst == STRING:
        return show_time(sql) if is_time(src) else None
    if is_array(src) and is_array(dst) or is_object(src) and type(src) is type(dst):
        return sql
    return None


def lenient(sql: str, src, dst) -> str | None:
    """The strict casts, and those between bool, numbers and text; null to bool is false."""
    if dst == BOOL and src != BOOL:
        if is_null(src):
            return "false"
        if is_numeric(src):
            return f"coalesce({sql} <> 0, false)"
        if src == STRING:
            return f"coalesce({sql} = 'true', false)"
        if is_array(src) or isinstance(src, T.MapType):
            return f"coalesce(size({sql}) > 0, false)"
        return f"({sql} is not null)" if is_object(src) else None
    if dst == BOOL:
        return f"coalesce({sql}, false)"
    got = strict(sql, src, dst)
    if got is not None:
        return got
    if src == BOOL and is_numeric(dst):
        return f"cast({sql} as {dst.simpleString()})"
    if src == STRING and is_numeric(dst):
        return f"try_cast(trim({sql}) as {dst.simpleString()})"
    if dst == STRING:
        return number_text(sql, src) if is_numeric(src) else f"cast({sql} as string)" if src == BOOL else f"to_json({sql})" if is_array(src) or is_object(src) else None
    return None
