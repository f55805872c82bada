"""The aggregates of `summarize`, as Spark SQL texts. Each is partial and final in Spark's own aggregation.

Order-sensitive ones (first, last, lists, ties) go by the hidden row id; `{row}` is its SQL.
"""

from __future__ import annotations

from pyspark.sql import types as T

from ..plans import types as L
from ..plans.syntax import PipelineError
from ..plans.types import BOOL, LONG, STRING, Ex

#: Names that need the order of the input rows.
ORDERED = {"min_by", "max_by", "first", "first_value", "last", "last_value", "array_agg", "collect_list", "collect_set", "array_agg_if"}
ARITY = {"count": (0, None), "distinct_count": (1, None), "count_if": (1, 1), "sum": (1, 1), "avg": (1, 1), "mean": (1, 1), "min": (1, 1), "least": (1, 1), "max": (1, 1), "greatest": (1, 1), "min_by": (2, 2), "max_by": (2, 2), "every": (1, 1), "any": (1, 1), "some": (1, 1), "first": (1, 2), "first_value": (1, 2), "last": (1, 2), "last_value": (1, 2), "array_agg": (1, 1), "collect_list": (1, 1), "collect_set": (1, 1), "array_agg_if": (2, 2)}


def ordered_list(sql: str, row: str, where: str = "") -> str:
    """Values in row order, nulls kept."""
    return f"transform(array_sort(collect_list(struct({row} as r, {sql} as v)){where}), s_ -> s_.v)"


def aggregate(name: str, args: list[Ex], row: str) -> Ex:
    if name not in ARITY:
        raise PipelineError(f"unknown aggregate {name}")
    least, most = ARITY[name]
    if len(args) < least or most is not None and len(args) > most:
        raise PipelineError(f"{name} takes {least} to {most or 'many'} arguments")
    sqls = [f"({a.sql})" for a in args]
    a, t = (sqls[0], args[0].type) if args else ("", None)

    def bools(i: int = 0) -> str:
        if args[i].type != BOOL and not L.is_null(args[i].type):
            raise PipelineError(f"{name} takes a bool")
        return f"cast({sqls[i]} as boolean)"

    match name:
        case "count":
            return Ex("count(1)", LONG)
        case "count_if":
            return Ex("count_if(coalesce(" + (a if t == BOOL else "false") + ", false))", LONG)
        case "distinct_count":
            return Ex(f"count(distinct struct({', '.join(sqls)}))", LONG)
        case "sum":
            if t == STRING:
                return Ex(f"if(count({a}) = 0, null, array_join({ordered_list(a, row)}, ''))", STRING)
            numeric(name, t)
            return Ex(f"try_cast(try_sum({a}) as {t.simpleString()})", t)
        case "avg" | "mean":
            numeric(name, t)
            nulls = f"count(1) <> count({a}) and count({a}) > 0"
            mean = f"try_cast(try_sum(cast({a} as bigint)) div count(1) as {t.simpleString()})" if L.is_integral(t) else f"cast(try_sum({a}) / count(1) as {t.simpleString()})"
            return Ex(f"if({nulls}, null, {mean})", t, f"if({nulls}, {L.quote(f'{name}: null among numbers')}, null)")
        case "min" | "least" | "max" | "greatest":
            if not (L.is_numeric(t) or L.is_time(t) or t in (STRING, BOOL)):
                raise PipelineError(f"{name}: no {L.kind(t)}")
            return Ex(f"{'min' if name in ('min', 'least') else 'max'}({a})", t)
        case "min_by" | "max_by":
            # (ordering, returned); the first row wins ties for min_by, the last for max_by
            return Ex(f"{name}({sqls[1]}, struct({a}, {row})) filter (where {a} is not null)", args[1].type)
        case "every":
            return Ex(f"bool_and(coalesce({bools()}, false))", BOOL)
        case "any" | "some":
            return Ex(f"bool_or({bools()})", BOOL)
        case "first" | "first_value" | "last" | "last_value":
            ignore = len(args) > 1 and args[1].sql == "true"
            if len(args) > 1 and args[1].sql not in ("true", "false"):
                raise PipelineError(f"{name}: the second argument has to be true or false")
            where = f" filter (where {a} is not null)" if ignore else ""
            return Ex(f"{'min_by' if name.startswith('first') else 'max_by'}({a}, {row}){where}", t)
        case "array_agg" | "collect_list":
            return Ex(ordered_list(a, row), T.ArrayType(t))
        case "collect_set":
            return Ex(f"array_distinct({ordered_list(a, row)})", T.ArrayType(t))
        case "array_agg_if":
            return Ex(ordered_list(a, row, f" filter (where {bools(1)})"), T.ArrayType(t))
    raise AssertionError(name)


def numeric(name: str, t) -> None:
    if not L.is_numeric(t):
        raise PipelineError(f"{name}: no {L.kind(t)}")
