"""Binds expressions to the columns of an input: names, types, arity, promotion; gives SQL texts of value and error."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import special  # noqa: F401  (fills the registry)
from ..functions.registry import FUNCTIONS, call
from . import types as L
from .syntax import COMPARISONS, Call, ColumnRef, Literal, PipelineError
from .types import BOOL, DOUBLE, LONG, NULL, STRING, Ex


def literal(e: Literal) -> Ex:
    v = e.value
    match e.kind:
        case "null":
            return Ex("null", NULL, simple=True)
        case "bool":
            return Ex(str(v).lower(), BOOL, simple=True)
        case "int":
            return Ex(str(v), L.INT, simple=True)
        case "long":
            return Ex(f"{v}L", LONG, simple=True)
        case "double":
            return Ex(f"double('{v!r}')", DOUBLE, simple=True)
    return Ex(L.quote(v), STRING, simple=True)


def first(errors: list[str | None]) -> str | None:
    some = [e for e in errors if e]
    return None if not some else some[0] if len(some) == 1 else f"coalesce({', '.join(some)})"


class Binder:
    """Scope of one stage. udfs: name to a function of Ex arguments and this binder.

    Templates name their arguments several times, so an argument that is neither column nor literal becomes a column of its
    own first: texts grow with the expression, not with a power of its depth, and a random argument has one value a row.
    Columns are bound in levels, each of which is one projection; Catalyst merges those that are used once.
    """

    def __init__(self, columns: Mapping[str, Ex], udfs: Mapping[str, Callable[[list[Ex], Binder], Ex]] | None = None):
        self.columns, self.udfs = columns, udfs or {}
        self.levels: list[list[str]] = []

    def hold(self, e: Ex) -> Ex:
        """The expression as a column or a literal."""
        if e.simple or e.sql == "null":
            return e
        while len(self.levels) <= e.level:
            self.levels.append([])
        name = f"`__bind{sum(map(len, self.levels))}`"
        self.levels[e.level].append(f"{e.sql} as {name}")
        return replace(e, sql=name, simple=True, level=e.level + 1)

    def prepared(self, df: DataFrame) -> DataFrame:
        """df with the bound columns."""
        for columns in self.levels:
            df = df.selectExpr("*", *columns)
        return df

    def conditions(self, e) -> list[Ex]:
        """Expressions that are all true exactly where e is true; plain enough for a scan to take them."""
        if isinstance(e, Call) and e.operator and e.name == "and":
            return [c for a in e.args for c in self.conditions(self.logical("and", a))]
        if isinstance(e, Call) and e.operator and e.name == "or":
            a, b = (self.hold(self.bind(self.logical("or", x))) for x in e.args)
            if L.is_null(a.type) or L.is_null(b.type):
                return [Ex("false", BOOL)]
            return [Ex(f"({a.sql} or {b.sql})", BOOL, level=max(a.level, b.level)), Ex(f"({a.sql} is not null and {b.sql} is not null)", BOOL, level=max(a.level, b.level))]
        return [self.bind(e)]

    def logical(self, op: str, e):
        """e, if it can be an operand of a logical operator."""
        kind = Binder(self.columns, self.udfs).bind(e).type
        if kind != BOOL and not L.is_null(kind):
            raise PipelineError(f"{op}: operands have to be bool; comparisons bind loosest, so put them in parentheses")
        return e

    def bind(self, e) -> Ex:
        if isinstance(e, Literal):
            return literal(e)
        if isinstance(e, ColumnRef):
            if e.name not in self.columns:
                raise PipelineError(f"unknown column {e.name}")
            return self.columns[e.name]
        args = [self.hold(self.bind(a)) for a in e.args]
        if e.operator:
            out = self.operator(e.name, args)
        elif e.name in self.udfs:
            out = self.udfs[e.name](args, self)
        elif e.name in FUNCTIONS:
            out = call(FUNCTIONS[e.name], args)
        else:
            raise PipelineError(f"unknown function {e.name}")
        return replace(out, simple=False, level=max([out.level, *(a.level for a in args)]))

    def operator(self, op: str, args: list[Ex]) -> Ex:
        if op in ("is null", "is not null"):
            test = f"({args[0].sql} {op})"
            return Ex(f"if({args[0].err} is null, {test}, null)" if args[0].err else test, BOOL, args[0].err)
        if op == "&":
            return call(FUNCTIONS["bit_and"], args)
        if op == "~":
            return call(FUNCTIONS["bit_not"], args)
        sql, kind = self.value(op, args)
        nulls = " or ".join(f"({a.sql}) is null" for a in args)
        if op == "-" and len(args) == 2:  # null minus null is null, no error
            nulls = f"(({args[0].sql}) is null) <> (({args[1].sql}) is null)"
        missing = op in ("[]", ".")
        own = f"case when {nulls} then {L.quote(f'{op}: null operand')} " + ("" if missing else f"when not ({' or '.join(f'({a.sql}) is null' for a in args)}) and ({sql}) is null then {L.quote(f'{op} failed')} ") + "end"
        return Ex(sql, kind, first([*(a.err for a in args), own]))

    def value(self, op: str, args: list[Ex]) -> tuple[str, T.DataType]:
        a, b = args[0], args[-1]
        x, y = f"({a.sql})", f"({b.sql})"
        null = [L.is_null(t.type) for t in args]
        if op in ("[]", "."):
            got = special.index([Ex(x, a.type), Ex(y, b.type)], op)
            return got.sql, got.type
        if op in ("and", "or"):
            if any(t.type != BOOL and not n for t, n in zip(args, null, strict=True)):
                raise PipelineError(f"{op}: operands have to be bool; comparisons bind loosest, so put them in parentheses")
            return f"if({x} is null or {y} is null, null, {x} {op} {y})", BOOL
        if op == "not":
            if a.type != BOOL and not null[0]:
                raise PipelineError("not: the operand has to be bool")
            return f"(not {x})", BOOL
        if op in COMPARISONS:
            return self.compare(op, a, b), BOOL
        if op == "+" and STRING in (a.type, b.type) and all(t.type == STRING or n for t, n in zip(args, null, strict=True)):
            return f"concat({x}, {y})", STRING
        if not all(L.is_numeric(t.type) or n for t, n in zip(args, null, strict=True)):
            raise PipelineError(f"{op}: no {L.kind(a.type)} and {L.kind(b.type)}" if len(args) == 2 else f"{op}: no {L.kind(a.type)}")
        if op == "unary+":
            return x, a.type
        if op == "unary-":
            return f"try_subtract(cast(0 as {a.type.simpleString()}), {x})" if not null[0] else "null", a.type
        if any(null):
            return "null", NULL
        if op in ("div", "%"):
            long = lambda v, t: v if t == LONG else f"try_cast({v} as bigint)"
            p, q = long(x, a.type), long(y, b.type)
            return (f"if({q} = 0, null, {p} div {q})" if op == "div" else f"try_mod({p}, {q})"), LONG
        t = L.promote(a.type, b.type)
        p, q = (v if s.type == t else f"cast({v} as {t.simpleString()})" for v, s in ((x, a), (y, b)))
        if op == "/":
            if L.is_integral(t):
                return f"try_cast(if({q} = 0, null, cast({p} as bigint) div cast({q} as bigint)) as {t.simpleString()})", t
            return f"cast(try_divide({p}, {q}) as {t.simpleString()})", t
        return f"{ {'+': 'try_add', '-': 'try_subtract', '*': 'try_multiply'}[op]}({p}, {q})", t

    def compare(self, op: str, a: Ex, b: Ex) -> str:
        s, x, y = {"==": "=", "!=": "<>"}.get(op, op), f"({a.sql})", f"({b.sql})"
        if L.is_null(a.type) or L.is_null(b.type):
            return "cast(null as boolean)"
        both = lambda test: test(a.type) and test(b.type)
        if both(L.is_numeric):
            t = L.promote(a.type, b.type).simpleString()
            return f"(cast({x} as {t}) {s} cast({y} as {t}))"
        if both(lambda t: t == STRING) or both(lambda t: t == BOOL) or both(L.is_time):
            return f"({x} {s} {y})"
        if {True} == {L.is_time(t) or t == STRING for t in (a.type, b.type)}:
            x, y = (L.parse_time(v) if t == STRING else v for v, t in ((x, a.type), (y, b.type)))
            return f"({x} {s} {y})"
        if s in ("=", "<>") and both(L.is_array):
            return f"({x} {s} {y})"
        if s in ("=", "<>") and both(lambda t: isinstance(t, T.MapType)):
            sort = lambda v: f"array_sort(map_entries({v}))"
            return f"({sort(x)} {s} {sort(y)})"
        if s in ("=", "<>") and both(L.is_object):
            return f"(to_json({x}) {s} to_json({y}))"
        raise PipelineError(f"{op}: no {L.kind(a.type)} and {L.kind(b.type)}")
