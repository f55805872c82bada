"""The stages of a pipeline: each turns a Flow (a DataFrame and what is known of its columns) into the next.

Hidden columns: `__rowid`, only if a later stage needs the order of rows (a long; an array once explode or join made several
rows of one, so that it stays sortable), `__err_<name>` (text of a cell's error), only if errors are tracked, and
`__bind<n>` (arguments of an expression), within a stage.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import syntax as S
from ..plans import types as L
from ..plans.binder import Binder
from ..plans.syntax import PipelineError
from ..plans.types import NULL, Ex, ident
from .aggregates import ORDERED, aggregate

ROW = "__rowid"
FENCED = 2  # levels of bound columns through which a filter may move down


def err_name(name: str) -> str:
    return f"__err_{name}"


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    types: dict  # visible column -> type, in order
    tracked: frozenset = frozenset()  # columns with an error companion
    track: bool = False
    rows: bool = False  # __rowid is there
    grown: bool = False  # __rowid is an array
    sources: Mapping = field(default_factory=dict)
    udfs: Mapping[str, Callable] = field(default_factory=dict)

    def binder(self) -> Binder:
        columns = {n: Ex(ident(n), t, ident(err_name(n)) if n in self.tracked else None, simple=True) for n, t in self.types.items()}
        return Binder(columns, self.udfs)

    def row_array(self) -> str:
        return ident(ROW) if self.grown else f"array({ident(ROW)})"

    def hidden(self) -> list[str]:
        return [ident(ROW)] if self.rows else []

    def carried(self, names=None) -> list[str]:
        """SQL of visible columns and their companions."""
        names = list(self.types if names is None else names)
        return [ident(n) for n in names] + [ident(err_name(n)) for n in names if n in self.tracked]

    def companions(self, new: dict[str, Ex]) -> tuple[list[str], set[str]]:
        if not self.track:
            return [], set()
        return [f"cast({e.err} as string) as {ident(err_name(n))}" for n, e in new.items() if e.err], {n for n, e in new.items() if e.err}


def needs_rows(stages: tuple) -> bool:
    """Whether any stage depends on the order of rows."""
    def one(s) -> bool:
        return isinstance(s, S.Summarize) and any(a.function in ORDERED for a in s.aggregates)
    return any(one(s) for s in stages)


class OrderNeeded(Exception):
    """A sum of texts was met in a flow without row ids; types are known only once an input is bound."""


def needs_errors(stages: tuple) -> bool:
    """Whether results depend on which cells are errors: ignore-error, or a null test after a computed column."""
    computed = False
    for s in stages:
        if isinstance(s, S.IgnoreError):
            return True
        if computed and isinstance(s, S.Lookup) and s.kind == "left-inner":  # an error as key keeps its row
            return True
        exprs = [s.expr] if isinstance(s, (S.Where, S.Top)) else [c.expr for c in s.columns] if isinstance(s, S.Project) else [a for g in s.aggregates for a in g.args] if isinstance(s, S.Summarize) else []
        if computed and any(isinstance(n, S.Call) and n.name.startswith("is ") for e in exprs for n in S.walk(e)):
            return True
        computed |= isinstance(s, (S.Project, S.Lookup, S.Summarize))
    return False


def typed(sql: str, t) -> str:
    return f"cast({sql} as {t.simpleString()})" if not L.is_null(t) else f"cast({sql} as void)"


def where(flow: Flow, s: S.Where) -> Flow:
    """What is not exactly true drops the row. Conditions on plain columns go first, where the scan can take them."""
    binder = flow.binder()
    conditions = binder.conditions(s.expr)
    if any(e.type != L.BOOL for e in conditions):
        return replace(flow, df=flow.df.where("false"))
    df = flow.df
    for e in conditions:
        df = df.where(e.sql) if e.level == 0 else df
    rest = [e for e in conditions if e.level > 0]
    if rest:
        df = binder.prepared(df)
        if max(e.level for e in rest) > FENCED:  # a filter below its columns repeats them, a power of the depth of times
            df = df.selectExpr("*", "monotonically_increasing_id() as __fence").where("__fence >= 0 and " + " and ".join(e.sql for e in rest))
        else:
            for e in rest:
                df = df.where(e.sql)
        df = df.selectExpr(*flow.carried(), *flow.hidden())
    return replace(flow, df=df)


def take(flow: Flow, s: S.Take) -> Flow:
    df = flow.df.orderBy(ROW) if flow.rows else flow.df
    return replace(flow, df=df.limit(s.n))


def top(flow: Flow, s: S.Top) -> Flow:
    binder = flow.binder()
    e = binder.hold(binder.bind(s.expr))
    order = f"{'desc' if s.descending else 'asc'} nulls {'first' if s.nulls_first else 'last'}"
    key = F.expr(e.sql)
    column = {"desc nulls first": key.desc_nulls_first, "desc nulls last": key.desc_nulls_last, "asc nulls first": key.asc_nulls_first, "asc nulls last": key.asc_nulls_last}[order]()
    return replace(flow, df=binder.prepared(flow.df).orderBy(column).limit(s.n).selectExpr(*flow.carried(), *flow.hidden()))


def project(flow: Flow, s: S.Project) -> Flow:
    binder, new = flow.binder(), {}
    for c in s.columns:
        if c.name in flow.types or c.name in new:
            raise PipelineError(f"project: the column {c.name} exists")
        new[c.name] = binder.bind(c.expr)
    errs, tracked = flow.companions(new)
    df = binder.prepared(flow.df).selectExpr(*flow.carried(), *flow.hidden(), *(f"{e.sql} as {ident(n)}" for n, e in new.items()), *errs)
    return replace(flow, df=df, types=flow.types | {n: e.type for n, e in new.items()}, tracked=flow.tracked | tracked)


def project_rename(flow: Flow, s: S.ProjectRename) -> Flow:
    new = {old: name for name, old in s.names if old in flow.types}
    for name, old in s.names:
        if name in flow.types and name != old:
            raise PipelineError(f"project-rename: the column {name} exists")
    renames = new | {err_name(o): err_name(n) for o, n in new.items() if o in flow.tracked}
    return replace(flow, df=flow.df.withColumnsRenamed(renames), types={new.get(n, n): t for n, t in flow.types.items()}, tracked=frozenset(new.get(n, n) for n in flow.tracked))


def keep_columns(flow: Flow, names: list[str]) -> Flow:
    return replace(flow, df=flow.df.selectExpr(*flow.carried(names), *flow.hidden()), types={n: flow.types[n] for n in names}, tracked=flow.tracked & set(names))


def project_remove(flow: Flow, s: S.ProjectRemove) -> Flow:
    return keep_columns(flow, [n for n in flow.types if n not in s.names])


def project_keep(flow: Flow, s: S.ProjectKeep) -> Flow:
    for n in s.names:
        if n not in flow.types:
            raise PipelineError(f"project-keep: unknown column {n}")
    return keep_columns(flow, [n for n in flow.types if n in s.names])


def ignore_error(flow: Flow, s: S.IgnoreError) -> Flow:
    if not flow.tracked:
        return flow
    clean = " and ".join(f"{ident(err_name(n))} is null" for n in sorted(flow.tracked))
    return replace(flow, df=flow.df.where(clean).drop(*(err_name(n) for n in flow.tracked)), tracked=frozenset())


def explode(flow: Flow, s: S.Explode) -> Flow:
    """Rows with a null or empty array, or no array at all, go; the place of an element joins the row id."""
    if s.column not in flow.types:
        raise PipelineError(f"explode: unknown column {s.column}")
    t = flow.types[s.column]
    if not L.is_array(t):
        return replace(flow, df=flow.df.where("false"))
    item, sql, err = t.elementType, "__item", None
    if s.type and s.type in L.NAMED and L.NAMED[s.type] != item:
        item, sql = L.NAMED[s.type], L.strict("__item", item, L.NAMED[s.type])
        sql, err = (sql, f"if(__item is not null and ({sql}) is null, 'explode: bad cast', null)") if sql else (f"cast(null as {item.simpleString()})", "if(__item is not null, 'explode: bad cast', null)")
    others = [n for n in flow.types if n != s.column]
    grown = flow.df.selectExpr(*flow.carried(others), *flow.hidden(), f"posexplode({ident(s.column)}) as (__pos, __item)")
    columns = [f"{sql} as {ident(n)}" if n == s.column else ident(n) for n in flow.types]
    errs, tracked = flow.companions({s.column: Ex(sql, item, err)})
    companions = [ident(err_name(n)) for n in others if n in flow.tracked]
    row = [f"concat({flow.row_array()}, array(cast(__pos as bigint))) as {ident(ROW)}"] if flow.rows else []
    return replace(flow, grown=True, df=grown.selectExpr(*columns, *companions, *errs, *row), types={n: item if n == s.column else x for n, x in flow.types.items()}, tracked=(flow.tracked - {s.column}) | tracked)


def bound_keys(binder: Binder, keys: tuple) -> dict[str, Ex]:
    out = {}
    for k in keys:
        if k.name in out:
            raise PipelineError(f"the key {k.name} is given twice")
        out[k.name] = binder.bind(k.expr if k.expr is not None else S.ColumnRef(k.name))
    return out


def summarize(flow: Flow, s: S.Summarize) -> Flow:
    """Aggregates first, then keys; without keys, no row for no input."""
    binder = flow.binder()
    keys = bound_keys(binder, s.keys)
    row = ident(ROW) if flow.rows else "0"
    aggs: dict[str, Ex] = {}
    for a in s.aggregates:
        if a.name in aggs or a.name in keys:
            raise PipelineError(f"summarize: the column {a.name} exists")
        args = [binder.hold(binder.bind(x)) for x in a.args]
        if a.function == "sum" and args and args[0].type == L.STRING and not flow.rows:
            raise OrderNeeded
        aggs[a.name] = aggregate(a.function, args, row)
    errs, tracked = flow.companions(aggs)
    # keys become columns of their own names first, so that an expression key is evaluated once
    inner = binder.prepared(flow.df).selectExpr("*", *(f"{e.sql} as {ident(f'__key_{n}')}" for n, e in keys.items()))
    columns = [F.expr(e.sql).alias(n) for n, e in aggs.items()] + [F.expr(x.rsplit(" as ", 1)[0]).alias(x.rsplit(" as ", 1)[1].strip("`")) for x in errs]
    columns += [F.expr(f"min({ident(ROW)})").alias(ROW)] if flow.rows else []
    if keys:
        df = inner.groupBy(*(f"__key_{n}" for n in keys)).agg(*columns)
    else:
        df = inner.agg(*columns, F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n")
    out = replace(flow, types={n: e.type for n, e in aggs.items()} | {n: e.type for n, e in keys.items()}, tracked=frozenset(tracked))
    df = df.selectExpr(*(ident(n) for n in aggs), *(f"{ident(f'__key_{n}')} as {ident(n)}" for n in keys), *(ident(err_name(n)) for n in tracked), *flow.hidden())
    return replace(out, df=df)


def distinct(flow: Flow, s: S.Distinct) -> Flow:
    """Without keys whole rows, with keys the key columns alone; both are aggregates without functions."""
    binder = flow.binder()
    keys = bound_keys(binder, s.keys or tuple(S.Named(n) for n in flow.types))
    rows = binder.prepared(flow.df).selectExpr(*(f"{e.sql} as {ident(n)}" for n, e in keys.items()), *flow.hidden())
    rows = rows.groupBy(*keys).agg(F.min(ROW).alias(ROW)) if flow.rows else rows.distinct()
    return replace(flow, df=rows.selectExpr(*(ident(n) for n in keys), *flow.hidden()), types={n: e.type for n, e in keys.items()}, tracked=frozenset())


def lookup(flow: Flow, s: S.Lookup) -> Flow:
    """An equi-join on the key with the source's rows (see sources): first match, every match, or every match or nulls."""
    source = flow.sources.get(s.source)
    if source is None:
        raise PipelineError(f"unknown lookup source {s.source}")
    binder = flow.binder()
    key = binder.hold(binder.bind(s.key))
    names = [f.new or f.name for f in s.fields]
    for i, n in enumerate(names):
        if n in flow.types or n in names[:i]:
            raise PipelineError(f"{s.kind}: the column {n} exists")
    left = binder.prepared(flow.df).selectExpr(*flow.carried(), *flow.hidden(), f"{key.sql} as __k", f"{f'cast({key.err} as string)' if key.err and (flow.track or s.kind == 'left-inner') else 'cast(null as string)'} as __kerr")
    found = source.rows(left.select("__k").where("__k is not null and __kerr is null"), key.type, [f.name for f in s.fields], first=s.kind == "lookup")
    out_types, columns, errs, tracked = {}, [], [], set()
    if found is None:  # the key can't equal any key of the source
        joined = left.selectExpr("*", "cast(null as int) as __hit", "cast(null as string) as __ferr", "cast(null as bigint) as __seq")
        got = {f.name: NULL for f in s.fields}
    else:
        joined = left.join(found, F.col("__k") == F.col("__fk"), "left").drop("__fk")
        got = {f.name: found.schema[f"__f_{f.name}"].dataType for f in s.fields}
    if s.kind == "left-inner":
        joined = joined.where("__hit is not null or __kerr is not null or __ferr is not null" + (" or __k is null" if source.null_key_row else ""))
    for f, n in zip(s.fields, names, strict=True):
        t, raw = got[f.name], ident(f"__f_{f.name}") if found is not None else "null"
        want = L.NAMED.get(f.type, t) if f.type else t
        sql = L.strict(raw, t, want)
        bad = f"when {raw} is not null and {f'({sql}) is null' if sql else 'true'} then 'lookup: bad cast of {n}'" if f.type else ""
        sql = sql or f"cast(null as {want.simpleString()})"
        out_types[n] = want
        columns.append(f"{sql} as {ident(n)}")
        if flow.track:
            errs.append(f"case when __kerr is not null then __kerr when __ferr is not null then __ferr {bad} end as {ident(err_name(n))}")
            tracked.add(n)
    many = s.kind != "lookup"
    row = [f"concat({flow.row_array()}, array(coalesce(__seq, 0L))) as {ident(ROW)}" if many else ident(ROW)] if flow.rows else []
    df = joined.selectExpr(*flow.carried(), *columns, *errs, *row)
    return replace(flow, grown=flow.grown or many, df=df, types=flow.types | out_types, tracked=flow.tracked | tracked)


STAGES = {S.Where: where, S.Take: take, S.Top: top, S.Project: project, S.ProjectRename: project_rename, S.ProjectRemove: project_remove, S.ProjectKeep: project_keep, S.IgnoreError: ignore_error, S.Explode: explode, S.Summarize: summarize, S.Distinct: distinct, S.Lookup: lookup}


def apply(flow: Flow, stages: tuple) -> Flow:
    for s in stages:
        flow = STAGES[type(s)](flow, s)
    return flow
