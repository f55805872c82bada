"""Functions whose template depends on the number, the types or the literals of their arguments, and the two profiles."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ..plans import types as L
from ..plans.syntax import PipelineError
from ..plans.types import BOOL, DOUBLE, INT, LONG, NULL, STRING, TIME, Ex
from .registry import define

LONGS, BOOLS = "l*", "b*"


def fold(symbol: str):
    return lambda args: Ex("(" + f" {symbol} ".join(a.sql for a in args) + ")", LONG)


define("bit_and", LONGS)(fold("&"))
define("bit_or", LONGS)(fold("|"))
define("bit_xor", LONGS)(fold("^"))


def logic(symbol: str):
    """A null among the arguments is an error, whatever the others say."""
    return lambda args: Ex(f"if({' or '.join(f'{a.sql} is null' for a in args)}, null, {f' {symbol} '.join(a.sql for a in args)})", BOOL)


define("bool_and every", BOOLS)(logic("and"))
define("bool_or", BOOLS)(logic("or"))


@define("concat", "x*")
def concat(args):
    if len(args) < 2:
        raise PipelineError("concat takes at least 2 arguments")
    types = [a.type for a in args if not L.is_null(a.type)]
    if not all(t == STRING for t in types) and not all(L.is_array(t) for t in types):
        raise PipelineError("concat takes strings or arrays")
    return Ex(f"concat({', '.join(a.sql for a in args)})", types[0] if types else STRING)


@define("concat_ws", "sX*", True)
def concat_ws(args):
    if any(not (L.is_null(a.type) or a.type == STRING or L.is_array(a.type)) for a in args):
        raise PipelineError("concat_ws takes strings and arrays")
    parts = [f"transform({a.sql}, e_ -> cast(e_ as string))" if L.is_array(a.type) else f"cast({a.sql} as string)" for a in args[1:]]
    return Ex(f"concat_ws({', '.join([args[0].sql, *parts])})", STRING)


@define("elt", "X*", True)
def elt(args):
    """The index counts the index argument itself as position 0."""
    t = L.common([a.type for a in args]) if all(L.is_numeric(a.type) for a in args) else L.common([a.type for a in args[1:]])
    values = ", ".join(f"cast({a.sql} as {t.simpleString()})" for a in args)
    return Ex(f"get(array({values}), cast({args[0].sql} as int))", t)


@define("array", "X*", True)
def array(args):
    t = L.common([a.type for a in args])
    return Ex(f"array({', '.join(f'cast({a.sql} as {t.simpleString()})' if a.type != t and not L.is_null(t) else a.sql for a in args)})", T.ArrayType(t))


@define("array_join", "as?S")
def array_join(args):
    item = L.lenient("e_", args[0].type.elementType, STRING)
    if item is None:
        raise PipelineError("array_join: elements without a text form")
    rest = f", {args[2].sql}" if len(args) > 2 and not L.is_null(args[2].type) else ""
    return Ex(f"array_join(transform({args[0].sql}, e_ -> {item}), {args[1].sql}{rest})", STRING)


define("array_repeat", "Xl")(lambda a: Ex(f"array_repeat({a[0].sql}, cast({a[1].sql} as int))", T.ArrayType(a[0].type)))


@define("arrays_zip", "aa")
def arrays_zip(args):
    a, b = args
    t = L.common([a.type.elementType, b.type.elementType])
    cast = lambda v: f"cast({v} as {t.simpleString()})"
    n = f"least(size({a.sql}), size({b.sql}))"
    return Ex(f"zip_with(slice({a.sql}, 1, {n}), slice({b.sql}, 1, {n}), (p_, q_) -> array({cast('p_')}, {cast('q_')}))", T.ArrayType(T.ArrayType(t)))


@define("element_at", "xx", True)
def element_at(args):
    return index(args, "element_at")


def index(args, name: str):
    """0-based array access and object access by key; what is missing is null."""
    a, b = args
    if L.is_array(a.type) and (L.is_numeric(b.type) or L.is_null(b.type)):
        return Ex(f"get({a.sql}, cast({b.sql} as int))", a.type.elementType)
    if isinstance(a.type, T.MapType) and b.type == STRING:
        return Ex(f"try_element_at({a.sql}, {b.sql})", a.type.valueType)
    if isinstance(a.type, T.StructType) and (m := re.fullmatch(r"\(*'((?:[^'\\]|\\.)*)'\)*", b.sql)):
        name = m[1].replace("\\'", "'").replace("\\\\", "\\")
        return Ex(f"{a.sql}.{L.ident(name)}", a.type[name].dataType) if name in a.type.names else Ex("null", NULL)
    if isinstance(a.type, T.VariantType) and b.type == STRING:
        return Ex(f"try_variant_get({a.sql}, concat('$.', {b.sql}), 'string')", STRING)
    if L.is_null(a.type):
        return Ex("null", NULL)
    raise PipelineError(f"{name}: no access to {L.kind(a.type)} by {L.kind(b.type)}")


@define("flatten", "X", True)
def flatten(args):
    a = args[0]
    return Ex(f"flatten({a.sql})", a.type.elementType) if L.is_array(a.type) and L.is_array(a.type.elementType) else a


@define("slice", "all")
def slice_(args):
    """0-based and half open; negative places count from the end; an end before the start is an error."""
    a, b, c = (x.sql for x in args)
    start, end = f"if({b}<0, greatest(size({a})+{b}, 0), {b})", f"if({c}<0, greatest(size({a})+{c}, 0), least({c}, size({a})))"
    return Ex(f"if({start} > {end}, null, slice({a}, cast({start} as int)+1, cast(greatest({end}-{start}, 0) as int)))", args[0].type)


define("len length", "x")(lambda a: Ex(f"cast(size({a[0].sql}) as bigint)", LONG) if L.is_array(a[0].type) else Ex(f"cast(octet_length({text(a[0], 'length')}) as bigint)", LONG))


def text(a: Ex, name: str) -> str:
    if a.type != STRING and not L.is_null(a.type):
        raise PipelineError(f"{name} takes a string or an array")
    return a.sql if a.type == STRING else f"cast({a.sql} as string)"


@define("bucket", "x*")
def bucket(args):
    """The number of the first pivot that is greater than the value."""
    a, *pivots = args
    return Ex("case " + " ".join(f"when {a.sql} < {p.sql} then {i}L" for i, p in enumerate(pivots)) + f" else {len(pivots)}L end", LONG)


@define("regexp_extract", "ss?l")
def regexp_extract(args):
    """The group defaults to 1; no match and a missing group give ''. """
    a, b, *c = (x.sql for x in args)
    group = f"cast({c[0]} as int)" if c else "1"
    pattern = re.fullmatch(r"\(*'((?:[^'\\]|\\.)*)'\)*", b)
    if pattern:
        groups = len(re.findall(r"(?<!\\)\((?!\?)|(?<!\\)\(\?<(?![=!])|(?<!\\)\(\?P<", re.sub(r"\\\\(.)", r"", pattern[1])))
        return Ex(f"if({group} > {groups}, '', regexp_extract({a}, {b}, least({group}, {groups})))", STRING)
    return Ex(f"regexp_extract({a}, {b}, {group})", STRING)


@define("regexp_replace", "sss")
def regexp_replace(args):
    """All matches; $name in the replacement stands for a group, as ${name} does in Java."""
    a, b, c = (x.sql for x in args)
    return Ex(f"regexp_replace({a}, {b}, regexp_replace({c}, '\\\\$([A-Za-z][A-Za-z0-9]*)', '\\\\${{$1}}'))", STRING)


@define("map_from_arrays", "aa")
def map_from_arrays(args):
    """Zips to the shorter; of equal keys the last wins."""
    a, b = args
    n = f"least(size({a.sql}), size({b.sql}))"
    entries = f"arrays_zip(slice({a.sql}, 1, {n}), slice({b.sql}, 1, {n}))"
    pairs = f"transform({entries}, e_ -> struct(e_.`0` as k, e_.`1` as v))"
    last = f"filter(transform({pairs}, (e_, i_) -> struct(e_.k as k, e_.v as v, exists(slice({a.sql}, i_+2, greatest({n}-i_-1, 0)), f_ -> f_ <=> e_.k) as more)), e_ -> not e_.more)"
    return Ex(f"map_from_entries(transform({last}, e_ -> struct(e_.k, e_.v)))", T.MapType(a.type.elementType, b.type.elementType))


define("map_values", "o")(lambda a: Ex(f"map_values({a[0].sql})", T.ArrayType(a[0].type.valueType if isinstance(a[0].type, T.MapType) else STRING)))


@define("get_json_array", "ss", True)
def get_json_array(args):
    """All matches of a JSON path as an array of texts; a path with one match gives one element."""
    got = f"get_json_object({args[0].sql}, {args[1].sql})"
    many = f"contains({args[1].sql}, '*')"
    return Ex(f"case when {got} is null then cast(array() as array<string>) when {many} and startswith({got}, '[') then transform(from_json({got}, 'array<variant>'), v_ -> cast(v_ as string)) else array({got}) end", T.ArrayType(STRING))


@define("to_json", "X", True)
def to_json(args):
    a = args[0]
    if L.is_array(a.type) or isinstance(a.type, (T.MapType, T.StructType)):
        return Ex(f"to_json({a.sql})", STRING)
    if L.is_null(a.type):
        return Ex("'null'", STRING)
    value = L.show_time(a.sql) if L.is_time(a.type) else a.sql
    return Ex(f"coalesce(regexp_extract(to_json(array({value})), '^\\\\[(.*)\\\\]$', 1), 'null')", STRING)


@define("case", "X*", True)
def case(args):
    pairs, rest = list(zip(args[::2], args[1::2], strict=False)), args[-1:] if len(args) % 2 else []
    if any(c.type != BOOL and not L.is_null(c.type) for c, _ in pairs):
        raise PipelineError("case: a condition is no bool")
    t = L.common([v.type for _, v in pairs] + [r.type for r in rest])
    cast = lambda v: v.sql if v.type == t else f"cast({v.sql} as {t.simpleString()})"
    return Ex("case " + " ".join(f"when {c.sql} then {cast(v)}" for c, v in pairs) + (f" else {cast(rest[0])}" if rest else "") + " end", t)


@define("if", "bXX", True)
def if_(args):
    c, a, b = args
    t = L.common([a.type, b.type])
    return Ex(f"if({c.sql} is null, null, if({c.sql}, cast({a.sql} as {t.simpleString()}), cast({b.sql} as {t.simpleString()})))" if not L.is_null(t) else "null", t)


@define("coalesce ifnull nvl", "X*", True)
def coalesce(args):
    t = L.common([a.type for a in args])
    return Ex("coalesce(" + ", ".join(a.sql if a.type == t or L.is_null(t) else f"cast({a.sql} as {t.simpleString()})" for a in args) + ")", t)


define("nullif", "XX", True)(lambda a: Ex(f"if({a[0].sql} <=> {a[1].sql}, null, {a[0].sql})", a[0].type))


@define("nvl2", "XXX", True)
def nvl2(args):
    a, b, c = args
    t = L.common([b.type, c.type])
    return Ex(f"if({a.sql} is not null, {b.sql}, {c.sql})", t)


# ---- conversions ----


def conversion(dst, accept_null: bool = True):
    def build(args):
        a = args[0]
        if dst == INT and L.is_numeric(a.type) and not L.is_integral(a.type):
            return Ex(f"cast(greatest(least({a.sql}, 2147483647), -2147483648) as int)", INT)
        got = L.lenient(a.sql, a.type, dst)
        if got is None:
            raise PipelineError(f"no conversion of {L.kind(a.type)} to {L.kind(dst)}")
        return Ex(got, dst)

    return build


for _names, _t in (("bigint", LONG), ("double", DOUBLE), ("float", L.FLOAT), ("int", INT), ("string", STRING), ("date", TIME), ("boolean", BOOL)):
    define(_names, "X")(conversion(_t))


# ---- date and time with formats ----

#: Strftime specifiers and their Java patterns; %- drops the padding.
SPECIFIERS = {"Y": "yyyy", "m": "MM", "-m": "M", "d": "dd", "-d": "d", "H": "HH", "-H": "H", "I": "hh", "-I": "h", "M": "mm", "-M": "m", "S": "ss", "-S": "s", "p": "a", "y": "yy", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "f": "SSSSSS", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "'%'"}


def java_pattern(sql: str) -> str:
    m = re.fullmatch(r"\(*'((?:[^'\\]|\\.)*)'\)*", sql)
    if not m:
        raise PipelineError("a datetime format has to be a literal")
    out, at = "", 0
    text_ = m[1].replace("\\'", "'").replace("\\\\", "\\")
    while at < len(text_):
        c = text_[at]
        if c == "%":
            spec = text_[at + 1 : at + 3] if text_[at + 1 : at + 2] == "-" else text_[at + 1 : at + 2]
            if spec not in SPECIFIERS:
                raise PipelineError(f"unknown datetime specifier %{spec}")
            out += SPECIFIERS[spec]
            at += 1 + len(spec)
        else:
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            at += 1
    return L.quote(out)


DEFAULT_FORMAT = "'%Y-%m-%d %H:%M:%S'"


@define("timestamp", "s?ss")
def timestamp(args):
    fmt = java_pattern(args[1].sql if len(args) > 1 and not L.is_null(args[1].type) else DEFAULT_FORMAT)
    parsed = f"try_to_timestamp({args[0].sql}, {fmt})"
    return Ex(f"to_utc_timestamp({parsed}, {args[2].sql})" if len(args) > 2 and not L.is_null(args[2].type) else parsed, TIME)


@define("to_unix_timestamp unix_timestamp", "x?ss", True)
def to_unix_timestamp(args):
    """Text gives a double, null where it can't be parsed; a datetime gives a long."""
    if L.is_time(args[0].type):
        return Ex(f"unix_seconds(cast({args[0].sql} as timestamp))", LONG)
    if L.is_null(args[0].type):
        return Ex("cast(null as double)", DOUBLE)
    return Ex(f"cast(unix_seconds({timestamp(args).sql}) as double)", DOUBLE)


@define("make_timestamp", "iiiiii?s")
def make_timestamp(args):
    made = f"try_make_timestamp({', '.join(a.sql for a in args[:6])})"
    return Ex(f"to_utc_timestamp({made}, {args[6].sql})" if len(args) > 6 and not L.is_null(args[6].type) else made, TIME)


# ---- the two profiles ----


def profiled(profile: str) -> None:
    """Defines the functions of registry.PROFILES for `standard` or `reference`."""
    plain = profile == "standard"
    if profile not in ("standard", "reference"):
        raise ValueError(profile)
    define("bit_and", LONGS)(fold("&") if plain else lambda args: Ex("0L", LONG))
    convert = "lower(conv({}, {}, {}))" if plain else "reverse(lower(conv({}, {}, {})))"
    define("conv", "sii")(lambda a: Ex(f"if({a[1].sql} between 2 and 36 and {a[2].sql} between 2 and 36, {convert.format(*(x.sql for x in a))}, null)", STRING))
    define("date_from_unix_date", "i")(lambda a: Ex(f"cast(date_from_unix_date({a[0].sql}) as timestamp)" if plain else f"cast(date_add(date'0001-01-01', {a[0].sql} - 1) as timestamp)", TIME))
    day = "cast({} as date)"
    define("last_day", "t")(lambda a: Ex(f"cast(last_day({a[0].sql}) as timestamp)" if plain else f"cast(date_sub({day.format(a[0].sql)}, 1) as timestamp)", TIME))
    define("next_day", "t")(lambda a: Ex(f"cast(date_add({day.format(a[0].sql)}, 1) as timestamp)", TIME))
    define("dayofweek", "t")(lambda a: Ex(f"dayofweek({a[0].sql})" if plain else f"if(dayofweek({a[0].sql}) = 1, 0, dayofweek({a[0].sql}))", INT))


profiled("reference")
