"""The scalar functions, as Spark SQL templates, so that every call stays inside Catalyst.

A row is: names | argument kinds | result | template | flags. Argument kinds: d double, l long, i int, n number, s string,
b bool, t datetime, a array, o object, x any; a kind in lower case refuses null (an error cell), one in upper case takes
it; `?` marks arguments that may be missing, `*` repeats the last kind. Results are a kind, `=0` (the type of an argument),
`[0]` (the element type of an argument) or a rule by name. In templates {a} to {d} are the arguments. The flag `null` says
that null is a regular result, otherwise a null result of non-null arguments is an error cell.

Where the names' common meaning and the pipeline language differ, the language's meaning is kept (for example 0-based
substring, slice and element_at, log(value, base), date functions on timestamps). The table of profiles below lists the
functions for which `standard` takes the plain meaning instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import types as T

from ..plans import types as L
from ..plans.syntax import PipelineError
from ..plans.types import BOOL, DOUBLE, FLOAT, INT, LONG, NULL, STRING, TIME, Ex

KINDS = {"d": DOUBLE, "l": LONG, "i": INT, "s": STRING, "b": BOOL, "t": TIME}
WHITE = r"\\p{{IsWhite_Space}}+"
HAVERSINE = "pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2)"
TO_DATE = "cast({a} as date)"

TABLE = rf"""
abs | n | =0 | abs({{a}})
acos | d | d | acos({{a}})
acosh | d | d | acosh({{a}})
asin | d | d | asin({{a}})
asinh | d | d | asinh({{a}})
atan | d | d | atan({{a}})
atan2 | dd | d | atan2({{a}}, {{b}})
atanh | d | d | atanh({{a}})
cbrt | d | d | cbrt({{a}})
ceil ceiling | d | d | cast(ceil({{a}}) as double)
cos | d | d | cos({{a}})
cosh | d | d | cosh({{a}})
cot | d | d | cot({{a}})
csc | d | d | csc({{a}})
degrees | d | d | degrees({{a}})
e | | d | e()
exp | d | d | exp({{a}})
expm1 | d | d | expm1({{a}})
factorial | l | l | factorial(cast(if({{a}} between 0 and 20, {{a}}, null) as int)) | null
floor | d | d | cast(floor({{a}}) as double)
hypot | dd | d | hypot({{a}}, {{b}})
isnan | d | b | isnan({{a}})
ln | d | d | case when {{a}} < 0 then double('NaN') when {{a}} = 0 then double('-Infinity') else ln({{a}}) end
log | dd | d | case when {{a}} < 0 or {{b}} < 0 then double('NaN') when {{a}} = 0 then double('-Infinity') else log({{b}}, {{a}}) end
log10 | d | d | case when {{a}} < 0 then double('NaN') when {{a}} = 0 then double('-Infinity') else log10({{a}}) end
log1p | d | d | case when {{a}} < -1 then double('NaN') when {{a}} = -1 then double('-Infinity') else log1p({{a}}) end
log2 | d | d | case when {{a}} < 0 then double('NaN') when {{a}} = 0 then double('-Infinity') else log2({{a}}) end
mod | dd | d | pmod({{a}}, abs(nullif({{b}}, 0))) + 0D
nanvl | dd | d | nanvl({{a}}, {{b}})
pi | | d | pi()
positive | X | =0 | {{a}} | null
pow power | dd | d | pow({{a}}, {{b}})
radians | d | d | radians({{a}})
rand random | | d | rand()
round | d | d | round({{a}})
sec | d | d | sec({{a}})
sign signum | d | d | signum({{a}})
sin | d | d | sin({{a}})
sinh | d | d | sinh({{a}})
sqrt | d | d | sqrt({{a}})
tan | d | d | tan({{a}})
tanh | d | d | tanh({{a}})
distance | dddd | d | 2*6371.0D*atan2(sqrt({HAVERSINE}), sqrt(1-({HAVERSINE})))
bit_count | l | i | bit_count({{a}})
bit_get getbit | ll | i | cast(if({{b}} between 0 and 63, bit_get({{a}}, cast(if({{b}} between 0 and 63, {{b}}, 0) as int)), null) as int)
bit_not | l | l | ~{{a}}
shiftleft | ll | l | shiftleft({{a}}, cast({{b}} as int))
shiftright | ll | l | shiftright({{a}}, cast({{b}} as int))
shiftrightunsigned | ll | l | shiftrightunsigned({{a}}, cast({{b}} as int))
ascii | s | i | if({{a}} = '', null, ascii({{a}})) | null
bit_length | s | i | bit_length({{a}})
btrim trim | s | s | regexp_replace({{a}}, '^{WHITE}|{WHITE}$', '')
char chr | l | s | char({{a}})
char_length character_length | s | l | cast(char_length({{a}}) as bigint)
contains | SS | b | contains({{a}}, {{b}}) | null
endswith | ss | b | endswith({{a}}, {{b}})
instr | ss | l | cast(instr({{a}}, {{b}}) as bigint)
lcase lower | s | s | lower({{a}})
levenshtein | ss | l | cast(levenshtein({{a}}, {{b}}) as bigint)
ltrim | s | s | regexp_replace({{a}}, '^{WHITE}', '')
regexp regexp_like | ss | b | {{a}} rlike {{b}}
regexp_extract_all | ss | array<string> | regexp_extract_all({{a}}, {{b}}, 0)
repeat | sl | s | repeat({{a}}, cast({{b}} as int))
rtrim | s | s | regexp_replace({{a}}, '{WHITE}$', '')
space | l | s | space(cast({{a}} as int))
split | ss | array<string> | split({{a}}, concat('\\Q', {{b}}, '\\E'))
split_part | ssl | s | if({{c}} = 0 or {{c}} > size(split({{a}}, concat('\\Q', {{b}}, '\\E'))), null, split_part({{a}}, {{b}}, cast(if({{c}} = 0, 1, {{c}}) as int)))
startswith | ss | b | startswith({{a}}, {{b}})
substring | sii | s | substring({{a}}, if({{b}}<0, length({{a}})+{{b}}, {{b}})+1, if({{c}}<0, length({{a}})+{{c}}-if({{b}}<0, length({{a}})+{{b}}, {{b}}), {{c}}))
substring_index | ssl | s | substring_index({{a}}, {{b}}, cast({{c}} as int))
translate | sss | s | if(octet_length({{b}}) = octet_length({{c}}), translate({{a}}, {{b}}, {{c}}), null)
ucase upper | s | s | upper({{a}})
uuid | | s | uuid()
add_months | ti | t | cast(add_months({TO_DATE}, {{b}}) as timestamp)
current_date | | t | cast(current_date() as timestamp)
current_timestamp now | | t | current_timestamp()
current_timezone | | s | 'UTC'
date_add | tl | t | cast(date_add({TO_DATE}, cast({{b}} as int)) as timestamp)
date_diff | tt | l | cast(datediff({{a}}, {{b}}) as bigint)
date_sub | tl | t | cast(date_sub({TO_DATE}, cast({{b}} as int)) as timestamp)
day dayofmonth | t | i | dayofmonth({{a}})
dayofyear | t | i | dayofyear({{a}})
from_utc_timestamp to_utc_timestamp | ts | t | to_utc_timestamp({{a}}, {{b}})
hour | t | i | hour({{a}})
make_date | iii | t | try_to_timestamp(printf('%04d-%02d-%02d', {{a}}, {{b}}, {{c}}), 'yyyy-MM-dd') | null
minute | t | i | minute({{a}})
month | t | i | month({{a}})
quarter | t | i | quarter({{a}})
second | t | i | second({{a}})
timestamp_micros | l | t | timestamp_micros({{a}})
timestamp_millis | l | t | timestamp_millis({{a}})
timestamp_seconds | l | t | timestamp_seconds({{a}})
unix_date | t | l | unix_seconds({{a}}) div 86400
unix_micros | t | l | unix_micros({{a}})
unix_millis | t | l | unix_millis({{a}})
unix_seconds | t | l | unix_seconds({{a}})
weekday | t | i | weekday({{a}})
weekofyear | t | i | weekofyear({{a}})
year | t | i | year({{a}})
array_contains | aX | b | exists({{a}}, e_ -> e_ <=> {{b}})
array_distinct | a | =0 | array_distinct({{a}})
array_except | aa | =0 | filter({{a}}, e_ -> not exists({{b}}, f_ -> f_ <=> e_))
array_intersect | aa | =0 | filter({{a}}, e_ -> exists({{b}}, f_ -> f_ <=> e_))
array_max | a | [0] | array_max({{a}}) | null
array_min | a | [0] | array_min({{a}}) | null
array_position | aX | l | nullif(coalesce(array_position({{a}}, {{b}}), 0), 0) | null
array_remove | aX | =0 | filter({{a}}, e_ -> not (e_ <=> {{b}}))
array_size size | a | l | cast(size({{a}}) as bigint)
array_union | aa | =0 | concat({{a}}, array_except({{b}}, {{a}}))
arrays_overlap | aa | b | coalesce(arrays_overlap({{a}}, {{b}}), false)
shuffle | a | =0 | shuffle({{a}})
map_contains_key | os | b | map_contains_key({{a}}, {{b}})
map_keys | o | array<string> | map_keys({{a}})
get_json_object | ss | s | get_json_object({{a}}, {{b}}) | null
json_array_length | S | i | if({{a}} is null, null, coalesce(json_array_length({{a}}), 0)) | null
json_object_keys | S | array<string> | if({{a}} is null, null, coalesce(json_object_keys({{a}}), cast(array() as array<string>))) | null
isnotnull | X | b | ({{a}} is not null)
isnull | X | b | ({{a}} is null)
"""


@dataclass(frozen=True)
class Function:
    name: str
    kinds: str
    build: Callable[[list[Ex]], Ex]
    null_result: bool = False

    def bounds(self) -> tuple[int, int | None]:
        kinds = self.kinds.replace("?", "")
        return len(kinds.replace("*", "")), None if "*" in kinds else len(kinds)


FUNCTIONS: dict[str, Function] = {}
#: Functions whose language meaning is a slip of an obvious intent: template of the plain meaning, of the language's own.
PROFILES = {
    "bit_and": ("standard folds all bits; reference always gives 0"),
    "conv": ("standard is the usual conversion; reference has the digits least significant first"),
    "date_from_unix_date": ("standard counts from 1970-01-01; reference from 0001-01-01"),
    "last_day": ("standard is the month's end; reference the day before"),
    "next_day": ("both give the following day: the function takes one argument"),
    "dayofweek": ("standard has Sunday as 1; reference as 0"),
}


def result_type(rule: str, args: list[Ex]) -> T.DataType:
    if rule in KINDS:
        return KINDS[rule]
    if m := re.fullmatch(r"=(\d)", rule):
        return args[int(m[1])].type
    if m := re.fullmatch(r"\[(\d)\]", rule):
        return args[int(m[1])].type.elementType
    return T.DataType.fromDDL(rule)


def coerce(e: Ex, want: str, name: str) -> str:
    """The SQL of an argument in the kind that a function wants. Numbers pass freely, text passes as datetime only."""
    t, w = e.type, want.lower()
    if w == "x":
        return e.sql
    if L.is_null(t):
        dst = {"n": "double", "a": "array<string>", "o": "map<string,string>"}.get(w) or KINDS[w].simpleString()
        return f"cast(null as {dst})"
    if w in "dlin" and L.is_numeric(t):
        return e.sql if w == "n" or t == KINDS[w] else f"try_cast({e.sql} as {KINDS[w].simpleString()})"
    if w == "t" and (L.is_time(t) or t == STRING):
        return L.parse_time(e.sql) if t == STRING else f"cast({e.sql} as timestamp)" if t != TIME else e.sql
    if (w == "s" and t == STRING) or (w == "b" and t == BOOL) or (w == "a" and L.is_array(t)) or (w == "o" and L.is_object(t)):
        return e.sql
    raise PipelineError(f"{name}: no {L.kind(t)} where {w!r} is expected")


def call(f: Function, args: list[Ex]) -> Ex:
    """Binds a call: pads missing arguments with null, coerces, and derives value and error."""
    least, most = f.bounds()
    kinds = f.kinds.replace("?", "")
    if most is not None and len(args) > most:
        raise PipelineError(f"{f.name} takes at most {most} arguments")
    required = len(f.kinds.split("?")[0].replace("*", ""))
    while len(args) < min(least, required):
        args = [*args, Ex("null", NULL)]
    flat = kinds.replace("*", "")
    flat = flat + flat[-1:] * (len(args) - len(flat)) if "*" in kinds else flat[: len(args)]
    got = [Ex(f"({coerce(a, k, f.name)})" if k.lower() != "x" else f"({a.sql})", a.type if k.lower() in "xao" or L.is_null(a.type) and k.lower() == "n" else KINDS.get(k.lower(), a.type), a.err) for a, k in zip(args, flat, strict=True)]
    out = f.build(got)
    refused = [g.sql for g, k in zip(got, flat, strict=True) if k.islower()]
    own = []
    if refused:
        own.append(f"when {' or '.join(f'{s} is null' for s in refused)} then {L.quote(f'{f.name}: null or unfit argument')}")
    if not f.null_result and args:
        given = [f"{g.sql} is not null" for g in got]
        own.append(f"when {' and '.join(given)} and ({out.sql}) is null then {L.quote(f'{f.name} failed')}")
    own_sql = f"case {' '.join(own)} end" if own else None
    errs = [a.err for a in args if a.err] + ([own_sql] if own_sql else [])
    sql = out.sql
    before = [a.err for a in args if a.err and a.err.startswith("`__err_")]
    if f.null_result and before:  # an argument that is an error makes an error, whatever the function does with null
        sql = f"if(coalesce({', '.join(before)}) is null, {sql}, null)" if len(before) > 1 else f"if({before[0]} is null, {sql}, null)"
    return Ex(sql, out.type, (f"coalesce({', '.join(errs)})" if len(errs) > 1 else errs[0]) if errs else None)


def define(names: str, kinds: str, null_result: bool = False):
    def add(build: Callable[[list[Ex]], Ex]):
        for n in names.split():
            FUNCTIONS[n] = Function(n, kinds, build, null_result)
        return build

    return add


def template(rule: str, text: str) -> Callable[[list[Ex]], Ex]:
    return lambda args: Ex(text.format(**dict(zip("abcd", (a.sql for a in args), strict=False))), result_type(rule, args))


for line in TABLE.strip().split("\n"):
    # the template itself may hold | in a pattern, so the outer fields are cut off from both ends
    names_, kinds_, result_, rest_ = (x.strip() for x in line.split("|", 3))
    flag_ = rest_.endswith("| null")
    define(names_, kinds_, flag_)(template(result_, rest_.removesuffix("| null").strip()))
