"""One row for each scalar function: (call, expected value); a few with expected null for the edge cases."""

import math
from datetime import datetime

import pytest

from sluice.engine import Engine
from sluice.functions.registry import FUNCTIONS

D = datetime
CASES = [
    ("abs(-3)", 3), ("acos(1.0)", 0.0), ("acosh(1.0)", 0.0), ("asin(0.0)", 0.0), ("asinh(0.0)", 0.0), ("atan(0.0)", 0.0), ("atan2(0.0, 1.0)", 0.0), ("atanh(0.0)", 0.0),
    ("cbrt(27.0)", 3.0), ("ceil(1.2)", 2.0), ("ceiling(1.2)", 2.0), ("cos(0.0)", 1.0), ("cosh(0.0)", 1.0), ("cot(1.0)", 1 / math.tan(1)), ("csc(1.0)", 1 / math.sin(1)),
    ("degrees(PI)", 180.0), ("e()", math.e), ("exp(0)", 1.0), ("expm1(0)", 0.0), ("factorial(5)", 120), ("factorial(21)", None), ("factorial(-1)", None), ("floor(-1.2)", -2.0),
    ("hypot(3, 4)", 5.0), ("isnan(1.0)", False), ("ln(E)", 1.0), ("log(8, 2)", 3.0), ("log10(100)", 2.0), ("log1p(0)", 0.0), ("log2(8)", 3.0), ("mod(-7, 3)", 2.0), ("nanvl(1.0, 2.0)", 1.0),
    ("pi()", math.pi), ("positive(4)", 4), ("pow(2, 3)", 8.0), ("power(2, 3)", 8.0), ("radians(180)", math.pi), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("sec(0)", 1.0),
    ("sign(-2.0)", -1.0), ("signum(3.0)", 1.0), ("sin(0)", 0.0), ("sinh(0)", 0.0), ("sqrt(9)", 3.0), ("tan(0)", 0.0), ("tanh(0)", 0.0),
    ("bucket(5, 1, 4, 9)", 2), ("bucket(0, 1, 4)", 0), ("bucket(10, 1, 4)", 2), ("distance(0.0, 0.0, 0.0, 1.0)", 2 * 6371 * math.asin(math.sin(math.radians(0.5)))),
    ("bit_and(6, 3)", 0), ("bit_count(7)", 3), ("bit_get(5, 2)", 1), ("bit_get(5, 70)", None), ("bit_not(0)", -1), ("bit_or(4, 1, 2)", 7), ("bit_xor(6, 3)", 5), ("getbit(5, 0)", 1), ("shiftleft(1, 4)", 16), ("shiftright(-16, 2)", -4), ("shiftrightunsigned(16, 2)", 4),
    ('ascii("A")', 65), ('ascii("")', None), ('bit_length("ab")', 16), ('btrim(" \\ta ")', "a"), ("char(65)", "A"), ("chr(65)", "A"), ('char_length("äb")', 2), ('character_length("abc")', 3),
    ('concat("a", "b", "c")', "abc"), ("concat(array(1), array(2))", [1, 2]), ('concat_ws("-", "a", array("b", "c"), null)', "a-b-c"), ('contains("abc", "b")', True), ('contains(null, "b")', None),
    ("elt(1, 5, 6)", 5), ("elt(9, 5)", None), ('endswith("abc", "bc")', True), ('instr("abc", "c")', 3), ('instr("abc", "x")', 0), ('lcase("AB")', "ab"), ('len("äb")', 3), ("len(array(1, 2))", 2), ('length("abc")', 3),
    ('levenshtein("kitten", "sitting")', 3), ('lower("AB")', "ab"), ('ltrim("  a ")', "a "), ('regexp("abc", "b.")', True), ('regexp_like("abc", "^b")', False), ('regexp_extract("a12b", "([a-z])(\\\\d+)", 2)', "12"), ('regexp_extract("a12b", "([a-z])(\\\\d+)")', "a"),
    ('regexp_extract("a12b", "x(y)")', ""), ('regexp_extract("a12", "(a)", 7)', ""), ('regexp_extract_all("a1b22", "\\\\d+")', ["1", "22"]), ('regexp_replace("a1b2", "\\\\d", "x")', "axbx"), ('repeat("ab", 3)', "ababab"), ('rtrim(" a ")', " a"), ("space(3)", "   "),
    ('split("a.b.c", ".")', ["a", "b", "c"]), ('split_part("a,b,c", ",", 2)', "b"), ('split_part("a,b", ",", 5)', None), ('startswith("abc", "ab")', True), ('substring("abcdef", 1, 3)', "bcd"), ('substring("abcdef", -3, 2)', "de"), ('substring("abcdef", 1, -1)', "bcde"),
    ('substring_index("a.b.c", ".", 2)', "a.b"), ('substring_index("a.b.c", ".", -1)', "c"), ('translate("abc", "ab", "xy")', "xyc"), ('translate("abc", "ab", "x")', None), ('trim(" a ")', "a"), ('ucase("ab")', "AB"), ('upper("ab")', "AB"),
    ('add_months("2020-01-31", 1)', D(2020, 2, 29)), ("current_timezone()", "UTC"), ('date_add("2020-02-28", 2)', D(2020, 3, 1)), ('date_diff("2020-03-01", "2020-02-28")', 2), ("date_from_unix_date(719163)", D(1970, 1, 1)), ('date_sub("2020-03-01", 1)', D(2020, 2, 29)),
    ('day("2020-03-05")', 5), ('dayofmonth("2020-03-05")', 5), ('dayofweek("2023-01-01")', 0), ('dayofweek("2023-01-02")', 2), ('dayofyear("2020-02-01")', 32), ('from_utc_timestamp("2020-01-01 08:00:00", "Asia/Shanghai")', D(2020, 1, 1)), ('hour("2020-01-01 08:09:10")', 8),
    ('last_day("2020-03-01")', D(2020, 2, 29)), ("make_date(2020, 2, 29)", D(2020, 2, 29)), ("make_date(2021, 2, 29)", None), ('make_timestamp(2020, 1, 1, 8, 0, 0, "Asia/Shanghai")', D(2020, 1, 1)), ("make_timestamp(2020, 1, 1, 8, 0, 0)", D(2020, 1, 1, 8)), ("make_timestamp(2020, 13, 1, 8, 0, 0)", None),
    ('minute("2020-01-01 08:09:10")', 9), ('month("2020-03-01")', 3), ('next_day("2020-02-28")', D(2020, 2, 29)), ('quarter("2020-05-01")', 2), ('second("2020-01-01 08:09:10")', 10), ('timestamp("2020/1/2 3:4", "%Y/%-m/%-d %-H:%-M")', D(2020, 1, 2, 3, 4)), ('timestamp("2020-01-01 08:00:00", "%Y-%m-%d %H:%M:%S", "Asia/Shanghai")', D(2020, 1, 1)), ('timestamp("x")', None),
    ("timestamp_micros(1000000)", D(1970, 1, 1, 0, 0, 1)), ("timestamp_millis(1000)", D(1970, 1, 1, 0, 0, 1)), ("timestamp_seconds(1)", D(1970, 1, 1, 0, 0, 1)), ('to_unix_timestamp("1970-01-02 00:00:00")', 86400.0), ('to_unix_timestamp("x")', None), ("to_unix_timestamp(timestamp_seconds(5))", 5), ('to_utc_timestamp("2020-01-01 08:00:00", "Asia/Shanghai")', D(2020, 1, 1)),
    ('unix_date("1970-01-03")', 2), ('unix_micros("1970-01-01 00:00:01")', 1000000), ('unix_millis("1970-01-01 00:00:01")', 1000), ('unix_seconds("1970-01-01 00:00:01")', 1), ('unix_timestamp("1970-01-02 00:00:00")', 86400.0), ('weekday("2023-01-02")', 0), ('weekofyear("2023-01-02")', 1), ('year("2020-01-01")', 2020),
    ("array(1, 2)", [1, 2]), ("array_contains(array(1, null), null)", True), ("array_distinct(array(1, 2, 1))", [1, 2]), ("array_except(array(1, 1, 2), array(2))", [1, 1]), ("array_intersect(array(1, 1, 2), array(1))", [1, 1]), ('array_join(array(1, 2), "-")', "1-2"), ('array_join(array("a", null), "-", "?")', "a-?"), ("array_max(array(1, 3, 2))", 3), ("array_min(array(1, 3, 2))", 1),
    ("array_position(array(5, 6), 6)", 2), ("array_position(array(5), 9)", None), ("array_remove(array(1, 2, 1), 1)", [2]), ("array_repeat(7, 2)", [7, 7]), ("array_size(array(1))", 1), ("array_union(array(1, 1), array(1, 2))", [1, 1, 2]), ("arrays_overlap(array(1), array(null, 2))", False), ("arrays_zip(array(1, 2, 3), array(4, 5))", [[1, 4], [2, 5]]),
    ("element_at(array(5, 6), 1)", 6), ("element_at(array(5), 3)", None), ("flatten(array(array(1), array(2)))", [1, 2]), ("flatten(array(1))", [1]), ("size(array(1, 2))", 2), ("slice(array(1, 2, 3, 4), 1, 3)", [2, 3]), ("slice(array(1, 2, 3, 4), -3, -1)", [2, 3]), ("slice(array(1, 2), 2, 1)", None),
    ('map_contains_key(map_from_arrays(array("a"), array(1)), "a")', True), ('map_from_arrays(array("a", "a"), array(1, 2))', {"a": 2}), ('map_from_arrays(array("a", "b"), array(1))', {"a": 1}), ('map_keys(map_from_arrays(array("a"), array(1)))', ["a"]), ('map_values(map_from_arrays(array("a"), array(1)))', [1]),
    ('get_json_array("{\\"a\\":[1,2]}", "$.a[*]")', ["1", "2"]), ('get_json_array("{\\"a\\":1}", "$.a")', ["1"]), ('get_json_object("{\\"a\\":{\\"b\\":\\"x\\"}}", "$.a.b")', "x"), ('json_array_length("[1,2]")', 2), ('json_array_length("{}")', 0), ('json_object_keys("{\\"a\\":1}")', ["a"]), ('json_object_keys("[1]")', []), ("to_json(array(1, 2))", "[1,2]"), ('to_json("a")', '"a"'), ("to_json(3)", "3"),
    ("bool_and(true, false)", False), ("bool_or(true, false)", True), ("every(true, true)", True), ("case when false then 1 when true then 2 else 3 end", 2), ("case when false then 1 end", None), ("coalesce(null, 2)", 2), ("if(true, 1, 2)", 1), ("if(null, 1, 2)", None), ("ifnull(null, 4)", 4), ("isnotnull(1)", True), ("isnull(null)", True), ("nullif(1, 1)", None), ("nullif(1, 2)", 1), ("nvl(null, 5)", 5), ("nvl2(1, 2, 3)", 2),
    ('bigint("12")', 12), ('boolean("true")', True), ('boolean("yes")', False), ("boolean(null)", False), ("boolean(2)", True), ('date("2020-01-01 10:00:00")', D(2020, 1, 1, 10)), ('double("1.5")', 1.5), ('float("1.5")', 1.5), ("int(3.9)", 3), ('int("x")', None), ("string(1.0)", "1"), ("string(12)", "12"), ('conv("ff", 16, 10)', "552"),
    ("1 + 2", 3), ("1 / 2", 0), ("7.0 / 2", 3.5), ("1 / 0", None), ("7 div 2", 3), ("-7 % 3", -1), ("2147483647 + 1", None), ("2147483648 + 1", 2147483649), ('"a" + "b"', "ab"), ("null - null", None), ("1 == 1.0", True), ("1 <> 2", True), ("1 == null", None), ("true and false", False), ("false and null", None), ("true or null", None), ("not true", False), ("!true", False), ("-(3)", -3), ("+3", 3), ("~0", -1), ("null is null", True), ("1 is not null", True), ("array(1, 2)[1]", 2), ("array(1)[4]", None), ('map_from_arrays(array("k"), array(3)).k', 3), ("PI > 3", True), ('"b" > "a"', True), ("6 & 3", 0),
]
RANDOM = {"rand": float, "random": float, "uuid": str, "now": D, "current_timestamp": D, "current_date": D, "shuffle": list}


def test_all_functions_have_a_case():
    import re

    seen = set(re.findall(r"[a-z_0-9]+(?=\()", " ".join(c for c, _ in CASES))) | set(RANDOM) | {"case"}
    assert len(FUNCTIONS) == 181 and not set(FUNCTIONS) - seen


def test_values(spark):
    columns = ", ".join(f"c{i} = {c}" for i, (c, _) in enumerate(CASES))
    engine = Engine(spark, f"t(x as int) | project {columns};")
    row = engine.run("t", spark.createDataFrame([(1,)], "x int")).first()
    wrong = []
    for i, (call, want) in enumerate(CASES):
        got = row[f"c{i}"]
        if got != (pytest.approx(want, abs=1e-12) if isinstance(want, float) else want):
            wrong.append((call, got, want))
    assert not wrong


def test_values_of_columns(spark):
    """The same templates on columns instead of literals, without constant folding."""
    engine = Engine(spark, """t(s as string, n as long, d as double, a as array)
        | project u = upper(s), p = split_part(s, ",", n), q = n / 2, r = d / n, e = a[n], m = mod(d, n), z = substring(s, n, 1), l = log(d, 2);""")
    rows = spark.createDataFrame([("a,b", 1, 8.0, [1, 2]), ("x", 0, 1.0, []), (None, None, None, None)], "s string, n long, d double, a array<int>")
    got = [tuple(r)[4:] for r in engine.run("t", rows).collect()]
    assert got[0] == ("A,B", "a", 0, 8.0, 2, 0.0, ",", 3.0)
    assert got[1] == ("X", None, 0, None, None, None, "x", 0.0)
    assert got[2] == (None,) * 8


def test_random_functions(spark):
    row = Engine(spark, "t(x as int) | project a = rand(), b = random(), c = uuid(), d = now(), e = current_timestamp(), f = current_date(), g = shuffle(array(1, 2));").run("t", spark.createDataFrame([(1,)], "x int")).first()
    assert [type(v) for v in row[1:]] == [RANDOM[n] for n in ("rand", "random", "uuid", "now", "current_timestamp", "current_date", "shuffle")]
    assert 0 <= row.a < 1 and len(row.c) == 36 and sorted(row.g) == [1, 2]


def test_profiles(spark):
    from sluice.functions.special import profiled

    profiled("standard")
    try:
        row = Engine(spark, 't(x as int) | project a = bit_and(6, 3), b = conv("ff", 16, 10), c = date_from_unix_date(1), d = last_day("2020-02-03"), e = dayofweek("2023-01-01");').run("t", spark.createDataFrame([(1,)], "x int")).first()
        assert tuple(row)[1:] == (2, "255", D(1970, 1, 2), D(2020, 2, 29), 1)
    finally:
        profiled("reference")
