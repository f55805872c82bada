"""Registered queries that compare each function and operator over whole columns, with nulls and edges, with DuckDB.

A case is (name, expression of the language, SQL). Floating results are rounded, so that the last bit may differ.
"""

from __future__ import annotations

from .queries import Query

Case = tuple[str, str, str]


def side_by_side(table: str, declared: str, key: str, before: list[Case], cases: list[Case]) -> Query:
    """One query of all cases; `before` are helper columns that the cases use."""
    names = ", ".join(n for n, _, _ in cases)
    first = f"| project {', '.join(f'{n} = {e}' for n, e, _ in before)} " if before else ""
    text = f"({declared}) {first}| project {', '.join(f'{n} = {e}' for n, e, _ in cases)} | project-keep {key}, {names};"
    inner = f"SELECT *, {', '.join(f'{s} AS {n}' for n, _, s in before)} FROM {table}" if before else f"SELECT * FROM {table}"
    return Query(table, text, f"SELECT {key}, {', '.join(f'{s} AS {n}' for n, _, s in cases)} FROM ({inner})")


def rounded(*cases: Case, by: int = 1_000_000) -> list[Case]:
    return [(n, f"round(({e}) * {by}.0)", f"round(({s}) * {by})") for n, e, s in cases]


SIZES = "p_partkey as long, p_name as string, p_brand as string, p_type as string, p_size as int, p_retailprice as double"
ORDERS = "o_orderkey as long, o_custkey as long, o_orderstatus as string, o_totalprice as double, o_orderdate, o_orderpriority as string"
EVENTS = "event_id as long, ts, user_id as long, event_type as string, value as double, props as string"

X = [("x", "p_size / 50.0", "p_size / CAST(50 AS DOUBLE)"), ("z", "if(p_size % 7 == 0, null, p_size / 51.0)", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / CAST(51 AS DOUBLE) END")]
TEXT = [("s", "if(p_size % 7 == 0, null, p_name)", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END")]
DATE = [("d", "case when (o_orderkey % 7 != 0) then o_orderdate end", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END"), ("h", 'timestamp_seconds(o_orderkey * 7919)', "make_timestamp(o_orderkey * 7919 * 1000000)")]
INTS = [("a", "p_size % 3", "p_size % 3"), ("b", "p_size % 2", "p_size % 2"), ("n", "case when (p_size % 7 != 0) then p_size end", "CASE WHEN p_size % 7 <> 0 THEN p_size END")]
CHECK = [("v", "case when (user_id % 5 != 0) then value end", "CASE WHEN user_id % 5 <> 0 THEN value END"), ("p", "case when (user_id % 3 != 0) then user_id > 40 end", "CASE WHEN user_id % 3 <> 0 THEN user_id > 40 END"), ("q", "value > 20.0", "value > 20.0")]


def joined(e: str) -> str:
    return f'array_join({e}, ",")'


def sql_joined(s: str) -> str:
    return f"array_to_string({s}, ',')"


VALUES: dict[str, Query] = {
    "fn_trig_inverse": side_by_side("part", SIZES, "p_partkey", X, rounded(
        ("f_acos", "acos(z)", "acos(z)"), ("f_acosh", "acosh(z + 1.0)", "acosh(z + 1)"), ("f_asin", "asin(z)", "asin(z)"), ("f_asinh", "asinh(z)", "asinh(z)"),
        ("f_atan2", "atan2(z, x - 0.5)", "atan2(z, x - 0.5)"), ("f_atanh", "atanh(z * 0.9)", "atanh(z * 0.9)"), ("f_cosh", "cosh(z)", "cosh(z)"), ("f_sinh", "sinh(z)", "sinh(z)"),
        ("f_tanh", "tanh(z)", "tanh(z)"), ("f_tan", "tan(z)", "tan(z)"), ("f_cot", "cot(z)", "1 / tan(z)"), ("f_csc", "csc(z)", "1 / sin(z)"), ("f_sec", "sec(z)", "1 / cos(z)"))),
    "fn_logarithms": side_by_side("part", SIZES, "p_partkey", X, [
        *rounded(("f_ln", "ln(z)", "ln(z)"), ("f_log10", "log10(z)", "log10(z)"), ("f_log1p", "log1p(z)", "ln(1 + z)"), ("f_log2", "log2(z)", "log2(z)"), ("f_expm1", "expm1(z)", "exp(z) - 1"),
                 ("f_e", "e() * z", "exp(1) * z"), ("f_pi", "pi() * z", "pi() * z"), ("f_pow", "pow(z, 3)", "pow(z, 3)"), ("f_power", "power(z, 0.5)", "sqrt(z)"), ("f_nanvl", "nanvl(ln(x - 0.51), 7.0)", "CASE WHEN x < 0.51 THEN 7 ELSE ln(CASE WHEN x > 0.51 THEN x - 0.51 END) END")),
        ("f_isnan", "isnan(ln(x - 0.51))", "x - 0.51 < 0"), ("f_signum", "signum(x - 0.5)", "CAST(sign(x - 0.5) AS DOUBLE)"), ("f_ceiling", "ceiling(p_retailprice)", "ceil(p_retailprice)"), ("f_positive", "positive(p_size)", "p_size"),
        ("f_conv", "conv(string(p_partkey), 10, 16)", "reverse(lower(to_hex(p_partkey)))"),
        ("f_distance", "round(distance(x * 50, x * 90, z * 40, 0.0 - x * 60))", "round(2 * 6371 * atan2(sqrt(pow(sin(radians(z * 40 - x * 50) / 2), 2) + cos(radians(x * 50)) * cos(radians(z * 40)) * pow(sin(radians(0 - x * 60 - x * 90) / 2), 2)), sqrt(1 - (pow(sin(radians(z * 40 - x * 50) / 2), 2) + cos(radians(x * 50)) * cos(radians(z * 40)) * pow(sin(radians(0 - x * 60 - x * 90) / 2), 2)))))"),
    ]),
    "fn_bits_more": side_by_side("orders", ORDERS, "o_orderkey", [], [
        ("f_bit_and", "bit_and(o_orderkey, 5)", "CAST(0 AS BIGINT)"), ("f_amp", "o_orderkey & 5", "CAST(0 AS BIGINT)"), ("f_tilde", "~ o_orderkey", "~o_orderkey"), ("f_bit_get", "bit_get(o_orderkey, 2)", "CAST((o_orderkey >> 2) & 1 AS INTEGER)"),
        ("f_unsigned", "shiftrightunsigned(o_orderkey - 500, 2)", "CAST(((CAST(o_orderkey - 500 AS HUGEINT) + 18446744073709551616) % 18446744073709551616) // 4 AS BIGINT)"),
    ]),
    "fn_strings_more": side_by_side("part", SIZES, "p_partkey", TEXT, [
        ("f_ascii", "ascii(s)", "ascii(s)"), ("f_bit_length", "bit_length(s)", "CAST(bit_length(s) AS INTEGER)"), ("f_btrim", 'btrim(concat("  ", s, " \\t"))', "s"), ("f_char", "char(p_size + 64)", "chr(p_size + 64)"), ("f_chr", "chr(p_size + 32)", "chr(p_size + 32)"),
        ("f_char_length", "char_length(s)", "length(s)"), ("f_character_length", "character_length(p_type)", "length(p_type)"), ("f_contains", 'contains(s, "bolt")', "contains(s, 'bolt')"), ("f_elt", "elt(2, p_name, p_brand)", "p_brand"), ("f_endswith", 'endswith(p_type, "L")', "ends_with(p_type, 'L')"),
        ("f_lcase", "lcase(s)", "lower(s)"), ("f_lower", "lower(p_type)", "lower(p_type)"), ("f_len", "len(s)", "CAST(strlen(s) AS BIGINT)"), ("f_ltrim", 'ltrim(concat("  ", s))', "s"), ("f_rtrim", 'rtrim(concat(s, "  "))', "s"), ("f_regexp_like", 'regexp_like(p_type, "^[A-M]")', "regexp_matches(p_type, '^[A-M]')"),
        ("f_space", 'concat(space(p_size % 5), "|")', "repeat(' ', p_size % 5) || '|'"), ("f_substring_index", 'substring_index(s, " ", 1)', "split_part(s, ' ', 1)"), ("f_substring_index2", 'substring_index(p_name, " ", -1)', "split_part(p_name, ' ', -1)"), ("f_ucase", "ucase(s)", "upper(s)"), ("f_plus", 's + "-" + p_brand', "s || '-' || p_brand"),
        ("f_unit", 'concat("ü", s)', "'ü' || s"), ("f_bytes", 'length(concat("ü", s))', "CAST(strlen(s) + 2 AS BIGINT)"), ("f_substring_end", "substring(s, -3, 2)", "substr(s, length(s) - 2, 2)"),
    ]),
    "fn_dates_more": side_by_side("orders", ORDERS, "o_orderkey", DATE, [
        ("f_add_months", "add_months(d, 1)", "CAST(CAST(d AS DATE) + INTERVAL 1 MONTH AS TIMESTAMP)"), ("f_timezone", "current_timezone()", "'UTC'"), ("f_from_unix_date", "date_from_unix_date(int(o_orderkey % 20000) + 719163)", "CAST(DATE '1970-01-01' + CAST(o_orderkey % 20000 AS INTEGER) AS TIMESTAMP)"),
        ("f_date_sub", "date_sub(d, 3)", "CAST(CAST(d AS DATE) - 3 AS TIMESTAMP)"), ("f_day", "day(d)", "CAST(day(d) AS INTEGER)"), ("f_dayofweek", "dayofweek(d)", "CAST(CASE WHEN dayofweek(d) = 0 THEN 0 ELSE dayofweek(d) + 1 END AS INTEGER)"),
        ("f_from_utc", 'from_utc_timestamp(d, "Asia/Shanghai")', "d - INTERVAL 8 HOUR"), ("f_to_utc", 'to_utc_timestamp(d, "Asia/Tokyo")', "d - INTERVAL 9 HOUR"), ("f_last_day", "last_day(d)", "CAST(CAST(d AS DATE) - 1 AS TIMESTAMP)"), ("f_next_day", "next_day(d)", "CAST(CAST(d AS DATE) + 1 AS TIMESTAMP)"),
        ("f_make_date", "make_date(year(d), month(d), day(d))", "CAST(CAST(d AS DATE) AS TIMESTAMP)"), ("f_make_bad", "make_date(2021, 2, 28 + int(o_orderkey % 3))", "CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2021-02-28 00:00:00' END"), ("f_make_timestamp", "make_timestamp(year(h), month(h), day(h), hour(h), minute(h), second(h))", "h"),
        ("f_minute", "minute(h)", "CAST(minute(h) AS INTEGER)"), ("f_second", "second(h)", "CAST(second(h) AS INTEGER)"), ("f_micros", "timestamp_micros(o_orderkey * 1001)", "make_timestamp(o_orderkey * 1001)"), ("f_millis", "timestamp_millis(o_orderkey * 77)", "make_timestamp(o_orderkey * 77000)"), ("f_seconds", "timestamp_seconds(o_orderkey)", "make_timestamp(o_orderkey * 1000000)"),
        ("f_unix_date", "unix_date(d)", "CAST(date_diff('day', DATE '1970-01-01', CAST(d AS DATE)) AS BIGINT)"), ("f_unix_micros", "unix_micros(h)", "o_orderkey * 7919 * 1000000"), ("f_unix_millis", "unix_millis(h)", "o_orderkey * 7919 * 1000"), ("f_unix_timestamp", "unix_timestamp(d)", "CAST(epoch(d) AS BIGINT)"), ("f_date", "date(string(d))", "d"),
    ]),
    "fn_arrays_more": side_by_side("part", SIZES, "p_partkey", INTS, [
        ("f_distinct", joined("array_distinct(array(a, b, a))"), "CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || ',' || b END"), ("f_except", joined("array_except(array(a, b, a, 9), array(b))"), sql_joined("list_filter([a, b, a, 9], lambda e: e <> b)")), ("f_intersect", joined("array_intersect(array(a, b, 1), array(1, 2))"), sql_joined("list_filter([a, b, 1], lambda e: e IN (1, 2))")),
        ("f_min", "array_min(array(n, a, 5))", "list_min([CAST(n AS BIGINT), a, 5])"), ("f_remove", joined("array_remove(array(a, b, 0, 1), a)"), sql_joined("list_filter([a, b, 0, 1], lambda e: e <> a)")), ("f_repeat", joined("array_repeat(a, 3)"), sql_joined("[a, a, a]")), ("f_union", joined("array_union(array(a, a), array(b))"), "CASE WHEN a = b THEN a || ',' || a ELSE a || ',' || a || ',' || b END"),
        ("f_overlap", "arrays_overlap(array(a, 7), array(b, 8))", "a = b"), ("f_zip", "arrays_zip(array(a, b), array(p_size, 4))[0][1]", "CAST(p_size AS BIGINT)"), ("f_zip_size", "size(arrays_zip(array(a, b, 1), array(b)))", "CAST(1 AS BIGINT)"), ("f_flatten", joined("flatten(array(array(a, b), array(p_size)))"), sql_joined("[a, b, p_size]")), ("f_values", 'array_join(map_values(map_from_arrays(array("x", "y", "x"), array(a, b, p_size))), ",")', "b || ',' || p_size"),
        ("f_to_json", "to_json(array(a, b))", "'[' || a || ',' || b || ']'"), ("f_to_json_text", "to_json(p_name)", "to_json(p_name)::VARCHAR"), ("f_index", "array(a, b, p_size)[2]", "CAST(p_size AS BIGINT)"), ("f_no_index", "array(a, b)[5]", "CAST(NULL AS BIGINT)"), ("f_null_item", "array_contains(array(n, a), n)", "CASE WHEN n IS NULL THEN true ELSE true END"),
    ]),
    "fn_conditions": side_by_side("events", EVENTS, "event_id", CHECK, [
        ("f_bool_and", "bool_and(p, q)", "CASE WHEN p IS NULL THEN NULL ELSE p AND q END"), ("f_bool_or", "bool_or(p, q)", "CASE WHEN p IS NULL THEN NULL ELSE p OR q END"), ("f_every", "every(q, user_id > 10, p)", "CASE WHEN p IS NULL THEN NULL ELSE q AND user_id > 10 AND p END"), ("f_isnotnull", "isnotnull(v)", "v IS NOT NULL"), ("f_isnull", "isnull(v)", "v IS NULL"),
        ("f_nullif", "nullif(user_id % 3, 0)", "nullif(user_id % 3, 0)"), ("f_nvl", "nvl(v, -1.0)", "coalesce(v, -1.0)"), ("f_float", "float(user_id)", "CAST(user_id AS FLOAT)"), ("f_float_text", "double(float(string(user_id)))", "CAST(user_id AS DOUBLE)"), ("f_case", "case when v is null then 0 when v > 50.0 then 2 else 1 end", "CASE WHEN v IS NULL THEN 0 WHEN v > 50 THEN 2 ELSE 1 END"),
    ]),
    "operators": side_by_side("events", EVENTS, "event_id", CHECK, [
        ("f_plus", "user_id + 1", "user_id + 1"), ("f_plus_double", "round((v + user_id) * 100)", "round((v + user_id) * 100)"), ("f_plus_text", 'event_type + "!"', "event_type || '!'"), ("f_ge", "user_id >= 50", "user_id >= 50"), ("f_ge_null", "v >= 20.0", "v >= 20.0"), ("f_ne", 'event_type != "click"', "event_type <> 'click'"), ("f_ne2", "user_id <> 7", "user_id <> 7"),
        ("f_or", "p or q", "CASE WHEN p IS NULL THEN NULL ELSE p OR q END"), ("f_and", "p && q", "CASE WHEN p IS NULL THEN NULL ELSE p AND q END"), ("f_not", "not p", "NOT p"), ("f_bang", "! q", "NOT q"), ("f_unary_plus", "+ user_id", "user_id"), ("f_unary_minus", "- value", "-value"), ("f_is_null", "v is null", "v IS NULL"), ("f_is_not_null", "v is not null", "v IS NOT NULL"),
        ("f_overflow", "2147483647 + int(user_id)", "CASE WHEN user_id = 0 THEN 2147483647 END"), ("f_mod", "user_id % 7", "user_id % 7"), ("f_mod_zero", "user_id % (user_id % 2)", "CASE WHEN user_id % 2 <> 0 THEN user_id % (user_id % 2) END"),
    ]),
    "fn_random_bounds": side_by_side("orders", ORDERS, "o_orderkey", [("r", "rand()", "0.5"), ("m", "array(1, 2, 3, int(o_orderkey % 9))", "[1, 2, 3, o_orderkey % 9]"), ("u", "uuid()", "''"), ("g", "random()", "0.5"), ("t", "now()", "now()"), ("c", "current_timestamp()", "now()"), ("y", "current_date()", "now()"), ("k", "shuffle(array(1, 2, 3, int(o_orderkey % 9)))", "[]")], [
        ("f_rand", "(r >= 0.0) and (r < 1.0)", "true"), ("f_random", "(g >= 0.0) and (g < 1.0)", "true"), ("f_uuid", 'regexp(u, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")', "true"), ("f_now", 'unix_seconds(t) - unix_seconds(c) == 0', "true"), ("f_after", 't > o_orderdate', "true"), ("f_date", "hour(y) + minute(y) + second(y)", "CAST(0 AS INTEGER)"),
        ("f_shuffle", "(array_size(k) == 4) and (array_size(array_except(k, m)) == 0) and (array_size(array_except(m, k)) == 0)", "true"), ("f_bucket", "bucket(r, 0.0, 1.0)", "CAST(1 AS BIGINT)"),
    ]),
    "lang_precedence": side_by_side("part", SIZES, "p_partkey", [], [
        ("f_mul_first", "1 + p_size * 3 - 4", "CAST(1 + p_size * 3 - 4 AS INTEGER)"), ("f_paren", "(1 + p_size) * 3", "CAST((1 + p_size) * 3 AS INTEGER)"), ("f_or_and", '(p_size > 40) or (p_size > 10) and (p_type == "SMALL")', "p_size > 40 OR p_size > 10 AND p_type = 'SMALL'"), ("f_left", "p_size - 10 - 5", "CAST(p_size - 10 - 5 AS INTEGER)"), ("f_neg", "- p_size + 1", "CAST(-p_size + 1 AS INTEGER)"),
    ]),
    "lang_literals": side_by_side("part", SIZES, "p_partkey", [], [
        ("f_int", "2147483647", "2147483647"), ("f_long", "2147483648", "CAST(2147483648 AS BIGINT)"), ("f_double", "1.", "CAST(1 AS DOUBLE)"), ("f_text", '"a \\"q\\" \\\\ b"', "'a \"q\" \\ b'"), ("f_true", "true", "true"), ("f_false", "false", "false"), ("f_pi", "round(PI * 1000)", "round(pi() * 1000)"), ("f_e", "round(E * 1000)", "round(exp(1) * 1000)"),
    ]),
    "lang_paths": side_by_side("part", SIZES, "p_partkey", [("m", 'map_from_arrays(array("a", "b"), array(array(p_size, 1), array(2, 3)))', "0")], [
        ("f_dot", "m.a[0]", "p_size"), ("f_index", 'm["b"][1]', "3"), ("f_nested", "array(array(1, p_size), array(3, 4))[0][1]", "p_size"), ("f_missing", "m.c is null", "true"),
    ]),
}

VALUES |= {
    "lang_no_stages": Query("nation", "(n_nationkey as int, n_name as string);", "SELECT n_nationkey, n_name FROM nation"),
    "lang_last_definition": Query("nation", '(n_name as string); q(n_nationkey as int) | project twice = n_nationkey * 2;', "SELECT n_nationkey, CAST(n_nationkey * 2 AS INTEGER) AS twice FROM nation"),
    "lang_comments_and_names": Query("orders", "(o_orderkey as long)  # the key\n  | project order_id = o_orderkey, island = 1, notes = 2,\n # a line of its own\n not_null = 3 | where(order_id>10)and(island<2);", "SELECT o_orderkey, order_id, 1 AS island, 2 AS notes, 3 AS not_null FROM (SELECT o_orderkey, o_orderkey AS order_id FROM orders) WHERE order_id > 10"),
    "where_or": Query("lineitem", '(l_orderkey as long, l_linenumber as int, l_quantity as double, l_returnflag as string) | where (l_quantity >= 49) or (l_returnflag != "R") and (l_linenumber <> 2);', "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity >= 49 OR l_returnflag <> 'R' AND l_linenumber <> 2"),
    "where_computed": Query("lineitem", "(l_orderkey as long, l_linenumber as int, l_quantity as double, l_returnflag as string) | where not (lower(substring(l_returnflag, 0, 1)) == \"n\") | where (l_quantity * 2 + l_linenumber) / 3 > 20.0;", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE lower(substr(l_returnflag, 1, 1)) <> 'n' AND (l_quantity * 2 + l_linenumber) / 3 > 20.0"),
}
