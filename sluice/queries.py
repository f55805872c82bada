"""Registered queries: one for each operator of the engine, with the DuckDB text that gives the same rows."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .sources.fetch import FetchSource, function_source
from .sources.tables import TableSource


@dataclass(frozen=True)
class Query:
    table: str
    text: str  # of a pipeline q
    sql: str | None
    sources: dict = field(default_factory=dict)  # name -> (table, key) or a function of (spark, sf_dir)
    udfs: dict = field(default_factory=dict)
    order_by: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        sources = {n: s(spark, sf_dir) if callable(s) else TableSource(read(s[0]), s[1]) for n, s in self.sources.items()}
        engine = Engine(spark, f"q{self.text}", sources)
        for name, how in self.udfs.items():
            how(engine) if callable(how) else engine.register(name, *how)
        return engine.run("q", read(self.table), order_by=self.order_by)


LINE = "(l_orderkey as long, l_linenumber as int, l_quantity as double, l_extendedprice as double, l_discount as double, l_returnflag as string)"
ORD = "(o_orderkey as long, o_custkey as long, o_orderstatus as string, o_totalprice as double, o_orderdate, o_orderpriority as string)"
CUST = "(c_custkey as long, c_name as string, c_nationkey as int, c_acctbal as double, c_mktsegment as string)"
PART = "(p_partkey as long, p_name as string, p_brand as string, p_type as string, p_size as int, p_retailprice as double)"
EV = "(event_id as long, ts, user_id as long, event_type as string, value as double, props as string)"

PHONES = {"AUTOMOBILE": ["car", 1], "BUILDING": ["house", 2], "MACHINERY": ["tool", 3]}


def segment_rows(key, fields):
    row = dict(zip(("word", "code"), PHONES[key], strict=True)) if key in PHONES else None
    return [] if row is None else [[row[f] for f in fields]]


async def segment_rows_async(key, fields):
    return segment_rows(key, fields)


def cents(amounts):
    """Whole cents of an Arrow array of amounts."""
    return pc.cast(pc.round(pc.multiply(amounts, 100.0)), pa.int64())


def halved(n):
    if n % 2:
        raise ValueError("odd")
    return n // 2


def in_memory_sqlite() -> Callable:
    """A client of a small database, made anew in each task."""
    def client():
        db = sqlite3.connect(":memory:", check_same_thread=False)
        db.execute("create table t(group_id int, name text, age int)")
        db.executemany("insert into t values (?, ?, ?)", [(3, "Mara", 51), (3, "Nilo", 18), (8, "Odd", 77), (20, "Pia", 5), (20, "Quin", 44), (20, "Rui", 29)])

        def ask(key, fields):
            return [[dict(zip(("name", "age"), r, strict=True))[f] for f in fields] for r in db.execute("select name, age from t where group_id = ?", (key,))]

        return ask

    return client


PEOPLE = "(VALUES (3, 'Mara', 51), (3, 'Nilo', 18), (8, 'Odd', 77), (20, 'Pia', 5), (20, 'Quin', 44), (20, 'Rui', 29)) t(g, name, age)"
NATION = {"nations": ("nation", "n_nationkey")}

QUERIES: dict[str, Query] = {
    "flagship_pricing": Query("lineitem", "(l_returnflag as string, l_linestatus as string, l_quantity as double, l_extendedprice as double, l_discount as double) | where l_discount < 0.05 | project disc_price = l_extendedprice * (1 - l_discount) | summarize q = sum(l_quantity), p = sum(disc_price), n = count() by l_returnflag, l_linestatus | project sum_qty = round(q), sum_price = round(p / 100) | top 10 by sum_price desc | project-remove q, p;",
        "SELECT count(*) AS n, l_returnflag, l_linestatus, round(sum(l_quantity)) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)) / 100) AS sum_price FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag, l_linestatus ORDER BY sum_price DESC LIMIT 10"),
    "where_filter": Query("lineitem", LINE + '| where (l_quantity > 40) and (l_returnflag == "R") and (l_discount <= 0.02);', "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R' AND l_discount <= 0.02"),
    "project": Query("lineitem", LINE + "| project half = l_linenumber / 2, twice = l_quantity * 2, rest = l_orderkey % 7, d = l_orderkey div 10, s = l_linenumber - 10, neg = -l_linenumber;",
        "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, CAST(l_linenumber // 2 AS INTEGER) AS half, l_quantity * 2 AS twice, l_orderkey % 7 AS rest, l_orderkey // 10 AS d, CAST(l_linenumber - 10 AS INTEGER) AS s, CAST(-l_linenumber AS INTEGER) AS neg FROM lineitem"),
    "project_rename": Query("orders", "(o_orderkey as long, o_orderstatus as string) | project-rename id = o_orderkey, status = o_orderstatus;", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders"),
    "project_remove": Query("orders", ORD + "| project-remove o_orderdate, o_totalprice, o_custkey;", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders"),
    "project_keep": Query("orders", ORD + "| project-keep o_orderstatus, o_orderkey;", "SELECT o_orderkey, o_orderstatus FROM orders"),
    "take": Query("orders", "(o_orderkey as long, o_orderstatus as string) | take 25 | summarize n = count(), ids = distinct_count(o_orderkey), known = count_if(o_orderkey >= 0);", "SELECT least(count(*), 25) AS n, least(count(*), 25) AS ids, least(count(*), 25) AS known FROM orders"),
    "take_ordered": Query("orders", "(o_orderkey as long, o_orderstatus as string) | take 25;", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25", order_by="o_orderkey"),
    "top_desc": Query("orders", "(o_orderkey as long, o_totalprice as double) | top 20 by o_orderkey;", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC NULLS LAST LIMIT 20"),
    "top_asc_nulls_first": Query("orders", "(o_orderkey as long) | project k = case when (o_orderkey > 9) then o_orderkey end | top 20 by k asc nulls first | summarize n = count(), nulls = count_if(k is null), high = max(k), low = min(k);", "SELECT count(*) AS n, count(*) FILTER (k IS NULL) AS nulls, max(k) AS high, min(k) AS low FROM (SELECT CASE WHEN o_orderkey > 9 THEN o_orderkey END AS k FROM orders ORDER BY k ASC NULLS FIRST LIMIT 20)"),
    "top_desc_nulls_last": Query("orders", "(o_orderkey as long) | project k = case when (o_orderkey > 9) then o_orderkey end | top 20 by k desc nulls last;", "SELECT o_orderkey, CASE WHEN o_orderkey > 9 THEN o_orderkey END AS k FROM orders ORDER BY k DESC NULLS LAST LIMIT 20"),
    "distinct_rows": Query("lineitem", "(l_returnflag as string, l_linestatus as string) | distinct;", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_by": Query("customer", CUST + "| distinct by c_nationkey, big = c_acctbal > 5000;", "SELECT DISTINCT c_nationkey, c_acctbal > 5000 AS big FROM customer"),
    "explode": Query("embeddings", "(vec_id as long, embedding as array) | explode embedding as double | project-rename x = embedding;", "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"),
    "mv_expand_split": Query("part", PART + '| project word = split(p_name, " ") | mv-expand word | project-keep p_partkey, word;', "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part"),
    "ignore_error": Query("events", EV + "| project n = int(event_type), d = value / (user_id % 3) | project-remove n | ignore-error | project-keep event_id;", "SELECT event_id FROM events WHERE user_id % 3 <> 0 AND value IS NOT NULL"),
    "error_cells_null": Query("events", EV + "| project d = 10 div (user_id % 3), bad = int(event_type) | project mixed = int(if(user_id % 2 == 0, string(user_id), event_type)) | project-keep event_id, d, bad, mixed;", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(10 // (user_id % 3) AS BIGINT) END AS d, TRY_CAST(event_type AS INTEGER) AS bad, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS INTEGER) END AS mixed FROM events"),
    "lookup": Query("customer", "(c_custkey as long, c_nationkey as int) | lookup nation = n_name, n_regionkey as long from nations on c_nationkey;", "SELECT c_custkey, c_nationkey, n_name AS nation, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", NATION),
    "lookup_first_match": Query("customer", "(c_custkey as long) | lookup first_order = o_orderkey, price = o_totalprice from orders_ on c_custkey | project found = first_order is not null;", "SELECT c_custkey, first_order, price, first_order IS NOT NULL AS found FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) ON c_custkey = o_custkey", {"orders_": ("orders", "o_custkey")}),
    "join_left_inner": Query("customer", "(c_custkey as long, c_mktsegment as string) | join kind=left-inner o_orderkey, price = o_totalprice from orders_ on c_custkey;", "SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice AS price FROM customer JOIN orders ON c_custkey = o_custkey", {"orders_": ("orders", "o_custkey")}),
    "join_left_outer": Query("customer", "(c_custkey as long) | join kind=left-outer o_orderkey, o_orderstatus from orders_ on c_custkey;", "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey", {"orders_": ("orders", "o_custkey")}),
    "lookup_two_steps": Query("supplier", "(s_suppkey as long, s_nationkey as int) | lookup n_name, n_regionkey from nations on s_nationkey | lookup region = r_name from regions on n_regionkey;", "SELECT s_suppkey, s_nationkey, n_name, n_regionkey, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", NATION | {"regions": ("region", "r_regionkey")}),
    "lookup_function": Query("customer", "(c_custkey as long, c_mktsegment as string) | lookup word, code as long from f on c_mktsegment;", "SELECT c_custkey, c_mktsegment, word, CAST(code AS BIGINT) AS code FROM customer LEFT JOIN (VALUES ('AUTOMOBILE', 'car', 1), ('BUILDING', 'house', 2), ('MACHINERY', 'tool', 3)) t(k, word, code) ON c_mktsegment = k", {"f": lambda s, d: function_source(segment_rows_async, {"word": "string", "code": "long"}, 4)}),
    "join_key_fetch": Query("nation", "(n_nationkey as int) | join kind=left-outer name, age from people on n_nationkey;", f"SELECT n_nationkey, name, CAST(age AS INTEGER) AS age FROM nation LEFT JOIN {PEOPLE} ON n_nationkey = g", {"people": lambda s, d: FetchSource(in_memory_sqlite(), {"name": "string", "age": "int"})}),
    "udf_python": Query("customer", "(c_custkey as long, c_name as string) | project tag = shout(c_name, c_custkey);", "SELECT c_custkey, c_name, upper(c_name) || '!' || CAST(c_custkey AS VARCHAR) AS tag FROM customer", udfs={"shout": (lambda s, n: f"{s.upper()}!{n}", "string")}),
    "udf_vectorised": Query("customer", "(c_custkey as long, c_acctbal as double) | project cents = to_cents(c_acctbal);", "SELECT c_custkey, c_acctbal, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer", udfs={"to_cents": lambda e: e.register_vectorised("to_cents", cents, "long")}),
    "udf_native": Query("customer", "(c_custkey as long, c_name as string) | project tag = tagged(c_name, c_custkey % 10);", "SELECT c_custkey, c_name, upper(c_name) || '/' || (c_custkey % 10) AS tag FROM customer", udfs={"tagged": lambda e: e.register_expression("tagged", "concat(upper({0}), '/', {1})", "string")}),
    "udf_error_is_a_cell": Query("customer", "(c_custkey as long) | project half = halved(c_custkey) | ignore-error;", "SELECT c_custkey, c_custkey // 2 AS half FROM customer WHERE c_custkey % 2 = 0", udfs={"halved": (halved, "long")}),
    "fn_math": Query("part", PART + "| project a = floor(p_retailprice), b = ceil(p_retailprice), c = round(sqrt(p_size) * 1000), d = mod(0 - p_size, 7), e = sign(p_size - 25), f = bucket(p_size, 10, 20, 40), g = factorial(p_size % 10), h = round(log(p_size, 2) * 1000), i = abs(p_size - 25) | project-keep p_partkey, a, b, c, d, e, f, g, h, i;",
        "SELECT p_partkey, floor(p_retailprice) AS a, ceil(p_retailprice) AS b, round(sqrt(p_size) * 1000) AS c, CAST(((-p_size % 7) + 7) % 7 AS DOUBLE) AS d, CAST(sign(p_size - 25) AS DOUBLE) AS e, CAST(CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 40 THEN 2 ELSE 3 END AS BIGINT) AS f, CAST(factorial(CAST(p_size % 10 AS INTEGER)) AS BIGINT) AS g, round(log2(p_size) * 1000) AS h, CAST(abs(p_size - 25) AS INTEGER) AS i FROM part"),
    "fn_trig": Query("part", "(p_partkey as long, p_size as int) | project x = p_size / 10.0 | project a = round(sin(x) * 1000000), b = round(cos(x) * 1000000), c = round(atan(x) * 1000000), d = round(exp(x)), e2 = round(degrees(x)), f = round(cbrt(x) * 1000000), g = round(hypot(x, 3.0) * 1000000), h = round(radians(p_size) * 1000000) | project-remove x, p_size;",
        "SELECT p_partkey, round(sin(p_size/10.0)*1000000) AS a, round(cos(p_size/10.0)*1000000) AS b, round(atan(p_size/10.0)*1000000) AS c, round(exp(p_size/10.0)) AS d, round(degrees(p_size/10.0)) AS e2, round(cbrt(p_size/10.0)*1000000) AS f, round(sqrt(p_size/10.0*(p_size/10.0)+9)*1000000) AS g, round(radians(p_size)*1000000) AS h FROM part"),
    "fn_bits": Query("orders", "(o_orderkey as long) | project a = bit_or(o_orderkey, 5), b = bit_xor(o_orderkey, 9), c = bit_not(o_orderkey), d = shiftleft(o_orderkey, 3), e1 = shiftright(o_orderkey, 2), f = bit_count(o_orderkey), g = getbit(o_orderkey, 1);",
        "SELECT o_orderkey, o_orderkey | 5 AS a, xor(o_orderkey, CAST(9 AS BIGINT)) AS b, ~o_orderkey AS c, o_orderkey << 3 AS d, o_orderkey >> 2 AS e1, CAST(bit_count(o_orderkey) AS INTEGER) AS f, CAST((o_orderkey >> 1) & 1 AS INTEGER) AS g FROM orders"),
    "fn_strings": Query("part", PART + '| project a = upper(p_name), b = length(p_name), c = substring(p_name, 1, 3), d = instr(p_name, "a"), e1 = concat_ws("-", p_brand, p_type), f = startswith(p_type, "S"), g = repeat(p_brand, 2), h = translate(p_name, "abc", "xyz"), i = split_part(p_name, " ", 1), j = levenshtein(p_brand, p_type), k = trim(concat("  ", p_brand, " ")) | project-keep p_partkey, a, b, c, d, e1, f, g, h, i, j, k;',
        "SELECT p_partkey, upper(p_name) AS a, CAST(strlen(p_name) AS BIGINT) AS b, substr(p_name, 2, 3) AS c, CAST(instr(p_name, 'a') AS BIGINT) AS d, p_brand || '-' || p_type AS e1, starts_with(p_type, 'S') AS f, repeat(p_brand, 2) AS g, translate(p_name, 'abc', 'xyz') AS h, split_part(p_name, ' ', 1) AS i, CAST(levenshtein(p_brand, p_type) AS BIGINT) AS j, p_brand AS k FROM part"),
    "fn_regex": Query("part", PART + '| project a = regexp_extract(p_brand, "([A-Za-z]+)#?([0-9]+)", 2), b = regexp_replace(p_name, "[aeiou]", "_"), c = regexp(p_type, "^[A-M]"), d = array_size(regexp_extract_all(p_name, "[a-z]+")) | project-keep p_partkey, a, b, c, d;',
        "SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]+)', 2) AS a, regexp_replace(p_name, '[aeiou]', '_', 'g') AS b, regexp_matches(p_type, '^[A-M]') AS c, CAST(len(regexp_extract_all(p_name, '[a-z]+')) AS BIGINT) AS d FROM part"),
    "fn_dates": Query("orders", ORD + '| project a = year(o_orderdate), b = month(o_orderdate), c = dayofmonth(o_orderdate), d = quarter(o_orderdate), e1 = date_add(o_orderdate, 10), f = date_diff(o_orderdate, "1995-01-01"), g = weekday(o_orderdate), h = unix_seconds(o_orderdate), i = dayofyear(o_orderdate), j = weekofyear(o_orderdate) | project-keep o_orderkey, a, b, c, d, e1, f, g, h, i, j;',
        "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS a, CAST(month(o_orderdate) AS INTEGER) AS b, CAST(day(o_orderdate) AS INTEGER) AS c, CAST(quarter(o_orderdate) AS INTEGER) AS d, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) + INTERVAL 10 DAY AS e1, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS f, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS g, CAST(epoch(o_orderdate) AS BIGINT) AS h, CAST(dayofyear(o_orderdate) AS INTEGER) AS i, CAST(weekofyear(o_orderdate) AS INTEGER) AS j FROM orders"),
    "fn_date_text": Query("orders", ORD + '| project s = string(o_orderdate) | project a = timestamp(s), b = to_unix_timestamp(s, "%Y-%m-%d %H:%M:%S"), c = hour(s) | project-keep o_orderkey, s, a, b, c;',
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS s, date_trunc('second', o_orderdate) AS a, CAST(floor(epoch(o_orderdate)) AS DOUBLE) AS b, CAST(hour(o_orderdate) AS INTEGER) AS c FROM orders"),
    "fn_arrays": Query("part", PART + '| project w = split(p_name, " ") | project a = array_size(w), b = array_join(array_distinct(w), "|"), c = array_contains(w, "red"), d = element_at(w, 0), e1 = array_join(slice(w, 0, 2), "+"), f = array_max(w), g = array_position(w, w[0]) | project-keep p_partkey, a, b, c, d, e1, f, g;',
        "SELECT p_partkey, CAST(len(w) AS BIGINT) AS a, CASE WHEN w[1] = w[2] THEN w[1] ELSE array_to_string(w, '|') END AS b, list_contains(w, 'red') AS c, w[1] AS d, array_to_string(w[1:2], '+') AS e1, list_max(w) AS f, CAST(list_position(w, w[1]) AS BIGINT) AS g FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)"),
    "fn_maps": Query("part", PART + '| project m = map_from_arrays(array("brand", "type"), array(p_brand, p_type)) | project a = m.brand, b = map_contains_key(m, "x"), c = m["type"], d = array_size(map_keys(m)) | project-keep p_partkey, a, b, c, d;', "SELECT p_partkey, p_brand AS a, false AS b, p_type AS c, CAST(2 AS BIGINT) AS d FROM part"),
    "fn_json": Query("part", PART + '| project j = concat("{\\"n\\":\\"", p_brand, "\\",\\"l\\":[1,2,", string(p_size), "]}") | project a = get_json_object(j, "$.n"), b = array_join(get_json_array(j, "$.l[*]"), ","), c = json_array_length(get_json_object(j, "$.l")), d = array_join(json_object_keys(j), ",") | project-keep p_partkey, a, b, c, d;',
        "SELECT p_partkey, p_brand AS a, '1,2,' || p_size AS b, CAST(3 AS INTEGER) AS c, 'n,l' AS d FROM part"),
    "fn_conditional": Query("events", EV + '| project a = case when value > 50 then "high" when value > 10 then "mid" else "low" end, b = if(user_id > 50, 1, 0), c = coalesce(value, 0.0), d = nvl2(value, "v", "n"), e1 = ifnull(event_type, "none") | project-keep event_id, a, b, c, d, e1;',
        "SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS a, CAST(CASE WHEN user_id > 50 THEN 1 ELSE 0 END AS INTEGER) AS b, coalesce(value, 0.0) AS c, CASE WHEN value IS NOT NULL THEN 'v' ELSE 'n' END AS d, coalesce(event_type, 'none') AS e1 FROM events"),
    "fn_conversion": Query("events", EV + "| project a = string(user_id), b = double(user_id), c = boolean(user_id), d = int(value), e1 = bigint(string(event_id)) | project-keep event_id, a, b, c, d, e1;",
        "SELECT event_id, CAST(user_id AS VARCHAR) AS a, CAST(user_id AS DOUBLE) AS b, coalesce(user_id <> 0, false) AS c, CAST(trunc(value) AS INTEGER) AS d, event_id AS e1 FROM events"),
    "fn_random": Query("orders", "(o_orderkey as long) | project a = rand(), b = uuid(), c = now(), d = shuffle(array(1, 2, 3)), e1 = random(), f = current_date(), g = current_timestamp();", None),
}

AGG = "(o_orderkey as long, o_custkey as long, o_orderstatus as string, o_totalprice as double, o_orderpriority as string) | project cents = int(o_totalprice), flag = o_totalprice > 200000 "
BY = " by o_orderstatus;"
FROM = "FROM (SELECT *, CAST(trunc(o_totalprice) AS INTEGER) AS cents, o_totalprice > 200000 AS flag FROM orders) GROUP BY o_orderstatus"


def agg(call: str, sql: str) -> Query:
    return Query("orders", f"{AGG}| summarize v = {call}{BY}", f"SELECT {sql} AS v, o_orderstatus {FROM}", order_by="o_orderkey")


QUERIES |= {
    "agg_count": agg("count()", "count(*)"),
    "agg_count_if": agg("count_if(flag)", "count(*) FILTER (flag)"),
    "agg_distinct_count": agg("distinct_count(o_custkey, o_orderpriority)", "count(DISTINCT {'a': o_custkey, 'b': o_orderpriority})"),
    "agg_sum": agg("sum(o_custkey)", "CAST(sum(o_custkey) AS BIGINT)"),
    "agg_avg_truncates": agg("avg(cents)", "CAST(sum(CAST(cents AS BIGINT)) // count(*) AS INTEGER)"),
    "agg_mean_double": Query("orders", f"{AGG}| summarize m = mean(o_totalprice){BY[:-1]} | project v = round(m * 100) | project-remove m;", f"SELECT o_orderstatus, round(avg(o_totalprice) * 100) AS v {FROM}"),
    "agg_min": agg("min(cents)", "min(cents)"),
    "agg_least": agg("least(o_orderpriority)", "min(o_orderpriority)"),
    "agg_max": agg("max(cents)", "max(cents)"),
    "agg_greatest": agg("greatest(o_orderpriority)", "max(o_orderpriority)"),
    "agg_min_by": agg("min_by(o_orderpriority, o_orderkey)", "arg_min(o_orderkey, {'a': o_orderpriority, 'b': o_orderkey})"),
    "agg_max_by": agg("max_by(o_orderpriority, o_orderkey)", "arg_max(o_orderkey, {'a': o_orderpriority, 'b': o_orderkey})"),
    "agg_every": agg("every(flag)", "bool_and(flag)"),
    "agg_any": agg("any(flag)", "bool_or(flag)"),
    "agg_some": agg("some(flag)", "bool_or(flag)"),
    "agg_first": agg("first(o_custkey)", "arg_min(o_custkey, o_orderkey)"),
    "agg_first_value": agg("first_value(o_custkey, true)", "arg_min(o_custkey, o_orderkey)"),
    "agg_last": agg("last(o_custkey)", "arg_max(o_custkey, o_orderkey)"),
    "agg_last_value": agg("last_value(o_custkey, true)", "arg_max(o_custkey, o_orderkey)"),
    "agg_array_agg": Query("orders", f"{AGG}| summarize x = array_agg(o_orderkey){BY[:-1]} | project v = array_join(x, \",\") | project-remove x;", f"SELECT o_orderstatus, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS v {FROM}", order_by="o_orderkey"),
    "agg_collect_list": Query("orders", f"{AGG}| summarize x = collect_list(o_orderkey){BY[:-1]} | project v = x[3], n = size(x) | project-remove x;", f"SELECT o_orderstatus, list(o_orderkey ORDER BY o_orderkey)[4] AS v, count(*) AS n {FROM}", order_by="o_orderkey"),
    "agg_collect_set": Query("orders", f"{AGG}| summarize x = collect_set(o_orderpriority){BY[:-1]} | project v = size(x), top_ = array_max(x), all_ = array_join(x, \"|\") | project-remove x;", f"SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS v, max(o_orderpriority) AS top_, (SELECT string_agg(p, '|' ORDER BY k) FROM (SELECT o_orderpriority AS p, min(o_orderkey) AS k FROM orders i WHERE i.o_orderstatus = outer_.o_orderstatus GROUP BY 1)) AS all_ FROM orders outer_ GROUP BY o_orderstatus", order_by="o_orderkey"),
    "agg_array_agg_if": Query("orders", f"{AGG}| summarize x = array_agg_if(o_orderkey, flag){BY[:-1]} | project v = array_join(x, \",\") | project-remove x;", f"SELECT o_orderstatus, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (flag), '') AS v {FROM}", order_by="o_orderkey"),
    "agg_global": Query("orders", f"{AGG}| summarize n = count(), top_price = max(cents);", "SELECT count(*) AS n, CAST(max(trunc(o_totalprice)) AS INTEGER) AS top_price FROM orders"),
    "agg_key_expression": Query("orders", f"{AGG}| summarize n = count() by y = o_custkey % 10;", "SELECT count(*) AS n, o_custkey % 10 AS y FROM orders GROUP BY 2"),
    "agg_sum_text": Query("nation", "(n_nationkey as int, n_name as string, n_regionkey as int) | summarize v = sum(n_name) by n_regionkey;", "SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS v, n_regionkey FROM nation GROUP BY n_regionkey", order_by="n_nationkey"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {n: q.sql for n, q in QUERIES.items() if q.sql}
