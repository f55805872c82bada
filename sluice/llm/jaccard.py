"""N-gram Jaccard join by set relations.

A document is the set of its 5-word shingles; two documents link at a Jaccard similarity of at least 0.8. Equal sets
collapse first. Distinct sets meet in an index of prefix tokens (any two linked sets share a token among the first
n - ceil(0.8 n) + 1 of one global order; frequent tokens come last in that order). From there sets relate in two ways:

Index level. Entries of a list carry the set's size and the token's position; an entry, or a whole family's block of
entries, is skipped when sizes or positions leave too little room for the overlap that a link needs.

Answer level. A set joins the family of a highly similar hub (the set that shares most of its tokens with others), and its
exact overlap and difference to the hub are computed. What the hub's answer says about other members follows from these:
members that link to the hub are one group already; two members share at most the smaller of their overlaps with a
reference (the hub and the differences' common tokens) plus the other tokens that both hold, so only pairs that pass this bound are compared. Families meet other families
as a whole, and single sets of two families only when the families can't be told apart. So dense groups cost a row for
each member, not for each pair, and no link between different sets is lost: every skipped pair is bounded below 0.8, or
its two sets are in one group by other links.

The frequent tokens are counted per block of about a million tokens of distinct sets, then summed; a block reports only
tokens that it holds at least twice, so one spread thinly (once in each of many blocks) is not seen as frequent and can
make long lists on large inputs. At most `order_tokens` of them, the most frequent, are sent to all tasks. They only shape
the order, so results are exact whatever it is.

Shingles and sets are told by 64-bit hashes. Defined cases: null, empty or blank texts have the empty set and link with
nothing; with fewer than 5 words the whole sequence is the one shingle; a null doc_id takes part, but names no component
(a component of such rows alone has a null id); repeated rows link as copies; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, discard, free_names, gram_hashes, materialise, mix, paused, scratch_dir, word_hashes
from .components import components
from .debruijn import NO_ID

WORDS = 5


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; A-Z count as a-z."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())
    if len(h) < WORDS:
        with np.errstate(over="ignore"):
            return gram_hashes(h, len(h), seed=9) + U(len(h)) if len(h) else h
    return np.unique(gram_hashes(h, WORDS, seed=3))


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        both = np.array([mix(tokens ^ U(0xA24BAED4963EE407)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(tokens + U(0x9FB21C651E98DF25))), len(tokens)], dtype=np.uint64)
        return int(mix(mix(mix(both[:1]) + both[1:2]) + both[2:])[0].astype(np.int64))


def survey(block_tokens: int = 1_000_000):
    """Rows (doc_id, th, text) to rows of kind 0 (doc_id, th, set, size) and of kind 1 (token, count in a block of distinct sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0

        def often() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            more = count > 1
            n = int(more.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(token[more].view(np.int64)), pa.array(count[more].astype(np.int64))], ["kind", "doc_id", "th", "a", "b"])

        for b in batches:
            ids, n = [], []
            for text in b.column(2):
                s = shingles(text.as_py())
                ids.append(set_id(s))
                n.append(len(s))
                if len(s) and ids[-1] not in seen:
                    seen.add(ids[-1])
                    held.append(s)
                    size += len(s)
                if size >= block_tokens:
                    yield often()
                    held, size = [], 0
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["kind", "doc_id", "th", "a", "b"])
        if held:
            yield often()

    return paused(run)


def in_order(tokens: np.ndarray, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Tokens in the global order: by level of frequency, then by hash."""
    if not len(frequent):
        return tokens
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    rank = np.where(frequent[at] == tokens, level[at], 0)
    return tokens[np.lexsort((tokens, rank))]


def prefixes(frequent: np.ndarray, level: np.ndarray):
    """Texts to prefix entries (token, sid, n, pos), once for each set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            token, sid, n, pos = [], [], [], []

            def entries() -> pa.RecordBatch:
                count = [len(t) for t in token]
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.repeat(np.array(sid, dtype=np.int64), count)), pa.array(np.repeat(np.array(n, dtype=np.int32), count)), pa.array(np.concatenate(pos).astype(np.int32))], ["token", "sid", "n", "pos"])

            for text in b.column(0):
                s = shingles(text.as_py() or "")
                if not len(s):
                    continue
                name = set_id(s)
                if name in seen:
                    continue
                if len(seen) < 1_000_000:  # a longer memory would only save repeated entries
                    seen.add(name)
                p = len(s) - (4 * len(s) + 4) // 5 + 1
                token.append(in_order(s, frequent, level)[:p])
                sid.append(name)
                n.append(len(s))
                pos.append(np.arange(p))
                if len(token) >= 2000:
                    yield entries()
                    token, sid, n, pos = [], [], [], []
            if token:
                yield entries()

    return paused(run)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their texts (a, b, ta, tb) to (a, b, na, nb, o, diff): exact overlap, and the tokens of a not in b."""
    last: dict[int, np.ndarray] = {}

    def tokens(sid: int, text: pa.Scalar) -> np.ndarray:
        if sid not in last:
            if len(last) > 64:
                last.clear()
            last[sid] = shingles(text.as_py())
        return last[sid]

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        na, nb, o, diff = [], [], [], []
        for i in range(len(a)):
            x, y = tokens(a[i], batch.column(2)[i]), tokens(b[i], batch.column(3)[i])
            other = ~np.isin(x, y, assume_unique=True)
            na.append(len(x))
            nb.append(len(y))
            o.append(len(x) - int(other.sum()))
            diff.append(x[other].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int32()) for c in (na, nb, o)), pa.array(diff, pa.list_(pa.int64()))], ["a", "b", "na", "nb", "o", "diff"])


def enough(o, na, nb) -> F.Column:
    """Whether an overlap of o makes a Jaccard similarity of 0.8."""
    return F.lit(100) * o >= F.lit(80) * (na + nb - o)


def room(a: str, b: str) -> F.Column:
    """Whether two entries of one list can belong to linked sets, by sizes and positions."""
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    return (5 * na >= 4 * nb) & (5 * nb >= 4 * na) & enough(F.least(pa_, pb) + 1 + F.least(na - pa_, nb - pb) - 1, na, nb)


def prefix_size(n: F.Column) -> F.Column:
    return n - F.floor((4 * n + 4) / 5) + 1


def link_edges(texts: DataFrame, sets: DataFrame, folder: str, frequent: np.ndarray, level: np.ndarray) -> DataFrame:
    """(a, b): links that connect the distinct sets as all links would. texts(rid, th, text), sets(rid, th, sid)."""
    spark = texts.sparkSession
    entries = materialise(texts.select("text").mapInArrow(prefixes(frequent, level), "token long, sid long, n int, pos int"), folder, "entries")
    lists = entries.groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high").select("token")
    met = materialise(entries.join(lists, "token").groupBy("token", "sid").agg(F.first("n").alias("n"), F.first("pos").alias("pos")), folder, "met")
    discard(spark, folder, "entries")

    # families: the hub of a list is its most connected set; a set takes the hub that it shares most prefix tokens with
    met = met.join(met.groupBy("token").agg(F.count("*").alias("df")), "token")
    weight = met.groupBy("sid").agg((F.sum("df") / prefix_size(F.first("n"))).alias("w"))
    weighted = materialise(met.join(weight, "sid"), folder, "weighted")
    met = weighted.select("token", "sid", "n", "pos")
    hubs = weighted.groupBy("token").agg(F.max(F.struct("w", "sid", "n")).alias("hub"))
    near = weighted.join(hubs, "token").where((F.col("hub.sid") != F.col("sid")) & (F.struct("w", "sid") < F.struct("hub.w", "hub.sid")) & (2 * F.col("n") >= F.col("hub.n")) & (2 * F.col("hub.n") >= F.col("n")))
    near = near.groupBy("sid", F.col("hub.sid").alias("hub")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.max("hub.w").alias("w"))
    best = near.groupBy("sid").agg(F.max(F.struct("c", "w", "hub", "n")).alias("x")).where(4 * F.col("x.c") >= prefix_size(F.col("x.n"))).select("sid", F.col("x.hub").alias("hub"))
    best = materialise(best, folder, "best")
    rooted = best.join(best.select(F.col("sid").alias("hub")), "hub", "left_anti").select("sid", "hub")

    # one text for each set that shares a token
    wanted = sets.groupBy("sid").agg(F.min(F.struct("rid", "th")).alias("at")).join(met.select("sid").distinct(), "sid")
    bodies = texts.join(wanted.select("sid", F.col("at.rid").alias("rid"), F.col("at.th").alias("th")), ["rid", "th"]).groupBy("rid", "th").agg(F.first("sid").alias("sid"), F.first("text").alias("text"))
    bodies = materialise(bodies.select("sid", "text"), folder, "bodies")

    linked = enough(F.col("o"), F.col("na"), F.col("nb"))

    def overlaps(pairs: DataFrame, name: str) -> DataFrame:
        x, y = bodies.select(F.col("sid").alias("a"), F.col("text").alias("ta")), bodies.select(F.col("sid").alias("b"), F.col("text").alias("tb"))
        both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "ta", "tb")
        return materialise(both.mapInArrow(compare, "a long, b long, na int, nb int, o int, diff array<long>"), folder, name)

    first = overlaps(rooted.select(F.col("sid").alias("a"), F.col("hub").alias("b")), "first")
    edges = first.where(linked).select("a", "b")

    # a family moves to the member that is nearest to what most members hold, if that is not its hub yet
    close = first.where(2 * F.col("o") >= F.least("na", "nb"))
    size = close.groupBy("b").agg(F.count("*").alias("m"), F.first("nb").alias("hub_n")).where("m >= 4")
    held = close.select("a", "b", F.explode("diff").alias("token"))
    usual = held.groupBy("b", "token").agg(F.count("*").alias("c")).join(size, "b").where("2 * c >= m").select("b", "token", F.lit(1).alias("u"))
    score = held.join(usual, ["b", "token"], "left").groupBy("a", "b").agg(F.sum(F.coalesce(3 * F.col("u"), F.lit(0)) - 1).alias("s"))
    centre = close.join(score, ["a", "b"], "left").groupBy("b").agg(F.max(F.struct((F.col("o") + F.coalesce("s", F.lit(0))).alias("s"), "a")).alias("x"))
    centre = materialise(centre.join(size, "b").where(F.col("x.s") > F.col("hub_n")).select("b", F.col("x.a").alias("c")), folder, "centre")
    again = close.select("a", "b").unionAll(centre.select(F.col("b").alias("a"), "b")).join(centre, "b").where("a <> c").select("a", F.col("c").alias("b"))
    second = overlaps(again, "second")
    stars = close.join(centre, "b", "left_anti").unionByName(second.where(2 * F.col("o") >= F.least("na", "nb")))
    edges = edges.unionAll(second.where(linked).select("a", "b"))

    # inside a family: its reference is the hub and each token that 8 or more differences hold; two members share at most
    # the smaller overlap with the reference plus what both have besides it
    each = stars.select("a", F.col("b").alias("hub"), F.explode("diff").alias("token"))
    often = each.groupBy("hub", "token").agg(F.count("*").alias("c"))
    each = materialise(each.join(often, ["hub", "token"]), folder, "each")
    more = each.where("c >= 8").groupBy(F.col("a").alias("sid"), "hub").agg(F.count("*").alias("more"))
    members = stars.select(F.col("a").alias("sid"), F.col("b").alias("hub"), F.col("na").alias("n"), "o", linked.alias("linked")).join(more, ["sid", "hub"], "left")
    members = materialise(members.select("sid", "hub", "n", (F.col("o") + F.coalesce("more", F.lit(0))).cast("int").alias("o"), "linked"), folder, "members")
    parts = each.where("c between 2 and 7").select(F.col("a").alias("sid"), "hub", "token").join(members, ["sid", "hub"])
    bound = lambda extra: enough(F.least("x.o", "y.o") + extra, F.col("x.n"), F.col("y.n"))
    one = (~F.col("x.linked")) & (F.col("y.linked") | (F.col("x.sid") < F.col("y.sid")))
    shared = parts.alias("x").join(parts.alias("y"), (F.col("x.hub") == F.col("y.hub")) & (F.col("x.token") == F.col("y.token")) & one & (5 * F.col("x.n") >= 4 * F.col("y.n")) & (5 * F.col("y.n") >= 4 * F.col("x.n")))
    shared = shared.groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).agg(F.count("*").alias("d"), F.first("x.o").alias("ox"), F.first("y.o").alias("oy"), F.first("x.n").alias("na"), F.first("y.n").alias("nb"))
    shared = shared.where(enough(F.least("ox", "oy") + F.col("d"), F.col("na"), F.col("nb"))).select("a", "b")
    kinds = members.groupBy("hub", "n", "o", "linked").agg(F.count("*").alias("m"))
    alike = kinds.alias("x").join(kinds.alias("y"), (F.col("x.hub") == F.col("y.hub")) & ~F.col("x.linked") & bound(F.lit(0)))
    alike = alike.select(F.col("x.hub").alias("hub"), *(F.col(f"{k}.{c}").alias(f"{k}{c}") for k in "xy" for c in ("n", "o", "linked")))
    of = lambda k: members.select("hub", F.col("sid").alias(f"{k}sid"), F.col("n").alias(f"{k}n"), F.col("o").alias(f"{k}o"), F.col("linked").alias(f"{k}linked"))
    alike = alike.join(of("x"), ["hub", "xn", "xo", "xlinked"]).join(of("y"), ["hub", "yn", "yo", "ylinked"]).where("xsid <> ysid").select(F.least("xsid", "ysid").alias("a"), F.greatest("xsid", "ysid").alias("b"))
    inside = shared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(alike)

    # across families: families meet as a whole, then the entries of those that may link
    family = materialise(met.join(members.select("sid", "hub"), "sid", "left").select("token", "sid", "n", "pos", F.coalesce("hub", "sid").alias("root")), folder, "family")
    discard(spark, folder, "weighted", "met")
    heads = materialise(family.groupBy("token", "root").agg(F.min("n").alias("low"), F.max("n").alias("high")), folder, "heads")
    together = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & (5 * F.col("x.high") >= 4 * F.col("y.low")) & (5 * F.col("y.high") >= 4 * F.col("x.low"))
    pairs = heads.alias("x").join(heads.alias("y"), together).groupBy(F.col("x.root").alias("xroot"), F.col("y.root").alias("yroot")).agg(F.count("*").alias("c"), F.min("x.low").alias("xl"), F.min("y.low").alias("yl"), F.max("x.high").alias("xh"), F.max("y.high").alias("yh"))
    rest = F.greatest(F.col("xh") - prefix_size(F.col("xh")), F.col("yh") - prefix_size(F.col("yh")))
    pairs = materialise(pairs.where(enough(F.col("c") + rest, F.col("xl"), F.col("yl"))).select("xroot", "yroot"), folder, "pairs")
    lists = heads.alias("x").join(heads.alias("y"), together).select(F.col("x.token").alias("token"), F.col("x.root").alias("xroot"), F.col("y.root").alias("yroot")).join(pairs, ["xroot", "yroot"])
    entry = lambda k: family.select("token", F.col("root").alias(f"{k}root"), F.struct("sid", "n", "pos").alias(k))
    across = lists.join(entry("x"), ["token", "xroot"]).join(entry("y"), ["token", "yroot"]).where(room("x", "y"))
    across = across.groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).agg(F.count("*").alias("c"), F.first("x.n").alias("na"), F.first("y.n").alias("nb"))
    suffix = F.greatest(F.col("na") - prefix_size(F.col("na")), F.col("nb") - prefix_size(F.col("nb")))
    across = across.where(enough(F.col("c") + suffix, F.col("na"), F.col("nb"))).select("a", "b")

    checked = overlaps(inside.unionAll(across).distinct(), "checked")
    return edges.unionAll(checked.where(enough(F.col("o"), F.col("na"), F.col("nb"))).select("a", "b"))


def group_documents(docs: DataFrame, order_tokens: int = 100_000, keep_all: bool = False) -> DataFrame:
    """(doc_id, sid, n_shingles, component_id) of each row of docs(doc_id, text); sid names the row's set.

    With keep_all, the table (doc_id, th, sid, n, low) of the rows with words: low names a group, th a text.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid"), F.xxhash64(text).alias("th"), text.alias("text"))
    seen = materialise(texts.select("doc_id", "th", "text").mapInArrow(survey(), "kind int, doc_id long, th long, a long, b long"), folder, "survey")
    # the most frequent tokens, at most order_tokens rows of 16 bytes on the driver and in each task
    top = seen.where("kind = 1").groupBy("a").agg(F.sum("b").alias("c")).where("c >= 8").orderBy(F.desc("c"), "a").limit(order_tokens).collect()
    frequent = np.array([r["a"] for r in top], dtype=np.int64).view(np.uint64)
    level = np.floor(np.log2(np.array([r["c"] for r in top], dtype=np.float64))).astype(np.int8)
    order = np.argsort(frequent)
    rows = seen.where("kind = 0").select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), "th", F.col("a").alias("sid"), F.col("b").alias("n"))
    edges = link_edges(texts, rows.where("n > 0").select("rid", "th", "sid"), folder, frequent[order], level[order])
    groups = components(edges, folder).select(F.col("u").alias("sid"), F.col("v").alias("low"))
    # sets without links are groups of their own; blank texts link with nothing, so their row is its own group
    named = materialise(rows.join(groups, "sid", "left").select("doc_id", "th", "sid", "n", F.coalesce("low", "sid").alias("low")), folder, "named")
    if keep_all:
        return named.where("n > 0")
    first = named.where("n > 0").groupBy("low").agg(F.min("doc_id").alias("first"))
    full = named.where("n > 0").join(first, "low").select("doc_id", "sid", F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))
    return full.unionAll(named.where("n = 0").select("doc_id", "sid", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each group the row with the smallest doc_id stays, once.

    Rows without any word all stay. Columns and their order are those of docs; nulls count after all ids.
    """
    named, own = group_documents(docs, keep_all=True), docs.columns
    rid, th, k_id, k_th = free_names(own, "id", "th", "k_id", "k_th")
    keep = named.groupBy("low").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid", "th")).alias("at")).select(F.col("at.doc_id").alias(k_id), F.col("at.th").alias(k_th))
    rows = docs.withColumns({rid: F.col("doc_id").cast("long"), th: F.xxhash64(F.coalesce("text", F.lit("")))})
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x09-\\x0D\\x20]+", " ")) == ""
    met = rows.where(~blank).join(keep, F.col(rid).eqNullSafe(F.col(k_id)) & (F.col(th) == F.col(k_th)), "left_semi")
    names = [F.col(f"`{c}`") for c in own]
    return met.dropDuplicates([rid, th]).select(*names).unionAll(rows.where(blank).select(*names))
