"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a word model of a given order n with absolute discounting, interpolated down to an add-one base:
p(w | u) = (c(u, w) - D) / c(u) + D * N(u) / c(u) * p(w | u'), p(w) = (c(w) + 1) / (N + V + 1), where u are the n - 1 words
before w, u' is u without its first word, c(u) sums the counts of u's successors and N(u) counts the distinct ones; an
unseen context leaves p(w | u'). Before a document's first word stand end tokens.

The trie has one part for each context length of 1 to n - 1 words, and is cut into shards by ranges of context ids
(successors of very frequent contexts, named from a bounded sample, are spread over several). A part has levels in one
compact buffer: sorted context ids, monotone pointers to the successors of each context, running sums of the contexts'
counts, successor ids relative to their context (monotone because the context's rank stands above them), each as
Elias-Fano sequences, and the discounted counts quantised to 16 bits on a partly geometric scale. A query finds the
context, then the successor by search inside the context's range only, which the pointers give. The buffer is an anonymous
memory map that the task fills and reads: low bits, pointers' low bits and codes in place, while the unary high parts are
expanded to 8 bytes an entry as their select directory. Stored are quantised counts; probabilities are computed from them
when scoring.

Data flow: each task cuts its own rows to blocks. A block sends every distinct n-gram once to its shard, with the count in
training rows, and the list of its documents; the shard sums the counts of all blocks, builds its trie, and answers each
block in the order of its keys. Each distinct document (doc_id and text) then joins the numbers of its blocks and meets
their answers: keys stand in the order of their hashes, so a block finds them again from its documents in any order. It is
scored in one of them, and rows join the score of their document. Messages hold sorted ids as
differences and all numbers as byte planes, compressed. A message goes from each block to each shard, so with blocks and
shards of a fixed size their number grows with the square of the input, and messages get smaller (about 20 KB at 30 GB).

Ids are 64-bit hashes of words; ids of contexts keep 20 bits more than the number of characters in the input has, those of
successors 32 bits within one context (parts of a spread context are told by 6 more). Defined cases: a null text is the end token alone; a null doc_id is a training row;
repeated rows are counted and scored each; without training rows every token has p = 1; extra columns are ignored.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, discard, materialise, mix, no_gc, paused, scratch_dir, shuffle_partitions, word_hashes
from .debruijn import NO_ID
from .quality import held_out_sql

END = 0x9B97F4A7C15E3779
DISCOUNT = 0.5
SUCC_BITS = 32
SPREAD = 64


# ---- Elias-Fano sequences ----


def pack_low(low: np.ndarray, bits: int) -> bytes:
    """Fixed-width fields, least significant bit first, in 64-bit words; 64 fields fill `bits` words."""
    groups = -(-len(low) // 64)
    fields = np.zeros((groups, 64), dtype=np.uint64)
    fields.ravel()[: len(low)] = low
    out = np.zeros((groups, bits + 1), dtype=np.uint64)
    for k in range(64 if bits else 0):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= fields[:, k] << U(shift)
        if shift + bits > 64:
            out[:, word + 1] |= fields[:, k] >> U(64 - shift)
    return out[:, :bits].tobytes() + bytes(16)


class EliasFano:
    """A monotone sequence of uint64: low bits in fixed-width fields, high parts as a unary bit vector."""

    def __init__(self, buffer, at: int):
        head = np.frombuffer(buffer, np.int64, 4, at)
        self.n, self.bits, low, high = map(int, head)
        self.low = np.frombuffer(buffer, np.uint64, low >> 3, at + 32)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(buffer, np.uint8, high, at + 32 + low), bitorder="little"))
        self.high = (ones - np.arange(len(ones))).astype(np.uint64)  # the select directory of the bit vector
        self.end = at + 32 + low + high + (-(low + high)) % 8

    @staticmethod
    def dump(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = pack_low(values & U((1 << bits) - 1), bits)
        marks = np.zeros((top >> bits) + n + 1, dtype=np.uint8)
        marks[(values >> U(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little").tobytes()
        return np.array([n, bits, len(low), len(high)], dtype=np.int64).tobytes() + low + high + bytes((-(len(low) + len(high))) % 8)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i.astype(np.int64) * self.bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        with np.errstate(over="ignore"):
            out = self.low[word] >> shift
            out |= (self.low[word + 1] << (U(63) - shift)) << U(1)
        return out & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.high[i] << U(self.bits)) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each x by successor search, -1 where it is absent."""
        h = x >> U(self.bits)
        low, end = np.searchsorted(self.high, h, side="left"), np.searchsorted(self.high, h, side="right")
        want, high, live = x & U((1 << self.bits) - 1), end.copy(), np.flatnonzero(low < end)
        while len(live):  # bisection over the low bits of one high part
            middle = (low[live] + high[live]) >> 1
            less = self.lows(middle) < want[live]
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
            live = live[low[live] < high[live]]
        out, on = np.full(len(x), -1, dtype=np.int64), np.flatnonzero(low < end)
        on = on[self.lows(low[on]) == want[on]]
        out[on] = low[on]
        return out

    def find_within(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The index of each x in its own range from low to high, -1 where it is absent."""
        low, right, live = low.copy(), high.copy(), np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + right[live]) >> 1
            less = self.get(middle) < x[live]
            low[live] = np.where(less, middle + 1, low[live])
            right[live] = np.where(less, right[live], middle)
            live = live[low[live] < right[live]]
        out, on = np.full(len(x), -1, dtype=np.int64), np.flatnonzero(low < high)
        on = on[self.get(low[on]) == x[on]]
        out[on] = low[on]
        return out


#: Discounted counts of the 16-bit codes: exact up to 32768, then a geometric scale. Code 0: not in the trie.
LEVELS = np.concatenate([[0.0], np.arange(1, 32769) - DISCOUNT, 32768 * np.exp(np.arange(1, 32768) * 6e-4) - DISCOUNT])


def quantise(count: np.ndarray) -> np.ndarray:
    middle = (LEVELS[1:-1] + LEVELS[2:]) / 2
    return (np.searchsorted(middle, count - DISCOUNT) + 1).astype(np.uint16)


class Trie:
    """Contexts of every length and their successors, in one buffer."""

    def __init__(self, buffer):
        self.contexts = EliasFano(buffer, 0)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.sums = EliasFano(buffer, self.pointers.end)
        self.successors = EliasFano(buffer, self.sums.end)
        self.codes = np.frombuffer(buffer, np.uint16, self.successors.n, self.successors.end)

    @staticmethod
    def dump(context: np.ndarray, successor: np.ndarray, count: np.ndarray) -> bytes:
        """From n-grams in order of (context, successor), each once."""
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, dtype=np.int64)
        rank = np.repeat(np.arange(len(head)), np.diff(np.concatenate([head, [len(context)]])))
        ends, sums = np.concatenate([head, [len(context)]]), np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        return EliasFano.dump(context[head]) + EliasFano.dump(ends.astype(np.uint64)) + EliasFano.dump(sums[ends].astype(np.uint64)) + EliasFano.dump((rank.astype(np.uint64) << U(SUCC_BITS)) | successor) + quantise(count).tobytes()

    @staticmethod
    def mapped(data: bytes) -> Trie:
        m = mmap.mmap(-1, max(1, len(data)))
        m.write(data)
        return Trie(m)

    def rank(self, context: np.ndarray) -> np.ndarray:
        """The place of each context, -1 where absent."""
        return self.contexts.find(context) if self.contexts.n else np.full(len(context), -1, dtype=np.int64)

    def codes_at(self, rank: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of successors of ranked contexts, 0 where absent."""
        out = np.zeros(len(rank), dtype=np.uint16)
        on = np.flatnonzero(rank >= 0)
        if len(on):
            low, high = (self.pointers.get(rank[on] + k).astype(np.int64) for k in (0, 1))
            at = self.successors.find_within((rank[on].astype(np.uint64) << U(SUCC_BITS)) | successor[on], low, high)
            out[on[at >= 0]] = self.codes[at[at >= 0]]
        return out

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of the n-grams, 0 where absent."""
        return self.codes_at(self.rank(context), successor)

    @staticmethod
    def spans(level: EliasFano, rank: np.ndarray) -> np.ndarray:
        out, on = np.zeros(len(rank), dtype=np.int64), rank >= 0
        if on.any():
            out[on] = (level.get(rank[on] + 1) - level.get(rank[on])).astype(np.int64)
        return out

    def fanout(self, context: np.ndarray) -> np.ndarray:
        """Distinct successors of each context."""
        return self.spans(self.pointers, self.rank(context))


# ---- blocks ----


def order_of(x: np.ndarray) -> np.ndarray:
    """An order that sorts x: a sort of high bits and places, which is faster than argsort, then of the few ties left."""
    if len(x) < 2:
        return np.arange(len(x))
    low = U((1 << len(x).bit_length()) - 1)
    packed = (x & ~low) | np.arange(len(x), dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int64)
    y = x[order]
    return order if (y[1:] >= y[:-1]).all() else order[np.argsort(y, kind="stable")]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each x among them."""
    order = order_of(x)
    y = x[order]
    new = np.concatenate([[True], y[1:] != y[:-1]]) if len(y) else np.empty(0, dtype=bool)
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return y[new], place


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as compressed byte planes; high bytes that are all zero cost nearly nothing."""
    planes = [np.array([len(a) for a in arrays], dtype=np.int64).tobytes()]
    planes += [np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 8 * n
    for size in np.frombuffer(raw, np.int64, n).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size).T).view(np.uint64).ravel())
        at += 8 * size
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=U(0))


def ungap(x: np.ndarray) -> np.ndarray:
    return np.add.accumulate(x, dtype=np.uint64)


def streams(texts) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, each with its end token, and the texts' lengths."""
    out = []
    for t in texts:
        out.append(word_hashes((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()))  # bytes: A-Z only
        out.append(np.array([END], dtype=np.uint64))
    lens = np.array([len(a) + 1 for a in out[::2]], dtype=np.int64)
    return np.concatenate(out), lens


def contexts(tokens: np.ndarray, lens: np.ndarray, order: int) -> np.ndarray:
    """[order - 1, tokens] ids of the 1, 2, ... tokens before each token; end tokens stand before each text."""
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(lens) - lens, lens)
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for d in range(1, order):
            back = np.full(len(tokens), END, dtype=np.uint64)
            back[d:] = np.where(at[d:] >= d, tokens[: max(0, len(tokens) - d)], U(END))
            out.append(mix(out[-1] * U(0x9E3779B97F4A7C15) + back + U(d)) if out else back)
    return np.stack(out)


def spread_id(context: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The id of a part of a spread context."""
    with np.errstate(over="ignore"):
        return mix(context + (part + U(1)) * U(0x9E3779B97F4A7C15))


class Level:
    """Distinct contexts of one length in a block, their successors in order, and where each token finds its own pair."""

    def __init__(self, context: np.ndarray, succ: np.ndarray, part: np.ndarray, hot: np.ndarray, bits: int):
        ids = mix(context)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            on = np.flatnonzero(hot[at] == context)
            ids[on] = spread_id(context[on], part[on])
        self.ctx, rank = distinct(ids >> U(64 - bits))
        if len(self.ctx) >> (64 - SUCC_BITS):
            raise ValueError(f"a block has {len(self.ctx)} contexts; use smaller blocks")
        pair, self.pair_of = distinct((rank.astype(np.uint64) << U(SUCC_BITS)) | succ)
        self.succ, self.pair_ctx = pair & U((1 << SUCC_BITS) - 1), (pair >> U(SUCC_BITS)).astype(np.int64)
        if len(hot):
            self.hot_of = np.full(len(self.ctx), -1, dtype=np.int64)
            self.hot_of[rank[on]] = at[on]


class BlockKeys:
    """Distinct keys of a block in the order of their ids: words, and contexts of each length with their successors."""

    def __init__(self, tokens: np.ndarray, lens: np.ndarray, hot: np.ndarray, order: int, bits: int):
        self.words, self.word_of = distinct(tokens)
        ids = mix(tokens)
        succ, part = ids >> U(64 - SUCC_BITS), ids % U(SPREAD)
        self.levels = [Level(c, succ, part, hot, bits) for c in contexts(tokens, lens, order)]


def cuts(ids: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard's range of ids of so many bits begins and ends among sorted ids."""
    return np.searchsorted(ids, np.array([-(-(k << bits) // shards) for k in range(shards)], dtype=np.uint64)).tolist() + [len(ids)]


KEYS = "blk long, shard long, body binary, docs binary"


def emit(shards: int, hot: np.ndarray, order: int, bits: int, block_chars: int):
    """Rows (rid, th, held_out, text) to one message for each shard and block; the first one lists the block's documents."""

    def messages(block: int, texts: list, held_out: list[bool], docs: np.ndarray) -> Iterator[tuple]:
        tokens, lens = streams(texts)
        keys = BlockKeys(tokens, lens, hot, order, bits)
        train = np.repeat(~np.array(held_out), lens)
        word_count = np.bincount(keys.word_of[train], minlength=len(keys.words))
        counts = [np.bincount(v.pair_of[train], minlength=len(v.succ)) for v in keys.levels]
        runs = [np.bincount(v.pair_ctx, minlength=len(v.ctx)) for v in keys.levels]
        wcut = cuts(keys.words, 64, shards)
        ccuts = [cuts(v.ctx, bits, shards) for v in keys.levels]
        pcuts = [np.searchsorted(v.pair_ctx, c) for v, c in zip(keys.levels, ccuts, strict=True)]
        for k in range(shards):
            w = slice(wcut[k], wcut[k + 1])
            arrays = [gaps(keys.words[w]), word_count[w]]
            for v, n, run, c, p in zip(keys.levels, counts, runs, ccuts, pcuts, strict=True):
                ctx, pair = slice(c[k], c[k + 1]), slice(p[k], p[k + 1])
                arrays += [gaps(v.ctx[ctx]), run[ctx], v.succ[pair], n[pair]]
            if k == block % shards or any(map(len, arrays)):
                yield block, k, pack(*arrays), docs.tobytes() if k == block % shards else None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["blk", "shard", "body", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, texts, held, ids, size = TaskContext.get().partitionId() << 30, [], [], [], 0
        rows: list[tuple] = []
        for b in batches:
            for rid, th, held_out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                texts.append(text)
                held.append(held_out)
                ids.append((rid, th))
                size += len(text.as_buffer())
                if size >= block_chars:
                    yield batch(list(messages(block, texts, held, np.array(ids, dtype=np.int64))))
                    block, texts, held, ids, size = block + 1, [], [], [], 0
        if texts:
            rows = list(messages(block, texts, held, np.array(ids, dtype=np.int64)))
            yield batch(rows)

    return paused(run)


def build_part(ctx: np.ndarray, runs: np.ndarray, succ: np.ndarray, count: np.ndarray) -> bytes:
    """The trie of one context length from the keys of all blocks."""
    known = count > 0
    names, rank = distinct(np.repeat(ctx, runs.astype(np.int64))[known])
    key = (rank.astype(np.uint64) << U(SUCC_BITS)) | succ[known].astype(np.uint64)
    order = order_of(key)
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    total = np.add.reduceat(count[known][order].astype(np.int64), head) if len(head) else np.empty(0, dtype=np.int64)
    key = key[head]
    return Trie.dump(names[(key >> U(SUCC_BITS)).astype(np.int64)], key & U((1 << SUCC_BITS) - 1), total)


def taken(body: list, k: int) -> np.ndarray:
    """An array of a message, which the message lets go of."""
    x, body[k] = body[k], None
    return x


ANSWERS = "blk long, shard long, body binary, docs binary"


def answer(order: int, hot_parts: np.ndarray):
    """One shard: builds the trie and answers each block; a row with blk -1 has the shard's sums."""

    def run(t: pa.Table) -> pa.Table:
        with no_gc():
            return pa.table(dict(zip(("blk", "shard", "body", "docs"), answers(t), strict=True)), schema=pa.schema([("blk", pa.int64()), ("shard", pa.int64()), ("body", pa.binary()), ("docs", pa.binary())]))

    def answers(t: pa.Table) -> tuple[list, list, list, list]:
        blocks, shard = t.column("blk").to_pylist(), t.column("shard")[0].as_py()
        bodies = [unpack(b.as_py(), 2 + 4 * (order - 1)) for b in t.column("body")]
        back: list[list] = [[] for _ in bodies]
        words, place = distinct(np.concatenate([ungap(b[0]) for b in bodies]))
        count = np.bincount(place, weights=np.concatenate([b[1] for b in bodies]), minlength=len(words)).astype(np.int64)
        ends = np.cumsum([len(b[0]) for b in bodies])[:-1]
        for out, part in zip(back, np.split(place, ends), strict=True):
            out.append(count[part])
        own: list[np.ndarray] = [np.array([count.sum(), (count > 0).sum()])]
        for level in range(order - 1):
            ctx = np.concatenate([ungap(taken(b, 2 + 4 * level)) for b in bodies])
            c_ends, p_ends = (np.cumsum([len(b[2 + 4 * level + k]) for b in bodies])[:-1] for k in (1, 2))
            runs, succ, counts = (np.concatenate([taken(b, 2 + 4 * level + k).astype(np.uint32) for b in bodies]) for k in (1, 2, 3))
            trie = Trie.mapped(build_part(ctx, runs, succ, counts))
            at = trie.rank(hot_parts.ravel())
            own += [trie.spans(level_, at).reshape(hot_parts.shape).sum(axis=1) if hot_parts.size else np.empty(0, dtype=np.int64) for level_ in (trie.pointers, trie.sums)]
            rank = trie.rank(ctx)
            fan, sums, codes = trie.spans(trie.pointers, rank), trie.spans(trie.sums, rank), trie.codes_at(np.repeat(rank, runs.astype(np.int64)), succ)
            del trie
            for out, *parts in zip(back, np.split(fan, c_ends), np.split(sums, c_ends), np.split(codes, p_ends), strict=True):
                out += parts
        docs = t.column("docs").to_pylist()
        return [-1, *blocks], [shard] * (len(blocks) + 1), [pack(*own), *(pack(*out) for out in back)], [None, *docs]

    return run


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (blk, docs) to (rid, th, blk)."""
    for b in batches:
        for blk, docs in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = np.frombuffer(docs.as_py(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(np.full(len(ids), blk))], ["rid", "th", "blk"])


SCORES = "rid long, th long, n_tokens long, n_known long, base_score double, score double"


def score_block(hot: np.ndarray, hot_fanout: list[np.ndarray], hot_sums: list[np.ndarray], total: int, distinct_words: int, order: int, bits: int):
    """The documents (main, rid, th, text) of a block, all of which it needs for its keys, and its answers to scores of the main ones."""
    schema = pa.schema([("rid", pa.int64()), ("th", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        with no_gc():
            return scored(docs, answers) if docs.num_rows else schema.empty_table()

    def scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, lens = streams(docs.column("text"))
        keys = BlockKeys(tokens, lens, hot, order, bits)
        by_shard = sorted(answers.to_pylist(), key=lambda r: r["shard"])
        bodies = [unpack(r["body"], 1 + 3 * (order - 1)) for r in by_shard]
        all_of = lambda k: np.concatenate([b[k] for b in bodies]).astype(np.int64)
        c = all_of(0)
        base = ((c + 1) / (total + distinct_words + 1))[keys.word_of]
        p = base
        for k, level in enumerate(keys.levels):
            fan, sums_of, codes = (all_of(1 + 3 * k + j) for j in range(3))
            if len(hot):  # successors of spread contexts lie in several shards: their sums came separately
                is_hot = level.hot_of >= 0
                fan, sums_of = np.where(is_hot, hot_fanout[k][level.hot_of], fan), np.where(is_hot, hot_sums[k][level.hot_of], sums_of)
            context_of = level.pair_ctx[level.pair_of]
            seen = sums_of[context_of]
            p = np.where(seen > 0, (LEVELS[codes[level.pair_of]] + DISCOUNT * fan[context_of] * p) / np.maximum(seen, 1), p)
        first = np.cumsum(lens) - lens
        sums = lambda x: np.add.reduceat(x, first)
        known = sums((c > 0)[keys.word_of].astype(np.int64))
        cols = [docs.column("rid"), docs.column("th"), pa.array(lens), pa.array(known), pa.array(sums(np.log10(base))), pa.array(sums(np.log10(p)))]
        return pa.table(cols, schema=schema).filter(docs.column("main"))

    return run


def frequent_contexts(texts: DataFrame, total_chars: int, sample_chars: int, order: int, share: float = 1e-3) -> np.ndarray:
    """Ids (sorted) of contexts that make more than `share` of a bounded sample; they only shape the spread over shards."""
    some = texts.where(F.pmod(F.xxhash64("th"), F.lit(max(1, total_chars // sample_chars))) == 0).limit(20_000)

    def count(batches):
        for b in batches:
            tokens, lens = streams(b.column(0)) if b.num_rows else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
            w, c = np.unique(contexts(tokens, lens, order), return_counts=True)
            keep = c > len(tokens) * share / 2
            yield pa.RecordBatch.from_arrays([pa.array(w[keep].view(np.int64)), pa.array(c[keep]), pa.array(np.full(int(keep.sum()), len(tokens)))], ["w", "c", "n"])

    got = some.select("text").mapInArrow(count, "w long, c long, n long").groupBy("w").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "w").limit(int((order - 1) / share)).collect()
    return np.sort(np.array([r["w"] for r in got], dtype=np.int64).view(np.uint64))


def trie_scores(documents: DataFrame, order: int = 2, block_chars: int = 12_000_000, shard_chars: int = 12_000_000, sample_chars: int = 20_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents(doc_id, text); order is 2 at least."""
    spark = documents.sparkSession
    folder = scratch_dir(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid"), F.xxhash64(text).alias("th"), held_out_sql(7, 2).alias("held_out"), text.alias("text"))
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-size * (order - 1) // shard_chars))
    bits = min(64, max(48, size.bit_length() + 20))
    hot = frequent_contexts(rows, size, sample_chars, order)
    parts = (spread_id(hot[:, None], np.arange(SPREAD, dtype=np.uint64)[None, :]) >> U(64 - bits)) if len(hot) else np.empty((0, SPREAD), dtype=np.uint64)
    keys = rows.select("rid", "th", "held_out", "text").mapInArrow(emit(shards, hot, order, bits, block_chars), KEYS)
    answers = materialise(keys.groupBy("shard").applyInArrow(answer(order, parts), ANSWERS), folder, "answers")
    total = words = 0
    hot_fanout, hot_sums = ([np.zeros(len(hot), dtype=np.int64) for _ in range(order - 1)] for _ in range(2))
    for r in answers.where("blk = -1").select("body").toLocalIterator():  # one row a shard, a few bytes for each hot context
        own = unpack(r["body"], 1 + 2 * (order - 1))
        total, words = total + int(own[0][0]), words + int(own[0][1])
        for k in range(order - 1):
            hot_fanout[k] += own[1 + 2 * k].astype(np.int64)
            hot_sums[k] += own[2 + 2 * k].astype(np.int64)
    # documents are told by doc_id and text; one that repeats may lie in several blocks, and is scored in the first
    of = answers.where("docs is not null").select("blk", "docs").mapInArrow(places, "rid long, th long, blk long").groupBy("rid", "th").agg(F.collect_set("blk").alias("blks"))
    unique = rows.groupBy("rid", "th").agg(F.first("text").alias("text"))
    dealt = unique.join(of, ["rid", "th"]).select(F.explode("blks").alias("blk"), F.array_min("blks").alias("one"), "rid", "th", "text").withColumn("main", F.col("blk") == F.col("one")).drop("one")
    scored = dealt.groupBy("blk").cogroup(answers.where("blk >= 0").select("blk", "shard", "body").groupBy("blk"))
    scores = scored.applyInArrow(score_block(hot, hot_fanout, hot_sums, total, words, order, bits), SCORES)
    scores = materialise(scores, folder, "scores")
    discard(spark, folder, "answers")
    return rows.select("rid", "th", "doc_id", "held_out").join(scores, ["rid", "th"]).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
