"""Packing of token streams into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut: full windows come off its front, and what is left over goes, in near-equal pieces of at most
`piece` tokens, to a pool. A pool that holds the tokens of `pool` windows is partitioned by differencing: every piece
starts as a partial partition with one loaded window, and the two partial partitions with the largest imbalance merge,
the heaviest window of one with the lightest of the other, until one is left. Its windows are near-equal; whenever the
heaviest exceeds the capacity, the window count rises by one and the pool is partitioned anew.

Pools are filled to `fill` of their windows (the last piece is cut there and its rest opens the next pool), so padding
stays near 1 - fill. Every task packs its own rows in bounded memory, nothing is shuffled. sequence_id is the number of
the task's partition, shifted, plus a count. Sequences are padded to 1024, or stay as they are at a power of two.

Defined cases: a null or empty text is the end id alone; repeated doc_ids are packed as separate documents; an empty
table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import no_gc
from .pair_bpe import byte_alphabet

#: The public word pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each piece, load of each window) of a multiway partition by largest differencing."""
    if windows == 1:
        return np.zeros(len(sizes), dtype=np.int64), np.array([sum(sizes)])
    # a partial partition: loads ascending, and for each window a linked list of pieces (head, tail)
    link = np.full(len(sizes), -1, dtype=np.int64)
    empty = np.full(windows - 1, -1, dtype=np.int64)
    heap = [(-s, i, np.concatenate([np.zeros(windows - 1, dtype=np.int64), [s]]), np.concatenate([empty, [i]]), np.concatenate([empty, [i]])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, load_a, head_a, tail_a = heapq.heappop(heap)
        _, _, load_b, head_b, tail_b = heapq.heappop(heap)
        load_b, head_b, tail_b = load_b[::-1], head_b[::-1], tail_b[::-1]  # heaviest meets lightest
        load = load_a + load_b
        joined = (tail_a >= 0) & (head_b >= 0)
        link[tail_a[joined]] = head_b[joined]
        head, tail = np.where(head_a >= 0, head_a, head_b), np.where(tail_b >= 0, tail_b, tail_a)
        order = np.argsort(load, kind="stable")
        load = load[order]
        heapq.heappush(heap, (-int(load[-1] - load[0]), count, load, head[order], tail[order]))
        count += 1
    _, _, load, head, _ = heap[0]
    window = np.empty(len(sizes), dtype=np.int64)
    for w, p in enumerate(head.tolist()):
        while p >= 0:
            window[p] = w
            p = int(link[p])
    return window, load


def partition(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Windows of at most `capacity`, as few as the differencing can do: the count rises while one is exceeded."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        window, load = differencing(sizes, windows)
        if load.max(initial=0) <= capacity:
            return window, windows
        windows += 1


class Packer:
    def __init__(self, capacity: int, piece: int, pool: int, fill: float, first: int):
        self.capacity, self.piece, self.target, self.next = capacity, piece, int(pool * capacity * fill), first
        self.waiting: list[tuple[int, int, int, bytes]] = []  # doc_id, start, tokens in the document, ids
        self.held = 0
        self.out: list[tuple] = []

    def emit(self, doc_id: int, start: int, n: int, ids: bytes, sequence: int, offset: int) -> None:
        self.out.append((doc_id, start, len(ids) >> 2, zlib.crc32(ids), n, sequence, offset))

    def add(self, doc_id: int, ids: bytes) -> None:
        n, size = len(ids) >> 2, self.capacity * 4
        at = 0
        while len(ids) - at >= size:
            self.emit(doc_id, at >> 2, n, ids[at : at + size], self.next, 0)
            self.next += 1
            at += size
        left = n - (at >> 2)
        cuts = -(-left // self.piece)
        for i in range(cuts):
            a, b = at + 4 * (left * i // cuts), at + 4 * (left * (i + 1) // cuts)
            while b > a:
                c = min(b, a + 4 * (self.target - self.held))
                self.waiting.append((doc_id, a >> 2, n, ids[a:c]))
                self.held += (c - a) >> 2
                a = c
                if self.held >= self.target:
                    self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        window, windows = partition([len(p[3]) >> 2 for p in self.waiting], self.capacity)
        offsets = [0] * windows
        for (doc_id, start, n, ids), w in zip(self.waiting, window.tolist(), strict=True):
            self.emit(doc_id, start, n, ids, self.next + w, offsets[w])
            offsets[w] += len(ids) >> 2
        self.next += windows
        self.waiting, self.held = [], 0

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])


class Encoder:
    """Ids of whole texts as packed little-endian uint32.

    tiktoken splits and merges whole texts by the public pattern and the ranks in the file (the id order of its
    vocabulary), which gives the library's ids in less time; texts that hold an added token, and those on which its
    pattern gives up (very long runs of one kind), go to the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            try:
                return self.packed(self.ordinary(text))
            except BaseException as e:  # a panic of the pattern engine is no Exception
                if type(e).__name__ not in ("PanicException", "ValueError", "RuntimeError"):
                    raise
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, piece: int = 256, pool: int = 128, fill: float = 0.995) -> DataFrame:
    """Pieces of docs(doc_id, text) with their places in sequences; see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path), Encoder.packed([end_id])
        packer = Packer(capacity, piece, pool, fill, TaskContext.get().partitionId() << 40)
        with no_gc():
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    packer.add(doc_id, encoder.encode(text.as_py() or "") + end)
                    if len(packer.out) >= 20_000:
                        yield packer.take()
            packer.flush()
            yield packer.take()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
