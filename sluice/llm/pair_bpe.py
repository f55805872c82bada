"""BPE encoding and decoding with a pair occurrence index.

All new words of a block are laid out in one chain of symbols. An index maps each adjacent pair that has a rank to all
its positions in the block; active ranks sit in a heap and are applied in ascending order, each to all its positions at
once, and every merge updates the position lists of the two pairs that it creates. A file in which some merge needs a
token that only a later merge makes is refused, since ascending order would not be exact for it. Chunks between white
space that were encoded before come from a bounded cache. Rules (ranks, normaliser, word pattern, word-end mark) are read from the tokenizer's public file.

Defined cases: a null or empty text has no ids and decodes to the empty string; added tokens in a text keep their ids,
as the tokenizers library has it; repeated doc_ids give one row each; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import paused

CACHE_CHUNKS = 400_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the others count up from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class PairBpe:
    """A tokenizer of whole texts for files with NFC, white space and lower-case normalisers, a word pattern and BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ", 1)
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
            pairs.setdefault(vocab[a] << 20 | vocab[b], r)
            made[vocab[a + b]] = r
        if any(max(made.get(a, -1), made.get(b, -1)) >= r for r, (a, b, _) in enumerate(self.merges)):
            raise ValueError("a merge uses a token that a later merge makes: ranks can't be applied in ascending order")
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in alphabet], dtype=np.int64)
        self.tokens: list[str] = [""] * (max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.added.items():
            self.tokens[i] = t
        self.added_at = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.space, self.control = regex.compile(r"\s+"), regex.compile(r"[\x1c-\x1f]")  # str.split() takes these four for white space
        self.cache: dict[str, tuple[int, ...]] = {}

    def normalise(self, text: str) -> str:
        """Of a chunk without white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # each letter alone, so no final sigma

    def learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of words that are encoded together as one block."""
        if not words:
            return {}
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(r) for r in raws])
        starts = np.concatenate([[0], ends[:-1]])
        raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
        sym, nxt, prv = self.inner[raw], np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        sym[ends - 1], nxt[ends - 1], prv[starts] = self.final[raw[ends - 1]], -1, -1
        where: dict[int, list[np.ndarray]] = {}  # the index: rank of a pair to its positions
        heap: list[int] = []

        def note(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            pairs = left << 20 | right
            k = np.minimum(np.searchsorted(self.pair_keys, pairs), len(self.pair_keys) - 1)
            hit = self.pair_keys[k] == pairs
            at, rank = at[hit], self.pair_ranks[k[hit]]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else (), np.split(at, cuts), strict=False):
                add(r, part)

        def add(r: int, part) -> None:
            if (got := where.get(r)) is None:
                where[r] = [part]
                heapq.heappush(heap, r)
            else:
                got.append(part)

        first = np.flatnonzero(nxt >= 0)
        note(first, sym[first], sym[first + 1])
        while heap:
            r = heapq.heappop(heap)
            parts = where.pop(r)
            a, b, new = self.merges[r]
            places = parts[0] if len(parts) == 1 else np.concatenate(parts)
            q = nxt[places]
            on = (q >= 0) & (sym[places] == a) & (sym[q] == b)
            places = places[on]
            if a == b or len(parts) > 1:
                places = np.unique(places)
            if a == b and len(places) > 1:  # aaa: the left pair goes first and takes its right neighbour away
                took, last = [], -1
                for p, e in zip(places.tolist(), nxt[places].tolist(), strict=True):
                    if p != last:
                        took.append(p)
                        last = e
                places = np.array(took)
            if not len(places):
                continue
            q = nxt[places]
            sym[places], sym[q] = new, -1
            n = nxt[q]
            nxt[places] = n
            more = n >= 0
            prv[n[more]] = places[more]
            before = prv[places]
            left = before[before >= 0]
            at, other = places[more], n[more]
            note(np.concatenate([at, left]), np.concatenate([sym[at], sym[left]]), np.concatenate([sym[other], np.full(len(left), new)]))
        live = sym >= 0
        ids, count = sym[live].tolist(), np.concatenate([[0], np.cumsum(live)])
        return {w: tuple(ids[i:j]) for w, i, j in zip(words, count[starts].tolist(), count[ends].tolist(), strict=True)}

    def chunks(self, fresh: list[str]) -> None:
        """Puts the ids of chunks (texts between white space) into the cache."""
        own = [self.words.findall(self.normalise(c)) for c in fresh]
        got = self.learn(list({w for ws in own for w in ws}))
        for c, ws in zip(fresh, own, strict=True):
            self.cache[c] = got[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable(map(got.__getitem__, ws)))

    def split(self, text: str) -> list[str]:
        return [c for c in self.space.split(text) if c] if self.control.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each whole text."""
        parts: list[list] = []
        fresh: set[str] = set()
        for text in texts:
            own: list = []
            at = 0
            for m in self.added_at.finditer(text) if self.added_at and "<|" in text else ():
                own += [self.split(text[at : m.start()]), self.added[m[0]]]
                at = m.end()
            own.append(self.split(text[at:]))
            for p in own:
                if not isinstance(p, int):
                    fresh.update(p)
            parts.append(own)
        if len(self.cache) + len(fresh) > CACHE_CHUNKS:
            self.cache = {c: self.cache[c] for c in fresh if c in self.cache}
        self.chunks([c for c in fresh if c not in self.cache])
        get = self.cache.__getitem__
        out = []
        for own in parts:
            ids: list[int] = []
            for p in own:
                if isinstance(p, int):
                    ids.append(p)
                else:
                    ids.extend(chain.from_iterable(map(get, p)))
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """As a tokenizers file without a decoder has it: tokens, special ones too, joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.cache
def bpe_of(path: str) -> PairBpe:
    """One for each worker process, so that its cache outlives a task."""
    return PairBpe(path)


def encode_batches(path: str, block_chars: int = 12_000_000):
    """Arrow batches (doc_id, text) to (doc_id, tokenizer, ids), in blocks of about block_chars of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], PairBpe, list[list[int]]]]:
        bpe = bpe_of(path)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            at = size = 0
            block: list[str] = []
            for i in range(len(ids)):
                block.append(texts[i].as_py() or "")
                size += len(block[-1])
                if size >= block_chars or i + 1 == len(ids):
                    yield ids[at : i + 1], bpe, bpe.encode(block)
                    at, size, block = i + 1, 0, []

    return paused(run)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, _, ids in encode_batches(path)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of encoded(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PairBpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        digits: list[str] = []
        for doc_ids, bpe, ids in encode_batches(path)(batches):
            digits = digits or [str(i) for i in range(len(bpe.tokens))]
            cols = [doc_ids, [len(x) for x in ids], [sha(" ".join(map(digits.__getitem__, x))) for x in ids], [sha(bpe.decode(x)) for x in ids]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
