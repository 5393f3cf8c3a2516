"""Byte-level BPE encoding and decoding.

A text is cut into matches of a pattern; each match is encoded on its own.  Matches that a worker has not met are put into
zero-padded numpy matrices of similar length; in each round every row merges its leftmost pair of the least rank, found in a
hashed table of pairs, and the row is closed up.  A match beyond the longest matrix takes the same merges in the same order from a heap
over linked ids, so its time grows with n log n.  A worker remembers pieces and their ids up to a bound in bytes, and lets go of all
soon after its last task: Spark keeps workers, and what they hold would lie beside the memory of whatever runs next.

Defined cases: a null text is empty; empty texts have no ids; repeated rows are encoded each, also without a doc_id (which stays null);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import os
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Bytes of pieces that a worker remembers, about (two generations of half as many), and what a piece takes besides its letters and ids.
REMEMBERED, PIECE_BYTES = 128 << 20, 300
#: Seconds after its last task until a worker lets go of the encoder.
IDLE = 3.0
#: Lengths of padded matrices.
BUCKETS = (4, 8, 12, 16, 24, 32, 64)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().split(b"\n")))}


class PairTable:
    """(left id, right id) -> id of the joined token, or none, by open addressing in flat arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(rank)
        key = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(2.5 * max(1, len(key))))))
        self.keys, self.to = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, -1, np.int64)
        at, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        to = np.array(to, np.int64)
        while len(todo):  # in each round the first to come takes a free slot, the others go on
            slot = at[todo]
            free = self.keys[slot] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            won = free & first
            self.keys[slot[won]], self.to[slot[won]] = key[todo[won]], to[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (C.mix(key) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at, out = self._slot(key), np.full(len(key), -1, np.int64)
        live = np.arange(len(key))
        while len(live):
            got = self.keys[at[live]]
            hit = got == key[live]
            out[live[hit]] = self.to[at[live[hit]]]
            live = live[~hit & (got != np.uint64(2**64 - 1))]
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)
        return out


_NONE = np.int64(1 << 40)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.pattern, self.ranks, self.table = regex.compile(pattern), ranks, PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.tokens = {i: t for t, i in ranks.items()}
        self.spaced: list[dict] = [{}, {}]
        self.firsts: list[dict] = [{}, {}]
        self.held, self.half = 0, remembered // 2  # bytes of the younger generations, and how many they may have

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = [whole]
            else:
                n = len(p)
                if n > BUCKETS[-1]:
                    out[i] = self._merge_long(p)
                else:
                    by.setdefault(next(b for b in BUCKETS if n <= b), []).append(i)
        for rows in by.values():
            width = max(len(pieces[i]) for i in rows)
            for at in range(0, len(rows), max(1, (1 << 20) // width)):
                part = rows[at : at + max(1, (1 << 20) // width)]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        ids = np.zeros((n, width), np.int64)
        ids[np.arange(width) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        done: list = [None] * n
        rows = np.arange(n)
        rank = np.full((n, max(1, width - 1)), _NONE)
        r, c = np.nonzero(np.arange(max(1, width - 1)) < (size - 1)[:, None])
        if len(r):
            got = self.table.find(ids[r, c], ids[r, c + 1])
            rank[r, c] = np.where(got < 0, _NONE, got)
        while len(rows):
            best = rank.argmin(1)  # the leftmost of the least
            low = rank[np.arange(len(rows)), best]
            over = low == _NONE
            if over.any():
                for i in np.flatnonzero(over).tolist():
                    done[rows[i]] = ids[i, : size[i]].tolist()
                live = ~over
                rows, ids, size, rank, best, low = rows[live], ids[live], size[live], rank[live], best[live], low[live]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            w = int(size.max())
            ids, rank = ids[:, :w], rank[:, : max(1, w - 1)]
            ids[k, best] = low
            cols = np.arange(w - 1)
            ids[:, :-1] = np.where(cols > best[:, None], ids[:, 1:], ids[:, :-1])
            if rank.shape[1] > 1:
                rank[:, :-1] = np.where(cols[:-1] > best[:, None] - 1, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            size = size - 1
            for at in (best - 1, best):  # the pairs on both sides of what was merged
                ok = np.flatnonzero((at >= 0) & (at < size - 1))
                got = self.table.find(ids[ok, at[ok]], ids[ok, at[ok] + 1])
                rank[ok, at[ok]] = np.where(got < 0, _NONE, got)
                out_of = np.flatnonzero((at >= 0) & (at >= size - 1) & (at < rank.shape[1]))
                rank[out_of, at[out_of]] = _NONE
        return done

    def _merge_long(self, piece: bytes) -> list[int]:
        """Ids of one long piece; a heap holds the pairs by rank and place, neighbours are linked."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        found = self.table.find(ids[:-1], ids[1:])
        at = np.flatnonzero(found >= 0)
        heap = list(zip(found[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [*found.tolist(), -1]  # of the pair that begins at each place; -1: none, or the place is gone
        pairs = self.pairs

        def anew(i: int) -> None:
            rank[i] = pairs(ids[i], ids[after[i]]) if after[i] < n else -1
            if rank[i] >= 0:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue  # merged, or another pair, since it was pushed
            gone = after[i]
            ids[i], after[i] = r, after[gone]
            rank[gone] = -1
            if after[i] < n:
                before[after[i]] = i
            anew(i)
            if before[i] >= 0:
                anew(before[i])
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def pairs(self, left: int, right: int) -> int:
        """Id of two joined tokens, or -1: a pair's id is the rank of its bytes."""
        return self.ranks.get(self.tokens[left] + self.tokens[right], -1)

    def _known(self, units: set[str], cache: list[dict], lead: str) -> dict[str, tuple]:
        """For runs of text that the pattern cuts alike wherever they stand: (ids as decimals, number of ids, their bytes).

        ``lead`` is what stands before each of ``units``; ``cache`` is the younger and the older generation of those known;
        others than ``units`` may be returned too.
        """
        young, old = cache
        todo, new = [], units.difference(young)
        for u in new:
            if (x := old.get(u)) is None:
                todo.append(u)
            else:
                young[u] = x
        pieces = list(map(self.pattern.findall, [lead + u for u in todo]))
        each = {p: None for ps in pieces for p in ps}
        for p, ids in zip(each, self.merge([p.encode("utf-8") for p in each]), strict=True):
            each[p] = ids
        for u, ps in zip(todo, pieces, strict=True):
            ids = each[ps[0]] if len(ps) == 1 else [i for p in ps for i in each[p]]
            young[u] = (" ".join(map(str, ids)), len(ids), self.decode(ids))
        self.held += sum(PIECE_BYTES + len(said) + 3 * len(raw) for said, _, raw in map(young.__getitem__, new))
        return young

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode(self, texts: list[str]) -> list[list[tuple]]:
        """For each text its runs in order, each with ids as decimals, their number and the bytes they stand for.

        One space between two characters that are no white space always begins a match, so texts are cut there.
        """
        units = [self.units(t) for t in texts]
        spaced: set[str] = set()
        for _, rest in units:
            spaced.update(rest)
        known = self._known(spaced, self.spaced, " ").__getitem__
        firsts = self._known({u for first, _ in units for u in first}, self.firsts, "").__getitem__
        if self.held > self.half:  # what was used since the last time is the older generation
            self.spaced, self.firsts, self.held = [{}, self.spaced[0]], [{}, self.firsts[0]], 0
        return [[*map(firsts, first), *map(known, rest)] for first, rest in units]

    def units(self, text: str) -> tuple[list[str], list[str]]:
        """Runs that stand as they are, then runs that follow them after one space each."""
        if not text:
            return [], []
        # Printable but for line ends: then no other white space is there, and spaces need a look only beside each other and line ends.
        if "  " not in text and " \n" not in text and "\n " not in text and text[0] != " " and text[-1] != " " and text.replace("\n", "").isprintable():
            first, *rest = text.split(" ")
            return [first], rest
        # Join again where white space meets white space: there the cut would not be a boundary for certain.
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            before = out[-1][-1:]
            if before and not before.isspace() and p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return [u for u in out if u], []

    def ids(self, text: str) -> list[int]:
        return [int(i) for x in self.encode([text])[0] for i in x[0].split()]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


@lru_cache(maxsize=1)
def _made(path: str, pattern: str, written: tuple[int, int]) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def made(path: str, pattern: str) -> Bpe:
    """The worker's encoder: its tables and what it remembers serve all tasks of the worker, until another file is asked for or none has run for a while."""
    at = os.stat(path)
    return _made(path, pattern, (at.st_mtime_ns, at.st_size))


_idle: list[threading.Timer] = []


@contextmanager
def _task() -> Iterator[None]:
    """Around a task of a worker: without another one the encoder goes after IDLE seconds.  A task that begins just then makes its own."""
    while _idle:
        _idle.pop().cancel()
    try:
        yield
    finally:
        timer = threading.Timer(IDLE, _made.cache_clear)
        timer.daemon = True
        _idle.append(timer)
        timer.start()


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the search for cycles, of which encoding makes none: it would walk through all that is remembered again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _digests(path: str, pattern: str, with_ids: bool):
    def digests(batches: Iterator[pa.RecordBatch], bpe: Bpe) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole, limit=2 * C.SLICE_BYTES):
                n, a, d, ids = [], [], [], []
                with _uncollected():
                    encoded = bpe.encode(C.texts_of(b).to_pylist())
                for runs in encoded:
                    said, count, raw = zip(*runs, strict=True) if runs else ((), (), ())
                    text = " ".join(said)
                    n.append(sum(count))
                    a.append(hashlib.sha256(text.encode()).hexdigest())
                    d.append(hashlib.sha256(b"".join(raw)).hexdigest())
                    if with_ids:
                        ids.append(np.array(text.split(), np.int32))
                cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                if with_ids:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32()))], names=[*_OUT.names, "ids"])
                else:
                    yield pa.RecordBatch.from_arrays(cols, schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _task():
            yield from digests(batches, made(path, pattern))

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids themselves) of each row of ``docs`` (doc_id, text)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return C.plain(docs, "doc_id", "text").mapInArrow(_digests(ranks_path, pattern, with_ids), schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
