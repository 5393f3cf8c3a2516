"""Benchmark decontamination by BM25 with block-max pruning.

The items of a benchmark form an inverted index: per term, postings in blocks of BLOCK items, and the largest impact of each
block.  Impacts are BM25 weights divided by the score an item gives itself, so one threshold holds for all items.  Every
text is cut into overlapping passages, each passage is a query, and all items at or above the threshold are retrieved:

* an item's commonest terms, as long as they carry no more than half of the threshold, cannot make it a hit: their lists are not
  walked (the non-essential lists of WAND); the rest must bring what is missing;
* block maxima of the essential terms bound each pair of passage and block; only blocks that reach the bound are opened, and
  there all terms of the passage are scored exactly.  All passages of a slice are bounded at once, in arrays.

A hit counts when enough two-word shingles of both the question (all but the last sentence) and the answer (the last sentence) stand
in the passage.  Passages are twice as long as the longest item and half overlap, so none is cut in two.

An index holds at most INDEX_ITEMS items, and at most PASS of them are sent to executors at once; a larger benchmark takes more passes.
Statistics (items, document frequencies, mean length, longest item) are of the whole benchmark, so hits and scores do not depend on the parts.

Defined cases: null or empty texts and items match nothing, nor do items of one word, which would be found wherever that word stands; items of equal text are found each; repeated documents are judged
each; an empty benchmark matches nothing; other columns are kept by decontaminate() and ignored by hits().
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

K1, B = 1.2, 0.75
#: Share of its own score that an item must reach, and of each part's shingles that must be there.
SCORE, OVERLAP = 0.6, 0.6
BLOCK, INDEX_ITEMS, INDEX_CHARS = 8, 4096, 8_000_000
#: Indexes that one pass over the texts asks.
PASS = 4
LEAST_PASSAGE = 128
#: Marks at the ends of words do not count: all of ASCII's.
_TRIM = string.punctuation


def words_of(text: str) -> list[str]:
    """Lower-cased words without the marks at their ends."""
    return [w for w in (x.decode("utf-8", "ignore").strip(_TRIM) for x in (text or "").lower().encode("utf-8", "surrogatepass").split()) if w]


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer; of a single sentence, its last third is the answer."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if words_of(s)]
    if len(sentences) > 1:
        return words_of(" ".join(sentences[:-1])), words_of(sentences[-1])
    w = words_of(text)
    cut = len(w) - max(1, len(w) // 3) if len(w) > 1 else len(w)
    return w[:cut], w[cut:]


def pairs_of(words: list[str]) -> set:
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {(w,) for w in words}


class Statistics(NamedTuple):
    """Of all items of two words or more: how many, their words, the words of the longest, and for each word the items that hold it."""

    items: int
    words: int
    longest: int
    holders: dict[str, int]


def statistics_of(lists: list[list[str]]) -> Statistics:
    return Statistics(len(lists), sum(map(len, lists)), max(map(len, lists), default=0), Counter(x for w in lists for x in set(w)))


class Index:
    """Of ``items``, with the statistics of the benchmark they are a part of; without them, ``items`` are the whole of it."""

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None):
        items = [(i, t) for i, t in items if len(words_of(t)) > 1]
        self.ids = [i for i, _ in items]
        lists = [words_of(t) for _, t in items]
        whole = whole or statistics_of(lists)
        self.passage = max(LEAST_PASSAGE, 2 * whole.longest)
        self.parts = [tuple(map(pairs_of, parts_of(t))) for _, t in items]
        # In the order of the words, so that in any part an item's weights are summed in the same order.
        names = {x: c for c, x in enumerate(sorted({x for w in lists for x in w}))}
        tf = [dict(sorted(Counter(names[x] for x in w).items())) for w in lists]
        self.names = pa.array(list(names), pa.string())
        df = np.array([whole.holders[x] for x in names], float)
        idf = np.log(1 + (whole.items - df + 0.5) / (df + 0.5))
        mean = whole.words / max(1, whole.items)
        term, item, impact, essential = [], [], [], []
        self.need = np.zeros(len(items))
        for i, count in enumerate(tf):
            weights = {c: idf[c] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(lists[i]) / mean)) for c, n in count.items()}
            own, free = sum(weights.values()), 0.0
            for c, x in sorted(weights.items(), key=lambda e: (idf[e[0]], e[0])):
                x /= own
                is_free = free + x <= SCORE / 2
                free += x if is_free else 0.0
                term.append(c), item.append(i), impact.append(x), essential.append(not is_free)
            self.need[i] = SCORE - free
        order = np.lexsort((item, term)) if term else np.empty(0, np.int64)
        self.item, self.impact = np.array(item, np.int64)[order], np.array(impact)[order]
        term, essential = np.array(term, np.int64)[order], np.array(essential, bool)[order]
        self.at = np.searchsorted(term, np.arange(len(names) + 1))
        # Of the essential postings, one entry for each term and block with its largest impact.
        t, b = term[essential], self.item[essential] // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (b[1:] != b[:-1])])) if len(t) else np.empty(0, np.int64)
        self.block, self.block_max = b[first], np.maximum.reduceat(self.impact[essential], first) if len(first) else np.empty(0)
        self.block_at = np.searchsorted(t[first], np.arange(len(names) + 1))
        self.n_blocks = -(-len(items) // BLOCK)
        self.block_need = np.array([self.need[k : k + BLOCK].min() for k in range(0, len(items), BLOCK)])

    def search(self, arr: pa.Array) -> list[tuple[int, int, int, float, float, float]]:
        """(row, item, passages, best score, question overlap, answer overlap) of all verified hits, one for each row and item."""
        if not self.ids:
            return []
        flat, offs = C.split_words(arr)
        codes, strings = C.coded(flat)
        strings = pc.utf8_trim(pc.utf8_lower(strings), characters=_TRIM)
        known = pc.fill_null(pc.index_in(strings, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        term = known[codes]
        # Half passages; two that follow each other in a text make a passage (a lone half makes one too).
        half = self.passage // 2
        n_half = -(-np.diff(offs) // half)
        first_half = np.concatenate([[0], np.cumsum(n_half)])
        own = C.owner(offs)
        of_half = first_half[own] + (np.arange(len(term)) - offs[own]) // half
        where = np.flatnonzero(term >= 0)
        key = np.unique(of_half[where] * len(self.names) + term[where])  # distinct terms of each half
        h, t = key // len(self.names), key % len(self.names)
        n = self.block_at[t + 1] - self.block_at[t]
        posting = C.gather(self.block_at[t], n)
        bound = np.bincount(np.repeat(h, n) * self.n_blocks + self.block[posting], self.block_max[posting], minlength=first_half[-1] * self.n_blocks).reshape(-1, self.n_blocks)
        last = np.zeros(len(bound), bool)
        last[first_half[1:][n_half > 0] - 1] = True
        both = bound.copy()
        both[:-1][~last[:-1]] += bound[1:][~last[:-1]]
        passage, block = np.nonzero(both >= self.block_need - 1e-9)
        best: dict[tuple[int, int], list] = {}
        row_of_half = np.repeat(np.arange(len(arr)), n_half)
        at_half = np.searchsorted(h, np.arange(len(bound) + 1))
        for p, blocks in _grouped(passage, block):
            end = p + 1 if last[p] else p + 2
            terms = np.unique(t[at_half[p] : at_half[end]])
            n = self.at[terms + 1] - self.at[terms]
            posting = C.gather(self.at[terms], n)
            items = self.item[posting]
            opened = np.zeros(self.n_blocks, bool)
            opened[blocks] = True
            in_open = opened[items // BLOCK]
            score = np.bincount(items[in_open], self.impact[posting][in_open], minlength=len(self.ids))
            hits = np.flatnonzero(score >= SCORE - 1e-9)
            if not len(hits):
                continue
            row = int(row_of_half[p])
            a = offs[row] + (p - first_half[row]) * half
            b = min(offs[row + 1], a + self.passage)
            there = strings.take(pa.array(codes[a:b])).to_pylist()
            there = [w for w in there if w]
            pairs = set(zip(there, there[1:], strict=False)) | {(w,) for w in there}
            for i in hits.tolist():
                q, ans = self.parts[i]
                over = [len(x & pairs) / len(x) if x else 1.0 for x in (q, ans)]
                if min(over) >= OVERLAP:
                    e = best.setdefault((row, i), [0, 0.0, 0.0, 0.0])
                    e[0] += 1
                    e[1:] = max(e[1:], [float(score[i]), *over])
        return [(row, self.ids[i], *e) for (row, i), e in sorted(best.items())]


def _grouped(a: np.ndarray, b: np.ndarray):
    ends = np.flatnonzero(np.concatenate([a[1:] != a[:-1], [True]])) + 1 if len(a) else []
    at = 0
    for e in ends:
        yield int(a[at]), b[at:e]
        at = e


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each item how many words it has, and its distinct words."""
    for b in batches:
        lists = [words_of(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in lists], pa.int64()), pa.array([sorted(set(w)) for w in lists], pa.list_(pa.string()))], names=["n", "words"])


def statistics(rows: DataFrame) -> Statistics:
    """Of all ``rows`` (text, not null).  The driver gets one row for each distinct word; the indexes it holds have them too."""
    words = rows.select("text").mapInArrow(_words, "n long, words array<string>").where(F.col("n") > 1)
    n, total, longest = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    holders = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("holders")).toArrow()
    return Statistics(n, total, longest, dict(zip(*(holders.column(c).to_pylist() for c in ("word", "holders")), strict=True)))


def indexes(benchmark: DataFrame) -> list[Index]:
    """Indexes of at most about INDEX_ITEMS items and INDEX_CHARS characters each; sizes are asked before any item is fetched."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, math.ceil(2 * n / INDEX_ITEMS), math.ceil(2 * chars / INDEX_CHARS)) if n > INDEX_ITEMS or chars > INDEX_CHARS else 1
    whole = statistics(rows)
    return [Index([(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect()], whole) for i in range(parts)]


def _passes(benchmark: DataFrame) -> list[list[Index]]:
    """The indexes that are sent out together and asked in one pass over the texts; an empty one if there are no items."""
    found = indexes(benchmark)
    return [found[i : i + PASS] for i in range(0, len(found), PASS)]


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_passages, score, question_overlap, answer_overlap: one row for each document and item it holds."""
    out = None
    for group in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in C.slices(whole):
                    texts = C.texts_of(b)
                    found = [f for index in group for f in index.search(texts)]
                    cols = list(zip(*found, strict=True)) if found else [[]] * 6
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[3:])], names=["doc_id", "item_id", "n_passages", "score", "question_overlap", "answer_overlap"])

        part = C.plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, item_id long, n_passages long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay, and nothing is shuffled."""
    for group in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in C.slices(whole):
                    keep, texts = np.ones(b.num_rows, bool), C.texts_of(b)
                    for index in group:
                        keep[[f[0] for f in index.search(texts)]] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
