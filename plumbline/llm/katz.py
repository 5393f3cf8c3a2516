"""Language-model scores by Katz backoff over word n-grams.

Words are counted in blocks of documents (``CHUNK_TOKENS``): a block is written once as codes of its own sorted vocabulary,
and all exchange is by block and bucket, in compressed sorted arrays:

1. ``packed``: the blocks, bucketed by block.  2. ``unigrams``: words of all blocks by range of hash, with training counts; a
word's place is its id.  3. ``resolved``: per block, ids and counts of its words.  4. For each order from 2 on, each block sends its distinct
n-grams (context, word, training count, what the next lower order gives the word) to buckets; a bucket sums them, keeps those of training
as the model, partitioned by bucket, and tells each block the counts of its n-grams and, of each context, the sums that its
discounts and backoff weight are made of.  5. Each block sums every document, order by order per token.

Nothing depends on how often a word or n-gram comes: a block sends each distinct one once.  A context with many followers (the beginning
of a text, a common word) is dealt to several buckets by word, as many as its known share of all tokens asks for; a block adds up what
these say of it.

Model: Good-Turing discounts for counts of 1 to K, from the counts of counts of each order; what they free is spread over unseen words in
proportion to the next lower order's probability, with weights that make each context's probabilities sum to 1; a context whose
counts are all above K frees 1 / (N + 1), one that training lacks leaves all to the lower order.  Unigrams free their own discount for
one class of unknown words.  What comes before a text is its beginning, as often as the order needs; the end is a token.

``ORDER`` is the order that op9 uses; score() takes 1 to 3, since a context of two 32-bit ids is still one exact number.

Defined cases: a null text is empty and has its end only; a row without a doc_id is learned from; repeated rows count as often as they stand; with no training rows
every token is unknown (score 0, as the unknown class then has probability 1); an empty table gives an empty result; other
columns are ignored.  At most 2^32 - 2 distinct words; more is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CHUNK_TOKENS = 2_000_000
K, ORDER = 5, 2
#: What stands for a null doc_id in blocks.
_NO_ID = -(2**63)
#: The end of a text, as a word's hash; and the beginning, as a first word's id.
END, BEGIN = np.uint64(2**64 - 1), np.uint64(2**32 - 1)


def squeeze(a: np.ndarray, ascending: bool = False) -> bytes:
    """An integer or float array as zstandard-compressed byte planes, of differences if it ascends."""
    if ascending and len(a):
        a = np.diff(a, prepend=a.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) if len(a) else b""


def stretch(raw: bytes, dtype, ascending: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    if not raw:
        return np.empty(0, dtype)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    a = np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T).view(dtype).ravel()
    return np.cumsum(a, dtype=dtype) if ascending else a


def held_out(doc_ids, parts: int = 7, which: int = 2) -> np.ndarray:
    """A row without a doc_id is not held out."""
    return np.array([i != _NO_ID and zlib.crc32(str(i).encode()) % parts == which for i in doc_ids], bool)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)], schema=schema)


_B = pa.binary()
_PACKED = pa.schema([("chunk", pa.int64()), ("docs", _B), ("held", _B), ("sizes", _B), ("codes", _B), ("vocab", _B), ("trained", _B)])
_PACKED_SQL = "chunk long, docs binary, held binary, sizes binary, codes binary, vocab binary, trained binary"


def _pack(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, docs, sizes, words, n = count(TaskContext.get().partitionId() << 24), [], [], [], 0

        def row() -> pa.RecordBatch:
            ids, size = np.concatenate(docs), np.concatenate(sizes)
            vocab, codes = np.unique(np.concatenate(words), return_inverse=True)
            held = held_out(ids.tolist())
            trained = np.bincount(codes[np.repeat(~held, size)], minlength=len(vocab)).astype(np.uint32)
            return _batch([(next(names), squeeze(ids), squeeze(held.astype(np.uint8)), squeeze(size), squeeze(codes.astype(np.uint32)), squeeze(vocab, True), squeeze(trained))], _PACKED)

        for whole in batches:
            for b in C.slices(whole):
                flat, offs = C.split_words(pc.ascii_lower(C.texts_of(b)))
                codes, strings = C.coded(flat)
                h = np.insert(C.hash_strings(strings)[codes], offs[1:], END)
                docs.append(pc.fill_null(b.column("doc_id"), _NO_ID).to_numpy(zero_copy_only=False))
                sizes.append(np.diff(offs) + 1)
                words.append(h)
                n += len(h)
                if n >= limit:
                    yield row()
                    docs, sizes, words, n = [], [], [], 0
        if docs:
            yield row()

    return run


def _bucket_bounds(parts: int) -> np.ndarray:
    """First hashes of ranges 1 .. parts - 1."""
    return np.array([(2**64 * i) // parts for i in range(1, parts)], np.uint64)


_ASK = pa.schema([("ub", pa.int32()), ("chunk", pa.int64()), ("keys", _B), ("n", _B)])


def _ask(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, vocab, trained in zip(*(b.column(c).to_pylist() for c in ("chunk", "vocab", "trained")), strict=True):
                v, t = stretch(vocab, np.uint64, True), stretch(trained, np.uint32)
                at = np.concatenate([[0], np.searchsorted(v, _bucket_bounds(parts)), [len(v)]])
                yield _batch([(i, chunk, squeeze(v[x:y], True), squeeze(t[x:y])) for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x], _ASK)

    return run


def _sum_by(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sum of values (int64), and of each key its first place in the concatenation."""
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(np.concatenate(values)[order].astype(np.int64), first), order[first]


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == r).sum()) for r in range(1, K + 2)]


_NR = [(f"n{r}", pa.int64()) for r in range(1, K + 2)]
_NR_SQL = "".join(f", n{r} long" for r in range(1, K + 2))
_UNI = pa.schema([("ub", pa.int32()), ("keys", _B), ("n", _B), ("words", pa.int64()), ("seen", pa.int64()), ("total", pa.int64()), ("ends", pa.int64()), *_NR])


def _unigrams(t: pa.Table) -> pa.Table:
    keys, n, _ = _sum_by([stretch(x, np.uint64, True) for x in t["keys"].to_pylist()], [stretch(x, np.uint32) for x in t["n"].to_pylist()])
    return _table([(t["ub"][0].as_py(), squeeze(keys, True), squeeze(n), len(keys), int((n > 0).sum()), int(n.sum()), int(n[keys == END].sum()), *_counts_of_counts(n))], _UNI)


#: What blocks are told: of order 1 ids and counts of their words, of higher orders what a bucket says of their n-grams and contexts.
_TOLD = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("a", _B), ("b", _B), ("c", _B), ("d", _B)])
_TOLD_SQL = "chunk long, level int, bucket int, a binary, b binary, c binary, d binary"


def _resolve(asked: pa.Table, uni: pa.Table) -> pa.Table:
    if not asked.num_rows:
        return _table([], _TOLD)
    keys, n, base = stretch(uni["keys"][0].as_py(), np.uint64, True), stretch(uni["n"][0].as_py(), np.int64), uni["base"][0].as_py()
    rows = []
    for chunk, raw in zip(asked["chunk"].to_pylist(), asked["keys"].to_pylist(), strict=True):
        at = np.searchsorted(keys, stretch(raw, np.uint64, True))
        rows.append((chunk, 1, asked["ub"][0].as_py(), squeeze((at + base).astype(np.uint64), True), squeeze(n[at]), b"", b""))
    return _table(rows, _TOLD)


def _joined(t: pa.Table) -> pa.Table:
    t = t.sort_by("bucket")
    ids = np.concatenate([stretch(x, np.uint64, True) for x in t["a"].to_pylist()])
    n = np.concatenate([stretch(x, np.int64) for x in t["b"].to_pylist()])
    return _table([(t["chunk"][0].as_py(), 1, -1, squeeze(ids, True), squeeze(n), b"", b"")], _TOLD)


class Facts:
    """What is known of the whole corpus before n-grams are counted; and the discounts of each order so far (``d[level]``)."""

    def __init__(self, parts: int, tokens: int, texts: int, uni: Unigram):
        self.parts, self.tokens, self.texts, self.uni = parts, tokens, texts, uni
        self.d: dict[int, np.ndarray] = {}


class Grams:
    """The distinct n-grams of a block: context and word of each, in order; how often training has it; and which of them each token ends."""

    def __init__(self, ctx: np.ndarray, word: np.ndarray, train: np.ndarray, ctx_count: np.ndarray):
        order = np.lexsort((word, ctx))
        c, w = ctx[order], word[order]
        first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])]))
        self.ctx, self.word, self.token = c[first], w[first], order[first]
        self.n = np.add.reduceat(train[order].astype(np.int64), first).astype(np.uint32)
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        self.ctx_count = ctx_count[self.token]

    def dealt(self, facts: Facts):
        """(bucket, which n-grams, contexts, how many of the n-grams each has) of each bucket that is asked; a context dealt to several is asked of in all of them."""
        parts = facts.parts
        tasks = 1 + np.minimum(parts - 1, self.ctx_count * parts // max(1, facts.tokens)).astype(np.int64)
        home = (C.mix(self.ctx) % np.uint64(parts)).astype(np.int64)
        bucket = (home + (C.mix(self.word.astype(np.uint64) + np.uint64(1)) % tasks.astype(np.uint64)).astype(np.int64)) % parts
        to = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[to], np.arange(parts + 1))
        start = np.flatnonzero(np.concatenate([[True], self.ctx[1:] != self.ctx[:-1]]))
        shared = start[tasks[start] > 1]
        also = np.repeat(self.ctx[shared], tasks[shared])
        also_in = (np.repeat(home[shared], tasks[shared]) + C.gather(np.zeros(len(shared), np.int64), tasks[shared])) % parts if len(shared) else np.empty(0, np.int64)
        for i in range(parts):
            which = to[at[i] : at[i + 1]]
            ctxs, each = np.unique(np.concatenate([self.ctx[which], also[also_in == i]]), return_counts=True)
            if len(ctxs):
                if (more := also[also_in == i]).size:
                    each[np.searchsorted(ctxs, more)] -= 1
                yield i, which, ctxs, each.astype(np.uint32)

    def probabilities(self, facts: Facts, d: np.ndarray, lower: np.ndarray, told: dict[int, dict]) -> tuple[np.ndarray, np.ndarray]:
        """P(word | context) and the count of each n-gram, from the probabilities of the next lower order."""
        start = np.flatnonzero(np.concatenate([[True], self.ctx[1:] != self.ctx[:-1]]))
        distinct, own = self.ctx[start], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(self.ctx))))
        r, total, by_count, given = np.zeros(len(self.ctx), np.int64), np.zeros(len(start), np.int64), np.zeros((K, len(start)), np.int64), np.zeros(len(start))
        for i, which, ctxs, _ in self.dealt(facts):
            a, at = told[i], np.searchsorted(distinct, ctxs)
            r[which] = stretch(a["a"], np.int64)
            total[at] += stretch(a["b"], np.int64)
            by_count[:, at] += stretch(a["c"], np.uint32).reshape(K, -1)
            given[at] += stretch(a["d"], np.float64)
        none = by_count.sum(0) == 0
        size = np.where(none, total + 1.0, total)
        freed = np.where(none, 1.0, ((1 - d[1:]) * np.arange(1, K + 1)) @ by_count)
        alpha = np.where(total > 0, freed / size / np.maximum(1 - given, 1e-12), 1.0)
        return np.where(r > 0, discounted(r, d) / size[own], alpha[own] * lower), r


class Block:
    """The tokens of a block, with what it was told of them so far."""

    def __init__(self, packed: dict, told: list[dict], facts: Facts):
        self.facts, self.told = facts, {}
        for t in told:
            self.told.setdefault(t["level"], {})[t["bucket"]] = t
        words = self.told[1][-1]
        ids, counts = stretch(words["a"], np.uint64, True), stretch(words["b"], np.int64)
        self.sizes, codes = stretch(packed["sizes"], np.int64), stretch(packed["codes"], np.uint32)
        self.train = np.repeat(stretch(packed["held"], np.uint8) == 0, self.sizes)
        self.word, self.count = ids[codes], counts[codes]
        self.first = np.cumsum(self.sizes) - self.sizes

    def _before(self, values: np.ndarray, begin) -> np.ndarray:
        """For each token, the value of the token before it."""
        out = np.concatenate([values[:1], values[:-1]])
        out[self.first] = begin
        return out

    def grams(self, level: int) -> tuple[Grams, np.ndarray]:
        """The n-grams of an order, and the probability of each word by the order below."""
        begin = self.facts.texts
        before = self._before(self.word, BEGIN)
        if level == 2:
            g = Grams(before, self.word, self.train, self._before(self.count, begin))
            return g, self.facts.uni(self.count[g.token])
        probability, r = self.tokens(level - 1)
        g = Grams(self._before(before, BEGIN) << np.uint64(32) | before, self.word, self.train, self._before(r, begin))
        return g, probability[g.token]

    def tokens(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: its probability by an order, and how often training has the n-gram."""
        if level == 1:
            return self.facts.uni(self.count), self.count
        g, lower = self.grams(level)
        probability, r = g.probabilities(self.facts, self.facts.d[level], lower, self.told[level])
        return probability[g.at], r[g.at]


_GRAMS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("ctx", _B), ("each", _B), ("words", _B), ("n", _B), ("lower", _B)])
_GRAMS_SQL = "bucket int, chunk long, ctx binary, each binary, words binary, n binary, lower binary"


def _grams(level: int, facts: Facts):
    def run(packed: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        for p in packed.to_pylist():
            block = Block(p, told.to_pylist(), facts)
            g, lower = block.grams(level)
            # Of order 2 the word's count says its probability, in fewer bytes.
            said = block.count[g.token] if level == 2 else lower
            rows += [(i, p["chunk"], squeeze(ctxs, True), squeeze(each), squeeze(g.word[which].astype(np.uint32)), squeeze(g.n[which]), squeeze(said[which])) for i, which, ctxs, each in g.dealt(facts)]
        return _table(rows, _GRAMS)

    return run


_COUNTED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("a", _B), ("b", _B), ("c", _B), ("d", _B), *_NR])
_COUNTED_SQL = "kind int, bucket int, chunk long, a binary, b binary, c binary, d binary" + _NR_SQL


def _counted(level: int, facts: Facts):
    """Sums of one bucket: the model's n-grams (kind 0: contexts, words, counts) and what each block is told (kind 1: counts of its n-grams; of its contexts the total, how many followers have each count to K, and the lower probabilities of all followers)."""

    def run(t: pa.Table) -> pa.Table:
        asked = [(r["chunk"], stretch(r["ctx"], np.uint64, True), stretch(r["each"], np.uint32), stretch(r["words"], np.uint32), stretch(r["n"], np.uint32), r["lower"]) for r in t.to_pylist()]
        bucket = t["bucket"][0].as_py()
        ctx, word = np.concatenate([np.repeat(c, e) for _, c, e, *_ in asked]), np.concatenate([w for _, _, _, w, _, _ in asked])
        order = np.lexsort((word, ctx))
        c, w = ctx[order], word[order]
        first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])) if len(c) else np.empty(0, np.int64)
        n = np.add.reduceat(np.concatenate([x for _, _, _, _, x, _ in asked])[order].astype(np.int64), first) if len(c) else np.empty(0, np.int64)
        r = np.empty(len(order), np.int64)
        r[order] = np.repeat(n, np.diff(np.append(first, len(order))))
        lower = np.concatenate([stretch(x, np.int64 if level == 2 else np.float64) for *_, x in asked])[order[first]]
        keep = n > 0
        c, w, n, lower = c[first][keep], w[first][keep], n[keep], lower[keep]
        lower = facts.uni(lower) if level == 2 else lower
        start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
        sums = lambda x: np.add.reduceat(x, start) if len(start) else np.empty(0, x.dtype)
        known, total, given = c[start], sums(n), sums(lower)
        by_count = np.stack([sums((n == k).astype(np.int64)) for k in range(1, K + 1)])
        rows, at = [(0, bucket, -1, squeeze(c, True), squeeze(w), squeeze(n), b"", *_counts_of_counts(n))], 0
        for chunk, ctxs, each, *_ in asked:
            place = np.minimum(np.searchsorted(known, ctxs), max(0, len(known) - 1))
            here = known[place] == ctxs if len(known) else np.zeros(len(ctxs), bool)
            pick = lambda x: np.where(here, x[..., place], 0) if len(known) else np.zeros((*x.shape[:-1], len(ctxs)), x.dtype)  # noqa: E731, B023
            to = at + int(each.sum())
            rows.append((1, bucket, chunk, squeeze(r[at:to]), squeeze(pick(total)), squeeze(pick(by_count).astype(np.uint32).ravel()), squeeze(pick(given).astype(np.float64)), *[0] * len(_NR)))
            at = to
        return _table(rows, _COUNTED)

    return run


def discounts(nr: list[int]) -> np.ndarray:
    """d[r] for counts 0 .. K (d[0] is unused): Good-Turing as Katz has it; where the counts of counts give no value in (0, 1), absolute discounting."""
    d = np.ones(K + 1)
    top = (K + 1) * nr[K] / nr[0] if nr[0] else 1.0
    absolute = nr[0] / (nr[0] + 2 * nr[1]) if nr[0] and nr[1] else 0.5
    for r in range(1, K + 1):
        good = (r + 1) * nr[r] / (r * nr[r - 1]) if nr[r - 1] else 0.0
        x = (good - top) / (1 - top) if top < 1 else 0.0
        d[r] = x if 0 < x < 1 else 1 - absolute / r
    return d


def discounted(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return n * d[np.where(n <= K, n, 0)]


class Unigram:
    """P(word) from its training count; the unknown class has what discounting frees."""

    def __init__(self, total: int, nr: list[int], d: np.ndarray):
        self.total, self.d = total, d
        freed = sum(r * nr[r - 1] * (1 - d[r]) for r in range(1, K + 1))
        # A class of unknown words always has something; all is exact: seen words are scaled by what is left.
        self.unknown = 1.0 if not total else freed / total if freed else 1 / (total + 1)
        self.scale = 1.0 if freed or not total else total / (total + 1)

    def __call__(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, discounted(n, self.d) * self.scale / max(1, self.total), self.unknown)


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORES_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(order: int, facts: Facts, seen: int):
    def run(packed: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for p in packed.to_pylist():
            block = Block(p, told.to_pylist(), facts)
            prob, _ = block.tokens(order)
            docs, held = stretch(p["docs"], np.int64), stretch(p["held"], np.uint8) > 0
            n, total = block.count, facts.uni.total
            base = np.log10((n + 1.0) / (total + seen + 1.0))
            cols = [pa.array(docs, mask=docs == _NO_ID), held, block.sizes, np.add.reduceat((n > 0).astype(np.int64), block.first), np.full(len(docs), total), np.add.reduceat(base, block.first), np.add.reduceat(np.log10(prob), block.first)]
            out.append(pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], schema=_SCORES))
        return pa.concat_tables(out) if out else _table([], _SCORES)

    return run


def _bucketed(df: DataFrame, by: str, parts: int, label: str) -> DataFrame:
    """``df`` in a table bucketed by ``by`` in the shared folder: whatever goes on by that key needs no exchange of it."""
    spark = df.sparkSession
    path = C.new_path(spark, label, table=True)
    df.write.bucketBy(parts, by).option("path", path).saveAsTable(C.table_name(path))
    return spark.table(C.table_name(path))


def score(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs`` (doc_id, text), by n-grams of up to ``order`` words."""
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = _bucketed(C.plain(docs, "doc_id", "text").mapInArrow(_pack(chunk_tokens), _PACKED_SQL), "chunk", parts, "packed")
    ask = packed.select("chunk", "vocab", "trained").mapInArrow(_ask(parts), "ub int, chunk long, keys binary, n binary")
    uni = C.stage(ask.groupBy("ub").applyInArrow(_unigrams, "ub int, keys binary, n binary, words long, seen long, total long, ends long" + _NR_SQL), "unigrams")
    # One row for each bucket: bounded by the number of shuffle partitions.
    base, bases, seen, total, texts, nr = 0, [], 0, 0, 0, [0] * (K + 1)
    for row in sorted(uni.drop("keys", "n").collect(), key=lambda r: r.ub):
        bases.append((row.ub, base))
        base, seen, total, texts = base + row.words, seen + row.seen, total + row.total, texts + row.ends
        nr = [a + row[f"n{r + 1}"] for r, a in enumerate(nr)]
    if base >= int(BEGIN):
        raise ValueError("more distinct words than 32-bit ids")
    facts = Facts(parts, total, texts, Unigram(total, nr, discounts(nr)))
    model = uni.select("ub", "keys", "n").join(F.broadcast(spark.createDataFrame(bases, "ub int, base long")), "ub")
    answered = ask.select("ub", "chunk", "keys").groupBy("ub").cogroup(model.groupBy("ub")).applyInArrow(_resolve, _TOLD_SQL)
    told = _bucketed(answered.groupBy("chunk").applyInArrow(_joined, _TOLD_SQL), "chunk", parts, "resolved")
    for level in range(2, order + 1):
        grams = packed.select("chunk", "held", "sizes", "codes").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_grams(level, facts), _GRAMS_SQL)
        path = C.new_path(spark, f"grams{level}")
        grams.groupBy("bucket").applyInArrow(_counted(level, facts), _COUNTED_SQL).write.partitionBy("kind").parquet(path)
        counted = spark.read.schema(_COUNTED_SQL).parquet(path)
        sums = counted.where("kind = 0").agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)).alias(f"n{r}") for r in range(1, K + 2)]).first()
        facts.d[level] = discounts(list(sums))
        told = told.unionByName(counted.where("kind = 1").select("chunk", F.lit(level).alias("level"), "bucket", "a", "b", "c", "d"))
    return packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scores(order, facts, seen), _SCORES_SQL)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"))
