"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad.  Its features are figures of the line and of the lines before and after it, each as steps over
quantiles of the training lines; transitions between neighbouring labels are learned with them.  A document's score is the mean
marginal probability of "good" over its lines, by forward-backward, weighted by the lines' lengths.

Only documents have labels, so those of the lines are latent.  Training begins with every line under its document's label and looks at
lines by themselves, without neighbours or transitions, so lines that look alike are judged alike; then it goes on
by expectation and maximisation of the whole chain: in the expectation each document's chain is tilted by as little as it takes that the share of good
lines (by length) agrees with its label (SHARES), so a bad document may hold good lines and a good one some bad; the maximisation fits
lines and transitions to these expectations.

Forward and backward messages are products of 2 x 2 matrices, taken for all lines of all texts at once by doubling spans: neither
texts are padded nor is there a loop over lines, so a text of 100,000 lines costs 17 passes over its own lines.

Training: documents with a label whose crc32(doc_id) mod 4 is not 2, in order of a hash of the id, as whole sequences: TRAIN_DOCS
documents and TRAIN_LINES lines at most (a document that does not fit into what is left of these is passed over).  Scoring uses whole texts.

Defined cases: null and empty texts have one empty line and get its score; several labels of one document count by the largest; without
labels of both kinds all scores are the share of good ones (0.5 without any); repeated rows are scored each and learned from once; an
empty table gives an empty result; rows without a doc_id are scored, not learned from and not held out; labels, lang, source and doc_id are no inputs;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Documents and lines to learn from, at most.
TRAIN_DOCS, TRAIN_LINES = 4000, 400_000
#: Steps of the first fit; rounds of expectation and maximisation, and steps in each.
ROUNDS, EM_ROUNDS, EM_STEPS = 80, 4, 30
#: The share of good lines (by length) of a bad document is at most the first of these, of a good one at least the second.
SHARES = (0.5, 0.8)
QUANTILES = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
GOOD_FROM = 0.7


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LUTS = {
    "symbol": _lut(b"#*$%&<>@^~=+_\\/{}[]"),
    "bar": _lut(b"|"),
    "upper": _lut(bytes(range(65, 91))),
    "digit": _lut(b"0123456789"),
    "stop": _lut(b".,;:?"),
    "shout": _lut(b"!"),
    "wide": np.arange(256) >= 128,
}


def line_features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Figures of each line (lines x figures), the lines' lengths, and where each text's lines begin."""
    lines, offs = C.split_lines(arr)
    n = len(lines)
    raw = pa.concat_arrays([lines])
    at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    size = np.diff(at)
    words, woffs = C.split_words(raw)
    count = np.diff(woffs)
    wlen = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, names = C.coded(words)
    own = C.owner(woffs)
    distinct = np.bincount(np.unique(own * max(1, len(names)) + codes) // max(1, len(names)), minlength=n)[:n] if len(codes) else np.zeros(n)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (own[1:] == own[:-1])
    lcodes, lnames = C.coded(raw)
    lown = C.owner(offs)
    key = lown * max(1, len(lnames)) + lcodes
    again = np.ones(n, bool)
    again[np.unique(key, return_index=True)[1]] = False
    longest = np.zeros(n)
    if len(wlen):
        longest[count > 0] = np.maximum.reduceat(wlen, woffs[:-1][count > 0])
    per = lambda x, d: x / np.maximum(1, d)
    last = np.zeros(n, np.uint8)
    last[size > 0] = buf[at[1:][size > 0] - 1]
    cols = [np.log1p(size), np.log1p(count), per(C.segment_sum(wlen, woffs), count), np.log1p(longest), per(distinct, count), per(C.segment_sum(same, woffs), count), per(C.segment_sum(wlen <= 3, woffs), count), again & (size > 0), np.isin(last, list(b".!?"))]
    cols += [per(C.segment_sum(lut[buf], at), size) for lut in _LUTS.values()]
    return np.stack([np.asarray(c, np.float32) for c in cols], 1), size, offs


def _first(offs: np.ndarray) -> np.ndarray:
    """For each line, its place in its text."""
    return np.arange(offs[-1]) - np.repeat(offs[:-1], np.diff(offs))


def _products(m: np.ndarray, place: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line, the product of the matrices ``m`` (2, 2, lines) of its text up to it (sign 1) or from it on (sign -1), scaled; and the log of the scale.

    In pass k spans of 2^k lines are joined to spans twice as long, until they reach the text's beginning (or end).
    """
    top = m.max((0, 1))
    m, scale = m / top, np.log(top)
    step, longest = 1, int(place.max()) if len(place) else 0
    live = np.flatnonzero(place >= 1)
    while step <= longest:
        near, far = m[:, :, live], m[:, :, live - sign * step]
        left, right = (far, near) if sign > 0 else (near, far)
        out = left[:, 0, None] * right[None, 0] + left[:, 1, None] * right[None, 1]
        top = out.max((0, 1))
        scale[live] += scale[live - sign * step] + np.log(top)
        m[:, :, live] = out / top
        step *= 2
        live = live[place[live] >= step]
    return m, scale


class Crf:
    """Two labels; ``weights`` (3, steps) are the log odds of "good" that a step of the line, the one before and the one after it adds, ``trans`` is what each pair of neighbouring labels adds."""

    def __init__(self, steps: list[np.ndarray], weights: np.ndarray, bias: float, trans: np.ndarray):
        self.steps, self.weights, self.bias, self.trans = steps, weights, bias, trans

    def codes(self, feats: np.ndarray) -> np.ndarray:
        """For each line and figure, how many of the figure's steps lie below it."""
        return np.stack([np.searchsorted(s, feats[:, j]).astype(np.uint8) for j, s in enumerate(self.steps)]).T if len(self.steps) else np.zeros((len(feats), 0), np.uint8)

    def odds(self, codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
        own, before, after = (np.full(len(codes), x) for x in (self.bias, 0.0, 0.0))
        at = 0
        for j, s in enumerate(self.steps):
            for k, out in enumerate((own, before, after)):
                out += np.concatenate([[0.0], np.cumsum(self.weights[k, at : at + len(s)])])[codes[:, j]]
            at += len(s)
        place = _first(offs)
        inner = np.flatnonzero(place > 0)
        own[inner] += before[inner - 1]
        own[inner - 1] += after[inner]
        return own

    def gradient(self, rest: np.ndarray, codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Sums of ``rest`` over the lines that each weight speaks for, then over all lines."""
        inner = np.flatnonzero(_first(offs) > 0)
        before, after = np.zeros_like(rest), np.zeros_like(rest)
        before[inner - 1] = rest[inner]
        after[inner] = rest[inner - 1]
        out = [[np.bincount(codes[:, j], r, len(s) + 1)[::-1].cumsum()[-2::-1] for j, s in enumerate(self.steps)] for r in (rest, before, after)]
        return np.concatenate([x for row in out for x in row] + [[rest.sum()]])

    def marginals(self, odds: np.ndarray, offs: np.ndarray, pairs: bool = False):
        """P(good) of each line; with ``pairs`` also the log partition sums and the summed marginals of neighbouring labels."""
        n, sizes = len(odds), np.diff(offs)
        if not n:
            return (np.zeros(0), 0.0, np.zeros((2, 2))) if pairs else np.zeros(0)
        place = _first(offs)
        left = np.repeat(sizes, sizes) - 1 - place
        e = np.exp(np.clip(odds, -60, 60))
        trans = np.exp(np.clip(self.trans, -30, 30))
        m = np.empty((2, 2, n))
        m[:, 0], m[:, 1] = trans[:, 0, None], trans[:, 1, None] * e
        starts = place == 0
        m[:, 0, starts], m[:, 1, starts] = 1.0, e[starts]
        nxt = np.ones((2, 2, n))
        inner = np.flatnonzero(~starts)
        nxt[:, :, inner - 1] = m[:, :, inner]
        ahead, scale = _products(m.copy(), place, 1)
        back, _ = _products(nxt, left, -1)
        a, b = ahead[0], back.sum(1)
        p = a * b
        p = p[1] / p.sum(0)
        if not pairs:
            return p
        two = a[:, None, inner - 1] * m[:, :, inner] * b[None, :, inner]
        ends = offs[1:][sizes > 0] - 1
        return p, float((scale[ends] + np.log(a[:, ends].sum(0))).sum()), (two / two.sum((0, 1))).sum(2)

    def lines(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, the lines' lengths, and where each text's lines begin."""
        feats, size, offs = line_features(arr)
        return self.marginals(self.odds(self.codes(feats), offs), offs), size, offs

    def scores(self, arr: pa.Array) -> np.ndarray:
        p, size, offs = self.lines(arr)
        weight = np.maximum(1, size)
        return np.clip(C.segment_sum(p * weight, offs) / np.maximum(1, C.segment_sum(weight, offs)), 0.0, 1.0)


def tilted(crf: Crf, odds: np.ndarray, offs: np.ndarray, weight: np.ndarray, good: np.ndarray) -> np.ndarray:
    """``odds`` with as little added, in proportion to each line's weight, as it takes that each text's share of good lines agrees with its label."""
    sizes, total = np.diff(offs), np.maximum(1e-9, C.segment_sum(weight, offs))
    pull = weight / np.repeat(np.maximum.reduceat(weight, offs[:-1]), sizes)  # every text has a line
    share = lambda tilt: C.segment_sum(crf.marginals(odds + np.repeat(tilt, sizes) * pull, offs) * weight, offs) / total
    now = share(np.zeros(len(good)))
    wrong = np.where(good, now < SHARES[1], now > SHARES[0])
    lo, hi = np.zeros(len(good)), np.where(wrong, 60.0, 0.0)
    side = np.where(good, 1.0, -1.0)
    for _ in range(9):
        mid = (lo + hi) / 2
        got = share(side * mid)
        enough = np.where(good, got >= SHARES[1], got <= SHARES[0])
        lo, hi = np.where(enough, lo, mid), np.where(enough, mid, hi)
    return odds + np.repeat(side * hi, sizes) * pull


def fit(feats: np.ndarray, offs: np.ndarray, good: np.ndarray, size: np.ndarray | None = None, decay: float = 1e-3) -> Crf:
    """Maximum penalised likelihood by Adam with fixed steps; the result depends on the rows only, not on chance."""
    steps = [np.unique(np.quantile(feats[:, j], QUANTILES)).astype(np.float32) if len(feats) else np.zeros(1, np.float32) for j in range(feats.shape[1])]
    n_steps = sum(map(len, steps))
    crf = Crf(steps, np.zeros((3, n_steps)), 0.0, np.zeros((2, 2)))
    if not len(good) or good.all() or not good.any():
        share = np.clip(good.mean(), 0.01, 0.99) if len(good) else 0.5
        crf.bias = float(np.log(share / (1 - share)))
        return crf
    sizes, n = np.diff(offs), len(good)
    codes = crf.codes(feats)
    # Line features begin with the logarithm of the length.
    weight = np.maximum(1.0, np.expm1(feats[:, 0].astype(float)) if size is None else size)
    want = np.repeat(good, sizes).astype(float)
    want_pairs = np.diag([(sizes - 1)[~good].sum(), (sizes - 1)[good].sum()]).astype(float)
    m, v, i = np.zeros(3 * n_steps + 5), np.zeros(3 * n_steps + 5), 0
    for em in range(EM_ROUNDS + 1):
        if em:
            want, _, want_pairs = crf.marginals(tilted(crf, crf.odds(codes, offs), offs, weight, good), offs, True)
        for _ in range(EM_STEPS if em else ROUNDS):
            i += 1
            p, _, pairs = crf.marginals(crf.odds(codes, offs), offs, True)
            theta = np.concatenate([crf.weights.ravel(), [crf.bias], crf.trans.ravel()])
            grad = np.concatenate([crf.gradient(want - p, codes, offs), (want_pairs - pairs).ravel()]) / n - decay * theta
            if not em:  # lines by themselves: their own steps and the constant
                grad[n_steps : 3 * n_steps] = grad[-4:] = 0.0
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            crf.weights, crf.bias, crf.trans = theta[:-5].reshape(3, n_steps), float(theta[-5]), theta[-4:].reshape(2, 2)
    return crf


def _held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> Crf:
    """From at most TRAIN_DOCS labelled documents with TRAIN_LINES lines; only their lines' figures reach the driver."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = [(r.doc_id, r.quality) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS).collect()]
    chosen = F.broadcast(spark.createDataFrame(sample, "doc_id long, quality int"))  # TRAIN_DOCS rows at most

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole):
                feats, _, offs = line_features(C.texts_of(b))
                raw = [feats[s:e].tobytes() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(np.diff(offs)), pa.array(raw, pa.binary())], names=["doc_id", "quality", "n_lines", "feats"])

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "quality").mapInArrow(figures, "doc_id long, quality int, n_lines long, feats binary")
    rows = C.stage(rows.withColumn("key", F.xxhash64("feats")), "figures")
    # Sizes are asked before any figures are fetched: rows may repeat a doc_id, and texts may be long.
    left, picked = TRAIN_LINES, []
    for r in rows.select("doc_id", "key", "n_lines").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(TRAIN_DOCS).collect():
        if r.n_lines <= left:
            left -= r.n_lines
            picked.append((r.doc_id, r.key))
    fetched = rows.join(F.broadcast(spark.createDataFrame(picked, "doc_id long, key long")), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).collect()
    width = 9 + len(_LUTS)
    fetched.sort(key=lambda r: (r.doc_id, r.key))
    offs = np.concatenate([[0], np.cumsum([r.n_lines for r in fetched])]).astype(np.int64)
    feats = np.frombuffer(b"".join(r.feats for r in fetched), np.float32).reshape(-1, width)
    return fit(feats, offs, np.array([r.quality > 0 for r in fetched], bool))


def line_labels(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, line (from 0), n_bytes, p_good, good of each line of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole):
                p, size, offs = crf.lines(C.texts_of(b))
                own = C.owner(offs)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(own)), pa.array(_first(offs)), pa.array(size), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "line", "n_bytes", "p_good", "good"])

    return C.plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, line long, n_bytes long, p_good double, good boolean")


def score(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(crf.scores(C.texts_of(b)), pa.float64())], names=["doc_id", "score"])

    out = C.plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score(docs, train(docs, C.table(spark, sf_dir, "labels")))
