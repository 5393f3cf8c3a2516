"""Near-duplicate groups by MinHash bands with sequential Bayesian verification.

1. Documents with equal shingle sets (128-bit sums) form one class, which has an id of its own; only the row with its smallest doc_id
   goes on.  Links and components are of classes; a component's id is the smallest doc_id of its classes.
2. Signatures of BANDS x ROWS minima are cut into bands; documents that share a band are candidates.  In a bucket each member
   is compared with the smallest only, so a bucket of n makes n - 1 pairs.  Where its members then still lie in different
   components, each member of a smaller one asks all documents of the larger one: where both are small pair by pair, else in blocks
   of documents that hold signatures and hashed shingles.
3. Candidates, in pairs and in blocks, are compared by batches of minima.  Given m equal ones of n, the posterior of the similarity under
   a uniform prior is Beta(m + 1, n - m + 1); a pair goes when P(similarity >= threshold) falls below MISS.  Within a block what is
   left is compared by hashed shingles, and of those that reach the threshold one for each asker and component goes on.
4. Every link is verified on the full shingle sets, made from the texts.  Links join components by small-star and
   large-star rounds over written tables, until each component is a star.

A pair at the very threshold is missed by all bands with probability (1 - 0.8^5)^32 = 3e-6, and less above it.
Joins on keys that may be common (a centre, a bucket, a component, a set) go by common.join_spread() or join_shared().

Defined cases: null and empty texts have no shingles and no links; texts with fewer words than a shingle have one, their words;
rows are judged by their own text also where they repeat a doc_id; equal texts are one group; an empty table gives an empty
result; rows with a null doc_id get no component and are kept; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BANDS, ROWS = 32, 5
#: A batch of minima, and the probability with which a pair at or above the threshold may be dropped on one.
BATCH, MISS = 32, 1e-6
#: Components of more documents than this are asked in blocks of about BLOCK documents; what is linked is the same.
SMALL, BLOCK = 32, 512

_SEEDS = C.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).astype(np.uint32)


def window_names(codes: np.ndarray, n_names: int, k: int) -> tuple[np.ndarray, int]:
    """For each place a number that names the window of ``k`` codes that begins there, and how many numbers there are.  Names are exact: halves are named first."""
    if k == 1:
        return codes, n_names
    half = 1 << ((k - 1).bit_length() - 1)
    (left, _), (right, n_right) = window_names(codes, n_names, half), window_names(codes, n_names, k - half)
    names, distinct = pd.factorize(left * n_right + right[np.minimum(np.arange(len(codes)) + half, len(codes) - 1)])
    return names, len(distinct)


def shingles(flat: pa.Array, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct k-word shingles, and where each text's begin.  Distinctness is decided on the words, not on hashes."""
    codes, names = C.coded(flat)
    words = C.hash_strings(names)
    sizes = np.diff(offs)
    n = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    at = C.gather(offs[:-1], n)
    own = np.repeat(np.arange(len(n)), n)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    name, n_windows = window_names(codes, max(1, len(names)), k)
    # A text with fewer words than a shingle has one shingle only.
    first = ~pd.Series(own * n_windows + name[at]).duplicated().to_numpy()
    at, own = at[first], own[first]
    length = np.minimum(sizes, k)[own]
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            c = codes[np.minimum(at + j, len(codes) - 1)]
            h = np.where(j < length, C.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[c] + np.uint64(j + 1)), h)
    return h, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(n)))]).astype(np.int64)


def signatures(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Minima of each text with shingles, one row each."""
    starts = offs[:-1][np.diff(offs) > 0]
    out = np.empty((len(starts), len(_SEEDS)), np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    with np.errstate(over="ignore"):
        for i, seed in enumerate(_SEEDS):
            y = (x ^ seed) * np.uint32(0x9E3779B1)
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x85EBCA77)
            y ^= y >> np.uint32(13)
            out[:, i] = np.minimum.reduceat(y, starts) if len(starts) else 0
    return out


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole):
                flat, offs = C.split_words(pc.ascii_lower(C.texts_of(b)))
                h, at = shingles(flat, offs, k)
                n = np.diff(at)
                some = n > 0
                sig = signatures(h, at)
                bands = np.zeros((len(sig), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = C.mix(bands + sig.reshape(len(sig), BANDS, ROWS)[:, :, r] + np.uint64(r + 1))
                with np.errstate(over="ignore"):
                    sums = [np.add.reduceat(C.mix(h + np.uint64(s)), at[:-1][some]).astype(np.int64) if some.any() else np.empty(0, np.int64) for s in (11, 23)]
                row = np.cumsum(some) - 1
                take = lambda a: pa.array(a).take(pa.array(row, mask=~some))
                sig_col = pa.FixedSizeBinaryArray.from_buffers(pa.binary(sig.shape[1] * 4), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
                band_col = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * BANDS, pa.int32()), pa.array(bands.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n), take(sums[0]), take(sums[1]), sig_col.take(pa.array(row, mask=~some)), band_col.take(pa.array(row, mask=~some))], names=["doc_id", "text_key", "n_shingles", "f1", "f2", "sig", "bands"])

    return run


@lru_cache
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For each number of batches compared: the fewest equal minima with P(similarity >= threshold) >= miss."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _prune(threshold: float):
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            live, m = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for i, need in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                m[live] += (x[live, part] == y[live, part]).sum(1)
                live = live[m[live] >= need]
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(live)) for c in ("a", "b")], names=["a", "b"])

    return run


def shingle_set(text: str, k: int) -> frozenset:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() folds A-Z only, split() cuts at ASCII white space
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(k)), strict=False))


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, frozenset()
        for b in batches:
            keep = []
            for i, (s, t) in enumerate(zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True)):
                if t != last:
                    last, of_last = t, shingle_set(t or "", k)
                mine = shingle_set(s or "", k)
                both = len(mine & of_last)
                keep.append(bool(both) and 100 * both >= percent * (len(mine) + len(of_last) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return run


def _hashes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole):
                h, at = shingles(*C.split_words(pc.ascii_lower(C.texts_of(b))), k)
                raw = [np.sort(h[s:e]).tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sig"), pa.array(raw, pa.binary())], names=["id", "sig", "hashes"])

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of undirected links (a, b), by small-star and large-star rounds."""
    edges = C.stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # Done when no node has two edges down, or one down and one up: then each component is a star around its smallest node.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
        left, total = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).agg(F.count_if((F.col("down") > 1) | (F.col("down") == 1) & (F.col("up") == 1)), F.coalesce(F.sum("down"), F.lit(0))).first()
        if not left:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = edges.union(edges.select("v", "u"))
        low = C.stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree"), "low")
        large = C.join_spread(both, low.drop("degree"), ["u"], "v", hot=C.hot_keys(low, ["u"], 2 * total, "degree")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        edges = C.stage(small.distinct(), "edges")


def _labelled(df: DataFrame, labels: DataFrame, column: str, name: str, by: str, hot: list[tuple]) -> DataFrame:
    """``df`` with the label of ``column``: itself, if it has none."""
    out = C.join_spread(df, labels.select(F.col("node").alias(column), F.col("label").alias("_label")), [column], by, "left", hot)
    return out.withColumn(name, F.coalesce("_label", column)).drop("_label")


def _ask_blocks(asks: DataFrame, group: DataFrame, sketches: DataFrame, percent: int, hot: list[tuple]) -> DataFrame:
    """Candidate links (a, b) between askers (x, own, part, size) and members (part, y, own) of groups; ``sketches`` (id, sig, hashes) says what they hold, ``hot`` are the groups to spread.

    ``own`` is the component a document is in already: of each block an asker gets one link for each other component at most.
    Askers and members of a group are cut into blocks of about BLOCK each; a task compares one block with another in arrays, so
    a large group makes neither a row for each pair nor a task that grows with it.
    """
    by = C.stage(asks.groupBy("part", "size").agg(F.count("*").alias("n")).select("part", F.ceil(F.col("size") / BLOCK).cast("int").alias("ny"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nx")), "cells")
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = C.join_spread(asks, by, ["part"], "x", hot=hot).select(F.col("x").alias("id"), "own", "part", cell("x", "nx").alias("xb"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("yb"))
    right = C.join_spread(group, by, ["part"], "y", hot=hot).select(F.col("y").alias("id"), "own", "part", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("xb"), cell("y", "ny").alias("yb"))
    cols = ("part", "xb", "yb", "id", "own", "sig", "hashes")
    left, right = (t.join(sketches, "id").select(*cols).toDF(*[f"{side}_{c}" for c in cols]) for side, t in (("x", left), ("y", right)))
    least = least_matches(percent / 100)

    def compare(xs: pa.Table, ys: pa.Table) -> pa.Table:
        found: tuple[list, list] = ([], [])
        if xs.num_rows and ys.num_rows:
            xsig, ysig = (np.frombuffer(b"".join(t.to_pylist()), np.uint32).reshape(len(t), -1) for t in (xs["x_sig"], ys["y_sig"]))
            xset, yset = ([np.frombuffer(h, np.uint64) for h in t.to_pylist()] for t in (xs["x_hashes"], ys["y_hashes"]))
            y_id, y_own = ys["y_id"].to_pylist(), ys["y_own"].to_numpy()
            for x, own, sig, mine in zip(xs["x_id"].to_pylist(), xs["x_own"].to_pylist(), xsig, xset, strict=True):
                live = np.flatnonzero(y_own != own)
                same = np.zeros(len(y_own), np.int64)
                for i, need in enumerate(least):
                    batch = slice(i * BATCH, (i + 1) * BATCH)
                    same[live] += (ysig[live, batch] == sig[batch]).sum(1)
                    live = live[same[live] >= need]
                seen = set()
                for j in live[np.argsort(-same[live], kind="stable")].tolist():
                    if y_own[j] in seen:
                        continue
                    theirs = yset[j]
                    both = int((mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs).sum())
                    if both and 100 * both >= percent * (len(mine) + len(theirs) - both):
                        seen.add(y_own[j])
                        found[0].append(max(x, y_id[j])), found[1].append(min(x, y_id[j]))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    left, right = (t.groupBy(*[f"{side}_{c}" for c in ("part", "xb", "yb")]) for side, t in (("x", left), ("y", right)))
    return left.cogroup(right).applyInArrow(compare, "a long, b long")


def text_key(text: Column) -> Column:
    """What tells the rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    return judge(docs, k, percent).drop("text_key")


def judge(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The same with the text_key of each row."""
    docs = C.plain(docs, "doc_id", "text").withColumn("text_key", text_key(F.col("text")))
    rows = C.stage(docs.mapInArrow(_sketch(k), "doc_id long, text_key long, n_shingles long, f1 long, f2 long, sig binary, bands array<long>"), "sketch")
    sets = rows.where("doc_id is not null and f1 is not null")
    same = ["f1", "f2", "n_shingles"]
    # The row with the smallest doc_id stands for its class and brings its signature along, so no join has to find it again.
    rep = F.min(F.struct("doc_id", "text_key", "sig", "bands")).alias("rep")
    classes = sets.groupBy(*same).agg(rep, F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("id"), *same, "copies", "rep.*")
    classes = C.stage(classes, "classes")
    buckets = classes.select("id", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "h"))
    # Buckets of one document, nearly all, end here.
    shared = C.stage(buckets.groupBy("band", "h").agg(F.min("id").alias("centre"), F.count("*").alias("members")).where("members > 1"), "shared")
    members = C.stage(C.join_shared(buckets, shared, ["band", "h"], "members", BANDS * classes.count()).select("band", "h", "id", "n", "centre"), "members")

    # Whatever is compared from here on shares a bucket: signatures and texts of these classes are set apart once.  Texts are asked for by
    # doc_id and text, which few rows share, not by set; of rows that repeat one, one goes on.
    held = classes.select("id", "doc_id", "text_key", "sig").join(members.select("id").distinct(), "id")
    held = C.stage(docs.join(held, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key", "id"]).select("id", "sig", "text"), "held")

    def both_sides(pairs: DataFrame, what: DataFrame, column: str, hot_a: list[tuple], hot_b: list[tuple]) -> DataFrame:
        """``pairs`` (a, b) with ``column`` of either side; a document in very many pairs is spread."""
        left = C.join_spread(pairs, what.toDF("a", f"{column}_a"), ["a"], "b", hot=hot_a)
        return C.join_spread(left, what.toDF("b", f"{column}_b"), ["b"], "a", hot=hot_b).select("a", "b", f"{column}_a", f"{column}_b")

    def verified(pairs: DataFrame, hot_a: list[tuple], hot_b: list[tuple]) -> DataFrame:
        """Of ``pairs`` those that are links, by their full sets."""
        return C.stage(both_sides(pairs, held.select("id", "text"), "text", hot_a, hot_b).mapInArrow(_verify(k, percent), "a long, b long"), "links")

    def confirmed(pairs: DataFrame, hot_a: list[tuple] | None = None, hot_b: list[tuple] | None = None) -> DataFrame:
        if hot_a is None or hot_b is None:
            pairs = C.stage(pairs, "pairs")
            total = pairs.count()
            hot_a, hot_b = (C.hot_keys(pairs, [c], total) if hot is None else hot for c, hot in (("a", hot_a), ("b", hot_b)))
        near = both_sides(pairs, held.select("id", "sig"), "sig", hot_a, hot_b).mapInArrow(_prune(percent / 100), "a long, b long")
        return verified(near, hot_a, hot_b)

    star = C.stage(members.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct(), "star")
    # A document has BANDS centres at most; a centre may have very many documents.
    centres = C.hot_keys(star, ["b"])
    links = confirmed(star, [], C.hot_keys(star, ["b"]))
    labels = components(links)
    # What may still be missed joins two components that share a bucket: each member of the smaller one asks the whole larger one.
    buckets = C.hot_keys(shared, ["band", "h"], members="members")
    parts = C.stage(_labelled(members.select("band", "h", "id", "n"), labels, "id", "part", "h", []), "parts")
    apart = parts.groupBy("band", "h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("band", "h")
    parts = C.stage(C.join_spread(parts, apart, ["band", "h"], "id", "left_semi", buckets), "parts")
    if not parts.isEmpty():
        # Components known so far are stars already, so only these and what joins them go through the rounds again.
        labels = components(labels.toDF("a", "b").union(_missed(parts, labels, held, buckets, confirmed, verified, k, percent)))

    group = labels.union(labels.select("label", "label").distinct()).join(classes.select(F.col("id").alias("node"), F.col("doc_id").alias("rep")), "node")
    group = C.stage(group.select("label", "node", "rep"), "group")
    least = C.stage(group.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")), "least")
    least = C.join_shared(group, least, ["label"], "size", group.count()).select(F.col("node").alias("id"), "component_id")
    labelled = C.stage(classes.join(least, "id", "left").select(*same, "copies", F.coalesce("component_id", "doc_id").alias("component_id")), "labelled")
    cols = ["doc_id", "text_key", "n_shingles", "component_id"]
    out = C.join_shared(sets.select("doc_id", "text_key", *same), labelled, same, "copies", sets.count()).select(*cols)
    alone = rows.where("doc_id is null or f1 is null").withColumn("component_id", F.col("doc_id")).select(*cols)
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _missed(parts: DataFrame, labels: DataFrame, held: DataFrame, buckets: list[tuple], confirmed, verified, k: int, percent: int) -> DataFrame:
    """Links between components that share a bucket: ``parts`` (band, h, id, n, part) are the members of buckets with several components, ``buckets`` the hot ones."""
    sizes = C.stage(labels.groupBy(F.col("label").alias("part")).agg((F.count("*") + 1).alias("size")), "sizes")
    # A component's rows are BANDS times its documents at most.
    large = C.hot_keys(sizes, ["part"], members="size")
    parts = C.stage(C.join_spread(parts, sizes, ["part"], "id", "left", large).withColumn("size", F.coalesce("size", F.lit(1))), "parts")
    heads = C.stage(parts.groupBy("band", "h", "part", "size").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi")), "heads")
    crowded = C.stage(heads.groupBy("band", "h").agg(F.count("*").alias("c")).where(F.col("c") > SMALL).select("band", "h", F.lit(True).alias("crowded")), "crowded")
    asked = C.join_spread(heads, crowded, ["band", "h"], "part", "left", buckets).where(F.col("crowded").isNull() | (F.col("size") > SMALL))
    # No two sets reach the threshold whose sizes are further apart than it.
    asked = asked.select("band", "h", F.col("part").alias("q_part"), F.col("size").alias("q_size"), "n_lo", "n_hi")
    asks = C.join_spread(parts, asked, ["band", "h"], "id", hot=buckets).where((F.struct("size", "part") < F.struct("q_size", "q_part")) & (100 * F.col("n") >= percent * F.col("n_lo")) & (100 * F.col("n_hi") >= percent * F.col("n")))
    asks = C.stage(asks.select(F.col("id").alias("x"), F.col("part").alias("own"), F.col("q_part").alias("part"), F.col("q_size").alias("size")).distinct(), "asks")
    wanted = C.hot_keys(asks, ["part"])
    whole = labels.select(F.col("label").alias("part"), F.col("node").alias("y")).union(labels.select("label", "label").distinct())
    few = asks.where(F.col("size") <= SMALL)
    pairs = few.where("size = 1").select("x", F.col("part").alias("y")).union(C.join_spread(few.where("size > 1"), whole, ["part"], "x", hot=wanted).select("x", "y"))
    links = confirmed(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    many = asks.where(F.col("size") > SMALL)
    blocks = [(many, whole.join(many.select("part").distinct(), "part", "left_semi").select("part", "y", F.col("part").alias("own")), sorted({*wanted, *large}))]
    # In a bucket with many components the small ones are compared in blocks too, as one group.
    if not crowded.isEmpty():
        crowd = C.stage(C.join_spread(parts.where(F.col("size") <= SMALL), crowded, ["band", "h"], "id", "left_semi", buckets).select(F.col("id").alias("x"), F.col("part").alias("own"), F.xxhash64("band", "h").alias("part")), "crowd")
        counts = C.stage(crowd.groupBy("part").agg(F.count("*").alias("size")), "counts")
        crowds = C.hot_keys(counts, ["part"], members="size")
        crowd = C.stage(C.join_spread(crowd, counts, ["part"], "x", hot=crowds).select("x", "own", "part", "size"), "crowd")
        blocks.append((crowd, crowd.select("part", F.col("x").alias("y"), "own"), crowds))
    for ask, group, hot in blocks:
        if not ask.isEmpty():
            hot = list({key: (key, n) for key, n in sorted(hot)}.values())  # the most tasks that either side asks for
            ids = ask.select(F.col("x").alias("id")).union(group.select("y")).distinct()
            sketches = C.stage(held.join(ids, "id").mapInArrow(_hashes(k), "id long, sig binary, hashes binary"), "sketches")
            found = C.stage(_ask_blocks(ask, group, sketches, percent, hot).distinct(), "found")
            total = found.count()
            links = links.union(verified(found, C.hot_keys(found, ["a"], total), C.hot_keys(found, ["b"], total)))
    return links


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), k=2)
