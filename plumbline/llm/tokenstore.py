"""Token ids in a content-addressed store.

Ids are cut into chunks where a rolling hash over the last ``WINDOW`` ids has ``MASK_BITS`` zero bits (never before
``MIN_IDS``, always at ``MAX_IDS``), so equal passages give equal chunks whatever stands before them.  The store holds

* ``chunks``: each distinct chunk once, under the BLAKE2 digest of its ids;
* ``recipes``: per document, in ascending doc_id order, its start in the stream of all ids and the digests to join;
* ``manifest``: a Merkle tree over the recipes: leaves of documents (doc_id, start, length, chunks) in blocks, blocks in segments,
  segments in the root of the whole store, each with its counts.

Reading recomputes the tree from the recipes and holds every node against the manifest: a recipe that is lost, altered, swapped or moved
fails the read, as does a damaged or missing chunk.  Who keeps the root that write_store() returns can have the manifest checked too.

Defined cases: a null text is empty and has only the end id; an empty table gives an empty store; rows that repeat a doc_id
are documents of their own, in the order of their digests; rows without a doc_id come first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common as C

WINDOW, MASK_BITS, MIN_IDS, MAX_IDS = 16, 9, 128, 4096
#: Documents under one leaf block of the manifest; segments are as many as the shuffle has partitions.
BLOCK = 1024
#: Words whose ids a worker remembers, at most, but for those of one slice.
REMEMBERED = 250_000
_CRC_POLY = 0xEDB88320


class WordEncoder:
    """Ids of texts by a tokenizer that never joins across ASCII white space, so each distinct word is encoded once.

    Runs of plain letters, and the marks right after them, are pieces of their own that no normalisation but lower case
    changes; these go to the library's model without its slower normaliser, all other words through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit = remembered
        spec = json.loads(self.tok.to_str())
        self.lowers = spec["normalizer"] == _NORMALIZER  # then folding A-Z before changes nothing
        suffix = self.tok.model.end_of_word_suffix if isinstance(self.tok.model, BPE) else None
        # Only with exactly these parts is a run of letters known to be a piece of its own.
        self.plain = bool(self.lowers and suffix and spec["pre_tokenizer"] == _PRE_TOKENIZER)
        self.pieces = Tokenizer(self.tok.model)
        self.pieces.pre_tokenizer = WhitespaceSplit()
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.known, self.ids, self.offs = pa.array([], pa.string()), np.empty(0, self.dtype), np.zeros(1, np.int64)

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], self.dtype), np.concatenate([[0], np.cumsum([len(ids) for ids in got])]).astype(np.int64)

    def _letters(self, cores: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """With white space between them each run is a piece, and only its last id ends a word."""
        text = " ".join(cores.to_pylist()).lower().translate(_BYTE_LEVEL)
        ids = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        return ids, np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, and where they begin."""
        easy = pc.match_substring_regex(words, f"^{_LETTERS}+{_MARKS}*$").to_numpy(zero_copy_only=False) if self.plain else np.zeros(len(words), bool)
        parts = []  # (which words, (ids, offs), which entry of it each word has), in the order in which they follow in a word
        if easy.any():
            w = words.filter(pa.array(easy))
            for piece, encode in ((pc.replace_substring_regex(w, f"{_MARKS}*$", ""), self._letters), (pc.replace_substring_regex(w, f"^{_LETTERS}+", ""), self._whole)):
                code, names = C.coded(piece)
                parts.append((np.flatnonzero(easy), encode(names), code))
        if not easy.all():
            odd = np.flatnonzero(~easy)
            parts.append((odd, self._whole(words.filter(pa.array(~easy))), np.arange(len(odd))))
        size = np.zeros(len(words), np.int64)
        for which, (_, offs), code in parts:
            size[which] += np.diff(offs)[code]
        starts = np.concatenate([[0], np.cumsum(size)])
        out, at = np.empty(starts[-1], self.dtype), starts[:-1].copy()
        for which, (ids, offs), code in parts:
            lens = np.diff(offs)[code]
            out[C.gather(at[which], lens)] = ids[C.gather(offs[code], lens)]
            at[which] += lens
        return out, starts

    def encode(self, arr: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's ids begin."""
        flat, offs = C.split_words(pc.ascii_lower(arr) if self.lowers else arr)
        codes, words = C.coded(flat)
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        fresh = words.filter(pa.array(new))
        ids, fresh_offs = self._new(fresh) if len(fresh) else (np.empty(0, self.dtype), np.zeros(1, np.int64))
        at[new] = len(self.known) + np.arange(len(fresh))
        self.known, self.offs = pa.concat_arrays([self.known, fresh]), np.concatenate([self.offs, self.offs[-1] + fresh_offs[1:]])
        self.ids = np.concatenate([self.ids, ids])
        starts, lens = self.offs[at], np.diff(self.offs)[at]
        table = self.ids
        if end_id is not None:
            codes, offs = np.insert(codes, offs[1:], len(starts)), offs + np.arange(len(offs))
            starts, lens, table = np.append(starts, len(table)), np.append(lens, 1), np.append(table, self.dtype.type(end_id))
        each = lens[codes]
        out = table[C.gather(starts[codes], each)], np.concatenate([[0], np.cumsum(each)])[offs]
        if len(self.known) > self.limit:  # go on with the words of this slice only
            self.known, size = words, lens[: len(words)]
            self.ids, self.offs = table[C.gather(starts[: len(words)], size)], np.concatenate([[0], np.cumsum(size)])
        return out


#: The parts, as a tokenizer's file spells them, for which runs of plain letters go to the model without the normaliser (fixed values).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_LETTERS = "[a-zß-öø-ÿÀ-ÖØ-Þ]"
_MARKS = r"[!-&(-/:-@\[-`{-~]"
#: Byte-level spelling: a byte that prints stands for itself, the others for the code points from 256 on, in their order.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELT = {b: chr(b) for b in _PRINTS} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTS}))}
_BYTE_LEVEL = {c: "".join(_SPELT[b] for b in chr(c).encode()) for c in (*range(0x61, 0x7B), *range(0xDF, 0x100))}
_GEAR = C.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each id, a hash of the WINDOW ids that end there (fewer at the beginning)."""
    h, k = _GEAR[ids] if ids.dtype == np.dtype("<u2") else C.mix((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), 1
    while k < WINDOW:
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint64(k)
        h, k = nxt, 2 * k
    return h


def cuts(ids: np.ndarray, offs: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, as indices into ``ids``."""
    marks = (np.flatnonzero(rolling(ids) >> np.uint64(64 - MASK_BITS) == 0) + 1).tolist() if len(ids) else []
    out = []
    for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        ends = []
        while s < e:
            i = bisect_left(marks, s + MIN_IDS)
            s = min(marks[i] if i < len(marks) else e, s + MAX_IDS, e)
            ends.append(s)
        out.append(ends)
    return out


_CHUNKS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("pos", pa.int32()), ("off", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("payload", pa.binary())])


def _chunker(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rid = WordEncoder(path), TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in C.slices(whole, limit=3 * C.SLICE_BYTES):
                ids, offs = enc.encode(C.texts_of(b), end_id)
                ends = cuts(ids, offs)
                each = np.array([len(x) for x in ends], np.int64)
                to = np.array([i for x in ends for i in x], np.int64)
                at = np.concatenate([offs[:1], to[:-1]])
                doc = np.repeat(np.arange(len(each)), each)
                w, raw = enc.dtype.itemsize, memoryview(ids).cast("B")
                digests = [hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip((at * w).tolist(), (to * w).tolist(), strict=True)]
                payload = pa.Array.from_buffers(pa.binary(), len(to), [None, pa.py_buffer(np.concatenate([at[:1], to]).astype(np.int32) * w), pa.py_buffer(ids)])
                cols = [rid + doc, b.column("doc_id").take(pa.array(doc)), np.diff(offs)[doc], (np.arange(len(to)) - (np.cumsum(each) - each)[doc]).astype(np.int32), at - offs[:-1][doc], (to - at).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(digests, pa.binary()), payload], schema=_CHUNKS)
                rid += b.num_rows

    return run


def merkle_root(col):
    """Root over binary children in order; the root of no children is the digest of nothing."""
    return F.sha2(F.coalesce(F.aggregate(col, F.lit("").cast("binary"), lambda a, x: F.concat(a, x)), F.lit("").cast("binary")), 256)


def write_store(docs: DataFrame, root: str, tokenizer: str, end_id: int) -> str:
    """Encode ``docs`` (doc_id, text), write chunks, recipes and manifest under ``root``, and return the Merkle root of the store."""
    spark = docs.sparkSession
    rows = C.stage(C.plain(docs, "doc_id", "text").mapInArrow(_chunker(tokenizer, end_id), "rid long, doc_id long, n_tokens long, pos int, off long, n int, digest binary, payload binary"), "ids")
    rows.select("digest", "n", "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{root}/chunks")
    recipes = rows.groupBy("rid", "doc_id", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "off", "n", "digest"))).alias("parts"))
    recipes = recipes.withColumn("root", merkle_root("parts.digest"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = C.stage(recipes, "recipes")
    order = ["doc_id", "root", "rid"]
    recipes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("seg", F.spark_partition_id()).write.parquet(f"{root}/ordered")
    ordered = spark.read.parquet(f"{root}/ordered")
    # One row for each segment: bounded by the number of shuffle partitions, whatever the input.
    base, bases = 0, []
    for seg, n in sorted((r.seg, r.n) for r in ordered.groupBy("seg").agg(F.sum("n_tokens").alias("n")).collect()):
        bases.append((seg, base))
        base += n
    bases = spark.createDataFrame(bases, "seg int, base long")
    w = Window.partitionBy("seg").orderBy(*order)
    ordered = ordered.join(F.broadcast(bases), "seg")
    ordered = ordered.withColumn("start", F.col("base") + F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).withColumn("block", F.expr(f"cast((row_number() over (partition by seg order by {', '.join(order)}) - 1) div {BLOCK} as int)"))
    ordered.select("seg", "block", *order, "start", "n_tokens", "parts").write.parquet(f"{root}/recipes")
    manifest(spark.read.parquet(f"{root}/recipes")).write.parquet(f"{root}/manifest")
    C.drop_path(spark, f"{root}/ordered")
    return spark.read.parquet(f"{root}/manifest").where("seg = -1").first().root


def manifest(recipes: DataFrame) -> DataFrame:
    """seg, block, n_docs, n_tokens, root: each block of at most BLOCK documents, each segment (block -1) and the store (seg and block -1).

    A leaf says all of a recipe: its document, where it starts, how long it is, and the root over its chunks' digests.
    """
    said = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", merkle_root(F.transform("parts.digest", lambda d: d)))
    leaf = F.unhex(F.sha2(said.cast("binary"), 256))
    level = lambda df, by, key: df.groupBy(*by).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct(key, "hash"))).alias("kids")).withColumn("root", merkle_root("kids.hash"))
    up = lambda df, *keys: df.select(*keys, "n_docs", "n_tokens", F.unhex("root").alias("hash"))
    # Starts differ, since each document has an id at least: they give the order.
    blocks = level(recipes.select("seg", "block", "start", F.lit(1).cast("long").alias("n_docs"), "n_tokens", leaf.alias("hash")), ["seg", "block"], "start")
    segments = level(up(blocks, "seg", "block"), ["seg"], "block")
    # One child for each segment, as many as the shuffle that wrote the store had partitions; none gives the root of an empty store.
    store = level(up(segments, "seg"), [], "seg")
    whole = store.select(F.lit(-1).alias("seg"), F.lit(-1).alias("block"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "root")
    cols = ["seg", "block", "n_docs", "n_tokens", "root"]
    return blocks.select(*cols).unionByName(segments.withColumn("block", F.lit(-1)).select(*cols)).unionByName(whole)


def verify(spark: SparkSession, root: str, expected: str | None = None) -> str:
    """The store's Merkle root, after every node made from the recipes was held against the manifest, and the root against ``expected``."""
    said, made = spark.read.parquet(f"{root}/manifest"), manifest(spark.read.parquet(f"{root}/recipes"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("n_docs", "n_tokens", "root")]
    both = said.alias("s").join(made.alias("m"), ["seg", "block"], "full").where(~(same[0] & same[1] & same[2]))
    if wrong := both.select("seg", "block").orderBy("seg", "block").limit(1).collect():
        raise ValueError(f"recipes differ from the manifest (segment {wrong[0].seg}, block {wrong[0].block})")
    tops = said.where("seg = -1").collect()
    if len(tops) != 1 or expected not in (None, tops[0].root):
        raise ValueError("the manifest is not that of the store expected")
    return tops[0].root


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the CRC polynomial, bit-reflected as zlib keeps them."""
    a, b, out = a.astype(np.uint64), b.astype(np.uint64), np.zeros(len(a), np.uint64)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1), b, np.uint64(0))
        b = b >> np.uint64(1) ^ np.where(b & np.uint64(1), np.uint64(_CRC_POLY), np.uint64(0))
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What the CRC of a part adds to the CRC of a text in which ``n_bytes`` bytes follow it: the CRC is the exclusive or of these."""
    out, left = crc.astype(np.uint64), n_bytes.astype(np.uint64)
    power = np.array([1 << 23], np.uint64)  # x to the 8: one byte
    while left.any():
        on = np.flatnonzero(left & np.uint64(1))
        out[on] = _times(np.broadcast_to(power, len(on)), out[on])
        power, left = _times(power, power), left >> np.uint64(1)
    return out


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, its digest checked: the CRC of its ids as 32-bit integers."""
    for b in batches:
        col, out = pa.concat_arrays([b.column("payload")]), []
        at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
        raw, at = memoryview(col.buffers()[2] or b"")[int(at[0]) : int(at[-1])], at - at[0]
        counts = b.column("n").to_numpy(zero_copy_only=False)
        width = _width(len(raw), int(counts.sum()))
        wide = memoryview(np.frombuffer(raw, f"<u{width}").astype("<u4")).cast("B")
        for want, n, s, e in zip(b.column("digest").to_pylist(), counts.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hashlib.blake2b(raw[s:e], digest_size=16).digest() != want or e - s != n * width:
                raise ValueError(f"chunk {want.hex()} is damaged")
            out.append(zlib.crc32(wide[s * 4 // width : e * 4 // width]))
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(out, pa.int64())], names=["digest", "crc"])


def _width(n_bytes: int, n_ids: int) -> int:
    """Bytes an id has: 2 or 4, as the vocabulary needed."""
    if n_bytes not in (2 * n_ids, 4 * n_ids):
        raise ValueError("a chunk is damaged")
    return n_bytes // n_ids if n_ids else 2


@F.pandas_udf(T.LongType())
def _term(crc: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(shift_crc(crc.to_numpy(np.uint64), 4 * after.to_numpy(np.uint64)).astype(np.int64))


def read_back(spark: SparkSession, root: str, expected: str | None = None) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, n_chunks, merkle_root (over its chunks).

    The recipes are verified against the manifest first; then every chunk is read and its digest checked.  CRCs of the parts are combined
    algebraically, so ids do not move; a missing part or a wrong length fails the read.  A chunk that very many documents share (that
    of the empty text, say) is joined by broadcasting its row of fixed width.
    """
    verify(spark, root, expected)
    recipes = spark.read.parquet(f"{root}/recipes")
    facts = spark.read.parquet(f"{root}/chunks").mapInArrow(_facts, "digest binary, crc long")
    refs = recipes.select("rid", "n_tokens", F.explode("parts").alias("p")).select("rid", F.col("p.n").alias("n"), (F.col("n_tokens") - F.col("p.off") - F.col("p.n")).alias("after"), F.col("p.digest").alias("digest"))
    counts = refs.groupBy("digest").agg(F.count("*").alias("refs"))
    known = C.stage(facts.join(counts, "digest"), "facts")
    total = known.agg(F.coalesce(F.sum("refs"), F.lit(0))).first()[0]
    terms = C.join_shared(refs, known, ["digest"], "refs", total).select("rid", "n", _term("crc", "after").alias("term"))
    sums = terms.groupBy("rid").agg(F.bit_xor("term").alias("crc"), F.sum("n").alias("got"), F.count("*").alias("n_chunks"))
    heads = recipes.select("rid", "doc_id", "start", "n_tokens", "root", F.size("parts").alias("want"))
    found = heads.join(sums, "rid", "left")
    good = (F.col("got") == F.col("n_tokens")) & (F.col("n_chunks") == F.col("want"))
    crc = F.when(F.coalesce(good, F.lit(False)), F.col("crc")).otherwise(F.raise_error(F.concat(F.lit("document cannot be rebuilt: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("long"))
    return found.select("doc_id", "start", "n_tokens", crc.alias("ids_crc32"), F.col("want").cast("long").alias("n_chunks"), F.col("root").alias("merkle_root"))


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """Documents with their ids, rebuilt from the chunks: doc_id, start, ids array<long>."""
    recipes = spark.read.parquet(f"{root}/recipes")
    refs = recipes.select("rid", "doc_id", "start", F.explode("parts").alias("p")).select("rid", "doc_id", "start", "p.pos", "p.n", "p.digest")
    joined = refs.join(spark.read.parquet(f"{root}/chunks").select("digest", "payload"), "digest").groupBy("rid", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "payload"))).alias("parts"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids(parts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(raw := b"".join(p["payload"] for p in row), f"<u{_width(len(raw), sum(p['n'] for p in row))}").astype(np.int64) for row in parts])

    return joined.select("doc_id", "start", ids("parts").alias("ids"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = C.new_path(spark, "store")
    made = write_store(C.table(spark, sf_dir, "documents"), root, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_back(spark, root, made)
