"""Line dedup: lines that many documents share stay only in the document with the largest id.

Only hashes of lines move.  They are range-partitioned by line and document and sorted by line, document and position, so a line with a
third of all rows is spread over partitions by its documents.  A window streams each partition in that order and marks the first
occurrence of a line in a document; first occurrences are counted by line from partial sums.  What comes back to each document is a
compressed bitmap: of each 64 lines of which one goes, a long whose bits are the lines to keep; words that keep all are left out.

Defined cases: a null or empty text is one empty line; a line of fewer than ``min_chars`` code points (stripped) always stays; a
line keeps all its places in the document that holds it; rows that repeat a doc_id count as one document, and keep apart by
their text; lines of a null doc_id count as one document that never is the largest; an empty table gives an empty result; other columns
are ignored by keep_bitmaps() and returned by dedup_documents(), but for such as have the name of one of its three results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

MIN_CHARS, MIN_DOCS = 40, 5
WHITE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(WHITE))
    # Lower-casing is quick on ASCII and means the same there.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sorted_run(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, doc_id, text_key, pos, first of each long line, written in the order of line, document and position."""
    rows = docs.select("doc_id", _row_key(F.col("text")).alias("text_key"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    # Whatever is shorter than min_chars bytes is also shorter in code points: most short lines go before their key is made.
    rows = rows.where(F.octet_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    # Written before the ranges are made: these are sampled from the hashes, texts are read once.
    rows = C.stage(rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc_id", "text_key", "pos"), "lines")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The window asks for its rows together by line and document, as the ranges have them: it sorts each range, and moves nothing.
    stream = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos", "text_key")
    return C.stage(rows.repartitionByRange(parts, "h1", "h2", "doc_id").withColumn("first", F.row_number().over(stream) == 1), "run")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_key, bitmap array<struct<word, bits>>: the lines to keep of each 64 with a line to drop; no row for documents that keep all."""
    run = sorted_run(docs, min_chars)
    lines = run.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    # How many rows a line has, for the join: at least as many as documents.
    shared = C.stage(lines.where(F.col("n_docs") >= min_docs), "shared")
    out = C.join_shared(run.drop("first"), shared, ["h1", "h2"], "n_docs", run.count()).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    out = out.groupBy("doc_id", "text_key", F.expr("pos div 64").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return out.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def dropped_positions(bitmap: Column) -> Column:
    """Positions of the bits that are not set, ascending."""
    bits = lambda w: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.getbit(w["bits"], b) == 0, w["word"] * 64 + b)), lambda p: p.isNotNull())
    return F.flatten(F.transform(bitmap, bits))


def kept_lines(lines: Column, gone: Column) -> Column:
    """``lines`` without the ascending positions ``gone``, in time in proportion to both."""
    before = F.transform(gone, lambda p, i: F.slice(lines, F.when(i == 0, F.lit(1)).otherwise(F.get(gone, i - 1) + 2).cast("int"), F.when(i == 0, p).otherwise(p - F.get(gone, i - 1) - 1).cast("int")))
    last = F.slice(lines, (F.element_at(gone, -1) + 2).cast("int"), F.size(lines))
    return F.concat(F.flatten(before), last)


def apply_bitmaps(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text.  Only texts with drops are taken apart.

    The bitmaps are the small side: a hash table of one partition of them at a time, so texts are shuffled but not sorted.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rest = [c for c in names if c not in ("doc_id", "text")]
    # The caller's other columns travel in one struct, so none of them meets a name used here.
    rows = docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("row"), _row_key(F.col("text")).alias("text_key"))
    found = found.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "bitmap")
    out = rows.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = out.withColumn("gone", F.when(F.col("bitmap").isNotNull(), dropped_positions(F.col("bitmap"))))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept_lines(_lines(F.col("text")), F.col("gone")), "\n"))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    out = out.select("doc_id", F.col("text").alias("given"), "row", n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("given")}
    return out.select(*[own.get(c, F.col("row")[c]).alias(c) for c in names], "n_lines", "n_dropped", "kept_text")


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.plain(C.table(spark, sf_dir, "documents"), "doc_id", "text")
    out = dedup_documents(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.*, s.keeper is not null and s.keeper <> k.doc_id as gone from k left join s using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""
