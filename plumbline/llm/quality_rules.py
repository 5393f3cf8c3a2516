"""Quality rules with verdicts on hosts.

Each document fails some of the base rules or none.  Failures are summed by host, rule by rule and for any rule; each host's rates
are shrunk towards a beta prior fitted to the rates of all hosts by moments, one prior a rule.  With the prior and its own documents a
host's rate has a beta posterior; the host fails where the posterior of "any rule" puts the rate above ``HOST_RATE`` (most of its
documents are bad) with a certainty of ``CERTAINTY`` standard deviations, and its documents go with it.

Defined cases: a null text has no words and fails; documents without a host (null) form no host and are judged alone; with
no failures, or no spread between hosts, the prior is the mean rate with the weight of ``LEAST_WEIGHT`` documents; an empty
table gives an empty result; repeated rows count as often as they stand; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host fails if its rate of failing documents lies above this, by so many standard deviations of the posterior.
HOST_RATE, CERTAINTY = 0.5, 1.645
LEAST_WEIGHT = 2.0
#: Each rule by name, over the base figures.
RULES = {"short": f"n_words < {MIN_WORDS}", "repeat": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FOLLOWS = (np.arange(256) & 0xC0) == 0x80  # bytes that go on with a code point
_CHARS = ~_SPACE & ~_FOLLOWS


def repeated_words(codes: np.ndarray, offs: np.ndarray, n_codes: int) -> np.ndarray:
    """Per text, the words that lie in 3-word windows found twice or more in that text."""
    docs = len(offs) - 1
    if len(codes) < 3 or docs == 0:
        return np.zeros(docs, np.int64)
    v = max(2, n_codes)
    if docs > 1 and docs * v**3 >= 2**63:  # halves, until a window of one text fits into 63 bits
        h = docs // 2
        out = []
        for a, b in ((0, h), (h, docs)):
            part, again = codes[offs[a] : offs[b]], np.array([], np.int64)
            names, again = np.unique(part, return_inverse=True)
            out.append(repeated_words(again.astype(np.int64), offs[a : b + 1] - offs[a], len(names)))
        return np.concatenate(out)
    own = C.owner(offs)
    if v**3 * docs < 2**63:
        key = ((own[:-2] * v + codes[:-2]) * v + codes[1:-1]) * v + codes[2:]
    else:  # one text with over two million distinct words: name its pairs first
        pairs = np.unique(codes[:-1] * v + codes[1:], return_inverse=True)[1].astype(np.int64)
        key = pairs[:-1] * v + codes[2:]
    key = np.where(own[:-2] == own[2:], key, -1)
    s = np.sort(key)
    twice = np.unique(s[1:][(s[1:] == s[:-1]) & (s[1:] >= 0)])
    if not len(twice):
        return np.zeros(docs, np.int64)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == key)
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[hit + k] = True
    return C.segment_sum(covered, offs)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in C.slices(whole):
            arr = C.texts_of(b)
            flat, offs = C.split_words(arr)
            codes, names = C.coded(flat)
            buf = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
            at = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
            buf, at = buf[at[0] : at[-1]], at - at[0]
            lines, loffs = C.split_lines(arr)
            lcodes, lnames = C.coded(lines)
            worded = np.array([bool(x.strip(b"\t\n\v\f\r ")) for x in lnames.cast(pa.binary()).to_pylist()], bool)[lcodes] if len(lines) else np.zeros(0, bool)
            keys = np.where(worded, C.owner(loffs) * max(1, len(lnames)) + lcodes, -1)
            first = np.zeros(len(keys), bool)
            first[np.unique(keys, return_index=True)[1]] = True
            cols = [np.diff(offs), C.segment_sum(_CHARS[buf], at), C.segment_sum(_SYMBOL[buf], at), C.segment_sum(worded & ~first, loffs), repeated_words(codes, offs, len(names))]
            given = {"doc_id": b.column("doc_id"), "host": b.column("source")} | ({"key": b.column("key")} if "key" in b.schema.names else {})
            yield pa.RecordBatch.from_arrays([*given.values(), *[pa.array(c.astype(np.int64)) for c in cols]], names=[*given, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def features(docs: DataFrame, host: str = "source", key: str | None = None) -> DataFrame:
    """The base figures of each row of ``docs`` (doc_id, text, and the column that names the host), and its ``key`` (a long), if any."""
    rows = docs.select("doc_id", "text", F.col(host).cast("string").alias("source"), *([F.col(key).alias("key")] if key else []))
    out = rows.mapInArrow(_features, "doc_id long, host string" + (", key long" if key else "") + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    for rule, sql in RULES.items():
        out = out.withColumn(f"{rule}_failed", F.expr(sql))
    return out.withColumn("base_failed", F.expr(" or ".join(f"{rule}_failed" for rule in RULES)))


def _prior(got: Row, rule: str) -> tuple[float, float]:
    """Mean and weight (in documents) of the beta prior of a rule's rates."""
    failed, squares = got[f"f_{rule}"], got[f"s_{rule}"]
    if not got.n:
        return 0.0, LEAST_WEIGHT
    mean = failed / got.n
    # Variance of the rates between hosts, weighted by documents, less what chance alone gives.
    spread = max(0.0, squares / got.n - mean * mean) - mean * (1 - mean) * got.h / got.n
    rest = 1 - got.h / got.n
    if spread > 1e-12 and rest > 0:
        return mean, max(LEAST_WEIGHT, mean * (1 - mean) * rest / spread - 1)
    return mean, max(LEAST_WEIGHT, got.n / got.h) if got.h > 1 else LEAST_WEIGHT


def host_verdicts(judged: DataFrame) -> DataFrame:
    """host, n_docs, for each rule and "any" n_.. (failures) and rate_.. (shrunken), and host_failed, from rows with host and the rules' columns.

    One pass gives the sums by host; the moments of all hosts' rates are one row.
    """
    rules = {**{rule: f"{rule}_failed" for rule in RULES}, "any": "base_failed"}
    hosts = C.stage(judged.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.col(c).cast("long")).alias(f"n_{r}") for r, c in rules.items()]), "hosts")
    p = lambda r: F.col(f"n_{r}") / F.col("n_docs")
    got = hosts.agg(F.sum("n_docs").alias("n"), F.count("*").alias("h"), *[F.sum(f"n_{r}").alias(f"f_{r}") for r in rules], *[F.sum(F.col("n_docs") * p(r) * p(r)).alias(f"s_{r}") for r in rules]).first()
    out = hosts
    for rule in rules:
        mean, weight = _prior(got, rule)
        out = out.withColumn(f"rate_{rule}", (F.col(f"n_{rule}") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight)))
    # The loop ends with "any": the deviation of its posterior.
    rate = F.col("rate_any")
    deviation = F.sqrt(rate * (1 - rate) / (F.col("n_docs") + F.lit(weight) + 1))
    return out.withColumn("host_failed", rate - F.lit(CERTAINTY) * deviation >= HOST_RATE)


def judge(docs: DataFrame, host: str = "source", key: str | None = None) -> DataFrame:
    """Base figures, base_failed, the figures of the host (host_docs, host_failures, host_rate), host_failed and kept for each row of ``docs``, and its ``key``, if any, as key."""
    rows = C.stage(features(docs, host, key), "rules")
    verdicts = host_verdicts(rows).select(F.col("host"), F.col("n_docs").alias("host_docs"), F.col("n_any").alias("host_failures"), F.col("rate_any").alias("host_rate"), *[F.col(f"rate_{r}").alias(f"host_{r}_rate") for r in RULES], "host_failed")
    # Few hosts are broadcast by Spark itself, by their measured size; else a hot host's partition is split (skew join).
    out = rows.join(verdicts, "host", "left")
    out = out.withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(C.table(spark, sf_dir, "documents"))
    rates = [F.round(c, 6).alias(c) for c in ("host_rate", *[f"host_{r}_rate" for r in RULES])]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_docs", "host_failures", *rates, "host_failed")


_NAMES = [*RULES, "any"]
_WEIGHT = "case when s.spread_{0} > 1e-12 and s.rest > 0 then greatest({1}, s.mean_{0} * (1 - s.mean_{0}) * s.rest / s.spread_{0} - 1) when s.h > 1 then greatest({1}, s.n / s.h) else {1} end as weight_{0}"
ORACLE_SQL = f"""
with t as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select doc_id, unnest(range(len(w))) as i, unnest(w) as w0 from t),
g as (select doc_id, i, w0, lead(w0) over o as w1, lead(w0, 2) over o as w2 from p window o as (partition by doc_id order by i)),
r as (select doc_id, i from g where w2 is not null qualify count(*) over (partition by doc_id, w0, w1, w2) > 1),
c as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as k from r) group by doc_id),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
f as (select doc_id, source, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from t join l using (doc_id) left join c using (doc_id)),
b as (select *, {", ".join(f"{sql} as {rule}_failed" for rule, sql in RULES.items())}, {" or ".join(RULES.values())} as base_failed from f),
h as (select source, count(*) as n, {", ".join(f"count(*) filter (where {c}) as n_{r}" for r, c in zip(_NAMES, [*[f"{x}_failed" for x in RULES], "base_failed"], strict=True))} from b where source is not null group by source),
m as (select sum(n) as n, count(*) as h, {", ".join(f"sum(n_{r}) / sum(n) as mean_{r}, sum(n * (n_{r} / n) ** 2) as npp_{r}" for r in _NAMES)} from h),
s as (select *, 1 - h / n as rest, {", ".join(f"greatest(0, npp_{r} / n - mean_{r} * mean_{r}) - mean_{r} * (1 - mean_{r}) * h / n as spread_{r}" for r in _NAMES)} from m),
k as (select *, {", ".join(_WEIGHT.format(r, LEAST_WEIGHT) for r in _NAMES)} from s),
v as (select h.source, h.n as host_docs, h.n_any as host_failures, {", ".join(f"(h.n_{r} + mean_{r} * weight_{r}) / (h.n + weight_{r}) as rate_{r}" for r in _NAMES)}, h.n + weight_any + 1 as size from h, k),
e as (select *, rate_any - {CERTAINTY} * sqrt(rate_any * (1 - rate_any) / size) >= {HOST_RATE} as host_failed from v)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(host_failed, false) as kept,
  source as host, host_docs, host_failures, round(rate_any, 6) as host_rate, {", ".join(f"round(rate_{r}, 6) as host_{r}_rate" for r in RULES)}, coalesce(host_failed, false) as host_failed
from b left join e using (source)
"""
