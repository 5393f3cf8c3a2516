"""Secret scan with linking of credential parts.

Base spans (assign, access, hex) are reported wherever they stand.  Weak spans (ident, endpoint, secret) are reported only
where a complementary part lies within ``SCOPE`` code points: a secret or an endpoint is no finding by itself.  All spans of a
document are sorted by start; running maxima of earlier ends and running minima of later starts, by role, give each span
its nearest complement on either side, so the interval join costs one sort and never forms pairs.  The nearer of the two is linked
to it: a link says which two parts belong together, and is reported for base and weak spans alike.

Roles: identifier (access, ident), secret (assign, hex, secret), endpoint.  An identifier and an endpoint are completed by a secret, a
secret by an identifier or an endpoint.  Weak spans that overlap a base span are left out: the base span says it already.

Defined cases: a null text is empty; documents without findings have zeros and empty strings; repeated rows are scanned
each; of two complements at the same distance the earlier one is linked, of several that overlap the span the one that ends last; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

SCOPE = 200


def _either(word: str) -> str:
    """The word in a pattern, each letter in either case (ASCII only)."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_IDS = "|".join(map(_either, ("username", "user", "login", "account", "client_id")))
#: kind: (pattern, group to measure, least length, role, base, what a text must hold to be looked at: a literal, or None for the pattern)
KINDS = {
    "assign": ("(" + _NAMES + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, "s", True, None),
    "access": ("AKIA[A-Z0-9]+", 0, 16, "i", True, "AKIA"),
    "hex": ("[0-9a-f]+", 0, 32, "s", True, "[0-9a-f]{32}"),
    "ident": ("(" + _IDS + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9@_.-]+)", 2, 3, "i", False, None),
    "endpoint": ("https?://[A-Za-z0-9.-]+", 0, 11, "e", False, "://"),
    "secret": ("[A-Za-z0-9+/]+", 0, 40, "s", False, "[A-Za-z0-9+/]{40}"),
}
#: The roles that complete each role.
_NEEDS = {"i": "s", "e": "s", "s": "ie"}


def _found(text: Column, kind: str) -> Column:
    """For each match: length of the text since the match before, length of the match, whether it is long enough."""
    pattern, group, least, _, _, hint = KINDS[kind]
    there = text.rlike(pattern if hint is None else hint) if hint is None or "[" in hint else text.contains(hint)
    n_between = F.transform(F.split(text, pattern, -1), F.char_length)
    n_match = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.char_length(x) >= least)
    return F.when(there, F.filter(F.zip_with(F.arrays_zip(n_between.alias("b"), n_match.alias("m")), long_enough, lambda x, ok: F.struct(F.lit(list(KINDS).index(kind)).alias("kind"), x["b"].alias("b"), x["m"].alias("m"), ok.alias("ok"))), lambda x: x["m"].isNotNull()))


def scan(docs: DataFrame, scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rid and doc_id of each row of ``docs``, and the reported spans: rid, start, stop, kind, ord, base, and what each is linked to (link: start, stop, ord; or null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("rid", F.monotonically_increasing_id())
    rows = C.stage(base.select("rid", "doc_id", *[_found(F.col("text"), k).alias(k) for k in KINDS]), "scan")
    some = rows.where(F.coalesce(*[F.col(k) for k in KINDS]).isNotNull())
    nothing = F.array().cast("array<struct<kind:int,b:int,m:int,ok:boolean>>")
    each = some.select("rid", F.explode(F.array(*[F.coalesce(F.col(k), nothing) for k in KINDS])).alias("list")).select("rid", F.posexplode("list").alias("k", "x"))
    each = each.select("rid", "k", F.col("x.kind").alias("ord"), F.col("x.b").alias("b"), F.col("x.m").alias("m"), F.col("x.ok").alias("ok"))
    run = Window.partitionBy("rid", "ord").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("stop", F.sum(F.col("b") + F.col("m")).over(run)).where("ok")
    each = each.select("rid", "ord", (F.col("stop") - F.col("m")).alias("start"), "stop")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    each = each.withColumn("role", F.get(F.array(*[F.lit(v[3]) for v in KINDS.values()]), F.col("ord"))).withColumn("base", F.get(F.array(*[F.lit(v[4]) for v in KINDS.values()]), F.col("ord")))
    back = Window.partitionBy("rid").orderBy("start", "stop", "ord").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("stop"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    seen, coming = F.struct("stop", "start", "ord"), F.struct("start", "stop", "ord")
    completes = lambda role: F.col("role").isin(*_NEEDS[role])
    each = each.select("*", *[F.max(F.when(completes(r), seen)).over(back).alias(f"{r}_before") for r in _NEEDS], F.max(F.when(F.col("base"), F.col("stop"))).over(back).alias("b_before"), *[F.min(F.when(completes(r), coming)).over(ahead).alias(f"{r}_after") for r in _NEEDS], F.min(F.when(F.col("base"), F.col("start"))).over(ahead).alias("b_after"))
    pick = lambda side: F.coalesce(*[F.when(F.col("role") == r, F.col(f"{r}_{side}")) for r in _NEEDS])
    each = each.withColumn("before", pick("before")).withColumn("after", pick("after"))
    far = F.lit(1 << 40)
    gap = lambda side, between: F.when(F.col(side).isNull(), far).otherwise(F.greatest(between, F.lit(0)))
    gap_before, gap_after = gap("before", F.col("start") - F.col("before.stop")), gap("after", F.col("after.start") - F.col("stop"))
    as_link = lambda side: F.struct(F.col(f"{side}.start").alias("start"), F.col(f"{side}.stop").alias("stop"), F.col(f"{side}.ord").alias("ord"))
    each = each.withColumn("link", F.when(F.least(gap_before, gap_after) <= scope, F.when(gap_before <= gap_after, as_link("before")).otherwise(as_link("after"))))
    alone = (F.coalesce("b_before", F.lit(-1)) <= F.col("start")) & (F.coalesce("b_after", far) >= F.col("stop"))
    return rows.select("rid", "doc_id"), each.where(F.col("base") | (F.col("link").isNotNull() & alone)).select("rid", "start", "stop", F.get(kinds, F.col("ord")).alias("kind"), "ord", "base", "link")


def links(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each link: doc_id, kind, start, stop of a reported span and other_kind, other_start, other_stop of its complement."""
    rows, spans = scan(docs, scope)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return rows.join(spans.where(F.col("link").isNotNull()), "rid").select("doc_id", "kind", "start", "stop", F.get(kinds, F.col("link.ord")).alias("other_kind"), F.col("link.start").alias("other_start"), F.col("link.stop").alias("other_stop"))


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak spans), links (span>complement)."""
    rows, spans = scan(docs, scope)
    text = lambda kind, at: F.concat_ws(":", kind, F.col(f"{at}start").cast("string"), F.col(f"{at}stop").cast("string"))
    said = text(F.col("kind"), "")
    link = F.when(F.col("link").isNotNull(), F.concat_ws(">", said, text(F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("link.ord")), "link.")))
    item = F.struct("start", "ord", said.alias("said"), "base", link.alias("link"))
    by = spans.groupBy("rid").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS if KINDS[k][4]], F.count_if(~F.col("base")).alias("n_linked"), F.array_sort(F.collect_list(item)).alias("all"))
    out = rows.join(by, "rid", "left")
    everything = F.coalesce("all", F.array().cast("array<struct<start:bigint,ord:int,said:string,base:boolean,link:string>>"))
    joined = lambda xs, c: F.array_join(F.transform(xs, lambda x: x[c]), ",")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS if KINDS[k][4]], F.sha2(joined(F.filter(everything, lambda x: x["base"]), "said").cast("binary"), 256).alias("base_sha256"), joined(everything, "said").alias("spans"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), joined(F.filter(everything, lambda x: x["link"].isNotNull()), "link").alias("links"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(C.plain(C.table(spark, sf_dir, "documents"), "doc_id", "text"))


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for n, (kind, (p, group, least, role, base, _)) in enumerate(KINDS.items()):
        parts.append(
            f"select doc_id, {n} as ord, '{kind}' as kind, '{role}' as role, {str(base).lower()} as base, sum(b + m) over (partition by doc_id order by k) - m as start, sum(b + m) over (partition by doc_id order by k) as stop, ok from ("
            f"select doc_id, unnest(range(len(mm))) as k, unnest(list_transform(bb[:len(mm)], lambda x: length(x))) as b, unnest(list_transform(mm, lambda x: length(x))) as m, unnest(list_transform(gg, lambda x: length(x) >= {least})) as ok from ("
            f"select doc_id, string_split_regex(text, {quoted(p)}) as bb, regexp_extract_all(text, {quoted(p)}, 0) as mm, regexp_extract_all(text, {quoted(p)}, {group}) as gg from d where regexp_matches(text, {quoted(p)})))"
        )
    needs = " or ".join(f"s.role = '{r}' and o.role in ({', '.join(quoted(x) for x in v)})" for r, v in _NEEDS.items())
    far = 1 << 40
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
s as (select * from ({' union all '.join(parts)}) where ok),
c as (select s.doc_id, s.start, s.stop, s.ord, max({{'stop': o.stop, 'start': o.start, 'ord': o.ord, 'kind': o.kind}}) filter (where (o.start, o.stop, o.ord) < (s.start, s.stop, s.ord)) as b,
  min({{'start': o.start, 'stop': o.stop, 'ord': o.ord, 'kind': o.kind}}) filter (where (o.start, o.stop, o.ord) > (s.start, s.stop, s.ord)) as a
  from s join s o on o.doc_id = s.doc_id and ({needs}) group by all),
g as (select *, case when b is null then {far} else greatest(start - b.stop, 0) end as gb, case when a is null then {far} else greatest(a.start - stop, 0) end as ga from c),
l as (select doc_id, start, stop, ord, case when gb <= ga then b.kind || ':' || b.start || ':' || b.stop else a.kind || ':' || a.start || ':' || a.stop end as link from g where least(gb, ga) <= {SCOPE}),
r as (select s.*, l.link from s left join l using (doc_id, start, stop, ord) where s.base or l.link is not null and not exists (select 1 from s o where o.doc_id = s.doc_id and o.base and o.start < s.stop and s.start < o.stop))
select d.doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (where base), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord), '') as spans,
  count(*) filter (where not base) as n_linked,
  coalesce(string_agg(kind || ':' || start || ':' || stop || '>' || link, ',' order by start, ord) filter (where link is not null), '') as links
from d left join r using (doc_id) group by d.doc_id
"""


ORACLE_SQL = _oracle()
