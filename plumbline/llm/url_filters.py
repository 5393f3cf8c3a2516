"""URL filters by dated lists.

List entries are dated additions and removals of a host pattern in a category.  They become validity intervals [since, until).
Each distinct host that an entry names, itself or by a parent domain, gets its intervals; an as-of join gives each distinct (host,
day) of the captures the entries active on that day, and every capture its verdict.  A host with a third of all captures has one row
for each of its days before the join, and its captures are spread by their ids after it; an entry that names a third of all hosts (a
top-level domain) meets them spread by host.  No group is collected.

Defined cases: a url without a host (null, empty, malformed) matches nothing and is allowed; a null fetch date matches nothing; case and
dots at the end do not count, in urls and in entries; an address (dotted numbers, or in brackets) has no parent domains; an addition while
active and a removal while inactive change nothing; on one day additions come before removals; a removal never made leaves the
interval open; repeated captures are judged each; empty lists allow everything, and no captures give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C


HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)"


def host_of(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.+$", "")
    return F.when(F.length(host) > 0, host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, the top-level domain too; of an address itself only."""
    labels = F.split(host, "[.]", -1)
    n = F.size(labels)
    return F.when(host.rlike(r"^\[|^[0-9.]+$"), F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def intervals(events: DataFrame) -> DataFrame:
    """pattern, category, since, until from events (pattern, category, action add or remove, day)."""
    w = Window.partitionBy("pattern", "category").orderBy("day", "action")  # add sorts before remove
    e = events.select(F.regexp_replace(F.lower("pattern"), r"\.+$", "").alias("pattern"), "category", "action", "day").where((F.length("pattern") > 0) & F.col("day").isNotNull())
    e = e.withColumn("before", F.lag("action").over(w))
    e = e.where(F.coalesce("before", F.lit("remove")) != F.col("action")).withColumn("until", F.lead("day").over(w))
    e = e.where(F.col("action") == "add").select("pattern", "category", F.col("day").alias("since"), F.coalesce("until", F.lit("9999-12-31").cast("date")).alias("until"))
    return e.where(F.col("since") < F.col("until"))


def judge(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) with host, n_active, blocked, categories and latest (pattern of the last active entry)."""
    rows = C.plain(captures, "page_id", "url", "fetched").select("page_id", "fetched", host_of(F.col("url")).alias("host"))
    days = C.stage(rows.where(F.col("host").isNotNull() & F.col("fetched").isNotNull()).groupBy("host", "fetched").agg(F.count("*").alias("captures")), "days")
    entries = C.stage(intervals(events), "intervals")
    named = days.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("pattern"))
    rules = C.join_spread(named, entries, ["pattern"], "host").select("host", "pattern", "category", "since", "until")
    active = days.join(rules, "host").where((F.col("since") <= F.col("fetched")) & (F.col("fetched") < F.col("until")))
    last = F.max(F.struct("since", "pattern", "category", "until"))["pattern"]
    verdicts = active.groupBy("host", "fetched").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), last.alias("latest"))
    verdicts = C.stage(verdicts, "verdicts")
    judged = C.join_spread(rows, verdicts, ["host", "fetched"], "page_id", "left", C.hot_keys(days, ["host", "fetched"], members="captures"))
    n = F.coalesce("n_active", F.lit(0)).cast("long")
    return judged.select("page_id", "host", "fetched", n.alias("n_active"), (n > 0).alias("blocked"), F.coalesce("categories", F.lit("")).alias("categories"), "latest")


CATEGORIES = ("adult", "malware", "spam")


def sample_events(pages: DataFrame) -> DataFrame:
    """Dated entries for the test tables, which have no list: of every third host (by digest), or its domain, one history."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where(F.col("host").isNotNull()).distinct()
    h = hosts.withColumn("k", F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long")).where("k % 3 = 0")
    day = lambda e: F.expr(f"date_add(date'2024-01-01', cast({e} as int))")
    pattern = F.when(F.expr("k % 4 = 0"), F.regexp_replace("host", r"^[^.]+\.(.+\..+)$", "$1")).otherwise(F.col("host"))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.expr("cast(k div 3 % 3 + 1 as int)"))
    e = F.array(
        F.struct(F.lit("add").alias("action"), day("k div 7 % 300").alias("day"), F.lit(True).alias("is")),
        F.struct(F.lit("remove").alias("action"), day("k div 7 % 300 + 60").alias("day"), F.expr("k % 2 = 0").alias("is")),
        F.struct(F.lit("add").alias("action"), day("k div 7 % 300 + 120").alias("day"), F.expr("k % 5 < 3").alias("is")),
    )
    return h.select(pattern.alias("pattern"), category.alias("category"), F.explode(e).alias("e")).where("e.is").select("pattern", "category", F.col("e.action").alias("action"), F.col("e.day").alias("day")).distinct()


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.plain(C.table(spark, sf_dir, "pages"), "page_id", "url")
    captures = pages.withColumn("fetched", F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))"))
    return judge(captures, sample_events(pages))


ORACLE_SQL = r"""
with p as (select page_id, date '2024-01-01' + cast(page_id % 366 as int) as fetched, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)', 1), '\.+$', ''), '') as host from pages),
h as (select host, cast('0x' || substr(md5(host), 1, 8) as bigint) as k from (select distinct host from p where host is not null)),
e as (select distinct case when k % 4 = 0 then regexp_replace(host, '^[^.]+\.(.+\..+)$', '\1') else host end as pattern, ['adult', 'malware', 'spam'][k // 3 % 3 + 1] as category, a.action, date '2024-01-01' + cast(k // 7 % 300 + a.after as int) as day
  from h, (values ('add', 0), ('remove', 60), ('add', 120)) a(action, after) where k % 3 = 0 and (a.after = 0 or a.after = 60 and k % 2 = 0 or a.after = 120 and k % 5 < 3)),
o as (select *, lag(action) over w as before from e window w as (partition by pattern, category order by day, action)),
v as (select pattern, category, action, day as since, coalesce(lead(day) over (partition by pattern, category order by day, action), date '9999-12-31') as until from o where coalesce(before, 'remove') <> action),
i as (select * from v where action = 'add' and since < until),
m as (select p.page_id, i.* from p, i where (p.host = i.pattern or suffix(p.host, '.' || i.pattern) and not regexp_matches(p.host, '^\[|^[0-9.]+$')) and i.since <= p.fetched and p.fetched < i.until)
select p.page_id, p.host, p.fetched, count(m.pattern) as n_active, count(m.pattern) > 0 as blocked, coalesce(string_agg(distinct m.category, ',' order by m.category), '') as categories,
  arg_max(m.pattern, (m.since, m.pattern, m.category, m.until)) as latest
from p left join m using (page_id) group by p.page_id, p.host, p.fetched
"""
