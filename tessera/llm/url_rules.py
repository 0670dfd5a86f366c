"""URL filters as a sort-merge range join of hosts with nested rules, in DataFrame operations only.

A host's canonical key is its labels in reverse, each followed by a dot: `www.example.net` is
`net.example.www.`. A rule for a host and its subdomains is then the interval of keys that begin with the
rule's key, and intervals nest or are apart. Distinct hosts and the intervals' begins and ends are cut
into ranges of keys and each range is swept in key order: a begin puts its rule on a stack at its depth, an
end takes it off. Slot d of the stack is the last begin at depth d, read by a running window, so the sweep
streams. A range starts with the rules that are open at its lower bound. A host's stack goes to its urls by a
join on the host, and of the stacked rules the longest whose path begins the url's path decides.

A hot host is one row of the sweep; the join back is a plain one that adaptive execution splits.

Defined results: null url, or one without `://`, has an empty host and path; an empty host fits no rule but an
empty one; a url that no rule fits gets the default verdict; of equal rules block wins; repeated rows are
judged row by row; an empty table or rule list is fine; other columns are not read.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, local_rows, lower_ascii

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Keys looked at per range when bounds are chosen; they only balance the ranges.
BOUND_KEYS = 32


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return local_rows(spark, rules, "r_host string, r_path string, r_verdict string")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or a url without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def bounds(keys: DataFrame, ranges: int) -> list[str]:
    """At most ranges - 1 keys that cut the sorted keys about evenly; read from a bounded sample of them."""
    n = keys.count()
    if n <= 1 or ranges <= 1:
        return []
    step = max(1, n // (ranges * BOUND_KEYS))
    seen = sorted(r[0] for r in keys.filter(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).limit(4 * ranges * BOUND_KEYS).collect())
    return sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []


def nested_stacks(hosts: DataFrame, rules: DataFrame, ranges: int) -> DataFrame:
    """host, stack: for each distinct host the rule lists of its open intervals, outermost first."""
    spark = hosts.sparkSession
    by_host = rules.groupBy(canonical("r_host").alias("key")).agg(F.collect_set(F.struct("r_host", "r_path", "r_verdict")).alias("rules"))
    by_host = cut(by_host.filter(F.col("key").isNotNull()))
    keys = cut(hosts.select("host", canonical("host").alias("key")))
    cuts = F.array(*[F.lit(x) for x in bounds(keys, ranges)]) if (ranges > 1) else F.array()
    cuts = cuts.cast("array<string>")
    end = F.concat(F.encode(F.col("key"), "utf-8"), F.unhex(F.lit("FF")))  # above every key that begins so

    def range_of(key: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c <= key))

    # the last key of an interval is below key || U+10FFFF, the highest character
    spans = by_host.select("key", "rules", end.alias("end"), F.explode(F.sequence(range_of(F.col("key")), range_of(F.concat("key", F.lit("\U0010ffff"))))).alias("range"))
    nothing = F.lit(None).cast("array<struct<r_host:string,r_path:string,r_verdict:string>>")
    begins = spans.select("range", F.encode("key", "utf-8").alias("at"), F.lit(0).alias("kind"), "rules", F.lit(None).cast("string").alias("host"))
    ends = spans.select("range", F.col("end").alias("at"), F.lit(2).alias("kind"), nothing.alias("rules"), F.lit(None).cast("string").alias("host"))
    points = keys.select(range_of(F.col("key")).alias("range"), F.encode("key", "utf-8").alias("at"), F.lit(1).alias("kind"), nothing.alias("rules"), "host")
    sweep = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.sum(F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)).over(sweep)
    deepest = cut(begins.union(ends).withColumn("depth", depth)).agg(F.max("depth")).first()[0] or 0
    events = begins.union(ends).union(points).withColumn("depth", depth)
    slots = [F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.col("rules")), ignorenulls=True).over(sweep) for d in range(1, deepest + 1)]
    swept = events.select("host", "kind", "depth", *[s.alias(f"slot_{d}") for d, s in enumerate(slots, 1)]).filter(F.col("kind") == 1)
    stack = [F.when(F.col("depth") >= d, F.col(f"slot_{d}")) for d in range(1, deepest + 1)]
    empty = F.array().cast("array<array<struct<r_host:string,r_path:string,r_verdict:string>>>")
    return swept.select("host", (F.array_compact(F.array(*stack)) if stack else empty).alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url)."""
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stacks = cut(nested_stacks(urls.select("host").distinct(), rules, ranges)).filter(F.size("stack") > 0)
    joined = urls.join(stacks.withColumnRenamed("host", "s_host"), F.col("host") == F.col("s_host"), "left")
    fits = F.filter(F.flatten("stack"), lambda r: F.col("path").startswith(r["r_path"]))
    # longest rule first; of rules of one length the longer host, and of equal rules block
    order = F.transform(fits, lambda r: F.struct(F.length(F.concat(r["r_host"], r["r_path"])).alias("n"), F.length(r["r_host"]).alias("h"), (r["r_verdict"] == "block").alias("b"), F.concat(r["r_host"], r["r_path"]).alias("rule"), r["r_verdict"].alias("verdict")))
    best = F.array_max(order)
    return joined.select("page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


def oracle(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    """DuckDB SQL of filter_urls over pages."""
    cases = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    fit = lambda r: f"(host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')"
    case = lambda i: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r[0] + r[1] if i else r[2]}'" for r in cases)
    return f"""WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    named AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
    split AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM named)
    SELECT page_id, host, path, {case(1)} END AS rule, {case(0)} ELSE '{default}' END AS verdict FROM split"""
