"""URL filters: rules on hosts and path prefixes, found by a sorted sweep over reversed hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HOSTS_PER_SWEEP = 100_000


def host_of(url: Column) -> Column:
    """What follows the first "://", up to a slash, question mark, hash or the end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels from right to left, as an array: a domain's key starts the keys of all below it.

    Arrays are ordered label by label and a start comes before what it starts, so the hosts below
    a domain follow it directly, whatever signs a label holds.
    """
    return F.reverse(F.split(host, r"\."))


def sweep_of(key: Column) -> Column:
    """The first two labels of a key: the hosts that are swept together."""
    return F.slice(key, 1, 2)


def _with_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack) for each ruled domain: the rules of the domain and of all domains above it.

    The domains above a domain are the starts of its key, so this is an equality join.
    """
    rules = rules.select(
        host_key(F.translate("host", UPPER, LOWER)).alias("key"),
        F.struct(
            F.length(F.concat("host", "path")).alias("length"),
            F.length("host").alias("host_length"),
            F.concat("host", "path").alias("rule"),
            "path",
            "verdict",
        ).alias("entry"),
    ).withColumn("entry", F.col("entry").withField("key", F.col("key")))
    starts = F.transform(F.sequence(F.lit(1), F.size("key")), lambda n: F.slice("key", F.lit(1), n))
    domains = rules.select("key").distinct()
    chains = domains.select("key", F.explode(starts).alias("above"))
    above = rules.withColumnRenamed("key", "above")
    return chains.join(above, "above").groupBy("key").agg(F.collect_set("entry").alias("stack"))


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, active): the rules whose domain is the host or above it; hosts without any are left out.

    A rule covers an interval of keys: those that start with its domain's key. Such intervals are
    nested or apart, so sweeping hosts and domains in the order of their keys, the domain opened
    last tells the whole stack: what covers the host is that domain or one above it. The stacks
    of the domains are known beforehand; of the last one's stack the rules that have been
    closed before the host are popped.

    Hosts are swept by their first two labels; a domain of one label is handed to every sweep
    below it. A sweep of very many hosts is salted into several, each with all its rules; the
    result is the same for any number of salts.
    """
    stacks = _with_stacks(rules)
    keyed = hosts.select("host", host_key(F.col("host")).alias("key")).withColumn("sweep", sweep_of(F.col("key")))
    sweeps = keyed.groupBy("sweep").agg(
        F.expr(f"cast(count(1) div {HOSTS_PER_SWEEP} + 1 as bigint)").alias("salts")
    )
    keyed = keyed.join(sweeps, "sweep").withColumn("salt", F.pmod(F.xxhash64("host"), F.col("salts")))
    opened = stacks.withColumn("sweep", sweep_of(F.col("key")))
    deep = opened.filter("size(key) >= 2").join(sweeps, "sweep")
    top = opened.filter("size(key) < 2").withColumn("first", F.slice("sweep", 1, 1))
    top = top.drop("sweep").join(sweeps.withColumn("first", F.slice("sweep", 1, 1)), "first")
    columns = ["sweep", "salts", "key", "stack"]
    events = deep.select(*columns).unionByName(top.select(*columns))
    events = events.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    rows = events.select("sweep", "salt", "key", "stack", F.lit(None).cast("string").alias("host")).unionByName(
        keyed.select("sweep", "salt", "key", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"), "host")
    )
    so_far = W.partitionBy("sweep", "salt").orderBy("key", F.col("host").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    swept = rows.withColumn("top", F.last("stack", ignorenulls=True).over(so_far)).filter("host is not null")
    active = F.filter("top", lambda rule: F.slice("key", F.lit(1), F.size(rule["key"])) == rule["key"])
    return swept.select("host", active.alias("active")).filter("size(active) > 0")


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", url: str = "url") -> DataFrame:
    """`row` (all columns), host, path, rule and verdict for every row of `pages`.

    `rules` (host, path, verdict): a rule fits its host and all hosts below it, if the path
    starts with the rule's. The longest rule wins, by host and path together, then by host;
    between rules spelled alike the verdict that comes last in the alphabet. Without a rule the
    verdict is `otherwise`.

    Distinct hosts are swept, then joined to the pages by host: a host with very many pages is
    swept once, and its pages are split as a heavy join key. Rules with a null host, path or
    verdict fit nothing. A null url, or one without "://", has an empty host and path, which no
    rule fits. Hosts and paths may be of any length and hold any signs, blanks too. Repeated rows
    are judged alike, an empty table gives no rows, and columns of any name stay inside `row`.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    urls = pages.select(row.alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rules = rules.select("host", "path", "verdict").dropna().filter("host != ''").distinct()
    hosts = urls.filter("host != ''").select("host").distinct()
    active = active_rules(hosts, rules).withColumnRenamed("host", "active_host")
    joined = urls.join(active, F.col("host") == F.col("active_host"), "left")
    fitting = F.filter("active", lambda rule: F.col("path").startswith(rule["path"]))
    best = F.array_max(
        F.transform(fitting, lambda r: F.struct(r["length"], r["host_length"], r["rule"], r["verdict"]))
    )
    return joined.withColumn("best", best).select(
        "row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )
