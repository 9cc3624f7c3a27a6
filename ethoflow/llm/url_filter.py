"""URL filters over time: which list entries were active when a page was fetched. DataFrame functions only.

Dated list entries (add or remove a rule for a host, its subdomains, or a path prefix) become validity
intervals by a window over each rule. A capture looks up its host and every parent domain, so the as-of join
is an equality on the domain with an interval condition; overlapping entries are judged by precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import BROADCAST_BYTES, written


def host_of(url: Column) -> Column:
    """Lower-case host without user, port, trailing dot; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.rtrim(F.lower(host), F.lit("."))


def path_of(url: Column) -> Column:
    """The path from its first slash; '/' where there is none."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def domains_of(host: Column) -> Column:
    """The host and its parent domains, longest first; a host of no characters has none."""
    labels = F.split(host, r"\.")
    return F.when(F.length(host) > 0, F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, path, verdict, valid_from, valid_to) from entries(list, domain, path, verdict, action, at).

    ``action`` add opens an interval that lasts until the rule's next entry; remove closes it. A null path
    is '/', valid_to is null while open. Of entries of one rule at one time the last by (action, verdict)
    holds. Entries without a list, domain or time are left out. One rule's entries are ordered together.
    """
    own = entries.where("list is not null and domain is not null and at is not null").select("list", F.lower("domain").alias("domain"), F.coalesce("path", F.lit("/")).alias("path"), "verdict", "action", "at")
    own = own.groupBy("list", "domain", "path", "at").agg(F.max(F.struct("action", "verdict")).alias("e"))
    rule = Window.partitionBy("list", "domain", "path").orderBy("at")
    own = own.withColumn("valid_to", F.lead("at").over(rule))
    return own.where("e.action = 'add'").select("list", "domain", "path", F.col("e.verdict").alias("verdict"), F.col("at").alias("valid_from"), "valid_to")


def filtered(captures: DataFrame, entries: DataFrame, limit: int = BROADCAST_BYTES, salt: int = 32) -> DataFrame:
    """Every capture(page_id, url, fetched_at) with verdict, the deciding rule and how many were active.

    The most specific active rule decides: longest domain, then longest path, then latest start, then list
    name, then verdict; no active rule means 'pass'. A rule of path p covers paths that begin with p. A null
    url or fetch time matches nothing. Repeated captures are judged row by row. Other columns are ignored.

    The rules are broadcast while they take ``limit`` bytes at most. Beyond, captures of domains without a rule leave
    first, and the others shuffle, each domain dealt over ``salt`` tasks.
    """
    rules = written(intervals(entries), "intervals")
    size = rules.agg(F.sum(F.length("list") + F.length("domain") + F.length("path") + 96)).first()[0] or 0
    own = captures.select("page_id", "url", "fetched_at")
    keys = own.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    host = host_of(F.col("url"))
    probes = keys.select("url", "fetched_at", path_of(F.col("url")).alias("p"), F.explode(domains_of(host)).alias("domain"))
    if size <= limit:
        met = probes.join(F.broadcast(rules), "domain")
    else:
        named = written(rules.select("domain").distinct(), "domains")
        small = (named.agg(F.sum(F.length("domain") + 32)).first()[0] or 0) <= limit
        some = probes.join(F.broadcast(named) if small else named, "domain", "left_semi")
        some = some.withColumn("salt", F.pmod(F.xxhash64("url", "fetched_at"), F.lit(salt)))
        met = some.join(rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))), ["domain", "salt"])
    active = met.where("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to) and startswith(p, path)")
    best = F.max(F.struct(F.length("domain").alias("d"), F.length("path").alias("n"), "valid_from", "list", "verdict", "domain", "path"))
    judged = active.groupBy("url", "fetched_at").agg(F.count("*").alias("n_active"), best.alias("b"))
    out = own.join(judged, ["url", "fetched_at"], "left")
    rule = F.when(F.col("b").isNotNull(), F.concat_ws(" ", "b.list", F.concat("b.domain", "b.path")))
    return out.select("page_id", host_of(F.col("url")).alias("host"), F.coalesce("b.verdict", F.lit("pass")).alias("verdict"), rule.alias("rule"), F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"))
