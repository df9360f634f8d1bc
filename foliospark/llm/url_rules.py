"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule on a host and a path covers the host, its subdomains and all paths that start with its path.
With the labels of the host reversed, `host/path` becomes a key (`net.example/` + path); the keys that a
rule covers are those that start with its own, an interval of the sorted order, and intervals of rules
nest or are disjoint. A url has one such key for each ending of its host, so all rules that fit it are
prefixes of one of its keys.

The sweep goes over the sorted keys once. A rule opens at its key and closes behind all keys that start with
it; the number of rules that are open is the height of the stack at a key, and the rule on top of it, the
longest that fits, is the one that brought the stack to this height last. A rule and the keys that it fits
have the same host part, so no other rules and keys need to be sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialise

DEFAULT_VERDICT = "allow"
#: Urls of one host part in one sweep, unless it has more rules; hosts with rules that are broadcast at most.
PART_ROWS, BROADCAST_SITES = 100_000, 10_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without one."""
    rest = _rest(url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _key(labels: Column, depth: Column, path: Column) -> Column:
    """The last `depth` labels of a host, last first, a slash and the path."""
    return F.concat(F.array_join(F.slice(F.reverse(labels), F.lit(1), depth), "."), F.lit("/"), path)


def keyed_rules(rules: DataFrame) -> DataFrame:
    """key, length (of host and path), rule, verdict: each distinct key of rules(host, path, verdict). Of rules with one host and path, block wins."""
    host, path = F.lower(F.coalesce(rules["host"], F.lit(""))), F.coalesce(rules["path"], F.lit(""))
    labels = F.split(host, r"\.")
    keyed = rules.select(_key(labels, F.size(labels), path).alias("key"), (F.length(host) + F.length(path)).alias("length"), F.concat(host, path).alias("rule"), F.coalesce(rules["verdict"], F.lit(DEFAULT_VERDICT)).alias("verdict"))
    return keyed.groupBy("key", "length", "rule").agg(F.max("verdict").alias("verdict"))


def sweep(rules: DataFrame, keys: DataFrame, group: list[str]) -> DataFrame:
    """keys(group, key, ...) with top: the innermost rule that is open at a key, of rules(group, key, entry) with distinct keys in a group; null if none is.

    Opening events come before keys like theirs; closing ones have a byte behind their key that no text has,
    greater than all that texts have, so they come behind every key that starts with theirs and before the
    closing of rules around them.
    """
    raw, none = F.encode("key", "UTF-8"), rules.schema["entry"].dataType
    more = [c for c in keys.columns if c not in (*group, "key")]
    blank = [F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in more]
    opens = rules.select(*group, raw.alias("at"), F.lit(0).alias("kind"), "entry", F.lit(1).alias("step"), *blank)
    closes = rules.select(*group, F.concat(raw, F.lit(b"\xff")).alias("at"), F.lit(2).alias("kind"), F.lit(None).cast(none).alias("entry"), F.lit(-1).alias("step"), *blank)
    asked = keys.select(*group, raw.alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(none).alias("entry"), F.lit(0).alias("step"), *more)
    events = opens.unionByName(closes).unionByName(asked)
    so_far = Window.partitionBy(*group).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # after a closing event the stack is lower, and what is on top of it then was opened before
    at_height = Window.partitionBy(*group, "height").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("height", F.sum("step").over(so_far)).withColumn("top", F.last("entry", ignorenulls=True).over(at_height))
    return swept.filter("kind = 1").select(*group, F.decode("at", "UTF-8").alias("key"), *more, F.when(F.col("height") > 0, F.col("top")).alias("top"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages(page_id, url, ...).

    The fitting rule with the longest host and path wins (ties: the longer host, then block); without one
    rule is null and the verdict the default. Keys whose host part has no rule go at once. The others are
    dealt by host part, one that many urls have in several salted parts of about PART_ROWS or as many
    urls as it has rules, and rules go to the parts of their host only, so there are never more copies of
    rules than urls and rules together. Each part is sorted and swept.

    Null url or one without ://: host and path are empty and no rule fits. Null rule host or path: empty
    (an empty host fits nothing). Null page_id: kept. Repeated rows: a row each. Empty tables: no rows, or
    the default for all. Other columns are ignored.
    """
    url = pages["url"].cast("string")
    own = pages.select(pages["page_id"].cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = materialise(own.withColumn("row", F.monotonically_increasing_id()), "urls")
    named = keyed_rules(rules).withColumn("site", F.substring_index("key", "/", 1)).filter("site <> ''")
    named = materialise(named.select("site", "key", F.struct("length", "verdict", "rule").alias("entry")), "rules")
    depth = named.agg(F.max(F.size(F.split("site", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    keys = own.filter("host <> ''").withColumn("level", F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))))).select("row", "level", _key(labels, F.col("level"), F.col("path")).alias("key"))
    keys = keys.withColumn("site", F.substring_index("key", "/", 1))
    ruled = named.groupBy("site").agg(F.count(F.lit(1)).alias("rules"))
    few = depth and named.select("site").distinct().count() <= BROADCAST_SITES
    met = keys.join(F.broadcast(ruled.select("site")) if few else ruled.select("site"), "site", "left_semi").groupBy("site").agg(F.count(F.lit(1)).alias("urls"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("urls") / F.greatest(F.lit(PART_ROWS), F.col("rules")))).cast("int").alias("parts")
    sites = materialise(met.join(ruled, "site").select("site", "urls", parts), "sites")
    asked = join_counted(keys, sites, "site", "urls").select("site", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "key", "row", "level")
    dealt = named.join(sites, "site").select("site", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", "entry")
    swept = sweep(dealt, asked, ["site", "part"]).filter("top is not null")
    found = swept.select("row", F.struct(F.col("top.length").alias("length"), "level", F.col("top.verdict").alias("verdict"), F.col("top.rule").alias("rule")).alias("best"))
    none = own.select("row", F.lit(None).cast(found.schema["best"].dataType).alias("best"), "page_id", "host", "path")
    every = none.unionByName(found, allowMissingColumns=True).groupBy("row").agg(F.max("best").alias("best"), *(F.max(c).alias(c) for c in ("page_id", "host", "path")))
    return every.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
