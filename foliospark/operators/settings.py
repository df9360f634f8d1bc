"""Settings and endpoints as tables: stored values over defaults, what may be shown, which endpoint to call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """key, value: the stored value, or the default where none is stored or it is null."""
    own = stored.select("key", F.col("value").alias("stored"))
    return defaults.join(own, "key", "left").select("key", F.coalesce("stored", "value").alias("value"))


def save(stored: DataFrame, changes: DataFrame, secrets: tuple[str, ...] = ("api_key",)) -> DataFrame:
    """key, value after changes; a blank secret keeps the old one."""
    new = changes.filter(~(F.col("key").isin(*secrets) & (F.coalesce(F.trim("value"), F.lit("")) == ""))).select("key", F.col("value").alias("new"), F.lit(True).alias("changed"))
    joined = stored.select("key", "value").join(new, "key", "full_outer")
    return joined.select("key", F.when(F.col("changed"), F.col("new")).otherwise(F.col("value")).alias("value"))


def public(settings: DataFrame, secrets: tuple[str, ...] = ("api_key",)) -> DataFrame:
    """key, value with secrets shown as whether there is one."""
    secret = F.col("key").isin(*secrets)
    return settings.select("key", F.when(secret, (F.coalesce(F.length("value"), F.lit(0)) > 0).cast("string")).otherwise(F.col("value")).alias("value"))


def connection_error(url: Column) -> Column:
    """Why a service can't be reached at a url: no http or https, no host, credentials, a query or fragment, a port out of range; null if it can."""
    port = F.regexp_extract(url, r"^https?://[^/?#]*:([0-9]+)(?:/|$)", 1)
    return (
        F.when(~url.rlike("^https?://"), "not http or https")
        .when(url.rlike("[?#]"), "a query or fragment")
        .when(url.rlike("^https?://[^/]*@"), "credentials")
        .when(~url.rlike(r"^https?://(?:\[[0-9A-Fa-f:.]+\]|[^/:\s]+)(?::[0-9]+)?(?:/[^\s]*)?$"), "no host")
        .when((port != "") & ~F.coalesce(F.try_to_number(port, F.lit("99999")).between(1, 65535), F.lit(False)), "port out of range")
    )


def choose_endpoint(instances: DataFrame, routes: DataFrame, model: str) -> DataFrame:
    """id, endpoint: the first running instance (by id, endpoint) of a model, or else of a model that a route of that name leads to."""
    running = instances.filter("state = 'running'")
    direct = running.filter(F.col("model_id") == model).withColumn("rank", F.lit(0))
    targets = routes.filter(F.col("name") == model).select(F.col("target_model_id").alias("model_id"))
    routed = running.join(targets, "model_id", "left_semi").withColumn("rank", F.lit(1))
    best = direct.unionByName(routed).agg(F.min(F.struct("rank", "id", "endpoint")).alias("x"))
    return best.filter("x is not null").select("x.id", "x.endpoint")
