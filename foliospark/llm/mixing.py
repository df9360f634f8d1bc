"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: The table of sources is sent to all tasks only if it has at most so many rows; otherwise Spark joins it by shuffle and splits the hot sources.
BROADCAST_SOURCES = 10_000
#: Largest mean of one Poisson draw (its table starts at exp(-mean)); a greater rate is the sum of several.
MAX_RATE = 500.0


def uniform(key, seed: int | str) -> F.Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:key)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate) -> F.Column:
    """P(X <= k) for k from 0 until the tail is below 1e-17 or so, as an array; [] for a null rate."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    step = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf")),
        lambda acc: acc["cdf"],
    )
    return F.coalesce(step, F.array().cast("array<double>"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float) -> tuple[DataFrame, int]:
    """(source_key, rate) and the number of sources. rate: mean repetitions of a source's documents so that its share of the output is its weight. weights None: the same for each source; a source without a weight: 0. The output has epochs times as many documents on average."""
    key = F.coalesce(docs["source"].cast("string"), F.lit(""))
    counts = docs.select(key.alias("source_key")).groupBy("source_key").agg(F.count(F.lit(1)).alias("docs"))
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k or "", float(v)) for k, v in weights.items()], "source_key string, weight double")
        weighted = counts.join(given, "source_key", "left").fillna(0.0, ["weight"])
    n, w, sources = weighted.agg(F.sum("docs"), F.sum("weight"), F.count(F.lit(1))).first()
    if not w:
        return weighted.select("source_key", F.lit(0.0).alias("rate")), sources
    rate = F.lit(float(epochs)) * F.col("weight") / F.lit(float(w)) * F.lit(float(n)) / F.col("docs")
    return weighted.select("source_key", rate.alias("rate")), sources


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """docs(doc_id, source, ...) with copy_no and mix_key, each row as often as its Poisson draw says, in a global random order.

    The count of a row is the Poisson quantile, at its source's mean repetition rate, of a uniform number
    hashed from seed and doc_id; the same doc_id and seed always draw alike. A rate above MAX_RATE is split
    into equal parts up to it, and the count is the sum of a draw for each part, whose number is hashed in from the second on. A row of count c becomes
    copies 1..c. Rows are dealt to partitions by mix_key, a hash of (seed, doc_id, copy), and lie in its order within.

    Null source: a source of its own, equal to ''. Null doc_id: drawn as the text ''. Repeated rows
    draw the same count. Empty table: no rows. Columns named like copy_no or
    mix_key are replaced; other columns are kept.
    """
    source, cdf, count, name = (unused(docs, x) for x in ("source_key", "cdf", "count", "ident"))
    parts = unused(docs, "parts")
    rates, sources = source_rates(docs, weights, epochs)
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE).cast("int")))
    rates = rates.select(F.col("source_key").alias(source), F.col("parts").alias(parts), poisson_cdf(F.col("rate") / F.col("parts")).alias(cdf))
    if sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    names = [c for c in docs.columns if c not in ("copy_no", "mix_key")]
    docs = docs.withColumn(source, F.coalesce(docs["source"].cast("string"), F.lit("")))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
    further = F.aggregate(F.sequence(F.lit(2), F.col(parts)), F.lit(0), lambda acc, no: acc + draw(uniform(F.concat(no.cast("string"), F.lit(":"), ident), f"{seed}/")))
    joined = docs.join(rates, source)
    counted = joined.withColumn(count, draw(uniform(ident, seed)) + F.when(F.col(parts) > 1, further).otherwise(0))
    copies = counted.filter(F.col(count) > 0).select(*names, ident.alias(name), F.explode(F.sequence(F.lit(1), F.col(count))).alias("copy_no"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(name), F.lit(":"), F.col("copy_no").cast("string")))
    keyed = copies.withColumn("mix_key", key).select(*names, "copy_no", "mix_key")
    # adaptive execution gives the parts their size, by joining small ones and splitting large ones
    return keyed.hint("rebalance", "mix_key").sortWithinPartitions("mix_key")


def mixing_sql(epochs: float = 1.0, seed: int = 17) -> str:
    """mix_sources with equal weights, in DuckDB, from the view documents."""
    return f"""
with recursive s as (
  select coalesce(source, '') source_key, count(*) docs from documents group by 1),
t as (select sum(docs) n, count(*) w from s),
m as (select source_key, {float(epochs)}::double * 1.0::double / w::double * n::double / docs mean from s, t),
r as (select source_key, greatest(1, ceil(mean / {MAX_RATE}::double))::int parts, mean / greatest(1, ceil(mean / {MAX_RATE}::double)) rate from m),
c as (
  select source_key, rate, 0 k, exp(-rate) p, exp(-rate) cdf from r
  union all
  select source_key, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) from c where k < ceil(rate + 10 * sqrt(rate) + 20)),
d as (
  select *, row_number() over () row_no, coalesce(source, '') source_key, coalesce(doc_id::varchar, '') ident from documents),
p as (
  select row_no, d.source_key, case when no = 1 then '{seed}:' else '{seed}/:' || no || ':' end || ident draw
  from d join r using (source_key), lateral (select unnest(generate_series(1, parts)) no)),
u as (
  select row_no, source_key, ('0x' || substr(md5(draw), 1, 13))::bigint::double / 4503599627370496.0::double u from p),
k as (
  select row_no, sum((select count(*) from c where c.source_key = u.source_key and c.cdf <= u.u))::bigint cnt from u group by row_no),
n as (
  select d.*, cnt from d join k using (row_no))
select doc_id, text, lang, source, n_chars, copy_no::int copy_no,
  md5('{seed}:' || coalesce(doc_id::varchar, '') || ':' || copy_no) mix_key
from n, lateral (select unnest(generate_series(1, cnt)) copy_no)
"""
