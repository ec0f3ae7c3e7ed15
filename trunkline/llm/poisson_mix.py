"""Mixing sources to target weights by Poisson replication.

Source s with n_s of all N documents and target share w_s gets the mean repetition rate
w_s * N / n_s. Each document's repetition count inverts the Poisson distribution of that mean
at a uniform number seeded by a hash of (seed, doc_id); documents are exploded by their counts
and dealt out by a hash of (seed, doc_id, copy), in that order within a partition: a global
shuffle that depends on nothing but seed and ids.

By default w_s is proportional to n_s ** ``TEMPERATURE``. All of it is built-in expressions;
source counts combine before their shuffle, and the rates are broadcast only where there are
at most ``BROADCAST_SOURCES`` sources.

Nulls: a null source is a source of its own; a null doc_id hashes as an empty string. Repeated
rows get equal counts, so ties of the order are equal rows. Extra columns stay, but ``copy`` and ``place`` of the input
give way to the operator's. An empty table gives none; texts are only carried, whatever their length. Rates above
``MAX_RATE`` are an error (exp underflows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trunkline.llm.common import documents, quoted, stored

TEMPERATURE = 0.7
SEED = "mix-1"
BROADCAST_SOURCES = 10_000
MAX_RATE = 500.0


def hash_unit(*parts) -> F.Column:
    """The first 32 bits of an MD5, over 2**32."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_rates(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate): one row for each source of ``docs``; sources absent from ``weights`` get 0."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    sized = stored(sizes.withColumn("share", share), "mix-sizes")
    total = sized.agg(F.sum("n").alias("n"), F.sum("share").alias("share")).first()  # two numbers
    if not total["share"]:
        return sized.select("source", F.lit(0.0).alias("rate"))
    rate = F.col("share") / F.lit(total["share"]) * F.lit(total["n"]) / F.col("n")
    return sized.select("source", F.round(rate, 6).alias("rate"))


def poisson_count(rate: F.Column, unit: F.Column) -> F.Column:
    """The smallest k whose Poisson distribution function exceeds ``unit``."""
    steps = F.sequence(F.lit(1), (rate + 12 * F.sqrt(rate) + 40).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))

    def step(acc, i):
        p = acc["p"] * rate / i
        return F.when(unit >= acc["c"], F.struct(p.alias("p"), (acc["c"] + p).alias("c"), (acc["k"] + 1).alias("k"))).otherwise(acc)

    return F.aggregate(steps, start, step, lambda acc: acc["k"])


def mixed(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """Rows of ``docs`` as often as drawn, with ``copy`` (from 0) and ``place`` (0 to 1), globally shuffled."""
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ("copy", "place")])
    rates = stored(source_rates(docs, weights, temperature).select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate")), "mix-rates")
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(rates) if small else rates, docs["source"].eqNullSafe(F.col("__mix_source")))
    mean = F.col("__mix_rate")
    rate = F.when(mean > MAX_RATE, F.raise_error(F.lit(f"a mean repetition rate is above {MAX_RATE}")).cast("double")).otherwise(mean)
    counted = joined.withColumn("__mix_count", poisson_count(rate, hash_unit(F.lit(seed), F.col("doc_id")))).where("__mix_count > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__mix_count") - 1)))
    placed = copies.withColumn("place", hash_unit(F.lit(seed), F.col("doc_id"), F.col("copy"))).drop("__mix_source", "__mix_rate", "__mix_count")
    return placed.repartition("place", "doc_id", "copy").sortWithinPartitions("place", "doc_id", "copy")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy with its whole text: doc_id, source, copy, place, text."""
    return mixed(documents(spark, sf_dir)).select("doc_id", "source", "copy", "place", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


ORACLE = f"""
WITH s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS share FROM documents GROUP BY source),
r AS (SELECT source, round(share / (SELECT sum(share) FROM s) * (SELECT sum(n) FROM s)::DOUBLE / n, 6) AS rate FROM s),
p AS (SELECT source, rate, i, exp(-rate) * pow(rate, i) / gamma(i + 1) AS mass FROM r, range(0, 100) t(i)),
c AS (SELECT source, i, sum(mass) OVER (PARTITION BY source ORDER BY i) AS cdf FROM p),
u AS (SELECT doc_id, source, text, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS unit FROM documents),
k AS (SELECT u.doc_id, u.source, any_value(u.text) AS text, count(*) AS n_copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND u.unit >= c.cdf GROUP BY u.doc_id, u.source),
e AS (SELECT doc_id, source, text, unnest(range(0, n_copies))::INT AS copy FROM k)
SELECT doc_id, source, copy, ('0x' || substr(md5('{SEED}|' || doc_id || '|' || copy), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS place, text FROM e
"""
