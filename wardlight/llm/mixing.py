"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A source of a higher rate draws the sum of several counts of at most this mean, which has the same distribution.
MEAN_AT_ONCE = 16.0
#: Terms of the cumulated distribution of a mean up to MEAN_AT_ONCE; the rest is below 2^-53.
TERMS = 90
#: Rate tables of more sources than this aren't broadcast.
BROADCAST_SOURCES = 20_000
#: Into so many parts each source is dealt where the rate table isn't broadcast.
SALTS = 32


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 digest as a number in [0, 1)."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_rates(df: DataFrame, weights: dict[str, float], default_weight: float, source_col: str, text_col: str) -> tuple[DataFrame, int]:
    """A row per source with the cumulated distribution of its repetitions, and the number of rows.

    Sizes come from one aggregation with partial sums and are written, a row per source; the
    driver gets only the two grand totals.
    """
    sizes = df.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source")).agg(
        F.sum(F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("bigint")).alias("chars")
    )
    weight = F.lit(float(default_weight))
    for name, value in sorted(weights.items()):
        weight = F.when(F.col("mix_source") == name, F.lit(float(value))).otherwise(weight)
    sizes = materialize(sizes.withColumn("weight", weight), "mix-sizes")
    total = sizes.agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight"), F.count("*").alias("sources")).first()
    if total["chars"] and total["weight"]:
        rate = F.when(F.col("chars") > 0, F.col("weight") / F.lit(total["weight"]) * F.lit(float(total["chars"])) / F.col("chars")).otherwise(0.0)
    else:
        rate = F.lit(0.0)
    rates = sizes.select("mix_source", rate.alias("rate"))
    draws = F.greatest(F.ceil(F.col("rate") / MEAN_AT_ONCE), F.lit(1)).cast("int")
    rates = rates.withColumn("draws", draws).withColumn("mean", F.col("rate") / F.col("draws"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.array(F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"))),
        lambda a, k: F.concat(
            a,
            F.array(
                F.struct(
                    (F.element_at(a, -1)["p"] * F.col("mean") / k).alias("p"),
                    (F.element_at(a, -1)["c"] + F.element_at(a, -1)["p"] * F.col("mean") / k).alias("c"),
                )
            ),
        ),
    )
    return rates.withColumn("cdf", F.transform(steps, lambda s: s["c"])), total["sources"]


def poisson_mix(
    df: DataFrame,
    weights: dict[str, float],
    default_weight: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """Repeats each document a Poisson number of times and shuffles the copies over the whole output.

    A source of weight w (default_weight where weights has none; null counts as the source "")
    is to hold the share w / sum of weights of the characters, of which there are as many as
    before: its mean rate is share * all characters / own characters. The count of a document
    inverts the cumulated Poisson distribution of that rate at a number hashed from seed, id and text,
    so it is the same in every run and needs no state. Only rows of equal ids and texts draw equal counts. A source without characters has rate 0. Empty tables give empty results.

    Result: df's columns and copy_no (int, from 1), shuffle_key (string); a column of these names
    in df is replaced. Copies are dealt by the hash of shuffle_key and sorted by it within
    partitions, which orders them at random and evenly, however large one source is.
    """
    columns = [c for c in df.columns if c not in ("copy_no", "shuffle_key")]
    rates, sources = source_rates(df, weights, default_weight, source_col, text_col)
    rows = df.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"), F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))).alias("mix_id"))
    if sources <= broadcast_sources:
        joined = rows.join(F.broadcast(rates), "mix_source")
    else:
        salt = F.pmod(F.xxhash64("mix_id"), F.lit(SALTS)).cast("int")
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", salt).join(salted, ["mix_source", "salt"])
    numbers = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: uniform(F.lit(str(seed)), F.col("mix_id"), j.cast("string")))
    drawn = F.aggregate(F.col("numbers"), F.lit(0), lambda total, u: total + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    counted = joined.withColumn("numbers", numbers).withColumn("copies", drawn)
    copies = counted.where("copies > 0").select("row", "mix_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    keyed = copies.select("row.*", "copy_no", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.col("mix_id"), F.col("copy_no").cast("string"))).alias("shuffle_key"))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def oracle(weights: dict[str, float], default_weight: float, seed: int, docs: str = "documents") -> str:
    """DuckDB SQL of poisson_mix over a table `docs` with the columns of documents."""
    cases = "".join(f"WHEN src = '{name}' THEN CAST({value!r} AS DOUBLE) " for name, value in sorted(weights.items()))
    weight = f"CASE {cases}ELSE CAST({float(default_weight)!r} AS DOUBLE) END"
    return f"""
WITH rows_in AS (SELECT *, coalesce(source, '') AS src, coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS mid FROM {docs}),
sizes AS (SELECT src, sum(coalesce(length(text), 0))::BIGINT AS chars FROM rows_in GROUP BY src),
weighed AS (SELECT *, {weight} AS w FROM sizes),
rates AS (SELECT src, CASE WHEN chars > 0 THEN w / (SELECT sum(w) FROM weighed) * (SELECT sum(chars) FROM weighed)::DOUBLE / chars ELSE 0.0 END AS rate FROM weighed),
means AS (SELECT src, greatest(ceil(rate / {MEAN_AT_ONCE}), 1)::INT AS draws, rate / greatest(ceil(rate / {MEAN_AT_ONCE}), 1) AS mean FROM rates),
terms AS (SELECT src, k, CASE WHEN mean > 0 THEN exp(-mean + k * ln(mean) - lgamma(k + 1)) WHEN k = 0 THEN 1.0 ELSE 0.0 END AS p FROM means, generate_series(0, {TERMS}) g(k)),
cdf AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM terms),
draws AS (SELECT DISTINCT mid, src, j, ('0x' || substr(md5('{seed}|' || mid || '|' || j), 1, 13))::BIGINT / {float(1 << 52)} AS u FROM (SELECT DISTINCT mid, src, draws FROM rows_in JOIN means USING (src)) q, LATERAL (SELECT unnest(generate_series(1, draws)) AS j) s),
counts AS (SELECT mid, src, count(*) AS copies FROM draws JOIN cdf USING (src) WHERE c <= u GROUP BY mid, src)
SELECT doc_id, text, lang, source, n_chars, copy_no::INT AS copy_no, md5('{seed}|order|' || mid || '|' || copy_no) AS shuffle_key
FROM (SELECT r.*, unnest(generate_series(1, copies)) AS copy_no FROM rows_in r JOIN counts USING (mid, src)) e
"""
