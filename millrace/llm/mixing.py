"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its share of the target weight times the wanted number of rows, over its rows. Each
document draws its number of copies by inverting the Poisson distribution of that rate at a uniform number hashed
from (seed, id), is exploded by that count, and all copies are shuffled by a hash of (seed, id, copy). The draw
depends on the document and its source's rate alone, so retries and other partitions give the same rows.

Defined results:
* source weights come from ``weights`` (a source that is not named gets 0 and drops out) or, without it, from the
  source's rows to the power ``temperature``; a null source is a source of its own, weighted under the key None;
* rows with a null id or repeated ids draw like any other: equal ids draw equally;
* the text takes no part: null, empty and very long texts are replicated alike;
* an empty table gives an empty table; new columns whose names clash get an underscore in front.

A rate is split into equal draws of at most 16 each, as a Poisson count of a sum is the sum of counts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded, cut, every, unique_name

DRAW_RATE = 16
#: Terms of the distribution that are kept: above them lies less than 1e-12 for a rate of 16.
TERMS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the parts' MD5, the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_distribution(rate: Column) -> Column:
    """P(X <= k) for k from 0: an array of ``TERMS`` doubles."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step)["c"]


def source_rates(docs: DataFrame, source_col: str = "source", weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, total: float | None = None) -> DataFrame:
    """(source, n_rows, rate): the mean number of copies of each source's documents."""
    sizes = cut(docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_rows")))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, weight double")
        weighed = sizes.join(given, sizes["source"].eqNullSafe(given["s"]), "left").drop("s").fillna(0.0, ["weight"])
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("n_rows").alias("n")).first()
    all_weight, rows = float(sums["w"] or 0.0), float(total if total is not None else sums["n"] or 0.0)
    rate = F.col("weight") / (all_weight or 1.0) * rows / F.col("n_rows")
    return weighed.select("source", "n_rows", rate.alias("rate"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, total: float | None = None, seed: int = 42) -> DataFrame:
    """Copies of ``docs`` in shuffled order, with ``copy`` (from 1) and ``shuffle_key``.

    Rows lie in partitions by a hash of the key and are sorted by it inside each.
    """
    rate, draws, dist, src = (unique_name(docs, n) for n in ("rate", "draws", "distribution", "rate_source"))
    rates = source_rates(docs, source_col, weights, temperature, total).where("rate > 0")
    n_draws = F.ceil(F.col("rate") / DRAW_RATE).cast("int")
    table = cut(rates.select(F.col("source").alias(src), n_draws.alias(draws), poisson_distribution(F.col("rate") / n_draws).alias(dist)))
    joined = docs.join(bounded(table, 10_000), F.col(source_col).eqNullSafe(F.col(src)))
    ident = F.col(id_col)

    def draw(k: Column) -> Column:
        u = uniform(F.lit(seed), ident, k)
        return F.size(F.filter(F.col(dist), lambda c: c <= u))

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(draws)), draw), F.lit(0), lambda a, x: a + x)
    copy, key = unique_name(docs, "copy"), unique_name(docs, "shuffle_key")
    counted = joined.select(*every(docs), count.alias(copy)).where(F.col(copy) > 0)
    copies = counted.select(*every(docs), F.explode(F.sequence(F.lit(1), F.col(copy))).alias(copy))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), F.coalesce(ident.cast("string"), F.lit("~")), F.col(copy).cast("string"))), 1, 15), 16, 10).cast("long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.withColumn(key, order).repartition(n, key).sortWithinPartitions(key)


def op1_mix(docs: DataFrame) -> DataFrame:
    return mix_sources(docs)


OP1_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
  SELECT source, (sqrt(n) / sum(sqrt(n)) OVER ()) * (sum(n) OVER ()) / n AS rate FROM sizes
), split AS (SELECT source, CAST(ceil(rate / 16) AS BIGINT) AS draws, rate / ceil(rate / 16) AS r FROM rates
), pmf AS (
  SELECT source, draws, k, exp(-r + k * ln(r) - lgamma(k + 1)) AS p FROM split, range(64) t(k)
), cdf AS (
  SELECT source, draws, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf
), dist AS (SELECT source, any_value(draws) AS draws, list(c ORDER BY k) AS cs FROM cdf GROUP BY source
), drawn AS (
  SELECT documents.*, cs, CAST(('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || d), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents JOIN dist ON documents.source IS NOT DISTINCT FROM dist.source, LATERAL (SELECT unnest(range(1, draws + 1)) AS d)
), counted AS (
  SELECT doc_id, text, lang, source, n_chars, CAST(sum(len(list_filter(cs, lambda c: c <= u))) AS BIGINT) AS copies
  FROM drawn GROUP BY doc_id, text, lang, source, n_chars
), copied AS (
  SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM counted
)
SELECT *, CAST(('0x' || substr(md5('42:order|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || copy), 1, 15)) AS BIGINT) AS shuffle_key FROM copied
"""
