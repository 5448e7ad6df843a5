"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import as_row, given

# Hex digits of a digest that make a uniform number: 52 bits fit a double exactly.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that follows from the parts alone."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    whole_number = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double")
    return (whole_number + 0.5) / float(16**DIGITS)


def poisson_steps(rate: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, 2, ..., to far beyond its mean.

    Each term is the exponential of its logarithm, so large rates do not underflow at zero.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("log_factorial"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("steps"))

    def step(state, k):
        log_factorial = state["log_factorial"] + F.when(k > 0, F.ln(k)).otherwise(0.0)
        total = state["sum"] + F.exp(k * F.ln(rate) - rate - log_factorial)
        return F.struct(
            log_factorial.alias("log_factorial"), total.alias("sum"), F.concat(state["steps"], F.array(total)).alias("steps")
        )

    steps = F.aggregate(F.sequence(F.lit(0), last), start, step, lambda state: state["steps"])
    return F.when(rate > 0, steps).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float], rest: float, epochs: float) -> DataFrame:
    """Mean repetitions of a document of each named source; ``mix`` is null for all other rows.

    A named source gets the share of its weight among the weights of the sources that are present,
    of ``epochs`` times the number of rows. At most ``len(weights) + 1`` rows.
    """
    named = F.when(F.col("source").isin(list(weights)), F.col("source"))
    counts = docs.select(named.alias("mix")).groupBy("mix").agg(F.count("*").alias("n"))
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    weight = F.when(F.col("mix").isNull(), F.lit(float(rest))).otherwise(F.element_at(table, F.col("mix")))
    weighed = counts.withColumn("weight", weight)
    total = weighed.agg(F.sum("n").alias("rows"), F.sum("weight").alias("all")).select(
        F.struct("rows", "all").alias("total")
    )
    rate = F.col("weight") / F.col("total.all") * (F.col("total.rows") * float(epochs)) / F.col("n")
    return weighed.withColumn("total", total.scalar()).select("mix", rate.alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float], rest: float, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """Each row of ``docs`` a Poisson number of times, in a global order of hashes.

    The number is the Poisson quantile, for the mean of the row's source, of a uniform number that is
    hashed from the seed and the id: it does not depend on how rows are placed, and rows with
    one id are repeated alike. ``weights`` must be positive; rows of sources that it does not name,
    null included, share the weight ``rest``. The table of rates has at most one row per weight
    and one more, and is broadcast. Returns ``row`` (all columns of ``docs``), ``rate``, ``copy``
    (from 1) and ``shuffle_key``.
    """
    if not weights or min(weights.values()) <= 0 or rest < 0:
        raise ValueError("weights must be positive, and the rest not negative")
    lookup = F.broadcast(rates(docs, weights, rest, epochs).withColumn("steps", poisson_steps(F.col("rate"))))
    named = F.when(F.col("source").isin(list(weights)), F.col("source"))
    rows = docs.select(as_row(docs), named.alias("named"), uniform(F.lit(seed), F.col("doc_id")).alias("point"))
    joined = rows.join(lookup, F.col("named").eqNullSafe(F.col("mix")))
    copies = F.size(F.filter("steps", lambda reached: reached < F.col("point")))
    copy = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))
    number = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}/shuffle"), number, "copy"))
    return joined.select("row", "rate", copy.alias("copy")).select("*", key.alias("shuffle_key")).orderBy("shuffle_key")


def mix(docs: DataFrame, weights: dict[str, float], rest: float, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """``replicate`` with the columns of ``docs``, then ``rate``, ``copy`` and ``shuffle_key``, which take
    the place of given columns of these names."""
    added = ["rate", "copy", "shuffle_key"]
    return replicate(docs, weights, rest, epochs, seed).select(*given(docs.columns, added), *added)


def remix(docs: DataFrame, weights: dict[str, float], rest: float, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """``replicate`` with the columns of ``docs`` alone, all unchanged."""
    return replicate(docs, weights, rest, epochs, seed).select("row.*")
