"""Bayesian models over events: joint, marginal, posterior and the best event, all as one join and grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.prob import ln_sum_exp


def posterior(prior: DataFrame, likelihood: DataFrame, event: str, data: str, ln_prior: str = "ln_prior", ln_likelihood: str = "ln_likelihood") -> DataFrame:
    """(data, event, ln_joint, ln_marginal, ln_posterior) for every event of each data set. Both logs may be minus infinity."""
    joint = likelihood.join(prior.select(event, ln_prior), event).select(data, event, (F.col(ln_prior) + F.col(ln_likelihood)).alias("ln_joint"))
    marginal = ln_sum_exp(joint, [data], "ln_joint", "ln_marginal")
    return joint.join(marginal, data).withColumn("ln_posterior", F.col("ln_joint") - F.col("ln_marginal"))


def from_marginal(joint: DataFrame, marginal: DataFrame, data: str) -> DataFrame:
    """The same with a marginal that is given."""
    return joint.join(marginal, data).withColumn("ln_posterior", F.col("ln_joint") - F.col("ln_marginal"))


def maximum_posterior(post: DataFrame, event: str, data: str) -> DataFrame:
    """The most probable event of each data set; the smallest of ties."""
    return post.groupBy(data).agg(F.min_by(event, F.struct(-F.col("ln_posterior"), F.col(event))).alias(event), F.max("ln_posterior").alias("ln_posterior"))


def ranked_posteriors(post: DataFrame, event: str, data: str) -> DataFrame:
    w = Window.partitionBy(data).orderBy(F.desc("ln_posterior"), event)
    return post.withColumn("rank", F.row_number().over(w))


def expected_value(post: DataFrame, event: str, data: str) -> DataFrame:
    """The posterior mean of numeric events."""
    return post.groupBy(data).agg(F.sum(F.col(event) * F.exp("ln_posterior")).alias("expected"))
