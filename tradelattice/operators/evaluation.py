"""Link-prediction metrics over scored pairs ``(src, dst, score, label)``, per model where asked.

Nothing sorts all pairs in one task: curves run over distinct scores and ranks over range-partitioned
slices, both through :mod:`tradelattice.operators.ordering`. Ties in score are ordered by (src, dst).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tradelattice.operators.ordering import ranked, running_totals, top_k, top_k_per

METRICS = ["roc_auc", "average_precision", "precision", "recall", "mrr", "hits"]


def _order():
    return [F.desc("score"), F.asc("src"), F.asc("dst")]


def curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, highest first: positives, negatives, and both accumulated."""
    counts = scored.groupBy(*by, "score").agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"), F.sum((1 - F.col("label")).cast("bigint")).alias("neg")
    )
    return running_totals(counts, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, by)


def _curve_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    p, n = F.sum(pos), F.sum(neg)
    # A positive beats the negatives scored lower and half of those tied with it.
    beaten = F.sum(pos * (neg / 2 - fp))
    return curve(scored, by).groupBy(*by).agg(
        F.try_divide(beaten + p * n, p * n).alias("roc_auc"),
        F.try_divide(F.sum(pos * tp / (tp + fp)), p).alias("average_precision"),
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive outscores a negative, ties counting half."""
    return _curve_metrics(scored, by).select(*by, "roc_auc")


def average_precision(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise area under the precision-recall curve, one step per distinct score."""
    return _curve_metrics(scored, by).select(*by, "average_precision")


def _head(scored: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    return top_k_per(scored, by, _order(), k) if by else top_k(scored, _order(), k)


def precision_at_k(scored: DataFrame, k: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Positives among the first ``k``, divided by ``k`` also when there are fewer pairs."""
    return _head(scored, k, by).groupBy(*by).agg((F.sum("label") / F.lit(float(k))).alias("precision"))


def recall_at_k(scored: DataFrame, k: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Positives among the first ``k``, divided by all positives."""
    found = _head(scored, k, by).select(*by, F.col("label").alias("_found"), F.lit(0).alias("_all"))
    every = scored.select(*by, F.lit(0).alias("_found"), F.col("label").alias("_all"))
    return found.unionByName(every).groupBy(*by).agg(F.try_divide(F.sum("_found"), F.sum("_all")).alias("recall"))


def with_rank(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranked(scored, _order(), by)


def mrr(scored: DataFrame, by: Sequence[str] = (), per: Sequence[str] = ()) -> DataFrame:
    """Mean reciprocal rank of the positives, ranked over all pairs or within each ``per`` group."""
    return with_rank(scored, [*by, *per]).where("label = 1").groupBy(*by).agg(F.avg(1.0 / F.col("rank")).alias("mrr"))


def hits_at_k(scored: DataFrame, k: int = 10, by: Sequence[str] = (), per: Sequence[str] = ()) -> DataFrame:
    """Share of the positives ranked in the first ``k``, over all pairs or within each ``per`` group."""
    hit = (F.col("rank") <= k).cast("double")
    return with_rank(scored, [*by, *per]).where("label = 1").groupBy(*by).agg(F.avg(hit).alias("hits"))


def all_metrics(scored: DataFrame, ks: Sequence[int] = (10, 20, 50), by: Sequence[str] = ()) -> DataFrame:
    """Every metric as long rows ``(*by, metric, k, value)``; ``k`` is null where it does not apply."""
    label, rank = F.col("label").cast("double"), F.col("rank")
    total = F.sum(label)
    within = {k: F.sum(F.when(rank <= k, label).otherwise(0.0)) for k in ks}
    row = lambda name, k, value: F.struct(
        F.lit(name).alias("metric"), F.lit(k).cast("int").alias("k"), value.alias("value")
    )
    ranks = with_rank(scored, by).groupBy(*by).agg(
        F.try_divide(F.sum(label / rank), total).alias("_mrr"),
        *[(n / F.lit(float(k))).alias(f"_p{k}") for k, n in within.items()],
        *[F.try_divide(n, total).alias(f"_r{k}") for k, n in within.items()],
    )
    items = [row("mrr", None, F.col("_mrr"))]
    for k in ks:
        items += [row("precision", k, F.col(f"_p{k}")), row("recall", k, F.col(f"_r{k}")), row("hits", k, F.col(f"_r{k}"))]
    of_ranks = ranks.select(*by, F.inline(F.array(*items)))
    of_curve = _curve_metrics(scored, by).select(
        *by, F.inline(F.array(*[row(m, None, F.col(m)) for m in ("roc_auc", "average_precision")]))
    )
    return of_curve.unionByName(of_ranks)


def compare_models(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long (model, metric, value) to one row per model, best average precision first."""
    wide = results.groupBy("model").pivot("metric", list(metrics)).agg(F.max("value"))
    return wide.orderBy(F.desc_nulls_last("average_precision"), "model")


def ablation(results: DataFrame, metrics: Sequence[str], baseline: str, variants: Sequence[str] = ()) -> DataFrame:
    """Comparison with the variant columns and the difference of every metric to the baseline model."""
    base = results.where(F.col("model") == baseline).select("metric", F.col("value").alias("_base"))
    both = results.join(base, "metric", "left").withColumn("delta", F.col("value") - F.col("_base"))
    wide = both.groupBy("model", *variants).pivot("metric", list(metrics)).agg(
        F.max("value").alias("value"), F.max("delta").alias("delta")
    )
    return wide.select(
        "model", *variants, *[F.col(f"{m}_value").alias(m) for m in metrics],
        *[F.col(f"{m}_delta").alias(f"delta_{m}") for m in metrics],
    ).orderBy(F.desc_nulls_last("average_precision"), "model")


def hit_test(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions with ``hit``: 1 where the pair occurs among the actuals."""
    seen = actuals.select(*keys).distinct().withColumn("hit", F.lit(1))
    return predictions.join(seen, list(keys), "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def temporal_validation(
    predictions: DataFrame, actuals: DataFrame, keys: Sequence[str], ks: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """How many of the first k predictions (by ``rank``) occur in held-out years: (*by, k, hits, hit_rate)."""
    top = hit_test(predictions.where(F.col("rank") <= max(ks)), actuals, keys)
    per_k = top.select(*by, "rank", "hit", F.explode(F.lit(list(ks))).alias("k")).where("rank <= k")
    return per_k.groupBy(*by, "k").agg(F.sum("hit").alias("hits")).withColumn("hit_rate", F.col("hits") / F.col("k"))
