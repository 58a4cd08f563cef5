"""Ranking metrics and focal loss on scored tables.

ROC AUC (ties count half, one class -> 0.0), step-wise average precision and
the precision/recall table all come from one cumulative table over distinct
scores in descending order.  Its running sums are exact and distributed
(``operators.ranges``): the scores are cut into ranges that are split until each
holds a bounded number of distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigwin.functions.columns import focal_loss_terms
from sigwin.operators.ranges import running_before


def score_table(df: DataFrame, label: str = "label", score: str = "score",
                by: list[str] | None = None, sums: list[Column] | None = None) -> DataFrame:
    """Distinct scores (per group) with the positives and negatives at each,
    plus the counts at strictly higher scores (tp_before, fp_before) and any
    other aliased ``sums`` over the rows of a score."""
    by = list(by or [])
    per = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("long").alias("fp"), *(sums or []))
    return running_before(per, "threshold", ["tp", "fp"], by=by, descending=True)


def _auc() -> Column:
    """The area over the rows of a score table: pairs won, ties as halves."""
    won = F.sum(F.col("fp") * (F.col("tp_before") + F.lit(0.5) * F.col("tp")))
    pairs = F.sum("tp").cast("double") * F.sum("fp").cast("double")
    return F.when(pairs > 0, won / pairs).otherwise(F.lit(0.0)).alias("auc")


def _ap() -> Column:
    """Precision at each score of a score table, weighted by the recall gained there."""
    cum_tp = F.col("tp_before") + F.col("tp")
    precision = cum_tp / (cum_tp + F.col("fp_before") + F.col("fp"))
    positives = F.sum("tp").cast("double")
    return (F.when(positives > 0, F.sum(F.col("tp") * precision) / positives)
            .otherwise(F.lit(0.0)).alias("ap"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            by: list[str] | None = None) -> DataFrame:
    """auc per group (one row without ``by``): Mann-Whitney form over
    distinct scores, ties count half, one class only gives 0.0."""
    by = list(by or [])
    return score_table(df, label, score, by).groupBy(*by).agg(_auc())


def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      by: list[str] | None = None) -> DataFrame:
    """ap per group = sum over thresholds of (R_n - R_{n-1}) * P_n."""
    by = list(by or [])
    return score_table(df, label, score, by).groupBy(*by).agg(_ap())


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tp, fp, precision, recall) per distinct score, with the
    counts of rows scoring >= threshold."""
    t = score_table(df, label, score)
    positives = df.where(F.col(label) == 1).count()
    cum_tp = F.col("tp_before") + F.col("tp")
    cum_fp = F.col("fp_before") + F.col("fp")
    recall = (cum_tp / F.lit(float(positives))) if positives else F.lit(None).cast("double")
    return t.select("threshold", cum_tp.alias("tp"), cum_fp.alias("fp"),
                    (cum_tp / (cum_tp + cum_fp)).alias("precision"), recall.alias("recall"))


def focal_loss(df: DataFrame, label: str = "label", z0: str = "z0", z1: str = "z1",
               alpha: float = 1.0, gamma: float = 2.0, reduction: str = "mean",
               by: list[str] | None = None):
    """Focal loss from two logits.  reduction 'none' adds a per-row ``loss``;
    'mean' / 'sum' aggregate (per group with ``by``)."""
    terms = focal_loss_terms(label, z0, z1, alpha, gamma)
    if reduction == "none":
        return df.withColumn("loss", terms)
    agg = F.avg(terms) if reduction == "mean" else F.sum(terms)
    return df.groupBy(*(by or [])).agg(agg.alias("loss"))


def prob_to_logits(p: str, eps: float = 1e-7):
    """Logits (0, logit(p)) of a class-1 probability, clamped away from 0 / 1."""
    c = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return F.lit(0.0), F.log(c / (F.lit(1.0) - c))


def metric_report(df: DataFrame, split="split", label: str = "label",
                  z0: str = "z0", z1: str = "z1", score: str = "score",
                  alpha: float = 1.0, gamma: float = 2.0) -> DataFrame:
    """(split..., n, loss, auc, ap) per split value; ``split`` may be a list
    of columns.  One score table, which carries the losses too, gives all four."""
    by = [split] if isinstance(split, str) else list(split)
    terms = focal_loss_terms(label, z0, z1, alpha, gamma)
    t = score_table(df, label, score, by,
                    [F.sum(terms).alias("loss_sum"), F.count(terms).alias("loss_n")])
    return t.groupBy(*by).agg(
        F.sum(F.col("tp") + F.col("fp")).alias("n"),
        F.try_divide(F.sum("loss_sum"), F.sum("loss_n")).alias("loss"), _auc(), _ap())
