"""Ensembles, labels and metrics of two-class predictions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.tables import running

#: The weights of the weighted ensemble and the threshold of the other.
SVM_PRESENCE, GLM_ABSENCE, THRESHOLD = 0.6, 0.8, 0.55


def ensemble_weighted(svm_p: Column, svm_a: Column, glm_p: Column, glm_a: Column) -> Column:
    """Struct (presence, absence, label); a tie is Absence."""
    p = SVM_PRESENCE * svm_p + (1 - SVM_PRESENCE) * glm_p
    a = GLM_ABSENCE * glm_a + (1 - GLM_ABSENCE) * svm_a
    return F.struct(F.round(p, 6).alias("presence"), F.round(a, 6).alias("absence"), F.when(F.round(p, 9) > F.round(a, 9), "Presence").otherwise("Absence").alias("label"))


def ensemble_threshold(absence: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(absence > threshold, "Absence").otherwise("Presence")


def ensemble_rule(glm_a: Column, svm_label: Column, threshold: float) -> Column:
    return F.when(glm_a > threshold, "Absence").otherwise(svm_label)


def threshold_label(p: Column, threshold: float | Decimal, yes: str, no: str) -> Column:
    """yes from the threshold on, no up to its complement, Uncertain between; ties are exact in decimals."""
    return F.when(p >= threshold, yes).when(p <= 1 - threshold, no).otherwise("Uncertain")


def confidence_band(c: Column) -> Column:
    """Five bands by their fixed least values, and Unknown."""
    return F.when(c.isNull(), "Unknown").when(c >= 0.9, "Very High").when(c >= 0.8, "High").when(c >= 0.7, "Medium").when(c >= 0.6, "Low").otherwise("Very Low")


def metrics(df: DataFrame, truth: str, guess: str, positive: str, negative: str) -> DataFrame:
    """One row: counts, accuracy, kappa, sensitivity, specificity, precision, F1 and F2."""
    at = lambda t, g: F.sum(((F.col(truth) == t) & (F.col(guess) == g)).cast("long"))
    n = df.agg(at(positive, positive).alias("tp"), at(negative, positive).alias("fp"), at(positive, negative).alias("fn"), at(negative, negative).alias("tn"))
    all_ = F.expr("tp + fp + fn + tn")
    chance = F.expr("((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))")
    accuracy = F.expr("tp + tn") / all_
    r = lambda c, name: F.round(c, 6).alias(name)
    f = lambda b: F.expr(f"(1 + {b * b}) * tp / ((1 + {b * b}) * tp + {b * b} * fn + fp)")
    return n.select("tp", "fp", "fn", "tn", r(accuracy, "accuracy"), r((accuracy - chance) / (1 - chance), "kappa"), r(F.expr("tp / (tp + fn)"), "sensitivity"), r(F.expr("tn / (tn + fp)"), "specificity"), r(F.expr("tp / (tp + fp)"), "precision"), r(f(1), "f1"), r(f(2), "f2"))


def right_closed(c: Column, width: float) -> Column:
    """The label "a-b" of the bin (a, b] of a value; null at or below 0."""
    low = F.ceil(F.round(c / width, 9)) - 1
    return F.when(c > 0, F.concat(F.format_number(low * width, 1), F.lit("-"), F.format_number((low + 1) * width, 1)))


def period_right_closed(year: Column, first: int = 1980, last: int = 2030) -> Column:
    """Five-year periods (a, a+5] labelled "a-(a+4)", so 1985 is in "1980-1984"."""
    low = F.lit(first) + 5 * (F.ceil((year - first) / 5) - 1)
    return F.when((year > first) & (year <= last), F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string")))


def period(year: Column, width: int = 5) -> Column:
    return (F.floor(year / width) * width).cast("long")


def period_label(year: Column, width: int = 5) -> Column:
    low = period(year, width)
    return F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))


def weight_grid(df: DataFrame, a: str, b: str, truth: str, positive: str, weights: list[float], thresholds: list[float]) -> DataFrame:
    """weight, threshold, presence_recall and absence_recall of each weighted mean of two probabilities.

    All configurations are counted in one pass; rows without a probability or truth are left out."""
    tries = [(w, t) for w in weights for t in thresholds]
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(truth).isNotNull())
    yes = F.col(truth) == positive
    sums = [F.count_if(yes).alias("yes"), F.count_if(~yes).alias("no")]
    for i, (w, t) in enumerate(tries):
        hit = F.round(w * F.col(a) + (1 - w) * F.col(b), 9) >= t
        sums += [F.count_if(hit & yes).alias(f"p{i}"), F.count_if(~hit & ~yes).alias(f"a{i}")]
    part = lambda c, of: F.round(F.col(c) / F.when(F.col(of) > 0, F.col(of)), 6)
    rows = [F.struct(F.lit(w).alias("weight"), F.lit(t).alias("threshold"), part(f"p{i}", "yes").alias("presence_recall"), part(f"a{i}", "no").alias("absence_recall")) for i, (w, t) in enumerate(tries)]
    return known.agg(*sums).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def cascade(steps: list[tuple[Column, float, Column]], otherwise: str = "Uncertain") -> Column:
    """The label of the first step whose confidence reaches its threshold."""
    out = F.when(steps[0][0] >= steps[0][1], steps[0][2])
    for confidence, least, label in steps[1:]:
        out = out.when(confidence >= least, label)
    return out.otherwise(otherwise)


# --- curves -----------------------------------------------------------------------------------
def curve(df: DataFrame, score: str, label: str, positive) -> DataFrame:
    """(score, positives, negatives, tp, fp, n_positive, n_negative, tpr, fpr, precision) at every score as a cut, which
    counts all rows of at least that score as positive; rows without score or label are left out.

    Rows are counted by score first; the scores are then dealt to ranges and summed up from the
    highest, so that no task holds them all and ties are one point.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    yes = (F.col(label) == positive).cast("long")
    counts = known.groupBy(F.col(score).alias("score")).agg(F.sum(yes).alias("positives"), F.sum(1 - yes).alias("negatives"))
    points = running(counts, [F.desc("score")], {"tp": "positives", "fp": "negatives"})
    both = points.agg(F.sum("positives").alias("n_positive"), F.sum("negatives").alias("n_negative"))
    out = points.crossJoin(F.broadcast(both))
    rate = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole))
    return out.withColumns({"tpr": rate("tp", "n_positive"), "fpr": rate("fp", "n_negative"), "precision": F.col("tp") / (F.col("tp") + F.col("fp"))})


def areas(points: DataFrame) -> DataFrame:
    """The area under the ROC curve (ties count half) and the average precision, from ``curve``; null
    where a class has no row."""
    roc = F.sum(F.col("negatives").cast("decimal(38,1)") * (2 * F.col("tp") - F.col("positives")))
    pairs = F.max("n_positive").cast("double") * F.max("n_negative").cast("double")
    steps = F.sum(F.col("positives") * F.col("precision"))
    return points.agg(F.when(pairs > 0, roc.cast("double") / 2 / pairs).alias("roc_area"), F.when(F.max("n_positive") > 0, steps / F.max("n_positive")).alias("average_precision"), F.count("*").alias("cuts"))
