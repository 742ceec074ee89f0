"""Classifiers whose parameters are tables: one row per term, however many terms there are.

Features come in long form, ``(id, term, value)``, as ``terms.apply_idf`` makes them; a term that
a document lacks has the value zero and no row.  Ids tell documents apart.  ``rows`` holds all
documents, also those without any known term, and their labels.  Nothing of the size of the
vocabulary reaches the driver or a single task; what does is one number per class or round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.operators.terms import join_weights
from vocalis.session import materialize

#: Classes a table of moments may have; each is two columns of it.
MAX_CLASSES = 100


@dataclass(frozen=True)
class GaussianTable:
    """``terms`` (term, df, square, linear): per class (arrays in the order of ``classes``), what
    a value's square and the value itself add to the log-likelihood beyond a zero; ``constants``:
    log-likelihood of a document without any term."""

    terms: DataFrame
    classes: list
    constants: list[float]

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame(list(zip(self.classes, self.constants, strict=True)), "class long, constant double").write.mode("overwrite").parquet(f"{path}/classes")

    @staticmethod
    def load(spark, path: str) -> GaussianTable:
        kept = spark.read.parquet(f"{path}/classes").orderBy("class").collect()
        return GaussianTable(spark.read.parquet(f"{path}/terms"), [r["class"] for r in kept], [r["constant"] for r in kept])


def fit_gaussian(values: DataFrame, rows: DataFrame, id_col: str, value: str = "tfidf", smoothing: float = 1e-9) -> GaussianTable:
    """Gaussian naive Bayes: mean and variance of every term in every class, all documents of
    the class counting, absent terms as zeros; variances grow by ``smoothing`` times the greatest
    variance of a term over all documents.  Rows without a label take no part."""
    known = rows.where(F.col("label").isNotNull())
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(MAX_CLASSES + 1).collect()}
    if not sizes or len(sizes) > MAX_CLASSES:
        raise ValueError(f"between 1 and {MAX_CLASSES} classes are needed")
    total, x = sum(sizes.values()), F.col(value)
    of_class = lambda c, v: F.coalesce(F.sum(F.when(F.col("label") == c, v)), F.lit(0.0))
    seen = values.select(id_col, "term", value).join(known.select(id_col, "label"), id_col)
    moments = materialize(seen.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"),
        *[of_class(c, v).alias(f"_{k}{i}") for i, c in enumerate(sizes) for k, v in (("s", x), ("q", x * x))]))
    spread = moments.agg(F.max(F.col("_q") / total - (F.col("_s") / total) ** 2)).first()[0]
    add = smoothing * (spread or 0.0)

    def of(i: int) -> tuple[Column, Column]:
        n = list(sizes.values())[i]
        mean = F.col(f"_s{i}") / n
        return mean, F.greatest(F.col(f"_q{i}") / n - mean * mean, F.lit(0.0)) + add

    sums = [F.sum(F.log(2 * math.pi * var) + mean * mean / var).alias(f"_{i}") for i, (mean, var) in enumerate(map(of, range(len(sizes))))]
    base = moments.agg(*sums).first()
    constants = [math.log(n / total) - 0.5 * (base[i] or 0.0) for i, n in enumerate(sizes.values())]
    both = [of(i) for i in range(len(sizes))]
    terms = materialize(moments.select(
        "term", "df", F.array(*[-0.5 / var for _, var in both]).alias("square"), F.array(*[mean / var for mean, var in both]).alias("linear")))
    return GaussianTable(terms, list(sizes), constants)


def score_gaussian(model: GaussianTable, values: DataFrame, rows: DataFrame, id_col: str, value: str = "tfidf") -> DataFrame:
    """``rows`` with ``prediction`` (of equal classes the least) and ``probabilities``, one per
    class in their order."""
    x, k = F.col(value), range(len(model.classes))
    joined = join_weights(values.select(id_col, "term", value), model.terms)
    sums = joined.groupBy(id_col).agg(*[F.sum(x * x * F.col("square")[i] + x * F.col("linear")[i]).alias(f"_{i}") for i in k])
    logs = [F.coalesce(F.col(f"_{i}"), F.lit(0.0)) + F.lit(model.constants[i]) for i in k]
    scored = rows.join(sums, id_col, "left").select(*[rows[c] for c in rows.columns], F.array(*logs).alias("_logs"))
    best = F.array_max("_logs")
    odds = F.transform("_logs", lambda s: F.exp(s - best))
    classes = F.array(*[F.lit(c) for c in model.classes])
    return scored.select(
        *rows.columns, F.get(classes, F.array_position("_logs", best).cast("int") - 1).alias("prediction"),
        F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)).alias("probabilities"))


#: The term of the intercept: a value of one in every document.
INTERCEPT = ""


def with_intercept(values: DataFrame, rows: DataFrame, id_col: str, value: str = "tfidf") -> DataFrame:
    ones = rows.select(id_col, F.lit(INTERCEPT).alias("term"), F.lit(1.0).alias(value))
    return values.select(id_col, "term", value).unionByName(ones)


def fit_logistic(
    values: DataFrame, rows: DataFrame, id_col: str, value: str = "tfidf", reg: float = 0.0, rounds: int = 50, tol: float = 0.0,
) -> DataFrame:
    """``term, df, weight``: logistic regression of the label (0/1) with an L2 penalty ``reg / 2``
    times the squared weights (not the intercept's, the row of the empty term) against the mean
    loss.

    Accelerated gradient steps of fixed size, which suits documents of at most unit length.  A
    round joins the weights to the terms, sums every document's margin, and sums the errors of its
    documents for every term; both sums collapse before they are shuffled.  Rounds stop early
    when no weight moves by more than ``tol``."""
    known = materialize(rows.where(F.col("label").isNotNull()).select(id_col, F.col("label").cast("double").alias("label")))
    data = materialize(with_intercept(values, known, id_col, value).join(known, id_col))
    n, step = known.count(), 1.0 / (0.5 + reg)
    state = data.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", F.lit(0.0).alias("weight"), F.lit(0.0).alias("_before"))
    state, t = materialize(state), 1.0
    for _ in range(rounds if n else 0):
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = state.withColumn("_v", F.col("weight") + F.lit((t - 1) / after) * (F.col("weight") - F.col("_before")))
        margins = join_weights(data, ahead.select("term", "_v")).groupBy(id_col, "label").agg(F.sum(F.col(value) * F.col("_v")).alias("_m"))
        errors = margins.select(id_col, (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_m"))) - F.col("label")).alias("_e"))
        slopes = data.select(id_col, "term", value).join(errors, id_col).groupBy("term").agg((F.sum(F.col("_e") * F.col(value)) / n).alias("_g"))
        penalty = F.when(F.col("term") == INTERCEPT, 0.0).otherwise(F.lit(reg) * F.col("_v"))
        moved = ahead.join(slopes, "term").select("term", "df", (F.col("_v") - F.lit(step) * (F.col("_g") + penalty)).alias("weight"), F.col("weight").alias("_before"))
        state, t = materialize(moved), after
        if tol and state.agg(F.max(F.abs(F.col("weight") - F.col("_before")))).first()[0] <= tol:
            break
    return state.select("term", "df", "weight")


def score_logistic(weights: DataFrame, values: DataFrame, rows: DataFrame, id_col: str, value: str = "tfidf") -> DataFrame:
    """``rows`` with ``prediction`` and the ``probability`` of class 1; one half is class 0."""
    data = with_intercept(values, rows, id_col, value)
    sums = join_weights(data, weights).groupBy(id_col).agg(F.sum(F.col(value) * F.col("weight")).alias("_m"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.coalesce(F.col("_m"), F.lit(0.0))))
    scored = rows.join(sums, id_col, "left").select(*[rows[c] for c in rows.columns], p.alias("probability"))
    return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
