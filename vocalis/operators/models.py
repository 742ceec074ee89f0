"""Supervised text classification: features, grid search, prediction, metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, NaiveBayes, NaiveBayesModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.functions.rows import recode_label, threshold
from vocalis.functions.text import explode_each, parse_token_list, vector_words, with_once
from vocalis.operators.report import binary_metrics
from vocalis.operators.sampling import sample_n, stratified_folds, stratified_split
from vocalis.operators.terms import doc_frequency, n_rows
from vocalis.session import BROADCAST_ROWS, broadcast_if_small, has_at_most, materialize

# Terms a vocabulary may have: it lies on the driver and in every task.  More are refused.
MAX_TERMS = 1 << 22


def fit_tfidf(train: DataFrame, tokens: str = "tokens", min_df: float = 1e-4) -> PipelineModel:
    """Sparse unit-length TF-IDF vectors with the idf ``ln((1+n)/(1+df)) + 1`` over every term in
    at least the share ``min_df`` of the rows; no term is left out.  The terms are counted first,
    and more than MAX_TERMS raise a ValueError: ``terms.tfidf_smooth`` has no such bound."""
    words = with_once(train.select(tokens), _words=vector_words(F.col(tokens)))
    found = doc_frequency(words, "_words").where(F.col("df") >= F.lit(min_df) * n_rows(words)).count()
    if found > MAX_TERMS:
        raise ValueError(f"{found} terms reach min_df {min_df}; at most {MAX_TERMS} fit a vocabulary")
    counter = CountVectorizer(inputCol="_words", outputCol="_tf", minDF=min_df, vocabSize=max(found, 1))
    counts = counter.fit(words)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counts.transform(words))
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="_tf", outputCol="_tfidf"
    )
    return PipelineModel([counts, scale, Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)])


def add_tfidf(model: PipelineModel, df: DataFrame, tokens: str = "tokens") -> DataFrame:
    words = with_once(df, _words=vector_words(F.col(tokens)))
    return model.transform(words).drop("_words", "_tf", "_tfidf")


# --- fixed values: names of the model families in a configuration ------------------------
FAMILIES = {"LogisticRegression()": LogisticRegressionModel, "GaussianNB()": NaiveBayesModel}
PARAMETERS = {"LogisticRegression()": {"penalty", "C", "max_iter", "tol", "fit_intercept"}, "GaussianNB()": set()}
SAMPLE_ROWS = 500_000
SCORING = {
    "accuracy": {"metricName": "accuracy"},
    "precision": {"metricName": "precisionByLabel", "metricLabel": 1.0},
    "recall": {"metricName": "recallByLabel", "metricLabel": 1.0},
}
# ----------------------------------------------------------------------------------------


def estimator(kind: str, params: Mapping[str, object], n_train: int):
    """Estimator of a family.  ``C`` weighs the summed loss, Spark's ``regParam`` the penalty
    against the mean loss, hence the division by the number of rows.  Unknown families and
    parameters raise a ValueError."""
    if unknown := set(params) - PARAMETERS.get(kind, set(params)):
        raise ValueError(f"unknown parameters of {kind}: {', '.join(sorted(unknown))}")
    if params.get("penalty", "l2") not in ("l1", "l2"):
        raise ValueError(f"unknown penalty {params['penalty']!r}")
    if kind == "GaussianNB()":
        return NaiveBayes(modelType="gaussian")
    if kind == "LogisticRegression()":
        return LogisticRegression(
            elasticNetParam=1.0 if params.get("penalty", "l2") == "l1" else 0.0,
            regParam=1.0 / (float(params.get("C", 1.0)) * n_train),
            standardization=False,
            maxIter=int(params.get("max_iter", 100)),
            tol=float(params.get("tol", 1e-6)),
            fitIntercept=bool(params.get("fit_intercept", True)),
        )
    raise ValueError(f"unknown family {kind!r}; known: {', '.join(FAMILIES)}")


def settings(grid: Mapping[str, Sequence[object]]) -> list[dict[str, object]]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def grid_search(
    train: DataFrame, kind: str, grid: Mapping[str, Sequence[object]], ids: Sequence[str],
    folds: int = 5, scoring: str = "accuracy", seed: int = 1234, parallelism: int = 2,
):
    """Best model by cross-validation on stratified folds, refitted on all rows, and the table
    of scores.  ``train`` has ``features``, ``label`` and the id columns."""
    data = materialize(stratified_folds(train, "label", ids, folds, seed).select("features", "label", "fold"))
    rows = data.count()
    # Every step of a fit sends a gradient as long as the vocabulary from every partition: so many
    # partitions that the fits running together fill the cluster, whatever the rows.
    data = data.coalesce(max(1, data.sparkSession.sparkContext.defaultParallelism // parallelism))
    options = settings(grid)
    per_fold = rows * (folds - 1) / folds
    base = estimator(kind, options[0], per_fold)
    maps = ParamGridBuilder().build()
    if kind == "LogisticRegression()":
        built = [estimator(kind, o, per_fold) for o in options]
        searched = ("elasticNetParam", "regParam", "maxIter", "tol", "fitIntercept")
        maps = [{base.getParam(p): e.getOrDefault(p) for p in searched} for e in built]
    cv = CrossValidator(
        estimator=base, estimatorParamMaps=maps, numFolds=folds, foldCol="fold", parallelism=parallelism,
        evaluator=MulticlassClassificationEvaluator(**SCORING[scoring]),
    ).fit(data)
    best = max(range(len(options)), key=lambda i: cv.avgMetrics[i])
    model = estimator(kind, options[best], rows).fit(data)
    return model, cv_results(train.sparkSession, kind, options, cv.avgMetrics, cv.stdMetrics)


def cv_results(spark, kind: str, options, means, deviations) -> DataFrame:
    """One row per setting: family, parameters, mean and deviation of the score, rank."""
    order = sorted(range(len(options)), key=lambda i: -means[i])
    rows = [
        (kind, ", ".join(f"{k}={v}" for k, v in o.items()), float(means[i]), float(deviations[i]), order.index(i) + 1)
        for i, o in enumerate(options)
    ]
    return spark.createDataFrame(rows, "family string, params string, mean_score double, std_score double, rank int")


def predict(model, df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, predicted class and probability of class 1."""
    out = model.transform(df)
    return out.select(
        *keep,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("probability"),
    )


def evaluate_splits(predictions: DataFrame, by: Sequence[str] = ("family", "split")) -> DataFrame:
    return binary_metrics(predictions, by)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def prepare_training(table: DataFrame, config: Mapping, ids: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """Rows to train on, as a configuration asks: the required columns of a sample of at most
    ``sample_rows`` labelled rows (SAMPLE_ROWS unless given), token lists parsed, empty texts dropped, labels 0/1, and the part every row belongs to."""
    label, seed = config["label_col"], config.get("seed", 1234)
    columns = [c for c in dict.fromkeys([*ids, *config["reqd_cols"], label, tokens])]
    rows = sample_n(table.select(*columns), config.get("sample_rows", SAMPLE_ROWS), ids, seed)
    if dict(rows.dtypes)[tokens] == "string":
        rows = with_once(rows, **{tokens: parse_token_list(F.col(tokens))})
    rows = rows.where(F.size(tokens) > 0).withColumn("label", recode_label(F.col(label)).cast("int"))
    test, valid = float(config["test_frac"]), float(config["val_frac"])
    return stratified_split(materialize(rows), "label", ids, test, valid, seed)


def save_models(models: Mapping, path: str) -> None:
    for name, model in models.items():
        save_model(model, f"{path.rstrip('/')}/{name}")


def load_models(config: Mapping, path: str) -> dict:
    """Models of an earlier run: the features and one model per family of the configuration."""
    kinds = {family: FAMILIES[spec["type"]] for family, spec in config["grid"].items()}
    return {name: kind.load(f"{path.rstrip('/')}/{name}") for name, kind in {"tfidf": PipelineModel, **kinds}.items()}


def run_baseline(
    data: DataFrame, config: Mapping, ids: Sequence[str], tokens: str = "tokens", fit_on_all: bool = False
) -> tuple[DataFrame, DataFrame | None, dict]:
    """Evaluate every family of a configuration on validation and test rows.

    ``data`` has ``label``, ``split`` (train, valid, test), tokens and ids.  With ``run_type``
    ``build`` (the default) the families are trained by grid search, with ``load`` they are read
    from ``model_obj_path``.  Features are fitted on the training part unless ``fit_on_all``.
    Returns the metrics, the cross-validation table (None when loaded) and the models.
    """
    train = F.col("split") == "train"
    load = config.get("run_type", "build") == "load"
    if load:
        models = load_models(config, config["model_obj_path"])
    else:
        models = {"tfidf": fit_tfidf(data if fit_on_all else data.where(train), tokens, config.get("min_df", 1e-4))}
    featured = materialize(add_tfidf(models["tfidf"], data, tokens).select(*ids, "label", "split", "features"))
    predictions, tables = [], []
    for family, spec in config["grid"].items():
        if not load:
            models[family], table = grid_search(
                featured.where(train), spec["type"], spec["grid"], ids, config.get("folds", 5),
                config.get("scoring", "accuracy"),
            )
            tables.append(table)
        held = predict(models[family], featured.where(~train), "split", "label")
        predictions.append(held.withColumn("family", F.lit(family)))
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return evaluate_splits(union(predictions)), union(tables) if tables else None, models


def join_embeddings(df: DataFrame, vectors: DataFrame, ids: Sequence[str], tokens: str, size: int) -> DataFrame:
    """``ids, term, vector``: the vector of every token, zeros for unknown ones."""
    terms = explode_each(df, tokens, "term", *ids)
    known = vectors.select(F.col("token").alias("term"), F.col("vector"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    joined = terms.join(broadcast_if_small(known), "term", "left")
    return joined.select(*ids, "term", F.coalesce("vector", zeros).alias("vector"))


def _whole(vectors: DataFrame, size: int) -> bool:
    """True when every vector has all its numbers and no token comes twice."""
    full = (F.size("vector") >= size) & ~F.exists(F.slice("vector", 1, size), lambda x: x.isNull())
    lacking = vectors.where(~F.coalesce(full, F.lit(False)))
    return lacking.isEmpty() and vectors.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _summed(vectors: DataFrame, size: int):
    """The sum of the vectors of a list of tokens, in their order, zeros for unknown ones, and behind
    it the number of tokens; NULL tokens do not count."""
    table = vectors.select("token", F.transform(F.slice("vector", 1, size), lambda x: x.cast("double")).alias("vector")).toArrow()
    numbers = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    shared = vectors.sparkSession.sparkContext.broadcast((table["token"].combine_chunks(), np.vstack([numbers, np.zeros((1, size))])))

    @F.arrow_udf("array<double>")
    def sums(lists: pa.Array) -> pa.Array:
        tokens, numbers = shared.value
        flat = lists.flatten()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        kept = np.concatenate([[0], np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False))])[np.concatenate([[0], ends])]
        at = pc.fill_null(pc.index_in(flat.drop_null(), value_set=tokens.cast(flat.type)), len(numbers) - 1).to_numpy(zero_copy_only=False)
        out = np.zeros((len(lists), size + 1))
        out[:, size] = np.diff(kept)
        # Longest first: those that still have a token at a place stand in front.
        order = np.argsort(-out[:, size], kind="stable")
        starts, lengths = kept[:-1][order], np.diff(kept)[order]
        total, left = np.zeros((len(lists), size)), len(lists)
        for place in range(int(lengths[0]) if len(lists) else 0):
            left = int(np.searchsorted(-lengths[:left], -place, side="left"))
            total[:left] += numbers[at[starts[:left] + place]]
        out[order, :size] = total
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * (size + 1), pa.int32()), pa.array(out.ravel()))

    return sums


def mean_vectors(df: DataFrame, vectors: DataFrame, ids: Sequence[str], tokens: str, size: int) -> DataFrame:
    """``ids, mean``: mean vector of the tokens.  Sums collapse before the shuffle.

    Vectors that may be broadcast, each whole and of one token, are looked up and summed row by row in
    Python workers; others are joined to every token."""
    known = materialize(vectors.where(F.col("token").isNotNull()).select("token", "vector"))
    if has_at_most(known, BROADCAST_ROWS) and _whole(known, size):
        sums = with_once(df.select(*ids, tokens), _sums=_summed(known, size)(F.col(tokens))).drop(tokens)
        sums = sums.where(F.get("_sums", F.lit(size)) > 0).groupBy(*ids).agg(*[F.sum(F.get("_sums", F.lit(i))).alias(f"_{i}") for i in range(size + 1)])
        return sums.select(*ids, F.array(*[F.col(f"_{i}") / F.col(f"_{size}") for i in range(size)]).alias("mean"))
    rows = join_embeddings(df, vectors, ids, tokens, size)
    sums = rows.groupBy(*ids).agg(*[F.avg(F.get("vector", F.lit(i))).alias(f"_{i}") for i in range(size)])
    return sums.select(*ids, F.array(*[F.col(f"_{i}") for i in range(size)]).alias("mean"))


def fit_embedding_classifier(train: DataFrame, max_iter: int = 50, reg: float = 0.0):
    """Logistic regression on mean vectors (column ``mean``, ``label``)."""
    rows = train.select("label", array_to_vector("mean").alias("features"))
    return LogisticRegression(maxIter=max_iter, regParam=reg).fit(rows)


def score_embeddings(model, df: DataFrame, *keep: str) -> DataFrame:
    """``keep, prediction_raw, prediction_class`` of every row."""
    out = model.transform(df.withColumn("features", array_to_vector("mean")))
    raw: Column = vector_to_array("probability")[1]
    return out.select(*keep, raw.alias("prediction_raw")).withColumn(
        "prediction_class", threshold(F.col("prediction_raw"))
    )


def sweep(train: DataFrame, valid: DataFrame, grid: Mapping[str, Sequence[object]]):
    """Fit every setting independently and keep the best accuracy on the validation rows.
    Returns the best model and the table of settings."""
    rows, best = [], None
    for option in settings(grid):
        model = fit_embedding_classifier(train, **option)
        scored = score_embeddings(model, valid, "label").withColumnRenamed("prediction_class", "prediction")
        accuracy = binary_metrics(scored).first()["accuracy"]
        rows.append((", ".join(f"{k}={v}" for k, v in option.items()), float(accuracy)))
        if best is None or accuracy > best[0]:
            best = (accuracy, model)
    return best[1], train.sparkSession.createDataFrame(rows, "params string, valid_accuracy double")
