"""Training, evaluating and using a category classifier on TF-IDF vectors: a net, or logistic regression by MLlib."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.functions.text import without_accents
from vellumflow.operators import hashed, scanned
from vellumflow.operators.metrics import calibration_error, class_report, class_weights, confusion, ranked_labels, ratio, selective, summary, top_k_accuracy, worst_mistakes
from vellumflow.operators.net import Net, fit, unpacked
from vellumflow.operators.split import borders, stratified, within, without_rare
from vellumflow.sources.shared import run_folder
from vellumflow.sources.swap import Files, replace_directory

WORD_SHARE = 0.75
FORMAT = 1
#: Numbers of iterations that logistic regression tries, and how many may pass without a gain.
ITERATIONS = (5, 10, 20, 40)
LEAST_GAIN, PATIENCE = 1e-4, 2
NET, LOGISTIC = "net", "logistic"
#: Bytes of vectors and texts that a task holds before it writes them.
ROW_GROUP = 16 << 20


def _shaped(papers: DataFrame, label: str) -> DataFrame:
    return papers.select("arxiv_id", "title", F.concat_ws("\n\n", "title", "abstract").alias("text"), F.col(label).alias("label"))


def examples(papers: DataFrame, label: str = "primary_category", least: int = 5) -> DataFrame:
    """arxiv_id, title, text, label of papers in classes that are frequent enough."""
    return without_rare(_shaped(papers, label), "label", least)


def _split(papers: DataFrame, label: str, least: int, validation: float, test: float, seed: int) -> tuple[DataFrame, list[str], int | None]:
    """The examples with split, their labels, and the number of training rows if it is told. Keys and labels, which are read once, tell each row's part."""
    keys = papers.select("arxiv_id", F.col(label).alias("label")).persist()
    frequent = without_rare(keys, "label", least)
    told = borders(frequent, "arxiv_id", "label", validation, test, seed)
    # As many rows as there are labels.
    labels = sorted(told[0]) if told else [r.label for r in frequent.select("label").distinct().orderBy("label").collect()]
    keys.unpersist()
    if told:
        return within(_shaped(papers, label), "arxiv_id", "label", told[0], seed), labels, told[1]
    return stratified(examples(papers, label, least), "arxiv_id", "label", validation, test, seed), labels, None


def _blocks() -> dict[str, hashed.Terms]:
    return {"w": hashed.word_runs(1, 2, lambda text: without_accents(F.lower(text))), "c": hashed.letter_runs(3, 5)}


def _vector(size: int, index: str, value: str) -> Column:
    """The dense vector of a sparse one. Its entries are in order of their numbers; gaps between them are runs of zeros."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    n, last = F.size(index), F.element_at(F.col(index), -1)
    gaps = F.transform(index, lambda at, i: at - F.when(i > 0, F.get(index, i - 1)).otherwise(-1) - 1)
    parts = F.zip_with(gaps, F.col(value), lambda gap, x: F.concat(zeros(gap), F.array(x)))
    filled = F.when(n > 0, F.concat(F.flatten(parts), zeros(size - 1 - last))).otherwise(zeros(F.lit(size)))
    return array_to_vector(filled)


@dataclass
class Vocabulary:
    """The terms of both blocks with their numbers and weights; bounded by the number of features asked for."""

    terms: DataFrame
    size: int

    @staticmethod
    def fit(train: DataFrame, features: int, n: int | None = None) -> Vocabulary:
        """n: the number of rows, if it is known."""
        sizes = {"w": int(features * WORD_SHARE), "c": features - int(features * WORD_SHARE)}
        n = train.count() if n is None else n
        # Frequency bounds that suit the number of documents.
        least, most = 1 if n < 4 else 2, n if n < 3 else 0.995 * n
        chosen = scanned.vocabulary(train, "text", _blocks(), sizes, n, least, most)
        rows = [(name, term, math.log((1 + n) / (1 + df)) + 1) for name in _blocks() for term, df in chosen[name]]
        spark = train.sparkSession
        return Vocabulary(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "number int, block string, term string, idf double"), len(rows))

    def transform(self, docs: DataFrame) -> DataFrame:
        """docs with `features`: index and value of what isn't zero, by index. Each text's are made of it and the vocabulary."""
        rows = self.terms.orderBy("number").collect()
        own = {name: [(r.term, r.idf) for r in rows if r.block == name] for name in _blocks()}
        return docs.withColumn("features", scanned.features(docs, "text", own))


@dataclass
class Classifier:
    vocabulary: Vocabulary
    model: Net | LogisticRegressionModel
    labels: list[str]

    def predict(self, docs: DataFrame, k: int = 3) -> DataFrame:
        """arxiv_id, text columns, predicted, confidence and the k most probable labels. docs may have their vectors already."""
        vectors = docs if "features" in docs.columns else self.vocabulary.transform(docs)
        index, value = F.col("features.index"), F.col("features.value")
        if isinstance(self.model, Net):
            scored = vectors.withColumn("_p", self.model.probability(docs.sparkSession, index, value, self.vocabulary.size))
        else:
            scored = self.model.transform(vectors.withColumn("_x", _vector(self.vocabulary.size, "features.index", "features.value"))).withColumn("_p", vector_to_array("probability"))
        ranked = scored.withColumn("ranked", ranked_labels(F.col("_p"), self.labels, k))
        first = F.get(F.col("ranked"), F.lit(0))
        return ranked.withColumns({"predicted": first["label"], "confidence": first["probability"]}).drop("_p", "_x", "features", "rawPrediction", "probability", "prediction")


@dataclass
class Run:
    classifier: Classifier
    history: list[dict]
    metrics: dict
    report: DataFrame
    confusion: DataFrame
    mistakes: DataFrame
    selective: DataFrame
    split: DataFrame

    def curve(self, spark: SparkSession) -> DataFrame:
        """The learning curve: a row for each number of iterations that was tried."""
        return spark.createDataFrame(self.history, "epoch int, train_loss double, train_accuracy double, validation_loss double, validation_accuracy double, validation_macro_f1 double")


def _fit_logistic(vectors: DataFrame, vocabulary: Vocabulary, labels: list[str], weights: list[float], iterations: Iterable[int]) -> tuple[Classifier, dict]:
    """Logistic regression with the number of iterations that does best on the validation part."""
    weight = F.get(F.array(*map(F.lit, weights)), F.col("y"))
    rows = vectors.where("split = 'train'").select(F.col("y").cast("double").alias("y"), weight.alias("weight"), _vector(vocabulary.size, "features.index", "features.value").alias("_x")).persist()
    best, best_score, best_epoch, waited, history = None, float("-inf"), 0, 0, []
    for n in iterations:
        model = LogisticRegression(featuresCol="_x", labelCol="y", weightCol="weight", maxIter=n, regParam=1e-4).fit(rows)
        candidate = Classifier(vocabulary, model, labels)
        score = summary(candidate.predict(vectors.where("split = 'validation'")), "label", "predicted").head()
        history.append({"epoch": n, "validation_accuracy": score.accuracy, "validation_macro_f1": score.macro_f1})
        if score.macro_f1 > best_score + LEAST_GAIN:
            best, best_score, best_epoch, waited = candidate, score.macro_f1, n, 0
        elif (waited := waited + 1) >= PATIENCE:
            break
    rows.unpersist()
    # Without training all labels are equally probable and the first one is guessed.
    untrained = vectors.where("split = 'validation'").agg(ratio(F.count_if(F.col("y") == 0), F.count(F.lit(1)), 0.0)).head()[0]
    return best, {"history": history, "best_epoch": best_epoch, "untrained_validation_accuracy": untrained}


def train_and_evaluate(papers: DataFrame, label: str = "primary_category", least: int = 5, features: int = 8000, validation: float = 0.15, test: float = 0.15, seed: int = 42, model: str = NET, iterations: Iterable[int] = ITERATIONS, **options) -> Run:
    """Fits on the training part only, picks the epoch on the validation part, reports on the test part.

    model: net (options as in net.fit()) or logistic (iterations: the numbers to try).
    """
    if model not in (NET, LOGISTIC):
        raise ValueError(f"no such model: {model}")
    split, labels, n = _split(papers, label, least, validation, test, seed)
    index = F.create_map(*(x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))))
    spark, path = papers.sparkSession, run_folder(papers.sparkSession, "vectors")
    if n is None:
        # Rows of one key are in no order of their own, so that they are dealt once.
        split.write.parquet(f"{path}-split")
        split = spark.read.schema(split.schema).parquet(f"{path}-split")
    vocabulary = Vocabulary.fit(split.where("split = 'train'"), features, n)
    # The vectors of all parts in one pass, beside the texts: what learns reads their columns only, and nothing is held in memory.
    made = vocabulary.transform(split).withColumn("y", F.element_at(index, F.col("label")))
    made.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    vectors = spark.read.schema(made.schema).parquet(path)
    split, train = vectors.drop("features", "y"), vectors.where("split = 'train'")
    by_label = {r.label: r.weight for r in class_weights(train, "label").collect()}
    weights = [by_label[name] for name in labels]
    if model == NET:
        net, fitted = fit(vectors, "arxiv_id", vocabulary.size, weights, seed=seed, **options)
        best = Classifier(vocabulary, net, labels)
    else:
        best, fitted = _fit_logistic(vectors, vocabulary, labels, weights, iterations)
    part = lambda name: vectors.where(F.col("split") == name)
    told = best.predict(part("test")).withColumn("correct", F.col("label") == F.col("predicted"))
    told.write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}-told")
    told = spark.read.schema(told.schema).parquet(f"{path}-told")
    metrics = summary(told, "label", "predicted").head().asDict() | top_k_accuracy(told, "label", "ranked", min(3, len(labels))).head().asDict()
    metrics |= {k: fitted[k] for k in ("best_epoch", "untrained_validation_accuracy")}
    metrics |= calibration_error(told, "confidence", "correct").head().asDict()
    return Run(best, fitted["history"], metrics, class_report(told, "label", "predicted"), confusion(told, "label", "predicted"), worst_mistakes(told, "label", "predicted", "confidence", "arxiv_id"), selective(told, "confidence", "correct"), split)


def _digest(files: Files, folder: str) -> dict[str, str]:
    return {name: files.sha256(f"{folder}/{name}") for name in files.under(folder) if name != "manifest.json"}


def save(classifier: Classifier, folder: str) -> None:
    """Writes model, terms, labels and a manifest of hashes, then swaps the folder in; a failure keeps the old one."""
    spark = classifier.vocabulary.terms.sparkSession

    def write(stage: str) -> None:
        files = Files(spark, stage)
        net = isinstance(classifier.model, Net)
        if net:
            spark.createDataFrame([(classifier.model.weights,)], "weights binary").coalesce(1).write.parquet(f"{stage}/model")
        else:
            classifier.model.write().overwrite().save(f"{stage}/model")
        classifier.vocabulary.terms.coalesce(1).write.mode("overwrite").parquet(f"{stage}/terms")
        files.write(f"{stage}/labels.json", json.dumps(classifier.labels))
        files.write(f"{stage}/manifest.json", json.dumps({"format": FORMAT, "kind": NET if net else LOGISTIC, "size": classifier.vocabulary.size, "files": _digest(files, stage)}, sort_keys=True))

    replace_directory(spark, folder, write)


def load(spark: SparkSession, folder: str) -> Classifier:
    """Reads what save() wrote; unknown formats and files that differ from the manifest are errors."""
    files = Files(spark, folder)
    manifest = json.loads(files.read(f"{folder}/manifest.json"))
    if manifest.get("format") != FORMAT:
        raise ValueError("unknown model format")
    if manifest["files"] != _digest(files, folder):
        raise ValueError("the model's files don't match its manifest")
    if manifest["kind"] == NET:
        model = Net(bytes(spark.read.parquet(f"{folder}/model").head().weights))
        n_labels = unpacked(model.weights)[3].size
    else:
        model = LogisticRegressionModel.load(f"{folder}/model")
        n_labels = model.numClasses
    terms = spark.read.parquet(f"{folder}/terms")
    labels = json.loads(files.read(f"{folder}/labels.json"))
    if manifest["size"] != terms.count() or n_labels != len(labels):
        raise ValueError("the model's parts don't fit each other")
    return Classifier(Vocabulary(terms, manifest["size"]), model, labels)
