"""Metrics of engines over datasets: cross-validation, and training on one dataset and testing on another."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.errors import DatasetError
from parlance.operators import metrics
from parlance.plans.config import EngineConfig
from parlance.plans.engine import IntentEngine, IntentEngineModel
from parlance.sources.dataset import Dataset

#: The name under which utterances without an intent are counted.
NONE = "null"
Fit = Callable[[Dataset], IntentEngineModel]


@dataclass
class Report:
    confusion: DataFrame  # actual, predicted, n
    intents: DataFrame  # class (null: all), true_positive, false_positive, false_negative, precision, recall, f1
    slots: DataFrame  # intent, slot_name, the same
    errors: DataFrame  # id, text, actual, predicted, probability of utterances with a wrong intent


def engine_fit(spark: SparkSession, config: EngineConfig | None = None, resources: dict | None = None) -> Fit:
    return IntentEngine(spark, config, resources).fit


def _part(dataset: Dataset, keep: Callable[[str, int], bool]) -> Dataset:
    intents = {name: [u for k, u in enumerate(said) if keep(name, k)] for name, said in dataset.intents.items()}
    return Dataset(dataset.language, {n: u for n, u in intents.items() if u}, dataset.entities)


def _parsed(spark: SparkSession, fit: Fit, train: Dataset, test: Dataset, shift: int) -> tuple[DataFrame, DataFrame]:
    """Judged utterances (id, text, actual, predicted, probability) and slots (id, intent, slot_name, raw_value, found: whether it was found or is true)."""
    frames = test.frames(spark)
    texts = frames["texts"].select((F.col("id") + shift).alias("id"), "intent", "text")
    model = fit(train)
    parsed = model.parse(texts.select("id", "text")).cache()
    judged = parsed.join(texts.select("id", F.col("intent").alias("actual")), "id").select("id", F.col("input").alias("text"), "actual", F.coalesce("intent", F.lit(NONE)).alias("predicted"), "probability")
    found = parsed.select("id", "intent", F.explode("slots").alias("s")).select("id", "intent", "s.slot_name", "s.raw_value", F.lit(True).alias("found"))
    truth = frames["slots"].select((F.col("id") + shift).alias("id"), "intent", "slot_name", "raw_value", F.lit(False).alias("found"))
    out = tuple(spark.createDataFrame(df.toArrow(), df.schema) for df in (judged, found.unionByName(truth)))
    parsed.unpersist()
    model.release()
    return out


def _report(judged: DataFrame, slots: DataFrame) -> Report:
    confusion = metrics.confusion(judged)
    right = judged.where("actual = predicted").select("id")
    own = slots.join(right, "id", "left_semi").withColumn("slot_name", F.concat_ws("\t", "intent", "slot_name"))
    counted = metrics.slot_counts(own.where("found"), own.where("NOT found"))
    parts = F.split("slot_name", "\t")
    by_slot = metrics.rated(counted).select(F.get(parts, 0).alias("intent"), F.get(parts, 1).alias("slot_name"), *metrics.RATED)
    return Report(confusion, metrics.precision_recall(confusion), by_slot, judged.where("actual <> predicted"))


def cross_validate(spark: SparkSession, dataset: Dataset, fit: Fit | None = None, folds: int = 5, train_ratio: float = 1.0, seed: int = 0) -> Report:
    """Utterances of each intent in `folds` parts by a seeded order; each part is parsed by an engine fitted on the others, of which a share of train_ratio is taken."""
    fit = fit or engine_fit(spark)
    if folds < 2 or any(len(said) < folds for said in dataset.intents.values()):
        raise DatasetError(f"an intent has fewer utterances than the {folds} folds, of which there must be two or more")
    if not 0 < train_ratio <= 1:
        raise ValueError("train_ratio must lie above 0 and not above 1")
    rng, fold, drawn = random.Random(seed), {}, {}
    for name, said in sorted(dataset.intents.items()):
        order = list(range(len(said)))
        rng.shuffle(order)
        for place, k in enumerate(order):
            fold[name, k], drawn[name, k] = place % folds, place / len(said)
    judged = slots = None
    for f in range(folds):
        train = _part(dataset, lambda n, k, f=f: fold[n, k] != f and (train_ratio == 1 or drawn[n, k] < train_ratio or drawn[n, k] < 2 / len(dataset.intents[n])))
        test = _part(dataset, lambda n, k, f=f: fold[n, k] == f)
        one, two = _parsed(spark, fit, train, test, f * 1_000_000)
        judged, slots = (one, two) if judged is None else (judged.unionByName(one), slots.unionByName(two))
    return _report(judged, slots)


def train_test(spark: SparkSession, train: Dataset, test: Dataset, fit: Fit | None = None) -> Report:
    return _report(*_parsed(spark, fit or engine_fit(spark), train, test, 0))
