"""All detectors by name: what they return and which relations they need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.functions import arrays
from tagsieve.operators import dynamics, ensemble, labels, noise, probability, sequences, spans, vectors


class Kind(Enum):
    FLAGGER = "flag"
    SCORER = "score"


@dataclass(frozen=True)
class Detector:
    """A detector as a function of data frames, with what it needs and can do."""

    name: str
    kind: Kind
    run: Callable
    needs: frozenset[str] = frozenset()
    supports_correction: bool = False

    @property
    def uses_probabilities(self) -> bool:
        return bool(self.needs & {"probs", "rep_probs"})

    @property
    def needs_multiple_probabilities(self) -> bool:
        return "rep_probs" in self.needs


def _detectors() -> list[Detector]:
    flag, score = Kind.FLAGGER, Kind.SCORER

    def of(name, kind, run, *needs, correct=False):
        return Detector(name, kind, run, frozenset(needs), correct)

    return [
        of("majority_label", flag, labels.majority_label, "instances", correct=True),
        of("majority_per_form", flag, labels.majority_per_form, "instances", correct=True),
        of("label_entropy", score, labels.label_entropy, "instances"),
        of("weighted_discrepancy", score, labels.weighted_discrepancy, "instances"),
        of("variation_n_grams", flag, sequences.variation_n_grams, "tokens", correct=True),
        of("variation_n_grams_span", flag, sequences.variation_n_grams_span, "tokens", correct=True),
        of("retag", flag, probability.retag, "instances", "preds", correct=True),
        of("classification_entropy", score, probability.classification_entropy, "probs"),
        of("classification_uncertainty", score, probability.classification_uncertainty, "instances", "probs", "classes"),
        of("prediction_margin", score, probability.prediction_margin, "probs"),
        of("confident_learning", flag, probability.confident_learning, "instances", "probs", "classes"),
        of("dropout_uncertainty", score, probability.dropout_uncertainty, "rep_probs"),
        of("label_aggregation", flag, ensemble.label_aggregation, "instances", "rep_probs", "classes", correct=True),
        of("majority_voting_ensemble", flag, ensemble.majority_voting_ensemble, "instances", "preds", correct=True),
        of("borda_count", score, ensemble.borda_count, "scores"),
        of("item_response_theory", flag, ensemble.item_response_flags, "instances", "preds"),
        of("projection_ensemble", flag, vectors.projection_ensemble, "vectors", correct=True),
        of("knn_entropy", score, vectors.knn_entropy, "vectors"),
        of("knn_flagger", flag, vectors.knn_flagger, "vectors", correct=True),
        of("mean_distance", score, vectors.mean_distance, "vectors"),
        of("datamap_confidence", score, dynamics.datamap_confidence, "train_log"),
        of("curriculum_spotter", score, dynamics.curriculum_spotter, "vectors"),
        of("leitner_spotter", score, dynamics.leitner_spotter, "vectors"),
        of("random_flagger", flag, noise.random_flags, "instances"),
        of("random_scorer", score, noise.random_scores, "instances"),
    ]


DETECTORS = {d.name: d for d in _detectors()}

#: How each detector takes its part of a bundle; the relations are those of ``relations`` by name, ``classes`` the class table
#: ``(idx, label)``, ``spans`` the spans of a tagging and ``scores`` the scores of several scorers. ``instances`` has ``form`` too
#: where forms are asked for, ``tokens`` likewise.
_CALLS: dict[str, Callable] = {
    "majority_label": lambda b, run: run(b["instances"], "id", "noisy"),
    "majority_per_form": lambda b, run: run(_formed(b["instances"]), "id", "form", "noisy"),
    "label_entropy": lambda b, run: run(_formed(b["instances"]), "id", "form", "noisy"),
    "weighted_discrepancy": lambda b, run: run(_formed(b["instances"]), "id", "form", "noisy"),
    "variation_n_grams": lambda b, run: run(_formed(b["tokens"], "token"), "form", "noisy"),
    "variation_n_grams_span": lambda b, run: run(_formed(b["tokens"], "token"), b.get("spans") or spans.bio_spans(b["tokens"], "noisy"), "form"),
    "retag": lambda b, run: run(b["instances"].join(_first_model(b["preds"]), "id"), "id", "noisy", "prediction"),
    "classification_entropy": lambda b, run: run(b["probs"]),
    "classification_uncertainty": lambda b, run: run(_with_probs(b), b["classes"]),
    "prediction_margin": lambda b, run: run(b["probs"]),
    "confident_learning": lambda b, run: run(_with_probs(b), b["classes"]),
    "dropout_uncertainty": lambda b, run: run(b["rep_probs"]),
    "label_aggregation": lambda b, run: run(b["instances"], _votes(b["rep_probs"]), _names(b["classes"]), b["rep_probs"].agg(F.max("t")).first()[0] + 1),
    "majority_voting_ensemble": lambda b, run: run(b["instances"], b["preds"]),
    "borda_count": lambda b, run: run(b["scores"]),
    "item_response_theory": lambda b, run: run(b["instances"], b["preds"], b["preds"].agg(F.max("model")).first()[0] + 1),
    "projection_ensemble": lambda b, run: run(b["vectors"], b["vectors"], "id", "vec", "noisy")[0],
    "knn_entropy": lambda b, run: run(b["vectors"], "id", "vec", "noisy"),
    "knn_flagger": lambda b, run: run(b["vectors"], "id", "vec", "noisy"),
    "mean_distance": lambda b, run: run(b["vectors"], "id", "vec", "noisy"),
    "datamap_confidence": lambda b, run: run(b["train_log"]),
    "curriculum_spotter": lambda b, run: run(b["vectors"], "id", "vec", "noisy"),
    "leitner_spotter": lambda b, run: run(b["vectors"], "id", "vec", "noisy"),
    "random_flagger": lambda b, run: run(b["instances"], "id"),
    "random_scorer": lambda b, run: run(b["instances"], "id"),
}


def _formed(df: DataFrame, text: str = "text") -> DataFrame:
    return df if "form" in df.columns else df.withColumn("form", F.lower(text))


def _first_model(preds: DataFrame) -> DataFrame:
    return preds.groupBy("id").agg(F.min_by("prediction", "model").alias("prediction"))


def _with_probs(bundle: dict[str, DataFrame]) -> DataFrame:
    return bundle["instances"].select("id", "noisy").join(bundle["probs"], "id")


def _votes(rep_probs: DataFrame) -> DataFrame:
    return rep_probs.select("id", F.col("t").alias("worker"), arrays.arg_max(F.col("probs")).alias("label"))


def _names(classes: DataFrame) -> list[str]:
    return [r.label for r in classes.orderBy("idx").collect()]


def run_all(bundle: dict[str, DataFrame], names: list[str] | None = None) -> dict[str, DataFrame]:
    """The results of all detectors, or those named, that the bundle has the relations for.

    One bundle serves all: each detector takes the relations that it needs and leaves the
    others. A named detector whose relations aren't all there is an error.
    """
    found = {}
    for name in names or DETECTORS:
        missing = DETECTORS[name].needs - bundle.keys()
        if missing and names:
            raise ValueError(f"{name} needs {sorted(missing)}")
        if not missing:
            found[name] = _CALLS[name](bundle, DETECTORS[name].run)
    return found
