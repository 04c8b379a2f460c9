"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on measures of the whole text, fitted to a bounded sample of labelled documents, gives each document's
evidence. Hosts and the paths in them have posteriors of their own: the mean of their documents' probabilities, shrunk to the
level above (path to host, host to all) by as much as the spread between sites warrants. A document's score combines its
evidence with the posterior its path has without it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import join_groups, slices, written

#: Labelled documents that the classifier is fitted to, those with the lowest hashes, by their whole texts.
TRAIN_DOCS = 4_000
#: Score from which a document is kept.
KEEP = 0.5

FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "bars", "ends", "distinct", "repeats", "lines", "dup_lines")
_SYMBOLS = str.maketrans("", "", "#*$%&|<>!")
_ENDS = str.maketrans("", "", ".,;:?")
_DIGITS = str.maketrans("", "", "0123456789")
_upper = re.compile(r"[^\W\d_a-zß-öø-ÿ]")


def features(text: str) -> list[float]:
    """FEATURES of a text; all are 0 for one without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    lower = sum(1 for _ in _upper.finditer(text))
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), min((chars - n) / n, 50.0), (chars - len(text.translate(_SYMBOLS))) / chars, lower / chars, (chars - len(text.translate(_DIGITS))) / chars, text.count("|") / n,
        (chars - len(text.translate(_ENDS))) / n, len(set(words)) / n, repeats / n, min(len(lines) / n, 1.0), 1 - len(set(lines)) / max(len(lines), 1),
    ]


@dataclass
class Model:
    """Standardised logistic regression; prior is the share of good documents it was fitted to."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return self.weights[0] + z @ self.weights[1:]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Model:
    """Iteratively reweighted least squares with a ridge. Labels all alike (or none) give a model that always says the
    smoothed share of good ones."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.r_[np.log(prior / (1 - prior)), np.zeros(len(FEATURES))], float(prior))
    if not len(y) or y.min() == y.max():
        return base
    base.mean, base.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.c_[np.ones(len(x)), np.clip((x - base.mean) / base.scale, -8, 8)]
    w, penalty = base.weights.copy(), np.r_[1e-6, np.full(len(FEATURES), ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    base.weights = w
    return base


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits the classifier to at most TRAIN_DOCS labelled documents (a bounded sample; null labels and texts are left out).

    Only the sample's ids and labels are joined with texts; texts are measured where they are read.
    """
    order = F.xxhash64(id_col)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"), order.alias("h")).orderBy("h", "id").limit(TRAIN_DOCS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([features(t) for t in batch.column(3).to_pylist()], pa.list_(pa.float64()))], ["h", "id", "y", "x"])

    # at most TRAIN_DOCS rows are broadcast
    measured = texts.join(F.broadcast(chosen), "id").select("h", "id", "y", "text").mapInArrow(run, "h long, id long, y double, x array<double>")
    found = measured.orderBy("h", "id", "x", "y").limit(TRAIN_DOCS).select("y", "x").collect()
    return fit(np.array([r["x"] for r in found]).reshape(-1, len(FEATURES)), np.array([float(r["y"] > 0) for r in found]))


def evidence(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """doc_id, host, path, logit: the classifier's log-odds of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(3).to_pylist()]
            for a, b in slices(texts):
                x = np.array([features(t) for t in texts[a:b]])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(shared.value.logits(x), pa.float64())], ["doc_id", "host", "path", "logit"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(host_col).cast("string"), F.col(path_col).cast("string"), text_col)
    return rows.mapInArrow(run, "doc_id long, host string, path string, logit double")


def _strength(sites: DataFrame, mean: str, above: str, n: str) -> float:
    """Pseudo-documents of the level above, by the method of moments: how far sites' means spread beyond chance. One site, or
    no spread, give the strongest, 1000."""
    spread = F.col(n) * F.pow(F.col(mean) - F.col(above), 2)
    chance = F.col(above) * (1 - F.col(above))
    s = sites.agg(F.sum(spread).alias("ss"), F.sum(chance).alias("v"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("n2"), F.avg(chance).alias("c"), F.count("*").alias("k")).first()
    if not s["n"] or s["k"] < 2:
        return 1000.0
    between = (s["ss"] - s["v"] * (s["k"] - 1) / s["k"]) / max(s["n"] - s["n2"] / s["n"], 1e-9)
    return float(min(max(s["c"] / between - 1, 2.0), 1000.0)) if between > 0 else 1000.0


def hierarchical(rows: DataFrame, prior: float, keep: float = KEEP) -> DataFrame:
    """Scores of rows (doc_id, host, path, logit): doc_id, host, path, evidence (probability by the text alone), host_rate,
    path_rate (posteriors; the path's without the document), score, kept.

    Null hosts and paths are sites; a null id is scored like others; repeated rows count and are scored each; equal scores give
    equal verdicts; an empty table gives no rows. Texts play no part here, and other columns none at all.
    """
    rows = rows.select("doc_id", "host", "path", "logit")
    rows = written(rows.withColumn("p", 1 / (1 + F.exp(-F.col("logit")))), "quality-evidence")
    paths = written(rows.groupBy("host", "path").agg(F.sum("p").alias("path_sum"), F.count("*").alias("path_docs")), "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_docs").alias("host_docs"), F.count("*").alias("host_paths")), "quality-hosts")
    total = hosts.agg(F.sum("host_sum").alias("s"), F.sum("host_docs").alias("n")).first()
    mean = (total["s"] + prior) / (total["n"] + 1) if total["n"] else prior
    k = _strength(hosts.select((F.col("host_sum") / F.col("host_docs")).alias("m"), F.lit(mean).alias("g"), "host_docs"), "m", "g", "host_docs")
    hosts = hosts.withColumn("host_rate", (F.col("host_sum") + k * mean) / (F.col("host_docs") + k))
    sites = join_groups(paths, written(hosts.select("host", "host_paths", "host_rate"), "quality-host-rates"), "host", "host_paths", paths.count())
    sites = written(sites.withColumn("site", F.struct("host", "path")), "quality-sites")
    m = _strength(sites.select((F.col("path_sum") / F.col("path_docs")).alias("m"), F.col("host_rate").alias("g"), "path_docs"), "m", "g", "path_docs")
    out = join_groups(rows.withColumn("site", F.struct("host", "path")), sites.select("site", "path_sum", "path_docs", "host_rate"), "site", "path_docs", rows.count())
    # the document's own probability is taken out of its path's sum
    rate = (F.greatest(F.col("path_sum") - F.col("p"), F.lit(0.0)) + m * F.col("host_rate")) / (F.col("path_docs") - 1 + m)
    rate = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumn("path_rate", rate)
    score = 1 / (1 + F.exp(-(F.col("logit") - float(np.log(prior / (1 - prior))) + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    return out.select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_rate", "path_rate", score.alias("score"), (score >= keep).alias("kept"))


def quality_model(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **columns: str) -> DataFrame:
    """Fits, scores and combines: one row per row of docs, as hierarchical() returns them.

    A null or empty text has features of 0 and is scored by them; very long texts are measured whole; null hosts and paths are
    sites of their own; repeated rows are scored each; an empty table gives no rows; other columns play no part, whatever
    their names. Labels of unknown documents are ignored. If no label is known or all are
    alike, scores follow the sites alone.
    """
    model = train(docs, labels, **{k: v for k, v in columns.items() if k in ("id_col", "text_col")})
    return hierarchical(evidence(docs, model, **columns), model.prior, keep)
