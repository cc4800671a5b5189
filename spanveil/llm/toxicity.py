"""Severity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(score - threshold_k): all thresholds share one weight for each feature, so every grade's
examples teach the same weights. Features are words and their first letters (three to six), counted once for each
different word of a text. Expected severity is the sum of P(grade > k) over k.

The model is fitted on a bounded sample of labelled rows; scoring covers every document and whole texts.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled documents used to fit, at most.
FIT_DOCS = 6000
# A feature needs so many documents, and so many standard deviations between the classes.
LEAST_DOCS = 4
LEAST_Z = 4.0
PREFIXES = (3, 4, 5, 6)
ROUNDS = 400
STEP = 0.1
L1 = 2e-4
# Every so many labelled texts are held out to set the probability from which a text is rejected.
HOLD_OUT = 5

_MARKS = ".,;:!?\"'()[]{}<>|*&-_"
_MEMO_WORDS = 500_000


def features(word: str) -> list[str]:
    """The features of one word (lower case, with marks around it)."""
    core = word.strip(_MARKS)
    return ["=" + core, *("^" + core[:n] for n in PREFIXES if len(core) > n)] if core else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


@dataclass
class OrdinalModel:
    """Weights by feature, thresholds in rising order (one less than there are grades), and P(grade > 0) to reject at."""

    weights: dict[str, float]
    thresholds: list[float]
    reject_at: float = 0.5

    def word_score(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def exceedance(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), one column for each threshold."""
        return _sigmoid(np.asarray(scores, float)[:, None] - np.array(self.thresholds)[None, :])


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def _count(text: str | None) -> Counter:
    return Counter(f for w in words_of(text) for f in features(w))


def fit_ordinal(texts: Iterable[str | None], grades: Iterable[int]) -> OrdinalModel:
    """Fit on labelled texts; grades are 0 .. K - 1, with at least one text of each.

    Features whose share differs by LEAST_Z standard deviations between grade 0 and the others enter; a
    proximal gradient with an L1 penalty sets their weights.
    """
    texts, y = list(texts), np.array(list(grades), int)
    top = int(y.max(initial=0))
    if top < 1 or len(np.unique(y)) != top + 1:
        raise ValueError("grades must run from 0 to at least 1 without a gap")
    bad, good = int((y > 0).sum()), int((y == 0).sum())
    df_bad, df_all = Counter(), Counter()
    # Counts are made twice, not kept: those of all texts would take far more memory than the texts.
    for t, g in zip(texts, y, strict=True):
        found = _count(t).keys()
        df_all.update(found)
        if g:
            df_bad.update(found)
    names = []
    for f, n in df_all.items():
        share = n / len(y)
        gap = df_bad[f] / bad - (n - df_bad[f]) / good
        if n >= LEAST_DOCS and abs(gap) >= LEAST_Z * np.sqrt(share * (1 - share) * (1 / bad + 1 / good)):
            names.append(f)
    names.sort()
    del df_all, df_bad
    place = {f: i for i, f in enumerate(names)}
    rows, cols, values = array("i"), array("i"), array("d")
    for i, t in enumerate(texts):
        for f, n in _count(t).items():
            if f in place:
                rows.append(i), cols.append(place[f]), values.append(float(n))
    rows, cols, values = np.array(rows), np.array(cols), np.array(values)
    weights, theta = np.zeros(len(names)), _start(y, top)
    sum_w, sum_t = np.full(len(names), 1e-8), np.full(top, 1e-8)
    for _ in range(ROUNDS):
        score = np.bincount(rows, values * weights[cols], len(y)) if len(rows) else np.zeros(len(y))
        slope, slope_t = _slopes(score, y, theta)
        grad = np.bincount(cols, values * slope[rows], len(names)) / len(y) if len(rows) else np.zeros(len(names))
        slope_t = slope_t / len(y)
        sum_w += grad**2
        sum_t += slope_t**2
        rate = STEP * 3 / np.sqrt(sum_w)
        weights = weights - rate * grad
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * L1, 0)
        theta = np.maximum.accumulate(theta - STEP * 3 / np.sqrt(sum_t) * slope_t + np.arange(top) * 1e-6)
    return OrdinalModel({f: float(w) for f, w in zip(names, weights, strict=True) if w}, theta.tolist())


def _start(y: np.ndarray, top: int) -> np.ndarray:
    above = np.array([(y > k).mean() for k in range(top)])
    return -np.log(above / (1 - above))


def _slopes(score: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood by score and by threshold."""
    edges = np.r_[-np.inf, theta, np.inf]
    upper, lower = edges[y + 1], edges[y]
    at_upper = np.where(np.isinf(upper), 1.0, _sigmoid(upper - score))
    at_lower = np.where(np.isinf(lower), 0.0, _sigmoid(lower - score))
    chance = np.maximum(at_upper - at_lower, 1e-12)
    rise_upper, rise_lower = at_upper * (1 - at_upper) / chance, at_lower * (1 - at_lower) / chance
    by_theta = np.bincount(y, -rise_upper, len(theta) + 1)[: len(theta)]
    by_theta += np.bincount(np.maximum(y - 1, 0), np.where(y > 0, rise_lower, 0.0), len(theta) + 1)[: len(theta)]
    return rise_upper - rise_lower, by_theta


def severity_grades(texts: list[str | None], toxic: list[int]) -> list[int]:
    """Grades 0, 1, 2 from yes-or-no labels.

    Grade 0 is not toxic. Toxic texts are graded by how many of their different words are typical of toxic
    texts: 2 above the median of the toxic ones, else 1.
    """
    n_bad = sum(map(bool, toxic))
    n_good = len(toxic) - n_bad
    bad, good = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        (bad if y else good).update({w.strip(_MARKS) for w in words_of(t)})
    typical = {w for w, n in bad.items() if n >= LEAST_DOCS and n / n_bad > 10 * (good[w] + 0.5) / max(1, n_good)}
    hits = [len({w.strip(_MARKS) for w in words_of(t)} & typical) for t in texts]
    middle = float(np.median([h for h, y in zip(hits, toxic, strict=True) if y])) if n_bad else 0.0
    return [0 if not y else 2 if h > middle else 1 for h, y in zip(hits, toxic, strict=True)]


def fit_from_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FIT_DOCS) -> OrdinalModel | None:
    """Fit on at most ``most`` labelled documents, those whose ids have the smallest hashes.

    Null labels and null ids are left out; of repeated labels for one id the larger counts. None if a class is missing.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = (
        marked.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # ``most`` rows at most, so they are broadcast and only their texts come to the driver.
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    toxic = [int(r["label"] > 0) for r in rows]
    if len(set(toxic)) < 2:
        return None
    texts_of = [r["text"] for r in rows]
    grades = severity_grades(texts_of, toxic)
    if len(set(grades)) < 3:  # no spread among the toxic ones
        grades = toxic
    return fit_with_cut(texts_of, grades)


def fit_with_cut(texts: list[str | None], grades: list[int]) -> OrdinalModel:
    """Fit on most texts, and set ``reject_at`` on the others.

    The cut lies midway (in log odds) between the highest of all but a thousandth of the clean texts, or a text
    without any feature if that is higher, and the lowest of all but a hundredth of the toxic ones; where these cross,
    it is the cut with the fewest errors.
    """
    held = [i for i in range(len(texts)) if i % HOLD_OUT == 0]
    rest = [i for i in range(len(texts)) if i % HOLD_OUT]
    if set(grades[i] for i in rest) != set(grades) or len({grades[i] > 0 for i in held}) < 2:
        return fit_ordinal(texts, grades)
    model = fit_ordinal([texts[i] for i in rest], [grades[i] for i in rest])
    scores = np.array([sum(map(model.word_score, words_of(texts[i]))) for i in held]) - model.thresholds[0]
    bad = np.array([grades[i] > 0 for i in held])
    clean, toxic = max(np.quantile(scores[~bad], 0.999), -model.thresholds[0]), np.quantile(scores[bad], 0.01)
    if clean < toxic:
        cut = (clean + toxic) / 2
    else:
        errors = [(int(((scores >= c) != bad).sum()), abs(c)) for c in scores]
        cut = scores[int(min(range(len(errors)), key=errors.__getitem__))]
    # Without any feature a text says nothing, however common toxic ones are among the labelled.
    model.reject_at = float(_sigmoid(np.array(max(cut, 1e-3 - model.thresholds[0]))))
    return model


class _Scores(dict):
    def __init__(self, model: OrdinalModel):
        super().__init__()
        self._model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        self[word] = value = self._model.word_score(word)
        return value


def score(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_toxic, expected_severity, grade, rejected for each row of ``docs``.

    A text of at least ``reject_at`` toxic probability is rejected and has grade 1 or more: one for each threshold
    passed with probability one half or more. Null and empty texts have
    no features and are not rejected; without a model (no labels of one class) nothing is.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "p_toxic", "expected_severity", "grade", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(model) if model else None
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            if model is None:
                above = np.zeros((len(texts), 1))
            else:
                # fsum: the order of a set's words must not change the last digits
                above = model.exceedance(np.array([_total(known, t) for t in texts]))
                above[[not t for t in texts]] = 0.0
            toxic, grade = above[:, 0], _grades(above, model)
            columns = [batch.column("doc_id"), pa.array(toxic), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(grade > 0)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return slim.mapInArrow(run, "doc_id long, p_toxic double, expected_severity double, grade int, rejected boolean")


def _grades(above: np.ndarray, model: OrdinalModel | None) -> np.ndarray:
    rejected = above[:, 0] >= (model.reject_at if model else 2.0)
    return np.where(rejected, np.maximum(1, (above >= 0.5).sum(axis=1)), 0)


def _total(known: _Scores, text: str | None) -> float:
    from math import fsum

    return fsum(map(known.__getitem__, words_of(text)))


def drop_toxic(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows, all columns as they are; each row is judged by its own text."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(model) if model else None
        for batch in batches:
            if model is not None:
                texts = [t.as_py() for t in batch.column(text_col)]
                above = model.exceedance(np.array([_total(known, t) for t in texts]))[:, 0]
                above[[not t for t in texts]] = 0.0
                batch = batch.filter(pa.array(above < model.reject_at))
            yield batch

    return docs.mapInArrow(run, schema)
