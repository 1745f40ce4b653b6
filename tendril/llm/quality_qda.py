"""Quality classifier: regularised quadratic discriminant analysis.

Each class is a Gaussian over transformed statistics of the text.  Its mean
and covariance come from one pass over *all* learning rows (sums of the
features and of their products, added up per task before the shuffle); the
covariance is shrunk towards the pooled one and a scaled identity.  A score
is the difference of the two Mahalanobis log densities plus the log prior,
computed with Cholesky factors that are built once and sent with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.llm.common import cut, fresh, held_out, text_udf

ACCEPT = 0.3
#: Weights of the pooled covariance and of the scaled identity.
TO_POOLED, TO_IDENTITY = 0.1, 0.02
#: Log odds are bent towards +-BEND, so that distinct odds stay distinct scores.
BEND = 30.0
#: Few words say little: shares are averaged with those of plain prose, which
#: weigh as much as PRIOR_WORDS words, and counts start at LEAST_WORDS.
PRIOR_WORDS, LEAST_WORDS = 10, 30

FEATURES = [
    "log_words", "symbol_share", "vocabulary_power", "capital_share", "word_length", "word_length_spread",
    "marked_words", "repeated_lines", "short_words", "digit_share", "letter_share", "new_pairs", "line_length",
]


#: Values of the features in plain prose, in the order of FEATURES (fixed values).
PROSE = np.array(
    [np.log1p(LEAST_WORDS), 0, 0.95, 0.12, 5.0, 1.3, 0.39, 0, 0.63, 0, 0.8, 0.95, np.log1p(LEAST_WORDS)]
)


def features(text: str) -> np.ndarray:
    """Transformed statistics of a whole text; those of PROSE without words."""
    words = text.split()
    n = len(words)
    if not n:
        return PROSE.copy()
    chars = max(1, len(text))
    ascii_ = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    counts = np.bincount(ascii_, minlength=128)
    symbols = sum(int(counts[ord(c)]) for c in "#*$%&|<>!") / chars
    capitals = counts[65:91].sum() / chars
    digits = counts[48:58].sum() / chars
    letters = (counts[65:91].sum() + counts[97:123].sum()) / chars
    size = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    marked = sum(not w[-1].isalnum() for w in words) / n
    x = np.array(
        [
            np.log1p(max(n, LEAST_WORDS)),
            np.sqrt(symbols),
            np.log1p(distinct) / np.log1p(n),
            np.sqrt(capitals),
            size.mean(),
            np.log1p(size.std()),
            np.sqrt(marked),
            np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
            np.sqrt((size <= 3).mean()),
            np.sqrt(digits),
            letters,
            (pairs + 1) / n,
            np.log1p(max(n, LEAST_WORDS) / max(1, len(lines))),
        ]
    )
    return PROSE + (x - PROSE) * (n / (n + PRIOR_WORDS))


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # inverse of the Cholesky factor
    log_norm: float  # log prior minus half the log determinant

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return self.log_norm - 0.5 * np.einsum("...i,...i->...", z, z)


def features_column(text: Column) -> Column:
    """The features of a text column; null texts count as empty."""
    return text_udf("array<double>", lambda: features)(text)


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and class: rows, sums of the features and of their products."""
    k = len(FEATURES)
    total = {c: np.zeros(1 + k + k * k) for c in (0, 1)}
    for rows in batches:
        for c, own in rows.groupby("label"):
            x = np.stack(own["features"].to_numpy())
            total[int(c)] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
    yield pd.DataFrame(
        [(c, i, v) for c, sums in total.items() if sums[0] for i, v in enumerate(sums)], columns=["label", "i", "v"]
    )


def fit(learn: DataFrame) -> list[Gaussian] | None:
    """Class models of ``learn(features, label)`` over all its rows, label 0 or 1.

    Without rows of both classes there is no model (None)."""
    sums = learn.where(F.col("label").isin(0, 1)).select("features", "label").mapInPandas(
        _moments, "label int, i int, v double"
    )
    k = len(FEATURES)
    got = np.zeros((2, 1 + k + k * k))  # 2 * 183 numbers, whatever the corpus
    for c, i, v in sums.groupBy("label", "i").agg(F.sum("v")).collect():
        got[c, i] = v
    n = got[:, 0]
    if not n.all():
        return None
    mean = got[:, 1 : k + 1] / n[:, None]
    cov = [got[c, k + 1 :].reshape(k, k) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    out = []
    for c in (0, 1):
        s = (1 - TO_POOLED - TO_IDENTITY) * cov[c] + TO_POOLED * pooled
        s = s + TO_IDENTITY * np.diag(np.diag(pooled)) + 1e-6 * np.eye(k)
        low = np.linalg.cholesky(s)
        log_norm = np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum()
        out.append(Gaussian(mean[c], np.linalg.inv(low), float(log_norm)))
    return out


def score_column(model: list[Gaussian] | None, feats: Column) -> Column:
    """Probability of label 1 from a column of features, bent so that extreme odds do not tie."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            if model is None or not len(rows):
                yield pd.Series(np.full(len(rows), 0.5))
                continue
            x = np.stack(rows.to_numpy())
            z = model[1].log_density(x) - model[0].log_density(x)
            yield pd.Series(1 / (1 + np.exp(-BEND * z / (BEND + np.abs(z)))))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(feats)


def _learn_rows(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """``features, label`` of all labelled rows of ``feats(doc_id, features)`` that are
    not held out; only ids and features are shuffled, never texts.  An id with several
    labels counts as 1 if one of them is."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").cast("int").alias("label"))
    learn = feats.where(~held_out(F.col("doc_id")))
    return learn.join(marks, F.col("doc_id") == F.col("of")).select("features", "label")


def _featured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", features_column(F.col("text")).alias("features"))


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Null texts count as empty, an empty text has a score too; repeated rows
    each give a row; without labels of both classes every score is 0.5.  The
    features are stored once, for learning and for scoring."""
    feats = cut(_featured(docs))
    model = fit(_learn_rows(feats, labels))
    return feats.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("features")).alias("score")
    ).withColumn("predicted", (F.col("score") >= accept).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns."""
    model = fit(_learn_rows(_featured(docs), labels))
    (s,) = fresh(docs, "quality_score")
    return docs.withColumn(s, score_column(model, features_column(F.col("text")))).where(F.col(s) >= accept).drop(s)
