"""Toxicity by a convolutional text classifier.

A word is the sum of hashed embeddings (the word and its prefixes), filters of
widths 1, 2 and 3 slide over the words, each filter's largest response in the
whole text is kept, and a logistic unit scores those maxima.

Training is plain numpy on the driver over a bounded sample of labelled rows
(``POSITIVES`` and ``NEGATIVES`` at most, chosen by a hash of their ids); the
first embedding dimension starts as the bucket's log odds.  Scoring runs in
the tasks over whole texts of any length: a word's response to every filter
position is computed once and remembered, long texts go through in blocks.

Learning rows that the network was not trained on calibrate it, all of them, by
counts per language and fine bin of the log odds: the score of 0.5 lies where the
decision has the best F1 on them, whatever the language; beside that each
language gets its own threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.llm.common import bounded_join, cut, held_out, text_udf

#: Bounds of the training sample (documented parameters of the model).
POSITIVES, NEGATIVES = 2000, 4000
#: Bins of calibration rows per unit of log odds, which are kept within -MOST_ODDS and MOST_ODDS.
BINS, MOST_ODDS = 256, 35
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
STEPS, RATE, SMOOTHING = 12_000, 0.05, 2.0
#: A language's threshold is the lowest score from which on so many flagged rows are toxic.
PRECISION = 0.9
#: Toxic calibration rows from which on they are trusted.
LEAST_TOXIC = 10
BLOCK, REMEMBERED = 8192, 60_000
EDGES = ".,;:!?%*&$#|\"'()[]<>"


def words_of(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


def buckets(word: str) -> list[int]:
    """Hash buckets of a word and its prefixes; always 1 + len(PREFIXES) of them."""
    raw = word.encode("utf-8", "replace")
    return [zlib.crc32(raw) % BUCKETS] + [
        zlib.crc32(f"{n}:{word[:n]}".encode("utf-8", "replace")) % BUCKETS for n in PREFIXES
    ]


@dataclass
class Network:
    table: np.ndarray  # (BUCKETS, DIMS)
    taps: list[np.ndarray]  # per width: (width, DIMS, FILTERS)
    bias: np.ndarray  # (widths * FILTERS)
    out: np.ndarray  # (widths * FILTERS)
    base: float
    shift: float = 0.0  # added to the log odds


def _embedded(net: Network, words: np.ndarray, of_word: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Vectors of a text's words at some places; zeros behind its end."""
    x, within = np.zeros((len(places), DIMS), np.float32), places < len(words)
    x[within] = net.table[of_word[words[places[within]]]].sum(1)
    return x


def _pooled(net: Network, words: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter and where it begins, over the whole text by blocks."""
    filters, loose = np.arange(FILTERS), max(WIDTHS) - 1
    best, at = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.int64)
    for s in range(0, len(words), BLOCK):
        n = min(BLOCK, len(words) - s)
        x = _embedded(net, words, of_word, np.arange(s, s + n + loose))
        for wi, (w, taps) in enumerate(zip(WIDTHS, net.taps)):
            z = sum(x[j : j + n] @ taps[j] for j in range(w))
            a = z.argmax(0)
            top, own = z[a, filters], slice(wi * FILTERS, (wi + 1) * FILTERS)
            higher = top > best[own]
            best[own] = np.where(higher, top, best[own])
            at[own] = np.where(higher, s + a, at[own])
    return best + net.bias, at


def log_odds(ids: Iterable[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Smoothed log odds of label 1 for texts that have a bucket."""
    seen = np.zeros((2, BUCKETS))
    for x, label in zip(ids, y):
        seen[label, np.unique(x)] += 1
    rate = [(seen[c] + SMOOTHING) / ((y == c).sum() + 2 * SMOOTHING) for c in (0, 1)]
    return np.log(rate[1] / rate[0])


def train(texts: Iterable[str], y: np.ndarray, seed: int = 7) -> Network:
    """A network from texts and labels (0 or 1) by stochastic gradient descent."""
    return _train(*_numbered(texts), y, seed)


def _numbered(texts: Iterable[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text as the numbers of its words, and the buckets of each word, kept once."""
    place: dict[str, int] = {}
    ids = [np.array([place.setdefault(w, len(place)) for w in words_of(t) or [""]], np.int32) for t in texts]
    return ids, np.array([buckets(w) for w in place], np.int32)


def _train(ids: list[np.ndarray], of_word: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (BUCKETS, DIMS)).astype(np.float32)
    odds = log_odds((of_word[x] for x in ids), y)
    table[:, 0] = odds / (1 + len(PREFIXES))
    k = len(WIDTHS) * FILTERS
    taps = [rng.normal(0, 0.1, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for t in taps:
        t[:, 0, :] = rng.uniform(0.5, 1.0, (len(t), FILTERS)) / len(t)
    net = Network(table, taps, np.full(k, -1.0, np.float32), np.full(k, 1.0 / k, np.float32), -2.0)
    filters = np.arange(FILTERS)
    for epoch in range(-(-STEPS // len(ids))):
        rate = RATE / (1 + epoch * len(ids) / 6000)
        for i in rng.permutation(len(ids)):
            m, at = _pooled(net, ids[i], of_word)
            h = np.maximum(m, 0)
            z = float(h @ net.out) + net.base
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            if abs(d) < 0.01:
                continue
            dh = d * net.out * (m > 0)
            dx: dict[int, np.ndarray] = {}
            for wi, (w, t) in enumerate(zip(WIDTHS, net.taps)):
                g, a = dh[wi * FILTERS : (wi + 1) * FILTERS], at[wi * FILTERS : (wi + 1) * FILTERS]
                for j in range(w):
                    gx = t[j] * g  # (DIMS, FILTERS)
                    x = _embedded(net, ids[i], of_word, a + j)
                    for f in filters[g != 0]:
                        p = int(a[f]) + j
                        if p < len(ids[i]):
                            dx[p] = dx.get(p, 0) + gx[:, f]
                    t[j] -= rate * (x.T * g)
            net.out -= rate * d * h
            net.base -= rate * d
            net.bias -= rate * dh
            for p, g in dx.items():
                np.subtract.at(net.table, of_word[ids[i][p]], rate * np.clip(g, -1, 1))
    return net


def scorer(net: Network | None, raw: bool = False) -> Callable[[str], float]:
    """A function from a text to its score, or with ``raw`` to its log odds; texts without
    words score what silence scores."""
    if net is None:
        return lambda text: 0.5
    # all taps side by side: a word's contribution to every filter at every offset
    side = np.concatenate([t.transpose(1, 0, 2).reshape(DIMS, -1) for t in net.taps], axis=1)
    cols, at = [], 0
    for w in WIDTHS:
        cols.append([slice(at + j * FILTERS, at + (j + 1) * FILTERS) for j in range(w)])
        at += w * FILTERS
    place: dict[str, int] = {}
    rows = np.zeros((REMEMBERED, at), np.float32)

    def block(words: list[str], last: bool) -> np.ndarray:
        """Largest responses within a block, without bias; only behind the text's end may a
        filter reach beyond its words."""
        if len(place) + len(words) > REMEMBERED:
            place.clear()
        new = [w for w in dict.fromkeys(words) if w not in place]
        if new:
            first = len(place)
            ids = np.array([buckets(w) for w in new])
            rows[first : first + len(new)] = net.table[ids].sum(1) @ side
            place.update(zip(new, range(first, first + len(new))))
        r = rows[[place[w] for w in words]]
        n, best = len(r), []
        for parts in cols:
            z = r[:, parts[0]]
            if len(parts) > 1:
                z = z.copy()
                for j, part in enumerate(parts[1:], 1):
                    z[: n - j] += r[j:, part]
            best.append((z if last else z[: n - len(parts) + 1]).max(0))
        return np.concatenate(best)

    def one(text: str) -> float:
        words = words_of(text) or [""]
        # blocks overlap, so that each place is the whole of a filter's in one of them
        step, best = BLOCK - max(WIDTHS) + 1, None
        for at in range(0, max(1, len(words) - max(WIDTHS) + 1), step):
            got = block(words[at : at + BLOCK], at + BLOCK >= len(words))
            best = got if best is None else np.maximum(best, got)
        z = float(np.maximum(best + net.bias, 0) @ net.out) + net.base + net.shift
        z = float(np.clip(z, -MOST_ODDS, MOST_ODDS))
        return z if raw else float(1 / (1 + np.exp(-z)))

    return one


def _sample(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``text, toxic`` of at most ``NEGATIVES`` + ``POSITIVES`` marked ids, those of smallest
    hash, in one scan; the id list is bounded and broadcast.  Of an id's rows one is
    taken, that of the smallest text."""
    chosen = [
        marks.where(F.col("toxic") == label).orderBy(F.xxhash64("of", F.lit(5)), "of").limit(n)
        for label, n in ((0, NEGATIVES), (1, POSITIVES))
    ]
    ids = F.broadcast(chosen[0].union(chosen[1]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("of"))
    return rows.groupBy("of", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _for_rates() -> Column:
    """The learning ids that calibrate."""
    return F.pmod(F.xxhash64("of", F.lit(3)), F.lit(6)) == 0


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Network, DataFrame] | None:
    """Network and ``lang, threshold`` from the labelled rows that are not held out; None without both labels.

    Of the learning rows one hash class in six is kept for calibration."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    learn = marks.where(~_for_rates())
    marked: list[tuple[int, int]] = []

    def texts() -> Iterable[str]:
        for r in _sample(docs, learn).toLocalIterator():
            marked.append((zlib.crc32(r["text"].encode("utf-8", "replace")), r["toxic"]))
            yield r["text"]

    # texts pass one by one, only the numbers of their words stay
    ids, of_word = _numbered(texts())
    y = np.array([label for _, label in marked])
    if len(set(y.tolist())) < 2:
        return None
    order = sorted(range(len(ids)), key=lambda i: (*marked[i], ids[i].tolist()))
    net = _train([ids[i] for i in order], of_word, y[order])
    net.shift = float(np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum()))
    return net, calibrate(net, docs, marks.where(_for_rates()))


def best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, half: float = 0.0) -> float:
    """Log odds from which on calling a row toxic has the best F1, halfway between two
    neighbouring rows; of several best cuts the middle one.

    For bins ``z`` are their middles, ``y`` their toxic rows, ``n`` all their rows
    and ``half`` half their width."""
    n = np.ones(len(z), np.int64) if n is None else n
    down = np.argsort(-z, kind="stable")
    z, y, n = z[down], y[down], n[down]
    f1 = 2 * np.cumsum(y) / (np.cumsum(n) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # no cut between equal rows
    best = np.flatnonzero(f1 == f1.max())
    i = best[len(best) // 2]
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i]) - half


def calibration_counts(net: Network, docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``lang, bin, n, toxic`` of all rows of ``docs`` with an id of ``marks(of, toxic)``.

    Rows are chosen by the hash of their id and scored where they are; only their
    counts by id, language and bin are joined, so repeated ids are small, too."""
    of = F.col("doc_id").cast(marks.schema["of"].dataType)
    rows = docs.select(of.alias("of"), "text", _lang()).where(
        F.col("of").isNotNull() & ~held_out(F.col("of")) & _for_rates()
    )
    odds = text_udf("double", lambda: scorer(net, raw=True))(F.col("text"))
    scored = rows.select("of", "lang", odds.alias("z")).withColumn("bin", F.floor(F.col("z") * BINS))
    counted = scored.groupBy("of", "lang", "bin").agg(F.count("*").alias("n")).join(marks, "of")
    return cut(counted.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")))


def calibrate(net: Network, docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Sets the shift from all rows of ``marks``' ids and gives ``lang, threshold``; with
    fewer than ``LEAST_TOXIC`` toxic ones the shift stays as it is.

    A language's threshold is the lowest bin's edge of precision ``PRECISION``; languages
    with fewer than ``LEAST_TOXIC`` toxic rows are not among them."""
    counts = calibration_counts(net, docs, marks)
    bins = counts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect()
    z, y, n = (np.array([r[c] for r in bins], np.int64) for c in ("bin", "toxic", "n"))
    moved = best_cut((z + 0.5) / BINS, y, n, 0.5 / BINS) if y.sum() >= LEAST_TOXIC else 0.0
    net.shift -= moved
    return thresholds(counts, moved)


def thresholds(counts: DataFrame, moved: float) -> DataFrame:
    """``lang, threshold`` from the counts; the scores' log odds are less by ``moved``."""
    above = Window.partitionBy("lang").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    good = F.sum("toxic").over(above) >= PRECISION * F.sum("n").over(above)
    lowest = (
        counts.withColumn("good", good)
        .groupBy("lang")
        .agg(F.sum("toxic").alias("toxic"), F.min(F.when(F.col("good"), F.col("bin"))).alias("bin"))
        .where((F.col("toxic") >= LEAST_TOXIC) & F.col("bin").isNotNull())
    )
    return lowest.select("lang", (1 / (1 + F.exp(moved - F.col("bin") / BINS))).alias("threshold"))


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")


def score_column(net: Network | None, text: Column) -> Column:
    return text_udf("double", lambda: scorer(net))(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, flagged`` for every row of
    ``docs(doc_id, text, lang)``; null texts count as empty, empty texts have a
    score, repeated rows each give a row, other columns are ignored.  Without
    labels of both classes every score is 0.5."""
    net, limits = fit(docs, labels) or (None, None)
    rows = docs.select("doc_id", "text", _lang())
    if net is None:
        rows = rows.withColumn("threshold", F.lit(0.5))
    else:
        of_lang = rows.groupBy("lang").agg(F.count("*").alias("rows")).join(limits, "lang", "left")
        of_lang = cut(of_lang.withColumn("threshold", F.coalesce("threshold", F.lit(0.5))).select("lang", "threshold", "rows"))
        rows = bounded_join(rows, of_lang, "lang", "rows", of_lang.agg(F.sum("rows")).first()[0] or 0)
    scored = rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score_column(net, F.col("text")).alias("score"),
        "threshold",
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn(
        "flagged", F.col("score") >= F.col("threshold")
    )
