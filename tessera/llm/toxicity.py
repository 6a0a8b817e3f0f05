"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w.x - theta_k): one weight vector for all thresholds, thetas in order. The
features are words and word beginnings whose presence parts the grades; expected severity is the sum
of P(grade > k) over k. Grades are those of the labels: with 0 and 1 alone there is one threshold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, row_without, stored, table, texts

#: At most so many labelled rows are fitted, those with the least hash of their id.
SAMPLE = 12_000
#: Documents that a feature needs, its least z-score, features at most, and P(grade > 0) from which a text is rejected.
MIN_DF, LEAST_Z, MAX_FEATURES, CUT = 6, 6.0, 512, 0.5
_BLANK = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z lower-cased; ASCII digits, marks and blanks part them."""
    return text.translate(_BLANK).split()


def features(text: bytes, known=None) -> Counter:
    """Counts of words and of their leading 4, 5 and 6 bytes; only those in `known` if it is given.

    Leading bytes let an insult's inflected forms share one weight. A word shorter than a prefix has
    no such prefix; the prefix is marked by a trailing star.
    """
    w = tokens(text)
    stems = [x[:k] + b"*" for k in (4, 5, 6) for x in w if len(x) >= k]
    if known is not None:
        return Counter([x for x in w if x in known] + [x for x in stems if x in known])
    return Counter(w + stems)


def _tail(eta: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade > k), a column for each k, with 1 before the first and 0 after the last."""
    p = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta[None, :], -35, 35)))
    return np.hstack([np.ones((len(eta), 1)), p, np.zeros((len(eta), 1))])


def fit_ordinal(x: np.ndarray, y: np.ndarray, n_grades: int, ridge: float = 0.005, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least negative log-likelihood plus ridge/2 * |w|^2, by Newton steps.

    x: one row per document; y: its grade. Each round moves the weights and a common shift of all
    thresholds together, then each threshold alone, and halves a step that does not help.
    """
    at, x = np.arange(len(y)), np.hstack([np.ones((len(y), 1)), x])
    above = np.array([(y > k).sum() for k in range(n_grades - 1)], dtype=float)
    theta = np.sort(np.log((len(y) - above + 0.5) / (above + 0.5)))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-9

    def loss(w: np.ndarray, theta: np.ndarray) -> float:
        p = _tail(x @ w, theta)
        return -np.log(np.maximum(p[at, y] - p[at, y + 1], 1e-300)).sum() + 0.5 * (penalty * w * w).sum()

    now = loss(w, theta)
    for _ in range(rounds):
        p = _tail(x @ w, theta)
        up, down = p[at, y], p[at, y + 1]
        grad = x.T @ (up + down - 1) + penalty * w
        hess = (x * (up * (1 - up) + down * (1 - down))[:, None]).T @ x + np.diag(penalty)
        move, size = np.linalg.solve(hess + 1e-8 * np.eye(len(w)), grad), 1.0
        while size > 1e-4 and loss(w - size * move, theta) > now:
            size /= 2
        if size > 1e-4:
            w = w - size * move
        p = _tail(x @ w, theta)
        up, down = p[at, y], p[at, y + 1]
        like = np.maximum(up - down, 1e-12)
        for k in range(1, n_grades - 1):  # the first stays: the shift moves it
            g = -(down * (1 - down) / like)[y == k].sum() + (up * (1 - up) / like)[y == k + 1].sum()
            tried = theta.copy()
            tried[k] -= np.clip(g / (len(y) * 0.02 + abs(g)), -1, 1)
            if (np.diff(tried) > 0).all() and loss(w, tried) < loss(w, theta):
                theta = tried
        after = loss(w, theta)
        if now - after < 1e-7 * max(1.0, now):
            break
        now = after
    return w[1:], theta - w[0]


def fit_words(x: np.ndarray, y: np.ndarray, names: list[bytes], n_grades: int) -> tuple[dict[bytes, float], list[float]]:
    """Weights of the features and the thresholds; x[i, j]: whether document i has feature j, strongest first.

    A feature whose documents all have a stronger one of the same sign that is as pure gets no weight
    where there are two grades; more grades need all features to tell the upper ones apart.
    """
    if not len(y):
        return {}, [math.inf] * (n_grades - 1)
    share, kept = (y > 0).mean(), []
    rate = [(y[x[:, j]] > 0).mean() - share if x[:, j].any() else 0.0 for j in range(len(names))]
    for j in range(len(names)):
        if n_grades > 2 or not any((x[:, j] <= x[:, k]).all() for k in kept if rate[k] * rate[j] > 0 and abs(rate[k]) >= abs(rate[j]) - 0.02):
            kept.append(j)
    w, theta = fit_ordinal(x[:, kept].astype(float), y, n_grades)
    return {names[j]: float(v) for j, v in zip(kept, w, strict=True)}, [float(t) for t in theta]


def fit_toxicity(labelled: DataFrame, grade: str = "grade", text: str = "text", key: str = "doc_id", n_grades: int = 2, sample: int = SAMPLE) -> tuple[dict[bytes, float], list[float]]:
    """Fit on at most `sample` rows; null grades are left out, null texts are empty.

    The rows are those with the least xxhash64 of the key; equal texts of one grade count once, so
    that copies do not pass for evidence. The features' document counts are summed by Spark, and at
    most MAX_FEATURES that part grade 0 from the rest (|z| >= LEAST_Z, MIN_DF documents) are kept. One
    task fits the documents' kept features, which the two bounds limit; the driver gets the weights.
    """
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), texts(b, "_text"), strict=True):
                f = list(features(t))
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array([int(g > 0)] * len(f), pa.int64())], names=["feature", "high"])

    rows = labelled.where(F.col(grade).isNotNull()).select(F.xxhash64(key).alias("_h"), F.col(key).alias("_key"), F.least(F.greatest(F.col(grade), F.lit(0)), F.lit(n_grades - 1)).cast("int").alias("grade"), F.col(text).alias("_text"))
    chosen = rows.select("_h", "_key").orderBy("_h", "_key").limit(sample).distinct()  # ids first: texts stay where they are
    few = stored(rows.join(F.broadcast(chosen), ["_h", "_key"], "left_semi").select("grade", F.coalesce("_text", F.lit("")).alias("_text")).distinct(), "toxicity-sample")
    total = few.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("grade") > 0).cast("long")), F.lit(0)).alias("high")).first()
    share = min(max(total.high / max(1, total.n), 1e-6), 1 - 1e-6)
    df = few.mapInArrow(explode, "feature binary, high long").groupBy("feature").agg(F.count(F.lit(1)).alias("df"), F.sum("high").alias("high"))
    z = F.abs(F.col("high") - F.col("df") * share) / F.sqrt(F.col("df") * (share * (1 - share)))
    strong = df.where(F.col("df") >= MIN_DF).withColumn("z", F.round(z, 9)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
    names = [bytes(r.feature) for r in strong]
    place = {w: j for j, w in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted(place[w] for w in features(t, place)) for t in texts(b, "_text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=["grade", "at"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = sorted((g, at) for b in batches for g, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        x = np.zeros((len(docs), len(names)), dtype=bool)
        for i, (_, at) in enumerate(docs):
            x[i, at] = True
        w, theta = fit_words(x, np.array([g for g, _ in docs], dtype=int), names, n_grades)
        out = sorted(w.items()) + [(None, t) for t in theta]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([v for _, v in out], pa.float64())], names=["word", "weight"])

    got = few.mapInArrow(present, "grade int, at array<int>").repartition(1).mapInArrow(fit, "word binary, weight double").collect()
    return {bytes(r.word): r.weight for r in got if r.word is not None}, [r.weight for r in got if r.word is None] or [math.inf] * (n_grades - 1)


def score_toxicity(df: DataFrame, model: tuple[dict[bytes, float], list[float]], text: str = "text", cut: float = CUT) -> DataFrame:
    """df with p_toxic (P(grade > 0)), expected_severity, grade (the likeliest), rejected (p_toxic >= cut).

    Columns of df with those names are replaced. Null and empty texts have no words: their score is
    the thresholds' alone. Repeated rows score alike.
    """
    new = ("p_toxic", "expected_severity", "grade", "rejected")
    return df.select(row_without(df, *new).alias("row"), _scores(text, model).alias("s")).select(*columns_of(df, *new), "s.*", (F.col("s.p_toxic") >= cut).alias("rejected"))


def drop_toxic(df: DataFrame, model: tuple[dict[bytes, float], list[float]], text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of df that score_toxicity does not reject, all columns as they are."""
    return df.select(row_without(df).alias("row"), _scores(text, model).alias("s")).where(F.col("s.p_toxic") < cut).select(*columns_of(df))


def _scores(text: str, model: tuple[dict[bytes, float], list[float]]) -> Column:
    weights, theta = model[0], np.array(model[1])
    fields = "p_toxic double, expected_severity double, grade int"

    def score(s: pa.Array) -> pa.Array:
        eta = np.array([sum(weights[w] for w in sorted(features(t or b"", weights))) for t in s.cast(pa.large_binary()).to_pylist()], dtype=float)
        p = _tail(eta, theta)
        likely = (p[:, :-1] - p[:, 1:]).argmax(axis=1).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(p[:, 1].round(6)), pa.array(p[:, 1:-1].sum(axis=1).round(6)), pa.array(likely)], names=["p_toxic", "expected_severity", "grade"])

    return F.arrow_udf(score, fields)(F.col(text).cast("string"))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grade: str = "toxic") -> DataFrame:
    """The texts of at most `sample` labelled documents, with their grade, the greatest of a document's labels."""
    one = labels.select("doc_id", F.col(grade).cast("int").alias("grade")).dropna().groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(labelled(docs, table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).drop("text")
