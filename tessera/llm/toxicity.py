"""Toxicity by non-negative positive-unlabelled learning of a linear model in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, in_fold, small_batches, table, words_of

#: Bounds of the sample of labelled rows that the classifier is fitted on: known toxic rows, and rows taken as unlabelled.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000
#: A feature is a word of so many unlabelled texts at least, by so many standard errors more or less common in positive ones; the most telling are kept.
MIN_DOCS, MIN_Z, MAX_WORDS = 5, 4.0, 100_000


@dataclass
class Toxicity:
    """A linear score over the distinct words of a text: ``words`` (sorted 64-bit hashes), their weights, and a bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, hashes: np.ndarray) -> float:
        if not len(self.words) or not len(hashes):
            return self.bias
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return self.bias + float(self.weights[at[self.words[at] == hashes]].sum())

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(np.unique(hash_words(_tokens(text)))), -30, 30))))


_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _tokens(text: str | None) -> list[bytes]:
    return [w.strip(_EDGES) for w in words_of(text)]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4, min_docs: int = MIN_DOCS, min_z: float = MIN_Z, max_words: int = MAX_WORDS) -> Toxicity:
    """Minimise the non-negative PU risk  prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])  by Adam.

    l is the logistic loss. Where the second part is below 0, a step follows its own gradient upwards instead (Kiryo et al. 2017), so the model
    can't drive the estimate of the negative risk below 0 by over-fitting. Features are words of ``min_docs`` unlabelled texts or more
    whose share of positive texts differs from their share of unlabelled ones by ``min_z`` standard errors: a weight for every
    rare word would only learn the sample by heart. Without positives or prior, every text scores 0.
    """
    if not positive or not unlabelled or not 0 < prior < 1:
        return Toxicity(np.empty(0, np.uint64), np.empty(0), -30.0 if prior < 1 else 30.0)
    words, docs = np.unique(np.concatenate(unlabelled), return_counts=True)
    in_p, p_docs = np.unique(np.concatenate(positive), return_counts=True)
    known = np.isin(in_p, words)
    share, rate_u = np.zeros(len(words)), docs / len(unlabelled)
    share[np.searchsorted(words, in_p[known])] = p_docs[known] / len(positive)
    z = np.abs(share - rate_u) / np.sqrt(rate_u * (1 - rate_u) / len(positive) + 1e-12)
    picked = np.flatnonzero((docs >= min_docs) & (z >= min_z))
    words = np.sort(words[picked[np.argsort(-z[picked], kind="stable")[:max_words]]])

    def rows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Word and row of each entry."""
        flat = np.concatenate(texts)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1))
        known = words[at] == flat if len(words) else np.zeros(len(flat), bool)
        return at[known].astype(np.int32), row[known].astype(np.int32)

    (pw, pr), (uw, ur) = rows(positive), rows(unlabelled)
    n_p, n_u, n = len(positive), len(unlabelled), len(words)
    w, b = np.zeros(n + 1), np.log(prior / (1 - prior))
    w[n] = b
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    loss = lambda x: np.logaddexp(0, -x)
    for t in range(1, rounds + 1):
        gp = np.bincount(pr, w[pw], n_p) + w[n]
        gu = np.bincount(ur, w[uw], n_u) + w[n]
        negative = loss(-gu).mean() - prior * loss(-gp).mean()
        d_pos, d_neg_p, d_neg_u = -prior * sigmoid(-gp) / n_p, -prior * sigmoid(gp) / n_p, sigmoid(gu) / n_u
        if negative >= 0:
            dp, du = d_pos + d_neg_p, d_neg_u
        else:
            dp, du = -d_neg_p, -d_neg_u
        g = np.zeros(n + 1)
        g[:n] = np.bincount(pw, dp[pr], n) + np.bincount(uw, du[ur], n) + decay * w[:n]
        g[n] = dp.sum() + du.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Toxicity(words, w[:n], float(w[n]))


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0), max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Fit on labelled rows outside the held-out fold (crc32 of the id as text, modulo ``fold[0]``, is ``fold[1]``).

    Positives are rows labelled toxic, at most about ``max_positive`` of them; the unlabelled side is drawn from all labelled rows with the
    label hidden, at most about ``max_unlabelled``. Both are drawn by a hash of the id, so reruns agree. The class prior is the
    share of toxic rows over all labelled training rows. Null labels and ids are left out; of repeated ids the largest label counts.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), *fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_pos = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    n_pos = n_pos or 0
    u = F.xxhash64(F.lit(5), "doc_id") / F.lit(2.0**64) + 0.5
    v = F.xxhash64(F.lit(6), "doc_id") / F.lit(2.0**64) + 0.5
    sample = known.select(F.col("doc_id").alias("__id"), ((F.col("toxic") == 1) & (u < max_positive / max(1, n_pos))).alias("p"), (v < max_unlabelled / max(1, n)).alias("u")).filter("p OR u")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    held = texts.join(F.broadcast(sample), "__id").select("p", "u", "text")  # the sample is bounded by the two sizes

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [np.unique(hash_words(_tokens(t.as_py()))).view(np.int64) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(words, pa.list_(pa.int64()))], ["p", "u", "words"])

    rows = table(held.mapInArrow(features, "p boolean, u boolean, words array<long>").withColumn("row", F.monotonically_increasing_id()), "toxic-rows")
    n_p, n_u = (x or 0 for x in rows.agg(F.sum(F.col("p").cast("int")), F.sum(F.col("u").cast("int"))).first())
    if not n_p or not n_u:
        return fit([], [], n_pos / max(1, n))
    # Words that can't be features for ``fit`` go before anything leaves the executors, so the driver gets short rows however long texts are.
    words = rows.select("p", "u", F.explode("words").alias("h")).groupBy("h").agg(F.sum(F.col("p").cast("int")).alias("in_p"), F.sum(F.col("u").cast("int")).alias("in_u"))
    rate = F.col("in_u") / n_u
    z = F.abs(F.col("in_p") / n_p - rate) / F.sqrt(rate * (1 - rate) / n_p + 1e-12)
    useful = words.filter((F.col("in_u") >= MIN_DOCS) & (z >= MIN_Z)).select("h", z.alias("z")).orderBy(F.desc("z"), "h").limit(MAX_WORDS).select("h")
    got = rows.select("row", "p", "u", F.explode("words").alias("h")).join(useful, "h", "left_semi").groupBy("row").agg(F.collect_list("h").alias("words"))  # at most MAX_WORDS words a row
    got = rows.select("row", "p", "u").join(got, "row", "left_outer").select("p", "u", F.coalesce("words", F.array().cast("array<long>")).alias("words")).collect()
    sets = sorted((sorted(r["words"]), r["p"], r["u"]) for r in got)
    as_array = lambda x: np.sort(np.array(x, np.int64).view(np.uint64))
    return fit([as_array(x) for x, p, _ in sets if p], [as_array(x) for x, _, u in sets if u], n_pos / max(1, n))


def scorer(model: Toxicity):
    """A pandas UDF text -> score in [0, 1]; null and empty texts get the score of a text without known words."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([model.score(x) for x in t], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Empty and null texts are scored by the bias alone; a very long text by its distinct words, whole. A score of exactly 0.5 is predicted toxic. Repeated rows are scored each; a null id is never held out and never trained on.
    An empty table gives no rows. Other columns are ignored; labels are used for nothing but training outside the fold.
    """
    model = train(docs, labels, fold, id_col=id_col, text_col=text_col, **options)
    out = docs.select(F.col(id_col).alias("doc_id"), scorer(model)(F.col(text_col)).alias("score"))
    return out.select("doc_id", in_fold(F.col("doc_id"), *fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't call toxic."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    score: Column = scorer(model)(F.col(text_col))
    return docs.withColumn("__toxic", score).filter("__toxic < 0.5").drop("__toxic")
