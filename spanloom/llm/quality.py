"""Quality classifier by positive-unlabelled learning.

Trusted good documents are the positives; a sample of all documents, good and bad together, is the unlabelled set.
With the class prior given, the risk of a classifier on the bad ones is its risk on the unlabelled set less the
prior's share of the positives' risk; that difference can't truly be negative, so where it is, the non-negative
estimator steps back instead of fitting it further. The prior itself is estimated from positives and unlabelled
documents: above any score, the unlabelled share is at least the prior times the positives' share. A small network on style features is trained so. Training uses
a bounded sample, as its size is a parameter; every document is scored by its whole text.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Positives and unlabelled documents in the training sample, about, at most.
POSITIVES, UNLABELLED = 12_000, 24_000
#: Words in a stretch; features are also taken over a document's worst and best stretches.
STRETCH = 64
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 512, 0.01, 1e-4
KEEP = 0.7

SPACE, LOWER, UPPER, DIGIT, POINT, SYMBOL, OTHER = range(7)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""

    def of(c: int) -> int:
        kind = unicodedata.category(chr(c))
        if c in (9, 10, 11, 12, 13, 32) or kind[0] == "Z":
            return SPACE
        if kind[0] == "L":
            return {"l": LOWER, "u": UPPER}.get(kind[1], OTHER)
        if kind[0] == "N":
            return DIGIT
        return POINT if chr(c) in ".,;:?'\"-()" else OTHER if kind[0] == "M" else SYMBOL

    low = np.array([of(c) for c in range(0x3000)], np.uint8)
    return np.concatenate([low, np.full(sys.maxunicode + 1 - len(low), OTHER, np.uint8)])


MARKS = "!|#%&*$@<>{}=_"
N_WORD = 7
N_FEATURES = 3 * N_WORD + 7 + len(MARKS) + 6


def features(text: str | None) -> np.ndarray:
    """Style features of a text; they don't depend on its language's words."""
    out = np.zeros(N_FEATURES)
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return out
    kinds = classes()[codes]
    solid = kinds != SPACE
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    share = np.bincount(kinds, minlength=7) / len(codes)
    at = 3 * N_WORD
    out[at : at + 7] = share
    at += 7
    counts = np.bincount(codes[codes < 128], minlength=128)
    n_words = len(starts)
    out[at : at + len(MARKS)] = np.minimum(3, counts[[ord(c) for c in MARKS]] / max(1, n_words))
    at += len(MARKS)
    lines = counts[10] + 1
    out[at : at + 3] = np.log1p(n_words), np.log1p(len(codes)), np.log1p(n_words / lines)
    if not n_words:
        return out
    lengths = (ends - starts).astype(float)
    before = np.zeros((3, len(codes) + 1))
    for i, c in enumerate((UPPER, SYMBOL, DIGIT)):
        np.cumsum(kinds == c, out=before[i, 1:])
    upper, symbol, digit = before[:, ends] - before[:, starts]
    place = np.arange(len(codes)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(codes)]])))
    weights = (codes.astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) ^ np.uint64(0x5851F42D4C957F2D))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights * solid, dtype=np.uint64)])
    words = total[ends] - total[starts]
    again = np.concatenate([[0.0], words[1:] == words[:-1]])
    per_word = np.stack([upper >= np.maximum(2, lengths * 0.6), symbol > 0, again, lengths <= 3, np.minimum(lengths, 30) / 10, digit > 0, upper > 0]).astype(float)
    cut = np.arange(0, n_words, STRETCH)
    if len(cut) > 1 and n_words - cut[-1] < STRETCH // 2:
        cut = cut[:-1]
    size = np.diff(np.concatenate([cut, [n_words]]))
    stretches = np.add.reduceat(per_word, cut, axis=1) / size
    out[:N_WORD], out[N_WORD : 2 * N_WORD], out[2 * N_WORD : 3 * N_WORD] = per_word.mean(1), stretches.max(1), stretches.min(1)
    different = len(np.unique(words))
    out[at + 3 : at + 6] = different / n_words, np.log(different + 1) / np.log(n_words + 1.5), lengths.std() / 10
    return out


class Model:
    """A network with one hidden layer; score() is the probability of label 1."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.w1 + self.b1)
        return hidden, hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.raw(self.inputs(x))[1], -30, 30)
        return 1 / (1 + np.exp(-z))

    def slopes(self, x: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        hidden, _ = self.raw(x)
        back = np.outer(dz, self.w2) * (1 - hidden**2)
        return [x.T @ back, back.sum(0), hidden.T @ dz, np.array([dz.sum()])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Minimises prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) for the logistic loss, by Adam on mini-batches."""
    model = Model(np.concatenate([positive, unlabelled]), seed)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    rng = np.random.default_rng(seed)
    params = [model.w1, model.b1, model.w2, model.b2]
    moment, square, step = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params], 0
    n = max(1, max(len(p), len(u)) // BATCH)
    for epoch in range(epochs):
        ps, us = np.array_split(rng.permutation(len(p)), n), np.array_split(rng.permutation(len(u)), n)
        for i, j in zip(ps, us, strict=True):
            if not len(i) or not len(j):
                continue
            zp, zu = model.raw(p[i])[1], model.raw(u[j])[1]
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
            # the loss of calling z bad is log(1 + e^z), whose slope is the score
            negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            from_u, from_p = model.slopes(u[j], su / len(j)), model.slopes(p[i], -prior * sp / len(i))
            if negative_risk >= 0:
                good = model.slopes(p[i], prior * (sp - 1) / len(i))
                slope = [a + b + c for a, b, c in zip(from_u, from_p, good, strict=True)]
            else:
                slope = [-(a + b) for a, b in zip(from_u, from_p, strict=True)]
            step += 1
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for k, (a, g) in enumerate(zip(params, slope, strict=True)):
                g = g + DECAY * a
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                a -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return model


def prior_from_scores(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from scores of positives and unlabelled documents that no model was fitted on: above any threshold, the unlabelled share is at least prior times the positives' share; the threshold with the least ratio, less a margin for its noise, is taken."""
    edges = np.unique(positive)
    top_p = 1 - np.searchsorted(np.sort(positive), edges) / len(positive)
    top_u = 1 - np.searchsorted(np.sort(unlabelled), edges) / len(unlabelled)
    noise = np.sqrt(np.log(40.0) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = np.argmin((top_u + noise) / np.maximum(top_p, 1e-9))
    return float(np.clip(top_u[best] / max(top_p[best], 1e-9), 0.01, 0.99))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 2) -> float:
    """Class prior of the unlabelled documents, from positives and unlabelled ones alone: each fold is scored by a first model of the others, and the folds' estimates are averaged. One half if there are too few."""
    if len(positive) < 2 * folds or len(unlabelled) < 2 * folds:
        return 0.5
    found = []
    for i in range(folds):
        p_in, u_in = np.arange(len(positive)) % folds == i, np.arange(len(unlabelled)) % folds == i
        first = fit(positive[~p_in], unlabelled[~u_in], 0.5, epochs=20, seed=5 + i)
        found.append(prior_from_scores(first.score(positive[p_in]), first.score(unlabelled[u_in])))
    return float(np.mean(found))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4 (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the sampled positives (label 1) and unlabelled documents; no label 0 is read. The sample is drawn by a hash of the id."""

    def drawn(df: DataFrame, most: int, n: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n))))

    trusted = labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1) & F.col("doc_id").isNotNull())
    n_docs = docs.count()
    good = drawn(trusted, positives, trusted.count()).select("doc_id", F.lit(1).alias("kind"))
    some = drawn(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()), unlabelled, n_docs * 3 // 4).select("doc_id", F.lit(0).alias("kind"))
    # about positives + unlabelled ids, whatever the size of the tables
    chosen = F.broadcast(good.unionByName(some).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"kinds": b["kinds"], "x": [features(t).astype(np.float32).tobytes() for t in b["text"]]})

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "kinds").mapInPandas(run, "kinds array<int>, x binary").toPandas()
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, N_FEATURES).astype(float)
    is_good, is_some = (np.array([k in ks for ks in rows["kinds"]], bool) for k in (1, 0))
    return x[is_good], x[is_some]


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """A model from docs (doc_id, text) and the positives of labels (doc_id, quality) that are not held out; None if there are no positives or no documents to learn from.

    Labels other than 1 are not read, the class prior among them: it is estimated (see estimated_prior()). Labels of
    documents that docs lacks, null ids and null labels are ignored; a document that is labelled or there more than
    once counts each time that it is there.
    """
    small_batches(docs.sparkSession)
    p, u = training_rows(docs, labels, positives, unlabelled)
    if not len(p) or not len(u):
        return None
    return fit(p, u, min(max(estimated_prior(p, u), 0.01), 0.99))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from KEEP on).

    Null and empty texts score as texts without features; without a model every score is 0.5. Only the text counts.
    Columns of docs of those names are replaced; all others stay, and repeated rows stay repeated.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.stack([features(t) for t in texts]))) if len(texts) else pd.Series([], dtype=float)

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
