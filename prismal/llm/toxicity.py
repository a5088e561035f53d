"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic
function of its words; a document's is the noisy-or of its sentences, one minus
the product of what each leaves over.  Only document labels are needed to train
the sentence model, which then locates the offending sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import map_rows, release, ship, written

#: Labelled documents the model is fitted on at most, taken in hash order of their ids.
FIT_ROWS = 16_000
#: Features of the model at most, taken by their chi-square against the label, and the least chi-square of one (chance exceeds it once in a hundred).
FEATURES, LEAST_CHI_SQUARE = 4096, 6.635
MIN_DOCS = 4
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
CACHE = 200_000
#: Features of sentences that a sum of the fit runs over at once.
STRETCH = 1 << 18


def word_features(word: str) -> list[str]:
    """A word and its prefixes of four and five letters, which inflected and compound forms share."""
    return [word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k)]


class MilModel:
    """Word weights and a bias; scores sentences, and documents by noisy-or."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._words: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_words": {}}

    def forget(self) -> None:
        self._words.clear()

    def word(self, w: str) -> float:
        x = self._words.get(w)
        if x is None:
            if len(self._words) >= CACHE:
                self._words.clear()
            x = self._words[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
        return x

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, logit) of every sentence; a text without one has one empty sentence."""
        word, bias, out = self.word, self.bias, []
        for m in SENTENCE.finditer(text or ""):
            words = set(WORD.findall(m[0].lower()))
            out.append((m.start(), m.end(), bias + sum(map(word, words))))
        return out or [(0, 0, bias)]

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        found = self.sentences(text)
        logits = np.array([x[2] for x in found])
        return float(-np.expm1(-np.logaddexp(0, logits).sum())), found


def fit_noisy_or(bags: list[list[list[int]]] | pa.Array, labels: np.ndarray, n_features: int, rounds: int = 250, prior: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the exact noisy-or likelihood, with a normal prior of variance 1 / ``prior``.

    Sums run over stretches of whole sentences, so beside the features' places
    nothing as long as they are is held.
    """
    # flat arrays: a list of as many integers takes several times the memory
    bags = bags if isinstance(bags, pa.Array) else pa.array(bags, pa.list_(pa.list_(pa.int32())))
    n_doc, inner = len(bags), bags.flatten()
    size = pc.list_value_length(inner).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n_doc), pc.list_value_length(bags).to_numpy(zero_copy_only=False))
    cols = inner.flatten().to_numpy(zero_copy_only=False)
    plain = np.bincount(doc[size == 0], minlength=n_doc).astype(float)
    doc, size = doc[size > 0], size[size > 0]
    ends = np.cumsum(size)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(cols), STRETCH)), len(doc)))
    parts = [(a, b, ends[a] - size[a], ends[b - 1]) for a, b in zip(cuts[:-1], cuts[1:])]
    y = labels.astype(bool)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    per_doc = max(1.0, float(plain.mean()) + len(doc) / max(1, n_doc))
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(rate / per_doc) - 2
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, b = theta[:-1], theta[-1]
        logit = np.full(len(doc), b)
        for i, j, s, e in parts:
            logit[i:j] += np.add.reduceat(w[cols[s:e]], ends[i:j] - size[i:j] - s)
        total = np.bincount(doc, np.logaddexp(0, logit), n_doc) + plain * np.logaddexp(0, b)
        slope = np.where(y, -1 / np.expm1(np.maximum(total, 1e-6)), 1.0)
        by_sentence = slope[doc] / (1 + np.exp(-logit))
        grad = np.append(np.zeros(n_features), by_sentence.sum() + (slope * plain).sum() / (1 + np.exp(-b)))
        for i, j, s, e in parts:
            grad[:-1] += np.bincount(cols[s:e], np.repeat(by_sentence[i:j], size[i:j]), n_features)
        grad /= n_doc
        grad[:-1] += prior * w / n_doc
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> MilModel:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both already limited to what may be learned from.

    At most about ``fit_rows`` labelled documents are used, chosen by a hash of
    their ids; their whole texts are read, on executors.  Null ids, null labels
    and labels without a document are ignored; an id with several labels counts
    as toxic if one says so.  Without both classes every sentence has the
    smoothed rate of toxic documents.
    """
    spark = docs.sparkSession
    ship(spark)
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = fit_rows / max(1, named.count())
    picked = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else named
    # the sample is bounded, so its side may be broadcast
    sample = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id"), "labelled")
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n, pos = sum(counts.values()), counts.get(1, 0)
    if not pos or pos == n:
        rate = (pos + 0.5) / (n + 1)
        return MilModel({}, float(np.log(rate / (1 - rate))))

    def frequencies(cols: list[list]) -> dict[str, list]:
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(*cols):
            for f in {f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)}:
                seen.setdefault(f, [0, 0])[toxic] += 1
        return {"feature": list(seen), "neg": [x[0] for x in seen.values()], "pos": [x[1] for x in seen.values()]}

    freq = map_rows(sample.select("text", "toxic"), frequencies, "feature string, neg long, pos long")
    freq = freq.groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).filter(F.col("neg") + F.col("pos") >= MIN_DOCS)
    gap = F.col("pos") / pos - F.col("neg") / (n - pos)
    rate = (F.col("pos") + F.col("neg") + 0.5) / (n + 1)
    chi_square = gap * gap / (rate * (1 - rate)) * (pos * (n - pos) / n)
    best = freq.withColumn("chi", chi_square).filter(F.col("chi") >= LEAST_CHI_SQUARE).orderBy(F.desc("chi"), "feature").limit(features).collect()
    place = {r.feature: i for i, r in enumerate(best)}
    known = spark.sparkContext.broadcast(place)

    def bags(cols: list[list]) -> dict[str, list]:
        at, out = known.value.get, []
        for text in cols[0]:
            bag = []
            for m in SENTENCE.finditer(text or ""):
                hits = (at(f) for w in set(WORD.findall(m[0].lower())) for f in word_features(w))
                bag.append([i for i in hits if i is not None])
            out.append(bag or [[]])
        return {"bag": out, "toxic": cols[1]}

    rows = map_rows(sample.select("text", "toxic"), bags, "bag array<array<int>>, toxic int").toArrow()
    w, b = fit_noisy_or(rows["bag"].combine_chunks(), np.array(rows["toxic"]), len(place))
    del rows
    release()
    return MilModel({f: float(w[i]) for f, i in place.items() if w[i]}, b)


def score_toxicity(docs: DataFrame, model: MilModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text and locate its offending sentences.

    Returns ``doc_id, score, predicted, n_sentences, offending``; the last
    lists start, end (in characters) and probability of the sentences with a
    probability of at least ``threshold``, or the likeliest one of a rejected
    document that has none.  A null or empty text is one empty sentence.  Rows
    keep null and repeated ids; other columns are ignored.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(model)

    def run(cols: list[list]) -> dict[str, list]:
        m = known.value
        out: dict[str, list] = {k: [] for k in ("score", "predicted", "n_sentences", "offending")}
        for text in cols[1]:
            score, found = m.score(text)
            rejected = score >= threshold
            worst = []
            if rejected:
                probs = [(a, b, float(1 / (1 + np.exp(-x)))) for a, b, x in found if x > -30]
                worst = [x for x in probs if x[2] >= threshold] or [max(probs, key=lambda x: x[2])] if probs else []
            out["score"].append(score)
            out["predicted"].append(int(rejected))
            out["n_sentences"].append(len(found))
            out["offending"].append([{"start": a, "end": b, "p": p} for a, b, p in worst])
        return {"doc_id": cols[0]} | out

    schema = "doc_id long, score double, predicted int, n_sentences int, offending array<struct<start:int,end:int,p:double>>"
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema, done=lambda: known.value.forget())


def drop_toxic(docs: DataFrame, model: MilModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Documents that the model scores below ``threshold``; columns stay as they are.

    Only texts go to Python and only scores come back.
    """
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([known.value.score(t.as_py())[0] for t in texts], pa.float64())
        known.value.forget()
        release()

    return docs.filter(score(F.col(text_col)) < threshold)


def remainder(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % mod
