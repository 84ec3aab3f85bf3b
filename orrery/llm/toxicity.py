"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or.

Labels mark documents, not sentences. Each sentence has a logistic score over
its words; a document is toxic with probability 1 - prod(1 - p) over its
sentences, and training follows the gradient of that through to the words. The
sentence scores then tell where a document offends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import free, table

#: A sentence ends with these, and at a line's end.
_STOP, _EDGE = (".", "!", "?", "。", "！", "？"), re.compile(r"^\W+|\W+$")
REMEMBERED = 300_000


class ToxicityModel:
    """Word weights and a bias per sentence. Words that training hasn't seen often weigh nothing."""

    def __init__(self, words: dict[str, int], weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias
        self.codes: dict[str, int] = {}

    def _code(self, raw: str) -> int:
        """Twice the word's place, and 1 if it ends a sentence."""
        code = 2 * self.words.get(_EDGE.sub("", raw), 0) + raw.rstrip("\"')]»”’").endswith(_STOP)
        if len(self.codes) > REMEMBERED:
            self.codes.clear()
        self.codes[raw] = code
        return code

    def sentences(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(word places of a whole text, index of each sentence's first word)."""
        codes: list[int] = []
        known = self.codes
        for line in (text or "").lower().split("\n"):
            if words := line.split():
                codes.extend([known[w] if w in known else self._code(w) for w in words])
                codes[-1] |= 1
        marks = np.array(codes, np.int64)
        return marks >> 1, np.flatnonzero(np.concatenate([[1], marks[:-1] & 1])) if len(marks) else np.zeros(0, np.int64)

    def margins(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(margin of each sentence, index of its first word, words in the text); a word counts once a sentence."""
        places, starts = self.sentences(text)
        at, sentence = once(places, starts)
        return np.bincount(sentence, self.weights[at], len(starts)) + self.bias, starts, len(places)


def once(places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, sentence) of each known word once for each sentence that has it."""
    sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(places))))
    known = places > 0
    pairs = np.unique(sentence[known] << 32 | places[known])
    return pairs & 0xFFFFFFFF, pairs >> 32


def odds(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -60, 60)))


def noisy_or(margins: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(margin)); no sentences: 0."""
    return float(-np.expm1(-np.logaddexp(0, margins).sum()))


def fit(texts: list[str | None], toxic: list[int], least: int = 4, rounds: int = 150, rate: float = 0.15, shrink: float = 2e-3) -> ToxicityModel:
    """Train on whole documents with 0/1 labels (driver, bounded sample).

    The vocabulary is the words of at least ``least`` documents. Rounds are
    Adam steps on the mean log loss of the noisy-or with an L1 term.
    """
    blank = ToxicityModel({}, np.zeros(1), -6.0)
    seen = Counter()
    for t in texts:
        seen.update({_EDGE.sub("", w) for w in (t or "").lower().split()})
    words = {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= least and w))}
    blank.words = words
    parts = [blank.sentences(t) for t in texts]
    keep = [i for i, p in enumerate(parts) if len(p[0])]
    if not keep or len({toxic[i] for i in keep}) < 2:
        return ToxicityModel(words, np.zeros(len(words) + 1), -6.0)
    counts = np.array([len(parts[i][1]) for i in keep])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    pairs = [once(*parts[i]) for i in keep]
    places = np.concatenate([p for p, _ in pairs])
    sentence = np.concatenate([k + o for (_, k), o in zip(pairs, first, strict=True)])
    y = np.array([toxic[i] for i in keep], float)
    theta = np.zeros(len(words) + 2)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, theta[places], counts.sum()) + theta[-1]
        total = np.add.reduceat(np.logaddexp(0, z), first)
        # Of the log loss by the sum of softplus terms: 1 for label 0, -1 / (e^sum - 1) for label 1.
        slope = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0) / len(y)
        dz = np.repeat(slope, counts) * odds(z)
        grad = np.bincount(places, dz[sentence], minlength=len(theta))
        grad[:-1] += shrink * np.sign(theta[:-1]) / 10
        grad[0], grad[-1] = 0, dz.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ToxicityModel(words, theta[:-1], float(theta[-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 4000) -> tuple[list, list]:
    """(texts, labels) of at most ``most`` labelled documents, a half of each label as far as there are, least hashes first."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learn)
    mix = F.xxhash64(F.col("doc_id").cast("string"), F.lit(3))
    ids = [rows.where(F.col("toxic") == k).orderBy(mix, "doc_id").limit(most // 2).select("doc_id", "toxic") for k in (0, 1)]
    chosen = F.broadcast(ids[0].union(ids[1]))  # at most ``most`` rows
    got = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy())
    texts, toxic = got.column("text").to_pylist(), got.column("toxic").to_pylist()
    return [texts[i] for i in order], [int(toxic[i]) for i in order]


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns, and score, predicted, and offending: (sentence, first word, words, score) of sentences from the threshold on.

    Whole texts are scored. A null, empty or wordless text has no sentences:
    score 0 and nothing offending. Rows that are repeated are each scored alike;
    an empty table gives no rows; columns of the given names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.bias))
    rows = docs.drop("score", "predicted", "offending").withColumn(free(docs, "__text"), F.col(text).cast("string"))
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    spot = pa.list_(pa.struct([("sentence", pa.int32()), ("word", pa.int32()), ("words", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*sent.value)
        for batch in batches:
            scores, spots = [], []
            for t in batch.columns[-1].to_pylist():
                z, starts, n = model.margins(t)
                scores.append(noisy_or(z))
                p, sizes = odds(z), np.diff(np.append(starts, n))
                spots.append([{"sentence": i, "word": int(starts[i]), "words": int(sizes[i]), "score": float(p[i])} for i in np.flatnonzero(p >= threshold).tolist()])
            flags = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), flags, pa.array(spots, spot)], [*batch.schema.names[:-1], "score", "predicted", "offending"])

    out = "score double, predicted int, offending array<struct<sentence:int,word:int,words:int,score:double>>"
    return rows.mapInArrow(run, ", ".join([*fields, out]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = fit(*labelled_sample(docs, labels, ~held))
    rows = score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
