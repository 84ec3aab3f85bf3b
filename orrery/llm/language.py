"""Language identification by error-correcting output codes.

Each language has a codeword. A binary classifier over character n-grams
predicts each bit; decoding adds up, for each codeword, the logistic losses of
the bits weighted by how well they were learnt, and takes the nearest one. Two
codewords that are almost as near make the text ambiguous.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import free, table

UNKNOWN = "und"
GRAMS = 1 << 15
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark, else 0."""
    if not _kinds:
        points = map(chr, range(0x110000))
        _kinds.append(np.fromiter((2 if c.isalpha() else unicodedata.category(c)[0] == "M" for c in points), np.uint8, 0x110000))
    return _kinds[0]


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1. Up to 6 classes: every split of them once; above: random splits, ten for each doubling of n."""
    if n <= 6:
        return np.array([[1 if i == 0 or (split >> (i - 1)) & 1 else -1 for split in range(2 ** (n - 1) - 1)] for i in range(n)]).reshape(n, -1)
    rng, out = np.random.default_rng(5), []
    while len(out) < 10 * int(np.ceil(np.log2(n))):
        bit = rng.choice([-1, 1], n)
        if abs(bit.sum()) < n:
            out.append(bit)
    return np.array(out).T


def grams(text: str | None) -> np.ndarray:
    """Places of a whole text's character 1- to 3-grams, in lower case, a space for all between words; none without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    kind = kinds()[points]
    if not (kind == 2).any():
        return np.zeros(0, np.int64)
    a = np.concatenate([[32], np.where(kind > 0, points, 32), [32]]).astype(np.uint32)
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]
    x, y, z = (a * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
    found = np.concatenate([a * np.uint32(0x27D4EB2F), x[:-1] + y[1:], x[:-2] + y[1:-1] + z[2:]])
    return ((found ^ (found >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64)


class LanguageModel:
    """weights: a row for each n-gram place, a column for each bit."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.names, self.weights, self.bias, self.trust = names, weights, bias, trust
        self.codes = codewords(len(names))
    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, confidence, lead over the next one); und, 0, 0 without letters."""
        found = grams(text)
        if not len(found):
            return UNKNOWN, 0.0, 0.0
        if len(self.names) < 2:
            return self.names[0] if self.names else UNKNOWN, 1.0 if self.names else 0.0, 1.0
        margin = self.weights[found].sum(0, dtype=np.float64) / len(found) + self.bias
        losses = (np.logaddexp(0, -self.codes * margin) * self.trust).sum(1)
        near = np.exp(losses.min() - losses)
        near /= near.sum()
        first, second = np.sort(near)[::-1][:2]
        return self.names[int(losses.argmin())], float(first), float(first - second)


def fit(texts: list[str | None], langs: list[str], rounds: int = 60, rate: float = 0.3, shrink: float = 1e-6) -> LanguageModel:
    """Train the bit classifiers on whole documents (driver, bounded sample): logistic losses, Adam, all bits at once."""
    names = sorted(set(langs))
    codes = codewords(len(names)) if len(names) > 1 else np.ones((len(names), 1))
    index, value, first, y = [], [], [], []
    at = 0
    for t, lang in zip(texts, langs, strict=True):
        found = grams(t)
        if len(found):
            places, n = np.unique(found, return_counts=True)
            index.append(places)
            value.append(n / len(found))
            first.append(at)
            at += len(places)
            y.append(names.index(lang))
    bits = codes.shape[1]
    weights, bias = np.zeros((GRAMS, bits)), np.zeros(bits)
    if not y or len(names) < 2:
        return LanguageModel(names, weights, bias, np.ones(bits))
    index, value = np.concatenate(index), np.concatenate(value)
    row = np.repeat(np.arange(len(y)), np.diff([*first, at]))
    target = codes[np.array(y)]
    even = 1 / np.bincount(y, minlength=len(names))[np.array(y)]  # languages count alike
    even /= even.sum()
    used, local = np.unique(index, return_inverse=True)
    w = np.zeros((len(used), bits))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(bits), np.zeros(bits)
    for step in range(1, rounds + 1):
        margin = np.add.reduceat(w[local] * value[:, None], first) + bias
        slope = -target / (1 + np.exp(target * margin)) * even[:, None]
        grad = np.stack([np.bincount(local, slope[row, b] * value, len(used)) for b in range(bits)], 1) + shrink * w
        grad_b = slope.sum(0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b * grad_b
        w -= rate * 10 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / np.sqrt(step)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8) / np.sqrt(step)
    weights[used] = w
    margin = np.add.reduceat(w[local] * value[:, None], first) + bias
    right = ((np.sign(margin) == target) * even[:, None]).sum(0)
    return LanguageModel(names, weights, bias, np.clip(2 * right - 1, 0.05, 1) * 7 / bits)


def labelled_sample(docs: DataFrame, learn: Column, most: int = 300) -> tuple[list, list]:
    """(texts, langs) of about ``most`` documents of each language at most, chosen by hash; one row for each language reaches the driver first."""
    rows = docs.where(F.col("lang").isNotNull() & learn)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    mark = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 30))
    near = [(F.col("lang") == k) & (mark < min(1 << 30, (most << 30) // n)) for k, n in sizes.items()]
    if not near:
        return [], []
    pick = near[0]
    for x in near[1:]:
        pick = pick | x
    got = rows.where(pick).select("doc_id", "text", "lang").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return got.column("text").to_pylist(), got.column("lang").to_pylist()


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", lead: float = 0.2) -> DataFrame:
    """All columns, and lang_pred, score (0 to 1) and ambiguous (the lead over the next language is below ``lead``).

    Whole texts are read. A null text or one without letters is ``und`` with
    score 0 and not ambiguous. Rows that are repeated are each told alike; an
    empty table gives no rows; columns of the given names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.weights.astype(np.float32), model.bias, model.trust))
    rows = docs.drop("lang_pred", "score", "ambiguous").withColumn(free(docs, "__text"), F.col(text).cast("string"))
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*sent.value)
        for batch in batches:
            found = [model.predict(t) for t in batch.columns[-1].to_pylist()]
            new = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[0] != UNKNOWN and f[2] < lead for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, ambiguous boolean"]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = fit(*labelled_sample(docs, ~held))
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
