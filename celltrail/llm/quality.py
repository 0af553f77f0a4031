"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from .common import table
from .spans import small_batches

SLOTS = 128
WORD = re.compile(r"\S+")


def features(text: str | None) -> np.ndarray:
    """Shares and rates of a whole text, and the frequencies of its words in SLOTS hashed slots."""
    text = text or ""
    n = max(len(text), 1)
    words = WORD.findall(text)
    w = max(len(words), 1)
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    again = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split("\n")
    ended = sum(x.rstrip().endswith((".", "!", "?")) for x in lines)
    alpha = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    caps = sum(c for x, c in counts.items() if len(x) > 1 and x.upper() == x and x.lower() != x)
    marks = sum(text.count(c) for c in "#$%&*+<=>@[]^_`{|}~\\/")
    shares = [
        alpha / n, upper / max(alpha, 1), sum(map(str.isdigit, text)) / n, marks / n, text.count("|") / w, text.count("!") / w,
        text.count("http") / w, (text.count(",") + text.count(".")) / w, again / w, max(counts.values(), default=0) / w,
        len(counts) / w, caps / w, ended / len(lines), len(set(lines)) / len(lines), sum(x not in "\n\t" and ord(x) < 32 for x in text) / n,
    ]
    scale = [np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, counts)) / max(len(counts), 1) / 10, n / w / 10, float(not words)]
    slots = np.zeros(SLOTS)
    for x, c in counts.items():
        slots[zlib.crc32(x.strip(".,!?").lower().encode("utf-8", "replace")) % SLOTS] += c
    return np.concatenate([np.sqrt(shares), scale, np.sqrt(slots / w)]).astype(np.float32)


class Model:
    """A network with one hidden layer, fitted by Adam on the whole sample."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.parts = (mean, scale, w1, b1, w2, b2)

    def margin(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.parts
        return np.tanh(np.clip((x - mean) / scale, -8, 8) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -30, 30)))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 16, steps: int = 400, rate: float = 0.01, decay: float = 1e-3, seed: int = 0) -> Model:
    """Minimises prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)]) with the logistic loss l.

    Where the second part is below 0 its gradient is reversed, so it grows back instead of being overfitted.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    x = np.clip((both - mean) / scale, -8, 8)
    p, u = len(pos), len(unl)
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(np.log(prior / (1 - prior)))]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        h = np.tanh(x @ w[0] + w[1])
        g = h @ w[2] + w[3]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        rest = np.logaddexp(0, g[p:]).mean() - prior * np.logaddexp(0, g[:p]).mean()
        dg = np.concatenate([-prior * s[:p] / p, s[p:] / u])
        if rest < 0:
            dg = -dg
        else:
            dg[:p] += prior * (s[:p] - 1) / p
        dh = np.outer(dg, w[2]) * (1 - h * h)
        grads = [x.T @ dh + decay * w[0], dh.sum(axis=0), h.T @ dg + decay * w[2], dg.sum()]
        for i, d in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, *w)


def class_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores that the model was not fitted to.

    At any threshold, unlabelled scores over it are at least the prior times the positives' share over it. The estimate
    is the least ratio of the two shares, where the bound for its error (with probability delta) is taken into account,
    so no negative label is needed. It is kept within 0.01 and 0.99.
    """
    at = np.unique(pos)
    share = lambda x: 1 - np.searchsorted(np.sort(x), at, side="left") / len(x)
    p, u = share(pos), share(unl)
    error = np.sqrt(np.log(4 / delta) / 2 / len(unl)) + np.sqrt(np.log(4 / delta) / 2 / len(pos))
    best = int(np.argmin((u + error) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit_with_prior(pos: np.ndarray, unl: np.ndarray, rounds: int = 2) -> Model:
    """Two halves are each scored by a model of the other half, and the prior is estimated from these scores.

    The first models assume 1/2; where they rank well enough for a first estimate, models fitted with that rank better,
    and as a worse ranking can only raise the estimate, the next round's is nearer. All rows are then fitted with it.
    """
    prior = 0.5
    if min(len(pos), len(unl)) > 1:
        for _ in range(rounds):
            scores: list[list[np.ndarray]] = [[], []]
            for half in (0, 1):
                model = fit(pos[half::2], unl[half::2], prior, steps=200)
                for kept, x in zip(scores, (pos, unl)):
                    kept.append(model.score(x[1 - half :: 2]))
            prior = class_prior(*map(np.concatenate, scores))
    return fit(pos, unl, prior)


def _featured(docs: DataFrame, columns: list[str], made: StructField, work) -> DataFrame:
    """The columns, as they are, and work(features) of slices of the texts."""
    small_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([features(t) for t in b.column("text").to_pylist()]) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), work(x)], names=[*columns, made.name])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, StructType([*docs.select(*columns).schema, made]))


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, seed: int = 3) -> Model | None:
    """Fits on at most `sample` trusted positives and `sample` unlabelled texts, the least by a seeded hash of doc_id.

    Of the labels only the positive ones are used; the class prior is estimated (see class_prior). Rows whose
    crc32(doc_id) is divisible by 5 are held out of everything, as are null doc_ids. A doc_id gives one text, the least of
    its rows, however often it is repeated; ties in the hash go to the smaller id. None if there is no positive or
    no document.
    """
    kept = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    labels = labels.where(kept).select("doc_id", "quality")
    order = F.xxhash64(F.lit(seed), "doc_id")
    pos = labels.where("quality = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(sample).withColumn("positive", F.lit(True))
    unl = docs.where(kept).select("doc_id").distinct().orderBy(order, "doc_id").limit(sample).withColumn("positive", F.lit(False))
    ids = F.broadcast(pos.union(unl))  # at most 2 * sample ids
    texts = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    x = _featured(texts, ["doc_id", "positive"], StructField("x", ArrayType(FloatType())), lambda x: pa.array(list(x), pa.list_(pa.float32())))
    rows = x.toPandas().sort_values(["positive", "doc_id"])  # a row an id, so at most 2 * sample
    x, is_pos = np.stack(rows["x"]) if len(rows) else np.zeros((0, 1)), rows["positive"].to_numpy(dtype=bool)
    if not is_pos.any() or is_pos.all():
        return None
    return fit_with_prior(x[is_pos], x[~is_pos])


def score(docs: DataFrame, model: Model | None, *carried: str) -> DataFrame:
    """(doc_id, text) -> doc_id, the columns `carried`, score from 0 to 1; null text is scored like an empty one; without a model all score 1/2."""
    half = lambda x: np.full(len(x), 0.5)
    return _featured(docs, ["doc_id", *carried], StructField("score", DoubleType()), lambda x: pa.array((model.score if model else half)(x), pa.float64()))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; held_out where crc32(doc_id) is divisible by 5; null doc_ids are not held out by it (null)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
