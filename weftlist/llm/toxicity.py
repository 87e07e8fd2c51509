"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words, and 0 without any weighted word; a
document's is the noisy-or of its sentences, 1 - prod(1 - p). The weights are learned from document labels alone,
by AdaGrad on the likelihood of the noisy-or, so the gradient itself decides which sentence carries the
label; afterwards the sentence probabilities point at the offending sentences.

A long document is scored by its likeliest passage of ``PASSAGE`` consecutive sentences: faint evidence that is far apart
doesn't add up, so length alone flags no text. Settings were compared by five folds of the rows that are trained on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlist.llm.words import ALNUM, U, Words, lean, text_slices

#: Width of the hashed word table.
BITS = 18
#: Labelled documents that training uses at most: those with the smallest hash of their id.
SAMPLE = 12_000
#: Sentences that are combined by noisy-or when a text is scored.
PASSAGE = 20
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True


class Sentences:
    """Words of a slice of texts, with the sentence of each: sentences end with . ! ? or a line end, and with their text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        words = self.words = Words(data, offs, ALNUM)
        ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
        mark = ends[words.start]
        new = np.ones(len(mark), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (words.row[1:] != words.row[:-1])
        self.first = np.flatnonzero(new)
        self.row = words.row[self.first]
        self.feature = (words.hash >> U(64 - BITS)).astype(np.int64)


def sentence_scores(s: Sentences, weights: np.ndarray, bias: float) -> np.ndarray:
    if not len(s.first):
        return np.zeros(0)
    z = np.add.reduceat(weights[s.feature], s.first) + bias
    known = np.logical_or.reduceat(weights[s.feature] != 0, s.first)
    return np.where(known, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def noisy_or(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """1 - prod(1 - p) by row; 0 for a row without sentences."""
    return 1 - np.exp(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), rows))


def best_passage(p: np.ndarray, row: np.ndarray, rows: int, length: int = PASSAGE) -> np.ndarray:
    """The largest noisy-or of ``length`` consecutive sentences by row, of all of a row with fewer; ``row`` ascends."""
    total = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    at = np.arange(len(p))
    ends = np.minimum(at + length, np.searchsorted(row, row, "right"))
    least = np.zeros(rows)
    np.minimum.at(least, row, total[ends] - total[at])
    return 1 - np.exp(least)


def screen(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, least_z: float = 4.0, least_bags: int = 4) -> np.ndarray:
    """Which features are in positive bags more often than chance: the others keep weight 0."""
    n, hits = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for (feature, _), label in zip(bags, labels):
        feature = np.unique(feature)
        n[feature] += 1
        hits[feature] += label
    share = labels.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (hits - n * share) / np.sqrt(n * share * (1 - share))
    return (n >= least_bags) & (z >= least_z)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 400, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from bags of (distinct feature, sentence) entries; full-batch AdaGrad on the noisy-or's likelihood.

    Gradient: d/dz of log P(1) is (1-P)/P * p for a positive bag and -p for a negative one.
    Words are screened first, see :func:`screen`.
    """
    weights, bias = np.zeros(1 << BITS), -6.0
    if not len(bags) or labels.min() == labels.max():
        return weights, bias
    free = screen(bags, labels)
    counts = [int(s[-1]) + 1 if len(s) else 0 for _, s in bags]
    base = np.concatenate([[0], np.cumsum(counts)])
    feature = np.concatenate([f[free[f]] for f, _ in bags]).astype(np.int64)
    sentence = np.concatenate([s[free[f]] + b for (f, s), b in zip(bags, base)]).astype(np.int64)
    row = np.repeat(np.arange(len(bags)), counts)
    known = np.bincount(sentence, minlength=base[-1]) > 0
    square, square_b = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(sentence, weights[feature], base[-1]) + bias
        p = np.where(known, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
        whole = np.clip(noisy_or(p, row, len(bags)), 1e-9, 1 - 1e-9)
        pull = np.where(labels == 1, (1 - whole) / whole, -1.0) / len(bags)
        g = pull[row] * p
        gw = np.where(free, np.bincount(feature, g[sentence], 1 << BITS) - l2 * weights, 0)
        gb = g.sum()
        square += gw * gw
        square_b += gb * gb
        weights += rate * gw / np.sqrt(square)
        bias += rate * 0.3 * gb / np.sqrt(square_b)
    weights[np.abs(weights) < 1e-6] = 0
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from (doc_id, toxic) rows. At most ``sample`` labelled documents are used, whatever the input's size; the threshold is a score of 0.5."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def run(batches):
        for batch in batches:
            features, sentences = [], []
            for first, end, data, offs in text_slices(batch.column(2)):
                s = Sentences(data, offs)
                number = np.zeros(len(s.feature), np.int64)
                number[s.first] = 1
                number = np.cumsum(number) - 1
                pair = np.unique(number << BITS | s.feature)
                number, feature = pair >> BITS, pair & ((1 << BITS) - 1)
                row = s.row[number] if len(number) else number
                cut = np.searchsorted(row, np.arange(end - first + 1))
                for a, b in zip(cut[:-1], cut[1:]):
                    features.append(feature[a:b].astype(np.int32).tobytes())
                    sentences.append((number[a:b] - (number[a] if b > a else 0)).astype(np.int32).tobytes())
            if features:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.binary()), pa.array(sentences, pa.binary())], ["doc_id", "toxic", "features", "sentences"])

    # Training runs in one task of an executor: its input is bounded by the sample.
    def learn(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        bags = [(np.frombuffer(f, np.int32), np.frombuffer(s, np.int32)) for f, s in zip(table.column("features").take(order).to_pylist(), table.column("sentences").take(order).to_pylist())]
        weights, bias = fit(bags, table.column("toxic").to_numpy()[order].astype(np.int64))
        at = np.flatnonzero(weights)
        return pa.table({"at": np.append(at, -1), "weight": np.append(weights[at], bias)})

    got = rows.mapInArrow(lean(run), "doc_id long, toxic int, features binary, sentences binary").groupBy(F.lit(0).alias("all")).applyInArrow(learn, "at long, weight double").toArrow()
    at, weight = got.column("at").to_numpy(), got.column("weight").to_numpy()
    weights, bias = np.zeros(1 << BITS), -6.0
    for a, w in zip(at, weight):
        if a < 0:
            bias = float(w)
        else:
            weights[a] = w
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, worst_start, worst_end) of every row: the noisy-or of its likeliest passage and the byte range of its likeliest sentence.

    Null, empty and blank texts have no sentences: score 0 and a null range. Repeated rows and rows of a null id are scored
    like others; other columns are ignored. A model from labels that are all alike knows no words and scores 0 throughout.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = held.value
        for batch in batches:
            scores, starts, ends = [], [], []
            for first, end, data, offs in text_slices(batch.column(1)):
                s = Sentences(data, offs)
                p = sentence_scores(s, weights, bias)
                n = end - first
                scores.append(best_passage(p, s.row, n))
                best = np.full(n, -1)
                order = np.argsort(p, kind="stable")
                best[s.row[order]] = order
                last = np.append(s.first[1:], len(s.feature)) - 1
                ok = best >= 0
                a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
                a[ok] = s.words.start[s.first[best[ok]]] - offs[:-1][ok]
                b[ok] = s.words.end[last[best[ok]]] - offs[:-1][ok]
                starts.append(pa.array(a, mask=~ok))
                ends.append(pa.array(b, mask=~ok))
            if scores:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores)), pa.concat_arrays(starts), pa.concat_arrays(ends)], ["doc_id", "score", "worst_start", "worst_end"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, score double, worst_start long, worst_end long")
