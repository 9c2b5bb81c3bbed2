"""Toxicity by class-conditional Kneser-Ney models with shared backoff."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm import bytewords as bw
from framewright.llm.store import shared

U64 = np.uint64
#: Taken off every count of a class, so what was seen no more often rests on the shared counts: the fit takes that which does best on rows not counted.
DISCOUNTS = (1.0, 4.0, 16.0)
#: Taken off the shared counts.
SHARED_DISCOUNT = 0.75
#: No word counts for more than this either way.
MOST_RATIO = 4.0
#: Words of the stretches whose normalised log-likelihoods are compared, beside the whole text's.
STRETCHES = (1, 3, 20)
#: The fit's bounded sample of labelled rows: documents of each class, words of each class; half as many for calibrating.
SAMPLE_DOCS, SAMPLE_WORDS = 2000, 600_000
#: Of the sample's words one document has this share at most: 60,000 words, 30,000 for calibrating.
SHARE = 10
FOLDS = 5


def fold(id_col: Column, n: int = FOLDS) -> Column:
    """CRC-32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % n, F.lit(0))


def _pairs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each word with the one before it in its row."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    heads = first[:-1][first[:-1] < first[1:]]
    before[heads] = U64(0x5EED)
    return bw.mix(before * U64(0x9E3779B97F4A7C15) + h), before


def _fresh(h: np.ndarray, first: np.ndarray, width: int = 4) -> np.ndarray:
    """Words outside all windows of `width` words that occurred before, so copies and shared passages are learned from once."""
    at = np.flatnonzero(bw.inner(first, len(h), width))
    edge = np.zeros(len(h) + 1, np.int32)
    _, once = np.unique(bw.windows(h, width)[at], return_index=True)
    at = np.delete(at, once)
    edge[at] += 1
    edge[at + width] -= 1
    return np.cumsum(edge[:-1]) == 0


class Table:
    """Sums of weights by key in two classes, looked up by binary search."""

    def __init__(self, keys: np.ndarray, classes: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        keys, classes, weights = keys[order], classes[order], weights[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.keys = keys[new]
        at = np.cumsum(new) - 1
        self.sums = np.stack([np.bincount(at[classes == c], weights[classes == c], len(self.keys)) for c in (0, 1)]).astype(np.float32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((2, len(keys)), np.float32)
        order = np.argsort(keys)  # sorted questions stay in the cache
        at = np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.sums[:, at], np.float32(0))


class Model:
    """Two interpolated Kneser-Ney models, in which every count gives up to `discount` to the level below.

    Pairs and words have continuation counts (how many different words they follow) of each class, so copies and
    repeated passages count once; words back off to the counts of both classes together, each class as large as its `rate`, and
    these to an even share for each word, unseen ones included. Pairs that give all they have aren't stored.
    """

    def __init__(self, docs: list[tuple[int, np.ndarray]], discount: float, rate: float):
        words = np.concatenate([h for _, h in docs] or [np.zeros(0, U64)])
        first = np.concatenate([[0], np.cumsum([len(h) for _, h in docs])]).astype(np.int64)
        of = np.repeat(np.array([c for c, _ in docs], np.int8), np.diff(first))
        pair, before = _pairs(words, first) if len(words) else (words, words)
        fresh = np.flatnonzero(_fresh(words, first))
        triple = _pairs(pair, first)[0] if len(words) else words
        _, seen = np.unique(bw.mix(triple[fresh] ^ of[fresh].astype(U64)), return_index=True)
        seen = fresh[seen]
        _, at, n = np.unique(bw.mix(pair[seen] ^ of[seen].astype(U64)), return_index=True, return_counts=True)
        at = seen[at]
        more = n > discount
        self.pairs = Table(pair[at[more]], of[at[more]], n[more] - discount)
        self.context = Table(before[at], of[at], n)
        self.follow = Table(before[at], of[at], np.minimum(n, discount))
        types = Table(words[at], of[at], np.ones(len(at)))
        self.unigram = types
        self.types = np.maximum(1, types.sums.sum(axis=1))
        self.spilled = np.minimum(types.sums, discount).sum(axis=1)
        rest = SHARED_DISCOUNT * len(types.keys) / max(1, types.sums.sum())
        self.unseen = rest / (len(types.keys) + 1)
        self.shared = Table(types.keys, np.zeros(len(types.keys), np.int8), (1 - rest) * (np.array([1 - rate, rate]) / self.types @ types.sums))
        types.sums = np.maximum(types.sums - np.float32(discount), 0)

    def ratios(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log P(word | word before, toxic) - log P(word | word before, ordinary) of every word."""
        if not len(h):
            return np.zeros(0)
        pair, before = _pairs(h, first)
        base = self.shared.get(h)[0] + self.unseen
        own = (self.unigram.get(h) + np.maximum(self.spilled, 1)[:, None] * base) / self.types[:, None]
        context = self.context.get(before)
        whole = (self.pairs.get(pair) + self.follow.get(before) * own) / np.maximum(context, 1)
        p = np.log(np.where(context > 0, whole, own))
        return np.clip(p[1] - p[0], -MOST_RATIO, MOST_RATIO).astype(np.float64)

    def features(self, column: pa.Array) -> np.ndarray:
        """For each row the mean ratio over all words, and the largest over stretches of STRETCHES words (the whole text if shorter)."""
        return self.measured(*bw.words(column, bw.ALNUM, lower=True))

    def measured(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The same from hashes of words, and where rows begin in them (one more at the end)."""
        total = np.concatenate([[0.0], np.cumsum(self.ratios(h, first))])
        n = np.diff(first)
        mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(1, n)
        out = [np.ones(len(n)), (n == 0).astype(float), np.log1p(n), mean]
        for size in STRETCHES:
            most, long = mean.copy(), np.flatnonzero(n >= size)
            if len(long):
                stretch = np.append((total[size:] - total[:-size]) / size, -np.inf)
                most[long] = np.maximum.reduceat(stretch, np.stack([first[:-1][long], first[1:][long] - size + 1], axis=1).ravel())[::2]
            out.append(most)
        return np.stack(out, axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    weight = weight / max(weight.sum(), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w * (np.arange(len(w)) > 0)
        s = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(s, g)
        w -= step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, label: str, n: int, words: int) -> list[tuple[int, bool, np.ndarray]]:
    """(class, whether to calibrate, hashes of words) of labelled documents in the order of a hash: up to n and `words` words of each class, half as many to calibrate.

    A document has one SHARE-th of the words at most: of a longer one its beginning is taken, so it can't displace the others.
    Words are hashed on the executors; no text reaches the driver, and 8 bytes a word do.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold > 0").select("doc_id", "y", (F.col("fold") == FOLDS - 1).alias("held"), F.xxhash64(F.lit(7), "doc_id").alias("h"))
    parts = [known.where((F.col("y") == y) & (F.col("held") == held)).orderBy("h", "doc_id").limit(n // 2 if held else n) for y in (0, 1) for held in (False, True)]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])  # three times n rows at most
    most = {False: max(1, words // SHARE), True: max(1, words // 2 // SHARE)}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = bw.text_buffers(batch.column("text"))
            for lo, hi in bw.blocks(offsets):
                part = batch.slice(lo, hi - lo)
                h, first = bw.words(part.column("text"), bw.ALNUM, lower=True)
                rows = [h[a : min(b, a + most[held])] for a, b, held in zip(first[:-1], first[1:], part.column("held").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("y", "held", "h", "doc_id")), pa.array([len(x) for x in rows], pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())], ["y", "held", "h", "doc_id", "w", "words"])

    rows = docs.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull()).select("y", "held", "h", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(hashed, f"y int, held boolean, h long, doc_id {kind}, w long, words binary").dropDuplicates(["doc_id"])
    before = F.sum("w").over(Window.partitionBy("y", "held").orderBy("h", "doc_id"))
    rows = rows.withColumn("upto", before).where(F.col("upto") <= F.when(F.col("held"), words // 2).otherwise(words))
    found = sorted(rows.select("y", "held", "h", "doc_id", "words").collect(), key=lambda r: tuple(r)[:4])
    return [(r.y, r.held, np.frombuffer(r.words, U64)) for r in found]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> tuple[Model, np.ndarray]:
    """The models, counted on folds 1 to 3 of the ids, and the weights of their features, fitted on fold 4, class sizes as in all of fold 4."""
    sample = _sample(docs, labels, label, sample_docs, sample_words)
    counted = [(y, h) for y, held, h in sample if not held]
    held, y = [h for _, held, h in sample if held], np.array([y for y, held, _ in sample if held], int)
    n = dict(labels.where(fold(F.col("doc_id")) == FOLDS - 1).groupBy(F.col(label).cast("int")).count().collect())
    n, seen = np.array([n.get(0, 0), n.get(1, 0)]), np.bincount(y, minlength=2)
    if not seen.all():
        rate = (n[1] + 1) / (n.sum() + 2)
        return Model(counted, DISCOUNTS[0], 0.5), np.array([np.log(rate / (1 - rate)), *[0.0] * (3 + len(STRETCHES))])
    best, weight = None, (n / seen)[y]
    ends = np.cumsum([0, *map(len, held)])
    for discount in DISCOUNTS:
        model = Model(counted, discount, n[1] / n.sum())
        x = np.concatenate([model.measured(np.concatenate(held[lo:hi]), ends[lo : hi + 1] - ends[lo]) for lo, hi in bw.blocks(ends, 1 << 17)])
        w = logistic(x, y, weight)
        loss = (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum()
        if best is None or loss < best[0]:
            best = loss, model, w
    return best[1:]


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """Scores every document from 0 to 1 by how much likelier the toxic model finds it than the ordinary one.

    Each class has an interpolated Kneser-Ney bigram model; both back off to continuation counts over the two together, so an
    expression that neither knows well counts for neither. The log-likelihoods are compared by word: over the whole text,
    and over its most toxic stretches of STRETCHES words, so a long text doesn't hide one. One word's log-ratio counts for MOST_RATIO at most
    either way. Both normalised ratios are
    weighted by a logistic regression on labelled rows that the models haven't seen.

    Fitted on a documented sample of labelled rows (sample_docs documents and sample_words words for each class and use,
    of one document a tenth of these words at most), which bounds the model that is broadcast; scoring reads each text once, whole, without a shuffle. Only labels whose id has a
    CRC-32 not divisible by 5 are learned from. Labels that are null, neither 0 nor 1, or of unknown documents are ignored; an id with
    two labels counts as toxic. Returns (doc_id, held_out, score). Words are lowered runs of letters and digits;
    null and empty texts get one score between 0 and 1. Without labels of both classes the class rate decides.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    sent = shared(docs.sparkSession, fit(rows, labels, label, sample_docs, sample_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = sent()
        for batch in batches:
            _, offsets = bw.text_buffers(batch.column(1))
            for lo, hi in bw.blocks(offsets):
                x = model.features(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
