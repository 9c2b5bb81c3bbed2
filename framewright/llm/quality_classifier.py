"""A quality classifier learned from trusted positives and unlabelled text (non-negative PU risk)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bytewords as bw
from framewright.llm.store import kept

FOLDS = 5
#: Where the shares of a text are cut off, so that a linear model can tell some from many.
KNOTS = (0.01, 0.05, 0.2, 0.6)
RIDGE, STEPS = 1e-3, 12
BINS = 500


def fold(id_col: Column, n: int = FOLDS) -> Column:
    """CRC-32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % n, F.lit(0))


def _bytes(marks: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(marks.encode())] = True
    return out


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _bytes("0123456789")
_END = _bytes(".!?")
_PAUSE = _bytes(",;:")
_SYMBOL = _bytes("#*$%&|<>@^~{}[]\\_=+/")
_SHOUT = _bytes("!?")
_WIDE = np.arange(256) >= 0x80


def measures(column: pa.Array) -> np.ndarray:
    """A row of features for each text; shares are of its bytes or words. They know nothing of what words mean, in any language."""
    raw, offsets = bw.text_buffers(column)
    starts, ends, first = bw.spans(raw, offsets)
    h = bw.hashes(raw, starts, ends)
    rows, n = len(offsets) - 1, np.diff(first)
    size, words = np.maximum(1, np.diff(offsets)), np.maximum(1, n)

    def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[at[1:]] - total[at[:-1]]

    row = np.repeat(np.arange(rows), n)

    def repeated(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of a row's keys occur before in it, and the most of one."""
        key = np.sort(bw.mix(keys + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) | own.astype(np.uint64) << np.uint64(44))
        if not len(key):
            return np.zeros(rows), np.zeros(rows)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count, of = np.diff(at, append=len(key)), (key[at] >> np.uint64(44)).astype(np.int64)
        edges = np.searchsorted(of, np.arange(rows + 1))
        most = np.zeros(rows)
        some = np.flatnonzero(np.diff(edges))
        most[some] = np.maximum.reduceat(count, edges[:-1][some])
        return np.bincount(of, count - 1, rows), most

    letters = np.maximum(1, per_row(_LETTER[raw], offsets))
    twice, most = repeated(h, row)
    inside = np.flatnonzero(bw.inner(first, len(h), 4))
    grams, _ = repeated(bw.windows(h, 4)[inside], row[inside])
    last = raw[ends - 1] if len(ends) else raw
    line_end = np.flatnonzero(raw == 10)
    line_row = np.searchsorted(offsets, line_end, "right") - 1
    lines = 1 + np.bincount(line_row, minlength=rows)
    sentences = per_row(_END[last], first)
    length = ends - starts
    shares = [
        per_row(_UPPER[raw], offsets) / letters, per_row(_SYMBOL[raw], offsets) / size, per_row(_SYMBOL[last], first) / words, per_row(_SHOUT[last], first) / words, per_row(_DIGIT[raw], offsets) / size,
        per_row(_PAUSE[raw], offsets) / size, per_row(_END[raw], offsets) / size, per_row(_WIDE[raw], offsets) / size, twice / words, grams / words, most / words, per_row(length > 20, first) / words, per_row(length == 1, first) / words, lines / words,
    ]
    out = [np.minimum(s / k, 1) for s in shares for k in KNOTS]
    out += [np.log1p(n) / 5, np.minimum(np.log1p(n), 3) / 3, per_row(length, first) / words / 5, np.log1p(sentences / lines), np.log1p(words / np.maximum(1, sentences)) / 3, np.minimum(words / np.maximum(1, sentences) / 60, 1), (n == 0).astype(float)]
    return np.stack(out, axis=1)


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x array<float>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = bw.text_buffers(batch.column(1))
            for lo, hi in bw.blocks(offsets):
                x = measures(batch.column(1).slice(lo, hi - lo)).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<float>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
    return np.concatenate([np.ones((batch.num_rows, 1)), x], axis=1)


def total(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(features, whether trusted) over all rows: a vector from each task, added up in two steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows:
                got = part(_matrix(batch), batch.column("trusted").to_numpy(zero_copy_only=False))
                out = got if out is None else out + got
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(out.tobytes()) % 64], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["k", "v"])

    def add(table: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(v.as_py()) for v in table["v"])
        return pa.table({"v": pa.array([out.tobytes()], pa.binary())})

    added = rows.mapInArrow(run, "k int, v binary").groupBy("k").applyInArrow(add, "v binary").collect()
    return sum((np.frombuffer(r.v) for r in added), start=np.zeros(1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _newton(rows: DataFrame, width: int, prior: float | None) -> np.ndarray:
    """Weights of a linear model, from sums over all rows: by prior None, trusted against unlabelled; else the PU risk.

    With the logistic loss the unbiased risk is convex: -prior mean_P(z) + mean_U log(1 + e^z). Its share of unlabelled text less that of
    positives estimates a risk and can't be below zero: a step that takes it there is halved until it doesn't (non-negative risk).
    """

    def sums(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, float]:
        def part(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
            z = x @ w
            u = ~trusted
            p = _sigmoid(z)
            if prior is None:
                g, s, risk = x.T @ (p - trusted), (x * (p * (1 - p))[:, None]).T @ x, np.logaddexp(0, np.where(trusted, -z, z)).sum()
                return np.concatenate([[trusted.sum(), u.sum(), risk, 0], g, g * 0, s.ravel()])
            s = (x[u] * (p[u] * (1 - p[u]))[:, None]).T @ x[u]
            return np.concatenate([[trusted.sum(), u.sum(), np.logaddexp(0, z[u]).sum(), np.logaddexp(0, z[trusted]).sum()], x[u].T @ p[u], x[trusted].sum(axis=0), s.ravel()])

        v = total(rows, part)
        if len(v) == 1:
            return 0, 0, np.zeros(width), np.eye(width), 0
        n_p, n_u = max(1.0, v[0]), max(1.0, v[1])
        gu, gp, s = v[4 : 4 + width], v[4 + width : 4 + 2 * width], v[4 + 2 * width :].reshape(width, width)
        keep = RIDGE * w * (np.arange(width) > 0)
        if prior is None:
            n = n_p + n_u
            return v[2] / n + keep @ w / 2, 0, gu / n + keep, s / n, n
        negative = v[2] / n_u - prior * v[3] / n_p
        positive = prior * (v[3] / n_p - gp @ w / n_p)
        return positive + max(0.0, negative) + keep @ w / 2, negative, gu / n_u - prior * gp / n_p + keep, s / n_u, n_u

    w = np.zeros(width)
    risk, negative, g, s, _ = sums(w)
    for _ in range(STEPS):
        step = np.linalg.solve(s + RIDGE * np.eye(width), g)
        size = min(1.0, 20 / max(1e-9, np.abs(step).max()))
        for _ in range(8):
            there = w - size * step
            new = sums(there)
            if new[1] >= 0 and new[0] <= risk + 1e-12:
                break
            size /= 2
        else:
            return w
        gain, w = risk - new[0], there
        risk, negative, g, s, _ = new
        if gain < 1e-6:
            break
    return w


def class_prior(rows: DataFrame, w: np.ndarray) -> float:
    """The share of positives in the unlabelled text: the least ratio, over thresholds of a trusted-against-unlabelled score, of unlabelled to trusted documents above it.

    Where only positives are left, that ratio is their share; a margin for chance keeps off thresholds with few documents.
    """

    def part(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        bins = np.minimum((_sigmoid(x @ w) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(bins[trusted], minlength=BINS), np.bincount(bins[~trusted], minlength=BINS)]).astype(float)

    v = total(rows, part)
    if len(v) == 1 or not v[:BINS].sum() or not v[BINS:].sum():
        return 0.5
    above = np.cumsum(v.reshape(2, BINS)[:, ::-1], axis=1)[:, ::-1]
    n = above[:, :1]
    share = above / n
    margin = np.sqrt(np.log(20) / n) / 2
    ok = share[0] > 0
    bound = (share[1, ok] + margin[1]) / share[0, ok] + margin[0] / share[0, ok]
    best = np.argmin(bound)
    return float(np.clip(share[1, ok][best] / share[0, ok][best], 0.01, 0.99))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every document from 0 to 1 by how likely it is of trusted quality, learned without negatives.

    Trusted positives are the rows labelled 1 whose id has a CRC-32 not divisible by 5; all documents without a label that may
    be learned from are the unlabelled text (held-out rows among them, as texts without a label), and known negatives aren't used. The share of positives in the unlabelled text is
    estimated from the two score distributions, and a logistic model minimises the non-negative PU risk. All rows count: features are
    computed once from whole texts and kept in the shared folder, and each step of Newton's method adds up one vector from
    each task (the Hessian is about 60 x 60), so nothing that reaches the driver grows with the rows.

    Returns (doc_id, held_out, score). Labels that are null or neither 0 nor 1 are ignored; an id with two labels counts as
    positive. Null text counts as empty; empty texts are scored as well. Without positives the score is one constant.
    """
    x = features(docs, id_col, text)
    known = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) > 0)).groupBy(F.col("doc_id").alias("_id")).agg((F.max(label) == 1).alias("trusted"))
    rows = kept(x.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id"))
    learned = rows.select("x", (F.col("trusted").isNotNull() & F.col("trusted")).alias("trusted"), F.col("trusted").alias("known")).where("trusted or known is null").drop("known")
    width = measures(pa.array([""])).shape[1] + 1
    first = _newton(learned, width, None)
    prior = class_prior(learned, first)
    w = _newton(learned, width, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_sigmoid(_matrix(batch) @ w))], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double").select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))
