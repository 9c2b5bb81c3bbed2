"""Language-model scores by context-tree weighting over the bytes of a text, with a unigram baseline."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bytewords as bw
from framewright.llm.chunks import chunked, totals
from framewright.llm.store import kept

U64 = np.uint64
#: Bytes of context; a gram is as many bytes and the one that follows, the nearest of the context first.
DEPTH = 5
CHUNK_BYTES, BLOCK_BYTES = 8 << 20, 32 << 20
#: Groups of contexts by their last two bytes; each is dealt by the third byte into parts, which are so many that they have about this much text.
GROUPS, PART_BYTES = 64, 2 << 20
FOLDS = 10
_LOWER = bw.LOWER.tobytes()
END = 0x0A


def fold(id_col: Column, n: int = FOLDS) -> Column:
    """CRC-32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % n, F.lit(0))


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x > 0, by Stirling's series after a shift of 8."""
    x = np.asarray(x, np.float64)
    y = x + 8
    low = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - low


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - math.log(math.pi)


def streams(column: pa.Array, lo: int, hi: int, raw: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all bytes of the token streams of some rows, and where rows begin (one more at the end).

    A stream is the row's lowered words, a space between them and END after the last, as if it followed many ENDs.
    """
    lead = bytes([END]) * depth
    parts = [lead + b" ".join(raw[offsets[i] : offsets[i + 1]].tobytes().translate(_LOWER).split()) + b"\n" for i in range(lo, hi)]
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"".join(parts), np.uint8).astype(U64)
    n = len(text) - depth
    gram = np.zeros(n, U64)
    for j in range(1, depth + 1):
        gram = gram << U64(8) | text[depth - j : depth - j + n]
    gram = gram << U64(8) | text[depth:]
    first = np.concatenate([[0], np.cumsum(sizes)])
    own = np.ones(n, bool)  # the leads of all rows but the first are within the array
    for j in range(depth):
        own[first[1:-1] - depth + j] = False
    return gram[own], np.concatenate([[0], np.cumsum(sizes - depth)])


def _unique(parts: list[np.ndarray]) -> np.ndarray:
    x = np.sort(np.concatenate(parts)) if parts else np.zeros(0, U64)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    x, n = np.concatenate(keys or [np.zeros(0, U64)]), np.concatenate(counts or [np.zeros(0, np.int64)])
    order = np.argsort(x)
    x = x[order]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.add.reduceat(n[order], at) if len(x) else n


def _count(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(at, append=len(x))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(x: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _block(keys: np.ndarray, n: int) -> np.ndarray:
    return ((bw.mix(keys) >> U64(32)) * U64(n)) >> U64(32)


class Keys:
    """Distinct words and grams of some texts, how often they occur in those to learn from, and by block."""

    def __init__(self, n_blocks: int, counted: str = ""):
        """counted: of which of words (w) and grams (g) occurrences are counted."""
        self.n_blocks, self.counted, self.parts = n_blocks, counted, {"w": ([], [], []), "g": ([], [], [])}

    def add(self, column: pa.Array, train: np.ndarray) -> None:
        raw, offsets = bw.text_buffers(column)
        for lo, hi in bw.blocks(offsets):
            h, wf = bw.words(column.slice(lo, hi - lo), lower=True)
            g, gf = streams(column, lo, hi, raw, offsets)
            for of, x, first in (("w", h, wf), ("g", g, gf)):
                every, keys, counts = self.parts[of]
                if of not in self.counted:
                    every.append(_unique([x]))
                    continue
                learned = np.repeat(train[lo:hi], np.diff(first))
                k, n = _count(x[learned])
                every.append(_unique([k, x[~learned]]))
                keys.append(k)
                counts.append(n)

    def sorted(self, of: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, counts to learn from, their order by block, and where blocks end in it."""
        every, keys, counts = self.parts[of]
        every, (k, n) = _unique(every), _counted(keys, counts)
        count = np.zeros(len(every), np.uint32)
        count[np.searchsorted(every, k)] = n
        block = _block(every, self.n_blocks)
        order = np.argsort(block, kind="stable")
        return every, count, order, bw.slices(block[order], self.n_blocks)

    def packed(self) -> dict[str, list]:
        """A row for each block that has any of the keys."""
        found: dict[str, dict[int, bytes]] = {}
        for of in ("w", "g"):  # one after another, for memory
            every, count, order, ends = self.sorted(of)
            cuts = {int(i): order[ends[i] : ends[i + 1]] for i in np.flatnonzero(np.diff(ends))}
            found[of] = {i: _planes(every[c]) for i, c in cuts.items()}
            found[f"{of}n"] = {i: _planes(count[c]) for i, c in cuts.items()} if of in self.counted else {}
        some = sorted(found["w"].keys() | found["g"].keys())
        return {"block": some} | {k: [v.get(i, b"") if k.strip("n") in self.counted or len(k) == 1 else None for i in some] for k, v in found.items()}


ASKED = "block int, w binary, wn binary, g binary, gn binary"


def _table(columns: dict[str, list], **more: pa.Array) -> dict[str, pa.Array]:
    return more | {k: pa.array(v, pa.int32() if k == "block" else pa.binary()) for k, v in columns.items()}


def _levels(grams: np.ndarray, counts: np.ndarray, depth: int, least: int) -> dict[int, tuple]:
    """Nodes of the tree from level `depth` up to `least`: for each level keys (context, node), zeros, ones, log Pw, log of the sum below."""
    out, below = {}, None
    symbol = grams & U64(255)
    for d in range(depth, least - 1, -1):
        context = grams >> U64(8 * (depth - d) + 8)
        keys, zeros, ones = [], [], []
        k, n = _counted([context << U64(8) | symbol], [counts])
        x = k & U64(255)
        for bit in range(8):
            node = U64(1 << bit) | x >> U64(8 - bit)
            one = (x >> U64(7 - bit) & U64(1)).astype(np.int64)
            keys.append(k & ~U64(255) | node)
            ones.append(n * one)
            zeros.append(n * (1 - one))
        keys, (both, ones) = np.concatenate(keys), (np.concatenate(zeros), np.concatenate(ones))
        order = np.argsort(keys)
        ranked = keys[order]
        at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
        nodes = ranked[at]
        a, b = (np.add.reduceat(v[order], at) if len(at) else v for v in (both, ones))
        kt = log_kt(a.astype(np.float64), b.astype(np.float64))
        s = None
        if below is not None:
            s = np.zeros(len(nodes))
            up = (below[0] >> U64(16)) << U64(8) | below[0] & U64(255)
            np.add.at(s, np.searchsorted(nodes, up), below[3])
        below = out[d] = (nodes, a, b, kt if s is None else np.logaddexp(kt, s) - math.log(2), kt, s)
    return out


def _predict(grams: np.ndarray, levels: dict[int, tuple], depth: int) -> np.ndarray:
    """log P(last byte | context) of each gram: at every bit the mixture over all depths, by the posterior weight of each."""
    symbol = grams & U64(255)
    total = np.zeros(len(grams))
    for bit in range(8):
        node = U64(1 << bit) | symbol >> U64(8 - bit)
        one = (symbol >> U64(7 - bit) & U64(1)).astype(bool)
        p = np.full(len(grams), 0.5)
        for d in range(depth, -1, -1):
            nodes, a, b, pw, kt, s = levels[d]
            key = grams >> U64(8 * (depth - d) + 8) << U64(8) | node
            at = np.minimum(np.searchsorted(nodes, key), max(0, len(nodes) - 1))
            if not len(nodes):
                continue
            seen = nodes[at] == key
            own = (np.where(one, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1)
            stop = np.ones(len(at)) if s is None else np.exp(kt[at] - math.log(2) - pw[at])
            p = np.where(seen, stop * own + (1 - stop) * p, p)
        total += np.log(p)
    return total


def _added(rows: list[dict]) -> tuple:
    """Nodes of a level, from what those below add up to (k: nodes, a: zeros, b: ones, s: log of the sum below)."""
    keys, a, b, s = (np.concatenate([np.frombuffer(r[c], t) for r in rows] or [np.zeros(0, t)]) for c, t in (("k", U64), ("a", np.int64), ("b", np.int64), ("s", np.float64)))
    nodes, at = np.unique(keys, return_inverse=True)
    x, y, z = (np.bincount(at, v, len(nodes)).astype(v.dtype) for v in (a, b, s))
    kt = log_kt(x.astype(np.float64), y.astype(np.float64))
    return nodes, x, y, np.logaddexp(kt, z) - math.log(2), kt, z


def _upper(rows: list[dict]) -> dict[int, tuple]:
    """Levels 1 and 0 from what the groups add up to at level 1."""
    one = _added(rows)
    return {1: one, 0: _added([{"k": (one[0] & U64(255)).tobytes(), "a": one[1].tobytes(), "b": one[2].tobytes(), "s": one[3].tobytes()}])}


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """log10 probability of every whole text under a context-tree model of the training rows, and under unigrams.

    Learns from rows whose id has a CRC-32 not divisible by 10. Each byte of the lowered words, a space between words and an end after
    the last, is eight binary decisions. Each decision has a Krichevsky-Trofimov estimate in every context of 0 to DEPTH bytes, and
    weighting mixes all depths by their posterior weights, bottom up; so the score is minus the code length.

    Counts: every task packs the distinct grams (context and byte) of a few MB, and blocks of a hash add them up. The tree
    is built in parts by the last three bytes of the contexts, whose number grows with the text; its level of two bytes in GROUPS groups, and
    the two topmost levels (65 280 nodes at most) on the driver. Then each chunk of documents asks the blocks for the log probabilities of its
    distinct grams and the counts of its distinct words. A chunk has rows only for blocks, and a block only for parts, that hold some of its keys.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: the code length per byte of the stream). Words are keyed by 64 bits of hash. Null text is
    empty: one token, the end. A null id is held out; repeated rows count as often as they occur. Without training rows each bit
    has probability 1/2. An empty table gives no rows.
    """
    _, size = totals(docs, text)
    n_blocks = max(16, math.ceil(size / BLOCK_BYTES))
    spread = min(1 << 16, max(1, math.ceil(size / PART_BYTES / GROUPS)))
    train = (fold(F.col(id_col)) != 0).alias("train")
    rows = docs.select(train, F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = Keys(n_blocks, "wg"), 0
        for batch in batches:
            _, offsets = bw.text_buffers(batch.column(1))
            flags = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in bw.blocks(offsets, chunk_bytes // 2):
                held.add(batch.column(1).slice(lo, hi - lo), flags[lo:hi])
                have += offsets[hi] - offsets[lo] + hi - lo
                if have > chunk_bytes:
                    yield pa.RecordBatch.from_pydict(_table(held.packed()))
                    held, have = Keys(n_blocks, "wg"), 0
        if have:
            yield pa.RecordBatch.from_pydict(_table(held.packed()))

    def add_up(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        sums = [_counted([_unplanes(x.as_py(), U64) for x in table[k]], [_unplanes(x.as_py(), np.uint32).astype(np.int64) for x in table[f"{k}n"]]) for k in ("w", "g")]
        (_, n), (g, gn) = sums
        part = _block((g >> U64(8 * (DEPTH - 2) + 8)) + U64(1), GROUPS) * U64(spread) + _block((g >> U64(8 * (DEPTH - 3) + 8)) + U64(1), spread)
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) > 0])) if len(part) else np.zeros(0, np.int64)
        cuts = np.split(order, starts[1:]) if len(part) else [order]  # a row at least, for the words
        more = len(cuts) - 1
        return pa.table({
            "block": pa.array([block] * len(cuts), pa.int32()), "part": pa.array(part[order[starts]].astype(np.int32) if len(part) else [0], pa.int32()), "v": pa.array([int((n > 0).sum())] + [0] * more, pa.int64()), "n": pa.array([int(n.sum())] + [0] * more, pa.int64()),
            "g": pa.array([_planes(g[c]) for c in cuts], pa.binary()), "gn": pa.array([_planes(gn[c]) for c in cuts], pa.binary()),
        })

    counts = kept(rows.mapInArrow(count, ASKED).groupBy("block").applyInArrow(add_up, "block int, part int, v long, n long, g binary, gn binary"))
    v, n = counts.agg(F.sum("v"), F.sum("n")).first()
    n_ends = docs.where(fold(F.col(id_col)) != 0).count()
    n_words, n_train = (v or 0) + (n_ends > 0), (n or 0) + n_ends

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = [_unplanes(x.as_py(), U64) for x in table["g"]]
        gn = np.concatenate([_unplanes(x.as_py(), np.int64) for x in table["gn"]])
        blocks = np.repeat(table["block"].to_numpy(), [len(x) for x in g])
        return np.concatenate(g), gn, blocks

    def sums(nodes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nodes of the context shorter by its farthest byte, and their sums."""
        keys, at = np.unique(nodes >> U64(16) << U64(8) | nodes & U64(255), return_inverse=True)
        return keys, *(np.bincount(at, v, len(keys)).astype(v.dtype) for v in values)

    def top(table: pa.Table) -> pa.Table:
        g, gn, _ = read(table)
        nodes, a, b, pw, _, _ = _levels(g[gn > 0], gn[gn > 0], DEPTH, 3)[3]
        found = zip(("k", "a", "b", "s"), sums(nodes, a, b, pw), strict=True)
        return pa.table({"group": pa.array([table["part"][0].as_py() // spread], pa.int32())} | {k: pa.array([z.tobytes()], pa.binary()) for k, z in found})

    def second(table: pa.Table) -> pa.Table:
        """Level 2 of a group, from its parts; and what it adds up to at level 1."""
        level = _added(table.to_pylist())
        found = zip(("k", "a", "b", "s"), sums(level[0], level[1], level[2], level[3]), strict=True)
        return pa.table({"group": table["group"].slice(0, 1)} | {f"l{i}": pa.array([x.tobytes()], pa.binary()) for i, x in enumerate(level)} | {k: pa.array([z.tobytes()], pa.binary()) for k, z in found})

    arrays = ", ".join(f"{k} binary" for k in ("k", "a", "b", "s"))
    tops = counts.groupBy("part").applyInArrow(top, f"group int, {arrays}")
    level2 = kept(tops.groupBy("group").applyInArrow(second, f"group int, {', '.join(f'l{i} binary' for i in range(6))}, {arrays}"))
    upper = _upper([r.asDict() for r in level2.select("k", "a", "b", "s").collect()])

    def tree(table: pa.Table, above: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "g": pa.array([], pa.binary()), "p": pa.array([], pa.binary())})
        g, gn, blocks = read(table)
        own = tuple(np.frombuffer(above[f"l{i}"][0].as_py(), t) for i, t in enumerate((U64, np.int64, np.int64, np.float64, np.float64, np.float64)))
        p = _predict(g, _levels(g[gn > 0], gn[gn > 0], DEPTH, 3) | {2: own} | upper, DEPTH).astype(np.float32)
        order = np.argsort(blocks, kind="stable")
        ends = bw.slices(blocks[order], n_blocks)
        cuts = [(i, order[ends[i] : ends[i + 1]]) for i in range(n_blocks) if ends[i] < ends[i + 1]]
        return pa.table({"block": pa.array([i for i, _ in cuts], pa.int32()), "g": pa.array([_planes(g[c]) for _, c in cuts], pa.binary()), "p": pa.array([_planes(p[c]) for _, c in cuts], pa.binary())})

    own_part = F.explode(F.sequence(F.col("group") * spread, F.col("group") * spread + spread - 1)).alias("part")
    above = level2.select(own_part, *[f"l{i}" for i in range(6)])
    scored = counts.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(tree, "block int, g binary, p binary")
    base = chunked(docs, size, id_col, text, (train,), chunk_bytes)
    by_chunk = base.groupBy("chunk")

    def ask(table: pa.Table) -> pa.Table:
        held = Keys(n_blocks, "w")
        for batch in table.to_batches():
            held.add(batch.column("text"), batch.column("train").to_numpy(zero_copy_only=False))
        asked = held.packed()
        return pa.table(_table(asked, chunk=pa.array([table["chunk"][0].as_py()] * len(asked["block"]), pa.int32())))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        words = [_unplanes(x.as_py(), U64) for x in asked["w"]]
        w, n = _counted(words, [_unplanes(x.as_py(), np.uint32).astype(np.int64) for x in asked["wn"]])
        g, p = (np.concatenate([_unplanes(x.as_py(), t) for x in known[c]] or [np.zeros(0, t)]) for c, t in (("g", U64), ("p", np.float32)))
        order = np.argsort(g)
        g, p = g[order], p[order]
        wn = [_planes(n[np.searchsorted(w, x)]) for x in words]
        gp = [_planes(p[np.searchsorted(g, _unplanes(x.as_py(), U64))]) for x in asked["g"]]
        return pa.table({"chunk": asked["chunk"], "block": asked["block"], "wn": pa.array(wn, pa.binary()), "gp": pa.array(gp, pa.binary())})

    floor = math.log10(n_train + 0.1 * (n_words + 1))
    end_part = math.log10(n_ends + 0.1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        held = Keys(n_blocks)
        batches = left.to_batches()
        for batch in batches:
            held.add(batch.column("text"), np.zeros(batch.num_rows, bool))
        right = right.sort_by("block")
        values = {}
        for of, column, kind in (("w", "wn", np.int64), ("g", "gp", np.float32)):
            every, _, order, _ = held.sorted(of)
            value = np.zeros(len(every), kind)
            value[order] = np.concatenate([_unplanes(x.as_py(), kind) for x in right[column]] or [np.zeros(0, kind)])
            values[of] = every, value
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
        added = lambda x, first: (t := np.concatenate([[0.0], np.cumsum(x)]))[first[1:]] - t[first[:-1]]
        for batch in batches:
            raw, offsets = bw.text_buffers(batch.column("text"))
            for lo, hi in bw.blocks(offsets):
                h, wf = bw.words(batch.column("text").slice(lo, hi - lo), lower=True)
                every, value = values["w"]
                c = value[np.searchsorted(every, h)]
                n = np.diff(wf) + 1
                out["n_tokens"].append(n)
                out["n_known"].append(added(c > 0, wf).astype(np.int64) + (n_ends > 0))
                out["base_score"].append(added(np.log10(c + 0.1), wf) + end_part - n * floor)
                g, gf = streams(batch.column("text"), lo, hi, raw, offsets)
                every, value = values["g"]
                order = np.argsort(g)
                p = np.empty(len(g))
                p[order] = value[np.searchsorted(every, g[order])]
                code = added(p, gf)
                out["score"].append(code / math.log(10))
                out["bits_per_byte"].append(-code / math.log(2) / np.diff(gf))
        return pa.table({"doc_id": left["doc_id"], "train": left["train"]} | {k: np.concatenate(x) for k, x in out.items()})

    asked = by_chunk.applyInArrow(ask, f"chunk int, {ASKED}")
    answers = asked.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(answer, "chunk int, block int, wn binary, gp binary")
    out = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
