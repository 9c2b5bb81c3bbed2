"""Removal of long verbatim repeats across documents, by a count-min prefilter."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bytewords as bw
from framewright.llm.chunks import CHUNK_BYTES, chunked, totals

U64 = np.uint64
NONE = np.iinfo(np.int64).max
#: Cells of one row of a block's sketch at most (a byte each while a block is merged).
BLOCK_CELLS = 1 << 24
#: Cells for each window in each of the two rows: about 5 % of single windows then look repeated.
CELLS_A_WINDOW = 4


def _ordered(table: pa.Table) -> pa.Table:
    """The same order of rows in every pass."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _windows(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows within one document: positions, two hashes; and the documents' first words."""
    h, first = bw.words(table["text"])
    at = np.flatnonzero(bw.inner(first, len(h), width))
    return at, bw.windows(h, width, 0)[at], bw.windows(h, width, 1)[at], first


def _place(a: np.ndarray, b: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Block of each window, and its cell in each row of the block's sketch."""
    block = ((a >> U64(32)) * U64(n)) >> U64(32)
    return block, [x & U64(cells - 1) for x in (a, b)]


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of an ordered array, and where their runs begin (one more at the end)."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], np.append(starts, len(ordered))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, starts of runs, and the run of each sorted place."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def substring_dedup(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Removes the words of every window of `width` words that also starts in a document with a smaller id.

    Pass 1: each chunk of documents adds its windows to the sketch, which is cut into blocks by hash
    and merged block by block; a chunk gets back one bit for each cell it touched (counted twice or more).
    Pass 2: the windows whose cells are all so marked, and no others, are grouped exactly, by 96 bits of
    hash beside the block, and the smallest id wins: a chunk sends each of its different windows once, with its least id, and is told
    whether another chunk has a smaller one; which of its own occurrences go, it knows. So a window that all documents share is
    one entry a chunk. Chunks send rows to those blocks only for which they have windows. Pass 3 drops the words. The sketch only
    overestimates, so no repeated window is lost.

    Returns (doc_id, n_words, n_removed, removed array<struct<first,last>> of word numbers, kept_text), a row
    for each input row. Null or empty text: no words. Null ids count as larger than all others and do not
    remove each other's words; nor do rows with one id, equal or not. Other columns are ignored. An empty table gives no rows.
    """
    _, size = totals(docs, text)
    base = chunked(docs, size, id_col, text, chunk_bytes=chunk_bytes)
    n_blocks = max(16, math.ceil(CELLS_A_WINDOW * size / 6 / block_cells))
    cells = 1 << max(8, math.ceil(math.log2(max(1, CELLS_A_WINDOW * size / 6 / n_blocks))))

    def ask(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        _, a, b, _ = _windows(_ordered(table), width)
        block, rows = _place(a, b, n_blocks, cells)
        out = [[] for _ in range(4)]
        for r, cell in enumerate(rows):
            keys = np.sort(block << U64(32) | cell)
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            starts = np.flatnonzero(new)
            many = np.diff(starts, append=len(keys)) > 1
            keys = keys[starts]
            own, ends = _runs(keys >> U64(32))
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                out[2 * r].append(bw.pack(keys[lo:hi] & U64(0xFFFFFFFF)))
                out[2 * r + 1].append(bw.pack(np.flatnonzero(many[lo:hi])))
        return pa.table({"chunk": pa.array([chunk] * len(own), pa.int32()), "block": pa.array(own.astype(np.int32)), **{n: pa.array(v, pa.binary()) for n, v in zip(("c0", "m0", "c1", "m1"), out, strict=True)}})

    def merge(table: pa.Table) -> pa.Table:
        flags = []
        for r in (0, 1):
            counts = np.zeros(cells, np.uint8)
            for c, m in zip(table[f"c{r}"], table[f"m{r}"], strict=True):
                at = bw.unpack(c.as_py())
                counts[at] = np.minimum(counts[at], 2) + 1
                counts[at[bw.unpack(m.as_py())]] += 1
            flags.append(pa.array([np.packbits(counts[bw.unpack(c.as_py())] > 1).tobytes() for c in table[f"c{r}"]], pa.binary()))
        return pa.table({"chunk": table["chunk"], "block": table["block"], "f0": flags[0], "f1": flags[1]})

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = {"chunk": pa.int32(), "block": pa.int32(), "k1": pa.binary(), "k2": pa.binary(), "at": pa.binary(), "more": pa.binary(), "ids": pa.binary(), "ns": pa.binary()}
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], t) for k, t in schema.items()})
        chunk = left["chunk"][0].as_py()
        left = _ordered(left)
        ids = left["doc_id"].combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False)
        at, a, b, first = _windows(left, width)
        block, rows = _place(a, b, n_blocks, cells)
        right = right.sort_by("block")
        twice = np.ones(len(at), bool)
        for r, cell in enumerate(rows):
            keys = block << U64(32) | cell
            order, starts, run = _groups(keys)
            _, ends = _runs(keys[order[starts]] >> U64(32))
            flags = [np.unpackbits(np.frombuffer(f.as_py(), np.uint8), count=n) for n, f in zip(np.diff(ends), right[f"f{r}"], strict=True)]
            twice[order] &= np.concatenate(flags).astype(bool)[run]
        # one entry for each different window, at its first place: rows are in order of ids, so that has the least
        some = np.flatnonzero(twice)
        a, b, block, at = a[some], b[some] >> U64(32), block[some], at[some]
        doc = np.searchsorted(first, at, "right") - 1
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(order) else np.zeros(0, bool)
        heads, ends = order[new], np.append(np.flatnonzero(new)[1:], len(order)) - 1
        more = ids[doc[order[ends]]] > ids[doc[heads]] if len(order) else np.zeros(0, bool)
        by = np.lexsort((at[heads], block[heads]))
        heads, more = heads[by], more[by]
        own, ends = _runs(block[heads])
        out = {k: [] for k in schema}
        for i, lo, hi in zip(own.tolist(), ends[:-1], ends[1:], strict=True):
            x = heads[lo:hi]
            mine, ns = np.unique(doc[x], return_counts=True)
            for k, v in zip(schema, (chunk, i, a[x].tobytes(), b[x].astype(np.uint32).tobytes(), bw.pack(at[x]), np.packbits(more[lo:hi]).tobytes(), ids[mine].tobytes(), ns.astype(np.uint32).tobytes()), strict=True):
                out[k].append(v)
        return pa.table({k: pa.array(out[k], t) for k, t in schema.items()})

    def exact(table: pa.Table) -> pa.Table:
        a = np.frombuffer(b"".join(x.as_py() for x in table["k1"]), U64)
        b = np.frombuffer(b"".join(x.as_py() for x in table["k2"]), np.uint32)
        sizes = [len(x.as_py()) // 4 for x in table["k2"]]
        ids = np.repeat(np.frombuffer(b"".join(x.as_py() for x in table["ids"]), np.int64), np.frombuffer(b"".join(x.as_py() for x in table["ns"]), np.uint32))
        more = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(table["more"], sizes, strict=True)] or [np.zeros(0, np.uint8)]).astype(bool)
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        low = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(order) else ids
        gone = np.zeros(len(order), bool)
        gone[order] = ids[order] > low[np.cumsum(new) - 1]
        told = gone | more  # windows of which some occurrence in the chunk goes, and whether the first does too
        out = {"chunk": [], "at": [], "all": []}
        for i, (chunk, lo, hi) in enumerate(zip(table["chunk"].to_pylist(), np.cumsum([0, *sizes[:-1]]), np.cumsum(sizes), strict=True)):
            x = told[lo:hi]
            if x.any():
                for k, v in zip(out, (chunk, bw.pack(bw.unpack(table["at"][i].as_py())[x]), np.packbits(gone[lo:hi][x]).tobytes()), strict=True):
                    out[k].append(v)
        return pa.table({"chunk": pa.array(out["chunk"], pa.int32()), "at": pa.array(out["at"], pa.binary()), "all": pa.array(out["all"], pa.binary())})

    kept_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _ordered(left)
        n = left.num_rows
        raw, offsets = bw.text_buffers(left["text"])
        firsts = np.zeros(n + 1, np.int64)
        for lo, hi in bw.blocks(offsets):
            firsts[lo + 1 : hi + 1] = firsts[lo] + bw.spans(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[2][1:]
        edge = np.zeros(firsts[-1] + 1, np.int32)
        heads = [bw.unpack(x.as_py()) for x in right["at"]]
        if heads:
            every = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)) for x, p in zip(right["all"], heads, strict=True)]).astype(bool)
            heads = np.concatenate(heads)
            at, a, b, _ = _windows(left, width)
            key = bw.mix(a ^ (b >> U64(32)))
            ids = left["doc_id"].combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False)
            told = key[np.searchsorted(at, heads)]
            order = np.argsort(told)
            told, every, heads = told[order], every[order], heads[order]
            found = np.minimum(np.searchsorted(told, key), len(told) - 1)
            hit = np.flatnonzero(told[found] == key)
            found = found[hit]
            own, least = (ids[np.searchsorted(firsts, x, "right") - 1] for x in (at[hit], heads[found]))
            at = at[hit][every[found] | (own > least)]
            edge[at] += 1
            edge[at + width] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[firsts[1:]] - total[firsts[:-1]]
        kept, runs = [], []
        for i in range(n):
            own = raw[offsets[i] : offsets[i + 1]].tobytes().split()
            if removed[i]:
                flags = gone[firsts[i] : firsts[i + 1]]
                turn = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
                runs.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                own = itertools.compress(own, (~flags).tolist())
            else:
                runs.append([])
            kept.append(b" ".join(own).decode())
        return pa.table({"doc_id": left["doc_id"], "n_words": pa.array(np.diff(firsts)), "n_removed": pa.array(removed.astype(np.int64)), "removed": pa.array(runs, kept_type), "kept_text": pa.array(kept, pa.string())})

    by_chunk = base.groupBy("chunk")
    asked = by_chunk.applyInArrow(ask, "chunk int, block int, c0 binary, m0 binary, c1 binary, m1 binary")
    flags = asked.groupBy("block").applyInArrow(merge, "chunk int, block int, f0 binary, f1 binary")
    picked = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(pick, "chunk int, block int, k1 binary, k2 binary, at binary, more binary, ids binary, ns binary")
    gone = picked.groupBy("block").applyInArrow(exact, "chunk int, at binary, all binary")
    return by_chunk.cogroup(gone.groupBy("chunk")).applyInArrow(drop, "doc_id long, n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
w as (select doc_id, unnest(range(1, len(w) - 11)) p, w from d where len(w) >= 13),
k as (select doc_id, p, array_to_string(w[p:p + 12], ' ') s from w),
m as (select s, min(doc_id) lo from k group by s having count(distinct doc_id) > 1),
c as (select distinct k.doc_id, unnest(range(k.p, k.p + 13)) p from k join m using (s) where k.doc_id > m.lo),
g as (select doc_id, list(p) ps from c group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(len(ps), 0)::bigint n_removed,
  sha256(array_to_string(case when ps is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(ps, i)), lambda i: w[i]) end, ' ')) kept_sha256
from d left join g using (doc_id)
"""
