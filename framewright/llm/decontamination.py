"""Benchmark decontamination: suffix arrays over the training texts, searched with every suffix of the test items."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bytewords as bw
from framewright.llm.chunks import totals
from framewright.llm.store import shared

U64 = np.uint64
#: Bytes of training text in one shard's suffix array.
SHARD_BYTES = 4 << 20
#: Bytes of item texts that are broadcast at once; more items are searched for in further blocks.
ITEM_BYTES = 8 << 20

REPORT = "n_words long, n_hit long, items array<string>, matches array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>, hit binary"
MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of seq in the order of their suffixes' first `depth` values at least (prefix doubling)."""
    rank, k = seq.astype(np.int64), 1
    order = np.argsort(rank)
    while k < depth:
        key = rank << 32
        key[:-k] |= rank[k:]
        order = np.argsort(key)
        ranked = key[order]
        new = np.ones(len(key), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        rank[order] = np.cumsum(new)
        if new.all():
            break
        k *= 2
    return order


def search(seq: np.ndarray, order: np.ndarray, pats: np.ndarray, sizes: np.ndarray, upper: bool) -> np.ndarray:
    """By binary search, the first place in the suffix array that is not below (upper: above) each pattern."""
    lo, hi = np.zeros(len(pats), np.int64), np.full(len(pats), len(order), np.int64)
    while len(busy := np.flatnonzero(lo < hi)):
        mid = (lo[busy] + hi[busy]) >> 1
        at, side = order[mid], np.zeros(len(busy), np.int64)
        even = np.arange(len(busy))
        for j in range(pats.shape[1]):
            even = even[j < sizes[busy[even]]]
            if not len(even):
                break
            there = at[even] + j
            found = np.where(there < len(seq), seq[np.minimum(there, len(seq) - 1)], -2)
            side[even] = np.sign(found - pats[busy[even], j])
            even = even[side[even] == 0]
        right = side <= 0 if upper else side < 0
        lo[busy[right]] = mid[right] + 1
        hi[busy[~right]] = mid[~right]
    return lo


class Items:
    """Test items, packed for broadcast: word hashes with a gap after each item, and where windows start."""

    def __init__(self, rows: list[tuple[str, str]], width: int):
        h, first = bw.words(pa.array([t for _, t in rows], pa.string()), bw.ALNUM, lower=True)
        n = np.diff(first)
        gap = np.repeat(np.arange(len(rows)), n)
        self.ids = [i for i, _ in rows]
        self.words = np.zeros(len(h) + len(rows), U64)
        self.words[np.arange(len(h)) + gap] = h
        self.start = first[:-1] + np.arange(len(rows))
        size = np.minimum(n, width)
        count = np.where(n > 0, n - size + 1, 0)
        self.item = np.repeat(np.arange(len(rows)), count)
        self.at = np.repeat(self.start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        self.size = size[self.item]


def _starts(seq: np.ndarray, test: np.ndarray, suffixes: np.ndarray, at: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (window, place) at which a match begins: those of a window's places whose word before differs from the window's.

    Windows of one size share a range of the suffix array or have none in common. Each range is sorted by the word before, so the
    places at which a match only goes on are stepped over together: no more pairs are made than there are longest matches.
    """
    before = np.concatenate([[0], seq[:-1]])
    own = np.where(at > 0, test[np.maximum(at, 1) - 1], -1)
    which, places = [], []
    for n in np.unique(size):
        asked = np.flatnonzero(size == n)
        starts, of = np.unique(low[asked], return_inverse=True)
        ends = np.zeros(len(starts), np.int64)
        ends[of] = high[asked]
        lengths = ends - starts
        base = np.concatenate([[0], np.cumsum(lengths)])
        group = np.repeat(np.arange(len(starts)), lengths)
        place = suffixes[np.repeat(starts - base[:-1], lengths) + np.arange(base[-1])]
        key = group << 32 | before[place]
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        same = of.astype(np.int64) << 32 | np.maximum(own[asked], 0)
        skip = [np.where(own[asked] > 0, np.searchsorted(key, same, side), base[of + 1]) for side in ("left", "right")]
        for lo, hi in ((base[of], skip[0]), (skip[1], base[of + 1])):
            many = hi - lo
            which.append(np.repeat(asked, many))
            places.append(place[np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())])
    return np.concatenate(which), np.concatenate(places)


def _matches(items: Items, column: pa.Array, width: int, lo: int, hi: int, raw: np.ndarray, offsets: np.ndarray):
    """Of one shard (rows lo to hi): words of each row, and all (row, item, item word, row word, length) that match as far as they can."""
    texts = pa.StringArray.from_buffers(hi - lo, pa.py_buffer((offsets[lo : hi + 1] - offsets[lo]).astype(np.int32)), pa.py_buffer(raw[offsets[lo] : offsets[hi]]))
    h, first = bw.words(texts, bw.ALNUM, lower=True)
    rows, n = hi - lo, np.diff(first)
    none = (n, *(np.zeros(0, np.int64) for _ in range(5)))
    if not len(h) or not len(items.at):
        return none
    order = np.argsort(h)
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    known = ranked[new]
    seq = np.zeros(len(h) + rows, np.int64)  # 0 after each row
    place = np.arange(len(h)) + np.repeat(np.arange(rows), n)
    seq[place[order]] = np.cumsum(new)
    found = np.minimum(np.searchsorted(known, items.words), len(known) - 1)
    test = np.where((known[found] == items.words) & (items.words != 0), found + 1, -1)
    lost = np.concatenate([[0], np.cumsum(test < 0)])
    ask = np.flatnonzero(lost[items.at + items.size] == lost[items.at])
    suffixes = suffix_array(seq, width)
    if not len(ask):
        return none
    pats = test[np.minimum(items.at[ask][:, None] + np.arange(width), len(test) - 1)]
    low, high = (search(seq, suffixes, pats, items.size[ask], up) for up in (False, True))
    some = high > low
    ask, low, high = ask[some], low[some], high[some]
    if not len(ask):
        return none
    which, at = _starts(seq, test, suffixes, items.at[ask], items.size[ask], low, high)
    which = ask[which]
    # both texts agree over the window, and may go on
    there, size = items.at[which], items.size[which].copy()
    busy = np.arange(len(at))
    while len(busy):
        a, b = at[busy] + size[busy], there[busy] + size[busy]
        inside = (a < len(seq)) & (b < len(test))
        busy, a, b = busy[inside], a[inside], b[inside]
        busy = busy[(seq[a] == test[b]) & (seq[a] > 0)]
        size[busy] += 1
    heads = first[:-1] + np.arange(rows)
    row = np.searchsorted(heads, at, "right") - 1
    return n, row, items.item[which], items.at[which] - items.start[items.item[which]], at - heads[row], size


def _scanner(items, width: int, text: str, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = items()
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("row").field(text)
            raw, offsets = bw.text_buffers(column)
            for lo, hi in bw.blocks(offsets, SHARD_BYTES):
                n, row, item, item_word, word, size = _matches(test, column, width, lo, hi, raw, offsets)
                by = np.lexsort((word, row))
                row, item, item_word, word, size = (x[by] for x in (row, item, item_word, word, size))
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                base = np.concatenate([[0], np.cumsum(n)])
                edge = np.zeros(base[-1] + 1, np.int32)
                np.add.at(edge, base[row] + word, 1)
                np.add.at(edge, base[row] + word + size, -1)
                hit = np.cumsum(edge[:-1]) > 0
                out = {k: [] for k in ("n_hit", "items", "matches", "hit")}
                for i in range(hi - lo):
                    x = slice(ends[i], ends[i + 1])
                    own = hit[base[i] : base[i + 1]]
                    names = {test.ids[j] for j in item[x].tolist()}
                    spans = [{"item_id": test.ids[a], "item_word": b, "doc_word": c, "n_words": d} for a, b, c, d in zip(item[x].tolist(), item_word[x].tolist(), word[x].tolist(), size[x].tolist(), strict=True)]
                    if not first and (before := batch.column("hit")[lo + i].as_py()) is not None:
                        own = own | np.unpackbits(np.frombuffer(before, np.uint8), count=len(own)).astype(bool)
                        names |= set(batch.column("items")[lo + i].as_py())
                        spans = batch.column("matches")[lo + i].as_py() + spans
                    out["n_hit"].append(int(own.sum()))
                    out["items"].append(sorted(names))
                    out["matches"].append(spans)
                    out["hit"].append(np.packbits(own).tobytes() if out["n_hit"][-1] else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["matches"], MATCH), pa.array(out["hit"], pa.binary())],
                    ["row", "n_words", "n_hit", "items", "matches", "hit"],
                )

    return scan


def find_matches(docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Longest verbatim matches of `width` words or more between each document and the test items.

    The documents' words are cut into shards of a few MB as they are read. Each shard sorts its suffixes into a
    suffix array, in which every suffix of every item is looked up by binary search. Only where the words before
    differ does a match begin, and it is followed as far as both texts agree. An item of fewer words, but not none, matches as a whole.
    No shuffle. The items are the stated query set: they are broadcast in blocks of item_bytes, and each block
    passes over the documents once.

    Returns (row struct<all columns of docs>, n_words, n_hit words within a match, items: ids found, matches:
    item, word of the item and of the document, length). Letters A-Z are lowered. Null or empty texts have no
    words and no matches. A null item id reads ''. Repeated words make as many matches as there are, not all pairs of places. Rows are independent, so equal rows give equal results, and
    clashing column names stay inside `row`. No items: nothing is hit.
    """
    _, size = totals(items, item_text)
    n_blocks = max(1, math.ceil(size / item_bytes))
    asked = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    kind = docs.select(F.struct("*").alias("row")).schema
    out = docs.select(F.struct("*").alias("row"))
    schema = f"row {kind['row'].dataType.simpleString()}, {REPORT}"
    for b in range(n_blocks):
        rows = sorted((r.i, r.t) for r in asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b).collect())
        sent = shared(docs.sparkSession, Items(rows, width))
        out = out.mapInArrow(_scanner(sent, width, text, b == 0), schema)
    return out.drop("hit")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, **names: str) -> DataFrame:
    """The rows of docs, unchanged, without those that hold a match with an item (see find_matches)."""
    return find_matches(docs, items, width, **names).where("n_hit = 0").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
q as (select item_id, w, least(10, len(w)) n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) p from b where len(w) > 0),
s as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') s from q),
n as (select distinct n from s),
k as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) p from d, n where len(w) >= n),
h as (select k.doc_id, s.item_id, k.p, k.n from k join s on s.n = k.n and s.s = array_to_string(k.w[k.p:k.p + k.n - 1], ' ')),
c as (select doc_id, count(distinct p)::bigint n_hit from (select doc_id, unnest(range(p, p + n)) p from h) group by doc_id),
i as (select doc_id, count(distinct item_id)::bigint n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from h group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c using (doc_id) left join i using (doc_id)
"""
