"""Near duplicates by word shingles: a chosen-path similarity join with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bytewords as bw
from framewright.llm.store import kept

U64 = np.uint64
SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Sampled tokens (minima of so many hash orders) of a set; tokens that a bucket is split on at each level.
SAMPLES, BRANCHES = 64, 2
#: Buckets up to this size are compared pair by pair; larger ones are split, at most so often.
BUCKET, LEVELS = 500, 8
#: A large bucket whose mean similarity is as high is not split further but compared in blocks.
DENSE = 0.5

_rng = np.random.Generator(np.random.PCG64(977))
_A = _rng.integers(0, 2**64, SAMPLES, dtype=U64) | U64(1)
_B = _rng.integers(0, 2**64, SAMPLES, dtype=U64)


def shingles(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, sorted, and where rows begin (one more at the end). A text of fewer words, but not none, is one shingle."""
    h, first = bw.words(column)
    n = np.diff(first)
    rows = np.arange(len(n))
    at = np.flatnonzero(bw.inner(first, len(h), width))
    values, row = bw.windows(h, width)[at], np.searchsorted(first, at, "right") - 1
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        short = np.array([bw.windows(h[first[i] : first[i + 1]], int(n[i]), 1)[0] for i in few], U64)
        row = np.concatenate([row, few])
        order = np.argsort(row, kind="stable")
        values, row = np.concatenate([values, short])[order], row[order]
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    values = values.copy()
    for i in rows:
        values[ends[i] : ends[i + 1]].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.concatenate([[0], np.cumsum(new)])[ends]


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = bw.text_buffers(batch.column(2))
            for lo, hi in bw.blocks(offsets):
                values, first = shingles(batch.column(2).slice(lo, hi - lo), width)
                n = np.diff(first)
                some = np.flatnonzero(n)
                starts = first[:-1][some]
                sig = np.zeros((2, hi - lo), U64)
                low = np.zeros((hi - lo, SAMPLES), np.int32)
                if len(some):
                    for k in (0, 1):
                        sig[k, some] = np.add.reduceat(bw.mix(values + _B[k]), starts)
                    for i in range(SAMPLES):
                        low[some, i] = (np.minimum.reduceat(values * _A[i] + _B[i], starts) >> U64(32)).astype(np.uint32).view(np.int32)
                tokens = pa.ListArray.from_arrays(np.arange(0, (hi - lo) * SAMPLES + 1, SAMPLES, dtype=np.int32), pa.array(low.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(sig[0].view(np.int64)), pa.array(sig[1].view(np.int64)), tokens], ["doc_id", "h", "n", "s0", "s1", "tokens"])

    return run


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(key)[0].as_py() != keys[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def linked(values: np.ndarray, first: np.ndarray, at_least: Fraction) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at_least, exactly: products of blocks of the set-by-token matrix."""
    m, n = len(first) - 1, np.diff(first)
    row = np.repeat(np.arange(m, dtype=np.int32), n)
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    token = np.cumsum(new) - 1
    shared = np.bincount(token)[token] > 1 if len(token) else np.zeros(0, bool)
    row, token = row[order][shared], token[shared]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    token = np.cumsum(new) - 1
    both = np.zeros((m, m), np.float32)
    step = max(1024, (1 << 22) // max(1, m))
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        a, b = np.searchsorted(token, [lo, lo + step])
        x = np.zeros((m, int(token[b - 1]) + 1 - lo), np.float32)
        x[row[a:b], token[a:b] - lo] = 1
        both += x @ x.T
    common = np.rint(both).astype(np.int64)
    out = common * at_least.denominator >= at_least.numerator * (n[:, None] + n[None, :] - common)
    out &= (n > 0)[:, None] & (n > 0)[None, :]
    np.fill_diagonal(out, False)
    return out


def _verify(width: int, at_least: Fraction):
    def one(table: pa.Table) -> tuple[list, list, list]:
        reps, keep = np.unique(table["rep"].to_numpy(), return_index=True)
        if len(keep) < 2:
            return [], [], []
        table = table.take(pa.array(keep))
        values, first = shingles(table["text"].combine_chunks(), width)
        links = linked(values, first, at_least)
        if not links.any():
            return [], [], []
        # a pair counts in the first of the groups that it shares; in one of blocks, where the two blocks meet
        group = table["group"][0].as_py()
        lists = table["groups"].combine_chunks()
        ids = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(keep)), np.diff(lists.offsets.to_numpy()))
        before = ids < group
        own, other = table["own"].to_numpy(), table["other"].to_numpy()
        counted = links & ((own[:, None] == other[None, :]) & (other[:, None] == own[None, :]))
        if before.any():
            known, place = np.unique(ids[before], return_inverse=True)
            y = np.zeros((len(keep), len(known)), np.float32)
            y[owner[before], place] = 1
            counted &= ~(y @ y.T > 0)
        label = np.arange(len(keep))
        while True:
            least = np.minimum(label, np.where(links, label[None, :], len(keep)).min(axis=1))
            if (least == label).all():
                break
            label = least
        weight = counted @ table["copies"].to_numpy().astype(np.int64)
        some = np.flatnonzero((weight > 0) | (label != np.arange(len(keep))))
        return reps[some].tolist(), reps[label[some]].tolist(), weight[some].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, root, links = [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rep, root, links)], ["rep", "root", "links"])

        for table in groups(batches, "bucket"):
            for held, got in zip((rep, root, links), one(table), strict=True):
                held += got
            if len(rep) > 10_000:
                yield out()
                rep, root, links = [], [], []
        yield out()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, root): the least node of each connected component, for nodes that are not roots.

    Alternates large-star and small-star steps until nothing changes; only a count and a checksum reach the driver.
    """
    edges, seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), None
    while True:
        edges = kept(edges)
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _children(rows: DataFrame, level: int) -> DataFrame:
    """(rep, tokens, bucket) to the buckets below: of a bucket's sampled tokens, some BRANCHES chosen by its hash."""
    place = [F.pmod(F.xxhash64(F.lit(level), "bucket") + b * (1 + F.pmod(F.xxhash64("bucket"), F.lit(SAMPLES - 1))), F.lit(SAMPLES)).cast("int") for b in range(BRANCHES)]
    child = F.explode(F.array(*[F.xxhash64("bucket", p, F.get("tokens", p)) for p in place]))
    return rows.select("rep", child.alias("bucket")).distinct()


def buckets(reps: DataFrame, runs: int, limit: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """(rep, tokens) to (bucket, group, own, other, rep): buckets of at most twice `limit` sets, so that similar pairs share one.

    Every run splits all sets on BRANCHES sampled tokens. What falls together up to `limit` times is a bucket, and a group of its own;
    larger ones are split again, unless they are dense: those, and what is still too large at the last level, are
    groups dealt into blocks of about `limit`. Each pair of blocks is a bucket, so no pair is lost: a row of block `own` goes to
    those of `own` and every `other` block. Equal buckets are kept once.
    """
    first = [F.xxhash64(F.lit(r * BRANCHES + b), F.get("tokens", F.lit((r * BRANCHES + b) % SAMPLES))) for r in range(runs) for b in range(BRANCHES)]
    rows = reps.select("rep", F.explode(F.array(*first)).alias("bucket"))
    none = F.lit(0).cast("long")
    small, blocks = [], []
    for level in range(1, levels + 1):
        size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        sized = kept(rows.join(size, "bucket"))
        small.append(sized.where(F.col("m") <= limit).select("bucket", "rep"))
        large = sized.where(F.col("m") > limit)
        if large.isEmpty():
            break
        large = large.join(reps, "rep")
        some = [0, SAMPLES // 3, SAMPLES // 2, SAMPLES - 1]
        held = large.select("bucket", "m", F.posexplode(F.array(*[F.get("tokens", F.lit(i)) for i in some])).alias("i", "token"))
        held = held.groupBy("bucket", "m", "i", "token").count().groupBy("bucket").agg((F.sum(F.pow("count", 2)) / F.first(F.pow("m", 2)) / len(some)).alias("mean"))
        large = large.join(held.select("bucket", ((F.col("mean") >= DENSE) | F.lit(level == levels)).alias("dense")), "bucket")
        large = kept(large)
        n = F.ceil(F.col("m") / limit)
        blocks.append(large.where("dense").select("rep", F.col("bucket").alias("group"), F.pmod(F.xxhash64(F.lit("block"), "rep"), n).alias("own"), F.explode(F.sequence(none, n - 1)).alias("other")))
        rows = _children(large.where("not dense"), level)
    lists = reduce(DataFrame.unionByName, small).groupBy("bucket").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    lists = lists.groupBy(F.xxhash64("reps").alias("bucket")).agg(F.first("reps").alias("reps"))
    lists = lists.select("bucket", F.col("bucket").alias("group"), none.alias("own"), none.alias("other"), F.explode("reps").alias("rep"))
    met = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("bucket")
    return reduce(DataFrame.unionByName, [x.select(met, "group", "own", "other", "rep") for x in blocks], lists)


#: Stands for a null id, so that null ids come last.
LAST = (1 << 63) - 1
#: Rows of one class are joined with its first id in so many parts.
SALT = 32


def _classes(docs: DataFrame, width: int, similarity: float, recall: float, id_col: str, text: str, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, h, n, s0, s1) of all documents, h a hash of the text; their different sets (s0, s1, n, rep, id, h, copies, links, twins if some have any); (node, root) of linked sets.

    A set's number rep is its place in the order of least ids and signatures, so one id can have several sets. h and twins: hash and
    number of its rows with the least id and text. root: the least rep that links lead to. Only texts named by (id, h) are read again.
    """
    at_least = Fraction(str(similarity))
    q = 1.0
    for _ in range(LEVELS):
        q = 1 - (1 - similarity * q) ** BRANCHES
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    sets = kept(rows.mapInArrow(_sets(width), "doc_id long, h long, n long, s0 long, s1 long, tokens array<int>"))
    some = sets.where("n > 0").withColumn("id", F.coalesce("doc_id", F.lit(LAST)))
    reps = some.groupBy("s0", "s1", "n").agg(F.min(F.struct("id", "h")).alias("o"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens"))
    reps = reps.select("s0", "s1", "n", "o.*", "copies", "tokens").sort("id", "s0", "s1")
    reps = kept(reps.withColumn("rep", F.monotonically_increasing_id()))  # ascends with the order
    twins = some.groupBy("id", "h").agg(F.count(F.lit(1)).alias("twins")).where("twins > 1")
    names = reps.drop("tokens")
    if not twins.isEmpty():
        names = names.join(twins, ["id", "h"], "left")
    found = kept(buckets(reps.select("rep", "tokens"), runs, limit))
    asked = found.groupBy("rep").agg(F.collect_set("group").alias("groups"), F.collect_list(F.struct("bucket", "group", "own", "other")).alias("places"))
    asked = names.drop("s0", "s1", "n").join(asked, "rep")
    texts = _named(rows.withColumn("id", F.coalesce("doc_id", F.lit(LAST))).select("id", "h", "text"), asked)
    texts = texts.select("rep", "copies", "groups", "text", F.inline("places"))
    parts = max(12, math.ceil(found.count() / 2000))
    pairs = texts.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_verify(width, at_least), "rep long, root long, links long")
    pairs = kept(pairs.groupBy("rep", "root").agg(F.sum("links").alias("links")))
    roots = components(pairs.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = pairs.groupBy("rep").agg(F.sum("links").alias("links"))
    names = names.join(links, "rep", "left").withColumn("links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    return sets.drop("tokens"), names, roots


def _named(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows that asked names by id and h, one of each name: where it says that some have twins, those are sorted out."""
    if "twins" not in asked.columns:
        return rows.join(asked, ["id", "h"])
    single, again = asked.where("twins is null"), asked.where("twins is not null")
    return rows.join(single, ["id", "h"]).unionByName(rows.join(again, ["id", "h"]).dropDuplicates(["id", "h"]))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text: str = "text", limit: int = BUCKET) -> DataFrame:
    """Documents whose sets of `width`-word shingles have a Jaccard similarity of `similarity` or more.

    Documents with equal sets are one class from the start (a 128-bit sum of hashes). The classes are joined by
    chosen paths over sampled tokens of their sets: a pair at the threshold shares each token with that chance, so a run
    finds it with the chance q = 1 - (1 - similarity q)^BRANCHES at any depth, and the number of runs follows from `recall`.
    Within a bucket all pairs are compared exactly on the whole sets; a pair in many buckets counts in the first.

    Returns (doc_id, class_id, n_links), a row for each row: the least id of the group that links connect, and how many other rows are
    linked to this one, copies included. Words are runs without white space, unchanged; a text of fewer than `width` words
    is one shingle; texts without words, or null, are linked to none and stand alone. Rows are compared by their texts: those with null ids
    or one id for different texts like all others, and rows equal in both are copies. A class of null ids only has a null
    class_id (so has the id 2^63 - 1, which stands for null). An empty table gives no rows; other columns are ignored.
    """
    sets, names, roots = _classes(docs, width, similarity, recall, id_col, text, limit)
    # a class can hold a third of all sets: its rows are dealt into SALT parts to be joined with its first id
    heads = roots.select("root").distinct().join(names.select(F.col("rep").alias("root"), F.col("id").alias("head")), "root")
    heads = heads.select("root", "head", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    first = roots.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALT))).join(heads, ["root", "salt"]).select(F.col("node").alias("rep"), "head")
    known = names.join(first, "rep", "left")
    known = known.select("s0", "s1", "n", F.nullif(F.coalesce("head", "id"), F.lit(LAST)).alias("class_id"), F.col("links").alias("n_links"))
    alone = sets.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return sets.where("n > 0").join(known, ["s0", "s1", "n"]).select("doc_id", "class_id", "n_links").unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, limit: int = BUCKET) -> DataFrame:
    """One row of each group of near duplicates (see near_duplicates), the first by id, null ids last; the same columns.

    Of rows that share the first id, the one whose text has the least hash stays, and of rows equal in both one. Texts without
    words, and null, are all kept. An empty table gives no rows.
    """
    _, names, roots = _classes(docs, width, similarity, recall, id_col, text, limit)
    first = names.join(roots, F.col("rep") == F.col("node"), "left_anti").drop("s0", "s1", "n", "rep", "copies", "links")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("some"))
    return _named(rows.where("some").drop("some"), first).select("row.*").unionByName(rows.where("not some").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[p:p + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) p from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 5 * k >= 4 * (a.n + b.n - k)),
r as (select doc_id node, doc_id root from d union select e.y, r.root from r join e on e.x = r.node),
m as (select node, min(root) class_id from r group by node),
l as (select x, count(*) n from e group by x)
select doc_id, class_id, coalesce(l.n, 0)::bigint n_links from d join m on m.node = doc_id left join l on l.x = doc_id
"""
