"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.native import SPACE, numbered, tagged, words_of
from framewright.llm.store import written

#: Weights of the sources in code point order, again and again.
WEIGHTS = (5, 2, 1)
#: A source is passed over so often at most.
MOST_PASSES = 3
#: Words of a block, at every size of the input. In SQL blocks grow beyond SLOTS slots, so it holds up to SLOTS * (LEAST_BLOCK + 1) words.
SLOTS, LEAST_BLOCK = 1 << 20, 16
#: 2**31 divided by the golden ratio, odd: multiples of it modulo 2**31 are evenly spread.
GOLDEN, GOLDEN_BITS = 1327217885, 31
#: Buckets of the hash by which a source is shuffled: so many rows each, but no fewer and no more buckets than this.
ROWS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 5_000, 1024, 65_536
#: Slots that are ranked in one task.
SLOT_RANGE = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(key, source_size) to (key, source_size, target, total): shares of the total by weight, filled up to `most` times a source's size.

    What a full source leaves is shared among the others by weight until none is above its limit: sources in order of
    limit per weight are full as long as that level, reached by all, takes no more than the total.
    """
    ordered = Window.orderBy("key")
    x = sizes.withColumn("place", (F.row_number().over(ordered) - 1) % len(weights))
    x = x.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("place"))).drop("place")
    x = x.withColumns({"limit": F.col("source_size") * most, "total": F.sum("source_size").over(Window.partitionBy())})
    level = Window.orderBy(F.col("limit") / F.col("weight"), "key")
    x = x.withColumn("before", F.sum("limit").over(level.rowsBetween(Window.unboundedPreceding, -1))).withColumn("from", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("full", F.col("limit") * F.col("from") + F.coalesce("before", F.lit(0)) * F.col("weight") <= F.col("total") * F.col("weight"))
    every = Window.partitionBy()
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return x.select("key", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(rest * F.col("weight") / open_weight).alias("target"), "total")


def schedule(spark: SparkSession, shares: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, key): each slot's point of the golden-ratio sequence falls into one source's share."""
    n = -(-total // block)
    edge = Window.orderBy("key")
    upto = F.sum("target").over(edge) / F.col("total")
    cells = 1024
    x = shares.where("target > 0").select("key", upto.alias("hi"), F.row_number().over(Window.orderBy(F.desc("key"))).alias("back"))
    x = x.select("key", F.coalesce(F.lag("hi").over(edge), F.lit(0.0)).alias("lo"), F.when(F.col("back") == 1, 1.0).otherwise(F.col("hi")).alias("hi"))
    x = x.select("*", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    point = F.expr(f"((id % {1 << GOLDEN_BITS}) * {GOLDEN} % {1 << GOLDEN_BITS}) / {float(1 << GOLDEN_BITS)}D")
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.floor(F.col("x") * cells))
    return slots.join(x, "cell").where("lo <= x and x < hi").select("slot", "key")


def ranked(slots: DataFrame) -> DataFrame:
    """(slot, key) with each slot's rank within its source: counted by ranges of slots, so no source is in one task."""
    x = slots.withColumn("range", F.floor(F.col("slot") / SLOT_RANGE))
    held = x.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.join(held.select("key", "range", base.alias("base")), ["key", "range"])
    return x.select("slot", "key", (F.col("base") + F.row_number().over(Window.partitionBy("key", "range").orderBy("slot")) - 1).alias("rank"))


def _placed(docs: DataFrame, seed: str, id_col: str, source: str, text: str, rid: str | None = None):
    """Rows with key, size and their first word's place in the shuffled source; the blocks that each slot of the schedule takes.

    Each text is split into words once: ids, sizes and sources (and numbers of rows, rid) are written to the shared folder, texts are not.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    own = [F.col(rid)] if rid else []
    rows = docs.select(*own, F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("~")).alias("key"), F.crc32(t).alias("crc"), F.octet_length(t).alias("bytes"), F.size(words_of(t)).cast("long").alias("size"))
    rows = written(rows)
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, rows.count() // ROWS_A_BUCKET))
    rows = numbered(rows, ("doc_id", "key", "crc", "bytes"))
    plain = F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")))
    again = F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string"), "crc", "bytes", "copy"))
    rows = rows.withColumn("h", F.when(F.col("doc_id").isNotNull() & (F.col("copy") == 0), plain).otherwise(again))
    rows = rows.withColumn("bucket", F.expr(f"cast(conv(substr(h, 1, 4), 16, 10) as int) * {buckets} div 65536"))
    order = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size", "crc", "copy")
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = written(rows.withColumn("inside", inside).drop("h", "crc", "bytes", "copy"))
    held = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    shares = targets(held.groupBy("key").agg(F.sum("words").alias("source_size")))
    total = (held.agg(F.sum("words")).first()[0]) or 0
    block = LEAST_BLOCK
    slots = schedule(spark, shares, total, block)
    taken = slots.groupBy("key").agg((F.count(F.lit(1)) * block).alias("scheduled"))
    base = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("key", "bucket", base.alias("base")).join(shares.join(taken, "key", "left"), "key")
    offsets = offsets.select("key", "bucket", "base", "source_size", "target", F.coalesce("scheduled", F.lit(0)).alias("scheduled"))
    rows = rows.join(offsets, ["key", "bucket"]).withColumn("first", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")

    # the words of a document at each pass, cut where blocks end; a block is taken by the slot of its rank, if there is one
    passes = F.transform(F.array(*map(F.lit, range(MOST_PASSES))), lambda p: F.struct(p.alias("pass"), (p * F.col("source_size") + F.col("first")).alias("at")))
    x = rows.where("size > 0").select("key", "doc_id", "first", "size", "scheduled", F.inline(passes)).where("at < scheduled")
    x = x.select("*", F.explode(F.expr(f"sequence(at div {block}, (least(at + size, scheduled) - 1) div {block})")).alias("rank"))
    lo, hi = F.greatest("at", F.col("rank") * block), F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * block)
    blocks = x.join(ranked(slots), ["key", "rank"]).select("key", "first", "pass", "slot", "doc_id", (lo - F.col("at")).alias("first_word"), (hi - lo).alias("n_words"))
    return rows, blocks


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", source: str = "source", text: str = "text", carry: bool = True) -> DataFrame:
    """How many words of each document the mix takes, passes counted.

    Sources share the total of all words by weight (see targets; a row for each source, which are sorted in one task). Slot i of the
    schedule falls to the source in whose share the i-th golden-ratio point lies. A source's documents are shuffled by a seeded hash into
    one stream, cut into blocks of equal words; its j-th slot takes block j, and the stream starts again at its end, three times
    at most. What is taken of a document are the words that its blocks have in common with it, from the join of ranked slots and blocks.
    Places and ranks are sums over buckets of the hash and ranges of slots, so that no source is ever in one task. A block has
    LEAST_BLOCK words at every size, so what a source takes is some blocks from its target (ten in a replay of 5 G words), however large the others are;
    beyond 2**GOLDEN_BITS slots (34 G words) points come again, and a source of less than that share can get none.

    Returns (row struct<all columns> if carry, doc_id, size, source_size, target, taken, pieces array<struct<pass, words>>). Null text has
    size 0 and takes nothing; null sources form one source, the last. Null ids are shuffled by text, and rows that agree in id, source and text by
    their number, so copies lie apart; ties of the hash are ordered by id, size, text and number. Runs agree. An empty table gives no rows.
    """
    if carry:
        base = tagged(docs)
        small = base.select("rid", *[F.col("row")[c].alias(f"_{i}") for i, c in enumerate((id_col, source, text))])
        rows, blocks = _placed(small, seed, "_0", "_1", "_2", "rid")
    else:
        rows, blocks = _placed(docs, seed, id_col, source, text)
    of = [F.sum(F.when(F.col("pass") == p, F.col("n_words"))).alias(f"p{p}") for p in range(MOST_PASSES)]
    taken = blocks.groupBy("key", "first").agg(F.sum("n_words").alias("taken"), *of).withColumn("some", F.lit(True))
    x = rows.withColumn("some", F.col("size") > 0).join(taken, ["key", "first", "some"], "left")  # places of rows with words are all different
    pieces = F.filter(F.array(*[F.struct(F.lit(p).alias("pass"), F.col(f"p{p}").alias("words")) for p in range(MOST_PASSES)]), lambda s: s["words"].isNotNull())
    x = x.select(*(["rid"] if carry else []), "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), pieces.alias("pieces"))
    return base.join(x, "rid").drop("rid") if carry else x


def mixed_blocks(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The schedule joined with the shuffled blocks: (slot, doc_id, first_word, n_words), the order in which to write the mix.

    Nulls, repeated rows, ties and empty tables are as in mix; a document without words has no row.
    """
    _, blocks = _placed(docs, seed, id_col, source, text)
    return blocks.select("slot", "doc_id", "first_word", "n_words")


def mixed_documents(docs: DataFrame, seed: str = "mix", text: str = "text", n_chars: str | None = "n_chars", **names: str) -> DataFrame:
    """The mix as rows of docs: a document for each pass that takes it, cut to its first words, line breaks kept, where the mix ends within it.

    Nulls, repeated rows, ties and empty tables are as in mix; texts without words have no row. Columns keep their names and types.
    """
    x = mix(docs, seed, text=text, **names).select("row", "size", F.explode("pieces").alias("piece"))
    own = F.split(F.regexp_replace(F.col("row")[text], f"^{SPACE}+", ""), f"(?<={SPACE})(?!{SPACE})")  # words, each with the white space after it
    cut = F.regexp_replace(F.array_join(F.slice(own, F.lit(1), F.col("piece.words").cast("int")), ""), f"{SPACE}+$", "")
    x = x.withColumn("t", F.when(F.col("piece.words") == F.col("size"), F.col("row")[text]).otherwise(cut))
    put = {text: F.col("t")} | ({n_chars: F.when(F.col("piece.words") == F.col("size"), F.col("row")[n_chars]).otherwise(F.char_length("t")).cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return x.select(*[put.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), carry=False).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
with d as (select doc_id, coalesce('=' || source, '~') k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size, md5('mix' || coalesce(doc_id::varchar, '')) h from documents),
s as (select k, sum(size)::bigint l from d group by k),
w as (select k, l, [5, 2, 1][((row_number() over (order by k)) - 1) % 3 + 1] w, sum(l) over () t from s),
v as (select *, coalesce(sum(3 * l) over (order by 3.0 * l / w, k rows between unbounded preceding and 1 preceding), 0) b, sum(w) over (order by 3.0 * l / w, k rows between current row and unbounded following) f from w),
u as (select *, 3 * l * f + b * w <= t * w full_ from v),
g as (select k, l, t, case when full_ then (3 * l)::double else (t - coalesce(sum(3 * l) filter (full_) over (), 0))::double * w / (sum(w) filter (not full_) over ()) end target from u),
e as (select k, sum(target) over (order by k) / t hi, row_number() over (order by k desc) back from g where target > 0),
r as (select k, coalesce(lag(hi) over (order by k), 0) lo, case when back = 1 then 1.0 else hi end hi from e),
n as (select coalesce(sum(l), 0)::bigint t, greatest({LEAST_BLOCK}, coalesce(sum(l), 0)::bigint // {SLOTS}) b from s),
i as (select unnest(range((t + b - 1) // b)) i from n),
c as (select k, count(*) n from i join r on r.lo <= (i * {GOLDEN} % {1 << 31}) / {float(1 << 31)} and (i * {GOLDEN} % {1 << 31}) / {float(1 << 31)} < r.hi group by k),
p as (select doc_id, d.k, size, l, target, least(coalesce(c.n, 0) * n.b, 3 * l) cov, coalesce(sum(size) over (partition by d.k order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) a
  from d join g on g.k = d.k left join c on c.k = d.k, n)
select doc_id, size, l source_size, target, (greatest(0, least(size, cov - a)) + greatest(0, least(size, cov - a - l)) + greatest(0, least(size, cov - a - 2 * l)))::bigint taken from p
"""
