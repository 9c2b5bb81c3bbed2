"""Line-first quality rules, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.native import NO_SPACE, SPACE, computed, word_chars, words_of

SYMBOLS = "[#*$%&|<>]"
#: Parts of lines that belong to a page, not to its text.
BOILERPLATE = r"(?i)\b(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|click here|sign in|log in|subscribe now|copyright \(c\)|lorem ipsum)\b"
#: Marks that set entries of a menu apart, and marks and shouts instead of text.
MENU, MARKS = "[|>»•·]", "[#*$%&|<>!]"
THREE_MARKS = f"{MENU}(?:{MENU.replace('[', '[^')}*+{MENU}){{2}}"
#: Up to three words.
FRAGMENT = rf"^{SPACE}*(?:{NO_SPACE}+{SPACE}+){{0,2}}{NO_SPACE}+{SPACE}*$"
#: How a sentence ends, closing quotes and brackets allowed.
SENTENCE_END = r"""[.!?…:;。！？]["'”’»)\]]*[\x20\x09-\x0D]*$"""


def _doubled(hashes: str, width: int) -> Column:
    """From a hash of `width` words from each on to one of twice as many; at the end, where there are fewer, of what there is."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + width)))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' rows as a column `row`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines."""
    t = F.col("t")
    x = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    x = x.select("row", "t", F.transform(words_of(t), lambda w: F.xxhash64(w)).alias("w"), F.split(t, "\n").alias("lines"))
    x = x.select("row", "t", "lines", F.size("w").cast("long").alias("n_words"), _doubled("w", 1).alias("h"), F.filter("lines", lambda s: s.rlike(NO_SPACE)).alias("full"))
    # each step is a column of its own, so that it is computed once; where no four words occur twice, no eight do, and windows are sorted only where one does
    x = x.withColumn("h", _doubled("h", 2))
    some = (F.col("n_words") > 8) & (F.size(F.array_distinct("h")) < F.size("h"))
    x = x.withColumn("h", F.when(some, F.slice(_doubled("h", 4), F.lit(1), F.col("n_words").cast("int") - 7)))
    twice = F.size(F.array_distinct("h")) < F.size("h")
    x = x.select("row", "t", "lines", "n_words", "full", F.when(twice, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("pairs"))
    same = F.transform("pairs", lambda p, j: F.when((p["h"] == F.get("pairs", j - 1)["h"]) | (p["h"] == F.get("pairs", j + 1)["h"]), p["i"]))
    x = x.select("row", "t", "lines", "n_words", "full", F.sort_array(F.filter(same, lambda i: i.isNotNull())).alias("at"))
    last = F.size("at") - 1
    repeats = F.aggregate(F.transform("at", lambda p, j: F.when(j < last, F.least(F.lit(8), F.get(F.col("at"), j + 1) - p)).otherwise(8)), F.lit(0), lambda a, b: a + b)
    return x.select(
        "row", "lines", "n_words", word_chars(t).cast("long").alias("word_chars"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"), F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def bad_line(line: Column) -> Column:
    """Whether a line fails a rule.

    Punctuation: up to three words that end no sentence, or marks and shouts for a tenth of its characters.
    Navigation: three marks between entries and no sentence's end. Boilerplate: a phrase of pages, in up to 300
    characters. A line without words passes, so that paragraphs stay apart.
    """
    fragment = line.rlike(FRAGMENT) & ~line.rlike(SENTENCE_END)
    menu = line.rlike(THREE_MARKS) & ~line.rlike(SENTENCE_END)
    boilerplate = (F.char_length(line) <= 300) & line.rlike(BOILERPLATE)
    return fragment | (line.rlike(MARKS) & (10 * F.regexp_count(line, F.lit(MARKS)) >= word_chars(line))) | menu | boilerplate


def quality_rules(docs: DataFrame, text: str = "text", least_words: int = 20, most_repeats: int = 30, least_kept: int = 50) -> DataFrame:
    """Judges every line, drops those that fail, and rejects documents that lose too much of their text.

    A document is rejected outright (base_failed) with fewer than least_words words, or if over most_repeats % of
    its words lie in 8-word windows found twice or more. Otherwise it is kept if the lines that pass hold at least
    least_kept % of its word characters, all equal lines counted once for this.

    Returns (row struct<all columns>, the measures, base_failed, kept, clean_text). Null text counts as empty and is
    rejected, as are texts of white space. Rows are independent: no shuffle; equal rows give equal results.
    Clashing column names stay inside `row`. An empty table gives no rows.
    """
    x = measures(docs, text).withColumn("good", F.filter("lines", lambda s: ~bad_line(s)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    held = word_chars(F.array_join(F.array_distinct("good"), "\n"))
    x = x.withColumns({"base_failed": failed, "held": held})
    kept = ~F.col("base_failed") & (100 * F.col("held") >= least_kept * F.col("word_chars"))
    return computed(x.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.array_join("good", "\n").alias("clean_text")))


def clean(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents kept, with the lines that passed as their text (see quality_rules); the same columns."""
    out = quality_rules(docs, text).where("kept")
    put = {text: F.col("clean_text")} | ({n_chars: F.char_length("clean_text").cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return out.select(*[(put.get(c, F.col("row")[c])).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, string_split(coalesce(text, ''), chr(10)) ls from documents),
f as (select *, list_filter(ls, lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) fl from d),
k as (select doc_id, w, unnest(range(1, len(w) - 6)) p from d where len(w) >= 8),
s as (select doc_id, p, count(*) over (partition by doc_id, array_to_string(w[p:p + 7], ' ')) c from k),
r as (select doc_id, count(distinct q)::bigint n from (select doc_id, unnest(range(p, p + 8)) q from s where c > 1) group by doc_id),
l as (select doc_id, l, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) ch, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) n, len(regexp_extract_all(l, '[#*$%&|<>!]')) marks,
  regexp_matches(l, '[.!?…:;。！？]["''”’»)\]]*[\x20\x09-\x0D]*$') ends from (select doc_id, unnest(ls) l from d)),
g as (select doc_id, l, any_value(ch) ch from l
  where not (n between 1 and 3 and not ends or marks > 0 and 10 * marks >= ch or len(regexp_extract_all(l, '[|>»•·]')) >= 3 and not ends
    or length(l) <= 300 and regexp_matches(l, '(?i)\b(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|click here|sign in|log in|subscribe now|copyright \(c\)|lorem ipsum)\b'))
  group by doc_id, l),
h as (select doc_id, sum(ch)::bigint held from g group by doc_id),
x as (select f.doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
  (len(fl) - len(list_distinct(fl)))::bigint n_dup_lines, coalesce(r.n, 0) n_repeat_words, coalesce(held, 0) held
  from f left join r using (doc_id) left join h using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * held >= 50 * word_chars kept from x
"""
