"""URL filtering by pattern rules, indexed by their rarest literal token."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict): rules on hosts and their subdomains; the longest that fits wins.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Lower-case patterns of addresses to block.
PATTERNS = (
    r"[/.]casino-win\.",
    r"[/.]cheap-pills\.",
    r"[/.]free-bets\.",
    r"[/.]ads-track\.",
    r"[/.]doubleclick\.",
    r"/adserver/",
    r"/popunder/",
    r"[?&]affid=",
    r"/wp-login\.php",
    r"\.torrent$",
)
#: Rules up to this size are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Letters and digits of a lower-case URL.
TOKEN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _items(pattern: str) -> list[str] | None:
    """The pattern's top level, in Java's grammar: letters and digits as such, "|" for what borders a token, "" for all else. None if that can't be told."""
    out, i, n = [], 0, len(pattern)

    def after_class(i: int) -> tuple[int, bool]:
        """Where the class that begins at i ends, and whether it has plain marks only."""
        depth, plain, start = 0, True, i
        while i < n:
            c = pattern[i]
            if c == "\\":
                plain &= i + 1 < n and not pattern[i + 1].isalnum()
                i += 2
                continue
            if c == "[":
                depth += 1
                plain &= depth == 1
            elif c == "]" and i > start + 1:
                depth -= 1
                if not depth:
                    return i + 1, plain
            elif c in "^&-" or c.isalnum() or ord(c) > 126:
                plain = False
            i += 1
        return n, False

    while i < n:
        c = pattern[i]
        if c == "|":
            return None  # a choice of whole patterns
        if c == "\\":
            x = pattern[i + 1 : i + 2]
            if x in ("Q", "E", ""):
                return None
            out.append("|" if x in "bAzZ" or not x.isalnum() else "")
            i += 2
            if x in "pPxuNkco0123456789":  # followed by a name or a number: nothing more is told of this pattern
                return None
        elif c == "[":
            i, plain = after_class(i)
            out.append("|" if plain else "")
        elif c == "(":
            if pattern.startswith("(?", i) and "x" in pattern[i + 2 : i + 8].split(":")[0].split(")")[0]:
                return None  # white space may be no text
            depth, out = 0, [*out, ""]
            while i < n:
                if pattern[i] == "\\":
                    if pattern[i + 1 : i + 2] == "Q":
                        return None
                    i += 1
                elif pattern[i] == "[":
                    i = after_class(i)[0] - 1
                else:
                    depth += (pattern[i] == "(") - (pattern[i] == ")")
                i += 1
                if not depth:
                    break
        elif c in "*+?{":
            if out:
                out[-1] = ""
            i = pattern.find("}", i) + 1 if c == "{" else i + 1
            if not i:
                return None
        else:
            out.append(c if c in TOKEN else "|" if c in "^$" or c < "\x7f" and not c.isalnum() and c != "." else "")
            i += 1
    return out


def literal_tokens(pattern: str) -> list[str]:
    """The tokens (runs of a-z and 0-9) that every match of the pattern must contain whole.

    A run counts only if what stands on either side can be no letter or digit: other literal characters,
    classes of such, word borders, and the ends of the text. So a match's token is a token of the URL too. Groups, quantified items and
    what else isn't plain end a run and border none; of a pattern with a choice at its top level nothing is told.
    """
    out, run, closed = [], "", False
    for item in [*(_items(pattern) or []), ""]:
        if item in TOKEN:
            run += item
            continue
        if run and closed and item == "|":
            out.append(run)
        run, closed = "", item == "|"
    return list(dict.fromkeys(out))


def tokens_of(url: Column) -> Column:
    """Distinct runs of letters and digits of a lower-case URL."""
    return F.array_distinct(F.regexp_extract_all(url, F.lit("[a-z0-9]+"), 0))


def parts_of(url: Column) -> tuple[Column, Column]:
    """(host, path): empty both without '://'; the host's A-Z lowered, up to / ? # or the end; the path from there up to ? or #."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower(F.regexp_extract(url, whole, 1)), F.regexp_extract(url, whole, 2)


def lower(x: Column) -> Column:
    """A-Z only."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matching_rules(urls: DataFrame, patterns: Sequence[str], url: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(url, rules array<int>): distinct URLs that match patterns, and which.

    Each rule is filed under the one of its literal tokens that fewest URLs have. A URL's tokens fetch its candidate
    rules, and only those run their regular expressions. Rules without a literal token run on every URL, all in one pass.
    Patterns are Java's, matched against the URL with A-Z lowered. Null URLs match nothing; repeated URLs and repeated patterns
    are judged alike, and ties for the rarest token go to the first in order. No patterns, or an empty table: no rows.
    """
    spark = urls.sparkSession
    seen = urls.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct().withColumn("low", lower(F.col("url")))
    rules = [(i, p, literal_tokens(p)) for i, p in enumerate(patterns)]
    small = sum(len(p) for p in patterns) <= broadcast_bytes
    hint = F.broadcast if small else (lambda x: x)
    found = None
    filed = [(i, p, t) for i, p, ts in rules for t in ts]
    if filed:
        listed = spark.createDataFrame(filed, "rule int, pattern string, token string")
        worded = seen.select("url", "low", F.explode(tokens_of(F.col("low"))).alias("token"))
        often = worded.join(hint(listed.select("token").distinct()), "token", "left_semi").groupBy("token").count()
        index = listed.join(often, "token", "left").groupBy("rule", "pattern").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
        found = worded.join(hint(index), "token").where(F.expr("low rlike pattern")).select("url", "rule")
    for some in batched([(i, p) for i, p, ts in rules if not ts], 100):
        hits = F.array_compact(F.array(*[F.when(F.col("low").rlike(p), F.lit(i)) for i, p in some]))
        more = seen.select("url", F.explode(hits).alias("rule"))
        found = more if found is None else found.unionByName(more)
    if found is None:
        return seen.where("false").select("url", F.array().cast("array<int>").alias("rules"))
    return found.groupBy("url").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def filter_urls(pages: DataFrame, patterns: Sequence[str] = PATTERNS, host_rules: Sequence[tuple[str, str, str]] = HOST_RULES, url: str = "url") -> DataFrame:
    """Judges every row's URL: by the longest host rule that fits, else blocked if any pattern matches, else allowed.

    A host rule fits its host and all subdomains if the path begins with the rule's. The host rules are a short
    stated list. Returns (row struct<all columns>, host, path, rule, patterns array<int>, verdict). A null URL, or one
    without '://', has an empty host and path, and fits no host rule. Equal URLs are judged once, so repeated
    rows cost no more; rows keep their number. An empty table gives no rows.
    """
    x = pages.select(F.struct("*").alias("row"), F.col(url).alias("url"))
    host, path = parts_of(F.coalesce(F.col("url"), F.lit("")))
    x = x.withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(host_rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    x = x.withColumns({"rule": rule, "by_rule": verdict})
    x = x.join(matching_rules(pages, patterns, url), "url", "left")
    by_pattern = F.when(F.col("rules").isNotNull(), "block").otherwise("allow")
    return x.select("row", "host", "path", "rule", F.coalesce("rules", F.array().cast("array<int>")).alias("patterns"), F.coalesce("by_rule", by_pattern).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("row.page_id", "host", "path", "rule", "verdict")


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{{{i}}}'" for i, (h, p, _) in sorted(enumerate(HOST_RULES), key=lambda r: -len(r[1][0] + r[1][1])))
SQL = f"""
with u as (select page_id, coalesce(url, '') url, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages),
h as (select page_id, {_LOW.format("url")} low, {_LOW.format("regexp_extract(rest, '(?s)^[^/?#]*')")} host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) path from u)
select page_id, host, path, case {_FITS.format(*[h + p for h, p, _ in HOST_RULES])} end as rule,
  case {_FITS.format(*[v for _, _, v in HOST_RULES])} when {" or ".join(f"regexp_matches(low, '{p}')" for p in PATTERNS)} then 'block' else 'allow' end verdict from h
"""
