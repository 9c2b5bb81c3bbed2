"""Scalar expressions on ids, sizes, sub-specifications, names and parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of detectors, as in their data headers.
DETECTORS = ("CPV", "CTP", "EMC", "FT0", "FV0", "FDD", "HMP", "ITS", "MCH", "MFT", "MID", "PHS", "TOF", "TPC", "TRD", "ZDC", "TST")
NO_DETECTOR, ANY_DETECTOR = "NIL", "ANY"
U32 = 0xFFFFFFFF


def align_up(n: Column, to: int) -> Column:
    """n rounded up to a multiple of `to`."""
    return n + F.pmod(-n, F.lit(to))


def subspec(cru: Column, link: Column, endpoint: Column) -> Column:
    """CRU in the upper half; link + 1 in the low byte, or the next one for other end points than 0. Kept to 32 bits."""
    wide = F.shiftleft((link + 1).cast("bigint"), 8)
    low = F.when(endpoint == 0, (link + 1).cast("bigint")).otherwise(wide)
    return F.shiftleft(cru.cast("bigint"), 16).bitwiseOR(low).bitwiseAND(F.lit(U32))


def subspec_parts(s: Column) -> dict[str, Column]:
    """CRU, link and end point of a sub-specification."""
    low = s.bitwiseAND(F.lit(0xFF))
    return {"cru": F.shiftright(s, 16), "link": F.when(low > 0, low).otherwise(F.shiftright(s, 8).bitwiseAND(F.lit(0xFF))) - 1, "ep": F.when(low > 0, 0).otherwise(1)}


def mask_fee(fee: Column, mask: int) -> Column:
    return fee.cast("bigint").bitwiseAND(F.lit(mask))


def origin_of_option(option: Column) -> Column:
    """Detector option to code, in any case; empty for none; unknown for any."""
    up = F.upper(F.trim(option))
    return F.when(up.isin(*DETECTORS, NO_DETECTOR), up).otherwise(ANY_DETECTOR)


def equipment(origin: Column, description: Column, sub: Column) -> Column:
    """Key of a data source; struct fields are in the order of comparison."""
    return F.struct(description.alias("description"), origin.alias("origin"), sub.alias("subspec"))


def equipment_text(e: Column) -> Column:
    return F.concat_ws("/", e["origin"], e["description"], e["subspec"].cast("string"))


def file_name(pattern: str, name: Column, run: Column, index: Column, ts: Column, host: str = "host") -> Column:
    """%n name, %r run, %i index (eight digits), %D date, %T time, %h host."""
    parts = (("%n", name), ("%r", run.cast("string")), ("%i", F.lpad(index.cast("string"), 8, "0")), ("%D", F.date_format(ts, "yyyyMMdd")), ("%T", F.date_format(ts, "HHmmss")), ("%h", F.lit(host)))
    out = F.lit(pattern)
    for mark, value in parts:
        out = F.replace(out, F.lit(mark), value)
    return out


def next_in_sequence(name: Column) -> Column:
    """A name with its last run of digits counted up, its width kept; "0" without digits."""
    digits = F.regexp_extract(name, r"(\d+)(?=\D*$)", 1)
    up = (F.when(digits != "", digits).cast("decimal(20,0)") + 1).cast("string")
    wide = F.lpad(up, F.greatest(F.length(digits), F.length(up)), F.lit("0"))
    return F.when(digits != "", F.concat(F.regexp_extract(name, r"^(.*?)\d+\D*$", 1), wide, F.regexp_extract(name, r"(\D*)$", 1))).when(name.isNotNull(), "0")


def sequence_number(name: Column) -> Column:
    digits = F.regexp_extract(name, r"(\d+)(?=\D*$)", 1)
    return F.when(digits != "", digits.cast("decimal(20,0)"))


def run_number(text: Column) -> Column:
    """Trimmed, without leading zeros; -1 unless a number."""
    bare = F.trim(text)
    return F.coalesce(F.when(bare.rlike(r"^\d{1,18}$"), bare.cast("bigint")), F.lit(-1).cast("bigint"))


def period_of(ts: Column) -> Column:
    """The default period: the month's short name."""
    return F.upper(F.date_format(ts, "MMM"))


def round_up(micros: Column, step: int) -> Column:
    return (F.ceil(micros / step) * step).cast("bigint")


def bool_param(text: Column, default: bool) -> Column:
    return F.when(text.isNull(), F.lit(default)).otherwise(text.isin("true", "TRUE", "True", "1"))


def uint_param(text: Column, default: int) -> Column:
    """A whole number without sign; anything else is the default."""
    return F.coalesce(F.when(F.trim(text).rlike(r"^\d{1,18}$"), F.trim(text).cast("bigint")), F.lit(default).cast("bigint"))


def id_list(text: Column) -> Column:
    """Ids between ; , and white space, sorted and unique; null if one is repeated or none is left."""
    ids = F.filter(F.split(text, r"[;,\s]+"), lambda x: x != "")
    return F.when((F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)), F.array_sort(ids))


def json_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def size_in_file(data: Column, n_equipments: Column, n_parts: Column, header: int = 96, meta: int = 24, element: int = 48) -> Column:
    """Meta and index blocks, each after a data header, then a header before every part."""
    return header + meta + header + n_equipments * element + data + n_parts * header


def estimated_size(size: Column) -> Column:
    """A fifth more than announced, in whole numbers."""
    return F.floor(size * 120 / 100).cast("bigint")


def chance(key: Column, percent: float) -> Column:
    """A repeatable draw: whether an arithmetic hash of the key falls in the first `percent` of its range."""
    return F.pmod(key * 7919 + 104729, F.lit(10007)) < F.lit(percent * 10007 / 100)


def bits_of(values: Column) -> Column:
    """Bit field of 1-based numbers: a sorted set; 0 is no bit."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x > 0)))


def bits_not(bits: Column, size: int) -> Column:
    return F.array_except(F.sequence(F.lit(1), F.lit(size)), bits)


def first_bit(bits: Column) -> Column:
    return F.coalesce(F.array_min(bits), F.lit(0))
