"""The sidecar table of a time-frame file: a line of text for each part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns and their widths.
WIDTHS = {
    "TF_ID": 10, "TF_OFFSET": 10, "TF_SIZE": 9, "ORIGIN": 6, "DESC": 9, "SUBSPEC": 10, "DATA_IDX": 8, "HDR_OFF": 10, "HDR_SIZE": 8, "DATA_OFF": 10, "DATA_SIZE": 9,
    "RDH_MEM_SIZE": 12, "RDH_STOP_BIT": 12, "RDH_FEE_ID": 10, "RDH_ORBIT": 12, "RDH_BC": 10, "RDH_TRG": 10,
}
HEX = {"SUBSPEC", "RDH_TRG"}
RAW_ONLY = [c for c in WIDTHS if c.startswith("RDH_")]


def _padded(x: Column, width: int) -> Column:
    return F.rpad(x, F.greatest(F.length(x), F.lit(width)), F.lit(" "))


def lines(parts: DataFrame) -> DataFrame:
    """(line) from a table with these columns, in lower case; columns of headers only for raw data."""
    cells = []
    for name, width in WIDTHS.items():
        value = F.col(name.lower())
        text = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(value), 8, "0"))) if name in HEX else value.cast("string")
        cell = _padded(F.coalesce(text, F.lit("")), width)
        cells.append(F.when(F.col("desc") == "RAWDATA", cell).otherwise("") if name in RAW_ONLY else cell)
    return parts.select("tf_id", "data_idx", F.rtrim(F.concat_ws(" ", *cells)).alias("line"))


def title() -> str:
    return " ".join(n.ljust(w) for n, w in WIDTHS.items())
