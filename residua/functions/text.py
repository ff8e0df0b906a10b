"""Timestamps, durations, safe names, nested lookups and file-name keys as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import _c

# Device names a file name may not have, and the name for an empty result.
RESERVED_STEMS = ["CON", "PRN", "AUX", "NUL"] + [f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]


def parse_timestamp_text(col) -> Column:
    """Seconds, ``MM:SS`` or ``HH:MM:SS`` to seconds; invalid text is null."""
    parts = F.split(F.trim(_c(col)), ":")
    part = lambda i: F.trim(F.try_element_at(parts, F.lit(i)))
    sec = lambda i: part(i).try_cast("double")
    whole = lambda i: F.when(part(i).rlike(r"^[+-]?\d+$"), part(i).try_cast("bigint"))
    finite = lambda c: (~F.isnan(c)) & (F.abs(c) < float("inf"))
    below60 = lambda c: (c >= 0) & (c < 60)
    return (
        F.when((F.size(parts) == 1) & finite(sec(1)) & (sec(1) >= 0), sec(1))
        .when((F.size(parts) == 2) & (whole(1) >= 0) & below60(sec(2)), whole(1) * 60 + sec(2))
        .when(
            (F.size(parts) == 3) & (whole(1) >= 0) & below60(whole(2)) & below60(sec(3)),
            whole(1) * 3600 + whole(2) * 60 + sec(3),
        )
    )


def format_timestamp(seconds) -> Column:
    """``MM:SS.ss`` or ``HH:MM:SS.ss``; negative input counts as zero."""
    sec = F.greatest(F.lit(0.0), _c(seconds).cast("double"))
    hours = F.floor(sec / 3600)
    minutes = F.floor((sec - hours * 3600) / 60)
    rest = sec - hours * 3600 - minutes * 60
    tail = F.format_string("%02d:%05.2f", minutes, rest)
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours), tail)).otherwise(tail)


def duration_text(seconds) -> Column:
    """``1d 2h 3m`` / ``2h 3m 4s`` / ``3m 4s`` / ``4s``; unusable input is ``unknown``."""
    sec = _c(seconds).cast("double")
    total = F.floor(sec + 0.5)
    d, h = F.floor(total / 86400), F.floor(total % 86400 / 3600)
    m, s = F.floor(total % 3600 / 60), total % 60
    usable = sec.isNotNull() & ~F.isnan(sec) & (sec >= 0) & (sec < float("inf"))
    return (
        F.when(~F.coalesce(usable, F.lit(False)), "unknown")
        .when(d > 0, F.format_string("%dd %dh %dm", d, h, m))
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def safe_file_name(col, fallback: str = "report", limit: int = 120) -> Column:
    """Keep letters, digits, ``_ . -`` and blanks; trim; never a reserved device name."""
    trim_end = lambda c: F.regexp_replace(c, r"[ ._]+$", "")
    clean = F.trim(F.regexp_replace(_c(col), r"[^\p{L}\p{N}_ .\-]+", "_"))
    clean = trim_end(F.regexp_replace(clean, r"\s+", " "))
    clean = trim_end(F.substring(clean, 1, limit))
    stem = F.regexp_extract(clean, r"^([^.]*)", 1)
    rest = F.regexp_extract(clean, r"^[^.]*(.*)$", 1)
    renamed = trim_end(F.substring(F.concat(stem, F.lit("_report"), rest), 1, limit))
    clean = F.when(F.upper(stem).isin(RESERVED_STEMS), renamed).otherwise(clean)
    return F.when(F.length(clean) == 0, F.lit(fallback)).otherwise(clean)


def markdown_text(col, table_cell: bool = False) -> Column:
    """One-line markdown-safe text; a table cell also escapes the bar."""
    text = F.regexp_replace(_c(col).cast("string"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    text = F.replace(text, F.lit("`"), F.lit("'"))
    return F.replace(text, F.lit("|"), F.lit("\\|")) if table_cell else text


def nested_number(json_text, path: str, default: float = 0.0, as_int: bool = False) -> Column:
    """Number at a JSON path; missing, blank, boolean or unparsable gives the default."""
    raw = F.get_json_object(_c(json_text), path)
    value = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
    value = F.coalesce(value, F.lit(float(default)))
    return value.cast("bigint") if as_int else value


def nested_text(json_text, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(_c(json_text), path), F.lit(default))


def parse_paired_name(col, value_count: int = 8192, max_id: int = 65535) -> Column:
    """``TSV-<value>-sid-<id>.sav`` to struct(value, id, valid, reason): first failing check wins."""
    pattern = r"(?i)^TSV-(\d{1,9})-sid-(\d{1,9})\.sav$"
    value = F.regexp_extract(_c(col), pattern, 1).try_cast("int")
    ident = F.regexp_extract(_c(col), pattern, 2).try_cast("int")
    reason = (
        F.when(value.isNull() | ident.isNull(), "name")
        .when(value >= value_count, "tsv-range")
        .when(ident > max_id, "sid-range")
        .when(F.shiftright(ident, 3) != value, "tid0-tsv-sid-mismatch")
    )
    return F.struct(value.alias("value"), ident.alias("id"), reason.isNull().alias("valid"), reason.alias("reason"))


def paired_name(value, ident) -> Column:
    return F.format_string("TSV-%04d-sid-%05d.sav", _c(value).cast("int"), _c(ident).cast("int"))
