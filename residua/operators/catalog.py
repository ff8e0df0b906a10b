"""Catalogue joins, optional filters, searches and stored-value scans."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional_filter(df: DataFrame, **constraints) -> DataFrame:
    """Equality on each column whose constraint is given; None means no constraint.

    Only supplied predicates enter the plan, so each reaches the scan.
    """
    for name, wanted in constraints.items():
        if wanted is not None:
            df = df.filter(F.col(name) == wanted)
    return df


def search_rows(df: DataFrame, status: str | None, query: str, status_col: str, ids: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Status equality AND (number equality on any id column OR substring over the joined texts)."""
    if status not in (None, "all"):
        df = df.filter(F.col(status_col) == status)
    q = query.strip().lower()
    if not q:
        return df
    text = F.lower(F.concat_ws(" ", *[F.col(t).cast("string") for t in texts]))
    hit = F.contains(text, F.lit(q))
    try:
        number = int(q, 16) if q.startswith("0x") else int(q)
    except ValueError:
        number = None
    if number is not None:
        for i in ids:
            hit = hit | F.coalesce(F.col(i) == number, F.lit(False))
    return df.filter(hit)


def catalog_select(paths: DataFrame, roots: DataFrame, entries: DataFrame, root_key: str, entry_key: str, order: Sequence[str], limit: int | None = None, offset: int = 0, **constraints) -> DataFrame:
    """Inner join of paths with their root and entry, filtered, ordered and paged."""
    out = optional_filter(paths.join(roots, root_key).join(entries, entry_key), **constraints)
    if limit is None:
        return out
    return out.orderBy(*order).offset(offset).limit(limit)


def catalog_count(paths: DataFrame, roots: DataFrame, entries: DataFrame, root_key: str, entry_key: str, **constraints) -> DataFrame:
    out = optional_filter(paths.join(roots, root_key).join(entries, entry_key), **constraints)
    return out.agg(F.count(F.lit(1)).alias("n"))


def catalog_lookup(df: DataFrame, games: DataFrame, entries: DataFrame, checksum: str, game_key: str) -> DataFrame:
    """Catalogue entry and game of each row by checksum."""
    return df.join(entries.join(games, game_key), checksum)


# Highest value a width holds before "guess" widens it.
GUESS_LIMITS = ((0x10000, 4), (0x100, 2))
DELTA_OPS = ("delta", "delta_positive", "delta_negative", "delta_any")


def compare(op: str, value: Column, match) -> Column:
    """The scan comparison; delta forms look at the change handed in as ``value``."""
    forms = {
        "eq": value == match, "delta": value == match, "gt": value > match, "lt": value < match,
        "delta_positive": value > 0, "delta_negative": value < 0, "delta_any": value != 0, "any": F.lit(True),
    }
    if op not in forms:
        raise ValueError(f"unknown comparison: {op!r}")
    return forms[op]


def value_scan(df: DataFrame, op: str, match: int, width: int, addr: str = "addr", value: str = "value", limit: int | None = None) -> DataFrame:
    """Aligned stored values of one width that satisfy the comparison."""
    out = df.filter((F.col("width") == width) & (F.col(addr) % width == 0) & compare(op, F.col(value), match))
    out = out.select(addr, "width", F.col(value).alias("old_value"), F.lit(1).alias("divisor"))
    return out if limit is None else out.orderBy(addr).limit(limit)


def text_scan(df: DataFrame, needle: str, addr: str = "addr", text: str = "text", limit: int | None = None) -> DataFrame:
    """Every occurrence (overlapping ones too) of a string inside each row's text, as absolute addresses."""
    if not needle:
        raise ValueError("an empty string occurs everywhere")

    @F.pandas_udf("array<int>")
    def offsets(texts: pd.Series) -> pd.Series:
        def find(body):
            found, at = [], -1 if body is None else body.find(needle)
            while at >= 0:
                found.append(at)
                at = body.find(needle, at + 1)
            return found

        return texts.map(find)

    holding = df.filter(F.contains(F.col(text), F.lit(needle)))
    out = holding.select(addr, F.explode(offsets(F.col(text))).alias("_i")).select((F.col(addr) + F.col("_i")).alias(addr))
    return out if limit is None else out.orderBy(addr).limit(limit)


def guesses(text: str, width: int | None) -> list[tuple[int, int, int]]:
    """(value, width, divisor) readings of a typed number: decimal, then hex, with trailing zeros cut."""
    found = []
    for base, step in ((10, 10), (16, 16)):
        try:
            value = int(text, base)
        except ValueError:
            continue
        divisor = 1
        while True:
            w = width or next((w for bound, w in GUESS_LIMITS if value > bound), 1)
            found.append((value, w, divisor))
            if value == 0 or value % step:
                break
            value //= step
            divisor *= step
    return found


def guess_scan(df: DataFrame, op: str, text: str, width: int | None = None, addr: str = "addr", value: str = "value", limit: int | None = None) -> DataFrame:
    """All readings of ``text`` in one scan: each row is tested against the list of guesses."""
    hits = F.array(
        *[
            F.when(
                (F.col("width") == w) & (F.col(addr) % w == 0) & compare(op, F.col(value), v),
                F.struct(F.lit(i).alias("guess"), F.lit(d).alias("divisor")),
            )
            for i, (v, w, d) in enumerate(guesses(text, width))
        ]
    )
    out = df.select(addr, "width", F.col(value).alias("old_value"), F.explode(hits).alias("_h")).filter(F.col("_h").isNotNull())
    out = out.select(addr, "width", "old_value", "_h.divisor", "_h.guess")
    return out if limit is None else out.orderBy("guess", addr).limit(limit)


def refine_scan(prev: DataFrame, now: DataFrame, op: str, match: int = 0, addr: str = "addr", value: str = "value") -> DataFrame:
    """Earlier hits re-tested against a new snapshot; survivors carry the new value."""
    joined = prev.join(now.select(addr, "width", F.col(value).alias("_new")), [addr, "width"])
    tested = F.col("_new") - F.col("old_value") if op in DELTA_OPS else F.col("_new")
    kept = joined.filter(compare(op, tested, match))
    return kept.select(addr, "width", F.col("_new").alias("old_value"), "divisor")
