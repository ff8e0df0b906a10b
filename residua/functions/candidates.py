"""Candidate-value tables: what each class of stream shift would have produced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .generator import lcg_jump, lcg_output
from .keys import pack_fields


def shifted_classes(base: Sequence[int], points: Sequence[tuple[str, int]], max_extra: int) -> list[tuple[int, str, list[int]]]:
    """(class id, name, positions): the base, then every insertion point for each extra advance.

    From an insertion index on, positions move by the extra advances.
    """
    if max_extra < 0:
        raise ValueError("max_extra must not be negative")
    classes = [(0, "normal", list(base))]
    for extra in range(1, max_extra + 1):
        for name, at in points:
            moved = [p + (extra if i >= at else 0) for i, p in enumerate(base)]
            classes.append((len(classes), f"{name}+{extra}", moved))
    return classes


def inherited_fields(words: Sequence[Column], parent_a: Sequence[int], parent_b: Sequence[int], order: Sequence[int]) -> list[Column]:
    """Six 5-bit fields after the inheritance rule, in field order.

    ``words``: two value words, three stat words, three parent words. The three stat picks
    run modulo 6, 5 and 4 over a list that loses the picked *value's slot*, not the drawn
    slot; written out, the second list is j + (j >= v1), the third skips slot v2 of that.
    ``order`` maps a stat value to its field.
    """
    w1, w2, s1, s2, s3, p1, p2, p3 = words
    five = lambda w, k: F.shiftright(w, k).bitwiseAND(31)
    fields = [five(w1, 0), five(w1, 5), five(w1, 10), five(w2, 5), five(w2, 10), five(w2, 0)]
    skip = lambda j, v: j + (j >= v).cast("bigint")
    v1 = s1 % 6
    v2 = skip(s2 % 5, v1)
    v3 = skip(skip(s3 % 4, v2), v1)
    for v, p in ((v1, p1), (v2, p2), (v3, p3)):
        for stat, field in enumerate(order):
            parent = F.when(p % 2 == 1, F.lit(parent_b[field])).otherwise(F.lit(parent_a[field])).cast("bigint")
            fields[field] = F.when(v == stat, parent).otherwise(fields[field])
    return fields


def candidate_values(
    states: DataFrame, key: str, state: str, classes: Sequence[tuple[int, str, list[int]]],
    parent_a: Sequence[int], parent_b: Sequence[int], order: Sequence[int],
) -> DataFrame:
    """(class_id, name, key, value) for every key and class.

    The draws a class needs are constant jumps from the key's state, so the table is a
    projection of the key rows; classes fan out inside the row.
    """
    last = max(p for _, _, positions in classes for p in positions)
    draws = F.array(*[lcg_output(lcg_jump(state, n)) for n in range(1, last + 1)])
    listed = F.array(
        *[F.struct(F.lit(i).alias("class_id"), F.lit(n).alias("name"), F.array(*[F.lit(p) for p in pos]).alias("pos")) for i, n, pos in classes]
    )
    rows = states.select(F.col(key), draws.alias("_w"), F.explode(listed).alias("_c"))
    rows = rows.select(
        F.col("_c.class_id").alias("class_id"), F.col("_c.name").alias("name"), F.col(key),
        *[F.element_at("_w", F.col("_c.pos")[i]).alias(f"_w{i}") for i in range(8)],
    )
    value = pack_fields(inherited_fields([F.col(f"_w{i}") for i in range(8)], parent_a, parent_b, order))
    return rows.select("class_id", "name", key, value.alias("value"))


def lookahead_value(df: DataFrame, state: str, n: int, table: DataFrame, slot: str, slots: int) -> DataFrame:
    """Table value selected by the state k steps ahead, for k = 1..n."""
    ahead = [F.struct(F.lit(k).alias("k"), (lcg_output(lcg_jump(state, k)) % slots).alias(slot)) for k in range(1, n + 1)]
    rows = df.select("*", F.inline(F.array(*ahead)))
    return rows.join(table, slot)
