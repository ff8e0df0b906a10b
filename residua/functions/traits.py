"""Attributes, geometric trait scores, labels and score bands derived from a 32-bit key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import _c, lower_half, upper_half

# Spot base centres (x, y), face centre, and the reference points of the scores.
SPOT_CENTRES = [(16.0, 19.0), (40.5, 20.5), (19.5, 35.5), (32.0, 36.5)]
FACE_CENTRE = (26.0, 30.0)
EYE_POINTS = [(19.5, 24.0), (38.0, 24.5)]
MOUTH_POINTS = [(23.5, 39.5), (31.5, 40.0)]
# Label thresholds, in output order.
TRAIT_LABELS = [
    ("centered", "centered", 70),
    ("balance", "balanced", 80),
    ("eye_cover", "eye-covering", 65),
    ("cluster", "clustered", 70),
    ("spread", "wide-spread", 72),
    ("vertical_symmetry", "rare vertical symmetry", 75),
    ("horizontal_symmetry", "rare horizontal symmetry", 75),
    ("heartish", "heart-ish", 70),
    ("funny", "funny-face candidate", 70),
    ("cursed", "cursed-face candidate", 70),
]
# Score to confidence, linear between the points; strength floors.
BAND_POINTS = [(0.0, 0), (0.60, 20), (0.70, 55), (0.80, 80), (0.90, 95), (1.0, 100)]
STRENGTHS = [("anchor", 0.90), ("strong", 0.80), ("clear", 0.70), ("echo", None)]


def derive_attributes(key, first_id, second_id) -> dict[str, Column]:
    """Class (mod 25), parity slot, threshold class, rarity and rare flag of a key."""
    k = _c(key).cast("bigint")
    rarity = (
        upper_half(k).bitwiseXOR(lower_half(k))
        .bitwiseXOR(_c(first_id).cast("bigint"))
        .bitwiseXOR(_c(second_id).cast("bigint"))
        .bitwiseAND(0xFFFF)
    )
    return {
        "class_id": k % 25,
        "slot": F.when(k % 2 == 0, "First").otherwise("Second"),
        "threshold_class": F.when(k % 256 >= 127, "high").otherwise("low"),
        "rarity": rarity,
        "is_rare": rarity < 8,
    }


def _centres(key) -> list[tuple[Column, Column]]:
    k = _c(key).cast("bigint")
    nibble = lambda i: F.shiftrightunsigned(k, 4 * i).bitwiseAND(15).cast("double")
    return [(F.lit(x) + nibble(2 * i), F.lit(y) + nibble(2 * i + 1)) for i, (x, y) in enumerate(SPOT_CENTRES)]


def _dist(ax, ay, bx, by) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def _closeness(d: Column, limit: float) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.lit(100.0) - d / limit * 100.0), 3)


def _mean(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / float(len(parts))


def with_centres(df: DataFrame, key, prefix: str = "_at") -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """The frame with the key's spot centres as columns, which many terms then read instead of deriving them, and those columns."""
    names = [(f"{prefix}_x{i}", f"{prefix}_y{i}") for i in range(len(SPOT_CENTRES))]
    centres = {n: c for pair, point in zip(names, _centres(key), strict=True) for n, c in zip(pair, point, strict=True)}
    return df.withColumns(centres), [(F.col(x), F.col(y)) for x, y in names]


def scored(df: DataFrame, key) -> DataFrame:
    """The frame with the eleven rounded scores of a key, in steps: centres, the scores that others are made of, the rest."""
    rows, at = with_centres(df, key)
    parts = trait_parts(at)
    rows = rows.withColumns({f"_part_{n}": c for n, c in parts.items()})
    scores = _finals({n: F.col(f"_part_{n}") for n in parts})
    return rows.withColumns({n: F.round(c, 3) for n, c in scores.items()}).select(*df.columns, *scores)


def trait_scores(key, rounded: bool = True) -> dict[str, Column]:
    """Eleven scores in 0..100; unrounded finals are what rankings use."""
    scores = _finals(trait_parts(_centres(key)))
    return {n: F.round(c, 3) for n, c in scores.items()} if rounded else scores


def trait_parts(p: list[tuple[Column, Column]]) -> dict[str, Column]:
    """The values of four spot centres that the scores are made of."""
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = p
    cx, cy = F.lit(FACE_CENTRE[0]), F.lit(FACE_CENTRE[1])

    def mirror(a, b):
        across = F.abs((a[0] - cx) + (b[0] - cx))
        return _closeness(F.sqrt(across * across + (a[1] - b[1]) * (a[1] - b[1])), 24.0)

    def mirror_down(a, b):
        across = F.abs((a[1] - cy) + (b[1] - cy))
        return _closeness(F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + across * across), 28.0)

    pair_avg = _mean([_dist(*p[i], *p[j]) for i in range(4) for j in range(i + 1, 4)])
    centered = _closeness(_mean([_dist(x, y, cx, cy) for x, y in p]), 28.0)
    balance = _closeness(_dist(_mean([x1, x2, x3, x4]), _mean([y1, y2, y3, y4]), cx, cy), 18.0)
    cluster = _closeness(pair_avg, 32.0)
    eye = _mean([_closeness(_dist(*p[i], F.lit(EYE_POINTS[i][0]), F.lit(EYE_POINTS[i][1])), 18.0) for i in (0, 1)])
    mouth = _mean(
        [_closeness(_dist(*p[2 + i], F.lit(MOUTH_POINTS[i][0]), F.lit(MOUTH_POINTS[i][1])), 18.0) for i in (0, 1)]
    )
    vertical = _mean([mirror(p[0], p[1]), mirror(p[2], p[3])])
    horizontal = _mean([mirror_down(p[0], p[2]), mirror_down(p[1], p[3])])
    return {
        "balance": balance, "centered": centered, "cluster": cluster, "eye": eye, "horizontal": horizontal, "mouth": mouth,
        "pair_avg": pair_avg, "vertical": vertical,
    }


def _finals(part: dict[str, Column]) -> dict[str, Column]:
    eye, mouth, vertical, centered, cluster = (part[n] for n in ("eye", "mouth", "vertical", "centered", "cluster"))
    spread = F.least(F.lit(100.0), part["pair_avg"] / 28.0 * 100.0)
    return {
        "balance": part["balance"],
        "centered": centered,
        "cluster": cluster,
        "cursed": (eye + mouth + spread + (F.lit(100.0) - vertical)) / 4.0,
        "eye_cover": eye,
        "funny": (eye * 2.0 + vertical + cluster + centered) / 5.0,
        "heartish": (vertical + centered + mouth) / 3.0,
        "horizontal_symmetry": part["horizontal"],
        "lower_face_cover": mouth,
        "spread": spread,
        "vertical_symmetry": vertical,
    }


def trait_labels(scores: dict[str, Column]) -> Column:
    """The labels a row's scores reach.

    Put together as text and split: compacting an array would evaluate every score outside generated code, term by term.
    """
    found = F.concat_ws("\u0001", *[F.when(scores[s] >= t, F.lit(n)) for s, n, t in TRAIT_LABELS])
    return F.split(F.when(found == "", F.lit("plain")).otherwise(found), "\u0001")


def band_score(score) -> Column:
    """Confidence 0..100 through the band points, half-even rounding."""
    s = _c(score).cast("double")
    out = F.when(s <= BAND_POINTS[0][0], F.lit(BAND_POINTS[0][1]))
    for (x0, y0), (x1, y1) in zip(BAND_POINTS, BAND_POINTS[1:]):
        out = out.when(s <= x1, F.rint(F.lit(float(y0)) + (s - x0) / (x1 - x0) * (y1 - y0)).cast("int"))
    return F.when(F.isnan(s), F.lit(None).cast("int")).otherwise(out.otherwise(F.lit(100)))


def strength(score) -> Column:
    s = _c(score).cast("double")
    out = F.when(s.isNull() | F.isnan(s), F.lit(None).cast("string"))
    for name, floor in STRENGTHS:
        out = out.when(s >= floor, name) if floor is not None else out.otherwise(name)
    return out
