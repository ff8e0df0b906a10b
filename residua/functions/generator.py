"""The 32-bit linear congruential generator as Column arithmetic.

Jumping ``n`` steps is an affine map, so a stream position never needs the positions
before it: row ``n`` of a generator stream is computed from ``n`` alone, in any task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import U16, U32, _c

# Generator multiplier and increment.
MULTIPLIER = 0x41C64E6D
INCREMENT = 0x6073
MULTIPLIER_INVERSE = pow(MULTIPLIER, -1, 1 << 32)


def jump_constants(n: int) -> tuple[int, int]:
    """(a, c) with state_n = a * state + c; negative ``n`` steps backwards.

    a is M**n, and c the increment times the geometric sum (M**n - 1) / (M - 1).
    """
    power = pow(MULTIPLIER, n % (1 << 32), (MULTIPLIER - 1) << 32)
    return power & U32, (power - 1) // (MULTIPLIER - 1) * INCREMENT & U32


_BIT_JUMPS = [jump_constants(1 << i) for i in range(32)]


def _affine(state: Column, a, c) -> Column:
    """a * state + c mod 2^32; the 16-bit split keeps every product inside BIGINT."""
    a = a if isinstance(a, Column) else F.lit(a).cast("bigint")
    c = c if isinstance(c, Column) else F.lit(c).cast("bigint")
    low = a * state.bitwiseAND(U16)
    high = F.shiftleft((a * F.shiftrightunsigned(state, 16)).bitwiseAND(U16), 16)
    return (low + high + c).bitwiseAND(U32)


def _state(col) -> Column:
    return _c(col).cast("bigint").bitwiseAND(U32)


def lcg_next(state) -> Column:
    return (_state(state) * MULTIPLIER + INCREMENT).bitwiseAND(U32)


def lcg_previous(state) -> Column:
    back = (_state(state) - INCREMENT).bitwiseAND(U32)
    return _affine(back, MULTIPLIER_INVERSE, 0)


def lcg_jump(state, n: int) -> Column:
    """State after a constant number of steps: one multiply-add."""
    a, c = jump_constants(n)
    return _affine(_state(state), a, c)


def lcg_at(state, n) -> Column:
    """State after ``n`` steps, ``n`` an integer or a column (taken modulo the period 2^32).

    A constant step count is one multiply-add in generated code; a column of counts takes four, one
    for each byte of the count, with factors from constant tables of 256 entries.
    """
    if isinstance(n, int):
        return lcg_jump(state, n)
    out, steps = _state(state), _state(n)
    for level in range(4):
        jumps = [jump_constants(i << (8 * level)) for i in range(256)]
        at = F.shiftrightunsigned(steps, 8 * level).bitwiseAND(F.lit(255)).cast("int") + 1
        a, c = (F.element_at(F.lit(column), at) for column in map(list, zip(*jumps, strict=True)))
        out = _affine(out, a, c)
    return out


def lcg_output(state) -> Column:
    """The generator's output: the high 16 bits."""
    return F.shiftrightunsigned(_state(state), 16)


def lcg_distance(start, end) -> Column:
    """Steps from ``start`` forward to ``end``, in 0..2^32-1.

    The low k bits of the generator have period 2^k, so a state's position is found bit by
    bit: where bit k differs, 2^k more steps are needed. 32 vector operations, no search.
    """

    @F.pandas_udf("bigint")
    def steps(a: pd.Series, b: pd.Series) -> pd.Series:
        known = a.notna() & b.notna()
        at = lambda v: _np_position(v.fillna(0).to_numpy().astype(np.uint64) & np.uint64(U32)).astype(np.int64)
        return pd.Series((at(b) - at(a)) % (1 << 32), dtype="Int64").where(known.to_numpy(), pd.NA)

    return steps(_state(start), _state(end))


def signed_distance(expected, observed, max_steps: int) -> Column:
    """Drift of ``observed`` against ``expected``: 0, then forward, then backward; null beyond the window."""
    d = lcg_distance(expected, observed)
    return F.when(d <= max_steps, d).when(F.lit(1 << 32) - d <= max_steps, d - (1 << 32))


def calibrate_offset(
    df: DataFrame, state: str, base: str, observed: str, expected: int, radius: int, out: str = "offset"
) -> DataFrame:
    """Offset past ``base`` whose output equals ``observed``, nearest ``expected`` (lower one on a tie).

    The search window is per row, at most ``2 * radius + 1`` positions, and stays inside the row.
    """
    low = max(0, expected - radius)
    start = df.withColumn("_from", lcg_at(F.col(state), F.col(base).cast("bigint") + low))
    hits = [
        F.when(
            lcg_output(lcg_jump("_from", k)) == F.col(observed).cast("bigint"),
            F.struct(F.lit(abs(low + k - expected)).alias("gap"), F.lit(low + k).alias("off")),
        )
        for k in range(expected + radius - low + 1)
    ]
    return start.withColumn(out, F.array_min(F.array(*hits))["off"]).drop("_from")


def _np_position(states: np.ndarray) -> np.ndarray:
    """Steps from state 0 to each state, vectorised over uint64."""
    mask = np.uint64(U32)
    s = np.zeros_like(states)
    d = np.zeros_like(states)
    for i, (a, c) in enumerate(_BIT_JUMPS):
        w = np.uint64(1 << i)
        hit = ((s ^ states) & w) != 0
        s = np.where(hit, (s * np.uint64(a) + np.uint64(c)) & mask, s)
        d = np.where(hit, d | w, d)
    return d


_SMALL_ORBIT: tuple[np.ndarray, np.ndarray] | None = None


def _small_orbit() -> tuple[np.ndarray, np.ndarray]:
    """Orbit positions of the 65,536 small states, sorted; the size is fixed by the rule."""
    global _SMALL_ORBIT
    if _SMALL_ORBIT is None:
        small = np.arange(1 << 16, dtype=np.uint64)
        pos = _np_position(small).astype(np.int64)
        order = np.argsort(pos)
        _SMALL_ORBIT = pos[order], small[order].astype(np.int64)
    return _SMALL_ORBIT


def nearest_small_state(state, max_steps: int) -> Column:
    """struct(seed, steps): nearest state <= 0xFFFF on the orbit, backward first at equal distance."""

    @F.pandas_udf("struct<seed bigint, steps bigint>")
    def find(values: pd.Series) -> pd.DataFrame:
        period = 1 << 32
        pos, seeds = _small_orbit()
        here = _np_position(values.fillna(0).to_numpy().astype(np.uint64) & np.uint64(U32)).astype(np.int64)
        right = np.searchsorted(pos, here, side="left")
        ahead = right % len(pos)
        behind = (np.searchsorted(pos, here, side="right") - 1) % len(pos)
        forward = (pos[ahead] - here) % period
        backward = (here - pos[behind]) % period
        use_back = backward <= forward
        steps = np.where(use_back, -backward, forward)
        seed = np.where(use_back, seeds[behind], seeds[ahead])
        frame = pd.DataFrame({"seed": pd.array(seed, "Int64"), "steps": pd.array(steps, "Int64")})
        frame.loc[(np.abs(steps) > max_steps) | values.isna().to_numpy(), ["seed", "steps"]] = pd.NA
        return frame

    return find(_state(state))
