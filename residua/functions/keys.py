"""Key arithmetic, packed values, bit helpers and flag masks as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

U16 = 0xFFFF
U32 = 0xFFFFFFFF
REMAP_MODULUS = 0xFFFE
# Bit offset of each of the six 5-bit fields, in internal field order.
FIELD_SHIFTS = (0, 5, 10, 20, 25, 15)
FIELD_MASK = 31
FLAG_BIT = 1 << 30


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def compose_key(upper, lower) -> Column:
    """Two unsigned 16-bit halves to one unsigned 32-bit key."""
    return F.shiftleft(_c(upper).cast("bigint").bitwiseAND(U16), 16).bitwiseOR(
        _c(lower).cast("bigint").bitwiseAND(U16)
    )


def upper_half(key) -> Column:
    return F.shiftrightunsigned(_c(key).cast("bigint"), 16).bitwiseAND(U16)


def lower_half(key) -> Column:
    return _c(key).cast("bigint").bitwiseAND(U16)


def format_hex(col, digits: int = 4) -> Column:
    """``0x``-prefixed upper-case hex with at least ``digits`` digits."""
    text = F.hex(_c(col).cast("bigint"))
    return F.concat(F.lit("0x"), F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0")))


def parse_hex(col) -> Column:
    """``0x1234`` or ``1234`` (both read as hex) to BIGINT; anything else is null."""
    text = F.trim(_c(col).cast("string"))
    return F.when(
        text.rlike("^(0[xX])?[0-9a-fA-F]{1,15}$"),
        F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, 10).cast("bigint"),
    )


def parse_int_text(col) -> Column:
    """``0x..`` as hex, plain digits as decimal; anything else is null."""
    text = F.trim(_c(col).cast("string"))
    return F.when(
        text.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 20), 16, 10).cast("bigint")
    ).when(text.rlike("^[0-9]{1,18}$"), text.try_cast("bigint"))


def remap_raw_to_live(raw) -> Column:
    return _c(raw).cast("bigint") % REMAP_MODULUS + 1


def canonical_raw_for_live(live) -> Column:
    """Inverse of the remap; null outside 1..0xFFFE."""
    value = _c(live).cast("bigint")
    return F.when((value >= 1) & (value <= REMAP_MODULUS), value - 1)


def pair_value(upper, lower) -> Column:
    """(upper xor lower) >> 3, an unsigned 13-bit value."""
    return F.shiftright(_c(upper).cast("bigint").bitwiseXOR(_c(lower).cast("bigint")).bitwiseAND(U16), 3)


def acceptable_ids(first_id, value) -> Column:
    """The eight second ids whose pair value with ``first_id`` equals ``value``."""
    base = F.shiftleft(_c(value).cast("bigint"), 3)
    return F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda k: _c(first_id).cast("bigint").bitwiseXOR(base.bitwiseOR(k.cast("bigint"))),
    )


def unpack_fields(value) -> list[Column]:
    """The six 5-bit fields of a packed value, in internal field order."""
    wide = _c(value).cast("bigint")
    return [F.shiftrightunsigned(wide, s).bitwiseAND(FIELD_MASK) for s in FIELD_SHIFTS]


def pack_fields(fields: Sequence, flag: bool = True) -> Column:
    """Six fields (internal order) to one packed value, with the flag bit unless told not to."""
    out = F.lit(FLAG_BIT if flag else 0).cast("bigint")
    for field, shift in zip(fields, FIELD_SHIFTS, strict=True):
        out = out.bitwiseOR(F.shiftleft(_c(field).cast("bigint").bitwiseAND(FIELD_MASK), shift))
    return out


def changed_bits(actual, base) -> list[Column]:
    """Six 0/1 columns: does field i of ``actual`` differ from ``base``?"""
    diff = _c(actual).cast("bigint").bitwiseXOR(_c(base).cast("bigint"))
    return [
        (F.shiftrightunsigned(diff, s).bitwiseAND(FIELD_MASK) != 0).cast("int") for s in FIELD_SHIFTS
    ]


def changed_count(actual, base) -> Column:
    """Number of differing fields: fold each field's bits onto its lowest one and count those."""
    diff = _c(actual).cast("bigint").bitwiseXOR(_c(base).cast("bigint"))
    folded = diff
    for k in range(1, 5):
        folded = folded.bitwiseOR(F.shiftrightunsigned(diff, k))
    return F.bit_count(folded.bitwiseAND(sum(1 << s for s in FIELD_SHIFTS))).cast("int")


def changed_mask(actual, base) -> Column:
    """Bit i set when field i differs."""
    out = F.lit(0)
    for i, bit in enumerate(changed_bits(actual, base)):
        out = out + bit * (1 << i)
    return out


def residual_key(actual, base) -> Column:
    """Changed mask in bits 0-5, then the changed fields' new values, five bits each."""
    out = changed_mask(actual, base).cast("bigint")
    for i, (bit, value) in enumerate(zip(changed_bits(actual, base), unpack_fields(actual), strict=True)):
        out = out.bitwiseOR(F.shiftleft(F.when(bit == 1, value).otherwise(F.lit(0).cast("bigint")), 6 + 5 * i))
    return out


def trailing_zeros16(col) -> Column:
    """Trailing zero bits of a 16-bit value; 16 for zero."""
    value = _c(col).cast("bigint").bitwiseAND(U16)
    return F.when(value == 0, F.lit(16)).otherwise(F.bit_count(value.bitwiseAND(-value) - 1).cast("int"))


def bit_test(bitmap, index) -> Column:
    """Little-endian bit test on a BINARY bitmap; ``index`` counts bits from byte 0."""
    byte = F.conv(F.hex(F.substring(_c(bitmap), F.shiftright(_c(index).cast("int"), 3) + 1, F.lit(1))), 16, 10)
    bit = F.call_function("shiftleft", F.lit(1), _c(index).cast("int").bitwiseAND(7))
    return byte.cast("int").bitwiseAND(bit) != 0


def bitmap_to_ids(bitmap, n_bits: int) -> Column:
    """All set bit positions of a little-endian bitmap as an array."""
    return F.filter(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: bit_test(bitmap, i))


def pack_bits(bits, n_bits: int) -> Column:
    """Array of bit positions (below 63) to an integer; the inverse is :func:`unpack_bits`."""
    if n_bits > 62:
        raise ValueError("pack_bits packs into one BIGINT; use bitmap rows for wider sets")
    return F.aggregate(
        F.array_distinct(_c(bits)),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc.bitwiseOR(F.element_at(F.array(*[F.lit(1 << k) for k in range(n_bits)]), i.cast("int") + 1)),
    )


def unpack_bits(value, n_bits: int) -> Column:
    parts = [F.when(_c(value).cast("bigint").bitwiseAND(1 << k) != 0, F.lit(k)) for k in range(n_bits)]
    return F.array_compact(F.array(*parts))


def mask_to_names(mask, names: Mapping[str, int]) -> Column:
    """Flag names set in ``mask`` in the given order; unknown bits as hex; ``NONE`` for an empty mask."""
    wide = _c(mask).cast("bigint")
    known = 0
    for bit in names.values():
        known |= 1 << bit
    unknown = wide.bitwiseAND(U32 & ~known)
    parts = [F.when(wide.bitwiseAND(1 << bit) != 0, F.lit(name)) for name, bit in names.items()]
    parts.append(F.when(unknown != 0, format_hex(unknown, 8)))
    found = F.array_compact(F.array(*parts))
    return F.when(F.size(found) == 0, F.array(F.lit("NONE"))).otherwise(found)


def names_to_mask(text, names: Mapping[str, int], aliases: Mapping[str, str] | None = None) -> Column:
    """``A+B`` or ``A|B`` (or a number) to a mask; null when any name is unknown."""
    table = {**names, **{a: names[t] for a, t in (aliases or {}).items()}}
    bits = F.create_map(*[F.lit(x) for name, bit in table.items() for x in (name, 1 << bit)])
    tidy = F.transform(
        F.split(F.regexp_replace(_c(text), r"\|", "+"), r"\+"),
        lambda p: F.replace(F.replace(F.upper(F.trim(p)), F.lit(" "), F.lit("")), F.lit("-"), F.lit("_")),
    )
    tidy = F.filter(tidy, lambda p: (p != "") & (p != "NONE"))
    mask = F.aggregate(
        tidy,
        F.lit(0).cast("bigint"),
        lambda acc, p: acc.bitwiseOR(F.try_element_at(bits, p).cast("bigint")),
    )
    return F.coalesce(parse_int_text(text), mask)


def percent(part, total) -> Column:
    """100 * part / total, and 0 for a zero or missing total."""
    t = _c(total).cast("double")
    return F.coalesce(_c(part).cast("double") * 100.0 / F.when(t != 0, t), F.lit(0.0))


def ratio(part, total) -> Column:
    t = _c(total).cast("double")
    return F.coalesce(_c(part).cast("double") / F.when(t != 0, t), F.lit(0.0))
