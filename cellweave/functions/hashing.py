"""Order-independent draws: the same id and salt always give the same number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published 32-bit mixer and its seeding
MIX_A = 0x7FEB352D
MIX_B = 0x846CA68B
SEED_STEP = 1000003
SALT_STEP = 7919
SEED_OFFSET = 12345
MASK32 = 0xFFFFFFFF


def _mul32(x: Column, k: int) -> Column:
    """``x * k mod 2^32`` without overflowing BIGINT: the multiplier is split into 16-bit halves."""
    low, high = k & 0xFFFF, k >> 16
    return (x * low + F.shiftleft((x * high).bitwiseAND(0xFFFF), 16)).bitwiseAND(F.lit(MASK32))


def uniform(ident: Column, salt: int) -> Column:
    """Uniform number in [0, 1) from an id and a salt, 24 bits fine."""
    x = (ident.cast("bigint") * SEED_STEP + F.lit(salt * SALT_STEP + SEED_OFFSET)).bitwiseAND(F.lit(MASK32))
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = _mul32(x, MIX_A)
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = _mul32(x, MIX_B)
    x = x.bitwiseXOR(F.shiftright(x, 16))
    return x.bitwiseAND(F.lit(0xFFFFFF)).cast("double") / float(1 << 24)


def uniform_sql(ident: str, salt: int) -> str:
    """The same draw as SQL text for the comparison engine."""

    def mul(x: str, k: int) -> str:
        return f"((({x}) * {k & 0xFFFF} + (((({x}) * {k >> 16}) & 65535) << 16)) & {MASK32})"

    a = f"((({ident}) * {SEED_STEP} + {salt * SALT_STEP + SEED_OFFSET}) & {MASK32})"
    b = mul(f"xor({a}, {a} >> 16)", MIX_A)
    c = mul(f"xor({b}, {b} >> 15)", MIX_B)
    return f"((xor({c}, {c} >> 16) & 16777215) / 16777216.0)"


def draw(*ids: Column, salt: int) -> Column:
    """Uniform number in [0, 1), 52 bits fine, from any number of ids and a salt. Ids far apart never share a draw."""
    text = F.concat_ws("|", *[i.cast("string") for i in ids], F.lit(str(salt)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def draw_sql(*ids: str, salt: int) -> str:
    """The same draw as SQL text for the comparison engine."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(ids)}, '{salt}')), 1, 13) AS BIGINT) / 4503599627370496.0)"
