"""Fixed-point numbers, clamps and record sizes as columns. Invalid is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I64_MAX, I32_MAX, I32_MIN = (1 << 63) - 1, (1 << 31) - 1, -(1 << 31)


def div(a: Column, b) -> Column:
    """Integer division truncating toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def to_p6(raw: Column, scale: int) -> Column:
    """raw * 10^(6 - scale); null on overflow, and for a scale that six digits can't hold."""
    return F.try_multiply(raw, F.lit(10 ** (6 - scale)).cast("long")) if 0 <= scale <= 6 else F.lit(None).cast("long")


def _limit(up: Column) -> Column:
    return F.when(up, F.lit(I64_MAX)).otherwise(F.lit(-I64_MAX - 1))


def saturating_multiply(a: Column, b: Column) -> Column:
    """The nearest long; null stays null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_multiply(a, b), _limit((a < 0) == (b < 0))))


def saturating_add(a: Column, b: Column) -> Column:
    """The nearest long; null stays null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_add(a, b), _limit(a > 0)))


def clamp(a: Column, low: Column, high: Column) -> Column:
    """a held to low and high; null stays null, where least and greatest would skip it."""
    return F.when(a.isNotNull(), F.least(F.greatest(a, low), high))


def narrow_u32(a: Column) -> Column:
    """The nearest unsigned 32-bit number, as a long."""
    return clamp(a, F.lit(0), F.lit((1 << 32) - 1)).cast("long")


def exact_positive_i32(a: Column) -> Column:
    """a as an int if it is one and above zero, else null."""
    return F.when((a > 0) & (a <= I32_MAX), a).cast("int")


def narrow_i32(a: Column) -> Column:
    return clamp(a, F.lit(I32_MIN), F.lit(I32_MAX)).cast("int")


def rescale_milli(milli: Column, scale: int) -> Column:
    """Thousandths to another scale: saturating above three digits, truncating below."""
    return saturating_multiply(milli, F.lit(10 ** (scale - 3)).cast("long")) if scale >= 3 else div(milli, 10 ** (3 - scale))


def mul_div(a: Column, b: Column, c: Column) -> Column:
    """a * b / c, truncated, over whole longs: the product has 38 digits at most. Null where c is 0 or the result is no long."""
    wide = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    got = F.call_function("div", wide, F.nullif(c, F.lit(0).cast("long")).cast("decimal(19,0)"))
    fits = F.abs(wide) < F.abs(c.cast("decimal(19,0)")) * F.lit(str(1 << 63)).cast("decimal(19,0)")
    return F.when(fits, got)


def fixed_text(raw: Column, scale: int) -> Column:
    """A scaled integer as text with all its decimals."""
    whole, part = div(F.abs(raw), 10**scale), F.abs(raw) % (10**scale)
    return F.concat(F.when(raw < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), scale, "0"))


def record_pad(body: Column) -> Column:
    """Bytes that pad header, head and body to a multiple of eight."""
    return F.pmod(F.lit(8) - F.pmod(body + 119, F.lit(8)), F.lit(8))


def record_size(body: Column) -> Column:
    """Header 96, head 23, body, padding, trailer 16."""
    return body + 119 + record_pad(body) + 16


def price_limits(reference: Column, tick: Column, derivative: Column) -> tuple[Column, Column]:
    """Lower and upper limit: 10 percent (derivatives 20), aligned inward to the tick."""
    pct = F.when(derivative, 20).otherwise(10)
    low, high = div(reference * (F.lit(100) - pct) + 99, 100), div(reference * (pct + 100), 100)
    return div(low + tick - 1, tick) * tick, div(high, tick) * tick


def depth_clamped(price: Column, lower: Column, upper: Column, tick: Column, depth: Column) -> Column:
    """price held so far inside its limits that ``depth`` levels and two more (two at least) fit on both sides; where the
    limits are too narrow for that, the upper limit wins over the lower margin. Null stays null."""
    room = tick * F.greatest(F.lit(2), depth + 2)
    floor = F.least(upper, lower + room)
    return clamp(price, floor, F.greatest(floor, upper - room))
