"""Hash and partition functions as column expressions.

Bucket counts round up to a power of two, but for exactrange. Only the low bits
reach a result, so values are masked before they are multiplied and nothing
overflows under ANSI rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParameter, MissingParameter, UnknownHash


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def buckets_of(spec: dict) -> int:
    """How many buckets the function has."""
    fn = spec.get("fn", "")
    if fn == "alwayszero":
        return 1
    if fn == "tpchq1magic":
        return 4
    if "buckets" not in spec:
        raise MissingParameter("hash.buckets")
    return int(spec["buckets"]) if fn == "exactrange" else power_of_two(spec["buckets"])


def hash_column(spec: dict, value: Column, *more: Column) -> Column:
    """The bucket (long) of `value` by `spec`: fn, buckets, range, offset, skipbits."""
    fn = spec.get("fn")
    if fn is None:
        raise MissingParameter("hash.fn")
    if fn == "alwayszero":
        return F.lit(0).cast("long")
    size = buckets_of(spec)
    mask, skip, offset = size - 1, int(spec.get("skipbits", 0)), int(spec.get("offset", 0))
    v = value.cast("long") if fn not in ("tpchq1magic", "willis", "bytes") else value
    if fn == "modulo":
        return v.bitwiseAND(F.lit(mask))
    if fn == "parammodulo":
        return F.shiftright((v - offset).bitwiseAND(F.lit(mask << skip)), skip)
    if fn == "knuth":
        bits = size.bit_length() - 1 + skip
        if bits > 30:
            raise InvalidParameter("knuth takes buckets and skipbits of 30 bits together")
        return F.shiftright((v.bitwiseAND(F.lit((1 << bits) - 1)) * F.lit(2654435761)).bitwiseAND(F.lit(mask << skip)), skip)
    if fn in ("range", "exactrange"):
        if len(spec.get("range", ())) != 2:
            raise MissingParameter("hash.range")
        low, high = (int(x) for x in spec["range"])
        if high < low:
            raise InvalidParameter("hash.range is empty")
        if fn == "range":
            return _div(F.shiftleft(v - F.lit(low), size.bit_length() - 1), high - low + 1)
        return _div(v - F.lit(low), (high - low + size) // size)
    if fn == "tpchorderkey":
        high = F.shiftright(v, 2).bitwiseAND(F.lit(~7))
        return high.bitwiseOR(v.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(mask))
    if fn == "tpchq1magic":  # of two one-letter columns: bit 2 of the first one's code, then bit 4 of it or bit 0 of the second one's
        a, b = F.ascii(value), F.ascii(more[0]) if more else F.lit(0)
        low = F.shiftright(a, 4).bitwiseOR(b).bitwiseAND(F.lit(1))
        return low.bitwiseOR(F.shiftright(a, 1).bitwiseAND(F.lit(2))).cast("long")
    if fn in ("willis", "bytes"):  # only placement shows, so any good hash will do
        return F.pmod(F.xxhash64(value, *more), F.lit(size))
    raise UnknownHash(str(fn))


def passes(spec: dict, n: int) -> list[dict]:
    """A parammodulo function as n ones over its bits from the highest down; the last takes what doesn't divide evenly."""
    if spec.get("fn") != "parammodulo":
        raise InvalidParameter("only parammodulo goes in passes")
    bits = buckets_of(spec).bit_length() - 1
    if not 1 <= n <= max(1, bits):
        raise InvalidParameter(f"{n} passes over {bits} bits")
    widths = [bits // n] * (n - 1) + [bits - bits // n * (n - 1)]
    skips = [int(spec.get("skipbits", 0)) + sum(widths[i + 1 :]) for i in range(n)]
    return [{**spec, "buckets": 1 << w, "skipbits": s} for w, s in zip(widths, skips)]


def _div(a: Column, b: int) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, F.lit(b).cast("long"))
