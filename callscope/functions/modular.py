"""Arithmetic on wrapping counters: 16-bit sequence numbers and 32-bit media timestamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ahead16(a: Column | str, b: Column | str) -> Column:
    """Steps from b forward to a, modulo 2^16."""
    return F.pmod(_c(a).cast("long") - _c(b).cast("long"), F.lit(65536))


def signed16(a: Column | str, b: Column | str) -> Column:
    """a - b as the nearest signed distance on the 16-bit circle."""
    return F.pmod(_c(a).cast("long") - _c(b).cast("long") + 32768, F.lit(65536)) - 32768


def signed32(a: Column | str, b: Column | str) -> Column:
    """a - b as the nearest signed distance on the 32-bit circle."""
    return F.pmod(_c(a).cast("long") - _c(b).cast("long") + 2147483648, F.lit(4294967296)) - 2147483648
