"""Weights and measures as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def tfidf(tf: Column, df: Column, n: Column, log_tf: bool = True) -> Column:
    """(1 + log10 tf) or tf, times log10(n / df)."""
    return ((F.lit(1.0) + F.log10(tf)) if log_tf else tf.cast("double")) * F.log10(n / df)


def idf(df: Column, n: Column, kind: str = "log") -> Column:
    """log: log10(n / df); smooth: 1 + log10(n / (df + 1)); inverse: 1 / df."""
    return {"log": lambda: F.log10(n / df), "smooth": lambda: 1 + F.log10(n / (df + 1)), "inverse": lambda: F.lit(1.0) / df}[kind]()


def mutual_information(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """In bits over a 2 x 2 table; an empty cell counts 0."""
    n = n11 + n10 + n01 + n00

    def cell(x: Column, row: Column, col: Column) -> Column:
        x, row, col = (c.cast("double") for c in (x, row, col))
        return F.when(x > 0, x / n * F.log2(n * x / (row * col))).otherwise(0.0)

    return cell(n11, n11 + n10, n11 + n01) + cell(n01, n01 + n00, n11 + n01) + cell(n10, n11 + n10, n10 + n00) + cell(n00, n01 + n00, n10 + n00)


def chi_square(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Of a 2 x 2 table; null if a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (n11, n10, n01, n00))
    margins = (a + c) * (a + b) * (b + d) * (c + d)
    return (a + b + c + d) * F.pow(a * d - b * c, F.lit(2.0)) / F.nullif(margins, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """-1 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(-1.0)).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))


def discount(rank: Column) -> Column:
    """1 at rank 1, then log2(rank)."""
    return F.when(rank <= 1, F.lit(1.0)).otherwise(F.log2(rank.cast("double")))


def t_cdf_two_sided(t: float, dof: int) -> float:
    """P(|T| >= |t|) of Student's distribution, by the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    a, b = dof / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x >= (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def unpack_bits(x: Column, shift: int, bits: int) -> Column:
    return F.shiftright(x, shift).bitwiseAND((1 << bits) - 1)


def big_endian(data: Column) -> Column:
    """A binary of up to 7 bytes as an unsigned number."""
    return F.conv(F.hex(data), 16, 10).cast("long")


def to_big_endian(n: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2 * size, "0"))


def ipv4(text: Column) -> Column:
    """A dotted IPv4 address as a number."""
    p = F.split(text, r"\.")
    return sum((p[i].cast("long") * (1 << 8 * (3 - i)) for i in range(1, 4)), p[0].cast("long") * (1 << 24))


def common_prefix(a: Column, b: Column, plen_a: Column | int = 32, plen_b: Column | int = 32) -> Column:
    """The length of the longest common IPv4 prefix, at most that of either operand."""
    x = a.bitwiseXOR(b)
    same = F.when(x == 0, 32).otherwise(32 - F.length(F.bin(x)))
    return F.least(same, *[p if isinstance(p, Column) else F.lit(p) for p in (plen_a, plen_b)])
