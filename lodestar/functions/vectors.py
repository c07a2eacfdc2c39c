"""Vector functions on ``array<float>`` columns. Sums are taken in double, so that engines agree to six digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_col(v), lambda x: x.cast("double") * x.cast("double"))))


def normalize(v: Column | str) -> Column:
    """v divided by its length plus 1e-12, so that a zero vector stays zero."""
    n = norm(v) + F.lit(1e-12)
    return F.transform(_col(v), lambda x: (x.cast("double") / n).cast("float"))


def shorten(v: Column | str, dim: int) -> Column:
    """The first ``dim`` values, normalised again."""
    return normalize(F.slice(_col(v), 1, dim))


def sign_code(v: Column | str) -> Column:
    """Sign bits as ``array<bigint>``, 64 to a word, lowest bit first; only values above zero are set."""
    v = _col(v)
    words = F.sequence(F.lit(0), F.ceil(F.size(v) / 64).cast("int") - 1)

    def word(w: Column) -> Column:
        part = F.slice(v, w * 64 + 1, 64)
        return F.aggregate(
            F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x),
        )

    return F.transform(words, word)


def bit_at(code: Column | str, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.element_at(_col(code), (F.floor(i / 64) + 1).cast("int")), (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))


def code_dot(code: Column | str, q: Column | str) -> Column:
    """Sum of the query's values, each with the sign of its bit: twice those of set bits less the sum of all."""
    q = _col(q)
    return _sum(F.transform(q, lambda y, i: F.when(bit_at(code, i) == 1, y.cast("double")).otherwise(-y.cast("double"))))


def nibbles(code: Column | str, dim: int) -> Column:
    """The code four bits at a time, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim // 4 - 1)), lambda g: F.call_function("shiftrightunsigned", F.element_at(_col(code), (F.floor(g / 16) + 1).cast("int")), ((g % 16) * 4).cast("int")).bitwiseAND(F.lit(15).cast("long")).cast("int"))


def lookup_table(q: Column | str) -> Column:
    """For each four values of a query the signed sum of each of 16 patterns: ``table[16 * group + pattern]``."""
    q = _col(q)
    groups = F.sequence(F.lit(0), F.floor(F.size(q) / 4).cast("int") - 1)
    signed = lambda g, j, p: F.when(F.pmod(F.floor(p / (1 << j)), F.lit(2)) == 1, F.element_at(q, g * 4 + j + 1).cast("double")).otherwise(-F.element_at(q, g * 4 + j + 1).cast("double"))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: signed(g, 0, p) + signed(g, 1, p) + signed(g, 2, p) + signed(g, 3, p))))


def lookup_score(code_nibbles: Column | str, table: Column | str) -> Column:
    return _sum(F.transform(_col(code_nibbles), lambda n, g: F.element_at(_col(table), g * 16 + n + 1)))


def is_finite(v: Column | str) -> Column:
    bad = F.exists(_col(v), lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return ~F.coalesce(bad, F.lit(True))


def checked(v: Column | str, dim: int | None = None) -> Column:
    """The vector itself; an error where it is not finite or not of the dimension asked for."""
    v = _col(v)
    ok = is_finite(v) if dim is None else is_finite(v) & (F.size(v) == dim)
    return F.when(ok, v).otherwise(F.raise_error(F.lit("vector is not finite or has the wrong dimension")).cast("array<float>"))
