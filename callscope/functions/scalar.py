"""Scalar column expressions (B1, B3, I1, I3, I4, I5, I7, I9, hash draws)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions.fixed_values import FALSE_STRINGS, TRUE_STRINGS

__all__ = [
    "col_", "file_name", "file_stem", "file_ext", "k_of_group", "occurrences",
    "uniform_hash", "softmax_at", "softmax", "argmax", "parse_bool", "linspace_point",
    "speaker_tag", "round_half_even",
]


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- B1: path parts ----------------------------------------------------------
def file_name(path: str | Column) -> Column:
    return F.substring_index(col_(path), "/", -1)


def file_ext(path: str | Column) -> Column:
    name = file_name(path)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def file_stem(path: str | Column) -> Column:
    name = file_name(path)
    return F.when(F.instr(name, ".") > 0,
                  F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)


# --- B3: membership with the k-of-group rule ----------------------------------
def k_of_group(arr: str | Column, flat: Sequence[str], groups: Sequence[Sequence[str]] = (),
               k: int = 2) -> Column:
    """True if any element is one of ``flat``, or at least ``k`` elements
    (duplicates counted) fall into the same group."""
    a = col_(arr)
    out = F.lit(False)
    if flat:
        out = F.coalesce(F.arrays_overlap(a, F.array(*[F.lit(x) for x in flat])), F.lit(False))
    for g in groups:
        garr = F.array(*[F.lit(x) for x in g])
        hits = F.size(F.filter(a, lambda x: F.coalesce(F.array_contains(garr, x), F.lit(False))))
        out = out | (hits >= k)
    return F.when(a.isNull(), F.lit(None).cast("boolean")).otherwise(out)


# --- I1: non-overlapping occurrence count ----------------------------------------
def occurrences(text: str | Column, word: str | Column, regex: bool = False) -> Column:
    """Non-overlapping left-to-right occurrences of ``word`` in ``text``.

    Literal by default; ``regex=True`` treats the word as a regular expression.
    """
    t, w = col_(text), (F.lit(word) if isinstance(word, str) else word)
    if not regex:  # quote the word (as java.util.regex.Pattern.quote does)
        w = F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    # a regex scan counts without materialising a replaced copy of the text
    return F.regexp_count(t, w).cast("long")


# --- seeded uniform draw, reproducible in any SQL engine with md5 ---------------
def uniform_hash(seed: int | str | Column, key: str | Column) -> Column:
    """u in [0, 1) from the first 52 bits of md5('<seed>:<key>')."""
    s = F.lit(str(seed)) if isinstance(seed, (int, str)) else seed.cast("string")
    digest = F.md5(F.concat(s, F.lit(":"), col_(key).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


# --- I3 / I4: softmax and argmax over an array of logits ------------------------
def softmax(arr: str | Column) -> Column:
    a = col_(arr).cast("array<double>")
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def softmax_at(arr: str | Column, k: int) -> Column:
    return F.get(softmax(arr), k)


def argmax(arr: str | Column) -> Column:
    a = col_(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


# --- I7: string -> boolean ------------------------------------------------------
def parse_bool(s: str | Column, on_invalid: str = "raise") -> Column:
    low = F.lower(F.trim(col_(s)))
    bad = (F.raise_error(F.concat(F.lit("Boolean value expected: "), col_(s)))
           if on_invalid == "raise" else F.lit(None))
    return (F.when(low.isin(*TRUE_STRINGS), F.lit(True))
            .when(low.isin(*FALSE_STRINGS), F.lit(False))
            .otherwise(bad.cast("boolean")))


# --- I9: linspace point j of n over [lo, hi] ------------------------------------
def linspace_point(j: str | Column, n: int, lo: float = 0.0, hi: float = 1.0) -> Column:
    step = (hi - lo) / (n - 1)
    jj = col_(j)
    return F.when(jj == n - 1, F.lit(hi)).otherwise(F.lit(lo) + jj * F.lit(step))


# --- C2: speaker tag ---------------------------------------------------------------
def speaker_tag(speaker: str | Column, text: str | Column) -> Column:
    return F.concat(F.lit("[SPK"), col_(speaker).cast("string"), F.lit("] "), col_(text))


# --- I5: rounding like numpy/Python (half to even) ------------------------------------
def round_half_even(c: str | Column, digits: int) -> Column:
    return F.bround(col_(c), digits)
