"""Column builders for words, lines and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters with the Unicode property White_Space, as a class that every regex engine reads alike.
SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def words(text: Column) -> Column:
    """The words of a text, separated by any white space; an empty array for a blank text, null for null."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def before_tab(line: Column) -> Column:
    """What is before the first tab; null where there is none."""
    return F.when(F.contains(line, F.lit("\t")), F.substring_index(line, "\t", 1))


def after_tab(line: Column) -> Column:
    """What is after the first tab, later tabs included; null where there is none."""
    return F.when(F.contains(line, F.lit("\t")), F.substring(line, F.locate("\t", line) + F.lit(1), F.length(line)))


def number(c: Column, largest: int) -> Column:
    """ASCII digits, optionally after one ``+``, of at most ``largest``, as BIGINT; null for anything else."""
    digits = F.regexp_replace(c, r"\A\+?0*(?=[0-9])", "")
    value = F.when(c.rlike(r"\A\+?[0-9]+\z") & (F.length(digits) <= 19), digits.try_cast("bigint"))
    return F.when(value <= largest, value)


def hash_xx(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def hash_md5(key: Column, buckets: int) -> Column:
    """A bucket from the first 32 bits of MD5: slower than ``hash_xx``, the same in every SQL engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets


HASHES: dict[str, Callable[[Column, int], Column]] = {"xx": hash_xx, "md5": hash_md5}
