"""32-bit object ids: unsigned BIGINT columns, signed decimal text and lower-case hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 4294967295
_HALF, _WHOLE = 2147483648, 4294967296


def signed_text_to_hex(text: Column) -> Column:
    """'-470607587' to 'e3f3191d'; no padding; text that is no number gives '0'."""
    return F.lower(F.hex(F.coalesce(text.try_cast("bigint"), F.lit(0)).bitwiseAND(F.lit(_MASK))))


def hex_to_unsigned(text: Column) -> Column:
    """Null unless the text is 1 to 8 hex digits."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,8}$"), F.conv(text, 16, 10).cast("bigint"))


def hex_to_signed(text: Column) -> Column:
    """Bad hex gives 0; only eight digits with the top bit set wrap round."""
    v = F.coalesce(hex_to_unsigned(text), F.lit(0).cast("bigint"))
    return F.when((F.length(text) == 8) & (v >= _HALF), v - _WHOLE).otherwise(v)


def to_signed(v: Column) -> Column:
    return F.when(v >= _HALF, v - _WHOLE).otherwise(v)


def to_unsigned(v: Column) -> Column:
    return v.bitwiseAND(F.lit(_MASK))


def flag_type(word: Column, bit: Column, type_: Column) -> Column:
    """The type of an optional parameter: word.bit?type."""
    return F.concat(word, F.lit("."), bit.cast("string"), F.lit("?"), type_)


def bit_of_mask(n: Column) -> Column:
    """Index of the one bit set in n; null if n is not a power of two."""
    one = (n > 0) & (n.bitwiseAND(n - 1) == 0)
    return F.when(one, F.length(F.bin(n)) - 1).cast("int")


def is_placeholder(v: Column) -> Column:
    """The three upper bytes are equal."""
    byte = lambda k: F.shiftright(v, k).bitwiseAND(F.lit(255))
    return (byte(24) == byte(16)) & (byte(16) == byte(8))
