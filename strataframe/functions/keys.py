"""Typed sample keys. An integer 12 is stored as ``#12`` and the string ``12`` as itself, so they stay different keys
and compare and sort as plain strings (bytewise: ``#10`` < ``#2`` < ``a``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal string keys, column and branch names.
LEGAL = r"[A-Za-z0-9_.\-]{1,64}"
_LEGAL = re.compile(LEGAL, re.ASCII)

Key = int | str


def is_legal_key(key: object) -> bool:
    """Integers from 0 up, and strings of 1 to 64 ASCII letters, digits, ``_``, ``.`` and ``-``."""
    if isinstance(key, int):
        return key >= 0 and len(str(int(key))) <= 64
    return isinstance(key, str) and bool(_LEGAL.fullmatch(key))


def is_ascii(text: str) -> bool:
    return isinstance(text, str) and text.isascii()


def encode_key(key: Key) -> str:
    if not is_legal_key(key):
        raise ValueError(f"{key!r} is no sample key: it must be an integer from 0 up or match {LEGAL}")
    return f"#{int(key)}" if isinstance(key, int) else key


def decode_key(stored: str) -> Key:
    return int(stored[1:]) if stored.startswith("#") else stored


def check_name(name: object, what: str) -> str:
    """A legal column or branch name; ValueError otherwise."""
    if not (isinstance(name, str) and is_legal_key(name)):
        raise ValueError(f"{name!r} is no {what} name: it must match {LEGAL}")
    return name


def encoded(column: Column, integer: bool) -> Column:
    """Stored form of a column of keys."""
    return F.concat(F.lit("#"), column.cast("string")) if integer else column.cast("string")


def decoded_int(stored: Column) -> Column:
    """The integer of an integer key, null for a string key."""
    return F.when(stored.startswith("#"), F.substr(stored, F.lit(2)).cast("long"))


def legal(column: Column, integer: bool = False) -> Column:
    return (column >= 0) if integer else F.coalesce(column.rlike(f"^{LEGAL}\\z"), F.lit(False))
