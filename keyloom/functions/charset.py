"""Bytes to text: a guess of the encoding, US-ASCII where nothing else fits."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def guess(raw: bytes | None) -> str | None:
    """UTF-8 if the bytes are well-formed and not all ASCII, by byte order mark if there is one, Latin-1 if letters prevail among the high bytes, else US-ASCII."""
    if raw is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if raw.startswith(mark):
            return name
    if raw.isascii():
        return "US-ASCII"
    try:
        raw.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        high = [b for b in raw if b > 127]
        return "ISO-8859-1" if sum(b >= 0xC0 for b in high) * 2 >= len(high) else "US-ASCII"


def _guesses(raw: pd.Series) -> pd.Series:
    return raw.map(guess)


def _texts(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else b.decode(guess(b), "replace"))


def guess_charset(raw: Column | str) -> Column:
    return F.pandas_udf(_guesses, StringType())(raw)


def decoded(raw: Column | str) -> Column:
    """The text of binary contents in the guessed encoding; undecodable bytes become replacement characters."""
    return F.pandas_udf(_texts, StringType())(raw)
