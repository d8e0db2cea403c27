"""Cutting texts into chunks of bounded size, at paragraph, line or word ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmill.functions.text import strip

MAX_CHARS = 24_000


def chunk_text(text: str | None, most: int = MAX_CHARS) -> list[str]:
    """Stripped, non-empty pieces of at most ``most`` characters.

    A cut falls at the last blank line, else line end, else space before the limit, if that leaves at least half of
    the limit; otherwise at the limit itself.
    """
    out, rest = [], text or ""
    while len(rest) > most:
        places = (rest.rfind(mark, 0, most) for mark in ("\n\n", "\n", " "))
        at = next((p for p in places if p >= most // 2), most)
        out.append(rest[:at].strip())
        rest = rest[at:]
    return [x for x in [*out, rest.strip()] if x]


def chunked(text: Column, most: int = MAX_CHARS) -> Column:
    """``chunk_text`` of a column; texts within the limit never leave the JVM's expressions."""

    @F.pandas_udf("array<string>")
    def long(texts: pd.Series) -> pd.Series:
        return pd.Series([chunk_text(t, most) for t in texts])

    short = F.filter(F.array(strip(F.coalesce(text, F.lit("")))), lambda x: x != "")
    return F.when(F.length(text) > most, long(F.when(F.length(text) > most, text))).otherwise(short)
