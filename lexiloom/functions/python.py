"""Functions that Spark's built-ins cannot express, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSETS = re.compile(r"\w+|[^\w\s]")


def ascii_fold(column: str) -> Column:
    """Canonically decomposed, without combining marks and what is not ASCII."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if c.isascii()), na_action="ignore")

    return run(F.col(column))


def token_offsets(column: str) -> Column:
    """Words and marks with their places."""

    @F.pandas_udf("array<struct<token:string,start:int,stop:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"token": m[0], "start": m.start(), "stop": m.end()} for m in _OFFSETS.finditer(t)] if t is not None else [])

    return run(F.col(column))


def split_recursively(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Parts of at most ``size`` characters, cut at the coarsest separator that does."""
    if len(text) <= size:
        return [text] if text else []
    for i, sep in enumerate(separators):
        if sep and sep in text:
            out: list[str] = []
            for piece in text.split(sep):
                if not piece:
                    continue
                if len(piece) > size:
                    out += split_recursively(piece, size, separators[i + 1 :])
                elif out and len(out[-1]) + len(sep) + len(piece) <= size:
                    out[-1] += sep + piece
                else:
                    out.append(piece)
            return out
    return [text[i : i + size] for i in range(0, len(text), size)]


def recursive_chunks(column: str, size: int, overlap: int) -> Column:
    """Chunks of at most ``size`` characters at natural borders; each but the first opens with the last ``overlap`` characters, from a blank on, of the one before."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            parts = split_recursively(text or "", size - overlap)
            out = parts[:1]
            for before, part in zip(parts, parts[1:], strict=False):
                tail = before[-overlap:] if overlap else ""
                out.append((tail[tail.find(" ") + 1 :] + " " + part) if tail else part)
            return out

        return s.map(one)

    return run(F.col(column))
