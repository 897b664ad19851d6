"""Functions that need Python's Unicode tables or sequence matcher, as Arrow-batched UDFs."""

from __future__ import annotations

import difflib
import functools
import gzip
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed form without surrounding white space; null and empty are empty."""
    return text.map(lambda x: unicodedata.normalize("NFC", x).strip() if x else "")


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x.casefold() if x else "")


@functools.lru_cache(1 << 16)  # the same tags come again and again
def _alias(tag: str | None) -> str:
    letters = unicodedata.normalize("NFKD", unicodedata.normalize("NFC", tag or "").strip().casefold())
    return re.sub(r"[\s\-_]+", " ", "".join(c for c in letters if not unicodedata.combining(c))).strip()


@F.pandas_udf(T.StringType())
def tag_alias(tag: pd.Series) -> pd.Series:
    """Folded tag without accents, with runs of space, hyphen and underscore as one space."""
    return tag.map(_alias)


@F.arrow_udf(T.ArrayType(T.StringType()))
def tag_aliases(tags: pa.Array) -> pa.Array:
    """The aliases of a row's tags, in order."""
    none = tags.is_null().to_numpy(zero_copy_only=False)
    ends = np.cumsum(tags.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int32)
    starts = pa.array(np.concatenate([[0], ends]), pa.int32(), mask=np.append(none, False))
    return pa.ListArray.from_arrays(starts, pa.array([_alias(x) for x in tags.flatten().to_pylist()], pa.string()))


@F.pandas_udf(T.StringType())
def slug(text: pd.Series) -> pd.Series:
    def plain(x: str | None) -> str:
        ascii_ = unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode().lower()
        return re.sub(r"[-\s]+", "_", re.sub(r"[^\w\s-]", "", ascii_)).strip("_")

    return text.map(plain)


def _alnum(text: str | None) -> str:
    return "".join(c.lower() for c in text or "" if c.isalnum())


def ratio(a: str | None, b: str | None) -> float:
    """Similarity of the letters and digits of two texts; the order of the arguments matters."""
    a, b = _alnum(a), _alnum(b)
    if not a or not b:
        return 0.0
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.StringType())
def alnum(text: pd.Series) -> pd.Series:
    """The letters and digits that a similarity is counted on."""
    return text.map(_alnum)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in seen:
            seen[pair] = ratio(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype=float)


@F.pandas_udf(T.StringType())
def gunzip(data: pd.Series) -> pd.Series:
    """Text of gzipped bytes; null where they aren't that."""

    def text(x: bytes | None) -> str | None:
        try:
            return gzip.decompress(x).decode() if x else None
        except (OSError, EOFError, UnicodeDecodeError):
            return None

    return data.map(text)


@F.pandas_udf(T.BinaryType())
def gzipped(text: pd.Series) -> pd.Series:
    return text.map(lambda x: gzip.compress(x.encode(), mtime=0) if x is not None else None)
