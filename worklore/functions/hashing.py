"""Content identities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _framed(col: Column) -> Column:
    text = col.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def content_id(*cols: Column) -> Column:
    """sha256 over length-framed values, so NULL, '' and joins never collide."""
    return F.sha2(F.concat(*[_framed(c) for c in cols]), 256)


def blob_id(content: Column, committed: Column) -> Column:
    """Object id of raw bytes, in the hash family of the committed id."""
    framed = F.concat(
        F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"),
        F.lit(b"\x00"),
        content,
    )
    return F.when(F.length(committed) == 40, F.sha1(framed)).otherwise(F.sha2(framed, 256))
