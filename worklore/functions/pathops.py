"""Path expressions and glob translation."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def file_glob(pattern: str) -> str:
    """Shell-style glob as an anchored regex; `*` also crosses directories."""
    out = ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return "(?s)^" + out + "$"


def segment_glob(pattern: str) -> str:
    """Glob over `/` separated segments where `**` spans any number of them."""
    regex = ""
    parts = pattern.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            regex += r"(?:[^/]+(?:/[^/]+)*)?" if last else r"(?:[^/]+/)*"
            continue
        body = file_glob(part)[len("(?s)^"):-1].replace(".*", "[^/]*")
        regex += body + ("" if last else "(?:/|$)" if parts[i + 1 :] == ["**"] else "/")
    return "(?s)^" + regex + "$"


def ancestors(path: Column) -> Column:
    """The path itself and every enclosing directory, for absolute paths."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    nested = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )
    return F.when(F.size(parts) > 0, F.array_append(nested, F.lit("/"))).otherwise(
        F.array(F.lit("/"))
    )


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# What is refused or tidied; an absolute path with none of it is clean as it is.
_UNCLEAN = r"//|/\./|(?<=.)/\.?$|[\x00-\x1f\x7f\[]|(?:^|/)\.\.(?:/|$)"


def _clean(path: Column) -> Column:
    bare = F.regexp_replace(path, r"^file:(?://)?(?=/)", "")
    bare = F.when(path.startswith("file:"), F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))).otherwise(path)
    tidy = F.regexp_replace(F.regexp_replace(bare, r"/(?:\./)*(?:/(?:\./)*)*", "/"), r"(?<=.)/\.?$", "")
    bad = bare.rlike(r"[\x00-\x1f\x7f\[]") | bare.rlike(r"(?:^|/)\.\.(?:/|$)")
    whole = F.when(bare.startswith("/") & ~bad & (F.length(bare) <= 4096), tidy)
    return F.when(path.startswith("/") & (F.length(path) <= 4096) & ~path.rlike(_UNCLEAN), path).otherwise(whole)


def clean_absolute(path: Column) -> Column:
    """An absolute path without parent steps, control characters or '[', else NULL."""
    # The rules mention the path many times; inside a lambda it is computed once.
    return F.get(F.transform(F.array(path), _clean), F.lit(0))
