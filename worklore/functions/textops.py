"""Text expressions: redaction, prose clean-up, topic keys, word sets, escaping.

All functions map columns to columns and stay inside built-in expressions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, functions as F

from . import patterns as P


def let(value: Column, body) -> Column:
    """Bind a computed value once and use it several times in an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gathered(entries: Column, start: Column, step, gathers: str, block: int = 64) -> Column:
    """Fold over an array with a struct state of which one field gathers an array.

    Appending copies what was gathered, so each block of entries gathers for
    itself and whole blocks are put together: close to linear in long arrays.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(entries), F.lit(1)) - 1) / block).cast("int")),
        lambda k: F.slice(entries, k * block + 1, F.lit(block)),
    )
    none = F.filter(F.array(start[gathers]), lambda _: F.lit(False))

    def one(state: Column, entries_: Column) -> Column:
        done = F.aggregate(entries_, state["carry"], step)
        return let(
            done,
            lambda d: F.struct(
                d.withField(gathers, start[gathers]).alias("carry"), F.array_append(state["done"], d[gathers]).alias("done")
            ),
        )

    return F.aggregate(blocks, F.struct(start.alias("carry"), none.alias("done")), one, lambda s: F.flatten(s["done"]))


def matches(col: Column, pattern: str) -> Column:
    """Case-insensitive Unicode search; NULL text never matches."""
    return F.coalesce(col.rlike(P.ci(pattern)), F.lit(False))


def matches_cs(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike(P.cs(pattern)), F.lit(False))


def truncate(col: Column, limit: int) -> Column:
    kept = max(0, limit - P.TRUNCATION_RESERVE)
    return F.when(
        F.length(col) > limit, F.concat(F.substring(col, 1, kept), F.lit(P.TRUNCATION_MARK))
    ).otherwise(col)


def redact(
    col: Column, limit: int | None = P.MAX_EXCERPT, extra_patterns: Sequence[str] = ()
) -> Column:
    """Strip terminal/control codes and replace secrets, then bound the length."""
    out = F.regexp_replace(F.regexp_replace(col, P.ANSI, ""), P.CONTROLS, "")
    for pattern in [*P.SECRETS, *extra_patterns]:
        out = F.regexp_replace(out, pattern, P.REDACTED)
    return out if limit is None else truncate(out, limit)


def prose(col: Column) -> Column:
    """Drop link targets, emphasis and code ticks; collapse whitespace."""
    labels = F.regexp_replace(col, r"\[([^\]]+)\]\([^)]*\)", "$1")
    bare = F.replace(F.replace(labels, F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))
    return F.btrim(F.regexp_replace(bare, r"(?U)\s+", " "))


def strip_ws(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def fold_marker(col: Column) -> Column:
    """Upper-case with the dotted capital I folded to the ASCII letter."""
    return F.replace(F.upper(col), F.lit("İ"), F.lit("I"))


def casefold(col: Column) -> Column:
    lowered = F.replace(F.lower(col), F.lit("\u0307"), F.lit(""))
    return F.replace(lowered, F.lit("ß"), F.lit("ss"))


def is_conversational(col: Column) -> Column:
    return matches(col, P.CONVERSATION)


def is_blocked(col: Column) -> Column:
    return matches(F.regexp_replace(col, P.ci(P.NOT_BLOCKED), ""), P.BLOCKED)


def _named_subject(text: Column) -> Column:
    """`verify: subject` style forms of a cleaned subject."""
    keyed = F.when(F.lit(False), text)
    for verb, endings in P.TOPIC_TURKISH_ENDINGS:
        for ending in endings:
            subject = F.substr(text, F.lit(1), F.length(text) - (len(ending) + 1))
            if ending in P.TOPIC_TURKISH_VERBS:
                subject = F.regexp_replace(subject, P.cs(P.TOPIC_TURKISH_OBJECT), "")
            keyed = keyed.when(text.endswith(" " + ending), F.concat(F.lit(verb + ":"), subject))
    for verb, noun in P.TOPIC_FORMS:
        for lead in (noun + " of ", verb + " "):
            rest = F.regexp_replace(F.substr(text, F.lit(len(lead) + 1)), r"(?U)^the\s+", "")
            keyed = keyed.when(text.startswith(lead), F.concat(F.lit(verb + ":"), rest))
        subject = F.substr(text, F.lit(1), F.length(text) - (len(noun) + 1))
        keyed = keyed.when(text.endswith(" " + noun), F.concat(F.lit(verb + ":"), subject))
    return keyed.otherwise(text)


def topic_key(col: Column) -> Column:
    """Explicit-subject key: equal keys mean the same named subject."""
    text = F.btrim(casefold(prose(col)), F.lit(" .!?\"'"))
    text = F.regexp_replace(text, P.cs(P.TOPIC_LEAD), "")
    text = F.btrim(F.regexp_replace(text, P.cs(P.TOPIC_TAIL), ""), F.lit(" .!?"))
    signed = let(
        text,
        lambda t: F.when(matches_cs(t, P.TOPIC_SIGNATURE), P.TOPIC_SIGNATURE_VALUE).otherwise(t),
    )
    return let(signed, _named_subject)


def content_words(col: Column) -> Column:
    """Distinct words of three or more letters, without the stop words."""
    words = F.regexp_extract_all(F.lower(col), F.lit(r"(?U)([^\W\d_]{3,})"), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(w) for w in P.STOP_WORDS]))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Accented letter -> base letter, derived from canonical decomposition."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)
        if len(base) > 1 and len(letter.lower()) == 1 and letter == letter.lower():
            source.append(letter)
            target.append(base[0])
    return "".join(source), "".join(target)


def fold_accents(col: Column) -> Column:
    source, target = _accent_table()
    return F.regexp_replace(F.translate(F.lower(col), source, target), r"\p{Mn}+", "")


def search_tokens(col: Column) -> Column:
    """Letter/digit runs of the accent-folded text, in order."""
    return F.regexp_extract_all(
        fold_accents(col), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1)
    )


def markdown_escape(col: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(col, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    out = F.regexp_replace(F.regexp_replace(out, "\n", " ↵ "), "\r", "")
    return F.regexp_replace(out, r"([\\`*_{}\[\]()#+!|])", r"\\$1")
