"""Shape-checked access to loosely structured JSON held as VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import patterns as P
from .textops import let


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def node(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _kind(value: Column) -> Column:
    """Type of a JSON value, without writing the value out: STRING, OBJECT<..., ARRAY<..., BIGINT, ..."""
    return F.schema_of_variant(value)


def _quoted(value: Column, kind: Column) -> Column:
    """Strings, and numbers beyond a double: their JSON form is "Infinity"."""
    return (kind == "STRING") | (kind == "DOUBLE") & F.to_json(value).startswith('"')


def first_char(value: Column) -> Column:
    """First character of the JSON form where it is a list, an object or a string; else null."""
    return let(
        _kind(value),
        lambda kind: F.when(_quoted(value, kind), '"').when(kind.startswith("OBJECT<"), "{").when(kind.startswith("ARRAY<"), "["),
    )


def is_object(value: Column) -> Column:
    return F.coalesce(_kind(value).startswith("OBJECT<"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(_kind(value).startswith("ARRAY<"), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(_quoted(value, _kind(value)), F.lit(False))


def string_at(value: Column, path: str) -> Column:
    """The field when it is a JSON string, else NULL."""
    return F.when(is_string(node(value, path)), F.try_variant_get(value, path, "string"))


def bool_at(value: Column, path: str) -> Column:
    return F.when(_kind(node(value, path)) == "BOOLEAN", F.try_variant_get(value, path, "boolean"))


def int_at(value: Column, path: str) -> Column:
    """The field when it is a JSON integer (not a boolean or a fraction)."""
    found, kind = node(value, path), _kind(node(value, path))
    whole = (kind == "BIGINT") | kind.startswith("DECIMAL") & F.to_json(found).rlike(r"^-?\d+$")
    return F.when(whole, F.try_variant_get(value, path, "bigint"))


def truthy(value: Column, path: str) -> Column:
    """JSON truth value: present and not null, false, 0, or empty."""
    text = F.to_json(node(value, path))
    return F.coalesce(~text.isin("null", "false", "0", '""', "[]", "{}"), F.lit(False))


def first_of(value: Column, getter, keys: Sequence[str]) -> Column:
    return F.coalesce(*[getter(value, "$." + key) for key in keys])


def as_mapping(value: Column) -> Column:
    """An object as itself, or the object encoded in a JSON string."""

    def choose(v: Column) -> Column:
        decoded = F.try_parse_json(F.try_variant_get(v, "$", "string"))
        return F.when(is_object(v), v).when(
            is_string(v), let(decoded, lambda d: F.when(is_object(d), d))
        )

    return let(value, choose)


def _nesting(value: Column) -> Column:
    """How deep lists and objects lie in one another."""
    plain = F.regexp_replace(F.regexp_replace(F.to_json(value), r"\\.", ""), r'"[^"]*"', "")
    marks = F.regexp_replace(plain, r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(marks, ""), lambda m: m != ""), start, step, lambda state: state["most"])


def _opened(value: Column) -> Column:
    """A list as its elements, a typed text part as what it holds, a string as itself."""

    def by_kind(kind: Column) -> Column:
        typed = F.coalesce(F.try_variant_get(value, "$.type", "string").isin(P.TEXT_PARTS), F.lit(False))
        inner = F.coalesce(node(value, "$.text"), node(value, "$.content"))
        return (
            F.when(kind == "[", F.try_variant_get(value, "$", "array<variant>"))
            .when((kind == "{") & typed, F.array(inner))
            .when(kind == '"', F.array(value))
        )

    none = F.filter(F.array(value), lambda _: F.lit(False))
    return F.coalesce(let(first_char(value), by_kind), none)


def _walked(value: Column) -> Column:
    """Open all values of a list in place, once per level that the value has."""
    levels = F.sequence(F.lit(1), F.greatest(_nesting(value), F.lit(1)))
    leaves = F.aggregate(levels, F.array(value), lambda held, _: F.flatten(F.transform(held, _opened)))
    texts = F.transform(F.filter(leaves, is_string), lambda v: F.try_variant_get(v, "$", "string"))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def flat_text(value: Column) -> Column:
    """Depth-first text of strings, lists and typed text parts at any depth, newline-joined."""
    return F.coalesce(
        let(value, lambda v: F.when(is_string(v), F.try_variant_get(v, "$", "string")).otherwise(_walked(v))), F.lit("")
    )


def has_shape(value: Column, path: str, openers: str) -> Column:
    return F.coalesce(first_char(node(value, path)).isin(*openers), F.lit(False))


def observed(data: Column) -> dict[str, Column]:
    """Execution facts in a mapping (see `as_mapping`; bind it to a column first)."""
    command = F.coalesce(
        *[
            F.when(has_shape(data, "$." + k, '"['), F.try_variant_get(data, "$." + k, "string"))
            for k in ("command", "cmd")
        ]
    )
    argv = F.coalesce(
        *[
            F.when(has_shape(data, "$." + k, "["), F.try_variant_get(data, "$." + k, "array<string>"))
            for k in ("command", "cmd")
        ]
    )
    return {
        "command": command,
        "command_argv": argv,
        "exit_status": first_of(data, int_at, ["exit_code", "exitCode", "exit_status"]),
        "revision": first_of(data, string_at, ["revision", "commit_hash", "sha"]),
        "branch": string_at(data, "$.branch"),
        "dirty": bool_at(data, "$.dirty"),
    }
