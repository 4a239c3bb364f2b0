"""Redaction of whole tables by the names of their fields, at any depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from sessionloom.functions import text as T


def project_name(name: Column) -> Column:
    """A project's name, the last part of it where it is a path."""
    return T.redact_value(T.stripped(name))


def bucket_key(key: Column) -> Column:
    """``name=value`` parts between bars, the value of ``project`` as a project's name."""
    part = lambda p: F.when(p.startswith("project="), F.concat(F.lit("project="), project_name(F.substr(p, F.lit(9))))).otherwise(p)
    return F.array_join(F.transform(F.split(key, "\\|"), part), "|")


def blank(_: Column) -> Column:
    return F.lit("")


#: What becomes of a text, or of each text of a list, by the field's name; lists that are blanked are emptied (fixed values).
RULES: dict[str, Callable[[Column], Column]] = {
    **{name: blank for name in ("path", "bundle_path", "store_path", "history_file", "session_paths", "claude_roots", "codex_roots", "trae_roots")},
    **{name: project_name for name in ("project", "top_project")},
    **{name: T.redact_text for name in ("confidence_reasons", "project_attribution_reasons", "role_reasons", "notes", "errors", "evidence")},
    "command": T.redact_command, "key": bucket_key,
}


def rewritten(value: Column, kind: DataType, name: str, rules: dict[str, Callable[[Column], Column]]) -> Column:
    rule = rules.get(name)
    if isinstance(kind, StringType):
        return value if rule is None else F.when(value.isNotNull(), rule(value))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        return value if rule is None else F.when(value.isNotNull(), F.array().cast(kind) if rule is blank else F.transform(value, rule))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.transform(value, lambda x: rewritten(x, kind.elementType, name, rules))
    if isinstance(kind, StructType):
        fields = [rewritten(value[f.name], f.dataType, f.name, rules).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redacted(table: DataFrame, rules: dict[str, Callable[[Column], Column]] = RULES) -> DataFrame:
    """``table`` with every text that a rule names rewritten, in structs and lists of structs at any depth; the schema stays.

    Texts that no rule names, numbers and maps pass through; nulls stay null; empty lists and tables stay empty.
    """
    return table.select(*[rewritten(F.col(f"`{f.name}`"), f.dataType, f.name, rules).alias(f.name) for f in table.schema.fields])
