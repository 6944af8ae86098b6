"""Name normalisation and keyword classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spoor.constants import ID_PREFIXES


def nz(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.when(c != "", c)


def normalize_name(c: Column) -> Column:
    """CamelCase, spaces and hyphens to one lower_snake form."""
    spaced = F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    spaced = F.regexp_replace(spaced, r"([a-z\d])([A-Z])", "$1_$2")
    flat = F.translate(F.lower(spaced), " -", "__")
    return F.regexp_replace(F.regexp_replace(flat, "_+", "_"), "^_|_$", "")


def strip_prefixes(c: Column, prefixes: list[str] = ID_PREFIXES) -> Column:
    for p in prefixes:
        c = F.replace(c, F.lit(p), F.lit(""))
    return c


def agent_id(name: Column) -> Column:
    return F.concat(F.lit("agent_"), normalize_name(name))


def capability_id(class_name: Column, kind: Column) -> Column:
    return F.concat(F.lit("cap_"), class_name, F.lit("_"), kind)


def _friendly(name: Column) -> Column:
    return F.translate(F.lower(name), " ()", "_")


def data_store_id(name: Column) -> Column:
    return F.concat(F.lit("ds_"), _friendly(name))


def external_id(name: Column) -> Column:
    return F.concat(F.lit("ext_"), _friendly(name))


def runtime_id(framework: Column, class_name: Column, source_file: Column, line: Column) -> Column:
    return F.concat_ws(":", framework, class_name, source_file, line.cast("string"))


def keyword_classes(c: Column, table: dict[str, list[str]], default: str) -> Column:
    """Sorted array of classes with a keyword contained in the lower-cased text."""
    low = F.lower(c)
    hits = []
    for cls in sorted(table):
        any_kw = F.lit(False)
        for kw in table[cls]:
            any_kw = any_kw | low.contains(kw)
        hits.append(F.when(any_kw, F.lit(cls)))
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out
