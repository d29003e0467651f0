"""Text rules as native column expressions (no Python runs per row)."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

SEPARATOR = " > "


def truthy(c: Column) -> Column:
    """Null for null and for the empty text, the text itself otherwise."""
    return F.nullif(c, F.lit(""))


def breadcrumb(*parts: Column) -> Column:
    """Join the non-empty parts, outermost first."""
    return F.concat_ws(SEPARATOR, *[truthy(p) for p in parts])


def path_parts(*parts: Column) -> Column:
    """The non-empty parts as an array, outermost first."""
    return F.array_compact(F.array(*[truthy(p) for p in parts]))


def ascii_fold(c: Column) -> Column:
    """Lower-case A-Z only; every other character keeps its case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def like_escape(c: Column) -> Column:
    """Make a backslash literal in a LIKE pattern; % and _ stay wildcards."""
    return F.replace(c, F.lit("\\"), F.lit("\\\\"))


def contains_regex(text: str) -> str:
    """A pattern that finds `text` anywhere, ignoring ASCII case; % and _ are wildcards."""
    out = []
    for ch in text.strip("%"):
        if ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch.isalnum() or ord(ch) > 127:
            out.append(ch)
        else:
            out.append("\\" + ch)
    return "(?is)" + "".join(out)


def contains(c: Column, text: str, ascii_only: bool = True) -> Column:
    """Case-insensitive contains; `ascii_only=False` also folds letters outside A-Z."""
    if ascii_only:
        return c.rlike(contains_regex(text))
    return c.ilike("%" + text.replace("\\", "\\\\") + "%")


def any_contains(columns: list[Column], text: str | None, ascii_only: bool = True) -> Column:
    """True where any column contains `text`; an empty search keeps everything."""
    if not text:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains(c, text, ascii_only)
    return hit


def tag_label(tag: Column) -> Column:
    """`en:plant-based-foods` -> `plant based foods`; a tag without a colon stays as it is."""
    label = F.replace(F.substring_index(tag, ":", -1), F.lit("-"), F.lit(" "))
    return F.when(F.contains(tag, F.lit(":")), label).otherwise(tag)


# Letters that have case. A capital starts every run of them, so digits,
# apostrophes and caseless scripts all end a run.
_CASE_CLASSES = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
_RUNS = rf"([{_CASE_CLASSES}]+|[^{_CASE_CLASSES}]+)"
# A Unicode noncharacter, so it does not occur in text meant for interchange.
_MARK = "\ufdd0"


def _title_by_run(c: Column) -> Column:
    def one(run: Column) -> Column:
        # The leading letter keeps a final sigma final when the tail is lowered alone.
        tail = F.substr(F.lower(F.concat(F.lit("a"), F.substr(run, F.lit(2)))), F.lit(2))
        return F.concat(F.initcap(F.substr(run, F.lit(1), F.lit(1))), tail)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_RUNS), F.lit(1)), one), "")


def title_case(c: Column) -> Column:
    """Capitalise every run of cased letters: `o'brien 3rd` -> `O'Brien 3Rd`.

    `initcap` only starts words after a blank, so a marked blank is put before every
    other run and taken out again. Text that holds the mark itself goes run by run.
    """
    marked = F.regexp_replace(c, rf"(?<=[^{_CASE_CLASSES} ])(?=[{_CASE_CLASSES}])", _MARK + " ")
    titled = F.replace(F.initcap(marked), F.lit(_MARK + " "), F.lit(""))
    return F.when(F.contains(c, F.lit(_MARK)), _title_by_run(c)).otherwise(titled)


def fallback_label(tag: Column) -> Column:
    """The title-cased label of a tag with a colon; other tags unchanged."""
    return F.when(F.contains(tag, F.lit(":")), title_case(tag_label(tag))).otherwise(tag)


def sorted_csv(values: Column) -> Column:
    """The distinct values of an array in text order, comma separated."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")
