"""Scalar functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def focus_tokens(text: Column, stop: list[str], limit: int = 12) -> Column:
    """The first distinct lower-case tokens (ASCII letters, digits and _ . / % -, without . and _ at their ends) that are no stop-words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_./%-]+)"), F.lit(1))
    bare = F.transform(found, lambda w: F.regexp_replace(w, "^[._]+|[._]+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda w: (w != "") & ~w.isin(*stop))), 1, limit)


def lead_words(text: Column, stop: list[str], limit: int = 8) -> Column:
    """The first words (an ASCII letter, then letters, digits, _ ' -) of three characters or more that are no stop-words; repeats stay."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9_'-]*)"), F.lit(1))
    return F.slice(F.filter(F.transform(found, F.lower), lambda w: (F.length(w) > 2) & ~w.isin(*stop)), 1, limit)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords are inside the text, within words too."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(k)).cast("bigint") for k in keywords), F.lit(0).cast("bigint"))


def first_tag(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The tag of the first rule whose fragment is inside the text."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(fragment)), F.lit(tag)) for fragment, tag in rules], F.lit(default))


def choice_letter(answer: Column, count: int) -> Column:
    """A letter from A, from a letter or a place counted from 0; null beyond the choices."""
    letters = F.upper(F.trim(answer))
    place = F.when(letters.rlike("^[0-9]{1,2}$"), letters.cast("int")).when(letters.rlike("^[A-Z]$"), F.ascii(letters) - 65)
    return F.when(place < count, F.chr(place + 65))


def slug(text: Column) -> Column:
    """In lower case, every character but letters and digits (ASCII) as an underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]", "_"), "^_+|_+$", "")


def normalised_tokens(text: Column, least: int = 3) -> Column:
    """Lower-case words of letters and digits, of any script, of `least` characters or more."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: F.length(w) >= least)


def shared_count(one: Column, two: Column) -> Column:
    """The number of distinct words in both."""
    return F.size(F.array_intersect(one, two))


def path_parts(path: Column, mark: str) -> Column:
    """The parts of a path that aren't blank."""
    return F.filter(F.transform(F.split(path, mark), lambda x: F.trim(x)), lambda x: x != "")


def path_prefixes(parts: Column, mark: str) -> Column:
    """Every beginning of a path, the shortest first."""
    return F.transform(F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, F.lit(1), n), mark))


def common_depth(one: Column, two: Column) -> Column:
    """The number of leading parts that two paths share."""
    unlike = F.filter(F.sequence(F.lit(1), F.greatest(F.size(one), F.size(two)) + 1), lambda i: ~F.coalesce(F.try_element_at(one, i) == F.try_element_at(two, i), F.lit(False)))
    return F.array_min(unlike) - 1


def numeric_fragments(text: Column) -> Column:
    """Numbers in a text that don't follow a letter, with sign, decimal part or denominator, and a percent sign or x behind; all commas go first."""
    return F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(?<![A-Za-z])([-+]?(?:[0-9]+\.[0-9]+|[0-9]+/[0-9]+|[0-9]+)(?:%|x)?)"), F.lit(1))


def fragment_value(fragment: Column) -> Column:
    """A fragment as a number: x behind it dropped, fractions divided (null by zero), percents as hundredths."""
    bare = F.regexp_replace(F.trim(fragment), "[xX]+$", "")
    plain = F.regexp_replace(bare, "%$", "")
    parts = F.split(plain, "/")
    value = F.when(F.size(parts) == 2, F.try_divide(F.element_at(parts, 1).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double"))).otherwise(plain.try_cast("double"))
    return F.when(F.endswith(bare, F.lit("%")), value / 100).otherwise(value)


def header_fields(record: Column) -> Column:
    """The lines key=value before the first blank line, as a map; of a key's lines the last counts."""
    lines = F.filter(F.split(F.element_at(F.split(record, "\n\n", 2), 1), "\n"), lambda x: F.contains(x, F.lit("=")))
    entries = F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substring(x, F.length(F.substring_index(x, "=", 1)) + 2, F.length(x)).alias("value")))
    last = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])) == 0)
    return F.map_from_entries(last)


def body(record: Column) -> Column:
    """What follows the first blank line; empty without one."""
    return F.coalesce(F.try_element_at(F.split(record, "\n\n", 2), F.lit(2)), F.lit(""))


def without_fields(record: Column, keys: list[str]) -> Column:
    """The lines of a record but those of the keys."""
    return F.array_join(F.filter(F.split(record, "\n"), lambda x: ~(F.contains(x, F.lit("=")) & F.substring_index(x, "=", 1).isin(*keys))), "\n")


def with_field(record: Column, key: str, value: Column) -> Column:
    """The record with the first line of the key replaced, or a line added at the end."""
    lines, line = F.split(record, "\n"), F.concat(F.lit(f"{key}="), value)
    first = F.array_min(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: F.startswith(e["x"], F.lit(f"{key}="))), lambda e: e["i"]))
    return F.when(first.isNull(), F.concat(record, F.lit("\n"), line)).otherwise(F.array_join(F.transform(lines, lambda x, i: F.when(i == first, line).otherwise(x)), "\n"))


def escaped_item(text: Column) -> Column:
    """A list item in which the marks ~ and | are spelled out."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~~")), F.lit("|"), F.lit("~p"))


def usable_body(text: Column, least: int = 120) -> Column:
    """Long enough once blanks are collapsed, and with fewer than two dot leaders (four dots or more)."""
    flat = F.trim(F.regexp_replace(text, "[ \t\n\r]+", " "))
    return (F.length(flat) >= least) & (F.regexp_count(flat, F.lit(r"[.]{4,}")) < 2)


def ranked_tags(text: Column, entries: list[tuple[str, list[str]]], defaults: list[str], limit: int) -> Column:
    """The tags with most keywords inside the text, in order of hits, then of the list; defaults fill up."""
    hits = F.array(*[F.struct((-keyword_hits(text, words)).alias("less"), F.lit(i).alias("i"), F.lit(tag).alias("tag")) for i, (tag, words) in enumerate(entries)])
    found = F.transform(F.array_sort(F.filter(hits, lambda x: x["less"] < 0)), lambda x: x["tag"])
    return F.slice(F.array_union(found, F.array(*map(F.lit, defaults))), 1, limit)
