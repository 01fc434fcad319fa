"""Documents by their headings: section paths, chunks of bounded size, outlines.

Everything is worked out inside a document's own row by array functions and ordered folds, so no row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.folds import greedy_runs, once, scan

MAX_CHARS = 1600
PATH_MARK = " > "
#: A line with one to three marks and a title; white space around it doesn't count.
_HEADING = r"(?m)^[^\S\n]*(#{1,3})[^\S\n]+(\S(?:[^\n]*\S)?)[^\S\n]*$"
_LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_SENTENCE_GAP = r"(?U)(?<=[.!?])\s+"


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _unix(text: Column) -> Column:
    """The text with every kind of line end as \\n; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _LINE_ENDS, "\n")


def headings(text: Column) -> Column:
    """The headings of a text in order, as an array of struct<level int, title string>."""
    levels, titles = (F.regexp_extract_all(_unix(text), F.lit("(?dU)" + _HEADING), F.lit(i)) for i in (1, 2))
    return F.zip_with(levels, titles, lambda a, b: F.struct(F.length(a).alias("level"), b.alias("title")))


def section_paths(title: Column, found: Column, mark: str = PATH_MARK) -> Column:
    """The path of each section: of the part before the first heading, which is the title alone, then of each heading's.

    A heading of level n follows the first n entries of the path before it, or all of them if there are fewer.
    """

    def paths(root: Column) -> Column:
        stacks = scan(found, F.array(root), lambda stack, h: F.concat(F.slice(stack, F.lit(1), h["level"]), F.array(h["title"])), "array<string>")
        return F.transform(F.concat(F.array(F.array(root)), stacks), lambda stack: F.array_join(stack, mark))

    return once(F.coalesce(title, F.lit("")), paths)


def bodies(text: Column) -> Column:
    """What stands before the first heading, then below each one; as many texts as section_paths has paths."""
    return F.split(_unix(text), "(?dU)" + _HEADING)


def paragraphs(body: Column) -> Column:
    """The parts of a text between blank lines that aren't blank themselves."""
    return F.filter(F.transform(F.split(body, "\n\n"), stripped), lambda p: p != "")


def split_paragraph(paragraph: Column, most: int) -> Column:
    """A paragraph in texts of at most `most` characters: sentences together as long as they fit, longer ones cut hard.

    Parts of a cut that are blank are left out.
    """

    def items(sentence: Column) -> Column:
        whole = F.array(F.struct(sentence.alias("text"), F.lit(False).alias("solo")))
        places = F.sequence(F.lit(1), F.greatest(F.length(sentence), F.lit(1)), F.lit(most))
        cuts = F.transform(places, lambda i: F.struct(stripped(F.substring(sentence, i, F.lit(most))).alias("text"), F.lit(True).alias("solo")))
        return F.when(F.length(sentence) <= most, whole).otherwise(F.filter(cuts, lambda c: c["text"] != ""))

    sentences = F.filter(F.transform(F.split(paragraph, _SENTENCE_GAP), stripped), lambda s: s != "")
    return F.when(F.length(paragraph) <= most, F.array(paragraph)).otherwise(greedy_runs(F.flatten(F.transform(sentences, items)), " ", most))


def body_chunks(body: Column, most: int) -> Column:
    """The paragraphs of a section in texts of at most `most` characters, as many together as fit."""
    pieces = F.flatten(F.transform(paragraphs(body), lambda p: split_paragraph(p, most)))
    return greedy_runs(F.transform(pieces, lambda p: F.struct(p.alias("text"), F.lit(False).alias("solo"))), "\n\n", most)


def _others(docs: DataFrame, *but: str) -> list[Column]:
    """The columns of docs but those that are read or made anew."""
    return [F.col(f"`{c}`") for c in docs.columns if c not in but]


def chunked(docs: DataFrame, title: str, text: str, most: int = MAX_CHARS) -> DataFrame:
    """The rows of docs without `text`, once for each chunk, with chunk (from 0 in the document), path and body, in place of columns of these names.

    A chunk belongs to one section, has at most `most` characters, and breaks between paragraphs, else between sentences,
    else anywhere. Null and blank texts have no chunks; a null title is empty. Repeated rows are documents of their own.
    """
    both = F.arrays_zip(section_paths(F.col(title), headings(F.col(text))).alias("path"), bodies(F.col(text)).alias("body"))
    found = F.flatten(F.transform(both, lambda s: F.transform(body_chunks(s["body"], most), lambda c: F.struct(s["path"].alias("path"), c.alias("body")))))
    others = _others(docs, text, "chunk", "path", "body")
    return docs.select(*others, F.posexplode(found).alias("chunk", "__chunk")).select(*others, "chunk", F.col("__chunk.path").alias("path"), F.col("__chunk.body").alias("body"))


def enveloped(mark: str, fields: dict[str, Column], body: Column) -> Column:
    """A record's text: the mark, a line key=value for each field, a blank line and the body; a line end at the end."""
    lines = [F.lit(mark), *[F.concat(F.lit(f"{key}="), F.coalesce(value.cast("string"), F.lit(""))) for key, value in fields.items()], F.lit(""), stripped(body)]
    return F.concat(stripped(F.concat_ws("\n", *lines)), F.lit("\n"))


def outline(found: Column) -> Column:
    """Headings (of `headings`) as a list, two spaces to the right for each level."""
    return F.array_join(F.transform(found, lambda h: F.concat(F.repeat(F.lit("  "), F.greatest(h["level"] - 1, F.lit(0))), F.lit("- "), h["title"])), "\n")


def outline_steps(docs: DataFrame, text: str) -> DataFrame:
    """The rows of docs without `text`, once for each heading but the first, with place (from 1), level, title and before: the titles of all headings before it."""
    others = _others(docs, text, "place", "level", "title", "before")
    held = docs.select(*others, headings(F.col(text)).alias("__all"))
    each = held.select(*others, "__all", F.posexplode("__all").alias("place", "__own")).filter("place > 0")
    return each.select(*others, "place", "__own.level", "__own.title", F.transform(F.slice("__all", F.lit(1), F.col("place")), lambda h: h["title"]).alias("before"))
