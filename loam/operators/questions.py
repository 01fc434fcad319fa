"""Multiple-choice rows: options and answers made regular, labels repaired, features of questions and choices, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as texts

CORRECTED, ORIGINAL = "corrected_single", "original"
#: Error types of relabelled rows; fixed values of the data.
UNSUPPORTED = ("no_correct_answer", "multiple_correct_answers")
WRONG_LABEL = "wrong_groundtruth"


def _letter(answer: Column, options: Column) -> Column:
    return texts.choice_letter(answer.cast("string"), F.size(options))


def normal_options(rows: DataFrame, options: str, answer: str, index: str) -> DataFrame:
    """The rows with answer as a letter, from the answer or else its index, and reject_reason (null: usable).

    Rows with fewer than two options, or whose answer names none of them either way, are rejected. Options become text;
    null ones are empty.
    """
    choices = F.transform(F.col(options), lambda x: F.coalesce(x.cast("string"), F.lit("")))
    held = rows.withColumn("choices", F.coalesce(choices, F.array().cast("array<string>")))
    letter = F.coalesce(_letter(F.col(answer), F.col("choices")), _letter(F.col(index), F.col("choices")))
    reason = F.when(F.size("choices") < 2, "invalid_choice_count").when(F.col("letter").isNull(), "unresolved_answer")
    return held.withColumn("letter", letter).withColumn("reject_reason", reason)


def repaired_labels(rows: DataFrame, options: str, answer: str, error_type: str, correct: str, mode: str = CORRECTED) -> DataFrame:
    """The rows with original_letter, letter (repaired) and reject_reason (null: usable).

    In the mode corrected_single, rows without one right answer are rejected, and a wrong label gives way to the correct
    one if that names an option. A null error type is none.
    """
    if mode not in (CORRECTED, ORIGINAL):
        raise ValueError(f"{mode} is neither {CORRECTED} nor {ORIGINAL}")
    size, kind = F.coalesce(F.size(options), F.lit(0)), F.coalesce(F.col(error_type), F.lit("ok"))
    own, better = (texts.choice_letter(F.col(c).cast("string"), size) for c in (answer, correct))
    fix = mode == CORRECTED
    reason = F.when(size < 2, "invalid_choice_count").when(F.col("original_letter").isNull(), "invalid_original_answer")
    reason = reason.when(F.lit(fix) & kind.isin(*UNSUPPORTED), F.concat(F.lit("unsupported_"), kind))
    letter = F.when(F.lit(fix) & (kind == WRONG_LABEL), F.coalesce(better, F.col("original_letter"))).otherwise(F.col("original_letter"))
    return rows.withColumn("original_letter", own).withColumn("letter", letter).withColumn("reject_reason", reason)


def choice_features(choices: Column, stop: list[str]) -> Column:
    """choice (its letter), text, n_words, numbers and focus (leading words) of each choice, in order."""
    words = lambda x: F.regexp_count(x, F.lit("[A-Za-z][A-Za-z0-9_'-]*"))
    return F.transform(choices, lambda x, i: F.struct(F.chr(i + 65).alias("choice"), x.alias("text"), words(x).alias("n_words"), texts.numeric_fragments(x).alias("numbers"), texts.lead_words(x, stop).alias("focus")))


def quantities(rows: DataFrame, question: str, choices: str) -> DataFrame:
    """The rows without question and choices, once for each number in either: quantity (its name), role, exact text and value.

    Numbers without a value, such as a fraction over 0, are left out, but keep their place in the name.
    """
    found = lambda x: F.transform(texts.numeric_fragments(x), lambda f, i: F.struct(i.alias("i"), f.alias("exact"), texts.fragment_value(f).alias("value")))
    named = lambda x, name, role: F.transform(F.filter(found(x), lambda q: q["value"].isNotNull()), lambda q: F.struct(F.concat(name, q["i"].cast("string")).alias("quantity"), role.alias("role"), q["exact"].alias("exact"), q["value"].alias("value")))
    low = lambda i: F.lower(F.chr(i + 65))
    of_choices = F.flatten(F.transform(F.coalesce(F.col(choices), F.array().cast("array<string>")), lambda x, i: named(F.coalesce(x, F.lit("")), F.concat(F.lit("q_choice_"), low(i), F.lit("_")), F.concat(F.lit("choice_"), low(i), F.lit("_numeric")))))
    every = F.concat(named(F.coalesce(F.col(question), F.lit("")), F.lit("q_stem_"), F.lit("question_numeric")), of_choices)
    others = [F.col(f"`{c}`") for c in rows.columns if c not in (question, choices, "quantity", "role", "exact", "value")]
    return rows.select(*others, F.explode(every).alias("__q")).select(*others, "__q.*")


def cascade(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The label of the first rule that has a fragment inside the text, in lower case; null text: the default."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.coalesce(*[F.when(hit(words), F.lit(label)) for label, words in rules], F.lit(default))


def structure(question: Column, modal: list[str], passage: list[str], vignette: list[str]) -> Column:
    """Length, words, sentences and marks of a question, and whether it starts with or holds given phrases."""
    low = F.lower(question)
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.struct(
        F.length(question).alias("question_length"),
        F.regexp_count(question, F.lit("[A-Za-z][A-Za-z0-9_'-]*")).alias("question_token_count"),
        F.size(F.filter(F.split(question, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")).alias("sentence_count"),
        F.contains(question, F.lit("____")).alias("has_fill_blank"),
        F.contains(question, F.lit("?")).alias("has_question_mark"),
        holds(passage).alias("has_passage_prefix"),
        (F.contains(low, F.lit("scenario 1")) & F.contains(low, F.lit("scenario 2"))).alias("has_multiple_scenarios"),
        holds(vignette).alias("has_case_vignette"),
        F.exists(F.array(*map(F.lit, modal)), lambda w: F.startswith(low, w)).alias("question_starts_with_modal"),
    )


def coverage(rows: DataFrame, key: str, by: list[str], reason: str, samples: int = 5) -> DataFrame:
    """dimension, value, n_rows, n_kept, rate and samples: how many rows each value of each column of `by`, and `all`, keeps.

    A row is kept if it has no reject reason; reasons are a dimension of their own. samples are the least keys kept (of a
    reason: rejected). One pass counts all dimensions; a task holds `samples` keys of a value.
    """
    kept = F.col(reason).isNull()
    dimensions = [F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value"), kept.alias("ok"))]
    dimensions += [F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("value"), kept.alias("ok")) for c in by]
    dimensions.append(F.when(~kept, F.struct(F.lit("reject_reason").alias("dimension"), F.col(reason).alias("value"), F.lit(False).alias("ok"))))
    each = rows.select(F.col(key).alias("key"), F.explode(F.array(*dimensions)).alias("d")).filter("d IS NOT NULL").select("key", "d.*")
    counts = each.groupBy("dimension", "value").agg(F.count("*").alias("n_rows"), F.sum(F.col("ok").cast("bigint")).alias("n_kept"))
    shown = each.filter("ok OR dimension = 'reject_reason'").withColumn("place", F.row_number().over(Window.partitionBy("dimension", "value").orderBy("key"))).filter(F.col("place") <= samples)
    few = shown.groupBy("dimension", "value").agg(F.sort_array(F.collect_list("key")).alias("samples"))
    return counts.join(few, ["dimension", "value"], "left").select("dimension", "value", "n_rows", "n_kept", F.round(F.col("n_kept") / F.col("n_rows"), 6).alias("rate"), F.coalesce("samples", F.array().cast(few.schema["samples"].dataType)).alias("samples"))


def must_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join by keys, nulls meeting nulls, where every row of left must meet one of right: else an error that names a key.

    What isn't met is found in the join itself, so nothing is read twice.
    """
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(f"`{c}`") for c in right.columns if c not in keys], F.lit(True).alias("__met"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    said = F.concat(F.lit("no row for "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("__met").isNotNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    return left.join(named, same, "left").filter(checked).drop("__met", *[f"__{k}" for k in keys])
