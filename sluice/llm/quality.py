"""Quality rules, line first.

Each line is judged on its own by punctuation, navigation and boilerplate rules.
Failing lines are removed; a document that loses too much of its text that way is
rejected. Everything stays inside the row: no shuffle, no Python.

Line rules, for a line with at least one word:
- punctuation: no sentence end ([.!?] and a few other scripts' marks) anywhere in
  the line, or symbols or doubled exclamation marks on more than 3 in 10 words;
- navigation: at least 3 separators (| and the like) and more than 2 per 10 words;
- boilerplate: at least one phrase that marks licences, rights notices or site
  furniture per `BOILERPLATE_WORDS` words, however long the line is.

A document is rejected if the three rules remove more than half of its words, or if
no words are left. A short text with a licence line stays if most of it is clean.

Defined cases: a null or empty text has no words and no lines and fails the base
rules. Rows are independent, so repeated rows, ties and null ids need no care.
Extra columns of the input are ignored. Long texts take memory in proportion.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SENTENCE_ENDS = ".!?\u2026\u3002\uff01\uff1f\u061f\u0964"
NOISE, SHOUT = r"[#*$%&<>]+(?=[\x20\x09-\x0D]|$)", r"!{2,}"
SEPARATORS = "|\u00bb\u203a\u2022\u00b7"
BOILERPLATE_WORDS = 16
BOILERPLATE = (
    r"(?i)all rights reserved|licen[sc]ed under|copyright|\(c\) ?[0-9]{4}|cookie policy|accept cookies|privacy policy|terms of (use|service)|click here|read more|sign (in|up)|log ?in|subscribe|javascript"
)
#: Of each phrase a part in lower case: a text without any of these has no phrase.
STEMS = ("rights reserved", "ed under", "copyright", "(c)", "cookie", "privacy policy", "terms of", "click here", "read more", "sign in", "sign up", "login", "log in", "subscribe", "javascript")
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50


def has_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether text holds one of parts, by plain searches of its bytes."""
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def line_verdict(line: Column, words: Column, noisy: Column, cut: Column, phrased: Column) -> Column:
    """The rule that a line of so many words fails, or null. The last three say whether
    its document can have noise, separators or phrases at all; patterns run only then."""
    noise = F.when(noisy, F.regexp_count(line, F.lit(NOISE)) + F.regexp_count(line, F.lit(SHOUT))).otherwise(0)
    cuts = F.when(cut, F.regexp_count(line, F.lit(f"[{SEPARATORS}]"))).otherwise(0)
    return (
        F.when(words == 0, F.lit(None))
        .when(cut & (cuts >= 3) & (cuts * 10 > words * 2), F.lit("navigation"))
        .when((noisy & (noise * 10 > words * 3)) | ~has_any(line, SENTENCE_ENDS), F.lit("punctuation"))
        .when(phrased & (F.regexp_count(line, F.lit(BOILERPLATE)) * BOILERPLATE_WORDS >= words), F.lit("boilerplate"))
    )


def _repeat_words(windows: str, size: int) -> Column:
    """From sorted struct<h, i>: how many words lie in windows found twice or more."""
    again = F.expr(f"array_sort(transform(filter({windows}, (x, j) -> coalesce(x.h = get({windows}, j - 1).h, false) or coalesce(x.h = get({windows}, j + 1).h, false)), x -> x.i))")
    return F.aggregate(
        again,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, and more:
    clean_text (the lines that pass), lost_words, lines_removed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        # Each line is cut into words once; put together they are the document's words.
        F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))).alias("cut"),
    )
    gets = ", ".join(f"get(words, i + {k})" for k in range(window))
    hashed = split.withColumn("words", F.flatten(F.transform("cut", lambda x: x["words"]))).select(
        "doc_id",
        F.transform("cut", lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("words"))).alias("lines"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.expr(f"CASE WHEN size(words) > {window} THEN transform(sequence(0, size(words) - {window}), i -> xxhash64({gets})) ELSE array() END").alias("hashes"),
        has_any(F.col("text"), [*SYMBOLS.replace("|", ""), "!!"]).alias("noisy"),
        has_any(F.col("text"), SEPARATORS).alias("separated"),
        has_any(F.lower("text"), STEMS).alias("phrased"),
    )
    counted = hashed.select(
        "*",
        F.expr("CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN array_sort(transform(hashes, (h, i) -> struct(h AS h, i AS i))) ELSE array() END").alias("sorted"),
        F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), line_verdict(x["line"], x["words"], F.col("noisy"), F.col("separated"), F.col("phrased")).alias("failed"))).alias("judged"),
    ).withColumn("worded", F.filter("judged", lambda x: x["words"] > 0))
    summed = counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("worded") - F.size(F.array_distinct(F.transform("worded", lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        _repeat_words("sorted", window).alias("n_repeat_words"),
        F.aggregate("worded", F.lit(0).cast("long"), lambda a, x: a + F.when(x["failed"].isNotNull(), x["words"]).otherwise(0)).alias("lost_words"),
        F.aggregate("worded", F.lit(0).cast("long"), lambda a, x: a + F.when(x["failed"].isNull(), x["words"]).otherwise(0)).alias("left_words"),
        F.size(F.filter("worded", lambda x: x["failed"].isNotNull())).cast("long").alias("lines_removed"),
        F.array_join(F.transform(F.filter("judged", lambda x: x["failed"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lost = (F.col("lost_words") * 100 > F.col("n_words") * MAX_LOST_PERCENT) | (F.col("left_words") == 0)
    return summed.withColumns({"base_failed": failed, "kept": ~failed & ~lost})
