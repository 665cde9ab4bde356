"""Spelling variants of words, found by anagram hashing; DataFrame functions alone.

A word's key is the sum of the ``POWER``-th powers of its letters' code points: a number that doesn't hang on their
order. Two words that differ by one inserted, deleted or replaced letter have keys that differ by the value of that letter, or by
that of one letter less that of another. So each word enters under its own key and under its key less each of its distinct
letters: words of which one is longer by a letter meet as (own key, key less a letter), words of which a letter is exchanged as
(key less a letter, key less a letter). A word thus has at most one entry for each letter of the alphabet, however long it is.

An edit leaves the first or the last half of the letters as it was (pigeonhole), so entries are made for each half, and meet
only where that half is the same, too: anagrams don't meet all to all, even where a bag of letters has many orders. The letter
order of what meets is verified on the words themselves (an edit distance of one). A pair that meets by both halves counts by the first.

A word's form is the near word that occurs most (ties: the smallest in code-point order), if it occurs ``ratio`` times as often as
the word or more; its root is where forms lead to. Forms occur more often at each step, so there are no cycles, and
steps are doubled: a chain of k forms takes log2(k) joins.

Defined results: null texts have no words, a null id counts as the empty text; repeated rows count as often as they occur; columns other than the
id and the text don't matter; words are counted over all rows; an empty table, or one with no word that counts, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

RUN_PATTERN = r"[A-Za-zÀ-ÿ]+"
#: Fourth powers: the sum of a word of 2 GB still fits 64 bits.
POWER = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[Column, Column], Column] | None = None, least_letters: int = 6, least_n: int = 5) -> DataFrame:
    """``word`` and its number ``n`` of occurrences: maximal runs of letters, A-Z as a-z, of ``least_letters`` and more that occur
    ``least_n`` times or more. ``change(id, run)`` gives a column that replaces each run."""
    lower = F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN_PATTERN), F.lit(0))).alias("run"))
    word = change(F.col("id"), F.col("run")) if change else F.col("run")
    counted = runs.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_n)


def _value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def entries(words: DataFrame) -> DataFrame:
    """word, n, key, left (letters that are left), whole (whether none is taken off), first (hash of the first half), side and part
    (hash of the half of that side), a row for each key and half."""
    letters = F.split("word", "")
    keyed = words.select("word", "n", letters.alias("c")).select("word", "n", F.size("c").alias("size"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + _value(x)).alias("key"), F.array_distinct("c").alias("c"))
    taken = F.concat(F.array(F.lit(0).cast("long")), F.transform("c", _value))
    each = keyed.select("word", "n", "size", "key", F.explode(taken).alias("taken"))
    left = F.col("size") - F.when(F.col("taken") == 0, 0).otherwise(1)
    each = each.select("word", "n", (F.col("key") - F.col("taken")).alias("key"), (F.col("taken") == 0).alias("whole"), left.alias("left"), (left / 2).cast("int").alias("h"))
    first = F.xxhash64(F.expr("left(word, h)"))
    last = F.xxhash64(F.expr("right(word, `left` - h)"))
    each = each.select("word", "n", "key", "whole", "left", first.alias("first"), last.alias("last"))
    return each.select("word", "n", "key", "whole", "left", "first", F.posexplode(F.array("first", "last")).alias("side", "part"))


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: each word with each that differs from it by exactly one letter put in, taken out or replaced."""
    own = entries(words)
    other = own.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key", F.col("whole").alias("near_whole"), "left", F.col("first").alias("near_first"), "side", "part")
    # both sides are shuffled: the planner takes entries for as small as the compressed words they are made of, and would broadcast them
    met = own.join(other.hint("merge"), ["key", "left", "side", "part"]).where(~(F.col("whole") & F.col("near_whole")) & (F.col("word") != F.col("near")))
    met = met.where((F.col("side") == 0) | (F.col("first") != F.col("near_first")))
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word``, ``n``, ``form``, ``root``, ``n_near`` and ``form_n`` of the distinct words of a table (word, n)."""
    with Scratch(words.sparkSession) as run:
        own = run.table(words.select("word", "n"), "words")
        best = near_words(own).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
        enough = -F.col("best.minus") >= ratio * F.col("n")
        found = own.join(best.hint("merge"), "word", "left").select("word", "n", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
        found = run.table(found, "forms")
        step = found.where("form is not null").select("word", F.col("form").alias("root"))
        while True:  # roots of roots, until all are words without a form
            step = run.table(step, "roots")
            on = step.select(F.col("word").alias("root"), F.col("root").alias("on"))
            ahead = step.join(on.hint("merge"), "root", "left")
            if not ahead.where("on is not null").limit(1).count():
                break
            step = ahead.select("word", F.coalesce("on", "root").alias("root"))
        return run.keep(found.join(step.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
