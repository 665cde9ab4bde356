"""Term standardisation and rewriting: dictionary, guard, safety audit, word diff, prompts.

The rewriter is a plug-in (a function from one text column to another); the default hands the
text on. Whatever it returns is guarded, so that a bad rewrite falls back to its input."""

from __future__ import annotations

import difflib
import random
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions import text as X
from . import phrases

STANDARD_BOUNDS, PROFESSIONAL_BOUNDS = (0.5, 2.0), (0.4, 2.5)

#: Dictionary rules that are one native expression each; more are one automaton, with the same result.
MOST_NATIVE = 100


def guard(original: Column, candidate: Column, bounds: tuple[float, float]) -> Column:
    """struct(text, ok, missing, extra): the trimmed candidate if it isn't blank, its length is within the
    bounds and no protection token of the original is missing; else the original. Extra tokens
    are told, not held against it."""
    # each step is bound, so that none is evaluated for every use of it
    def tokens(x: Column) -> Column:
        before = X.protection_tokens(x["a"])
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), before.alias("before"), F.when(x["a"] == x["b"], F.lit(None)).otherwise(X.protection_tokens(F.coalesce(x["b"], F.lit("")))).alias("after"))

    def judged(x: Column) -> Column:
        after = F.coalesce(x["after"], x["before"])
        missing, extra = F.array_except(x["before"], after), F.array_except(after, x["before"])
        share = F.length(x["b"]) / F.greatest(F.length(x["a"]), F.lit(1))
        ok = F.coalesce((F.btrim(x["b"]) != "") & share.between(*bounds) & (F.size(missing) == 0), F.lit(False))
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), ok.alias("ok"), missing.alias("missing"), extra.alias("extra"))

    def told(x: Column) -> Column:
        return F.struct(F.when(x["ok"], F.btrim(x["b"])).otherwise(x["a"]).alias("text"), x["ok"].alias("ok"), F.array_sort(x["missing"]).alias("missing"), F.array_sort(x["extra"]).alias("extra"))

    return X.let(F.struct(original.alias("a"), candidate.alias("b")), lambda x: X.let(tokens(x), lambda y: X.let(judged(y), told)))


def safety_drift(before: Column, after: Column) -> Column:
    """struct(refusal_lost, agency_lost, recurrence_lost, any_drift): a safety signal that was there and
    is no more; a refusal that an excusing word stands for is not lost."""
    lost = lambda p: F.regexp_like(before, F.lit("(?i)" + p)) & ~F.regexp_like(after, F.lit("(?i)" + p))
    low = F.lower(after)
    excused = F.contains(low, F.lit(L.EXCUSES[0])) | F.contains(low, F.lit(L.EXCUSES[1]))
    refusal, agency, recurrence = lost(L.REFUSAL) & ~excused, lost(L.AGENCY), lost(L.RECURRENCE)
    refusal, agency, recurrence = (F.when(before == after, False).otherwise(x) for x in (refusal, agency, recurrence))
    return F.struct(refusal.alias("refusal_lost"), agency.alias("agency_lost"), recurrence.alias("recurrence_lost"), (refusal | agency | recurrence).alias("any_drift"))


def _diff(a: str, b: str) -> list[dict]:
    x, y = (a or "").split(), (b or "").split()
    ops = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    return [{"kind": k, "original": " ".join(x[i:j]), "corrected": " ".join(y[m:n])} for k, i, j, m, n in ops if k != "equal"]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("kind", "original", "corrected")])))
def _word_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([_diff(a, b) for a, b in zip(before, after)])


def word_diff(before: Column | str, after: Column | str) -> Column:
    """Replaced, inserted and deleted runs of words, in order. Equal texts reach the UDF as null."""
    before, after = (F.col(x) if isinstance(x, str) else x for x in (before, after))
    other = ~before.eqNullSafe(after)
    return _word_diff(F.when(other, before), F.when(other, after))


def markdown_misheard(terms: DataFrame) -> DataFrame:
    """One row ``table``: misheard variants, longest first, at most 120 of them (a prompt's room)."""
    rows = terms.select(F.explode("variants").alias("v"), "term", "ord").groupBy("v").agg(F.max_by("term", "ord").alias("term"), F.min("ord").alias("ord"))
    top = rows.orderBy(F.length("v").desc(), "ord", "v").limit(120)
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("v")).alias("n"), "ord", "v", "term"))), lambda x: F.concat(F.lit("| "), x["v"], F.lit(" | "), x["term"], F.lit(" |")))
    return top.agg(F.concat_ws("\n", F.lit("| Misheard (Voice) | Standard Term |"), F.lit("|---|---|"), F.array_join(lines, "\n")).alias("table"))


def markdown_professional(terms: DataFrame) -> DataFrame:
    """One row ``table``: terms whose professional meaning differs. The dictionary is a small dimension."""
    rows = terms.where("term <> '' and meaning <> '' and lower(term) <> lower(meaning)")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "term", "meaning"))), lambda x: F.concat(F.lit("| "), x["term"], F.lit(" | "), x["meaning"], F.lit(" |")))
    return rows.agg(F.concat_ws("\n", F.lit("| Standard Term (ColA) | Professional Term (ColB) |"), F.lit("|---|---|"), F.array_join(lines, "\n")).alias("table"))


def prompt(system: str, table: Column, note: Column, examples: list[tuple[str, str]] = ()) -> Column:
    """array of struct(role, content) for a rewriter that takes messages."""
    shown = "\n\n".join(f"Input: {a}\nOutput: {b}" for a, b in examples)
    content = F.concat_ws("\n\n", F.lit(system), F.when(table != "", table), F.lit(shown or None).cast("string"))
    return F.array(F.struct(F.lit("system").alias("role"), content.alias("content")), F.struct(F.lit("user").alias("role"), note.alias("content")))


def is_error(response: Column) -> Column:
    return F.startswith(response, F.lit("ERROR:"))


def wait_for(response: str, attempt: int) -> float:
    """Seconds to wait after a failure: what a rate limit asks for and one more, else 2, 4, 8, .. and at most 90, a fifth more or less
    at random."""
    asked = re.search(r"retry.after[^\d]*(\d+\.?\d*)", response, re.IGNORECASE)
    return float(asked[1]) + 1.0 if asked else min(2.0 * 2**attempt * random.uniform(0.8, 1.2), 90.0)


def call(chat: Callable[[str], str], text: str, limits: int = 6, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer of ``chat`` to a text. A failure that names a rate limit is waited out, up to ``limits`` times a call; an error
    or an empty answer is tried again after 1, 2, .. seconds, ``attempts`` calls in all. Never raises: what fails is "ERROR: ..."."""
    answer = "ERROR: no answer"
    for attempt in range(attempts):
        if attempt:
            sleep(float(attempt))
        for turn in range(limits + 1):
            try:
                answer = chat(text)
                break
            except Exception as error:  # whatever a client raises
                answer = f"ERROR: {error}"
                limited = "429" in answer or re.search("rate.?limit", answer, re.IGNORECASE)
                if not limited or turn == limits:
                    break
                sleep(wait_for(answer, turn))
        if isinstance(answer, str) and answer.strip() and not answer.startswith("ERROR:"):
            return answer
    return answer if isinstance(answer, str) and answer.startswith("ERROR:") else "ERROR: empty answer"


def rewriter_of(chat: Callable[[str], str], **options) -> Callable[[Column], Column]:
    """A rewriter for ``standardise`` and ``professionalise`` from a function of one text, called with retries on the
    executors, a batch of rows at a time; it must be picklable."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: call(chat, t, **options) if t and t.strip() else t)

    return run


def _rewritten(notes: DataFrame, text: Column, rewriter: Callable[[Column], Column] | None, bounds) -> Column:
    candidate = X.strip_preamble(rewriter(text)) if rewriter else text
    return guard(text, F.when(is_error(candidate), text).otherwise(candidate), bounds)


def standardise(notes: DataFrame, variants: list[tuple[str, str]], rewriter: Callable[[Column], Column] | None = None, text_col: str = "text") -> DataFrame:
    """``notes`` with ``standard``, ``applied`` (dictionary rules), ``ok`` and ``corrections`` (word diff)."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    if len(variants) > MOST_NATIVE:
        step = phrases.rewrite(notes.withColumn("_w", whole), variants, "_w", "_p").drop("_w")
    else:
        step = notes.withColumn("_p", X.prepass_step(whole, variants))
    step = step.withColumn("_g", _rewritten(notes, F.col("_p.text"), rewriter, STANDARD_BOUNDS))
    return step.withColumns({"standard": F.col("_g.text"), "applied": F.col("_p.applied"), "ok": F.col("_g.ok"), "corrections": word_diff(F.coalesce(F.col(text_col), F.lit("")), F.col("_g.text"))}).drop("_p", "_g")


def professionalise(notes: DataFrame, rewriter: Callable[[Column], Column] | None = None, text_col: str = "standard") -> DataFrame:
    """``notes`` with ``professional``, ``ok``, ``drift`` and ``corrections``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = notes.withColumn("_g", _rewritten(notes, text, rewriter, PROFESSIONAL_BOUNDS))
    return step.withColumns({"professional": F.col("_g.text"), "ok": F.col("_g.ok"), "drift": safety_drift(text, F.col("_g.text")), "corrections": word_diff(text, F.col("_g.text"))}).drop("_g")
