"""Reversal of redaction: tokens such as PATIENT1 become the names of a note's map again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X

_LEFT, _RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def clean_map(pii_map: Column) -> Column:
    """Keys and values in NFC and trimmed; entries with an empty key or an empty or null value dropped. Where two
    keys become one, the last stays."""
    whole = F.to_json(pii_map)  # as one text, since a lambda can't hold what makes NFC
    pii_map = F.when(whole.rlike(X.NOT_NFC), F.from_json(X.nfc(whole), "map<string,string>")).otherwise(pii_map)
    entries = F.transform(F.map_entries(pii_map), lambda e: F.struct(F.btrim(e["key"]).alias("key"), F.btrim(e["value"].cast("string")).alias("value")))
    good = F.filter(entries, lambda e: (F.coalesce(F.length(e["key"]), F.lit(0)) > 0) & (F.coalesce(F.length(e["value"]), F.lit(0)) > 0))
    last = X.let(good, lambda g: F.filter(g, lambda e, i: F.size(F.filter(g, lambda o, j: (j > i) & (o["key"] == e["key"]))) == 0))
    return F.map_from_entries(last)


def restore(notes: DataFrame, text_col: str = "text", map_col: str = "pii_map") -> DataFrame:
    """``notes`` with ``restored``, ``reversals`` (array of token, name, n), ``residual`` (tokens
    left, sorted), ``tokens_found``, ``tokens_reversed``, ``tokens_missed``, ``occurrences`` and
    ``error`` and ``unused``, the map's tokens that the text doesn't hold. Longest tokens first, literally; the map is a column, so the plan has no shuffle.

    A null text, or a missing map, is an error of that row: its text is handed on as it is."""
    text = X.unix_lines(F.col(text_col))
    names = clean_map(F.coalesce(F.col(map_col), F.create_map().cast("map<string,string>")))
    step = notes.withColumns({"_t": text, "_m": names})
    pattern = lambda token: X.let(X.literal(token), lambda body: F.concat(F.lit("(?="), body, F.lit(")" + _LEFT), body, F.lit(_RIGHT)))
    held = F.filter(F.map_entries("_m"), lambda e: F.contains(F.coalesce("_t", F.lit("")), e["key"]))  # most texts hold few of a map's tokens
    counted = F.transform(held, lambda e: F.struct((-F.length(e["key"])).alias("o"), e["key"].alias("token"), e["value"].alias("name"), F.regexp_count(F.col("_t"), pattern(e["key"])).alias("n")))
    step = step.withColumn("_c", F.array_sort(F.filter(counted, lambda e: e["n"] > 0)))
    step = step.withColumn("restored", F.aggregate("_c", F.col("_t"), lambda t, e: F.regexp_replace(t, pattern(e["token"]), X.replacement(e["name"]))))
    step = step.withColumn("residual", F.array_sort(X.tokens_of(F.coalesce("restored", F.lit("")), L.RESTORED_PREFIXES)))
    return step.withColumns(
        {
            "reversals": F.transform("_c", lambda e: F.struct(e["token"], e["name"], e["n"])),
            "tokens_found": F.size("_c"),
            "tokens_reversed": F.size("_c"),
            "tokens_missed": F.size("residual"),
            "occurrences": F.aggregate("_c", F.lit(0), lambda a, e: a + e["n"]),
            "unused": F.array_sort(F.array_except(F.map_keys("_m"), F.transform("_c", lambda e: e["token"]))),
            "error": F.when(F.col(text_col).isNull(), "text is null").when(F.col(map_col).isNull(), "no map"),
        }
    ).drop("_t", "_m", "_c")


def with_maps(notes: DataFrame, maps: DataFrame, session_col: str = "session_id") -> DataFrame:
    """``notes`` with the map of their session from a table (session, token, canonical) and ``map_status``: "loaded", or
    "missing" for a session without rows, which gets an empty map. Of a token that is there twice the largest name counts,
    and rows without token or name don't."""
    good = maps.where("token is not null and canonical is not null").groupBy(session_col, "token").agg(F.max("canonical").alias("canonical"))
    gathered = good.groupBy(session_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "canonical")))).alias("pii_map"))  # a session's tokens are those of one note
    joined = notes.join(gathered, session_col, "left")
    status = F.when(F.col("pii_map").isNull(), "missing").otherwise("loaded")
    return joined.withColumns({"map_status": status, "pii_map": F.coalesce("pii_map", F.create_map().cast("map<string,string>"))})


def case_clashes(maps: DataFrame, session_col: str = "session_id") -> DataFrame:
    """Tokens of one session that differ in case alone."""
    return maps.groupBy(session_col, F.upper("token").alias("token")).agg(F.countDistinct("token").alias("spellings")).where("spellings > 1")
