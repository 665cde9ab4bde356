"""Redaction: names that a registry confirms become tokens such as PATIENT1, reversibly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import lexicons as L
from ..functions import text as X
from ..session import cut
from .blocking import found_names
from .names import role_order

CONFIRM, WINDOWED = 72.0, 78.0


def matches(forms: DataFrame, registry: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """``keys``, role, ord, name and ``s`` of all registry names that each of the forms (keys, form) matches by ``match_score``.
    Candidates are found without loss by their tokens, and each is scored once."""
    tried = cut(forms.withColumn("a", X.accent_normalise(F.col("form"))).withColumn("f", X.name_fold(F.col("a"))).select(*keys, "f"))
    found = found_names(tried, registry.select("role", "ord", "name", X.name_fold(F.col("name")).alias("g")), threshold)
    return tried.join(cut(found), "f").select(*keys, "role", "ord", "name", "s")


def confirm(spans: DataFrame, registry: DataFrame, threshold: float = WINDOWED) -> DataFrame:
    """span, canonical, role, confidence: the best registry name of each distinct span by
    ``match_score``. The span itself is tried first, then without its title; a tie goes to the
    patient, then to registry order."""
    base = spans.select("span").distinct()
    forms = base.select("span", F.posexplode(F.array_distinct(F.array(F.btrim("span"), X.strip_honorific(F.col("span"))))).alias("c", "form"))
    scored = matches(forms, registry, threshold, ["span", "c"])
    best = scored.groupBy("span").agg(F.min(F.struct("c", (-F.round("s", 2)).alias("s"), role_order(F.col("role")).alias("r"), "ord", "role", "name")).alias("b"))
    return best.select("span", F.col("b.name").alias("canonical"), F.col("b.role").alias("role"), (-F.col("b.s")).alias("confidence"))


_TITLE = r"(?iu:" + "|".join(L.HONORIFICS) + r")\.*\z"
#: Words that a window can begin with: the first letter is a capital, or there is none, or it is a title; words that hold a blank are let through.
_BEGINS = rf"(?U)\A[^\p{{L}}\p{{N}}_]*(?:\p{{Lu}}|\z|{_TITLE})|\s"
#: Words that are one token or more of a folded name, whatever is stripped, but for titles and the second words of what accent normalisation joins.
_SOLID = r"(?U)[\p{L}\p{N}&&[^ʼ]][^\s\x1C-\x1F]*[\p{L}\p{N}&&[^ʼ]]"
_SPARED = rf"\A[^\p{{L}}\p{{N}}_]*{_TITLE}|(?iu)\A(?:" + "|".join(p.split(r"\s+")[1][:-2] for p, _ in L.accent_rules() if r"\s+" in p) + ")"


def _begun(text: Column, sizes: list[int], most: int | None) -> Column:
    """Windows of words that begin as ``windows`` asks, and have at most ``most`` tokens by a count that is sure to be no larger than theirs: array of (n, at, span)."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    blank = text.rlike(r"(?U)[\x{80}-\x{10FFFF}&&[\s]]")  # a word may hold one

    def begins(w: Column, blank: Column) -> Column:  # most words begin with a-z, and are told without a pattern
        return F.when((w >= "a") & (w < "{") & ~blank, F.rtrim(F.lower(w), F.lit(".")).isin(L.HONORIFICS)).otherwise(w.rlike(_BEGINS))

    def at(words: Column, i: Column) -> Column:
        made = F.transform(F.array(*map(F.lit, sizes)), lambda n: F.when(i + n <= F.size(words), F.struct(n.alias("n"), i.alias("at"), F.slice(words, i + 1, n).alias("part"))))
        made = F.filter(made, lambda g: g.isNotNull() & ((g["n"] <= most) | (F.size(F.filter(g["part"], lambda w: w.rlike(_SOLID) & ~w.rlike(_SPARED))) <= most) if most is not None else F.lit(True)))
        return F.transform(made, lambda g: F.struct(g["n"].alias("n"), g["at"].alias("at"), F.array_join(g["part"], " ").alias("span")))

    places = lambda x: F.filter(F.transform(x["words"], lambda w, i: F.when(begins(w, x["blank"]), i)), lambda i: i.isNotNull())
    return F.flatten(X.let(F.struct(words.alias("words"), blank.alias("blank")), lambda x: F.transform(places(x), lambda i: at(x["words"], i))))


def windows(notes: DataFrame, id_col: str = "note_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """id, n, at, span: windows of four to one words that could be names, of ``most`` tokens if given; others go before anything is exploded."""
    bare = lambda g: F.struct(g["n"].alias("n"), g["at"].alias("at"), F.regexp_replace(g["span"], r"(?U)\A[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+\z", "").alias("span"))
    # the first word or, after a title, the second begins with a capital
    grams = F.filter(_begun(F.col(text_col), [4, 3, 2, 1], most), lambda g: g["span"].rlike(r"(?U)\A\P{Alnum}*\p{Lu}|\A\S+\s+\P{Alnum}*\p{Lu}"))
    own = F.transform(F.transform(grams, bare), lambda g: F.struct(g["n"].alias("n"), g["at"].alias("at"), g["span"].alias("span"), X.strip_honorific(g["span"]).alias("bare")))
    stop = F.array(*map(F.lit, L.ENTITY_STOP_WORDS))
    good = F.filter(own, lambda g: g["bare"].rlike(r"^\p{Lu}") & (F.length(g["bare"]) >= 4) & (F.size(F.array_except(F.split(F.lower(g["bare"]), " +"), stop)) > 0))
    return notes.select(id_col, F.explode(good).alias("g")).select(id_col, "g.n", "g.at", "g.span")


def detected(notes: DataFrame, detector, id_col: str, text_col: str) -> DataFrame:
    """id, n, at, span of a detector's spans: titles stripped, stop words and short ones dropped, ones within a longer one
    dropped, longest first. A detector takes (notes, id column, text column) and returns the id and ``span``."""
    found = detector(notes, id_col, text_col).select(id_col, X.strip_honorific(F.btrim("span")).alias("span"))
    stop = F.array(*map(F.lit, L.ENTITY_STOP_WORDS))
    found = found.where((F.length("span") >= 2) & (F.size(F.array_except(F.split(F.lower("span"), r"(?U)\s+"), stop)) > 0))
    each = found.groupBy(id_col).agg(F.array_sort(F.collect_set("span")).alias("s"))  # a note's spans
    return each.select(id_col, F.posexplode(X.drop_contained(F.col("s"))).alias("o", "span")).select(id_col, F.lit(1).alias("n"), F.col("o").alias("at"), "span")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _taken(at: pd.Series, size: pd.Series) -> pd.Series:
    """Of windows in order, the numbers of those that share no word with one taken before; a byte a word of the note says which are covered."""

    def one(starts, sizes) -> list[int]:
        used, out = bytearray(max((int(a + n) for a, n in zip(starts, sizes)), default=0)), []
        for i, (a, n) in enumerate(zip(starts, sizes)):
            if not any(used[a : a + n]):
                used[a : a + n] = b"\1" * n
                out.append(i)
        return out

    return pd.Series([one(a, n) for a, n in zip(at, size)])


def covering(found: DataFrame, id_col: str = "note_id") -> DataFrame:
    """Of confirmed windows of a note, those taken greedily: longer ones first, then from the left; none
    that shares a word with one taken before. Adds ``o``, the order in which they were taken. Linear in a note's windows, once sorted."""
    rows = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "at", "span", "canonical", "role", "confidence"))).alias("w"))  # a note's windows
    rows = rows.withColumn("i", _taken(F.transform("w", lambda x: x["at"]), F.transform("w", lambda x: -x["m"])))
    taken = F.transform("i", lambda i: F.get("w", i))
    return rows.select(id_col, F.posexplode(taken).alias("o", "x")).select(id_col, "o", "x.at", "x.span", "x.canonical", "x.role", "x.confidence")


def number_tokens(events: DataFrame, id_col: str = "note_id") -> DataFrame:
    """Events (id, o, canonical, role, ..) with ``token``: one for each distinct canonical of a note, any
    case, numbered by role in the order of first use. A name of one word that equals a first name
    claimed before takes its owner's token."""
    name = F.lower("canonical")
    first = events.groupBy(id_col, name.alias("key")).agg(F.min("o").alias("o1"), F.min_by(F.struct("canonical", "role"), "o").alias("b"))
    first = first.select(id_col, "key", "o1", "b.canonical", "b.role").withColumn("alias", F.lower(X.first_name_alias(F.col("canonical"))))
    owner = first.where("alias is not null").groupBy(id_col, "alias").agg(F.min_by(F.struct("key", "o1"), "o1").alias("w")).select(id_col, F.col("alias").alias("key"), F.col("w.key").alias("owner"), F.col("w.o1").alias("owner_o"))
    first = first.join(owner, [id_col, "key"], "left").withColumn("shared", F.coalesce(F.col("owner_o") < F.col("o1"), F.lit(False)))
    rank = F.dense_rank().over(Window.partitionBy(id_col, "role").orderBy("o1"))
    own = first.where("not shared").select(id_col, "key", F.concat(F.upper("role"), rank.cast("string")).alias("token"))
    lent = first.where("shared").select(id_col, F.col("key").alias("k"), F.col("owner").alias("key")).join(own, [id_col, "key"]).select(id_col, F.col("k").alias("key"), "token")
    return events.withColumn("key", name).join(own.unionByName(lent), [id_col, "key"]).drop("key")


def redact(notes: DataFrame, registry: DataFrame, id_col: str = "note_id", text_col: str = "text", threshold: float = WINDOWED, detector=None, maps_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Redacted notes (``redacted``, ``pii_map``) and the redaction events. Spans come from windows of words, or from a
    ``detector``, whose spans need a confidence of CONFIRM alone. With ``maps_path`` the maps are written there by note."""
    texts = notes.withColumn("_t", X.nfc(F.coalesce(F.col(text_col), F.lit(""))))
    most = registry.agg(F.max(F.size(F.filter(F.split(X.name_fold(F.col("name")), r"(?U)\s+"), lambda w: F.length(w) > 1)))).first()[0] or 0
    spans = cut(detected(texts, detector, id_col, "_t") if detector else windows(texts, id_col, "_t", most))
    taken = cut(covering(spans.join(confirm(spans, registry, CONFIRM if detector else threshold), "span"), id_col))
    events = number_tokens(taken, id_col)
    alias = F.row_number().over(Window.partitionBy(id_col, F.lower(X.first_name_alias(F.col("canonical")))).orderBy("o")) == 1
    events = events.withColumn("alias", F.when(alias, X.first_name_alias(F.col("canonical"))))
    steps = F.filter(F.array(F.col("canonical"), F.when(F.lower("span") != F.lower("canonical"), F.col("span")), F.col("alias")), lambda x: x.isNotNull())
    pairs = F.array_sort(F.collect_list(F.struct("o", "token", steps.alias("needles"))))
    names = events.groupBy(id_col, "token").agg(F.min_by("canonical", "o").alias("canonical")).groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "canonical")))).alias("m"))
    per_note = events.groupBy(id_col).agg(pairs.alias("e")).join(names, id_col)
    joined = texts.join(per_note, id_col, "left")
    empty = F.array().cast("array<struct<o:int,token:string,needles:array<string>>>")
    fold = F.aggregate(F.coalesce("e", empty), F.col("_t"), lambda t, x: F.aggregate(x["needles"], t, lambda u, n: X.name_to_token(u, n, x["token"])))
    done = joined.withColumns({"redacted": fold, "pii_map": F.coalesce("m", F.create_map().cast("map<string,string>"))}).drop("_t", "e", "m")
    if maps_path:
        from ..sources.tables import write_maps

        write_maps(events.groupBy(F.col(id_col).cast("string").alias("session_id"), "token").agg(F.min_by("canonical", "o").alias("canonical")), maps_path)
    return done, events
