"""Name resolution: spans of notes against a registry of names with roles.

A registry is a table (role, ord, name); ``ord`` is the tie-breaker. It is a dimension, far
smaller than the notes, yet nothing here broadcasts it by force: the planner decides by size.
Spans are made distinct before anything is scored, so that scoring costs as much as there are
different spans, not occurrences.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import lexicons as L
from ..functions import similarity as S
from ..functions import text as X
from ..session import cut
from .blocking import AT_ONCE, tasks, token_links

#: The least ratio of two tokens that ``similarity.plausible`` takes for alike.
ALIKE = 70.0
THRESHOLD, ENTITY_THRESHOLD, WINDOW_THRESHOLD, FIRST_NAME_LIMIT = 80.0, 72.0, 75.0, 0.88


def role_order(role: Column) -> Column:
    """Patients come before nurses, any other role after them."""
    return F.when(role == "patient", 0).when(role == "nurse", 1).otherwise(2)


def sanitise(registry: DataFrame) -> DataFrame:
    """Names trimmed and in NFC, blank ones dropped."""
    return registry.withColumn("name", X.nfc(F.btrim("name"))).where(F.length("name") > 0)


def augment(registry: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated names join the patients unless any registry has them, by folded name."""
    known = registry.select(X.name_fold(F.col("name")).alias("f")).distinct()
    top = registry.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top"))
    new = curated.withColumn("f", X.name_fold(F.col("name"))).join(known, "f", "left_anti")
    new = new.join(top).select(F.lit("patient").alias("role"), (F.col("ord") + F.col("top") + 1).alias("ord"), "name")
    return registry.select("role", "ord", "name").unionByName(new)


def index(registry: DataFrame) -> DataFrame:
    """Entries with folded and accent-normal name, tokens of two letters or more and phonetic codes;
    entries without tokens are dropped."""
    words = lambda c: F.filter(F.split(F.col(c), " +"), lambda w: F.length(w) > 1)
    entries = registry.withColumn("norm", X.name_fold(F.col("name"))).withColumn("accented", X.accent_normalise(F.col("norm")))
    entries = entries.withColumn("tokens", words("norm")).where(F.size("tokens") > 0).withColumn("role_ord", role_order(F.col("role")))
    word = entries.select("role", "ord", F.explode(F.array_union("tokens", words("accented"))).alias("w")).distinct()
    coded = word.select("role", "ord", "w", S.codes_udf(F.col("w")).alias("c"))
    gathered = coded.groupBy("role", "ord").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("codes"))  # a name's words
    first = entries.select("role", "ord", S.codes_udf(F.get("tokens", 0)).alias("first_codes"))
    return entries.join(gathered, ["role", "ord"], "left").join(first, ["role", "ord"])


def exact_matches(spans: DataFrame, entries: DataFrame) -> DataFrame:
    """span, role, ord, name, confidence, path: spans whose folded name is an entry's (1.0), else whose
    accent-normal name is (0.97); patients first, then registry order."""
    keys = entries.select("role", "ord", "role_ord", "name", F.explode(F.array_distinct(F.array("norm", "accented"))).alias("key"))
    found = None
    for column, confidence, path in (("norm", 1.0, "exact"), ("accented", 0.97, "accent")):
        hit = spans.select("span", F.col(column).alias("key")).join(keys, "key")
        best = hit.groupBy("span").agg(F.min(F.struct("role_ord", "ord", "role", "name")).alias("b"))
        best = best.select("span", "b.role", "b.ord", "b.name", F.lit(confidence).alias("confidence"), F.lit(path).alias("path"))
        found = best if found is None else found.unionByName(best.join(found, "span", "left_anti"))
    return found


@F.pandas_udf(T.DoubleType())
def _scores(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, least: pd.Series, guard: pd.Series) -> pd.Series:
    return pd.Series([S.span_score(*x) if g == 0 or _reads_like(x, g) else 0.0 for *x, g in zip(a, b, c, d, least, guard)], dtype=float)


def _reads_like(pair, guard: int) -> bool:
    norm, accented, candidate, other, _ = pair
    return S.plausible(norm, candidate, guard == 2) or S.plausible(accented, other, guard == 2)


@F.pandas_udf(T.BooleanType())
def _plausible(norm: pd.Series, candidate: pd.Series, guard: pd.Series) -> pd.Series:
    return pd.Series([g == 0 or S.plausible(a, b, g == 2) for a, b, g in zip(norm, candidate, guard)], dtype=bool)


def guarded(spans: DataFrame, strict: bool) -> DataFrame:
    """``guard``: 0 for none, else 1, and 2 for spans in lower case (see ``similarity.plausible``)."""
    return spans.withColumn("guard", F.when(F.lower("span") == F.col("span"), 2).otherwise(1) if strict else F.lit(0))


def blocked_matches(spans: DataFrame, entries: DataFrame, threshold: Column | float = THRESHOLD, strict: bool = False) -> DataFrame:
    """Best entry by ``span_score`` among those that share a phonetic code with the span's first token; for
    a role where none does, among all of that role. Entries with fewer tokens than the span can't
    reach the minimum and aren't scored. Emptiness of a block is judged before that. With ``strict``, an entry has to be plausible, and may
    share a code with any token of the span, as the misspelt one may be the first."""
    spans = guarded(spans, strict)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    heads = spans.select("span", F.get("tokens", 0).alias("w")) if not strict else spans.select("span", F.explode("tokens").alias("w"))
    first = heads.select("span", F.explode(S.codes_udf("w")).alias("code")).distinct()
    postings = entries.select("role", "ord", F.explode("codes").alias("code"))
    near = first.join(postings, "code").select("span", "role", "ord").distinct()
    roles = entries.select("role").distinct()
    blocks = near.select("span", "role").distinct()
    lone = spans.select("span").join(roles).join(blocks, ["span", "role"], "left_anti")  # spans by the few roles
    pairs = near.unionByName(lone.join(entries.select("role", "ord"), "role"))
    scored = pairs.join(spans, "span").join(entries.select("role", "ord", "role_ord", "name", F.col("norm").alias("e_norm"), F.col("accented").alias("e_accented"), F.size("tokens").alias("e_n")), ["role", "ord"])
    scored = scored.where(F.size("tokens") <= F.col("e_n")).repartition(tasks(spans.sparkSession), F.xxhash64("span", "role", "ord")).withColumn("score", _scores.asNondeterministic()("norm", "accented", "e_norm", "e_accented", limit, "guard"))  # else the filter scores before the rows are dealt out
    best = scored.where(F.col("score") >= limit).groupBy("span").agg(F.min(F.struct((-F.col("score")).alias("s"), "role_ord", "ord", "role", "name")).alias("b"))
    return best.select("span", "b.role", "b.ord", "b.name", F.round(-F.col("b.s") / 100, 3).alias("confidence"), F.lit("phonetic").alias("path"))


def first_name_matches(spans: DataFrame, entries: DataFrame, limit: float = FIRST_NAME_LIMIT, strict: bool = False) -> DataFrame:
    """Spans whose first token is, by Jaro-Winkler, close to that of exactly one name in all registries. With ``strict``, the name
    has to be plausible for the whole span."""
    own = guarded(spans, strict).select("span", "norm", "guard", F.get("tokens", 0).alias("first")).where(F.length("first") >= 3)
    coded = own.withColumn("code", F.explode(S.codes_udf(F.col("first"))))
    firsts = entries.select("role", "ord", "role_ord", "name", F.col("norm").alias("e_norm"), F.get("tokens", 0).alias("e_first"), F.explode("first_codes").alias("code"))
    pairs = coded.join(firsts, "code").drop("code").distinct().withColumn("jw", S.jaro_winkler_udf("first", "e_first")).where(F.col("jw") >= limit)
    if strict:
        pairs = pairs.where(_plausible("norm", "e_norm", "guard"))
    hits = pairs.groupBy("span").agg(F.countDistinct("name").alias("n"), F.min(F.struct((-F.col("jw")).alias("j"), "role_ord", "ord", "role", "name")).alias("b")).where("n = 1")
    return hits.select("span", "b.role", "b.ord", "b.name", F.round(-F.col("b.j") * 0.9, 3).alias("confidence"), F.lit("first_name").alias("path"))


def prepared(spans: DataFrame) -> DataFrame:
    """Distinct spans with folded and accent-normal form and tokens; titles stripped."""
    own = spans.select("span").distinct().withColumn("norm", X.name_fold(X.strip_honorific(F.col("span"))))
    own = own.withColumn("accented", X.accent_normalise(F.col("norm")))
    return own.withColumn("tokens", F.filter(F.split("norm", r"\s+"), lambda w: F.length(w) > 1)).where(F.size("tokens") > 0)


def readable(spans: DataFrame, entries: DataFrame) -> DataFrame:
    """Prepared spans that could be plausible for an entry: each token of the folded or of the accent-normal form is like a token of some
    entry. Distinct tokens are compared, not spans, and most spans of ordinary words end here."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"(?U)[\s\x1C-\x1F]+"), lambda w: F.length(w) > 1))
    forms = spans.select("span", F.posexplode(F.array(words("norm"), words("accented"))).alias("k", "ws"))
    each = forms.select("span", "k", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    tokens = entries.select(F.explode(F.array_union(words("norm"), words("accented"))).alias("t"))
    good = token_links(each.select("w"), tokens, ALIKE).select("w").distinct()
    able = each.join(good, "w", "left_semi").groupBy("span", "k", "n").agg(F.count(F.lit(1)).alias("m")).where("m = n")
    return spans.join(able.select("span").distinct(), "span", "left_semi")


def resolve(spans: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, strict: bool = False) -> DataFrame:
    """The cascade exact, accent, blocked, first name; each stage sees what those before left over. ``strict``: what the blocked
    and first-name stages find has to be plausible (``similarity.plausible``)."""
    own = cut(prepared(spans))
    found = cut(exact_matches(own, entries))
    if strict:
        own = cut(readable(own.join(found, "span", "left_anti"), entries))
    for stage in (lambda s: blocked_matches(s, entries, threshold, strict), lambda s: first_name_matches(s, entries, strict=strict)):
        left = own.join(found, "span", "left_anti")
        found = cut(found.unionByName(stage(left)))
    return found


def capital_detector(notes: DataFrame, id_col: str, text_col: str, strict: bool = False) -> DataFrame:
    """id and span: runs of capitalised words; a possessive stays in the text. With ``strict``, so do the function words that a run begins with, as
    sentences do."""
    heads = rf"(?iu)\A(?:(?:{'|'.join(L.function_words())})\s++)++"

    def bare(span: Column) -> Column:
        span = F.regexp_replace(span, "'s?$", "")
        return F.regexp_replace(span, heads, "") if strict else span

    # within the array: filters on rows would each repeat the replacements
    return notes.select(id_col, F.explode(F.array_distinct(F.transform(X.capitalised_spans(F.col(text_col)), bare))).alias("span"))


def window_detector(notes: DataFrame, registry: DataFrame, id_col: str, text_col: str, threshold: float = WINDOW_THRESHOLD, strict: bool = False) -> DataFrame:
    """id and span: windows of three to one words, in any case, that match a registry name; of those of which one contains
    the other, the first (longer ones first, then from the left). Only windows are formed whose words can all be
    aligned with a name's, so that most of a text is never looked at twice; with ``strict``, words that are plausible for one of a name's."""
    from .redact import matches

    parts = F.filter(F.split(F.col(text_col), r"(?U)\s+"), lambda w: w != "")
    words = notes.select(id_col, F.posexplode(parts).alias("at", "word"))
    folded = notes.select(F.explode(F.array_distinct(parts)).alias("word")).distinct()
    folded = cut(folded.withColumn("a", X.accent_normalise(F.col("word"))).withColumn("w", X.name_fold(F.col("a"))).select("word", "w"))
    tokens = registry.select(F.explode(F.split(X.name_fold(F.col("name")), r"(?U)\s+")).alias("t")).where(F.length("t") > 1)
    linked = token_links(folded.where(F.length("w") > 1), tokens, ALIKE if strict else 0.0)
    if strict:  # a word in lower case may be one of several, so that it needn't be equal here
        linked = linked.where(_plausible("w", "t", F.lit(1)))
    good = cut(folded.join(linked.select("w").distinct(), "w", "left_semi").select("word").unionByName(folded.where(F.length("word") < 2).select("word")).distinct())
    marked = words.join(F.broadcast(good) if good.count() <= AT_ONCE else good, "word", "left_semi")  # of a text's words, most go here
    # windows from the rows of the words after a word, in the order of the note: no array of a note's words is searched
    order = Window.partitionBy(id_col).orderBy("at")
    after = lambda c, k: F.lead(c, k).over(order)
    rows = marked.select(id_col, "at", "word", *[after(c, k).alias(f"{c}{k}") for k in (1, 2) for c in ("word", "at")])
    window = lambda n, ok, *parts: F.when(ok, F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *parts).alias("span")))
    two = F.col("at1") == F.col("at") + 1
    each = F.array(window(3, two & (F.col("at2") == F.col("at") + 2), "word", "word1", "word2"), window(2, two, "word", "word1"), window(1, F.lit(True), "word"))
    grams = rows.select(id_col, "at", F.explode(F.filter(each, lambda g: g.isNotNull())).alias("g"))
    spans = cut(grams.select(id_col, "g.n", "at", "g.span").where((F.length("span") >= 3) & ~F.col("span").rlike(r"\A\p{Nd}+\z")))
    hit = matches(spans.select("span", F.col("span").alias("form")).distinct(), registry, threshold, ["span"]).select("span").distinct()
    found = spans.join(hit, "span").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "at", "span"))).alias("w"))  # a note's matches
    over = lambda a, x: F.exists(a, lambda s: F.contains(F.lower(s), F.lower(x["span"])) | F.contains(F.lower(x["span"]), F.lower(s)))
    taken = F.aggregate("w", F.array().cast("array<string>"), lambda a, x: F.when(over(a, x), a).otherwise(F.concat(a, F.array(x["span"]))))
    return found.select(id_col, F.explode(taken).alias("span"))


def detect(notes: DataFrame, registry: DataFrame, id_col: str, text_col: str, recogniser=None, with_windows: bool = True, strict: bool = False) -> DataFrame:
    """id, o, span, method: the spans of all detectors, distinct, contained ones dropped, longest first. ``recogniser``
    takes (notes, id column, text column) and returns id and ``span``; its spans are ``ner``."""
    parts = [capital_detector(notes, id_col, text_col, strict).withColumn("r", F.lit(1))]
    if with_windows:
        parts.append(window_detector(notes, registry, id_col, text_col, strict=strict).withColumn("r", F.lit(2)))
    if recogniser is not None:
        own = recogniser(notes, id_col, text_col).select(id_col, F.btrim("span").alias("span"), F.lit(0).alias("r"))
        parts.append(own.where((F.length("span") >= 2) & ~F.lower("span").isin(L.ENTITY_STOP_WORDS + L.MORE_ENTITY_STOP_WORDS)))
    spans = parts[0]
    for more in parts[1:]:
        spans = spans.unionByName(more)
    if strict:  # single function words are no names, capitalised or not
        spans = spans.where((F.col("r") == 0) | ~F.lower("span").isin(L.function_words()))
    spans = spans.where(~X.is_token(F.col("span")) & ~F.lower("span").isin(L.ENTITY_STOP_WORDS + L.MORE_ENTITY_STOP_WORDS) & (F.length("span") >= 2))
    first = cut(spans.join(notes.select(id_col, F.col(text_col).alias("_text")), id_col).groupBy(id_col, "span").agg(F.min("r").alias("r"), F.min(F.instr("_text", F.col("span"))).alias("at")))
    each = first.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "span"))).alias("s"))  # a note's spans
    kept = each.select(id_col, F.posexplode(X.drop_contained(F.transform("s", lambda x: x["span"]))).alias("o", "span"))
    return kept.join(first.select(id_col, "span", F.when(F.col("r") == 0, "ner").when(F.col("r") == 1, "heuristic").otherwise("window").alias("method")), [id_col, "span"]).select(id_col, "o", "span", "method")


def _retried(state: DataFrame, entries: DataFrame, id_col: str, strict: bool) -> DataFrame:
    """id, o and the match of unresolved spans, without the surnames that spans before them claimed: one token as a first
    name, several by blocks."""
    surname = F.when(F.col("name").isNotNull() & (F.col("confidence") >= 0.70), F.element_at(F.split(X.name_fold(F.col("name")), r"(?U)\s+"), -1))
    before = Window.partitionBy(id_col).orderBy("o").rowsBetween(Window.unboundedPreceding, -1)  # a note's spans
    claimed = state.withColumn("claimed", F.collect_set(surname).over(before))
    tokens = F.filter(F.split(X.strip_honorific(F.col("span")), r"(?U)\s+"), lambda w: F.length(w) >= 2)
    rest = F.filter(tokens, lambda w: ~F.array_contains("claimed", F.lower(w)))
    retry = cut(claimed.where("name is null").withColumns({"n": F.size(rest), "m": F.size(tokens), "rest": F.array_join(rest, " ")}).where("n > 0 and n < m").select(id_col, "o", "rest", "n"))
    one = prepared(retry.where("n = 1").select(F.col("rest").alias("span")))
    more = prepared(retry.where("n > 1").select(F.col("rest").alias("span")))
    again = first_name_matches(one, entries, strict=strict).unionByName(blocked_matches(more, entries, THRESHOLD, strict))
    again = again.select(F.col("span").alias("rest"), F.col("role").alias("r2"), F.col("name").alias("n2"), F.col("confidence").alias("c2"))
    return retry.join(again, "rest").select(id_col, "o", "r2", "n2", "c2")


def correct_names(notes: DataFrame, registry: DataFrame, feedback: DataFrame | None = None, id_col: str = "note_id", text_col: str = "text", recogniser=None, with_windows: bool = True, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Corrected notes (id, ``corrected``, ``n_names``: how many were corrected) and detections (id, surface, canonical, role, confidence,
    path, tier, method, was_corrected, is_unresolved), from the spans of all detectors.

    A span that fails is tried again without the surnames that spans before it claimed (longer ones come first), as long
    as that resolves any; what it resolves claims in its turn.

    ``strict``: spans have to read like the name they are given, so that ordinary words which share a stretch of letters with one ("are" with
    Margaret, "von" with Yvonne) stay; a recogniser's spans are taken at its word. Without it every score over the thresholds counts."""
    texts = cut(notes.withColumn("_t", X.nfc(F.col(text_col))))
    entries = cut(index(registry))
    spans = cut(detect(texts, registry, id_col, "_t", recogniser, with_windows, strict))
    found = resolve(spans.where("method <> 'ner'"), entries, THRESHOLD, strict).withColumn("ner", F.lit(False))
    if recogniser is not None:
        found = found.unionByName(resolve(spans.where("method = 'ner'"), entries, ENTITY_THRESHOLD).withColumn("ner", F.lit(True)))
    state = cut(spans.withColumn("ner", F.col("method") == "ner").join(found, ["span", "ner"], "left").select(id_col, "o", "span", "method", "role", "name", "confidence", "path"))
    while True:
        again = cut(_retried(state, entries, id_col, strict))
        if again.isEmpty():
            break
        state = cut(state.join(again, [id_col, "o"], "left").select(id_col, "o", "span", "method", F.coalesce("role", "r2").alias("role"), F.coalesce("name", "n2").alias("name"), F.coalesce("confidence", "c2").alias("confidence"), F.coalesce("path", F.when(F.col("n2").isNotNull(), "contamination_filter")).alias("path")))
    all_ = state.select(id_col, "o", F.col("span").alias("surface"), F.col("name").alias("canonical"), F.col("role"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("path", F.lit("none")).alias("path"), "method")
    if feedback is not None:
        from .feedback import apply_feedback

        all_ = apply_feedback(all_, feedback)
    all_ = all_.withColumn("tier", F.when(F.col("canonical").isNull(), "skipped").otherwise(X.tier(F.col("confidence"))))
    used = (F.col("tier") != "skipped") & (X.name_fold(F.col("surface")) != X.name_fold(F.col("canonical")))
    all_ = cut(all_.withColumns({"was_corrected": F.coalesce(used, F.lit(False)), "is_unresolved": F.col("canonical").isNull()}))
    changes = all_.where("was_corrected").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("o", "surface", "canonical"))).alias("changes"))  # a note's spans
    text = texts.join(changes, id_col, "left")
    empty = F.array().cast("array<struct<o:int,surface:string,canonical:string>>")
    fold = F.aggregate(F.coalesce("changes", empty), F.col("_t"), lambda t, x: X.replace_word(t, x["surface"], x["canonical"]))
    return text.withColumns({"corrected": fold, "n_names": F.size(F.coalesce("changes", empty))}).drop("changes", "_t"), all_.drop("o")


def detection_counts(detections: DataFrame, id_col: str = "note_id") -> DataFrame:
    """id, ``detected``, ``corrected`` and ``unresolved`` of each note that has a detection."""
    return detections.groupBy(id_col).agg(F.count(F.lit(1)).alias("detected"), F.count_if("was_corrected").alias("corrected"), F.count_if("is_unresolved").alias("unresolved"))


def role_map(detections: DataFrame, id_col: str = "note_id") -> DataFrame:
    """Role of each canonical name of a note, the last one where they differ."""
    good = detections.where("canonical is not null and coalesce(role, '') not in ('', 'unknown')")
    return good.groupBy(id_col, "canonical").agg(F.max_by("role", "ord").alias("role")) if "ord" in detections.columns else good.groupBy(id_col, "canonical").agg(F.max("role").alias("role"))


def curated_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(L.curated_names())), "ord int, name string")
