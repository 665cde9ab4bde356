"""Queries of the note and name operators over the test tables, and DuckDB SQL of the same rows.

The tables hold no people's names: two-word part names serve as a registry, documents and
conversations as notes, events as logs. Every query covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as L
from ..functions import similarity as S
from ..functions import text as X
from ..operators import feedback as B
from ..operators import limits, names, phrases, redact, restore, snapshots, terms
from ..session import cut
from ..sources import tables
from .pipeline import process

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VARIANTS = [("of the", "OF-THE"), ("th", "T-H"), ("ing", "I N G"), ("de la", "DELA"), ("der", "Der."), ("once again", "recurrently")]


def _sql_rewrite(column: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'gi')"
    return column


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("PATIENT1 met NURSE2.\r\n"), F.coalesce("text", F.lit("")), F.lit(" PATIENT10, PATIENT1's XPATIENT1 PATIENT1_N (NURSE2) STAFF7"))
    pii_map = F.create_map(F.lit("PATIENT1"), F.col("source"), F.lit("NURSE2"), F.col("lang"), F.lit("PATIENT10"), F.lit("Ana $Ruiz"), F.lit("CARER3"), F.lit("nobody"))
    return restore.restore(docs.select("doc_id", text.alias("text"), pii_map.alias("pii_map")))


@query("""
    WITH t AS (SELECT doc_id, regexp_replace('PATIENT1 met NURSE2.' || chr(10) || coalesce(text, '') || ' PATIENT10, PATIENT1''s XPATIENT1 PATIENT1_N (NURSE2) STAFF7', '\\r\\n?', chr(10), 'g') AS t, source, lang FROM documents)
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '\\bPATIENT10\\b', 'Ana $Ruiz', 'g'), '\\bPATIENT1\\b', source, 'g'), '\\bNURSE2\\b', lang, 'g')) AS restored,
      CAST(3 AS INTEGER) AS tokens_found, CAST(len(regexp_extract_all(t, '\\b(PATIENT10|PATIENT1|NURSE2)\\b')) AS INTEGER) AS occurrences, 'STAFF7' AS residual FROM t""")
def restore_tokens(spark, sf_dir):
    return _restored(spark, sf_dir).select("doc_id", F.md5(F.col("restored").cast("binary")).alias("restored"), "tokens_found", "occurrences", F.array_join("residual", ",").alias("residual"))


@query("""
    WITH e AS (SELECT user_id AS note_id, event_id AS o, event_type AS canonical, CASE WHEN event_type IN ('view', 'click') THEN 'nurse' ELSE 'patient' END AS role FROM events),
      f AS (SELECT note_id, canonical, role, min(o) AS o1 FROM e GROUP BY ALL),
      r AS (SELECT *, dense_rank() OVER (PARTITION BY note_id, role ORDER BY o1) AS n FROM f)
    SELECT e.note_id, e.o, e.canonical, upper(e.role) || r.n AS token FROM e JOIN r USING (note_id, canonical)""")
def surrogate_tokens(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("note_id"), F.col("event_id").alias("o"), F.col("event_type").alias("canonical"), F.when(F.col("event_type").isin("view", "click"), "nurse").otherwise("patient").alias("role"))
    return redact.number_tokens(e).select("note_id", "o", "canonical", "token")


@query("""
    WITH r AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT DISTINCT upper(p_name) AS span FROM part)
    SELECT span, min(name) AS name, CAST(1.0 AS DOUBLE) AS confidence, 'exact' AS path FROM s JOIN r ON lower(s.span) = lower(r.name) GROUP BY span""")
def exact_registry(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return names.exact_matches(names.prepared(part.select(F.upper("p_name").alias("span"))), names.index(_registry(part))).select("span", "name", "confidence", "path")


def _registry(part: DataFrame) -> DataFrame:
    """Distinct part names in alphabetical order: a dimension."""
    return part.select(F.col("p_name").alias("name")).distinct().select(F.lit("patient").alias("role"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")).alias("ord"), "name")


@query("""
    WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)
    SELECT a.w AS a, b.w AS b, round(jaro_winkler_similarity(a.w, b.w), 6) AS jw FROM w a JOIN w b ON a.w[1] = b.w[1]""")
def jaro_winkler_pairs(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("a")).distinct().withColumn("k", F.substring("a", 1, 1))
    return w.join(w.withColumnRenamed("a", "b"), "k").select("a", "b", F.round(S.jaro_winkler_udf("a", "b"), 6).alias("jw"))


@query("""
    WITH r AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT name, left(name, 3) || right(name, length(name) - 4) AS span FROM r),
      j AS (SELECT s.span, r.name, levenshtein(s.span, r.name) AS d FROM s JOIN r ON s.span[1] = r.name[1])
    SELECT span, arg_min(name, (d, name)) AS best, CAST(min(d) AS INTEGER) AS distance FROM j GROUP BY span""")
def nearest_name(spark, sf_dir):
    r = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("k", F.substring("name", 1, 1))
    s = r.select(F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)")).alias("span")).distinct().withColumn("k", F.substring("span", 1, 1))
    best = s.join(r, "k").groupBy("span").agg(F.min(F.struct(F.levenshtein("span", "name").alias("d"), "name")).alias("b"))
    return best.select("span", F.col("b.name").alias("best"), F.col("b.d").alias("distance"))


@query()
def resolve_names(spark, sf_dir):
    """L1's cascade: misspelt part names, as spans, against the registry of part names."""
    part = table(spark, sf_dir, "part")
    spans = part.select(F.initcap(F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, 5)"))).alias("span")).distinct()
    return names.resolve(spans, names.index(_registry(part))).select("span", "name", "role", "confidence", "path")


def _notes(spark, sf_dir) -> DataFrame:
    """Conversation turns, each with a sentence about two people in front."""
    people = L.curated_names()
    pick = lambda k: F.get(F.array(*map(F.lit, people)), F.pmod(F.col("conv_id") * 7 + F.col("turn") * k, F.lit(len(people))).cast("int"))
    text = F.concat(F.lit("Nurse "), pick(3), F.lit(" saw "), pick(5), F.lit("'s chart. "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("note_id"), text.alias("text"))


def _people(spark) -> DataFrame:
    return names.curated_registry(spark).select(F.when(F.col("ord") % 2 == 0, "patient").otherwise("nurse").alias("role"), F.col("ord").cast("long").alias("ord"), "name")


@query()
def redact_notes(spark, sf_dir):
    """L2: every conversation turn redacted against a registry of people."""
    done, _ = redact.redact(_notes(spark, sf_dir), _people(spark))
    return done.select("note_id", "redacted", F.to_json("pii_map").alias("pii_map"))


@query()
def correct_notes(spark, sf_dir):
    """L1: every conversation turn with misspelt names corrected."""
    notes = _notes(spark, sf_dir).withColumn("text", F.replace(F.col("text"), F.lit("Murphy"), F.lit("Murfy")))
    return names.correct_names(notes, _people(spark))[1]


@query()
def note_pipeline(spark, sf_dir):
    """All five stages over every conversation turn."""
    done = process(_notes(spark, sf_dir), _people(spark), VARIANTS)
    return done.select("note_id", "restored", "standard_ok", "professional_ok", "n_corrections", F.col("drift.any_drift").alias("any_drift"))


@query(f"SELECT doc_id, md5({_sql_rewrite('text', [(chr(92) + 'b' + v + chr(92) + 'b', t) for v, t in sorted(VARIANTS, key=lambda x: -len(x[0]))])}) AS standard FROM documents")
def dictionary_prepass(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.prepass(F.col("text"), VARIANTS)[0].cast("binary")).alias("standard"))


_PHRASE = "[A-Za-z]+ [A-Za-z]+ [A-Za-z]+"


@query(f"""
    WITH p AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{_PHRASE}'))) AS phrase FROM benchmark),
      d AS (SELECT doc_id, text, lower(text) AS low FROM documents),
      c AS (SELECT doc_id, phrase, len(regexp_extract_all(text, '\\b' || phrase || '\\b', 0, 'i')) AS n FROM d JOIN p ON contains(d.low, p.phrase))
    SELECT doc_id, phrase, CAST(n AS BIGINT) AS n FROM c WHERE n > 0""")
def registry_scan(spark, sf_dir):
    """Every phrase of three words that benchmark items are cut into, and how often each document holds it."""
    items = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_PHRASE), F.lit(0))).alias("phrase"))
    known = [r.phrase for r in items.select(F.lower("phrase").alias("phrase")).distinct().orderBy("phrase").collect()]  # the dictionary: a small dimension
    return phrases.scan(table(spark, sf_dir, "documents"), known, "doc_id").groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT p_name AS name, {_sql_rewrite(chr(39) + 'Shon ' + chr(39) + ' || p_name || ' + chr(39) + ' o  Brien' + chr(39), [(p, r) for p, r in L.accent_rules()])} AS normal FROM part")
def accent_rewrite(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return part.select("name", X.accent_normalise(F.concat(F.lit("Shon "), "name", F.lit(" o  Brien"))).alias("normal"))


@query("SELECT doc_id, md5(lower(strip_accents(replace(replace(replace(text, '''', ''), '’', ''), 'ʼ', '')))) AS folded FROM documents")
def folded_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.name_fold(F.col("text")).cast("binary")).alias("folded"))


_TURNS = "SELECT conv_id, turn, coalesce(text, '') AS a, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations"


def _turns(spark, sf_dir) -> DataFrame:
    """Each turn and the next one of its conversation."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("a"))
    return t.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")


@query(f"""
    WITH t AS ({_TURNS}), k AS (SELECT *, trim(b, ' ') <> '' AND length(b) / greatest(length(a), 1) BETWEEN 0.4 AND 2.5 AS ok FROM t WHERE b IS NOT NULL)
    SELECT conv_id, turn, ok, md5(CASE WHEN ok THEN trim(b, ' ') ELSE a END) AS text FROM k""")
def output_guard(spark, sf_dir):
    g = _turns(spark, sf_dir).withColumn("g", terms.guard(F.col("a"), F.col("b"), terms.PROFESSIONAL_BOUNDS))
    return g.select("conv_id", "turn", F.col("g.ok").alias("ok"), F.md5(F.col("g.text").cast("binary")).alias("text"))


def _sql_lost(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"regexp_matches(x, '(?i){p}') AND NOT regexp_matches(y, '(?i){p}')"


@query(f"""
    WITH t AS (SELECT conv_id, turn, a || CASE WHEN turn % 3 = 0 THEN ' She refused again.' ELSE ' Patient removed it.' END AS x, b || CASE WHEN turn % 2 = 0 THEN ' Declined' ELSE ' every night' END AS y FROM ({_TURNS}) WHERE b IS NOT NULL),
      l AS (SELECT conv_id, turn, {_sql_lost(L.REFUSAL)} AND NOT contains(lower(y), 'declined') AND NOT contains(lower(y), 'rdh') AS refusal_lost, {_sql_lost(L.AGENCY)} AS agency_lost, {_sql_lost(L.RECURRENCE)} AS recurrence_lost FROM t)
    SELECT *, refusal_lost OR agency_lost OR recurrence_lost AS any_drift FROM l""")
def safety_drift(spark, sf_dir):
    t = _turns(spark, sf_dir)
    x = F.concat("a", F.when(F.col("turn") % 3 == 0, " She refused again.").otherwise(" Patient removed it."))
    y = F.concat("b", F.when(F.col("turn") % 2 == 0, " Declined").otherwise(" every night"))
    return t.withColumns({"x": x, "y": y}).select("conv_id", "turn", terms.safety_drift(F.col("x"), F.col("y")).alias("d")).select("conv_id", "turn", "d.*")


@query()
def word_changes(spark, sf_dir):
    """Word diff of each turn to the next."""
    d = _turns(spark, sf_dir).withColumn("c", terms.word_diff("a", "b"))
    return d.select("conv_id", "turn", F.size("c").alias("n_changes"), F.to_json("c").alias("changes"))


@query("""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
      g AS (SELECT doc_id, n, list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' ')) AS g FROM w, (VALUES (1), (2), (3), (4)) v(n) WHERE len(w) >= n)
    SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(len(g) AS BIGINT) AS windows, CAST(len(list_distinct(g)) AS BIGINT) AS spans FROM g""")
def span_windows(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.windows(F.col("text"), [1, 2, 3, 4])).alias("x"))
    return each.select("doc_id", "x.n", F.size("x.spans").cast("long").alias("windows"), F.size(F.array_distinct("x.spans")).cast("long").alias("spans")).where("windows > 0")


@query()
def capital_spans(spark, sf_dir):
    """Capitalised spans of every document, contained ones dropped."""
    return table(spark, sf_dir, "documents").select("doc_id", X.drop_contained(X.capitalised_spans(F.col("text"))).alias("spans")).select("doc_id", F.size("spans").alias("n_spans"), F.array_join("spans", "|").alias("spans"))


@query("""
    WITH w AS (SELECT user_id, event_id, CAST(floor(coalesce(value, 0)) AS BIGINT) AS tokens, ts FROM events),
      u AS (SELECT user_id, event_id, tokens, CAST(sum(tokens) OVER f AS BIGINT) AS used_tokens, count(*) OVER f AS used_requests FROM w WINDOW f AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id, used_tokens, used_requests, used_tokens <= 300 AND used_requests <= 4 AND tokens <= 300 AS admitted FROM u""")
def rate_limit(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("tokens"), "ts")
    return limits.window_usage(log, "user_id", seconds=86400, most_tokens=300, most_requests=4).select("user_id", "event_id", "used_tokens", "used_requests", "admitted")


@query("""
    WITH w AS (SELECT event_id, CAST(floor(coalesce(value, 0)) AS BIGINT) AS tokens, ts FROM events),
      u AS (SELECT event_id, tokens, CAST(sum(tokens) OVER f AS BIGINT) AS used_tokens, count(*) OVER f AS used_requests FROM w WINDOW f AS (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW))
    SELECT event_id, used_tokens, used_requests, used_tokens <= 300 AND used_requests <= 20 AND tokens <= 300 AS admitted FROM u""")
def rate_limit_shared(spark, sf_dir):
    """One limit that all users share: every event is of one client."""
    log = table(spark, sf_dir, "events").select(F.lit("all").alias("client"), "event_id", F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("tokens"), "ts")
    return limits.window_usage(log, "client", seconds=3600, most_tokens=300, most_requests=20).select("event_id", "used_tokens", "used_requests", "admitted")


def _log(spark, sf_dir) -> DataFrame:
    """Events as a feedback log: a user's verdict on a proposal for a surface."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string")).alias("surface"), F.concat(F.lit("P"), (F.col("event_id") % 11).cast("string")).alias("proposed"),
        (F.col("event_id") % 3 != 0).alias("accepted"), F.col("event_type").alias("role"), F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("C"), (F.col("event_id") % 5).cast("string"))).alias("correct"), F.lit(None).cast("string").alias("corr_role"),
    )


_LOG = "log AS (SELECT event_id AS seq, 'S' || (user_id % 50) AS surface, 'P' || (event_id % 11) AS proposed, event_id % 3 <> 0 AS accepted, event_type AS role, CASE WHEN event_id % 6 = 0 THEN 'C' || (event_id % 5) END AS correct FROM events)"
_CONFIRMED = """good AS (SELECT seq, lower(surface) AS surface, CASE WHEN accepted THEN proposed ELSE correct END AS canonical, role FROM log WHERE accepted OR correct IS NOT NULL),
      latest AS (SELECT surface, arg_max(canonical, seq) AS canonical, arg_max(role, seq) AS role, max(seq) AS since FROM good GROUP BY surface),
      dead AS (SELECT lower(surface) AS surface, proposed AS canonical, max(seq) AS dead FROM log WHERE NOT accepted GROUP BY ALL),
      conf AS (SELECT surface, canonical, role FROM latest LEFT JOIN dead USING (surface, canonical) WHERE dead IS NULL OR dead <= since)"""


@query(f"WITH {_LOG}, {_CONFIRMED} SELECT * FROM conf")
def feedback_confirmed(spark, sf_dir):
    return B.confirmed(_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT lower(surface) AS surface, proposed FROM log GROUP BY ALL HAVING NOT arg_max(accepted, seq)")
def feedback_rejected(spark, sf_dir):
    return B.rejected(_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT proposed, count(*) AS misses FROM log WHERE NOT accepted GROUP BY proposed ORDER BY misses DESC, min(seq) LIMIT 5")
def top_misses(spark, sf_dir):
    return B.misses(_log(spark, sf_dir)).orderBy(F.col("misses").desc(), "first_seq").limit(5).select("proposed", "misses")


@query(f"""
    WITH {_LOG}, {_CONFIRMED}, mix AS (SELECT proposed, arg_max(correct, seq) AS correct FROM log WHERE NOT accepted AND correct IS NOT NULL GROUP BY proposed),
      rej AS (SELECT lower(surface) AS surface, proposed FROM log GROUP BY ALL HAVING NOT arg_max(accepted, seq)),
      d AS (SELECT seq, surface, proposed AS canonical, 0.9 + (seq % 10) / 100 AS c FROM log),
      j AS (SELECT d.*, conf.canonical AS k, mix.correct AS x, rej.proposed IS NOT NULL AS r FROM d LEFT JOIN conf ON lower(d.surface) = conf.surface LEFT JOIN mix ON d.canonical = mix.proposed LEFT JOIN rej ON lower(d.surface) = rej.surface AND d.canonical = rej.proposed)
    SELECT seq, CASE WHEN k IS NOT NULL THEN k WHEN x IS NOT NULL THEN x WHEN r AND c - 0.4 < 0.7 THEN NULL ELSE canonical END AS canonical,
      round(CASE WHEN k = canonical THEN least(c + 0.06, 0.99) WHEN k IS NOT NULL THEN 0.95 WHEN x IS NOT NULL THEN least(c + 0.03, 0.97) WHEN r AND c - 0.4 < 0.7 THEN 0.0 WHEN r THEN c - 0.4 ELSE c END, 6) AS confidence FROM j""")
def feedback_cascade(spark, sf_dir):
    log = _log(spark, sf_dir)
    d = log.select("seq", "surface", F.col("proposed").alias("canonical"), "role", (F.lit(0.9) + (F.col("seq") % 10) / 100).alias("confidence"), F.lit("phonetic").alias("path"))
    return B.apply_feedback(d, log).select("seq", "canonical", F.round("confidence", 6).alias("confidence"))


@query(f"""
    WITH {_LOG}, {_CONFIRMED}, rej AS (SELECT lower(surface) AS surface, proposed FROM log GROUP BY ALL HAVING NOT arg_max(accepted, seq))
    SELECT 'confirmed' AS view, surface AS k1, canonical AS k2, CAST(NULL AS BIGINT) AS n FROM conf UNION ALL SELECT 'rejected', surface, proposed, NULL FROM rej
    UNION ALL SELECT 'misses', proposed, NULL, count(*) FROM log WHERE NOT accepted GROUP BY proposed
    UNION ALL SELECT 'confusions', proposed, arg_max(correct, seq), NULL FROM log WHERE NOT accepted AND correct IS NOT NULL GROUP BY proposed""")
def feedback_merged(spark, sf_dir):
    """The log's views from summaries of two logs, one of acceptances and one of rejections, merged."""
    log = _log(spark, sf_dir)
    state = cut(snapshots.merge(snapshots.summary(log.where("accepted")), snapshots.summary(log.where("not accepted"))))
    null = F.lit(None)
    views = [
        snapshots.confirmed(state).select(F.lit("confirmed").alias("view"), F.col("surface").alias("k1"), F.col("canonical").alias("k2"), null.cast("long").alias("n")),
        snapshots.rejected(state).select(F.lit("rejected"), "surface", "proposed", null.cast("long")),
        snapshots.misses(state).select(F.lit("misses"), "proposed", null.cast("string"), "misses"),
        snapshots.confusions(state).select(F.lit("confusions"), "proposed", "correct", null.cast("long")),
    ]
    return reduce(DataFrame.union, views)


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text FROM conversations WHERE coalesce(text, '') <> '' GROUP BY conv_id")
def nested_texts(spark, sf_dir):
    """Texts of a document store with nested transcriptions, joined in order."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    documents = t.select(F.lit(0).alias("ord"), F.array(F.struct(F.col("conv_id").cast("string").alias("patientId"), F.transform("t", lambda x: F.struct(x["turn"].cast("string").alias("_id"), x["text"].alias("text"))).alias("transcriptions"))).alias("patientsNotes"))
    return tables.patient_text(documents).where("text <> ''").select(F.col("patientId").cast("long").alias("conv_id"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT doc_id, CAST(greatest(1, floor(len(list_filter(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')) * CAST(1.35 AS DOUBLE) * CAST(1.10 AS DOUBLE))) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT event_id, CASE WHEN v >= 0.92 THEN 'auto_silent' WHEN v >= 0.80 THEN 'auto_log' WHEN v >= 0.70 THEN 'audit' ELSE 'skipped' END AS tier FROM (SELECT event_id, (event_id % 101) / 100 AS v FROM events)")
def confidence_tiers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.tier((F.col("event_id") % 101) / 100).alias("tier"))


@query("SELECT user_id AS note_id, event_type AS canonical, arg_max(props, event_id) AS role FROM events GROUP BY ALL")
def role_maps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("note_id"), F.col("event_type").alias("canonical"), F.col("props").alias("role"), F.col("event_id").alias("ord"))
    return names.role_map(e)


@query("SELECT event_id, regexp_full_match(CASE event_id % 4 WHEN 0 THEN '../' || event_type WHEN 1 THEN repeat('a', 129) WHEN 2 THEN event_type || '_1-c.' ELSE '' END, '[A-Za-z0-9_.-]{0,128}') AS ok FROM events")
def session_ids(spark, sf_dir):
    k = F.col("event_id") % 4
    sid = F.when(k == 0, F.concat(F.lit("../"), "event_type")).when(k == 1, F.lit("a" * 129)).when(k == 2, F.concat("event_type", F.lit("_1-c."))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", X.valid_id(sid).alias("ok"))


_DIGITS = "01230120022455012623010202"


@query(f"""
    WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
      c AS (SELECT word, upper(word) AS u, left(upper(word), 1) || translate(substr(upper(word), 2), 'HW', '') AS bare FROM w),
      d AS (SELECT word, u, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{_DIGITS}') AS d FROM c),
      s AS (SELECT word, u, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS d FROM d)
    SELECT word, left(u, 1) || left(replace(substr(d, 2), '0', '') || '000', 3) AS soundex FROM s""")
def soundex_codes(spark, sf_dir):
    """The native code of each distinct word of the part names."""
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.select("word", F.soundex("word").alias("soundex"))


@query()
def phonetic_codes(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.select("word", F.soundex("word").alias("soundex"), S.metaphone_udf("word").alias("metaphone"), S.nysiis_udf("word").alias("nysiis"))
