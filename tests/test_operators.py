"""Behaviour of the note operators, and determinism under other partitionings."""

import pytest
from pyspark.sql import functions as F

from notemill.operators import feedback, limits, names, redact, restore, terms
from notemill.sources import tables

REGISTRY = [("patient", 0, "Ana Ruiz"), ("patient", 1, "Juana Diaz"), ("patient", 2, "Siobhán Byrne"), ("nurse", 0, "Omar Haddad"), ("nurse", 1, "Ana Ruiz"), ("nurse", 2, " ")]


@pytest.fixture(scope="module")
def registry(spark):
    return names.sanitise(spark.createDataFrame(REGISTRY, "role string, ord long, name string"))


def notes(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "note_id string, text string")


CASES = [
    ("STAFF7 met PATIENT1.", {"PATIENT1": "Ana Ruiz"}, "STAFF7 met Ana Ruiz.", ["STAFF7"]),
    ("PATIENT10 PATIENT1", {"PATIENT1": "A", "PATIENT10": "B"}, "B A", []),
    ("XPATIENT1 PATIENT1X PATIENT1_N", {"PATIENT1": "A"}, "XPATIENT1 PATIENT1X PATIENT1_N", []),
    ("PATIENT1's", {"PATIENT1": "Ana"}, "Ana's", []),
    ("a\r\nb", {"PATIENT1": "Ana"}, "a\nb", []),
    ("PATIENT1 NURSE2", {"PATIENT1": None, "NURSE2": " B "}, "PATIENT1 B", ["PATIENT1"]),
    ("PATIENT1", {"PATIENT1": r"a\b$1"}, r"a\b$1", []),
    ("", {"PATIENT1": "A"}, "", []),
]


@pytest.mark.parametrize("text,pii_map,want,left", CASES)
def test_restore(spark, text, pii_map, want, left):
    row = restore.restore(spark.createDataFrame([(text, pii_map)], "text string, pii_map map<string,string>")).first()
    assert row.restored == want and row.residual == left and row.error is None


def test_restore_errors(spark):
    rows = restore.restore(spark.createDataFrame([(None, {"A": "b"}), ("x", None)], "text string, pii_map map<string,string>")).collect()
    assert [r.error for r in rows] == ["text is null", "no map"] and [r.restored for r in rows] == [None, "x"]


def test_maps_in_nfc(spark):
    rows = spark.createDataFrame([("PATIENT1 é", {"PATIENT1": "Ne\u0301e", "x\u0301 ": 'a "b" \\ c'}), ("PATIENT1", {"PATIENT1": "plain"})], "text string, pii_map map<string,string>")
    got = rows.select(restore.clean_map(F.col("pii_map")).alias("m")).collect()
    assert got[0].m == {"PATIENT1": "N\u00e9e", "x\u0301": 'a "b" \\ c'} and got[1].m == {"PATIENT1": "plain"}
    assert restore.restore(rows).first().restored == "N\u00e9e é"


def test_redact_and_back(spark, registry):
    texts = ["Dr Ana Ruiz met Omar Haddad. Ana Ruiz's bed; ANA RUIZ slept.", "Juana Diaz fell. Juana is fine, Omar Haddad said.", "nobody here", None, ""]
    done, events = redact.redact(notes(spark, *texts), registry)
    rows = {r.note_id: r for r in done.collect()}
    assert rows["0"].redacted == "Dr PATIENT1 met NURSE1. PATIENT1's bed; PATIENT1 slept."
    assert rows["1"].redacted == "PATIENT1 fell. PATIENT1 is fine, NURSE1 said."
    assert rows["0"].pii_map == {"PATIENT1": "Ana Ruiz", "NURSE1": "Omar Haddad"}
    assert rows["2"].redacted == "nobody here" and rows["3"].redacted == "" and rows["3"].pii_map == {}
    back = {r.note_id: r.restored for r in restore.restore(done.select("note_id", F.col("redacted").alias("text"), "pii_map")).collect()}
    assert back["0"] == "Dr Ana Ruiz met Omar Haddad. Ana Ruiz's bed; Ana Ruiz slept."


def test_empty_registry_and_notes(spark, registry):
    none = registry.limit(0)
    done, _ = redact.redact(notes(spark, "Ana Ruiz is here"), none)
    assert done.first().redacted == "Ana Ruiz is here"
    fixed, found = names.correct_names(notes(spark, "Ana Ruiz is here"), none)
    assert fixed.first().corrected == "Ana Ruiz is here" and all(r.is_unresolved for r in found.collect())


def test_correct_names(spark, registry):
    fixed, found = names.correct_names(notes(spark, "today Shivon Byrne and Anna Ruiz walked", "then Omar Hadad came"), registry)
    text = {r.note_id: r.corrected for r in fixed.collect()}
    assert text["0"].endswith("Ana Ruiz walked") and text["1"] == "then Omar Haddad came"
    rows = {r.surface: r for r in found.collect()}
    assert rows["Omar Hadad"].role == "nurse" and rows["Anna Ruiz"].role == "patient" and rows["Anna Ruiz"].tier != "skipped"


def test_same_result_under_any_partitioning(spark, registry):
    got = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spans = spark.createDataFrame([("Anna Ruiz",), ("Juanna Dias",), ("Omar",), ("Zzz Qqq",)], "span string").repartition(int(n))
        got.append(sorted(map(tuple, names.resolve(spans, names.index(registry)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and got[0]


def test_first_name_is_unique(spark):
    reg = spark.createDataFrame([("patient", 0, "Oisin Daly"), ("nurse", 0, "Brenda Foy"), ("patient", 1, "Brenda Kerr")], "role string, ord long, name string")
    spans = names.prepared(spark.createDataFrame([("Oisin",), ("Brenda",)], "span string"))
    rows = names.first_name_matches(spans, names.index(reg)).collect()
    assert [(r.span, r.name, r.confidence) for r in rows] == [("Oisin", "Oisin Daly", 0.9)]


def test_augment(spark, registry):
    extra = spark.createDataFrame([(0, "ana ruiz"), (1, "Nora Kane")], "ord int, name string")
    rows = names.augment(registry, extra).where("name = 'Nora Kane' or lower(name) = 'ana ruiz'").collect()
    assert sorted((r.role, r.name) for r in rows) == [("nurse", "Ana Ruiz"), ("patient", "Ana Ruiz"), ("patient", "Nora Kane")]


@pytest.mark.parametrize("before,after,ok", [("abcd", "a", False), ("abcd", "a" * 9, False), ("PATIENT1 ok", "nobody ok", False), ("all good", "PATIENT2 good", True), ("abcd", "  ", False), ("abcd", None, False)])
def test_guard(spark, before, after, ok):
    row = spark.createDataFrame([(before, after)], "a string, b string").select(terms.guard(F.col("a"), F.col("b"), terms.STANDARD_BOUNDS).alias("g")).first().g
    assert row.ok is ok and row.text == (after.strip() if ok else before)


def test_drift(spark):
    df = spark.createDataFrame([("She refused food again", "She ate"), ("She refused", "She declined")], "a string, b string")
    rows = [r.d for r in df.select(terms.safety_drift(F.col("a"), F.col("b")).alias("d")).collect()]
    assert rows[0].refusal_lost and rows[0].recurrence_lost and not rows[1].any_drift


def test_diff_and_stages(spark):
    df = notes(spark, "pt has b p high")
    row = terms.standardise(df, [("b p", "BP")]).first()
    assert row.standard == "pt has BP high" and [(c.kind, c.original, c.corrected) for c in row.corrections] == [("replace", "b p", "BP")]
    bad = terms.professionalise(terms.standardise(df, []).drop("ok", "corrections"), lambda c: F.lit("ERROR: no")).first()
    assert bad.professional == "pt has b p high" and bad.ok
    short = terms.professionalise(terms.standardise(df, []).drop("ok", "corrections"), lambda c: F.lit("x")).first()
    assert short.professional == "pt has b p high" and not short.ok


def test_prompt_tables(spark):
    t = spark.createDataFrame([(0, "BP", "Blood pressure", ["b p", "bee pee"]), (1, "X", "x", ["ex"])], "ord long, term string, meaning string, variants array<string>")
    assert terms.markdown_misheard(t).first()[0].split("\n")[2:] == ["| bee pee | BP |", "| b p | BP |", "| ex | X |"]
    assert terms.markdown_professional(t).first()[0].split("\n")[2:] == ["| BP | Blood pressure |"]
    p = t.limit(1).select(terms.prompt("Rules.", F.lit("T"), F.col("term"), [("a", "b")]).alias("p")).first().p
    assert [m.role for m in p] == ["system", "user"] and "Input: a" in p[0].content


LOG = "seq long, surface string, proposed string, accepted boolean, role string, correct string, corr_role string"


def test_feedback(spark):
    log = spark.createDataFrame([(1, "anna", "Ana Ruiz", True, "patient", None, None), (2, "anna", "Ana Ruiz", False, "patient", "Joan Roe", "nurse"), (3, "bo", "Bob", False, "patient", None, None), (4, "bo", "Bob", False, "patient", None, None)], LOG)
    assert [tuple(r) for r in feedback.confirmed(log).collect()] == [("anna", "Joan Roe", "nurse")]
    assert {tuple(r) for r in feedback.rejected(log).collect()} == {("anna", "Ana Ruiz"), ("bo", "Bob")}
    assert {r.proposed: r.misses for r in feedback.misses(log).collect()} == {"Ana Ruiz": 1, "Bob": 2}
    d = spark.createDataFrame([("anna", "Joan Roe", "nurse", 0.9, "p"), ("x", "Ana Ruiz", "patient", 0.9, "p"), ("bo", "Bob", "patient", 0.95, "p"), ("q", "Zed", "patient", 0.8, "p")], "surface string, canonical string, role string, confidence double, path string")
    rows = {r.surface: r for r in feedback.apply_feedback(d, log).collect()}
    assert rows["anna"].path == "p+confirmed" and round(rows["anna"].confidence, 2) == 0.96
    assert rows["x"].canonical == "Joan Roe" and rows["x"].path == "learned_confusion"
    assert rows["bo"].canonical is None and rows["bo"].confidence == 0 and rows["q"].path == "p"
    assert feedback.stats(log).first().most_missed[0].proposed == "Bob"


def test_limits(spark):
    rows = spark.createDataFrame([("k", 0, 10), ("k", 60, 10), ("k", 61, 99)], "key string, s long, tokens long").withColumn("ts", F.timestamp_seconds("s"))
    used = [r.used_tokens for r in limits.window_usage(rows, "key", most_tokens=50).orderBy("s").collect()]
    assert used == [10, 20, 109]  # 60 s ago still counts


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name\n Ana Ruiz \n\nBo Lee\n")
    assert [r.name for r in tables.read_registry(spark, f"file://{tmp_path}/r.csv", "patient").orderBy("ord").collect()] == ["Ana Ruiz", "Bo Lee"]
    assert tables.read_registry(spark, f"file://{tmp_path}/none.csv", "patient").isEmpty()
    (tmp_path / "t.csv").write_text("Term,Actual Meaning,Voice Misinterpretations\nBP,Blood pressure,\"['b p', 'bee pee']\"\n")
    assert tables.read_terms(spark, f"file://{tmp_path}/t.csv").first().variants == ["b p", "bee pee"]
    assert tables.read_terms(spark, f"file://{tmp_path}/none.csv").isEmpty()
    maps = spark.createDataFrame([("s1", "PATIENT1", "Ana")], "session_id string, token string, canonical string")
    tables.write_maps(maps, f"file://{tmp_path}/maps")
    tables.write_maps(maps.withColumn("session_id", F.lit("s2")), f"file://{tmp_path}/maps")
    assert {r.session_id for r in tables.read_maps(spark, f"file://{tmp_path}/maps").collect()} == {"s1", "s2"}
    docs = spark.createDataFrame([(0, [("p1", [("a", "x"), ("b", ""), ("c", "y")])]), (1, [("p1", [("d", "z")])])], "ord int, patientsNotes " + tables.NOTES)
    assert tables.patient_text(docs).first().text == "x\n\ny" and tables.note_text(docs, "d").first().text == "z"
    assert tables.Options.from_conf(spark).threshold == 78.0


def test_stream(spark, tmp_path):
    from notemill.streaming import notes as N

    src = f"file://{tmp_path}/in"
    spark.createDataFrame([("PATIENT1", {"PATIENT1": "Ana"})], "text string, pii_map map<string,string>").write.parquet(src)
    stream = N.restore_stream(spark.readStream.schema("text string, pii_map map<string,string>").parquet(src))
    q = stream.select("restored").writeStream.format("memory").queryName("restored").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select restored from restored").first()[0] == "Ana"


def test_window_detector_and_recogniser(spark):
    reg = spark.createDataFrame([("patient", 0, "Marcus O'Reilly"), ("nurse", 0, "Dharani Kumar"), ("patient", 1, "Emma Thompson"), ("patient", 2, "Anne Kelly")], "role string, ord long, name string")
    df = notes(spark, "nurse dharanee kumar said markus oreilly ate", "Nurse DHARANEE KUMAR came", "Emma Thompson and Anne Thompson", "nothing here at all", "", None)
    spans = {(r.note_id, r.span) for r in names.window_detector(df, reg, "note_id", "text").collect()}
    assert any("dharanee kumar" in b.lower() for a, b in spans if a == "0") and any("markus oreilly" in b for a, b in spans if a == "0")
    fixed, found = names.correct_names(df, reg)
    text = {r.note_id: r.corrected for r in fixed.collect()}
    assert "Dharani Kumar" in text["0"] and "Marcus O'Reilly" in text["0"] and "Dharani Kumar" in text["1"] and text["3"] == "nothing here at all" and text["5"] is None
    rows = {(r.note_id, r.surface): r for r in found.collect()}
    assert rows["2", "Anne Thompson"].path in ("contamination_filter", "phonetic", "first_name") and rows["2", "Anne Thompson"].canonical == "Anne Kelly"
    counts = {r.note_id: r for r in names.detection_counts(found).collect()}
    assert counts["0"].corrected == 2 and "3" not in counts

    def recogniser(notes_, id_col, text_col):
        return notes_.where(F.contains(text_col, F.lit("said"))).select(id_col, F.lit("said markus").alias("span"))

    _, with_ner = names.correct_names(df, reg, recogniser=recogniser)
    assert "ner" in {r.method for r in with_ner.collect()}


PLAIN = [
    "We are in one house, neither here nor there. All of them saw it, and one was for another. Others ran.",
    "Das Haus von der Stadt. Dann kam der Bus, und die Kinder waren nach einer Stunde wieder hier. Aber alle sahen es.",
    "La maison est dans la ville. Mais elle n'est pas ici, et une autre personne marche sous la pluie. Alors ils restent.",
    "La casa de la ciudad es grande. Pero ella no está aquí, y otra persona camina bajo la lluvia. Nadie sale.",
    "She ate well, then walked around the garden; there were no marks on her arms and her brain scan was clear.",
    "Then the team agreed on a plan. Later on, meals were given and fluids charted. Bring more towels.",
]
SAID = [("saw {} at noon.", "en"), ("Heute kam {} vorbei.", "de"), ("Hier {} est venue.", "fr"), ("Ayer {} comió bien.", "es")]


def test_names_are_corrected_and_ordinary_words_stay(spark):
    """Planted names in sentences of four languages, misspelt by one letter, and texts without any."""
    import random

    from notemill.functions import lexicons as L

    r = random.Random(8)
    people = [n for n in L.curated_names() if all(len(t) > 3 for t in n.replace("'", "").split())]
    rows = []
    for i in range(80):
        name = r.choice(people)
        word = list(name)
        at = r.choice([k for k in range(2, len(word) - 1) if word[k].isalpha() and word[k - 1].isalpha()])
        kind = i % 3
        word[at : at + 1] = {0: [word[at], word[at]], 1: [], 2: [r.choice("aeiou") if word[at] in "aeiou" else word[at]]}[kind]
        rows.append((f"p{i}", name, SAID[i % 4][0].format("".join(word))))
    reg = names.curated_registry(spark).select(F.lit("patient").alias("role"), F.col("ord").cast("long").alias("ord"), "name")
    given = [(i, t) for i, _, t in rows] + [(f"n{i}", t) for i, t in enumerate(PLAIN)]
    fixed, _ = names.correct_names(spark.createDataFrame(given, "note_id string, text string"), reg)
    text = {x.note_id: x.corrected for x in fixed.collect()}
    assert [text[f"n{i}"] for i in range(len(PLAIN))] == PLAIN
    wrong = [(text[i], SAID[int(i[1:]) % 4][0].format(n)) for i, n, _ in rows if text[i] != SAID[int(i[1:]) % 4][0].format(n)]
    assert len(wrong) <= 4, wrong  # recall, and the right person, of 0.95


def test_without_strict_every_score_counts(spark):
    reg = spark.createDataFrame([("patient", 0, "Margaret Walsh"), ("patient", 1, "Niall McCarthy")], "role string, ord long, name string")
    spans, entries = spark.createDataFrame([("are",), ("all",), ("Margret Walsh",), ("margaret",)], "span string"), names.index(reg)
    assert {x.span for x in names.resolve(spans, entries).collect()} >= {"are", "all", "Margret Walsh", "margaret"}
    assert {x.span for x in names.resolve(spans, entries, strict=True).collect()} == {"Margret Walsh", "margaret"}


def test_redact_with_a_detector_and_maps(spark, registry, tmp_path):
    def detector(notes_, id_col, text_col):
        return notes_.select(id_col, F.explode(F.array(F.lit("Dr ana ruiz"), F.lit("ruiz"), F.lit("the"), F.lit("Zed"))).alias("span"))

    done, events = redact.redact(notes(spark, "Dr ana ruiz slept"), registry, detector=detector, maps_path=f"file://{tmp_path}/maps")
    assert done.first().redacted == "Dr PATIENT1 slept" and [r.span for r in events.collect()] == ["ana ruiz"]
    assert [tuple(r) for r in tables.read_maps(spark, f"file://{tmp_path}/maps").collect()] == [("PATIENT1", "Ana Ruiz", "0")]


def test_candidates_lose_nothing(spark):
    """The same best names as scoring every span against the whole registry."""
    import random

    from notemill.functions import lexicons as L
    from notemill.functions import similarity as S

    r = random.Random(5)
    reg = [("patient" if i % 2 else "nurse", i, n) for i, n in enumerate(L.curated_names())]
    spans = set()
    for _ in range(400):
        w = list(r.choice(L.curated_names()).replace("'", ""))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice("abcdeiou rst")
        spans.add("".join(w).strip().title())
    spans |= {"Boyle", "Doyle", "Murphy Murphy", "Mary", "X", "Zq"}
    spans = {s for s in spans if s}
    registry_ = spark.createDataFrame(reg, "role string, ord long, name string")
    got = {x.span: (x.canonical, x.role, x.confidence) for x in redact.confirm(spark.createDataFrame([(s,) for s in spans], "span string"), registry_).collect()}
    import re as re_

    fold = lambda t: "".join(c for c in __import__("unicodedata").normalize("NFD", t) if __import__("unicodedata").category(c) != "Mn" and c not in "'’ʼ").lower()

    def accents(t):
        for p, new in L.accent_rules():
            t = re_.sub(p, new, t, flags=re_.I)
        return t

    for s in spans:
        scored = [((S.match_score(fold(accents(s)), fold(n), 78)), role, i, n) for role, i, n in reg]
        scored = [(x, role, i, n) for x, role, i, n in scored if x is not None]
        if not scored:
            assert s not in got, s
            continue
        best = max(round(x + 1e-12, 2) for x, *_ in scored)
        assert s in got and got[s][2] == pytest.approx(best, abs=0.0101), s
        assert got[s][0] in {n for x, _, _, n in scored if x >= best - 0.0101}, s


def test_store_retry_and_settings(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert feedback.load(spark, path).isEmpty()
    rows = spark.createDataFrame([(1, "anna", "Ana Ruiz", True, "patient", None, None)], LOG)
    feedback.append(rows, path)
    feedback.append(rows.withColumn("seq", F.lit(2).cast("long")), path)
    assert feedback.load(spark, path).count() == 2
    feedback.reset(spark, path)
    assert feedback.load(spark, path).isEmpty()
    (tmp_path / "other" / "version=0").mkdir(parents=True)
    assert feedback.load(spark, f"file://{tmp_path}/other").isEmpty()
    slept, answers = [], iter([RuntimeError("429 rate limit, retry after 3.5 s"), "ERROR: busy", "", "fine"])

    def chat(text):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert terms.call(chat, "t", sleep=slept.append) == "fine" and slept == [4.5, 1.0, 2.0]
    assert terms.call(lambda t: "ok", "t", sleep=slept.append) == "ok"
    assert 1.6 <= terms.wait_for("429", 0) <= 2.4 and terms.wait_for("429", 9) == 90.0
    df = notes(spark, "b p high today")
    row = terms.professionalise(terms.standardise(df, []).drop("ok", "corrections"), terms.rewriter_of(lambda t: "Here is the note: " + t.upper())).first()
    assert row.professional == "B P HIGH TODAY" and row.ok
    (tmp_path / "c.yaml").write_text("llm:\n  provider: none\n  limits:\n    window_tokens: 77\nthreshold: 81\n")
    own = tables.Options.from_yaml(spark, f"file://{tmp_path}/c.yaml")
    assert own.window_tokens == 77 and own.threshold == 81.0 and tables.Options.from_yaml(spark, f"file://{tmp_path}/no.yaml") == tables.Options()
    assert tables.store(spark, own, "names") is None
    back = spark.createDataFrame([("nurse", 0, "Bo Lee")], "role string, ord long, name string")

    def broken():
        raise OSError("no store")

    assert tables.registry_from(broken, back, "nurse").first().name == "Bo Lee"
    assert tables.registry_from(lambda: None, back, "nurse").first().name == "Bo Lee"
    assert [x.name for x in tables.registry_from(lambda: back.select("name").union(back.select(F.lit(" Al Fox "))), back, "nurse").orderBy("ord").collect()] == ["Al Fox", "Bo Lee"]
    ids = spark.createDataFrame([("ABCDEF0123456789abcdef01",), ("n-7",)], "x string").select(tables.parse_id(F.col("x"))).collect()
    assert [x[0] for x in ids] == ["abcdef0123456789abcdef01", "n-7"]
    requests = spark.createDataFrame([("a", " "), ("b", "own"), ("c", None)], "k string, txt string")
    found = tables.resolve_text(requests, spark.createDataFrame([("a", "stored")], "k string, text string"), "k")
    assert {(x.k, x.text, x.status) for x in found.collect()} == {("a", "stored", "ok"), ("b", "own", "ok"), ("c", None, "no text")}


def test_maps_with_repeated_tokens(spark):
    maps = spark.createDataFrame([("s", "PATIENT1", "Ana"), ("s", "PATIENT1", "Bea"), ("s", None, "x"), ("s", "NURSE1", None)], "session_id string, token string, canonical string")
    rows = {r.session_id: r for r in restore.with_maps(spark.createDataFrame([("s",), ("t",)], "session_id string"), maps).collect()}
    assert rows["s"].pii_map == {"PATIENT1": "Bea"} and rows["s"].map_status == "loaded" and rows["t"].map_status == "missing" and rows["t"].pii_map == {}
    row = restore.restore(spark.createDataFrame([("PATIENT1 ok", {"PATIENT1": "A", "NURSE9": "B"})], "text string, pii_map map<string,string>")).first()
    assert row.unused == ["NURSE9"]


def test_exact_stream_limiter(spark, tmp_path):
    from notemill.streaming import notes as N

    rows = [("k%d" % (i % 2), i * 7 % 200 + i // 10 * 0, 5 + i) for i in range(40)]
    rows = [(k, s + i / 1000, n) for i, (k, s, n) in enumerate(sorted(rows, key=lambda x: x[1]))]
    schema = "key string, s double, tokens long"
    df = lambda own: spark.createDataFrame(own, schema).withColumn("ts", F.timestamp_micros((F.col("s") * 1000000).cast("long")))
    src = f"file://{tmp_path}/in"
    df(rows[:20]).coalesce(1).write.parquet(src)
    stream = N.exact_usage_stream(spark.readStream.schema(df([]).schema).option("maxFilesPerTrigger", 1).parquet(src), "key", most_tokens=100)
    q = stream.writeStream.format("memory").queryName("usage").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    df(rows[20:]).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.tokens, r.used_tokens, r.used_requests, r.admitted) for r in spark.sql("select * from usage").collect()}
    want = {(r.key, r.tokens, r.used_tokens, r.used_requests, r.admitted) for r in limits.window_usage(df(rows), "key", most_tokens=100).collect()}
    assert got == want and len(got) == 40


def _usage_by_hand(rows, seconds):
    """Of (id, key, micros or None, tokens): id -> tokens and requests in the window that ends there."""
    span, out = seconds * 1_000_000, {}
    for i, k, t, _ in rows:
        own = [n or 0 for _, l, u, n in rows if l == k and ((t is None and u is None) or (t is not None and u is not None and t - span <= u <= t))]
        out[i] = (sum(own), len(own))
    return out


@pytest.mark.parametrize("hot", [0.0, 1.0])
def test_limits_spread_over_ranges(spark, hot):
    """All rows of one client, or of several with null keys, times and tokens, ties included: as by hand, whatever the ranges."""
    import random

    r = random.Random(7)
    rows = [(i, "hot" if r.random() < hot else r.choice(["a", "b", None]), None if hot < 1 and r.random() < 0.1 else r.randrange(400) * 500_000, r.choice([None, -2, 0, 5, 90])) for i in range(600)]
    log = spark.createDataFrame(rows, "id long, key string, us long, tokens long").withColumn("ts", F.timestamp_micros("us")).withColumn("used_tokens", F.lit("clash"))
    got = limits.window_usage(log, "key", seconds=7, most_tokens=300, most_requests=20)
    assert got.columns == ["id", "key", "us", "tokens", "ts", "used_tokens", "used_requests", "admitted"]
    want = _usage_by_hand(rows, 7)
    found = {x.id: (x.used_tokens, x.used_requests) for x in got.collect()}
    assert found == want
    assert limits.window_usage(log.limit(0), "key").isEmpty()


def test_no_task_takes_a_client(spark):
    """The ranges split the one client's rows: none holds twice the median."""
    from notemill.operators.limits import _running

    log = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("us"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("c"))
    parts = log.repartitionByRange(8, "k", "us").sortWithinPartitions("k", "us").mapInArrow(_running, "k string, us long, kind int, n long, c long, part int")
    sizes = sorted(x["count"] for x in parts.groupBy("part").count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[4]


def test_settled_stream_limiter(spark, tmp_path):
    """Shuffled requests in several batches equal the table's windows; late ones are left out; state of idle clients goes."""
    import random

    from notemill.streaming import notes as N

    r = random.Random(3)
    schema = "id long, key string, us long, tokens long"
    rows = [(i, r.choice("abc"), i * 900_000 + r.randrange(-20, 20) * 1_000_000 + 60_000_000, r.randrange(50)) for i in range(120)]
    rows += [(200, "a", rows[5][2], None), (201, "a", rows[5][2], 4)]
    late, flush = (900, "a", 61_000_000, 7), (901, "end", 10_000_000_000, 1)
    df = lambda own: spark.createDataFrame(own, schema).withColumn("ts", F.timestamp_micros("us")).select("key", "ts", "tokens")
    src, name = f"file://{tmp_path}/in", "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    with pytest.raises(ValueError):
        N.settled_usage_stream(df(rows), "key")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df(rows[:1]).limit(0).write.parquet(src)
        stream = N.settled_usage_stream(spark.readStream.schema("key string, ts timestamp, tokens long").parquet(src), "key", seconds=30, most_tokens=200, late="60 seconds")
        q = stream.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
        for own in (rows[:40] + rows[120:], rows[40:80], rows[80:120], [late], [flush], [(902, "end", 10_200_000_000, 1)]):
            df(own).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
        state = q.lastProgress["stateOperators"][0] if q.lastProgress["stateOperators"] else None
        dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
        q.stop()
    finally:
        spark.conf.set(name, old)
    columns = ["key", "ts", "tokens", "used_tokens", "used_requests", "admitted"]
    got = sorted(map(tuple, spark.sql("select * from settled where key <> 'end'").select(columns).collect()))
    want = sorted(map(tuple, limits.window_usage(df(rows).fillna(0), "key", seconds=30, most_tokens=200).select(columns).collect()))
    assert got == want and len(got) == 122 and dropped == 1
    assert state["numRowsTotal"] < 10, state  # one client is left
