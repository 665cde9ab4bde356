"""Behaviour of the column functions, on invented values."""

import pyarrow as pa
from pyspark.sql import functions as F

from notemill.functions import lexicons as L
from notemill.functions import text as X


def one(spark, build, *values):
    """The value of ``build`` over one row of the given columns a, b, c."""
    names = "abcdef"[: len(values)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(build(*[F.col(n) for n in names])).first()[0]


def test_lexicon_sizes():
    assert len(L.accent_rules()) == 108 and len(L.phonetic_variants()) == 117
    assert len(L.curated_names()) == 108 and len(L.SURNAMES) == 85 and len(L.first_names()) == 117


def test_fold(spark):
    assert one(spark, X.name_fold, "Siobhán O’Neill") == "siobhan oneill"
    assert one(spark, X.name_fold, "Siobhán") == one(spark, X.name_fold, "Siobhán")
    assert one(spark, X.latin_fold, "Nóra D'Arcy") == "nora darcy"
    assert one(spark, X.nfc, "é") == "é"


def test_accents_and_variants(spark):
    assert one(spark, X.accent_normalise, "Shon o  Brien") == "sean obrien"
    assert one(spark, X.phonetic_variant, "shivawn grawn ya obrien Zed") == "Siobhán Gráinne O'Brien Zed"
    assert one(spark, X.name_prefix, "Macarthy") == "mcarthy"


def test_honorific(spark):
    assert one(spark, X.strip_honorific, "Dr. Ana Ruiz") == "Ana Ruiz"
    assert one(spark, X.strip_honorific, "Dr") == "Dr"


def test_name_to_token(spark):
    rewrite = lambda text: one(spark, X.name_to_token, text, "Ana", "PATIENT1")
    assert rewrite("Ana's bed, ANA and ana.") == "PATIENT1's bed, PATIENT1 and PATIENT1."
    for text in ("Anafield", "D'Ana", "Ana-Lee"):
        assert rewrite(text) == text
    assert one(spark, X.name_to_token, "A+b (x)", "A+b", "T$1\\") == "T$1\\ (x)"


def test_replace_word(spark):
    assert one(spark, X.replace_word, "shon, Shona SHON", "shon", "Sean$\\") == "Sean$\\, Shona Sean$\\"


def test_prepass(spark):
    rules = [("met formin", "Metformin"), ("formin", "Form"), ("b p", "BP")]
    text, done = X.prepass(F.col("a"), rules)
    row = spark.createDataFrame([("Met formin, formin; b p bp xb p",)], "a string").select(text, done).first()
    assert row[0] == "Metformin, Form; BP bp xb p"
    assert [tuple(x) for x in row[1]] == [("met formin", "Metformin"), ("formin", "Form"), ("b p", "BP")]


def test_spans(spark):
    assert one(spark, X.capitalised_spans, "on Monday, Ana Ruiz met O'Brien and McGrath; Al") == ["Ana Ruiz", "O'Brien", "McGrath"]
    spans = spark.createDataFrame([(["Ana", "Ana Ruiz", "ruiz", "Bo", "bo"],)], "a array<string>").select(X.drop_contained(F.col("a"))).first()[0]
    assert spans == ["Ana Ruiz", "Bo"]
    grams = one(spark, lambda a: X.ngrams(a, [2, 1]), "a b c")
    assert [(g.n, g.at, g.span) for g in grams] == [(2, 0, "a b"), (2, 1, "b c"), (1, 0, "a"), (1, 1, "b"), (1, 2, "c")]
    assert one(spark, lambda a: X.ngrams(a, [3]), "a b") == []


def test_ids_and_tiers(spark):
    for value, good in (("../x", False), ("a" * 129, False), ("a_b-1.c", True), ("", True)):
        assert one(spark, X.valid_id, value) is good
    rows = spark.createDataFrame([(x,) for x in (0.92, 0.8, 0.7, 0.69)], "v double").select(X.tier(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["auto_silent", "auto_log", "audit", "skipped"]


def test_small_ones(spark):
    assert one(spark, X.unix_lines, "a\r\nb\rc") == "a\nb\nc"
    assert one(spark, X.first_name_alias, "Juana Diaz") == "Juana" and one(spark, X.first_name_alias, "Ana Ruiz") is None
    assert one(spark, X.estimate_tokens, "") == 1 and one(spark, X.estimate_tokens, "one two three") == 4
    assert one(spark, X.json_list, r"""['a, b', "c\"d", 'it\'s', bare , '']""") == ["a, b", 'c"d', "it's", "bare"]
    assert one(spark, X.json_list, "['b p', \"B.P\"]") == ["b p", "b.p"] and one(spark, X.json_list, None) == []
    assert one(spark, X.strip_preamble, "Sure, here is the note: Fine.") == "Fine."
    assert one(spark, X.strip_preamble, "Fine.\nNote: stays") == "Fine.\nNote: stays"
    assert one(spark, X.protection_tokens, "PATIENT1 MANAGER2 xPATIENT3 PATIENT1") == ["PATIENT1", "MANAGER2"]


def test_nfc_is_skipped_only_where_it_changes_nothing():
    """Every character that NFC changes, alone or after another, is one that the guard sees."""
    import re
    import sys
    import unicodedata

    guard = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U%08x" % int(m[1], 16), X.NOT_NFC).replace(r"\p{M}", ""))
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if not 0xD800 <= i < 0xE000 and unicodedata.normalize("NFC", c) != c:
            assert guard.search(c) or unicodedata.category(c)[0] == "M", hex(i)
        elif unicodedata.combining(c):
            assert unicodedata.category(c)[0] == "M", hex(i)


def test_fold_of_ascii_and_beyond(spark):
    rows = ["O'Neill", "ÁB", "", "Zoë d’Arc", None, "İz"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(X.name_fold(F.col("x"))).collect()]
    assert got == [None if x is None else X._fold(x) for x in rows]


def test_windows_by_size(spark):
    texts = [None, "", "  ", "a", " a  b\tc d e a b ", "x " * 7]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.windows(F.col("t"), [4, 1, 2]).alias("w"), X.ngrams(F.col("t"), [3, 1]).alias("g")).orderBy("i").collect()
    for text, r in zip(texts, rows):
        words = (text or "").split()
        of = lambda n: [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]  # noqa: B023, E731
        assert [(x.n, x.spans) for x in r.w] == [(n, of(n)) for n in (4, 1, 2)]
        assert [tuple(x) for x in r.g] == [(n, i, s) for n in (3, 1) for i, s in enumerate(of(n))]


def test_long_texts_are_folded_in_slices(monkeypatch):
    """Of an Arrow batch of long texts, some MB are Python strings at once."""
    now = pa.array(["É’a" * 1000, None, "", "ß" * 10])
    monkeypatch.setattr(X, "_SLICE", 2000)
    lists = []
    real = pa.array
    monkeypatch.setattr(X.pa, "array", lambda x, *a: lists.append(len(x)) or real(x, *a))
    for texts in (now, now.slice(1, 2), now.slice(0, 0)):
        assert X._sliced(texts, X._fold).to_pylist() == [None if x is None else X._fold(x) for x in texts.to_pylist()]
    lists.clear()
    X._sliced(real(["é" * 999] * 50), X._fold)
    assert max(lists) <= 2
