"""Steps of a note that once compared all pairs, against plain ones that do."""

import random
import time

from pyspark.sql import functions as F

from notemill.functions import similarity as S
from notemill.functions import text as X
from notemill.operators import blocking, names
from notemill.operators.redact import covering


def test_contained_spans_by_hand(spark):
    r = random.Random(2)
    lists = [None, [], ["Ana"], ["Ana", "ANA"], ["", "a"], ["", ""]] + [["".join(r.choice("aAb ") for _ in range(r.randint(1, 6))) for _ in range(r.randint(2, 12))] for _ in range(200)]
    got = [x.s for x in spark.createDataFrame(list(enumerate(lists)), "i long, l array<string>").select("i", X.drop_contained(F.col("l")).alias("s")).orderBy("i").collect()]
    for spans, kept in zip(lists, got):
        if spans is None:
            assert kept is None
            continue
        first = {}
        for i, s in enumerate(spans):
            first.setdefault(s.lower(), i)
        want = [s for low, i in first.items() for s in [(-len(spans[i]), i)] if not any(len(o) > len(low) and low in o for o in first)]
        assert kept == [spans[i] for _, i in sorted(want)], spans


def test_many_spans_take_no_time():
    r = random.Random(3)
    spans = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(r.randint(1, 4))) for _ in range(10_000)]
    start = time.time()
    assert len(X._outer(spans, spans)) > 9_000
    assert time.time() - start < 5  # pairs would take minutes


def test_covering_by_hand(spark):
    r = random.Random(4)
    rows = [(str(note), r.randint(1, 4), r.randrange(30)) for note in range(30) for _ in range(25)]
    rows += [("long", 1 + i % 4, i) for i in range(100_000)]
    found = spark.createDataFrame(rows, "note_id string, n int, at int").select("*", F.concat_ws("-", "n", "at").alias("span"), F.lit("c").alias("canonical"), F.lit("r").alias("role"), F.lit(1.0).alias("confidence"))
    got = {}
    for x in covering(found).orderBy("note_id", "o").collect():
        got.setdefault(x.note_id, []).append(x.span)
    for note in {x[0] for x in rows}:
        used, want = set(), []
        for n, at in sorted(((n, at) for i, n, at in rows if i == note), key=lambda x: (-x[0], x[1])):
            own = set(range(at, at + n))
            if not own & used:
                used |= own
                want.append(f"{n}-{at}")
        assert got[note] == want


def test_tokens_are_linked_as_one_by_one():
    rng = random.Random(5)
    tokens = ["mary", "murphy", "mccarthy", "osullivan", "ann", "x" * 70, "margaret", "fitz gerald", "st"]
    words = ["".join(rng.choice("amruphyncte'é") for _ in range(rng.randint(1, 14))) for _ in range(3000)] + tokens + ["maccarty", "o'", "mary\x1cann", "mc\x1cx", "y" * 65, "x" * 64, "a margaret b"]
    found = {(w, t) for w, t in blocking.Common(tokens).near(words, 0.0) if S.token_score(w, t) >= blocking.LEAST}
    assert found == {(w, t) for w in words for t in tokens if S.token_score(w, t) >= blocking.LEAST}
    alike = {(w, t) for w, t in blocking.Common(tokens).near(words, names.ALIKE) if S.plausible(w, t, False) and S.token_score(w, t) >= blocking.LEAST}
    assert alike == {(w, t) for w, t in found if S.plausible(w, t, False)}


def test_spans_of_ordinary_words_are_not_scored(spark):
    """Only spans whose every word is like one of a name go on; what the blocked stage finds is among them."""
    entries = names.index(spark.createDataFrame([("patient", 0, "Mary Murphy"), ("nurse", 1, "Siobhán O'Sullivan")], "role string, ord int, name string"))
    texts = ["Mary Murphie", "Mari Murphy", "Siobhan OSullivan", "The Garden", "Mary Garden", "Murpy", "Garden", "Sive Murfy", "mary murphie"]
    own = names.prepared(spark.createDataFrame([(x,) for x in texts], "span string"))
    able = names.readable(own, entries)
    assert not {"The Garden", "Mary Garden", "Garden"} & {r.span for r in able.select("span").collect()}
    rows = lambda d: sorted(map(tuple, d.collect()))
    for find in (lambda s: names.blocked_matches(s, entries, strict=True), lambda s: names.first_name_matches(s, entries, strict=True)):
        assert rows(find(able)) == rows(find(own))
    assert rows(names.blocked_matches(able, entries, strict=True))


def test_windows_are_formed_where_a_name_can_begin(spark):
    """As by forming all windows and judging each; with the registry's largest number of tokens, only windows of more go."""
    import random

    from pyspark.sql import functions as F

    from notemill.functions import lexicons as L
    from notemill.functions import text as X
    from notemill.operators import redact

    parts = ["Mary", "murphy", "--", "Dr.", "dr", "MRS...", "(O", "o", "Brien", "brien's,", "Ⓐb", "Ⓐ", "_X", "Élan", "élan", "a B", "ab Cd", "x\x1cY", "ʼʼ", "ʼA", "²", "7th", "the", "Áb", "ſir", "Nurse", "The", "pain"]
    rng = random.Random(3)
    rows = [(str(i), " ".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(400)] + [("n", None)]
    notes = spark.createDataFrame(rows, "note_id string, text string")
    bare = lambda g: F.struct(g["n"].alias("n"), g["at"].alias("at"), F.regexp_replace(g["span"], r"(?U)\A[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+\z", "").alias("span"))
    grams = F.filter(X.ngrams(F.col("text"), [4, 3, 2, 1]), lambda g: g["span"].rlike(r"(?U)\A\P{Alnum}*\p{Lu}|\A\S+\s+\P{Alnum}*\p{Lu}"))
    every = notes.select("note_id", F.explode(F.transform(grams, bare)).alias("g")).select("note_id", "g.*").withColumn("bare", X.strip_honorific(F.col("span")))
    stop = F.array(*map(F.lit, L.ENTITY_STOP_WORDS))
    every = every.where(F.col("bare").rlike(r"^\p{Lu}") & (F.length("bare") >= 4) & (F.size(F.array_except(F.split(F.lower("bare"), " +"), stop)) > 0)).drop("bare")
    whole = set(map(tuple, every.collect()))
    assert len(whole) > 500 and set(map(tuple, redact.windows(notes).collect())) == whole
    few = set(map(tuple, redact.windows(notes, most=2).collect()))
    assert few < whole
    gone = spark.createDataFrame(sorted(whole - few), every.schema).select(F.explode(F.array(F.btrim("span"), X.strip_honorific(F.col("span")))).alias("form"))
    gone = gone.withColumn("a", X.accent_normalise(F.col("form"))).select(X.name_fold(F.col("a")).alias("f"))
    assert all(len([t for t in r.f.split() if len(t) > 1]) > 2 for r in gone.collect())


def test_batches_score_tokens_as_one_by_one():
    from notemill.functions import lexicons as L
    from notemill.functions import similarity as S
    from notemill.operators.blocking import LEAST, Common

    tokens = sorted({t for n in L.curated_names() for t in n.lower().replace("'", "").split()} | {"ann", "mac donald", "x"})
    words = sorted({t[:k] + x + t[k:] for t in tokens for k in (0, 2, 5) for x in ("", "q", "er", "annmar", "macintosh")} | {"are", "von", "a", "mcdonald", "annabellalongwordindeed", "no blank", "macauley"})
    for least_ratio in (0.0, 70.0):
        for w, t, r in Common(tokens).rated(words, least_ratio):
            assert r is None or (r == S.wratio(S.prefix_normal(w), S.prefix_normal(t)) and S.with_codes(r, w, t) == S.token_score(w, t))
    found = {(w, t) for w, t, r in Common(tokens).rated(words, 0.0) if (S.token_score(w, t) if r is None else S.with_codes(r, w, t)) >= LEAST}
    assert found == {(w, t) for w in words for t in tokens if S.token_score(w, t) >= LEAST}


def test_names_that_a_text_lacks_are_told_without_a_pattern(spark):
    from pyspark.sql import functions as F

    from notemill.functions import text as X

    rows = [("MARY's chart", "Mary"), ("ſam and Kate", "Sam"), ("ſam and Kate", "kate"), ("İan or ıan", "Ian"), ("nobody", "Mary"), ("Zoë, ZOË's", "zoë"), ("d'Mary x-Mary Mary’s", "mary"), (None, "Mary")]
    done = spark.createDataFrame(rows, "t string, n string").select("t", X.name_to_token(F.col("t"), F.col("n"), F.lit("P$1")).alias("d")).collect()
    assert [r.d for r in done] == ["P$1's chart", "P$1 and Kate", "ſam and P$1", "P$1 or P$1", "nobody", "P$1, P$1's", "d'Mary x-Mary P$1’s", None]
