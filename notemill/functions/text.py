"""Column functions over notes and names; native expressions, but for ``nfc`` and ``name_fold``
on text beyond ASCII, and ``drop_contained``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicons as L

_QUOTES = "'’ʼ"
#: Whether a text holds what NFC could change: marks, conjoining jamo, and characters that it never keeps.
NOT_NFC = r"[\p{M}\x{1100}-\x{11FF}\x{340}-\x{374}\x{37E}\x{387}\x{958}-\x{95F}\x{9DC}-\x{9DF}\x{A33}-\x{A5E}\x{B5C}-\x{B5D}\x{F43}-\x{FB9}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]"

#: The same, told by one comparison for the letters below the first of them.
_MARKED = rf"[\x{{300}}-\x{{10FFFF}}&&{NOT_NFC}]"


def _fold(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name) if unicodedata.category(c) != "Mn" and c not in _QUOTES).lower()


@F.arrow_udf(T.StringType())
def _nfc(s: pa.Array) -> pa.Array:
    return _sliced(s, lambda x: unicodedata.normalize("NFC", x))


#: Bytes of text that are Python strings at once.
_SLICE = 1 << 20


def _sliced(texts: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """``f`` of each text, null as null, of some MB of an Arrow batch at a time: a batch is bounded by its rows, and rows may be long."""
    if not len(texts):
        return texts
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // _SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    out = [pa.array([None if x is None else f(x) for x in texts.slice(a, b - a).to_pylist()], texts.type) for a, b in zip(cuts, cuts[1:])]
    return pa.concat_arrays(out)


@F.arrow_udf(T.StringType())
def _fold_udf(s: pa.Array) -> pa.Array:
    return _sliced(s, _fold)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once; an expression inside a lambda is evaluated for each
    element, so what lambdas refer to is bound by this first."""
    return F.get(F.transform(F.array(value), body), 0)


def nfc(text: Column) -> Column:
    """Unicode NFC. Texts without combining marks or characters that decompose on their own (most are) don't need it; they
    reach the UDF as null and come back as they are."""
    plain = ~text.rlike(_MARKED)
    return F.when(text.isNull() | plain, text).otherwise(_nfc(F.when(~plain, text)))


def name_fold(name: Column) -> Column:
    """Marks and apostrophes dropped, lower case; other punctuation and blanks stay. ASCII is folded natively and reaches
    the UDF as null."""
    plain = name.rlike(r"\A\p{ASCII}*\z")
    return F.when(plain, F.translate(F.lower(name), "'", "")).otherwise(_fold_udf(F.when(~plain, name)))


def latin_fold(name: Column) -> Column:
    """``name_fold`` of Latin letters, without a UDF."""
    marked, plain = "áàâäãåéèêëíìîïóòôöõúùûüýÿñç", "aaaaaaeeeeiiiiooooouuuuyync"
    return F.translate(F.lower(name), marked + _QUOTES, plain)


def literal(text: Column) -> Column:
    """A regular expression that matches ``text`` itself."""
    return F.regexp_replace(text, r"([\\\[\](){}.*+?^$|&\-#~])", r"\\$1")


def replacement(text: Column) -> Column:
    """``text`` with the marks of replacement strings escaped."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def fold_rewrite(text: Column, rules: list[tuple[str, str]] | Column) -> Column:
    """Apply (pattern, replacement) rules one after the other; one expression, however many.
    ``rules``: a list, or an array column of structs ``p``, ``r``."""
    if not isinstance(rules, Column):
        rules = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")) for p, r in rules])
    return F.aggregate(rules, text, lambda t, x: F.regexp_replace(t, x["p"], x["r"]))


def accent_normalise(name: Column) -> Column:
    """Spoken variants of names become their usual form: whole words, any case, in order. Names that no rule's pattern is in,
    which are most, are told by one expression."""
    rules = L.accent_rules()
    inner: dict[str, list[str]] = {}
    for p, _ in rules:  # patterns are words between boundaries
        inner.setdefault(p[2], []).append(p[3:-2])
    some = r"(?iu)\b(?:" + "|".join(c + "(?:" + "|".join(rest) + ")" for c, rest in inner.items()) + r")\b"
    return F.when(name.rlike(some), fold_rewrite(name, [("(?iu)" + p, r) for p, r in rules])).otherwise(name)


def phonetic_variant(name: Column) -> Column:
    """Known spoken variants become canonical names, two tokens before one; other tokens stay."""
    known = L.phonetic_variants()
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    tokens = F.split(F.btrim(name), r"\s+")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))

    def step(a: Column, token: Column) -> Column:
        two = F.lower(F.concat_ws(" ", a["held"], token))
        single = F.coalesce(F.try_element_at(table, F.lower(a["held"])), a["held"])
        pair = F.try_element_at(table, two)
        joined = a["held"].isNotNull() & pair.isNotNull()
        kept = F.when(a["held"].isNull(), a["out"]).when(joined, F.concat(a["out"], F.array(pair))).otherwise(F.concat(a["out"], F.array(single)))
        return F.struct(kept.alias("out"), F.when(joined, F.lit(None).cast("string")).otherwise(token).alias("held"))

    def end(a: Column) -> Column:
        last = F.coalesce(F.try_element_at(table, F.lower(a["held"])), a["held"])
        return F.array_join(F.when(a["held"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(last))), " ")

    return F.aggregate(tokens, start, step, end)


def name_prefix(token: Column) -> Column:
    """mc, mac, o and st are joined to their stem, mac becomes mc; lower case."""
    low = F.lower(token)
    joined = F.regexp_replace(low, r"^(mc|mac|o|st)\s*'?\s*", "$1")
    return F.regexp_replace(joined, "^mac", "mc")


def strip_honorific(name: Column) -> Column:
    """The name without a leading title, where anything is left."""

    def without(words: Column) -> Column:
        head = F.lower(F.regexp_replace(F.get(words, 0), r"\.+$", ""))
        return F.when((F.size(words) > 1) & head.isin(L.HONORIFICS), F.array_join(F.slice(words, 2, F.size(words)), " "))

    return F.coalesce(let(F.split(F.btrim(name), r"(?U)\s+"), without), F.btrim(name))


def tokens_of(text: Column, prefixes: list[str]) -> Column:
    """Distinct tokens of the kind PATIENT1 in a text, in order."""
    first = "".join(sorted({p[0] for p in prefixes}))  # told before anything is looked at behind
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?=[{first}])(?<![A-Za-z0-9_])(?:" + "|".join(prefixes) + r")[0-9]+(?![A-Za-z0-9_])"), F.lit(0)))


def protection_tokens(text: Column) -> Column:
    return tokens_of(text, L.PROTECTED_PREFIXES)


def is_token(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A(?:" + "|".join(L.PROTECTED_PREFIXES) + r")[0-9]+\z"), F.lit(False))


def strip_preamble(text: Column) -> Column:
    """A rewriter's lead-in at the text's start, a closing fence and quotes around it all, gone."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(text), L.PREAMBLE, ""), r"\s*```\s*\z", "")
    return F.regexp_replace(F.btrim(bare), r"(?s)\A([\"'])(.*)\1\z", "$2")


def replace_word(text: Column, needle: Column, new: Column) -> Column:
    """Each whole-word occurrence of ``needle``, any case, becomes ``new`` literally."""
    body = literal(needle)  # looked for before what is behind it, which costs more and holds at most places
    return F.regexp_replace(text, F.concat(F.lit("(?iu)(?="), body, F.lit(r")(?<![\p{L}\p{N}_])"), body, F.lit(r"(?![\p{L}\p{N}_])")), replacement(new))


def name_to_token(text: Column, name: Column, token: Column) -> Column:
    """A name, any case, becomes its token; a possessive suffix stays. Not inside longer or
    hyphenated words, nor after an apostrophe."""
    def put(x: Column) -> Column:
        owned = F.concat(x["ahead"], F.lit(r"(?<![\p{L}\p{N}_-])"), x["body"], F.lit(r"(['’]s?)(?![\p{L}\p{N}_-])"))
        alone = F.concat(x["ahead"], F.lit(r"(?<![\p{L}\p{N}_'’-])"), x["body"], F.lit(r"(?![\p{L}\p{N}_'’-])"))
        return F.regexp_replace(F.regexp_replace(text, owned, F.concat(x["token"], F.lit("$1"))), alone, x["token"])

    # names of ASCII that a text doesn't hold need no pattern; the four other letters that are an ASCII letter in another case do
    absent = name.rlike(r"\A\p{ASCII}+\z") & ~F.contains(F.lower(text), F.lower(name)) & ~text.rlike(r"[\x{17F}\x{212A}\x{130}\x{131}]")
    bound = let(literal(name), lambda body: F.struct(body.alias("body"), F.concat(F.lit("(?iu)(?="), body, F.lit(")")).alias("ahead"), replacement(token).alias("token")))
    return F.when(absent, text).otherwise(let(bound, put))


def prepass(text: Column, variants: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Dictionary rewrite, longest variant first: the text, and (variant, term) of those applied.
    Whole words of letters and digits, any case; a rule sees what the rules before it made."""
    folded = prepass_step(text, variants)
    return folded["text"], folded["applied"]


def prepass_step(text: Column, variants: list[tuple[str, str]]) -> Column:
    """``prepass`` as one struct (text, applied), so that taking both doesn't do the work twice."""
    ordered = sorted(variants, key=lambda x: -len(x[0]))
    rules = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(t).alias("t")) for v, t in ordered]) if ordered else F.array().cast("array<struct<v:string,t:string>>")
    start = F.struct(text.alias("text"), F.array().cast("array<struct<v:string,t:string>>").alias("applied"))

    def step(a: Column, x: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<![a-zA-Z0-9])"), literal(x["v"]), F.lit(r"(?![a-zA-Z0-9])"))
        hit = F.contains(F.lower(a["text"]), F.lower(x["v"])) & F.regexp_like(a["text"], pattern)
        return F.when(hit, F.struct(F.regexp_replace(a["text"], pattern, replacement(x["t"])).alias("text"), F.concat(a["applied"], F.array(x)).alias("applied"))).otherwise(a)

    return F.aggregate(rules, start, step)


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def first_name_alias(name: Column, least: int = 4) -> Column:
    """The first token of a name of several, if it is long enough and no stop word; else null."""
    words = F.split(F.btrim(name), r"(?U)\s+")
    first = F.get(words, 0)
    return F.when((F.size(words) > 1) & (F.length(first) >= least) & ~F.lower(first).isin(L.ENTITY_STOP_WORDS + L.HONORIFICS), first)


def estimate_tokens(text: Column) -> Column:
    """max(1, floor(words * 1.35 * 1.10))."""
    bare = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))
    return F.greatest(F.lit(1), F.floor(words * F.lit(1.35) * F.lit(1.10))).cast("int")


def windows(text: Column, sizes: list[int]) -> Column:
    """Windows of words by size: array of (n, spans), spans from left to right. Each size is made from the one below and the words that
    follow, so that a window costs one step, whatever its size."""
    words = F.coalesce(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.array().cast("array<string>"))

    def build(words: Column, made: dict[int, Column]) -> Column:
        n = max(made)
        if n == max(sizes):
            return F.array(*[F.struct(F.lit(k).alias("n"), made[k].alias("spans")) for k in sizes])
        left = F.size(words) - n
        longer = F.zip_with(F.slice(made[n], F.lit(1), left), F.slice(words, F.lit(n + 1), left), lambda a, b: F.concat(a, F.lit(" "), b))
        return let(F.when(left > 0, longer).otherwise(F.array().cast("array<string>")), lambda grams: build(words, made | {n + 1: grams}))

    return let(words, lambda words: build(words, {1: words}))


def ngrams(text: Column, sizes: list[int]) -> Column:
    """Windows of words, the longest first, left to right: array of (n, at, span)."""
    return F.flatten(F.transform(windows(text, sizes), lambda x: F.transform(x["spans"], lambda s, i: F.struct(x["n"].alias("n"), i.alias("at"), s.alias("span")))))


def valid_id(session: Column) -> Column:
    """Up to 128 of ASCII letters, digits, ``_ - .``; empty is fine."""
    return F.coalesce(session.rlike(r"\A[A-Za-z0-9_.\-]{0,128}\z"), F.lit(False))


def capitalised_spans(text: Column) -> Column:
    """Runs of 1 to 4 capitalised words (ASCII, with O'X, McX, MacX) that hold a word of three letters
    or more and none of the stop words."""
    word = r"(?:[A-Z][a-z'\-]+|O'[A-Z][a-z]+|Mc[A-Z][a-z]+|Mac[A-Z][a-z]+)"
    spans = F.regexp_extract_all(text, F.lit(rf"(?U)(?=[A-Z])(?<!\w){word}(?:\s+{word}){{0,3}}(?!\w)"), F.lit(0))
    parts = lambda s: F.split(s, r"(?U)\s+")
    stop = F.array(*map(F.lit, L.CAPITAL_STOP_WORDS))
    return F.filter(spans, lambda s: let(parts(s), lambda p: F.exists(p, lambda w: F.length(w) >= 3) & ~F.arrays_overlap(F.transform(p, lambda w: F.lower(w)), stop)))


def _outer(spans: list[str], lows: list[str]) -> list[str]:
    """Spans as ``drop_contained`` keeps them. One automaton of all spans reads each of them once, and so finds what is within which."""
    first: dict[str, int] = {}
    for i, low in enumerate(lows):
        first.setdefault(low, i)
    found = ahocorasick.Automaton()
    for low in filter(None, first):
        found.add_word(low, low)
    inner: set[str] = {""} if len(first) > 1 else set()
    if len(found):
        found.make_automaton()
    for low in filter(None, first):
        inner.update(x for _, x in found.iter(low) if len(x) < len(low))
    kept = sorted((-len(spans[i]), i) for low, i in first.items() if low not in inner)
    return [spans[i] for _, i in kept]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _outer_udf(spans: pd.Series, lows: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else _outer(list(s), list(low)) for s, low in zip(spans, lows)])


def drop_contained(spans: Column) -> Column:
    """Spans that no longer span contains, any case; of spans that differ in case alone the first.
    Longest first, ties by first occurrence. Work grows with the spans' letters, not with their pairs; arrays of one span or none, which
    are left as they are, reach the UDF as null."""
    many = F.size(spans) > 1
    return F.when(many, _outer_udf(F.when(many, spans), F.when(many, F.transform(spans, F.lower)))).otherwise(spans)


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.92, "auto_silent").when(confidence >= 0.80, "auto_log").when(confidence >= 0.70, "audit").otherwise("skipped")


def json_list(text: Column) -> Column:
    """Strings of a list literal, in single or double quotes (commas and escaped quotes in them stay) or bare, in lower case."""
    inner = F.regexp_replace(F.btrim(F.coalesce(text, F.lit(""))), r"\A\[|\]\z", "")
    parts = F.regexp_extract_all(inner, F.lit(r"""\s*(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,]+)"""), F.lit(0))
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.btrim(x), r"""\A(?:'(.*)'|"(.*)")\z""", "$1$2"), r"\\(.)", "$1")
    return F.filter(F.transform(parts, lambda x: F.lower(F.btrim(bare(x)))), lambda x: x != "")
