"""Line-first quality rules, in native expressions alone.

Each line that holds a word is judged by itself:

* *symbols*: more symbols of ``#*$%&|<>`` than half its words, or exclamation marks doubled
  after more than a fifth of them (punctuation that no sentence has);
* *punctuation*: it neither ends in a terminal mark nor holds the end of a sentence;
* *navigation*: three or more separators of menus, or a few words that are a menu's;
* *boilerplate*: a line of up to 30 words with a stock phrase of web pages.

Failing lines are removed, and a document that lost more than ``most_lost`` percent of its
word characters is rejected, as is one that fails the base rules: under ``least_words`` words,
or over ``most_repeated`` percent of them in windows of five words that occur twice or more.

All of it is evaluated within a row (arrays sorted, neighbours compared: n log n for the
longest text), without shuffle, UDF or explode.

Defined results: null counts as the empty text, which has no words and is not kept; repeated
rows get equal results; an empty table gives an empty table. Added columns get leading
underscores where the input has a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Phrases of page furniture, in English, French, German and Spanish.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "click here",
    "read more",
    "subscribe to our",
    "sign up for",
    "enable javascript",
    "share on facebook",
    "follow us on",
    "lorem ipsum",
    "tous droits réservés",
    "accepter les cookies",
    "politique de confidentialité",
    "mentions légales",
    "conditions d'utilisation",
    "cliquez ici",
    "lire la suite",
    "abonnez-vous à",
    "activez javascript",
    "suivez-nous sur",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "klicken sie hier",
    "weiterlesen",
    "abonnieren sie unseren",
    "aktivieren sie javascript",
    "folgen sie uns auf",
    "todos los derechos reservados",
    "aceptar las cookies",
    "política de privacidad",
    "aviso legal",
    "condiciones de uso",
    "haga clic aquí",
    "leer más",
    "suscríbase a",
    "active javascript",
    "síganos en",
)
#: What menus say, in the same languages.
MENU = (
    "home", "menu", "about", "contact", "login", "log in", "sign in", "search", "next", "previous", "back to top", "skip to content",
    "accueil", "connexion", "rechercher", "suivant", "précédent", "haut de page",
    "startseite", "menü", "kontakt", "anmelden", "suche", "weiter", "zurück", "nach oben",
    "inicio", "menú", "contacto", "iniciar sesión", "buscar", "siguiente", "anterior", "volver arriba",
)
#: A phrase, from the beginning of a word on; alternatives are tried by first letter.
BOILERPLATE_PATTERN = r"(?:^|[^\p{L}])(?:" + "|".join(a + "(?:" + "|".join(x[1:] for x in BOILERPLATE if x[0] == a) + ")" for a in sorted({x[0] for x in BOILERPLATE})) + ")"
_MENU = "|".join(sorted(MENU, key=len, reverse=True))  # the longer one first of two that begin alike
MENU_PATTERN = rf"^\W*(?:{_MENU})(?:\W+(?:{_MENU}))*\W*$"
#: The same lines, for Java: a possessive repetition is a loop there, others of groups take a stack frame a time. No phrase that it
#: has matched is ever to be given back, as none begins with what separates two.
MENU_JAVA = rf"^\W*+(?:{_MENU})(?:\W++(?:{_MENU}))*+\W*+$"
#: A terminal mark at the end of the line, or the end of a sentence within it.
SENTENCE_PATTERN = r"""[.!?…:;。！？]["'”“’‘»«)\]*]*[\x20\x09-\x0D]*$|[.!?…]["'”“’‘»«)\]]*[\x20\x09-\x0D]+[^\x20\x09-\x0D]"""
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def words_in(line: Column) -> Column:
    """The number of words of a line; a regular expression only where spaces are not single ones between words."""
    uneven = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | (F.length(F.translate(line, "\t\x0b\f\r", "")) < F.length(line))
    return F.when(line == "", 0).when(uneven, F.regexp_count(line, F.lit(WORD_PATTERN))).otherwise(F.length(line) - F.length(F.translate(line, " ", "")) + 1)


def line_rule(line: Column, n_words: Column | None = None) -> Column:
    """The rule that a line fails, or null; a line without words fails none."""
    n_words = words_in(line) if n_words is None else n_words
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    bars = F.length(line) - F.length(F.translate(line, "|»›•", ""))
    low = F.lower(line)
    boilerplate, menu = low.rlike(BOILERPLATE_PATTERN), low.rlike(MENU_JAVA)
    return (
        F.when(n_words == 0, F.lit(None).cast("string"))
        .when((bars >= 3) & (bars * 6 >= n_words) | menu, F.lit("navigation"))
        .when((symbols * 2 > n_words) & (symbols >= 3) | (shouts * 5 > n_words) & (shouts >= 3), F.lit("symbols"))
        .when((n_words <= 30) & boilerplate, F.lit("boilerplate"))
        .when(~line.rlike(SENTENCE_PATTERN), F.lit("punctuation"))
    )


def quality(docs: DataFrame, text_col: str = "text", least_words: int = 10, most_repeated: int = 20, most_lost: int = 30) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept``, ``clean_text`` (the lines that stay), ``n_lines``, ``n_failed_lines``
    and ``lost_chars``."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    name = {x: free_name(docs, x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_lines", "n_failed_lines", "lost_chars", "q_text", "q_words", "q_grams", "q_sorted", "q_places", "q_lines")}
    col = {k: F.col(f"`{v}`") for k, v in name.items()}
    bare = F.btrim(text, F.lit(SPACES))
    word_chars = lambda c: F.length(F.translate(c, SPACES, ""))
    step = docs.select(*own, text.alias(name["q_text"]), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias(name["q_words"]))
    w = col["q_words"]
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    counted = F.transform(F.split(col["q_text"], "\n"), lambda x: F.struct(x.alias("line"), words_in(x).alias("w")))  # once, not in each rule
    judged = F.transform(counted, lambda x: F.struct(x["line"].alias("line"), line_rule(x["line"], x["w"]).alias("rule"), word_chars(x["line"]).alias("n")))
    step = step.withColumns({name["q_grams"]: F.when(F.size(w) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")), name["q_lines"]: judged})
    g = col["q_grams"]
    # places of windows, sorted by hash: equal windows are neighbours
    repeated = F.size(F.array_distinct(g)) < F.size(g)
    step = step.withColumn(name["q_sorted"], F.when(repeated, F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = col["q_sorted"]
    twin = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    step = step.withColumn(name["q_places"], F.sort_array(F.transform(twin, lambda x: x["i"])))
    p, lines = col["q_places"], col["q_lines"]
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    with_word = F.filter(lines, lambda x: x["n"] > 0)
    failed = F.filter(lines, lambda x: x["rule"].isNotNull())
    step = step.withColumns(
        {
            name["n_words"]: F.size(w).cast("long"),
            name["word_chars"]: word_chars(col["q_text"]).cast("long"),
            name["n_symbols"]: (F.length(col["q_text"]) - F.length(F.translate(col["q_text"], SYMBOLS, ""))).cast("long"),
            name["n_dup_lines"]: (F.size(with_word) - F.size(F.array_distinct(F.transform(with_word, lambda x: x["line"])))).cast("long"),
            name["n_repeat_words"]: covered.cast("long"),
            name["clean_text"]: F.array_join(F.transform(F.filter(lines, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n"),
            name["n_lines"]: F.size(with_word).cast("long"),
            name["n_failed_lines"]: F.size(failed).cast("long"),
            name["lost_chars"]: F.aggregate(failed, F.lit(0).cast("long"), lambda a, x: a + x["n"]),
        }
    )
    step = step.withColumn(name["base_failed"], (col["n_words"] < least_words) | (col["n_repeat_words"] * 100 > col["n_words"] * most_repeated))
    step = step.withColumn(name["kept"], ~col["base_failed"] & (col["lost_chars"] * 100 <= col["word_chars"] * most_lost))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_lines", "n_failed_lines", "lost_chars")
    # A generator of one row: a consumer's filter stays above it. Pushed below, it would take the
    # arrays' expressions along into the lambdas and evaluate them once an element.
    return step.select(*own, F.inline(F.array(F.struct(*[col[x] for x in shown]))))
