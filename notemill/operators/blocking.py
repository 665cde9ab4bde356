"""Candidates for fuzzy matches of names, without loss.

A fragment can only match a name if each of its tokens scores ``LEAST`` or more with one of the name's
tokens, so candidates are found by tokens. Distinct tokens of the notes meet distinct tokens of
the registry in blocks of a bounded size: shared letters bound the score from above, for a whole block in one
step, and what passes is scored once per pair of tokens, however often it occurs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import similarity as S
from ..session import cut

#: The least score of a token pair that ``match_score`` accepts.
LEAST = 62.0
#: Registry tokens that are broadcast at once.
AT_ONCE = 200_000


class Letters:
    """Upper bounds of ``token_score`` of a token with each of a list."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        plain = [S.prefix_normal(t) for t in tokens]
        self.column = {c: i for i, c in enumerate(sorted(set("".join(plain))))}
        self.size = np.array([len(t) for t in plain])
        self.counts = np.zeros((len(plain), max(len(self.column), 1)), np.int16)
        for i, t in enumerate(plain):
            for c in t:
                self.counts[i, self.column[c]] += 1

    def near(self, word: str) -> list[str]:
        """Tokens that could reach LEAST; a bonus for codes counts from a ratio of 60 on."""
        word = S.prefix_normal(word)
        own = np.zeros(self.counts.shape[1], np.int16)
        for c in word:
            if c in self.column:
                own[self.column[c]] += 1
        shared = np.minimum(self.counts, own).sum(axis=1)
        short, long = np.minimum(self.size, len(word)), np.maximum(self.size, len(word))
        longer = long / np.maximum(short, 1)
        part = np.where(longer < 1.5, 0, np.where(longer <= 8, 0.9, 0.6)) * 200 * shared / np.maximum(short + shared, 1)
        most = np.maximum(200 * shared / np.maximum(short + long, 1), part)
        return [self.tokens[i] for i in np.flatnonzero(most >= 60 - 1e-6)]


class Common:
    """The longest common subsequences of words with each of a list of tokens: all words of a batch meet a token at once, whose letters are the bits of
    a row of the table (as in ``similarity.common``), a word a lane."""

    #: Letters of tokens and words that are compared at once; longer ones, and those that Python splits, are compared one by one.
    MOST = 64
    #: Words that are compared at once.
    AT_ONCE = 8192

    def __init__(self, tokens: list[str]):
        plain = [S.prefix_normal(t) for t in tokens]
        easy = [self.easy(t, p) for t, p in zip(tokens, plain)]
        self.tokens, self.plain = [t for t, e in zip(tokens, easy) if e], [p for p, e in zip(plain, easy) if e]
        self.others = Letters([t for t, e in zip(tokens, easy) if not e])
        self.all = Letters(tokens)
        self.letters = np.array(sorted({ord(c) for p in self.plain for c in p}), np.uint32)
        code = {chr(x): i + 1 for i, x in enumerate(self.letters.tolist())}
        self.codes = [[code[c] for c in p] for p in self.plain]

    @classmethod
    def easy(cls, token: str, plain: str) -> bool:
        return 0 < len(plain) <= cls.MOST and not any(map(str.isspace, token))

    def near(self, words: list[str], least_ratio: float) -> list[tuple[str, str]]:
        """(word, token) of those that could reach LEAST, and whose ratio is ``least_ratio`` or more; of those compared one by one, all that could reach LEAST."""
        return [(w, t) for w, t, _ in self.rated(words, least_ratio)]

    def rated(self, words: list[str], least_ratio: float) -> list[tuple[str, str, float | None]]:
        """As ``near``, with the weighted ratio of the prefix-normal forms; None for those compared one by one."""
        plain = [S.prefix_normal(w) for w in words]
        out, easy = [], []
        for w, p in zip(words, plain):
            if self.easy(w, p):
                easy.append((len(p), p, w))
                out += [(w, t, None) for t in self.others.near(w)] if self.others.tokens else []
            else:
                out += [(w, t, None) for t in self.all.near(w)]
        easy.sort()  # words of one length need no padding
        for i in range(0, len(easy), self.AT_ONCE):
            part = easy[i : i + self.AT_ONCE]
            size = np.array([n for n, *_ in part])
            points = np.array([p for _, p, _ in part], f"U{size[-1]}").view(np.uint32).reshape(len(part), -1).T
            at = np.searchsorted(self.letters, points) if len(self.letters) else np.zeros(points.shape, int)
            known = self.letters[np.minimum(at, len(self.letters) - 1)] == points if len(self.letters) else np.zeros(points.shape, bool)
            columns = np.where(known, at + 1, 0).astype(np.intp)
            for token, codes in zip(self.tokens, self.codes):
                out += [(part[j][2], token, r) for j, r in zip(*map(np.ndarray.tolist, self._near(columns, size, codes, least_ratio)))]
        return out

    def _common(self, columns: np.ndarray, codes: list[int]) -> np.ndarray:
        places = np.zeros(len(self.letters) + 1, np.uint64)
        for i, c in enumerate(codes):
            places[c] |= np.uint64(1 << i)
        full = np.uint64((1 << len(codes)) - 1)
        row = np.full(columns.shape[1], full)
        for column in columns:
            hit = row & places[column]
            row = ((row + hit) | (row - hit)) & full
        return len(codes) - np.bitwise_count(row).astype(np.int64)

    def _stretches(self, columns: np.ndarray, size: np.ndarray, codes: list[int]) -> np.ndarray:
        """``similarity.partial_ratio`` of each word with a token: of the token with stretches of longer words, of shorter words with stretches of the token."""
        n, best = len(codes), np.zeros(len(size))
        longer = np.flatnonzero(size > n)
        for i in range(1 - n, max(size[longer], default=0)):
            low, high = max(0, i), np.minimum(i + n, size[longer])
            both = self._common(columns[low : i + n, longer], codes)
            best[longer] = np.maximum(best[longer], np.where(high > low, 200.0 * both / (n + np.maximum(high - low, 1)), 0))
        for m in np.unique(size[size <= n]).tolist():
            same = np.flatnonzero(size == m)
            for i in range(1 - m, n):
                stretch = codes[max(0, i) : i + m]
                best[same] = np.maximum(best[same], 200.0 * self._common(columns[:m, same], stretch) / (m + len(stretch)))
        return best

    def _near(self, columns: np.ndarray, size: np.ndarray, codes: list[int], least_ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers and their ``similarity.wratio`` with the token."""
        n = len(codes)
        both = self._common(columns, codes)
        ratio = 200.0 * both / (n + size)
        short, long = np.minimum(n, size), np.maximum(n, size)
        scale = np.where(long < 1.5 * short, 0, np.where(long <= 8 * short, 0.9, 0.6))
        # a stretch that holds the common letters has as many letters at least
        left = np.flatnonzero((ratio >= least_ratio - 1e-6) & (scale > 0) & (np.maximum(ratio, scale * 200.0 * both / (short + both)) >= 60 - 1e-6))
        most = ratio.copy()
        if len(left):
            most[left] = np.maximum(ratio[left], scale[left] * self._stretches(columns[:, left], size[left], codes))
        good = np.flatnonzero((most >= 60 - 1e-6) & (ratio >= least_ratio - 1e-6))
        return good, most[good]


def tasks(spark) -> int:
    """Tasks for rows of few bytes and much work, which the sizes of partitions alone would put into one. Deal the rows out by a hash of the key:
    by the key itself, a grouping before it would stand in, whose partitions are put together by size."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def token_links(words: DataFrame, tokens: DataFrame, least_ratio: float = 0.0) -> DataFrame:
    """w, t, s: pairs of ``words`` (w) and ``tokens`` (t) with a ``token_score`` of LEAST or more. Pairs of single words whose ratio (of their
    prefix-normal forms) is under ``least_ratio`` are left out: for callers that would drop them."""
    words, tokens = words.select("w").distinct().repartition(tasks(words.sparkSession), F.xxhash64("w")), tokens.select("t").distinct()
    blocks = max(1, -(-tokens.count() // AT_ONCE))
    out = None
    for b in range(blocks):
        own = [r.t for r in tokens.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect()]  # AT_ONCE, about
        shared = words.sparkSession.sparkContext.broadcast(sorted(own))

        def run(batches, shared=shared):
            letters = Common(shared.value)
            for batch in batches:
                rows = [(w, t, s) for w, t, r in letters.rated(batch["w"].tolist(), least_ratio) if (s := S.token_score(w, t) if r is None else S.with_codes(r, w, t)) >= LEAST]
                yield pd.DataFrame(rows, columns=["w", "t", "s"]).astype({"s": float})

        found = words.mapInPandas(run, "w string, t string, s double")
        out = found if out is None else out.unionByName(found)
    return out


class Names:
    """The names of a block of a registry, found by the tokens that the words of a fragment score with."""

    def __init__(self, names: list[tuple[str, list[str]]]):
        self.names, self.postings = names, {}
        for i, (_, tokens) in enumerate(names):
            for t in set(tokens):
                self.postings.setdefault(t, []).append(i)

    def _reached(self, links: dict[str, float]) -> dict[int, float]:
        """Names that have one of these tokens, and the best score of them."""
        best: dict[int, float] = {}
        for t, s in links.items():
            for i in self.postings.get(t, ()):
                if s > best.get(i, 0):
                    best[i] = s
        return best

    def find(self, fragment: str, links: list[dict[str, float]], threshold: float) -> list[tuple[int, float]]:
        """(number, score) of the names that a folded fragment matches, with the links of its distinct tokens. The names' ratio is 100 at
        most, so that the tokens' mean must make up the rest."""
        tokens = [t for t in fragment.split() if len(t) > 1]
        reached = sorted((self._reached(x) for x in links), key=len)
        least, out = max(threshold - 8, 65) if len(tokens) == 1 else threshold, []
        for i in reached[0]:
            name, other = self.names[i]
            if len(tokens) > len(other) or not all(i in r for r in reached):
                continue
            if len(reached) == len(tokens) and sum(r[i] for r in reached) / len(tokens) < (least - 15 + min(4 * (len(other) - len(tokens)), 12)) / 0.85 - 1e-6:
                continue
            if (s := S.match_score(fragment, name, threshold)) is not None:
                out.append((i, s))
        return out


def found_names(forms: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """f, role, ord, name, s: the names (role, ord, name, g: folded) that each distinct folded form ``f`` matches by ``match_score``. Each distinct
    word is scored once against the registry's tokens; forms of which a word scores with none go before names are looked at."""
    schema = T.StructType([T.StructField("f", T.StringType()), names.schema["role"], names.schema["ord"], T.StructField("name", T.StringType()), T.StructField("s", T.DoubleType())])
    types = to_arrow_schema(schema).types
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: F.length(w) > 1))
    names = cut(names.select("role", "ord", "name", "g"))
    tokens = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: F.length(w) > 1)
    most = names.agg(F.max(F.size(tokens("g")))).first()[0] or 0
    odd = F.col("f").rlike(r"[\x1C-\x1F]")  # what Python splits here is one word to Spark
    own = forms.select("f").distinct().select("f", odd.alias("odd"), tokens("f").alias("ts")).where(F.col("odd") | (F.size("ts") <= most))  # a name of fewer tokens can't be matched
    own = own.select("f", (F.col("odd") | (F.size("ts") != F.size(F.array_distinct("ts")))).alias("odd"), F.array_distinct("ts").alias("ws"))
    each = cut(own.where(F.size("ws") > 0).select("f", "odd", F.size("ws").alias("n"), F.explode("ws").alias("w")))
    links = cut(token_links(each.select("w"), names.select(F.explode(words("g")).alias("t"))))
    near = links.groupBy("w").agg(F.collect_list(F.struct("t", "s")).alias("links"))  # tokens near a word
    # a form goes unless each of its words has a link, and the best of these make up what ``Names.find`` asks of the tokens' mean
    best = links.groupBy("w").agg(F.max("s").alias("s"))
    least = F.when(F.col("n") == 1, max(threshold - 8, 65.0)).otherwise(float(threshold))
    able = each.join(best, "w").groupBy("f", "n", "odd").agg(F.count(F.lit(1)).alias("m"), F.avg("s").alias("mean")).where((F.col("m") == F.col("n")) & (F.col("odd") | (F.col("mean") >= (least - 15) / 0.85 - 1e-6)))
    known = each.join(cut(able.select("f")), "f", "left_semi").join(near, "w").groupBy("f").agg(F.collect_list("links").alias("links"))
    known = known.select("f", "links").repartition(tasks(names.sparkSession), F.xxhash64("f"))
    blocks = max(1, -(-names.count() // AT_ONCE))
    out = None
    for b in range(blocks):
        rows = names.where(F.pmod(F.xxhash64("g"), F.lit(blocks)) == b).collect()  # AT_ONCE, about
        shared = names.sparkSession.sparkContext.broadcast([(r.role, r.ord, r.name, r.g) for r in rows])

        def run(batches, shared=shared):
            own = Names([(g, [t for t in g.split() if len(t) > 1]) for *_, g in shared.value])
            for batch in batches:
                rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                found = [(f, *shared.value[i][:3], s) for f, words in rows for i, s in own.find(f, [{x["t"]: x["s"] for x in links} for links in words], threshold)]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found) if found else [[]] * 5, types)], names=["f", "role", "ord", "name", "s"])

        found = known.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
