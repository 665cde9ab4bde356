"""Many phrases at once: a dictionary of any size found in, or replaced in, every text by one pass of an automaton
(Aho-Corasick) instead of an expression a phrase.

Phrases match in any case (letters are compared by their lower case, one for one) and as whole words: no ASCII letter or digit
stands before or after. Empty phrases match nothing; null texts have no hits and stay null. The dictionary is a small dimension,
broadcast ``MOST_BYTES`` at a time; a larger one takes several passes, with the same result."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of phrases and replacements that one pass broadcasts.
MOST_BYTES = 16_000_000
_WORD = re.compile("[A-Za-z0-9]")


def _low(text: str) -> str:
    """Lower case, as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Automaton:
    """Phrases in order, numbered from 0. Of those equal in lower case the first is found; ``same`` has all their numbers."""

    def __init__(self, phrases: list[str]) -> None:
        self.found = ahocorasick.Automaton()
        self.size, self.same = {}, {}
        for i, phrase in enumerate(map(_low, phrases)):
            if not phrase:
                continue
            if phrase not in self.found:
                self.found.add_word(phrase, i)
                self.size[i], self.same[i] = len(phrase), []
            self.same[self.found.get(phrase)].append(i)
        if self.size:
            self.found.make_automaton()
        used = "".join(sorted(set("".join(map(_low, phrases)))))
        #: What no phrase holds and no word does: no match reaches over it.
        self.gap = re.compile(f"[^A-Za-z0-9{re.escape(used)}]")

    def hits(self, low: str) -> Iterator[tuple[int, int]]:
        """(phrase, start) of every whole-word occurrence, by end."""
        if not self.size:
            return
        for end, i in self.found.iter(low):
            start = end + 1 - self.size[i]
            if not (start and _WORD.match(low[start - 1])) and not _WORD.match(low[end + 1 : end + 2]):
                yield i, start

    def apart(self, low: str) -> dict[int, list[int]]:
        """Starts by phrase, from the left, of a phrase's occurrences that don't overlap each other."""
        out: dict[int, list[int]] = {}
        for i, start in self.hits(low):
            own = out.setdefault(i, [])
            if not own or start >= own[-1] + self.size[i]:
                own.append(start)
        return out

    def replay(self, text: str, new: list[str]) -> tuple[str, set[int]]:
        """What replacing phrase 0, 1, .. everywhere, one after the other, makes of a text, and the phrases that were replaced. After
        each replacement the next phrase of the order that occurs is sought; phrases between them change nothing."""
        done: set[int] = set()
        last = -1
        while True:
            found = self.apart(_low(text))
            after = min(((j, i) for i in found for j in self.same[i] if j > last), default=None)
            if after is None:
                return text, done
            last, first = after
            parts, at = [], 0
            for start in found[first]:
                parts += [text[at:start], new[last]]
                at = start + self.size[first]
            text = "".join([*parts, text[at:]])
            done.add(last)

    def rewrite(self, text: str, new: list[str]) -> tuple[str, list[int]]:
        """``replay`` of the stretches between gaps that hold a phrase; the others stay."""
        low = _low(text)
        starts = sorted({start for _, start in self.hits(low)})
        parts, at, done = [], 0, set()
        for start in starts:
            if start < at:
                continue  # in a stretch that is done
            behind = start  # the stretch around the hit
            while behind > at and not self.gap.match(low[behind - 1]):
                behind -= 1
            gap = self.gap.search(low, start)
            end = gap.start() if gap else len(low)
            whole, own = self.replay(text[behind:end], new)
            parts += [text[at:behind], whole]
            at = end
            done |= own
        return "".join([*parts, text[at:]]), sorted(done)


_BUILT: dict[int, Automaton] = {}


def _automaton(rules: Broadcast) -> Automaton:
    """The automaton of a broadcast's phrases, built once a Python worker; the last few stay."""
    own = id(rules.value)
    if own not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[own] = Automaton(rules.value[0])
        _BUILT[own].rules = rules.value  # keeps the id taken
    return _BUILT[own]


def _parts(rules: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """The rules in order, in lists of at most ``MOST_BYTES`` (or of one rule)."""
    part, size = [], 0
    for v, t in rules:
        own = len(v.encode()) + len(t.encode())
        if part and size + own > MOST_BYTES:
            yield part
            part, size = [], 0
        part.append((v, t))
        size += own
    if part:
        yield part


def _shared(spark: SparkSession, part: list[tuple[str, str]]) -> Broadcast:
    return spark.sparkContext.broadcast(([v for v, _ in part], [t for _, t in part]))


def in_order(variants: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules as they are applied: longest variant first, ties in the order given."""
    return sorted(variants, key=lambda x: -len(x[0]))


def rewrite(notes: DataFrame, variants: list[tuple[str, str]], text_col: str = "text", out: str = "rewritten") -> DataFrame:
    """``notes`` with ``out``, a struct of ``text`` and ``applied`` (array of struct(v, t)): what ``functions.text.prepass`` gives, which
    is the choice for a few rules. Here the cost of a text hangs on the rules that occur in it, not on how many there are. A part of the
    rules is done before the next one begins, as their order asks."""
    kind = "struct<text:string,applied:array<struct<v:string,t:string>>>"
    text, none = F.col(text_col), F.array().cast("array<struct<v:string,t:string>>")
    step = notes.withColumn(out, F.struct(text.alias("text"), none.alias("applied")))

    def one(rules: Broadcast):
        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.DataFrame:
            automaton, (old, new) = _automaton(rules), rules.value
            rows = [(None, []) if t is None else automaton.rewrite(t, new) for t in texts]
            return pd.DataFrame({"text": [t for t, _ in rows], "applied": [[{"v": old[i], "t": new[i]} for i in own] for _, own in rows]})

        return run

    for part in _parts(in_order(variants)):
        done = one(_shared(notes.sparkSession, part))(F.col(out)["text"])
        step = step.withColumn("_r", done).withColumn(out, F.struct(F.col("_r.text").alias("text"), F.concat(F.col(out)["applied"], F.coalesce("_r.applied", none)).alias("applied"))).drop("_r")
    return step


def scan(notes: DataFrame, phrases: list[str], id_col: str = "note_id", text_col: str = "text") -> DataFrame:
    """id, phrase, start, length: every whole-word occurrence of each phrase (as it was given) in each text, in code points from 0;
    occurrences of one phrase don't overlap, those of different phrases may. One pass over the texts a part of the phrases, no shuffle."""
    kind = "array<struct<phrase:string,start:int,length:int>>"

    def one(rules: Broadcast):
        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.Series:
            automaton, names = _automaton(rules), rules.value[0]
            each = ([] if t is None else sorted((s, i) for i, own in automaton.apart(_low(t)).items() for s in own) for t in texts)
            return pd.Series([[{"phrase": names[i], "start": s, "length": automaton.size[i]} for s, i in own] for own in each])

        return run

    distinct = dict((_low(p), p) for p in reversed(phrases)).values()  # the first of those equal in lower case
    found: list[Column] = [one(_shared(notes.sparkSession, part))(F.col(text_col)) for part in _parts([(p, "") for p in distinct])]
    hits = F.concat(*found) if found else F.array().cast(kind)
    return notes.select(id_col, F.explode(hits).alias("h")).select(id_col, "h.phrase", "h.start", "h.length")
