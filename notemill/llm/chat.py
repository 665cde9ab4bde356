"""Chat formatting into budgeted windows, in native expressions alone.

A conversation's turns, in order, are laid out with a template. Where it is longer than the
budget it becomes several windows, all of them aligned to turns:

* prefix sums of turn tokens choose the spans of new turns. The sum before a turn and the sum
  after it, each divided by the room for new turns, are its span; so a span never holds more
  than that room, and turns that cross a border stand alone. No turn needs another turn's
  decision. The sums are taken over a narrow table (no texts), sorted by range: within a range first,
  then with the sums of the ranges before, so that a conversation with a third of all turns, or all rows
  without an id, are no hot group;
* each window begins with the system turn (the conversation's first turn of that role), which
  windows that start after it repeat, then up to ``history`` tokens of the turns before its span, then the
  new turns;
* the loss mask covers the texts of the assistant's new turns; repeated turns are masked out,
  so that each target is trained on once.

Texts move twice: to the windows that their turn is in, and within these into one row.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and
texts are escaped with a backslash after their first character (backslashes are doubled), and
``unescape`` gives back the text exactly.

Tokens are those of ``tokens_col`` (of the laid-out turn; null or under 1 counts as 1), else estimated as one for
each four code points of the laid-out turn, rounded up. A turn that alone exceeds the room is a window of its own,
and a window over the budget is flagged ``oversize``.

Defined results: null text and null role count as empty; turns with the same number are ordered
by role and then by the 64-bit hash of their text, a null number comes first; ids are of any type that can be
ordered, and rows with a null id form one conversation with that id; repeated rows are turns of their own; other columns
of the input, whatever their names, don't matter; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = "(" + "|".join(x[0].replace("[", r"\[") for x in ("<", "[")) + ")(?=" + "|".join(sorted({x[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for x in CONTROL})) + ")"
#: Turns whose prefix sums one task takes, about.
RANGE = 200_000
#: Rows (some 50 bytes) that are broadcast at most, when counted; more are joined by a shuffle.
MOST_BROADCAST = 250_000


def escape(text: Column) -> Column:
    """``text`` without any control string; ``unescape`` takes it back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _laid_out(role: Column, text: Column) -> tuple[Column, Column]:
    """What stands before a turn's text, and the text with what ends the turn."""
    return F.concat(F.lit(START), F.regexp_replace(escape(role), "\n", "\\\\\\\n"), F.lit("\n")), F.concat(escape(text), F.lit(END))


def _numbered(turns: DataFrame, run: Scratch) -> DataFrame:
    """c, row, role, n of each turn (c, t, role, h, n, row), its ordinal ``k`` in its conversation and the sum ``after``
    it."""
    order = [F.col("c"), F.col("t").asc_nulls_first(), F.col("role"), F.col("h"), F.col("row")]
    parts = max(8, turns.count() // RANGE)
    ranged = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = run.table(ranged.select("c", "role", "n", "row", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")), "ranged")
    within = Window.partitionBy("part", "c").orderBy("at")
    local = ranged.withColumns({"k": F.row_number().over(within).cast("long") - 1, "after": F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    sums = ranged.groupBy("part", "c").agg(F.sum("n").alias("sn"), F.count(F.lit(1)).alias("sk"))
    upto = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range at most
    before = sums.select(F.col("part").alias("p2"), F.col("c").alias("c2"), F.sum("sn").over(upto).alias("n2"), F.sum("sk").over(upto).alias("k2")).where("k2 is not null")
    before = F.broadcast(run.table(before, "before"))  # bound: a range continues one conversation of the ranges before it
    joined = local.join(before, (F.col("part") == F.col("p2")) & F.col("c").eqNullSafe(F.col("c2")), "left")
    return joined.select("c", "row", "role", "n", (F.col("k") + F.coalesce("k2", F.lit(0))).alias("k"), (F.col("after") + F.coalesce("n2", F.lit(0))).alias("after"))


def _members(numbered: DataFrame, run: Scratch, budget: int, history: int) -> DataFrame:
    """row, c, span, k and ``repeated``: the windows that each turn is in; k is -1 for a repeated system turn."""
    first = numbered.where("role = 'system'").groupBy("c").agg(F.min(F.struct("k", "n", "row")).alias("s")).select(F.col("c").alias("c3"), F.col("s.k").alias("sk"), F.col("s.n").alias("sn"), F.col("s.row").alias("srow"))
    known = numbered.join(first, F.col("c").eqNullSafe(F.col("c3")), "left")
    room = F.greatest(F.lit(budget - history) - F.coalesce("sn", F.lit(0)), F.lit(1))
    at = F.col("after") - F.col("n")
    lo, hi = F.floor(at / room), F.floor((F.col("after") - 1) / room)
    new = run.table(known.select("c", "row", "k", "n", "after", at.alias("at"), (2 * lo + F.when(lo == hi, 0).otherwise(1)).cast("long").alias("span"), "sk", "srow"), "spans")
    starts = new.groupBy("c", "span").agg(F.min("at").alias("s4"), F.min("k").alias("k4"), F.first("sk").alias("sk4"), F.first("srow").alias("row"))
    member = new.select("row", "c", "span", "k", F.lit(False).alias("repeated"))
    system = starts.where("k4 > sk4").select("row", "c", "span", F.lit(-1).cast("long").alias("k"), F.lit(True).alias("repeated"))
    member = member.unionByName(system)
    if history:
        # turns that end where a span starts or before, and begin within `history` tokens of it
        starts = starts.select(F.col("c").alias("c4"), F.col("span").alias("span4"), "s4", F.floor(F.col("s4") / history).alias("cell4"))
        old = new.where((F.col("n") <= history) & (F.col("sk").isNull() | (F.col("k") != F.col("sk"))))
        old = old.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor(F.col("after") / history), F.floor((F.col("at") + history) / history)))))
        again = old.join(starts, F.col("c").eqNullSafe(F.col("c4")) & (F.col("cell") == F.col("cell4")) & (F.col("after") <= F.col("s4")) & (F.col("at") + history >= F.col("s4")))
        member = member.unionByName(again.select("row", "c", F.col("span4").alias("span"), "k", F.lit(True).alias("repeated")))
    return run.keep(member, "members")


def format_chat(turns: DataFrame, budget: int = 2048, history: int = 512, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """One row a window: id, ``window``, ``formatted``, ``n_tokens``, ``oversize``, ``turns``
    (array of ordinal, role, start, end, repeated: the laid-out turns) and ``loss`` (array of
    start, end: code points of ``formatted``, end exclusive)."""
    own = lambda c: F.col(f"`{c}`")
    role, text = F.coalesce(own(role_col), F.lit("")), F.coalesce(own(text_col), F.lit(""))
    head, body = _laid_out(role, text)
    size = own(tokens_col).cast("long") if tokens_col else F.ceil((F.length(head) + F.length(body)) / 4).cast("long")
    base = turns.select(own(id_col).alias("c"), own(turn_col).alias("t"), role.alias("role"), text.alias("x"), F.xxhash64(text).alias("h"), F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    with Scratch(turns.sparkSession) as run:
        base = run.keep(base, "turns")
        member = _members(_numbered(base.drop("x"), run), run, budget, history)
    if member.count() <= MOST_BROADCAST:
        member = F.broadcast(member)
    head, body = _laid_out(F.col("role"), F.col("x"))
    each = base.drop("c", "t", "h").join(member, "row").select("c", "span", F.struct("k", "role", F.concat(head, body).alias("piece"), F.length(head).cast("int").alias("head"), "n", "repeated").alias("p"))
    window = each.groupBy("c", "span").agg(F.sort_array(F.collect_list("p")).alias("p"))  # a budget's turns
    sizes = F.transform("p", lambda x: F.length(x["piece"]))
    window = window.withColumn("sizes", sizes)
    ends = F.aggregate("sizes", F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + x)))
    window = window.withColumn("ends", ends)
    start = lambda i: F.get("ends", i) - F.get("sizes", i)
    turn = lambda x, i: F.struct(x["k"].alias("ordinal"), x["role"].alias("role"), start(i).alias("start"), F.get("ends", i).alias("end"), x["repeated"].alias("repeated"), (start(i) + x["head"]).alias("text_start"))
    window = window.withColumn("turns", F.transform("p", turn))
    loss = F.transform(F.filter("turns", lambda x: (x["role"] == "assistant") & ~x["repeated"]), lambda x: F.struct(x["text_start"].alias("start"), (x["end"] - len(END)).alias("end")))
    tokens = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return window.select(
        F.col("c").alias(id_col),
        F.col("span").alias("window"),
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        tokens.alias("n_tokens"),
        (tokens > budget).alias("oversize"),
        F.transform("turns", lambda x: x.dropFields("text_start")).alias("turns"),
        loss.alias("loss"),
    )


def read_turns(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, ``window``, ``place`` in it, ``ordinal``, ``role``, ``text``, ``learnt`` (the text under the loss mask) and
    ``repeated`` of each laid-out turn, parsed from the formatted windows, and on a window's first turn its ``chars``."""
    laid_out = F.regexp_extract_all("formatted", F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), F.lit(1))
    each = windows.select(F.col(f"`{id_col}`"), "window", F.posexplode(F.arrays_zip(laid_out.alias("raw"), F.col("turns").alias("meta"))).alias("place", "z"), "loss", "formatted")
    split = r"(?s)\A([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)\z"  # possessive: loops, however long a role is
    raw = F.col("z.raw")
    target = F.filter("loss", lambda x: (x["start"] >= F.col("z.meta.start")) & (x["end"] <= F.col("z.meta.end")))
    learnt = F.array_join(F.transform(target, lambda x: F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"])), "")
    chars = F.when(F.col("place") == 0, F.length("formatted").cast("long"))
    return each.select(F.col(f"`{id_col}`"), "window", "place", F.col("z.meta.ordinal").alias("ordinal"), unescape(F.regexp_extract(raw, split, 1)).alias("role"), unescape(F.regexp_extract(raw, split, 2)).alias("text"), unescape(learnt).alias("learnt"), F.col("z.meta.repeated").alias("repeated"), chars.alias("chars"))


def read_back(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, ``ordinal``, ``role``, ``text`` and ``learnt`` of each turn; repeated turns are left out."""
    return read_turns(windows, id_col).where("not repeated").select(F.col(f"`{id_col}`"), "ordinal", "role", "text", "learnt")
