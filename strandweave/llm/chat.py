"""Chat formatting by quotation linking.

A message's lines carry quote levels: the number of ``>`` marks at their start. A quoted passage is a run of lines of
one level. Passages are normalised (marks off, white space runs to one blank, A-Z in lower case) and hashed, whole,
by paragraph and line by line, and joined within the conversation to the message that first wrote the same text (whole, a
paragraph or a line). A message replies to the latest message that its level-1 passages lead to; without one it
replies to the last message of an earlier turn.

Conversations come out in reply order, the order of a walk through the tree of replies: a message stands before its
replies, and each reply is followed by all that answers it before the next reply (by turn) begins. Quotes and their attribution
lines are taken out.

The hash join never lists pairs: the originals are reduced to the first message for each (conversation, hash) before it.
Messages are numbered by one global sort. Where every message answers the one before, that number is the place; else runs of
such messages are contracted, and only the runs are placed, by list ranking (pointer doubling) along the walk around the
tree, so neither a long conversation nor a message with many replies is one task's work.

Defined cases: a null or empty text gives an empty content and no links; a quote of the message itself or of one of the
same or a later turn isn't a link; rows that repeat (conv_id, turn) are messages of their own, in order of role and
content, each with its own quotes; messages of a conversation's first turn have no parent; rows with a null conv_id or
turn come out with null position and parent; other columns of the table are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_rows

#: Messages in whose range one task looks for the starts of runs.
RANGE = 1000
#: Lines that announce a quote.
ATTRIBUTION = r"^\s*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"

PARSED = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("own", T.ArrayType(T.LongType())),
        T.StructField("quotes", T.ArrayType(T.StructType([T.StructField("passage", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("key", T.LongType())]))),
        T.StructField("n_passages", T.IntegerType()),
        T.StructField("deepest", T.IntegerType()),
    ]
)


def level_of(line: str) -> tuple[int, str]:
    """Quote level of a line and what stands behind its marks."""
    m = re.match(r"[ \t]*((?:>[ \t]?)*)", line)
    marks = m[1].count(">")
    return (marks, line[m.end() :]) if marks else (0, line)


def normal(text: str) -> str:
    text = re.sub(r"\s+", " ", text).strip()
    return text.translate({c: c + 32 for c in range(65, 91)})


def key_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(text: str | None) -> tuple[str, list[str], list[tuple[int, str]]]:
    """Content without quotes, its normalised units (whole, paragraphs, lines) and (level, passage) in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    announce = re.compile(ATTRIBUTION, re.I)
    for line in (text or "").split("\n"):
        level, rest = level_of(line.removesuffix("\r"))
        if not level:
            own.append(rest)
        elif before == level:
            passages[-1][1].append(rest)
        else:
            if not before:
                last = next((i for i in range(len(own) - 1, -1, -1) if own[i].strip()), None)
                if last is not None and announce.match(own[last]):
                    del own[last:]
            passages.append((level, [rest]))
        before = level
    content = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip()
    units = {normal(content), *map(normal, re.split(r"\n\s*\n", content)), *map(normal, content.split("\n"))} - {""}
    return content, sorted(units), [(level, "\n".join(p)) for level, p in passages if normal("\n".join(p))]


def parse_rows(rows: DataFrame, text_col: str) -> DataFrame:
    def make():
        def one(text):
            content, units, passages = parse(text)
            quotes = []
            for i, (level, p) in enumerate(passages):
                parts = [x for x in map(normal, [*re.split(r"\n\s*\n", p), *p.split("\n")]) if x]
                for rank, unit in enumerate([normal(p), *parts]):
                    quotes.append({"passage": i, "level": level, "rank": rank, "key": key_of(unit)})
            return content, [key_of(u) for u in units], quotes, len(passages), max((level for level, _ in passages), default=0)

        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("rank", pa.int32()), ("key", pa.int64())])), pa.int32(), pa.int32())

        def call(a):
            got = [one(t) for t in a["text"].to_pylist()]
            return [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]

        return call

    return map_rows(rows, {"text": text_col}, make, PARSED)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with the dense number of each row (from 0) in a total order, by one range exchange. Ties are broken by the
    rows' places in ``df``, which must be cut, so that no run of equal keys is one task's."""
    placed = cut(df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order, "_tie").withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))  # a row for each partition
    ahead = sizes.select("_part", (F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_ahead"))
    return placed.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_ahead", "_at")


def sources(rows: DataFrame) -> DataFrame:
    """For each message (``g``) with linked passages: ``quoted``, the latest source of a level-1 passage, and ``n_linked``."""
    asked = rows.select("conv_id", "g", "turn", F.explode("quotes").alias("q")).select("conv_id", "g", "turn", "q.*")
    wanted = asked.select("conv_id", "key").distinct()
    wrote = rows.select("conv_id", "g", "turn", F.explode("own").alias("key")).join(wanted, ["conv_id", "key"], "left_semi")
    first = wrote.groupBy("conv_id", "key").agg(F.min("g").alias("source"), F.min("turn").alias("written"))
    return (
        asked.join(first, ["conv_id", "key"])
        .filter("written < turn")
        .groupBy("g", "passage", "level")
        .agg(F.min_by("source", "rank").alias("source"))
        .groupBy("g")
        .agg(F.max(F.when(F.col("level") == 1, F.col("source"))).alias("quoted"), F.count("*").cast("int").alias("n_linked"))
    )


def run_starts(rows: DataFrame) -> DataFrame:
    """g and ``run``: the last message up to g that doesn't answer the one before it. ``rows``: conv_id, g, parent."""
    head = F.when(F.col("parent").isNull() | (F.col("parent") != F.col("g") - 1), F.col("g"))
    rows = rows.withColumn("head", head).withColumn("span", F.floor(F.col("g") / RANGE))
    spans = rows.groupBy("conv_id", "span").agg(F.max("head").alias("last"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "span", F.max("last").over(before).alias("before"))
    inside = Window.partitionBy("conv_id", "span").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("own", F.max("head").over(inside)).join(spans, ["conv_id", "span"])
    return found.select("conv_id", "g", "parent", F.coalesce("own", "before").alias("run"))


def run_places(runs: DataFrame) -> DataFrame:
    """run and ``before``: how many messages of its conversation stand before it. ``runs``: conv_id, run, n, parent_run (null
    for the first), attach (the message of the parent run that it answers).

    The walk enters a run, walks its replies (those to its last message first, each message's by turn) and leaves it:
    a linked list of 2 places a run. The number of messages from a place to the list's end comes by pointer doubling.
    """
    down, up = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    order = numbered(cut(runs), "s", "conv_id", F.col("parent_run").asc_nulls_first(), F.col("attach").desc(), "run")
    order = cut(order)
    beside = order.select((F.col("s") - 1).alias("s"), F.col("conv_id").alias("c"), F.col("parent_run").alias("p"), F.col("run").alias("next_run"))
    order = order.join(beside, "s", "left")
    next_run = F.when((F.col("c") == F.col("conv_id")) & F.col("p").eqNullSafe(F.col("parent_run")), F.col("next_run"))
    child = order.filter("parent_run is not null").groupBy(F.col("parent_run").alias("run")).agg(F.min_by("run", "s").alias("child"))
    order = order.withColumn("next_run", next_run).join(child, "run", "left")
    enter = order.select(down("run").alias("at"), F.coalesce(down("child"), up("run")).alias("next"), F.col("n").alias("w"))
    leave = order.select(up("run").alias("at"), F.coalesce(down("next_run"), up("parent_run")).alias("next"), F.lit(0).cast("long").alias("w"))
    now = cut(enter.union(leave))
    while now.filter("next is not null").limit(1).count():
        on = now.select(F.col("at").alias("next"), F.col("next").alias("after"), F.col("w").alias("more"))
        now = cut(now.join(on, "next", "left").select("at", F.col("after").alias("next"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")))
    total = runs.groupBy("conv_id").agg(F.sum("n").alias("total"))
    return runs.select("conv_id", "run").join(total, "conv_id").join(now.filter("at % 2 = 0").select((F.col("at") / 2).cast("long").alias("run"), "w"), "run").select("run", (F.col("total") - F.col("w")).alias("before"))


def link_quotes(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every message in reply order: conv_id, position, turn, role, content, parent_turn, link (quote, turn or root),
    n_passages, n_linked and deepest (quote level), and parent_position."""
    slim = rows.select(rows[f"`{conv}`"].alias("conv_id"), rows[f"`{turn}`"].alias("turn"), rows[f"`{role}`"].alias("role"), rows[f"`{text}`"].alias("text"))
    parsed = cut(parse_rows(slim, "text").select("row.conv_id", "row.turn", "row.role", "out.*"))
    placed = cut(numbered(parsed.filter("conv_id is not null and turn is not null"), "g", "conv_id", "turn", "role", "content"))

    # The message that each one answers, by its number.
    turns = placed.groupBy("conv_id", "turn").agg(F.min("g").alias("of_turn"))
    convs = placed.groupBy("conv_id").agg(F.min("g").alias("of_conv"), F.count("*").alias("n"))
    prior = F.when(F.col("of_turn") > F.col("of_conv"), F.col("of_turn") - 1)
    slim = placed.drop("own", "quotes", "content").join(turns, ["conv_id", "turn"]).join(convs, "conv_id").join(sources(placed), "g", "left")
    linked = cut(slim.withColumn("parent", F.coalesce("quoted", prior)))

    # Places: those of the sort, but for conversations of several runs.
    starts = run_starts(linked.select("conv_id", "g", "parent"))
    runs = cut(starts.groupBy("conv_id", "run").agg(F.count("*").alias("n"), F.min_by("parent", "g").alias("attach")))
    several = runs.groupBy("conv_id").count().filter("count > 1").select("conv_id")
    runs = cut(runs.join(several, "conv_id", "left_semi"))
    place = F.col("g") - F.col("of_conv")
    if runs.limit(1).count():
        starts = cut(starts.join(several, "conv_id", "left_semi").select("g", "run"))
        parents = starts.select(F.col("g").alias("attach"), F.col("run").alias("parent_run"))
        moved = starts.join(run_places(runs.join(parents, "attach", "left")), "run").select("g", (F.col("before") + F.col("g") - F.col("run")).alias("moved"))
        linked = cut(linked.join(moved, "g", "left").withColumn("position", F.coalesce("moved", place)))
    else:
        linked = linked.withColumn("position", place)

    kind = F.when(F.col("quoted").isNotNull(), "quote").when(F.col("parent").isNotNull(), "turn").otherwise("root")
    answered = linked.select(F.col("g").alias("parent"), F.col("turn").alias("parent_turn"), F.col("position").alias("parent_position"))
    full = linked.join(answered, "parent", "left").join(placed.select("g", "content"), "g")
    done = full.select(
        "conv_id", F.col("position").cast("long").alias("position"), "turn", "role", "content", "parent_turn", kind.alias("link"), "n_passages", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "deepest", F.col("parent_position").cast("long").alias("parent_position")
    )
    loose = parsed.filter("conv_id is null or turn is null")
    none = F.lit(None)
    return done.unionByName(
        loose.select("conv_id", none.cast("long").alias("position"), "turn", "role", "content", none.cast(loose.schema["turn"].dataType).alias("parent_turn"), F.lit("root").alias("link"), "n_passages", F.lit(0).alias("n_linked"), "deepest", none.cast("long").alias("parent_position"))
    )
