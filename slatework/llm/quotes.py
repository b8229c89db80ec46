"""Quotation linking for conversations, in DataFrame operations only.

A message's lines are parsed for nested quote marks (``>``). Runs of lines at one level are passages; level 0 is the
message's own text. Passages are normalised (marks off, lower case, all white space joined, so a passage that was
wrapped anew is the same) and hashed, as a whole, by paragraph and by line. Own passages file the earliest message with
each hash, per conversation and over all; quoted ones look theirs up, first in their own conversation, then
anywhere. The coarsest parts of a passage that are found say which message it comes from, by their words. The message that most
words of a message's outermost quoted passages come from is the one it answers; without quotes it answers the turn before.
Replies form threads. A message's place in its thread is depth first: a reply, all that answers it, then the next reply.

No task needs all messages of a conversation or all replies of a message: joins are by (conversation, turn) or by hash against
one row per key, roots and places are found by pointer doubling over tables in the shared folder, and replies are
put in order by a range sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatework.scratch import materialize

#: Leading quote marks with blanks around them.
MARKS = r"^((?:[ \t]*>)+)[ \t]?"
BLANKS = r"[\x09-\x0D ]+"


def level_of(line: Column) -> Column:
    """How many quote marks lead a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalise(line: Column) -> Column:
    """A passage or line without quote marks, in lower case, all white space joined and trimmed."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), BLANKS, " ")
    return F.trim(bare)


def passages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv, turn, th (hash of the text), passage (from 0), level, content: runs of lines at one level, quote marks taken off. Null texts have none."""
    lines = F.split(text, "\n")
    rows = messages.where(F.col(text).isNotNull())
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.xxhash64(text).alias("th"), lines.alias("lines"), F.transform(lines, level_of).alias("levels"))
    begins = F.filter(F.sequence(F.lit(1), F.size("levels")), lambda i: (i == 1) | (F.get("levels", i - 1) != F.get("levels", i - 2)))
    rows = rows.withColumn("begins", begins)

    def cut(i: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("begins", k + 1), F.size("lines") + 1)
        return F.struct(F.get("levels", i - 1).alias("level"), F.array_join(F.transform(F.slice("lines", i, upto - i), lambda x: F.regexp_replace(x, MARKS, "")), "\n").alias("content"))

    rows = rows.select("conv", "turn", "th", F.posexplode(F.transform("begins", cut)).alias("passage", "p"))
    return rows.select("conv", "turn", "th", "passage", "p.level", "p.content")


def _units(content: Column) -> Column:
    """(grain, normalised content) of a passage: the whole (0), its paragraphs (1) and lines (2) that have words."""

    def of(grain: int, parts: Column) -> Column:
        return F.transform(parts, lambda x: F.struct(F.lit(grain).alias("grain"), normalise(x).alias("words")))

    units = F.concat(of(0, F.array(content)), of(1, F.split(content, r"\n[\x09-\x0D ]*\n")), of(2, F.split(content, "\n")))
    return F.filter(units, lambda u: u["words"] != "")


def _hash(words: Column) -> Column:
    return F.unhex(F.md5(words))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv, turn, th, passage, level, words, to_conv, to_turn of every quoted passage with words; to_* is null where nobody wrote any of it.

    The author of a part is the earliest message with an own part of the same content: of the same conversation and an
    earlier turn if there is one, else of the smallest other conversation, at its first turn (no conversation comes last). Null
    turns are no authors. Of the coarsest parts with authors, the author of most words counts (then one of the same
    conversation, then the later turn, then the smaller conversation); ``words`` are those. Rows with equal conversation, turn and text count once.
    """
    runs = passages(messages, conv, turn, text)
    own = runs.where("level = 0").select("conv", "turn", F.explode(F.array_distinct(F.transform(_units(F.col("content")), lambda u: _hash(u["words"])))).alias("hash"))
    near = own.groupBy("conv", "hash").agg(F.min("turn").alias("to_turn")).where("to_turn IS NOT NULL")
    # The first place of each of the two smallest conversations: one of them is not the quoting one. Tasks send two rows a hash.
    rank = F.row_number().over(Window.partitionBy("hash").orderBy(F.col("conv").isNull(), "conv"))
    place = F.struct("conv", F.col("to_turn").alias("turn"))
    two = near.withColumn("rank", rank).where("rank <= 2")
    far = two.groupBy("hash").agg(F.min(F.when(F.col("rank") == 1, place)).alias("to"), F.min(F.when(F.col("rank") == 2, place)).alias("next"))
    quoted = runs.where("level > 0").select("conv", "turn", "th", "passage", "level", F.posexplode(_units(F.col("content"))).alias("part", "u"))
    count = F.size(F.split("u.words", " ")).cast("long").alias("words")
    quoted = quoted.select("conv", "turn", "th", "passage", "level", "part", "u.grain", _hash(F.col("u.words")).alias("hash"), count).distinct()
    q, n, f = quoted.alias("q"), near.alias("n"), far.alias("f")
    same = (F.col("q.conv") == F.col("n.conv")) & (F.col("q.hash") == F.col("n.hash")) & (F.col("n.to_turn") < F.col("q.turn"))
    found = q.join(n, same, "left").select("q.*", F.col("n.to_turn").alias("near_turn")).alias("q")
    found = found.join(f, (F.col("q.hash") == F.col("f.hash")) & F.col("q.near_turn").isNull(), "left")
    to = F.when(F.col("f.to.conv").eqNullSafe(F.col("q.conv")), F.col("f.next")).otherwise(F.col("f.to"))
    found = found.select(
        "q.conv", "q.turn", "q.th", "q.passage", "q.level", "q.grain", "q.words",
        F.when(F.col("near_turn").isNotNull(), F.col("q.conv")).otherwise(to["conv"]).alias("to_conv"), F.coalesce("near_turn", to["turn"]).alias("to_turn"),
    )
    key = ["conv", "turn", "th", "passage", "level"]
    sums = found.groupBy(*key, "grain", "to_conv", "to_turn").agg(F.sum("words").alias("words"))
    order = F.struct("grain", -F.col("words"), ~F.col("to_conv").eqNullSafe(F.col("conv")), -F.col("to_turn"), F.col("to_conv").isNull(), "to_conv")
    best = F.min_by(F.struct("words", "to_conv", "to_turn"), F.when(F.col("to_turn").isNotNull(), order))
    return sums.groupBy(*key).agg(best.alias("best")).select(*key, "best.words", "best.to_conv", "best.to_turn")


def parents(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv, turn, n_quoted and n_linked (passages), to_conv, to_turn per distinct (conv, turn) without nulls."""
    links = link(messages, conv, turn, text)
    outer = (F.col("level") == 1) & F.col("to_conv").isNotNull()
    votes = links.groupBy("conv", "turn", "to_conv", "to_turn").agg(F.count("*").alias("n"), F.sum(F.when(outer, F.col("words"))).alias("words"))
    best = F.min_by(F.struct("to_conv", "to_turn"), F.when(F.col("words").isNotNull(), F.struct(-F.col("words"), -F.col("to_turn"), "to_conv")))
    linked = F.sum(F.when(F.col("to_turn").isNotNull(), F.col("n")).otherwise(0))
    votes = votes.groupBy("conv", "turn").agg(F.sum("n").alias("n_quoted"), linked.alias("n_linked"), best.alias("best"))
    ids = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn")).where("conv IS NOT NULL AND turn IS NOT NULL").distinct()
    rows = ids.join(votes, ["conv", "turn"], "left")
    before = ids.select("conv", (F.col("turn") + 1).cast(ids.schema["turn"].dataType).alias("turn"), F.col("turn").alias("last"))
    rows = rows.join(before, ["conv", "turn"], "left")
    fallback = F.when(F.col("last").isNotNull(), F.struct(F.col("conv").alias("to_conv"), F.col("last").alias("to_turn")))
    return rows.select(
        "conv", "turn", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("best", fallback).alias("to")
    ).select("conv", "turn", "n_quoted", "n_linked", "to.to_conv", "to.to_turn")


def threads(found: DataFrame) -> DataFrame:
    """Add root_conv, root_turn and depth to ``parents``: pointer doubling, so a chain of n replies takes log2(n) rounds.

    Messages that quote each other in a circle across conversations have no root; they are roots themselves.
    """
    root = F.col("to_conv").isNull()
    now = found.select(
        "conv", "turn", F.col("to_conv").alias("c"), F.col("to_turn").alias("t"), F.when(root, 0).otherwise(1).cast("long").alias("depth"),
        F.when(root, F.col("conv")).alias("root_conv"), F.when(root, F.col("turn")).alias("root_turn"),
    )
    now = materialize(now, "pointers")
    settled, open_ = now.where("c IS NULL"), now.where("c IS NOT NULL")
    left = open_.count()
    while left:
        # A settled row knows its root; what points at it learns root and depth from it. Only open rows move.
        names = (("conv", "c"), ("turn", "t"), ("c", "uc"), ("t", "ut"), ("depth", "more"), ("root_conv", "rc"), ("root_turn", "rt"))
        up = settled.unionByName(open_).select(*[F.col(x).alias(y) for x, y in names])
        moved = open_.join(up, ["c", "t"], "left").select(
            "conv", "turn", F.col("uc").alias("c"), F.col("ut").alias("t"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.coalesce("root_conv", "rc").alias("root_conv"), F.coalesce("root_turn", "rt").alias("root_turn"),
        )
        moved = materialize(moved, "pointers")
        settled, open_ = settled.unionByName(moved.where("c IS NULL")), moved.where("c IS NOT NULL")
        before, left = left, open_.count()
        if left == before:  # every round settles some rows, but for circles
            break
    circle = F.col("root_conv").isNull()
    return settled.unionByName(open_).select(
        "conv", "turn", F.coalesce("root_conv", "conv").alias("root_conv"), F.coalesce("root_turn", "turn").alias("root_turn"), F.when(circle, 0).otherwise(F.col("depth")).alias("depth")
    )


def _numbered(rows: DataFrame, *by: Column | str) -> DataFrame:
    """Rows with ``i``, their number from 0 in the order ``by``: a range sort, and the rows of the partitions before."""
    held = materialize(rows.orderBy(*by).withColumn("m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("m", 33)
    sizes = held.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.broadcast(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    number = F.col("base") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("part", part).join(sizes, "part").withColumn("i", number).drop("part", "m", "base")


def places(found: DataFrame, rooted: DataFrame) -> DataFrame:
    """Add place to ``threads``: the number of messages before it in its thread, depth first, replies by (conversation, turn).

    A thread where nothing has two replies is a chain, and places are depths. In the others each message is entered and left
    once; a walk from entry to exit leads through them in order, and doubling its steps counts the entries to its end.
    """
    rows = found.join(rooted, ["conv", "turn"])
    at_root = F.col("depth") == 0  # of a circle too: what it answers does not count
    rows = rows.select("conv", "turn", "root_conv", "root_turn", "depth", F.when(~at_root, F.col("to_conv")).alias("c"), F.when(~at_root, F.col("to_turn")).alias("t"))
    several = rows.where("c IS NOT NULL").groupBy("c", "t").agg(F.count("*").alias("n"), F.first("root_conv").alias("root_conv"), F.first("root_turn").alias("root_turn"))
    several = materialize(several.where("n > 1").select("root_conv", "root_turn").distinct(), "branching")
    chains = rows.join(several, ["root_conv", "root_turn"], "left_anti").withColumn("place", F.col("depth"))
    out = ["conv", "turn", "root_conv", "root_turn", "depth", "place"]
    if several.isEmpty():
        return chains.select(*out)
    nodes = materialize(_numbered(rows.join(several, ["root_conv", "root_turn"]), "c", "t", "conv", "turn"), "nodes")
    up = nodes.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("i").alias("up"))
    after = nodes.where("c IS NOT NULL").select("c", "t", (F.col("i") - 1).alias("i"), F.col("i").alias("next"))
    last = nodes.where("c IS NOT NULL").select(F.col("c").alias("pc"), F.col("t").alias("pt"), (F.col("i") + 1).alias("i"))
    first = nodes.where("c IS NOT NULL").join(last, "i", "left").where("pc IS NULL OR pc != c OR pt != t").select(F.col("c").alias("conv"), F.col("t").alias("turn"), F.col("i").alias("child"))
    steps = nodes.join(up, ["c", "t"], "left").join(after, ["c", "t", "i"], "left").join(first, ["conv", "turn"], "left")
    enter, leave = lambda c: 2 * F.col(c), lambda c: 2 * F.col(c) + 1
    one = F.struct(enter("i").alias("id"), F.coalesce(enter("child"), leave("i")).alias("to"), F.lit(1).cast("long").alias("n"))
    two = F.struct(leave("i").alias("id"), F.coalesce(enter("next"), leave("up")).alias("to"), F.lit(0).cast("long").alias("n"))
    now = materialize(steps.select(F.explode(F.array(one, two)).alias("s")).select("s.*"), "steps")
    settled, open_ = now.where("to IS NULL"), now.where("to IS NOT NULL")
    while not open_.isEmpty():
        ahead = settled.unionByName(open_).select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"))
        moved = materialize(open_.join(ahead, "to").select("id", F.col("far").alias("to"), (F.col("n") + F.col("more")).alias("n")), "steps")
        settled, open_ = settled.unionByName(moved.where("to IS NULL")), moved.where("to IS NOT NULL")
    left = settled.where("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("i"), F.col("n").alias("left"))
    size = nodes.groupBy("root_conv", "root_turn").agg(F.count("*").alias("size"))
    walked = nodes.join(left, "i").join(size, ["root_conv", "root_turn"]).withColumn("place", F.col("size") - F.col("left"))
    return chains.select(*out).unionByName(walked.select(*out))


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """row (the input's columns), body, n_quoted, n_linked, to_conv, to_turn, root_conv, root_turn, depth, place per input row.

    Sort by (root_conv, root_turn, place) for conversations in reply order. body is the text without quoted lines,
    null for a null text, and empty for an empty text or one of quotes only. Rows with a null conversation or turn answer
    nobody, start no thread (root, depth and place are null) and can be quoted. Repeated (conversation, turn) rows share
    their links and place. Conversations may have keys of any type that can be ordered, turns are whole numbers. Extra columns
    travel in ``row``. An empty table gives no rows.
    """
    found = materialize(parents(messages, conv, turn, text), "parents")
    placed = found.join(places(found, materialize(threads(found), "threads")), ["conv", "turn"])
    body = F.array_join(F.filter(F.split(text, "\n"), lambda x: level_of(x) == 0), "\n")
    rows = messages.select(F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("row"), F.col(conv).alias("conv"), F.col(turn).alias("turn"), body.alias("body"))
    out = rows.join(placed, ["conv", "turn"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("row", "body", count("n_quoted"), count("n_linked"), "to_conv", "to_turn", "root_conv", "root_turn", "depth", "place")
