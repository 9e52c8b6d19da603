"""Operator 6: conversations by their quotes, with DataFrame functions only.

Lines with > marks are quotes; lines of one level in a row are a passage.
Passages are normalised and hashed and joined to the messages in which the
passage is own text: the whole body, a paragraph or a line.  A passage that no
message has as such is looked up by its paragraphs, and then by its lines.  The
quoting message is a reply to the message that its first linked passage comes
from, and a conversation is the tree of replies below a message without a link, with each
message's depth in it; of links in a circle, that of the smallest message is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

MARKS = r"^(?:[ \t]?>)+"


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hash(text: Column) -> Column:
    """128 bits."""
    return F.md5(text.cast("binary"))


def parsed(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, body, own, passages): body without quotes, hashes of own text, quoted passages (level, parts: unit, hash)."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))
    marked = F.transform(lines, lambda line: F.struct(level(line).alias("level"), F.regexp_replace(line, MARKS + r"[ \t]?", "").alias("content")))
    base = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), marked.alias("lines"))
    at = lambda k: F.element_at(F.col("lines"), k)
    starts = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda k: (k == 1) | (at(k)["level"] != at(F.greatest(k - 1, F.lit(1)))["level"]))
    base = base.withColumn("starts", starts)

    def passage(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.try_element_at("starts", k + 2), F.size("lines") + 1)
        text = F.array_join(F.transform(F.slice("lines", start, stop - start), lambda x: x["content"]), "\n")
        units = [F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n")]  # passage, paragraphs, lines
        part = lambda unit: lambda x: F.struct(F.lit(unit).alias("unit"), normalised(x).alias("text"))
        parts = F.concat(*[F.transform(u, part(unit)) for unit, u in enumerate(units)])
        return F.struct(at(start)["level"].alias("level"), F.filter(parts, lambda x: x["text"] != "").alias("parts"))

    quoted = F.filter(F.transform("starts", passage), lambda p: (p["level"] > 0) & (F.size(p["parts"]) > 0))
    body = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["content"]), "\n")
    base = base.select("conv_id", "turn", "role", body.alias("body"), F.transform(quoted, lambda p: F.struct(p["level"].alias("level"), F.transform(p["parts"], lambda x: F.struct(x["unit"].alias("unit"), _hash(x["text"]).alias("hash"))).alias("parts"))).alias("passages"))
    pieces = F.transform(F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n")), normalised)
    own = F.transform(F.array_distinct(F.filter(pieces, lambda p: p != "")), _hash)
    return base.withColumn("own", own)


def rooted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root, depth) of the nodes of edges (node, parent), one parent a node; and the nodes whose link is dropped as the smallest of a circle.

    A node knows its ancestor 1, 2, 4 .. steps above, and the smallest node on the way, so that rounds follow the
    logarithm of the longest chain and no row holds a chain.  Who finds itself the smallest after as many steps as there are edges is on a circle.
    """
    cut = None
    while True:
        number = edges.count()
        tree = edges.select("node", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"), F.col("parent").alias("low"), F.lit(True).alias("open"))
        while True:
            above = tree.select(F.col("node").alias("root"), F.col("root").alias("top"), F.col("depth").alias("more"), F.col("low").alias("lower"))
            uses = tree.groupBy("root").agg(F.count("*").alias("n"))
            step = shared.spread_join(tree.drop("open"), above, ["root"], uses, ["node"], "left")
            step = step.select("node", F.coalesce("top", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.least("low", "lower").alias("low"), F.col("top").isNotNull().alias("open"))
            tree = shared.written(step, "ancestors")
            longest = tree.where("open").agg(F.max("depth").alias("d")).first()["d"]
            if longest is None or longest > number:
                break
        if longest is None:
            return tree.select("node", "root", "depth"), cut if cut is not None else edges.select("node").limit(0)
        found = shared.written(tree.where("open and node = low").select("node"), "circles")
        cut = found if cut is None else cut.unionByName(found)
        edges = shared.written(edges.join(found, "node", "left_anti"), "edges")


def linked(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages in reply order.

    Columns: thread (the first message's conv_id and turn), depth (replies from it to
    the message), conv_id, turn, role, body, n_passages, max_level, n_linked,
    reply_conv, reply_turn.  A passage links to the first message (by conv_id and
    turn) of the same conversation that has it as own text, if that is before the
    quoting message, else to that of the first other conversation that has it (the
    last one, where the quoting conversation is the first), whatever its order.  Null texts are empty; rows
    that repeat (conv_id, turn) share the links of the smallest of their quotes, and rows that lack one of the two have none.
    Ordered by thread, depth, conv_id and turn, each message comes after the one that it replies to.
    """
    known = parsed(messages, conv_col, turn_col, role_col, text_col)
    fine = known.where("conv_id is not null and turn is not null")
    quotes = fine.where(F.size("passages") > 0).groupBy("conv_id", "turn").agg(F.min("passages").alias("passages"))
    quotes = quotes.select("conv_id", "turn", F.posexplode("passages").alias("k", "p")).select("conv_id", "turn", "k", F.col("p.level").alias("level"), F.posexplode("p.parts").alias("j", "part"))
    quotes = shared.written(quotes.select("conv_id", "turn", "k", "level", "j", F.col("part.hash").alias("hash")), "quotes")
    # the first message of each piece of own text, in each conversation and in all: counted before the shuffle, and only what is asked for is kept
    asked = quotes.groupBy("hash").agg(F.count("*").alias("n"))
    near = fine.select("conv_id", "turn", F.explode("own").alias("hash")).groupBy("hash", "conv_id").agg(F.min("turn").alias("near_turn"))
    near = shared.written(near.join(asked.select("hash"), "hash", "left_semi"), "sources")
    other = F.struct("conv_id", F.col("near_turn").alias("turn"))
    far = near.groupBy("hash").agg(F.min(other).alias("first"), F.max(other).alias("last"))
    found = shared.spread_join(quotes.join(near, ["hash", "conv_id"], "left"), far, ["hash"], asked, ["conv_id", "turn"], "left")
    far_origin = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).when(F.col("last.conv_id") != F.col("conv_id"), F.col("last"))
    origin = F.when(F.col("near_turn") < F.col("turn"), other).otherwise(far_origin)
    # parts of a passage go from the whole to its paragraphs and lines: the first with an origin counts
    found = found.withColumn("origin", origin).groupBy("conv_id", "turn", "k").agg(F.first("level").alias("level"), F.min_by("origin", F.when(F.col("origin").isNotNull(), F.col("j"))).alias("origin"))
    replies = found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_passages"), F.max("level").alias("max_level"), F.count("origin").alias("n_linked"),
        F.min_by("origin", F.when(F.col("origin").isNotNull(), F.struct("level", "k"))).alias("parent"))
    replies = shared.written(replies, "replies")
    me = F.struct("conv_id", "turn")
    edges = replies.where("parent is not null").select(me.alias("node"), "parent")
    tree, circles = rooted(edges)
    links = replies.join(tree.select("node.conv_id", "node.turn", "root", "depth"), ["conv_id", "turn"], "left").join(circles.select("node.conv_id", "node.turn", F.lit(True).alias("circle")), ["conv_id", "turn"], "left")
    links = links.select("conv_id", "turn", "n_passages", "max_level", "n_linked", "root", "depth", F.when(F.col("circle").isNull(), F.col("parent")).alias("parent"))
    out = known.join(links, ["conv_id", "turn"], "left")
    return out.select(
        F.coalesce("root", me).alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "conv_id", "turn", "role", "body", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce("max_level", F.lit(0)).alias("max_level"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent.conv_id").alias("reply_conv"), F.col("parent.turn").alias("reply_turn"))
