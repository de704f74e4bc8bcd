"""Chat formatting over reply trees.

A table of messages with parent links is a forest.  Ancestor links are doubled by
self-joins (a node's link to the node 1, 2, 4, ... steps up), which gives every
node its depth and its path's score in a number of joins that is the logarithm of
the longest path.  Root-to-leaf paths are ranked by score, and the chosen paths
are expanded by walking the same links back down, so that only rows of chosen
paths are ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.running import running
from lodestar.llm.scratch import stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    """Text in which no control string can occur; ``unescape`` undoes it."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    # A text that holds no backslash was never changed.
    parts = F.split(c, r"\\\\", -1)
    return F.when(F.instr(c, "\\") == 0, c).otherwise(F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\|"), F.lit("|"))), "\\"))


def escape_role(c: Column) -> Column:
    """As ``escape``, on one line."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    parts = F.split(c, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.when(F.instr(c, "\\") == 0, c).otherwise(F.array_join(plain, "\\"))


def linear_tree(turns: DataFrame, conversation: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Messages of flat conversations: each row replies to the one before it."""
    w = Window.partitionBy(conversation).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    node = F.row_number().over(w).cast("long") - 1
    rows = turns.select(F.col(conversation).alias("tree"), node.alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def one_per_node(messages: DataFrame) -> DataFrame:
    """One row for each (tree, node): the best score, then the smallest parent, role and text, nulls first."""
    rest = [c for c in ("parent", "role", "text") if c in messages.columns]
    first = F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("score"), *rest)).alias("m")
    return messages.groupBy("tree", "node").agg(first).select("tree", "node", (-F.col("m.score")).alias("score"), *[f"m.{c}" for c in rest])


def paths(messages: DataFrame, keep: int = 1, distinct: bool = False) -> DataFrame:
    """Rows ``(tree, leaf, depth, node)`` of the ``keep`` best root-to-leaf paths of each tree.

    ``messages``: tree, node, parent (null at a root), score.  Of rows with the same tree and node
    one counts (``one_per_node``), so that no join multiplies them; ``distinct`` says that there are none.  Paths rank by the sum of their scores, then the longer, then the smaller leaf.
    A message whose parent is missing is a root.  Messages on a cycle have no root
    and belong to no path.
    """
    same = lambda a, b: a.eqNullSafe(b)
    base = (messages if distinct else one_per_node(messages)).select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = base.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    links = base.join(known, same(F.col("tree"), F.col("t")) & (F.col("parent") == F.col("n")), "left")
    step = stage(links.select("tree", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "chat-links")
    levels = [step]
    nodes = step.count()
    while (open_ := step.where("up is not null")).limit(1).count():
        if (1 << len(levels)) > 2 * max(nodes, 1):  # only a cycle is still open
            break
        above = step.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("s2"))
        joined = open_.join(above, same(F.col("tree"), F.col("t")) & (F.col("up") == F.col("n")))
        moved = joined.select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("s2")).alias("total"))
        step = stage(moved.unionByName(step.where("up is null")), "chat-links")
        levels.append(step)
    ended = step.where("up is null")
    inner = base.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = ended.join(inner, same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    walk = chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", "depth")
    for k, level in reversed(list(enumerate(levels[:-1]))):
        jump = level.where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        joined = walk.join(jump, same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("n")), "left")
        here = F.struct("node", "depth")
        higher = F.struct(F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, higher))
        walk = joined.select("tree", "leaf", "rank", F.explode(both).alias("at")).select("tree", "leaf", "rank", "at.node", "at.depth")
    return walk


def format_conversations(messages: DataFrame, keep: int = 1, distinct: bool = False) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, formatted, loss_spans.

    Every message becomes ``<|im_start|>role\\ntext<|im_end|>\\n`` with role and
    text escaped (null: empty).  ``loss_spans`` has start and end (code points of
    ``formatted``) of each assistant text, in order.  Of rows with the same tree and node one
    counts, as in ``paths``; an empty table gives an empty table, and other columns are ignored.
    """
    messages = messages if distinct else one_per_node(messages)
    walk = paths(messages, keep, distinct=True)
    texts = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    rows = walk.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    turn = F.struct("depth", head.alias("head"), body.alias("body"), (F.coalesce("role", F.lit("")) == "assistant").alias("learn"))
    grouped = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    tail = len(CLOSE) + 1
    width = lambda t: F.length(t["head"]) + F.length(t["body"]) + tail

    def step(at: Column, t: Column) -> tuple[Column, Column]:
        start = at + F.length(t["head"])
        return at + width(t), F.when(t["learn"], F.struct(start.alias("start"), (start + F.length(t["body"])).alias("end")))

    spans = F.array_compact(running(F.col("turns"), "struct<start:int,end:int>", F.lit(0), step))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))), "")
    return grouped.select("tree", "leaf", "rank", text.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Turns ``(role, text)`` read back from a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    inner = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(OPEN) + 1, F.length(p)))
    return F.transform(inner, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))
