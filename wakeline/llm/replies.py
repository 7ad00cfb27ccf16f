"""Reply trees to training conversations.

A tree's nodes point to what they answer. Self-joins double the reach of those
pointers round by round, and with them the sum of the scores up to the root, so
trees of any depth take a logarithmic number of rounds. The best leaves of each
tree are chosen, the same pointers enumerate their paths, and each path is
formatted as one conversation whose assistant texts bear the loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.store import materialise

#: Fixed values of the template: what opens and closes a turn.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Control strings of this and of other chat templates, by their first character and the rest.
CONTROL = {
    "<": ["|turn|>", "|end|>", "|im_start|>", "|im_end|>", "|endoftext|>", "|system|>", "|user|>", "|assistant|>", "s>", "/s>", "<SYS>>", "</SYS>>"],
    "[": ["INST]", "/INST]"],
}
#: The first character of a control string, also where backslashes follow it.
CONTROLS = "|".join(rf"{re.escape(first)}(?=\\*(?:{'|'.join(map(re.escape, rests))}))" for first, rests in CONTROL.items())
#: The same with the first of the backslashes.
GUARDED = "|".join(rf"{re.escape(first)}\\(?=\\*(?:{'|'.join(map(re.escape, rests))}))" for first, rests in CONTROL.items())


def escape(text: Column) -> Column:
    """Text without control strings: a backslash is put after the first character of each, one more where there are some."""
    return F.regexp_replace(text, CONTROLS, r"$0\\")


def unescape(text: str) -> str:
    return re.sub(GUARDED, lambda m: m[0][0], text)


def role_line(role: Column) -> Column:
    """A role on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def read_role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    for turn in formatted.split(OPEN)[1:]:
        role, _, text = turn.removesuffix(CLOSE).partition("\n")
        yield read_role(role), unescape(text)


def read_loss(formatted: str, loss: list) -> Iterator[str]:
    """The unescaped texts under the loss mask (start, length)."""
    for start, length in loss:
        yield unescape(formatted[start : start + length])


def chain_nodes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches: each row answers the one before.

    Rows go by turn (nulls first), equal turns by role and text; repeated rows are turns of their own.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(w).cast("long")
    return turns.select("conv_id", at.alias("node_id"), F.nullif(at - 1, F.lit(0)).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(pointers, roads): pointers[i] has the 2^i-th ancestor `up` of each node that has one; roads has for each node under a root the sum of the scores and the number of nodes up to there."""
    own = nodes.select("tree", "node", "parent", F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("steps"))
    known = own.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    linked = own.join(known, ["tree", "parent"], "left")
    state = linked.select("tree", "node", F.when(F.col("known") & (F.col("parent") != F.col("node")), F.col("parent")).alias("up"), "total", "steps")
    state = materialise(state, "climb")
    most, pointers = state.count(), []
    while 2 ** len(pointers) <= most:
        open_ = state.filter("up is not null")
        if open_.isEmpty():
            break
        pointers.append(open_.select("tree", "node", "up"))
        ahead = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("t"), F.col("steps").alias("s"))
        moved = open_.join(ahead, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("t")).alias("total"), (F.col("steps") + F.col("s")).alias("steps"))
        state = materialise(moved.unionByName(state.filter("up is null")), "climb")
    return pointers, state.filter("up is null").select("tree", "node", "total", "steps")


def best_branches(nodes: DataFrame, k: int = 1) -> DataFrame:
    """Rows (conv_id, leaf_id, rank, score, back, node_id): the nodes of the `k` best paths of each tree, `back` steps above the leaf.

    Nodes are rows (conv_id, node_id, parent_id, score). A path's score is the
    mean score of its nodes (null and NaN count 0); of equal ones the smaller
    leaf goes first. A node whose parent is null, itself or not in the tree is a
    root; of rows with one id in a tree one with the smallest parent counts.
    Nodes that lie on a circle, or under one, have no root and so no path. Rows
    without a node_id are left out; a null conv_id is a tree of its own.
    """
    keyed = nodes.filter(F.col("node_id").isNotNull()).select(F.struct("conv_id").alias("tree"), F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), "score")
    one = keyed.groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("n")).select("tree", "node", "n.parent", "n.score")
    one = materialise(one, "nodes")
    pointers, roads = climb(one)
    answered = one.filter(F.col("parent") != F.col("node")).select("tree", F.col("parent").alias("node")).distinct()
    leaves = roads.join(answered, ["tree", "node"], "left_anti").select("tree", "node", (F.col("total") / F.col("steps")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    chosen = leaves.withColumn("rank", rank).filter(F.col("rank") <= k)
    paths = chosen.select("tree", F.col("node").alias("leaf"), "rank", "score", F.lit(0).cast("long").alias("back"), "node")
    for i in reversed(range(len(pointers))):
        paths = materialise(paths, "paths")
        above = paths.join(pointers[i], ["tree", "node"]).select("tree", "leaf", "rank", "score", (F.col("back") + 2**i).alias("back"), F.col("up").alias("node"))
        paths = paths.unionByName(above)
    return paths.select("tree.conv_id", F.col("leaf").alias("leaf_id"), "rank", "score", "back", F.col("node").alias("node_id"))


def format_branches(nodes: DataFrame, branches: DataFrame, learn: str = "assistant") -> DataFrame:
    """Rows (conv_id, leaf_id, rank, score, formatted, loss): each path as one conversation.

    A turn is `<|turn|>`, the role, a newline, the text and `<|end|>` with a
    newline; control strings inside roles and texts are escaped, so that
    `read_turns` gives back what went in. `loss` lists (start, length) in code
    points of the texts of role `learn`. Null roles and texts count as empty. Of
    rows with one id in a tree the one chosen by `best_branches` is formatted,
    and of several such the first by role and text.
    """
    said = nodes.filter(F.col("node_id").isNotNull()).select(F.struct("conv_id").alias("tree"), F.col("node_id").alias("node"), F.struct("parent_id", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
    said = said.groupBy("tree", "node").agg(F.min("said").alias("said"))
    rows = branches.withColumnsRenamed({"leaf_id": "leaf", "node_id": "node"}).withColumn("tree", F.struct("conv_id")).join(said, ["tree", "node"])
    head = F.concat(F.lit(OPEN), role_line(F.col("said.role")), F.lit("\n"))
    rows = rows.select("tree", "leaf", "rank", "score", "back", (F.col("said.role") == learn).alias("learn"), head.alias("head"), escape(F.col("said.text")).alias("body"))
    rows = rows.withColumn("turn", F.concat("head", "body", F.lit(CLOSE)))
    before = F.sum(F.length("turn").cast("long")).over(Window.partitionBy("tree", "leaf").orderBy(F.desc("back"))) - F.length("turn")
    rows = rows.withColumn("mask", F.when(F.col("learn"), F.struct((before + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "turn", "mask")))
    whole = rows.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), turns.alias("turns"))
    masks = F.filter(F.transform("turns", lambda t: t["mask"]), lambda m: m.isNotNull())
    return whole.select("tree.conv_id", F.col("leaf").alias("leaf_id"), "rank", "score", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), masks.alias("loss"))


def reply_conversations(nodes: DataFrame, k: int = 1, learn: str = "assistant") -> DataFrame:
    """The `k` best paths of each tree, each formatted as one conversation; see `best_branches` and `format_branches`.

    An empty table gives no rows; columns other than conv_id, node_id, parent_id,
    role, text and score are not read. A path is one value, so its texts meet in
    one task; nothing else of a tree does.
    """
    nodes = materialise(nodes.select("conv_id", "node_id", "parent_id", "role", "text", "score"), "tree")
    return format_branches(nodes, best_branches(nodes, k), learn)
