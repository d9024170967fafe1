"""Chat formatting over reply trees.

Messages point at the message they answer. Pointer-doubling self-joins (round k reaches the ancestor 2^k steps up) give
every message its root, depth and path score; leaves are the ends of branches and are ranked per tree by the score of
their path. A second series of joins, over the same pointers, lists the messages of each chosen path, and each path is
formatted as one conversation. The joins carry ids only; texts join once, when the paths are known.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts a backslash becomes two and ``<|``
becomes ``<\\|``, so no control string can come from a text; a line break in a role becomes ``<|nl|>``. The loss mask is
a list of (start, length) spans in code points: the escaped texts of assistant turns.

Edge cases: a null text or role is empty. An answer to a missing message starts a tree of its own. Messages in a cycle
have no root and are left out. Rows with a null conversation id are one conversation, with a null id. Ties of path scores go to the smaller leaf id. Rows of one conversation with equal
turns follow each other in the order of role and text, so repeated rows are repeated turns. An empty table gives no
rows; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.llm.common import small_batches
from citeloom.session import materialize

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _key(tree: str = "tree") -> Column:
    """A tree as a join key that is never null."""
    return F.struct(F.col(tree).isNull().alias("none"), F.col(tree).alias("id")).alias("tree")


def linear_tree(messages: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(tree, node, parent, score, role, text): each row answers the row before it."""
    order = W.partitionBy(tree).orderBy(turn, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    node = F.row_number().over(order).cast("long")
    return messages.select(
        F.col(tree).alias("tree"), node.alias("node"), F.lit(0.0).alias("score"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def chosen_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, up, node) of the ``branches`` best root-to-leaf paths of each tree (all if None).

    ``nodes``: tree, node, parent, score; (tree, node) is unique. ``up`` counts steps from the leaf. The number of
    rounds is the logarithm of the depth.
    """
    base = materialize(nodes.select(_key(), "node", "parent", F.col("score").cast("double").alias("score")), "chat-nodes")
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("__known"))
    jump = materialize(
        base.join(known, ["tree", "parent"], "left").select(
            "tree", "node", F.when(F.col("__known"), F.col("parent")).alias("anc"), F.lit(1).cast("long").alias("depth"),
            F.col("score").alias("total"),  # depth and total cover the nodes from node up to, but not, anc
        ), "chat-jump-0",
    )
    # A node whose ancestor is null has reached its root; only the others go on.
    largest = base.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    rooted, levels = jump.where("anc is null"), [jump.where("anc is not null")]
    while 2 ** (len(levels) - 1) <= largest and not levels[-1].isEmpty():
        above = levels[-1].unionByName(rooted).select(
            "tree", F.col("node").alias("anc"), F.col("anc").alias("__anc"), F.col("depth").alias("__depth"),
            F.col("total").alias("__total"),
        )
        jump = materialize(
            levels[-1].join(above, ["tree", "anc"]).select(
                "tree", "node", F.col("__anc").alias("anc"), (F.col("depth") + F.col("__depth")).alias("depth"),
                (F.col("total") + F.col("__total")).alias("total"),
            ), f"chat-jump-{len(levels)}",
        )
        rooted = rooted.unionByName(jump.where("anc is null"))
        levels.append(jump.where("anc is not null"))
    answered = base.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(answered, ["tree", "node"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), "node")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    path = ranked.select("tree", F.col("node").alias("leaf"), "rank", F.lit(0).cast("long").alias("up"), "node")
    for k, level in enumerate(levels[:-1]):  # after round k the paths reach 2^(k+1) messages up
        step = level.select("tree", "node", "anc")
        higher = path.join(step, ["tree", "node"]).select(
            "tree", "leaf", "rank", (F.col("up") + F.lit(2**k)).alias("up"), F.col("anc").alias("node")
        )
        path = materialize(path.unionByName(higher), f"chat-path-{k}")
    return path.withColumn("tree", F.col("tree.id"))


def format_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans) of every path."""
    placed_at = paths.select(_key(), "leaf", "rank", "up", "node")
    turns = placed_at.join(nodes.select(_key(), "node", "role", "text"), ["tree", "node"]).select(
        F.col("tree.id").alias("tree"), "leaf", "rank", "up", F.col("role"),
        F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK)), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    piece = F.concat("head", "body", F.lit(END + "\n"))
    before = W.partitionBy("tree", "leaf", "rank").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    placed = turns.withColumn("piece", piece).withColumn(
        "span", F.struct(start.alias("start"), F.length("body").cast("long").alias("length"))
    )
    ordered = F.array_sort(F.collect_list(F.struct(
        (-F.col("up")).alias("at"), "piece", (F.col("role") == "assistant").alias("learn"), "span",
    )))
    return placed.groupBy("tree", "leaf", "rank").agg(ordered.alias("turns")).select(
        "tree", "leaf", "rank", F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["span"]).alias("loss_spans"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape(role.replace(BREAK, "\n")), unescape(rest[: -len(END) - 1])))
    return turns


def masked_text(formatted: str, spans) -> str:
    return "".join(unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in spans)


DIGESTS = (
    "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of what a reader of the formatted conversations gets."""

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for tree, formatted, spans in zip(frame["tree"], frame["formatted"], frame["loss_spans"], strict=True):
                turns, loss = parse(formatted), masked_text(formatted, spans)
                joined = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((
                    tree, len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(formatted),
                ))
            yield pd.DataFrame(rows, columns=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    small_batches(conversations.sparkSession, 500)
    # As text, because pandas would turn integers beside a null into floating-point numbers.
    given = conversations.select(F.col("tree").cast("string").alias("tree"), "formatted", "loss_spans")
    return given.mapInPandas(digests, DIGESTS).withColumn("tree", F.col("tree").cast(conversations.schema["tree"].dataType))
