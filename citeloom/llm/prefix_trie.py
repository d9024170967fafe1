"""Prefix trie of conversations: z-fast tries over ranges of sorted conversations, merged into one tree of turn prefixes.

A turn is a symbol, the digest of its role and text. A polynomial hash of the first d symbols, modulo 2^61 - 1 and with two bases,
names the node at depth d; prefix hashes are sums, so segments of a conversation are hashed apart and added up.

Sorted conversations are dealt out by ranges. A task inserts its conversations, batch by batch, into a z-fast trie: a
compacted node, which stands for the depths above its parent's up to its own, is kept in a hash table under the prefix of its
two-fattest depth (the depth in that interval with the most trailing zero bits). Fat binary search over these handles finds the
exit node of a conversation in a logarithmic number of look-ups; the strings of a batch that leave at one node are inserted one
after the other from there. Full tries are emptied: their compacted edges are expanded into one row per depth with the number and
the smallest of the conversations that pass. Spark adds the rows of all tries per node, so a hot first turn is one row per
trie, and neither ranges nor batches change a result.

The smallest member of a node owns it; a conversation owns a run of depths down to its end. Sums over subtrees are therefore
sums over members: a member adds the words of its turns above its own run (others own them too), and one leaf if the end of its
run has no child. Ids that end at a node are sorted by ranges, joined into long pieces and then hashed in order.

Conversations are cut into segments of ``SEGMENT`` turns, which hang below the node of the turns before them, so no row holds a
whole long conversation; turns are numbered by ranges of the sorted table, so one conversation may hold most of it.

Edge cases: rows without an id belong to no conversation and are left out. Null roles and texts are empty. Turns with one
number, or without one, are ordered by the digest of their role and text; repeated rows are turns of their own. A rebuilt
conversation without turns is a member of the root. Very long texts are read once, for their digest and their words. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.session import materialize

SEGMENT = 1024
TRIE_TURNS = 200_000  # of the conversations in one trie, which bounds a task's memory
PIECE_IDS = 10_000
PRIME = 2**61 - 1
BASES = (1_000_000_007 * 998_244_353 % PRIME, 87_178_291_199 * 479_001_599 % PRIME)
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "k1", "k2"]


# --- z-fast trie -------------------------------------------------------------------------------------------------


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the largest power of two."""
    return high & -1 << (low ^ high).bit_length() - 1


class Node:
    """A compacted node: depths above ``low`` up to ``high`` of the string ``path`` (its prefix hashes)."""

    __slots__ = ("children", "ending", "high", "least", "low", "passing", "path", "words")

    def __init__(self, low: int, high: int, path: list[int], words: list[int]):
        self.low, self.high, self.path, self.words = low, high, path, words
        self.children: dict[int, Node] = {}  # by the prefix hash one symbol below
        self.ending, self.passing, self.least = 0, 0, None


class ZFastTrie:
    """Strings are lists of prefix hashes; the first entry is that of the place where the trie hangs."""

    def __init__(self, top: int):
        self.root = Node(-1, 0, [top], [0])
        self.handles: dict[tuple[int, int], Node] = {}

    def _enter(self, node: Node) -> None:
        depth = two_fattest(node.low, node.high)
        self.handles[depth, node.path[depth]] = node

    def _leave(self, node: Node) -> None:
        depth = two_fattest(node.low, node.high)
        del self.handles[depth, node.path[depth]]

    def locate(self, path: list[int], start: Node) -> Node:
        """The deepest node whose whole string begins ``path``, by fat binary search below ``start``."""
        found, low, high = start, start.high, len(path) - 1
        while low < high:
            depth = two_fattest(low, high)
            node = self.handles.get((depth, path[depth]))
            if node is None:
                high = depth - 1
            elif node.high < len(path) and node.path[node.high] == path[node.high]:
                found, low = node, node.high
            else:  # the string leaves within the edge of this node
                high = depth - 1
        return found

    def insert(self, path: list[int], words: list[int], conv: int, n: int, start: Node) -> None:
        at, end = self.locate(path, start), len(path) - 1
        if at.high < end:
            key = path[at.high + 1]
            child = at.children.get(key)
            if child is not None:
                low, high = at.high + 1, min(end, child.high)  # the two agree up to low
                while low < high:
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if child.path[middle] == path[middle] else (low, middle - 1)
                self._leave(child)
                upper = Node(at.high, low, child.path, child.words)
                child.low = low
                upper.children[child.path[low + 1]] = child
                at.children[key] = upper
                self._enter(upper)
                self._enter(child)
                at = upper
            if at.high < end:
                leaf = Node(at.high, end, path, words)
                at.children[path[at.high + 1]] = leaf
                self._enter(leaf)
                at = leaf
        at.ending += n
        at.least = conv if at.least is None else min(at.least, conv)

    def insert_batch(self, strings: list[tuple[list[int], list[int], int, int]]) -> None:
        """(path, words, smallest conversation, number). Exit nodes are located first; then the strings of a node follow each other."""
        groups: dict[int, list] = {}
        for string in strings:
            node = self.locate(string[0], self.root)
            groups.setdefault(id(node), [node]).append(string)
        for node, *own in groups.values():
            for path, words, conv, n in own:
                self.insert(path, words, conv, n, node)

    def nodes(self) -> list[Node]:
        """All nodes, children after their parents, with the strings that pass through them counted."""
        order = [self.root]
        for node in order:
            order.extend(node.children.values())
        for node in reversed(order):
            node.passing = node.ending + sum(c.passing for c in node.children.values())
            least = [x for x in (node.least, *(c.least for c in node.children.values())) if x is not None]
            node.least = min(least, default=None)
        return order


def _split(key: int) -> tuple[int, int]:
    return key >> 61, key & PRIME


def _paths(entry: int, start: int, d1, d2) -> list[int]:
    """Prefix hashes of a segment, as one number each."""
    a, b = _split(entry)
    p, q = pow(BASES[0], start, PRIME), pow(BASES[1], start, PRIME)
    out = [entry]
    for x, y in zip(d1, d2, strict=True):
        a, b = (a + x * p) % PRIME, (b + y * q) % PRIME
        p, q = p * BASES[0] % PRIME, q * BASES[1] % PRIME
        out.append(a << 61 | b)
    return out


# --- rebuilt conversations ---------------------------------------------------------------------------------------


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, digest, words) with their rank in the conversation, numbered by ranges of the sorted table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for frame in frames:
            place = frame.groupby("conv", sort=False).cumcount().to_numpy() + 1
            if last is not None and len(frame):
                place[frame["conv"].to_numpy() == last] += n
            if len(frame):
                last = frame["conv"].iloc[-1]
                n = int(place[-1])
            yield frame.assign(part=part, place=place)

    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "words")
    local = materialize(ranged.mapInPandas(run, "conv long, digest string, words long, part int, place long"), "trie-turns")
    # A conversation that goes on in a later range: one row per range and conversation, of which few have a part before them.
    counts = local.groupBy("conv", "part").agg(F.max("place").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("conv", "part", before.alias("before")).where("before is not null")
    return local.join(offsets, ["conv", "part"], "left").select(
        "conv", "digest", "words", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place")
    )


def heads_kept(conv: Column) -> Column:
    """How many first turns a conversation takes from its base: unsigned CRC-32 of its decimal id modulo 4."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def segments(conversations: DataFrame, id_col: str, turn: str, role: str, text: str) -> DataFrame:
    """Rebuilt conversations in segments: (conv, start, e1, e2, before, total, d1, d2, words, n, end1, end2, is_last).

    ``place`` has a gap where the base is shorter than the first turns that it should give; ``start`` counts without gaps.
    """
    role_text = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.sha2(F.concat(F.length(role_text[0]).cast("string"), F.lit(":"), *role_text), 256).alias("digest"),
        F.regexp_count(role_text[1], F.lit(WORD)).cast("long").alias("words"),
    )
    numbered = materialize(numbered_turns(turns), "trie-numbered")
    symbol = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    row = ["conv", "place", symbol(1).alias("d1"), symbol(17).alias("d2"), "words"]
    own = numbered.where(F.col("place") > heads_kept(F.col("conv"))).select(*row)
    marks = numbered.where("place = 1").select(
        "conv", F.lit(0).cast("long").alias("place"), *[F.lit(None).cast("long").alias(c) for c in ("d1", "d2", "words")]
    )
    asked = marks.select("conv", (F.col("conv") - F.col("conv") % 20).alias("base"), heads_kept(F.col("conv")).alias("h"))
    bases = numbered.where((F.col("conv") % 20 == 0) & (F.col("place") <= 3)).withColumnRenamed("conv", "base")
    heads = asked.join(bases, "base").where("place <= h").select(*row)
    rebuilt = own.unionByName(heads).unionByName(marks)

    number = F.floor(F.greatest(F.col("place") - 1, F.lit(0)) / SEGMENT).alias("number")
    turn_row = F.when(F.col("place") > 0, F.struct("place", "d1", "d2", "words"))
    cut = rebuilt.groupBy("conv", number).agg(F.sort_array(F.collect_list(turn_row)).alias("t"))
    in_order = W.partitionBy("conv").orderBy("number")
    earlier = in_order.rowsBetween(W.unboundedPreceding, -1)
    cut = cut.select(
        "conv", "number", F.col("t.d1").alias("d1"), F.col("t.d2").alias("d2"), F.col("t.words").alias("words"), F.size("t").alias("n"),
        F.coalesce(F.sum(F.size("t")).over(earlier), F.lit(0)).alias("start"),
    )

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = [_split(_paths(0, start, d1, d2)[-1]) for start, d1, d2 in zip(frame["start"], _lists(frame["d1"]), _lists(frame["d2"]), strict=True)]
            yield frame.assign(v1=[s[0] for s in sums], v2=[s[1] for s in sums])

    schema = "conv long, number long, d1 array<long>, d2 array<long>, words array<long>, n int, start long"
    summed = cut.mapInPandas(add, f"{schema}, v1 long, v2 long")
    in_all = F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b)
    modulo = lambda c: F.pmod(c, F.lit(PRIME).cast("decimal(20,0)")).cast("long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    so_far = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = summed.withColumn("w", in_all).select(
        "conv", "start", "d1", "d2", "words", "n",
        *[F.coalesce(modulo(exact(f"v{i}").over(earlier)), F.lit(0)).alias(f"e{i}") for i in (1, 2)],
        *[modulo(exact(f"v{i}").over(so_far)).alias(f"end{i}") for i in (1, 2)],
        F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("before"),
        F.sum("w").over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
        F.lead("number").over(in_order).isNull().alias("is_last"),
    )
    return materialize(placed, "trie-segments")


def _lists(column: pd.Series) -> list[list[int]]:
    return [v.tolist() for v in column]


# --- nodes -------------------------------------------------------------------------------------------------------


def partial_nodes(cut: DataFrame, trie_turns: int = TRIE_TURNS) -> DataFrame:
    """(depth, k1, k2, p1, p2, words, cum, least, n): the expanded nodes of all tries; p is the node above, cum the words down to it."""

    def expanded(start: int, trie: ZFastTrie, before: int) -> Iterator[tuple]:
        reached = {}  # words of the prefix at the end of each compacted node
        for node in trie.nodes():
            if node.low < 0:
                reached[id(node)] = before
                if start == 0:
                    yield (0, 0, 0, 0, 0, 0, 0, node.least, node.passing)
            else:
                total = 0
                for depth in range(node.low + 1, node.high + 1):
                    total += node.words[depth - 1]
                above = reached.pop((id(node), "above"))
                reached[id(node)] = above + total
                for depth in range(node.low + 1, node.high + 1):
                    above += node.words[depth - 1]
                    yield (start + depth, *_split(node.path[depth]), *_split(node.path[depth - 1]), node.words[depth - 1], above, node.least, node.passing)
            for child in node.children.values():
                reached[id(child), "above"] = reached[id(node)]

    names = ["depth", "k1", "k2", "p1", "p2", "words", "cum", "least", "n"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries: dict[tuple[int, int], tuple[ZFastTrie, int]] = {}
        held = 0

        def flush() -> Iterator[pd.DataFrame]:
            rows = [row for (start, _), (trie, before) in tries.items() for row in expanded(start, trie, before)]
            tries.clear()
            for at in range(0, len(rows), 50_000):
                yield pd.DataFrame(rows[at : at + 50_000], columns=names)

        for frame in frames:
            batches: dict[tuple[int, int], dict] = {}
            columns = (frame["start"], frame["e1"], frame["e2"], frame["before"], _lists(frame["d1"]), _lists(frame["d2"]), _lists(frame["words"]), frame["conv"])
            for start, e1, e2, before, d1, d2, words, conv in zip(*columns, strict=True):
                path = _paths(e1 << 61 | e2, start, d1, d2)
                batch = batches.setdefault((start, path[0]), {"before": before, "strings": {}})
                known = batch["strings"].setdefault((len(path), path[-1]), [path, words, conv, 0])
                known[2], known[3] = min(known[2], conv), known[3] + 1
            for (start, entry), batch in batches.items():
                trie, _ = tries.setdefault((start, entry), (ZFastTrie(entry), batch["before"]))
                strings = list(batch["strings"].values())
                trie.insert_batch(strings)
                held += sum(len(s[0]) for s in strings)
            if held >= trie_turns:
                yield from flush()
                held = 0
        yield from flush()

    sorted_by = ["start", "e1", "e2", "d1", "d2", "conv"]
    # A few turns and the id deal out the ranges, so that the sample of keys that Spark takes stays small.
    ranges = ["start", "e1", "e2", F.slice("d1", 1, 8), "conv"]
    rows = cut.select(*sorted_by, "before", "words").repartitionByRange(*ranges).sortWithinPartitions(*sorted_by)
    return rows.mapInPandas(run, "depth long, k1 long, k2 long, p1 long, p2 long, words long, cum long, least long, n long")


def member_sums(cut: DataFrame, owners: DataFrame) -> DataFrame:
    """(depth, k1, k2, saved, leaves) of the members of nodes, added up within each batch.

    ``owners``: conv, the depth from which it owns its nodes, the words of its prefix above that depth, whether its end has no child.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums: dict[tuple[int, int], list[int]] = {}
            columns = (frame["start"], frame["e1"], frame["e2"], _lists(frame["d1"]), _lists(frame["d2"]), _lists(frame["words"]), frame["before"], frame["own"], frame["above"], frame["leaf"])
            for start, e1, e2, d1, d2, words, before, own, above, leaf in zip(*columns, strict=True):
                path = _paths(e1 << 61 | e2, start, d1, d2)
                for at in range(0 if start == 0 else 1, len(path)):
                    depth = start + at
                    if depth >= own and not leaf:
                        break
                    if at > 1:
                        before += words[at - 2]  # now the words of the prefix one turn above
                    held = sums.setdefault((depth, path[at]), [0, 0])
                    held[0] += above - before if depth < own else 0
                    held[1] += leaf
            yield pd.DataFrame([(d, *_split(k), *v) for (d, k), v in sums.items()], columns=[*NODE, "saved", "leaves"]).astype("int64")

    joined = cut.join(owners, "conv", "left").select(
        "start", "e1", "e2", "d1", "d2", "words", "before",
        F.coalesce("own", F.lit(2**62)).alias("own"), F.coalesce("above", "total").alias("above"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    summed = joined.mapInPandas(run, "depth long, k1 long, k2 long, saved long, leaves long")
    return summed.groupBy(*NODE).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def _streamed(start: Callable, add: Callable, close: Callable, names: list[str]):
    """One row per run of equal nodes in a sorted stream."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for frame in frames:
            rows = []
            for depth, k1, k2, value in zip(frame["depth"], frame["k1"], frame["k2"], frame["value"], strict=True):
                if node != (depth, k1, k2):
                    if node is not None and (rest := close(state)) is not None:
                        rows.append((*node, *rest))
                    node, state = (depth, k1, k2), start()
                full = add(state, value)
                if full is not None:
                    rows.append((*node, *full))
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if node is not None and (rest := close(state)) is not None:
            yield pd.DataFrame([(*node, *rest)], columns=names)

    return run


def ending_digests(cut: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """(depth, k1, k2, ends): SHA-256 of the sorted ids that end at a node. Pieces of many ids leave the sort, so that the one
    task that a node's digest needs reads few rows, in order and one by one."""

    def close_piece(ids: list[int]) -> tuple | None:
        return (ids[0], ",".join(map(str, ids))) if ids else None

    def add_id(ids: list[int], conv: int) -> tuple | None:
        ids.append(conv)
        if len(ids) < piece_ids:
            return None
        piece = close_piece(ids)
        ids.clear()
        return piece

    def add_piece(state: list, text: str) -> None:
        state[0].update((b"," if state[1] else b"") + text.encode())
        state[1] = True

    ends = cut.where("is_last").select((F.col("start") + F.col("n")).alias("depth"), F.col("end1").alias("k1"), F.col("end2").alias("k2"), F.col("conv").alias("value"))
    in_order = [*NODE, "value"]
    ends = ends.repartitionByRange(*in_order).sortWithinPartitions(*in_order)
    pieces = ends.mapInPandas(
        _streamed(list, add_id, close_piece, [*NODE, "first", "value"]), "depth long, k1 long, k2 long, first long, value string"
    )
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    hashed = _streamed(lambda: [hashlib.sha256(), False], add_piece, lambda state: (state[0].hexdigest(),), [*NODE, "ends"])
    return pieces.mapInPandas(hashed, "depth long, k1 long, k2 long, ends string")


def conversation_trie(
    conversations: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, words, k1, k2)."""
    cut = segments(conversations, id_col, turn, role, text)
    merged = partial_nodes(cut).groupBy(*NODE).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"), F.min("cum").alias("cum"),
        F.min("least").alias("conv"), F.sum("n").alias("n"),
    )
    nodes = materialize(merged, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("children")
    )
    nodes = materialize(nodes.join(children, NODE, "left").fillna(0, ["children"]), "trie-tree")
    owners = nodes.groupBy("conv").agg(
        F.min("depth").alias("own"), F.min_by(F.col("cum") - F.col("words"), "depth").alias("above"),
        F.max((F.col("children") == 0).cast("long")).alias("leaf"),
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    found = (
        nodes.join(member_sums(cut, owners), NODE, "left").join(ending_digests(cut), NODE, "left")
        .join(parents, ["depth", "p1", "p2"], "left")
    )
    return found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.coalesce("leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "words", "k1", "k2",
    )
