"""Conversation prefix trie: a z-fast trie in each task gathers what conversations share, and tasks' tries are merged by node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import arrow_schema, written

#: Original turns that a conversation may take over at most, and conversations of one series.
MOST_SHARED, SERIES = 5, 100
#: Turns of one stretch of a conversation, turns in a task's trie from which it is sent on, and ids of one piece of a list of ids.
STRETCH, TRIE_TURNS, LIST_IDS = 1024, 200_000, 20_000
_MASK = (1 << 63) - 1


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Path:
    """A stretch of a conversation: keys of its prefixes at ``top``, ``top`` + 1 and so on, code points of all turns up to there, and of each turn."""

    __slots__ = ("top", "end", "keys", "lengths", "reach")

    def __init__(self, top: int, keys: list[int], lengths: list[int], reach: list[int]):
        self.top, self.end, self.keys, self.lengths, self.reach = top, top + len(keys) - 1, keys, lengths, reach

    def key(self, depth: int) -> int:
        return self.keys[depth - self.top]


class Node:
    """A compacted node: its edge covers the depths (top, end] of ``path``; ``sums`` are of the conversations that end on it."""

    __slots__ = ("top", "end", "path", "parent", "children", "sums")

    def __init__(self, top: int, end: int, path: Path, parent: Node | None):
        self.top, self.end, self.path, self.parent, self.children, self.sums = top, end, path, parent, {}, None

    def add(self, sums: tuple) -> None:
        self.sums = sums if self.sums is None else combined(self.sums, sums)


def combined(a: tuple, b: tuple) -> tuple:
    """Sums of two sets of conversations: their number, the smallest, and two weights."""
    return a[0] + b[0], min(a[1], b[1]), a[2] + b[2], a[3] + b[3]


class ZFastTrie:
    """Compacted nodes in a table by handle: the prefix of a node at the two-fattest depth of its edge. Stretches that begin deeper have roots of their own."""

    def __init__(self):
        self.roots: dict[tuple[int, int], Node] = {}
        self.handles: dict[tuple[int, int], Node] = {}
        self.turns = 0

    def _handle(self, node: Node) -> tuple[int, int]:
        f = two_fattest(node.top, node.end)
        return f, node.path.key(f)

    def exit(self, path: Path) -> Node:
        """The deepest node whose edge the path enters, by binary search over handles."""
        node = self.roots.get((path.top, path.keys[0]))
        if node is None:
            node = self.roots[path.top, path.keys[0]] = Node(path.top, path.top, path, None)
        low, high = path.top, path.end
        while low < high:
            f = two_fattest(low, high)
            found = self.handles.get((f, path.key(f)))
            if found is None:
                high = f - 1
            elif found.end <= path.end and path.key(found.end) == found.path.key(found.end):
                node, low = found, found.end
            else:
                return found
        return node.children.get(path.key(node.end + 1), node) if node.end < path.end else node

    def insert(self, batch: dict[tuple[int, int, int], tuple[Path, tuple]]) -> None:
        """Adds distinct paths with their sums."""
        for path, sums in batch.values():
            node = self.exit(path)
            low, high = node.top, min(node.end, path.end)
            while low < high:  # the deepest prefix that path and edge share
                middle = (low + high + 1) // 2
                low, high = (middle, high) if path.key(middle) == node.path.key(middle) else (low, middle - 1)
            if low < node.end:
                node = self._split(node, low)
            if low == path.end:
                node.add(sums)
                continue
            leaf = Node(low, path.end, path, node)
            leaf.add(sums)
            node.children[path.key(low + 1)] = leaf
            self.handles[self._handle(leaf)] = leaf
            self.turns += path.end - low

    def _split(self, node: Node, at: int) -> Node:
        upper = Node(node.top, at, node.path, node.parent)
        del self.handles[self._handle(node)]
        node.parent.children[node.path.key(node.top + 1)] = upper
        node.top, node.parent = at, upper
        upper.children[node.path.key(at + 1)] = node
        for x in (upper, node):
            self.handles[self._handle(x)] = x
        return upper

    def expanded(self) -> Iterator[tuple]:
        """Every depth of every edge: ``(depth, key, key above, turn's length, length so far, sums of all conversations through it)``."""
        order = list(self.roots.values())
        for node in order:
            order += node.children.values()
        for node in reversed(order):
            for child in node.children.values():
                node.add(child.sums)
            path = node.path
            for depth in range(node.top + 1, node.end + 1):
                i = depth - path.top
                yield depth, path.keys[i], path.keys[i - 1], path.lengths[i - 1], path.reach[i], node.sums


_NODES = "depth long, k1 long, k2 long, u1 long, u2 long, size long, reach long, n long, least long, w1 long, w2 long"


def tries(stretches: DataFrame) -> DataFrame:
    """Nodes of depth 1 and more with sums over the conversations through them, a row for each trie that has them.

    ``stretches``: ``conv_id, block, p1, p2, reach, turns array<struct<depth,g1,g2,size>>, w1, w2``. A task inserts its conversations batch by
    batch and sends its trie on when it is full, so hot prefixes are a row per trie, and memory is bounded.
    """
    struct = T._parse_datatype_string(_NODES)
    schema = arrow_schema(struct)

    def rows(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = zip(*((d, k >> 63, k & _MASK, u >> 63, u & _MASK, size, reach, *sums) for d, k, u, size, reach, sums in held))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

        for x in trie.expanded():
            held.append(x)
            if len(held) == 10_000:
                yield made()
                held = []
        if held:
            yield made()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in source:
            distinct: dict[tuple[int, int, int], tuple[Path, tuple]] = {}
            plain = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name != "turns"}
            turns = batch.column(batch.schema.names.index("turns"))
            ends, flat = turns.offsets.to_numpy(), turns.values
            g1, g2, size = (flat.field(name).to_numpy() for name in ("g1", "g2", "size"))
            for i, (conv, block, p1, p2, reach, w1, w2) in enumerate(zip(*(plain[c] for c in ("conv_id", "block", "p1", "p2", "reach", "w1", "w2")))):
                mine = slice(ends[i], ends[i + 1])
                one, two = (((np.cumsum(g[mine].view(np.uint64)) + np.uint64(p)) & np.uint64(_MASK)).tolist() for g, p in ((g1, p1), (g2, p2)))
                keys = [p1 << 63 | p2, *(a << 63 | b for a, b in zip(one, two))]
                path = Path(block * STRETCH, keys, size[mine].tolist(), [reach, *(np.cumsum(size[mine]) + reach).tolist()])
                sums, name = (1, conv, w1, w2), (path.top, path.end, keys[-1])
                same = distinct.get(name)
                distinct[name] = (path, sums) if same is None else (same[0], combined(same[1], sums))
            trie.insert(distinct)
            if trie.turns >= TRIE_TURNS:
                yield from rows(trie)
                trie = ZFastTrie()
        yield from rows(trie)

    return stretches.select("conv_id", "block", "p1", "p2", "reach", "turns", "w1", "w2").mapInArrow(run, struct)


def ordered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, rank, h1, h2, size``: turns numbered from 1 in each conversation, by turn (null first), then role and text.

    Rows are sorted by ranges, so even a conversation of very many turns is dealt to many tasks; each of those continues at most one
    conversation from those before, so there is at most one offset a task, which is broadcast.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    hashes = [F.xxhash64(F.lit(seed), "role", "text").alias(f"h{seed}") for seed in (1, 2)]
    rows = rows.select(F.spark_partition_id().alias("part"), "conv_id", *hashes, F.length("text").cast("long").alias("size"))
    struct = T.StructType([*rows.schema.fields, T.StructField("rank", T.LongType())])
    schema = arrow_schema(struct)

    def numbered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in source:
            ids = batch.column(1).to_numpy()
            if not len(ids):
                continue
            first = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
            at = np.arange(len(ids))
            start = np.maximum.accumulate(np.where(first, at, -1))
            rank = np.where(start < 0, at + n + 1, at - start + 1)
            last, n = ids[-1], int(rank[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, type=pa.int64())], schema=schema)

    rows = written(rows.mapInArrow(numbered, struct), "turns")
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    moved = sizes.withColumn("moved", before).where("moved IS NOT NULL").select("conv_id", "part", "moved")
    return rows.join(F.broadcast(moved), ["conv_id", "part"], "left").select("conv_id", (F.col("rank") + F.coalesce("moved", F.lit(0))).alias("rank"), "h1", "h2", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, g1, g2, size`` of the rebuilt conversations' turns, and ``conv_id`` of all conversations.

    A conversation c takes over the first crc32(c) % 6 turns of c - c % 100 in the place of its own. ``g1`` and ``g2`` are hashes of a turn at its depth;
    prefixes are told apart by their sums.
    """
    shared = F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"shared": shared, "base": F.col("conv_id") - F.col("conv_id") % SERIES})
    bases = sizes.where(F.col("conv_id") % SERIES == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    known = sizes.hint("merge").join(bases.hint("rebalance").hint("merge"), "base", "left").select("conv_id", "base", "shared", F.least("shared", F.coalesce("n_base", F.lit(0))).alias("taken"))
    known = written(known, "convs")
    first = turns.where((F.col("conv_id") % SERIES == 0) & (F.col("rank") <= MOST_SHARED)).withColumnRenamed("conv_id", "base")
    over = known.where("taken > 0").hint("merge").join(first.hint("merge"), "base").where("rank <= taken").select("conv_id", F.col("rank").alias("depth"), "h1", "h2", "size")
    own = turns.hint("merge").join(known.hint("rebalance").hint("merge"), "conv_id").where("rank > shared").select("conv_id", (F.col("rank") - F.col("shared") + F.col("taken")).alias("depth"), "h1", "h2", "size")
    placed = lambda h: F.xxhash64("depth", h).bitwiseAND(F.lit(_MASK))
    return over.unionByName(own).select("conv_id", "depth", placed("h1").alias("g1"), placed("h2").alias("g2"), "size"), known.select("conv_id")


def _wrapped(total):
    """A sum of hashes, without what exceeds 63 bits."""
    return (total % F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def stretched(turns: DataFrame) -> DataFrame:
    """Conversations in stretches of bounded length, with the keys and the length at which each begins, and sums over each."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(19,0)"))
    block = F.floor((F.col("depth") - 1) / STRETCH)
    held = turns.groupBy("conv_id", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "g1", "g2", "size"))).alias("turns"), _wrapped(wide("g1")).alias("t1"), _wrapped(wide("g2")).alias("t2"), F.sum("size").alias("total"), F.count("*").alias("n")
    )
    held = written(held, "stretches")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = held.where("n = %d OR block > 0" % STRETCH).select("conv_id", "block", *(_wrapped(F.sum(F.col(t).cast("decimal(19,0)")).over(before)).alias(p) for t, p in (("t1", "p1"), ("t2", "p2"))), F.sum("total").over(before).alias("reach"))
    zero = lambda c: F.lit(0).cast("long").alias(c)
    start = held.where("block = 0").select("*", zero("p1"), zero("p2"), zero("reach"))
    rest = held.where("block > 0").hint("merge").join(later.where("block > 0").hint("merge"), ["conv_id", "block"])
    return start.unionByName(rest)


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, sha``: hashes of the ids that end at each node, in ascending order.

    Ids are sorted by ranges; each range sends a node's ids on in a few long pieces, which are hashed in order as a stream, so neither memory nor
    the rows of a task grow with the conversations of one node.
    """
    struct = T._parse_datatype_string("depth long, k1 long, k2 long, part int, seq int, ids string")
    schema = arrow_schema(struct)

    def listed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[str]] = {}
        n, seq = 0, 0

        def made() -> pa.RecordBatch:
            rows = [(*key, seq, ",".join(ids)) for key, ids in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in source:
            for d, k1, k2, part, conv in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault((d, k1, k2, part), []).append(str(conv))
            n += batch.num_rows
            if n >= LIST_IDS:
                yield made()
                held, n, seq = {}, 0, seq + 1
        if held:
            yield made()

    order = ["depth", "k1", "k2", "part", "seq"]
    lists = ends.repartitionByRange("conv_id").sortWithinPartitions("conv_id").select("depth", "k1", "k2", F.spark_partition_id().alias("part"), "conv_id").mapInArrow(listed, struct)
    lists = lists.repartition("depth", "k1", "k2").sortWithinPartitions(*order)
    out = T._parse_datatype_string("depth long, k1 long, k2 long, sha string")
    out_schema = arrow_schema(out)

    def hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in source:
            done = []
            for d, k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5))):
                if (d, k1, k2) != last:
                    if last:
                        done.append((*last, state.hexdigest()))
                    last, state = (d, k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), out_schema)], schema=out_schema)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((*last, state.hexdigest()), out_schema)], schema=out_schema)

    return lists.mapInArrow(hashed, out)


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the rebuilt conversations' trie.

    A node is named by its smallest conversation and its depth. Each task keeps a z-fast trie of its conversations and expands its
    edges into nodes; equal nodes of several tasks are summed, first in the tasks. Sums over subtrees come from sums over members: a node
    counts for its smallest conversation alone, so each conversation brings the nodes, and the leaf, that are its own to all prefixes of it; a second
    pass of tries sums those. Nothing is done depth by depth.

    Rows without a conversation's id are left out; null roles and texts are empty; turns that are equal are ordered by role, then text, and repeated
    rows are turns of their own. A conversation without turns ends at the root. Prefixes are told apart by sums of two 63-bit hashes.
    Other columns aren't read; an empty table gives an empty result.
    """
    turns, convs = rebuilt(written(ordered(conversations, id_col, turn_col, role_col, text_col), "ranked"))
    stretches = written(stretched(turns), "paths")
    long_zero = F.lit(0).cast("long")
    totals = stretches.groupBy("conv_id").agg(*(_wrapped(F.sum(F.col(t).cast("decimal(19,0)"))).alias(k) for t, k in (("t1", "k1"), ("t2", "k2"))), F.sum("n").alias("depth"), F.sum("total").alias("total"))
    ends = convs.hint("merge").join(totals.hint("merge"), "conv_id", "left").select("conv_id", *(F.coalesce(c, long_zero).alias(c) for c in ("depth", "k1", "k2", "total")))
    ends = written(ends, "ends")
    key = ["depth", "k1", "k2"]

    def sums(weights: DataFrame) -> DataFrame:
        """Members' weights ``(conv_id, w1, w2)`` over all nodes."""
        found = tries(stretches.hint("merge").join(weights.hint("rebalance").hint("merge"), "conv_id"))
        each = found.groupBy(*key).agg(*(F.max(c).alias(c) for c in ("u1", "u2", "size", "reach")), F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("w1").alias("w1"), F.sum("w2").alias("w2"))
        root = weights.agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.sum("w1").alias("w1"), F.sum("w2").alias("w2")).where("n > 0")
        return each.unionByName(root.select(*(long_zero.alias(c) for c in key), *(F.lit(None).cast("long").alias(c) for c in ("u1", "u2")), long_zero.alias("size"), long_zero.alias("reach"), "n", "least", "w1", "w2"))

    nodes = written(sums(ends.select("conv_id", F.col("total").alias("w1"), long_zero.alias("w2"))), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.hint("merge").join(children.hint("merge"), key, "left").withColumn("n_children", F.coalesce("n_children", long_zero)), "families")
    own = nodes.groupBy(F.col("least").alias("conv_id")).agg(F.sum("size").alias("w1"), F.sum((F.col("n_children") == 0).cast("long")).alias("w2"))
    weights = ends.select("conv_id", "total").hint("merge").join(own.hint("merge"), "conv_id", "left").select("conv_id", "total", *(F.coalesce(w, long_zero).alias(w) for w in ("w1", "w2")))
    weights = written(weights, "weights")
    below = sums(weights.drop("total")).select(*key, F.col("w1").alias("own"), F.col("w2").alias("n_leaves"))
    joined = nodes.hint("merge").join(below.hint("merge"), key).hint("merge").join(ends_hashes(ends.select("conv_id", *key)).hint("merge"), key, "left")
    first = weights.select(F.col("conv_id").alias("least"), (F.col("total") - F.col("w1")).alias("apart"))
    joined = written(joined.hint("merge").join(first.hint("rebalance").hint("merge"), "least"), "joined")
    above = nodes.where("n_children > 0 AND depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("least").alias("above"))
    top = nodes.where("depth = 0").select(F.col("least").alias("top"))  # one row
    deep = joined.where("depth > 1").hint("merge").join(above.hint("rebalance").hint("merge"), ["depth", "u1", "u2"])
    shallow = joined.where("depth <= 1").join(F.broadcast(top)).withColumn("above", F.when(F.col("depth") == 1, F.col("top"))).drop("top")
    every = deep.unionByName(shallow)
    before = F.col("reach") - F.col("size")
    saved = F.col("w1") - F.col("n") * before - (F.col("own") + F.col("apart") - before)
    return every.select(
        F.col("least").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


#: The same in DuckDB: lists of turns, and all their prefixes.
SQL = r"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(0, 256) x(i)),
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM o), tab),
r AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN o ON o.conv_id = c.base WHERE pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id WHERE pos > h),
s AS (
  SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY part, pos) FILTER (WHERE role IS NOT NULL), []) AS turns
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, d, list_slice(turns, 1, d) AS prefix, len(turns) AS n FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM s)),
n AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends
  FROM p GROUP BY prefix, d),
k AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
a AS (
  SELECT list_slice(prefix, 1, up) AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(prefix[depth].t) ELSE 0 END) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN a USING (prefix) LEFT JOIN n u ON f.depth > 0 AND u.prefix = list_slice(f.prefix, 1, f.depth - 1)
"""
