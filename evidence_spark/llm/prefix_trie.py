"""The trie of conversations that begin alike, by a splitter-skeleton.

A conversation is a path: for each turn 16 bytes that stand for (role, text) and 4 for the
text's length, one after the other, so that the order of paths is an order of the trie's
leaves and a prefix of a path is a node. Paths are dealt to shards by splitters, which are
(path, conv_id) of sampled conversations; equal paths are told apart by conv_id, so a group of
copies spreads over as many shards as it fills. Only a prefix of a splitter can have members
in two shards: these nodes are the skeleton, whose trie is broadcast. Each sorted shard
finishes all other nodes in one pass and gives a partial aggregate for each skeleton node it
meets; those are added up, and what lies between skeleton nodes is completed on the skeleton.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_spark.session import scratch_table, shuffle_partitions

#: Bytes of a path per turn; bytes of paths for one shard; sampled conversations per shard.
TURN, SHARD_BYTES, SAMPLED = 20, 32 << 20, 8
#: Conversations whose ids travel as one piece of text, where a node's are in several shards.
PIECE = 512
SHARED_TURNS, GROUP = 9, 5

_PARTS = "kind int, node int, shard int, piece int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_FIELDS = pa.schema([(n.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[n.split()[1]]) for n in _PARTS.split(", ")])
_EMPTY = hashlib.sha256(b"").hexdigest()




def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path), one row for each conversation.

    Turns are ordered by turn (null first), then role and text; a null role or text is an empty
    one. Rows without a conv_id belong to no conversation and are left out. Texts are shuffled
    once, to find their order; what is gathered per conversation is 20 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.concat(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    plain = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("role"), text.alias("text"), name.alias("name"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "text"))
    listed = plain.select("conv_id", F.struct(place.alias("i"), "name").alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), "")).alias("path"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): the first h turns of conversation c - c % 5 (none if there is no such
    one), then what follows the first h of conversation c; h = crc32(decimal c) % 9."""
    own = scratch_table(paths(conversations), "trie-paths")
    shared = F.substring("path", 1, (SHARED_TURNS - 1) * TURN)
    heads = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), shared.alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int") * TURN
    joined = own.select("conv_id", "path", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")).join(heads, "base", "left")
    return joined.select("conv_id", F.expr("concat(coalesce(substring(head, 1, h), X''), substring(path, h + 1))").alias("path"))


class Skeleton:
    """The trie of the splitters: of node i ``children[i]`` by their turn, ``parent``, ``depth`` and
    the ``bytes`` of its last text. Parents have smaller numbers than their children."""

    def __init__(self, splitters: list[bytes]):
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.depth, self.bytes = [-1], [0], [0]
        for path in splitters:
            node = 0
            for at in range(0, len(path), TURN):
                turn = path[at : at + TURN]
                if turn not in self.children[node]:
                    self.children[node][turn] = len(self.children)
                    self.children.append({})
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.bytes.append(int.from_bytes(turn[16:], "big"))
                node = self.children[node][turn]


class _Node:
    """An open node of a shard: its members so far and what its finished children gave."""

    __slots__ = ("bytes", "children", "convs", "depth", "ends", "first", "hash", "leaves", "pending", "pieces", "saved", "skeleton")

    def __init__(self, depth: int, size: int, skeleton: int):
        self.depth, self.bytes, self.skeleton = depth, size, skeleton
        self.first: int | None = None
        self.convs = self.children = self.leaves = self.saved = self.pieces = 0
        self.ends: list[int] = []
        self.hash = None
        self.pending: list[tuple] = []


class Shard:
    """One pass over the sorted (path, conv_id) of a shard; every method gives finished rows."""

    def __init__(self, shard: int, skeleton: Skeleton):
        self.shard, self.skeleton, self.path = shard, skeleton, b""
        self.open = [_Node(0, 0, 0)]

    def add(self, path: bytes, conv: int) -> Iterator[tuple]:
        common = len(path) // TURN if path == self.path else 0
        if path != self.path:
            while path[common * TURN : common * TURN + TURN] == self.path[common * TURN : common * TURN + TURN] != b"":
                common += 1
        while len(self.open) > common + 1:
            yield from self._close()
        for at in range(common * TURN, len(path), TURN):
            turn, above = path[at : at + TURN], self.open[-1].skeleton
            known = self.skeleton.children[above].get(turn, -1) if above >= 0 else -1
            self.open.append(_Node(len(self.open), int.from_bytes(turn[16:], "big"), known))
        self.path, node = path, self.open[-1]
        node.convs += 1
        node.first = conv if node.first is None else min(node.first, conv)
        node.ends.append(conv)
        if len(node.ends) == PIECE:
            yield from self._ended(node)

    def _ended(self, node: _Node) -> Iterator[tuple]:
        """Ends come in ascending order: skeleton nodes send them on, others hash them here."""
        if not node.ends:
            return
        text = ",".join(map(str, node.ends))
        if node.skeleton >= 0:
            yield 2, node.skeleton, self.shard, node.pieces, *(None,) * 7, text
        else:
            node.hash = node.hash or hashlib.sha256()
            node.hash.update(((",") * (node.pieces > 0) + text).encode())
        node.pieces += 1
        node.ends = []

    def _close(self) -> Iterator[tuple]:
        node = self.open.pop()
        yield from self._ended(node)
        above = self.open[-1] if self.open else None
        if node.skeleton >= 0:
            yield 1, node.skeleton, self.shard, None, node.first, node.depth, None, node.convs, node.children, node.leaves, node.saved, None
        else:
            node.leaves += node.children == 0
            node.saved += (node.convs - 1) * node.bytes
            above.children += 1
            mine = (node.first, node.depth, node.convs, node.children, node.leaves, node.saved, node.hash.hexdigest() if node.hash else _EMPTY)
            for child in node.pending:
                yield 0, None, None, None, *child[:2], node.first, *child[2:]
            if above.skeleton >= 0:
                yield 0, above.skeleton, None, None, *mine[:2], None, *mine[2:]
            else:
                above.pending.append(mine)
        if above is not None:
            above.convs += node.convs
            above.leaves += node.leaves
            above.saved += node.saved
            if node.first is not None:
                above.first = node.first if above.first is None else min(above.first, node.first)

    def finish(self) -> Iterator[tuple]:
        while self.open:
            yield from self._close()


def _batches(rows: Iterator[tuple], fields: pa.Schema, at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)


def splitters(stored: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 (path, conv_id) that cut the conversations into about equal shards,
    from a sample of ``SAMPLED`` for each shard chosen by hash; no more come to the driver."""
    total = stored.count()
    share = min(1.0, shards * SAMPLED / max(1, total))
    chosen = stored.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else stored
    sample = sorted((bytes(r["path"]), r["conv_id"]) for r in chosen.select("path", "conv_id").collect())
    step = max(1, -(-len(sample) // shards))
    return sample[step::step]


def _dealt(stored: DataFrame, cuts: list[tuple[bytes, int]]) -> DataFrame:
    """``stored`` in sorted shards, one partition each."""

    def deal(batches):
        for batch in batches:
            convs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shard = pa.array([bisect.bisect_right(cuts, x) for x in zip(keys, convs)], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], names=["shard", "conv_id", "path"])

    dealt = stored.select("conv_id", "path").mapInArrow(deal, "shard int, conv_id long, path binary")
    return dealt.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")


def _hashed_ends(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) from the pieces of each skeleton node, taken in order and never held:
    a hash is made from front to back, so the pieces of one node stream through one task."""

    def run(batches):
        def rows():
            node, digest = None, None
            for batch in batches:
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if k != node:
                        if digest:
                            yield node, digest.hexdigest()
                        node, digest = k, hashlib.sha256(text.encode())
                    else:
                        digest.update(b"," + text.encode())
            if digest:
                yield node, digest.hexdigest()

        yield from _batches(rows(), pa.schema([("node", pa.int32()), ("ends_sha256", pa.string())]))

    pieces = parts.filter("kind = 2").select("node", "ends", "shard", "piece")
    in_order = pieces.repartition("node").sortWithinPartitions("node", "shard", "piece").select("node", "ends")
    return in_order.mapInArrow(run, "node int, ends_sha256 string")


def _skeleton_rows(spark: SparkSession, skeleton: Skeleton, parts: DataFrame) -> DataFrame:
    """(node, ...) for each skeleton node. Partial aggregates are added up by Spark; what comes to
    the driver is one row for each node of the skeleton, at most one splitter's length a shard."""
    sums = parts.filter("kind = 1").groupBy("node").agg(F.min("conv_id").alias("first"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    found = {r["node"]: r for r in sums.join(_hashed_ends(parts), "node", "left").collect()}
    size = len(skeleton.children)
    leaves, saved = [0] * size, [0] * size  # of the skeleton nodes alone, below each and itself
    rows = []
    for i in range(size - 1, -1, -1):
        if i not in found:  # only the root of no conversations at all
            continue
        r, above = found[i], skeleton.parent[i]
        children = r["n_children"] + len(skeleton.children[i])
        leaves[i] += children == 0
        saved[i] += (r["n_convs"] - 1) * skeleton.bytes[i]
        if above >= 0:
            leaves[above] += leaves[i]
            saved[above] += saved[i]
        rows.append((i, r["first"], skeleton.depth[i], found[above]["first"] if above >= 0 else None, r["n_convs"], children, r["n_leaves"] + leaves[i], r["saved_tokens"] + saved[i], r["ends_sha256"] or _EMPTY))
    kinds = "node int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    return spark.createDataFrame(rows, kinds)


def nodes(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each node of the trie over (conv_id, path): conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_ids are distinct. An empty path is a member of the root alone; without any
    conversation there are no nodes. ``shards`` follows from the bytes of the paths. A task holds
    the open nodes of one path and the finished ones below them that are in no splitter, so
    never more than its shard.
    """
    spark = conversations.sparkSession
    stored = scratch_table(conversations.select("conv_id", "path"), "trie-rebuilt")
    if shards is None:
        held = stored.agg(F.sum(F.octet_length("path") + 16)).first()[0] or 0
        shards = max(shuffle_partitions(spark), held // SHARD_BYTES + 1)
    cuts = splitters(stored, shards)
    skeleton = Skeleton([path for path, _ in cuts])
    shared = spark.sparkContext.broadcast(skeleton)

    def run(batches):
        def rows():
            shard = None
            for batch in batches:
                for number, conv, path in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if shard is None or number != shard.shard:
                        if shard is not None:
                            yield from shard.finish()
                        shard = Shard(number, shared.value)
                    yield from shard.add(path, conv)
            if shard is not None:
                yield from shard.finish()

        yield from _batches(rows(), _FIELDS)

    parts = scratch_table(_dealt(stored, cuts).mapInArrow(run, _PARTS), "trie-parts")
    top = scratch_table(_skeleton_rows(spark, skeleton, parts), "trie-skeleton")
    above = F.broadcast(top.select("node", F.col("conv_id").alias("above")))
    local = parts.filter("kind = 0").join(above, "node", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    return local.withColumnRenamed("ends", "ends_sha256").select(*_NODES).unionByName(top.select(*_NODES))


#: The same nodes by grouping all prefixes; crc32 is written out bit by bit.
SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda p: ascii(substr(s, p::INT, 1))::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 9 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)
), r AS (
  SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.base WHERE i <= h
  UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE i > h
), n AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, strlen(text) AS b,
    md5(length(role)::VARCHAR || ':' || role || text) AS m FROM r
), p AS (
  SELECT conv_id, d, b, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM n
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), e AS (
  SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS is_end FROM p
), node AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM e GROUP BY d, k
), full_node AS (
  SELECT x.*, y.conv_id AS parent_conv_id, coalesce(z.n, 0) AS n_children
  FROM node x LEFT JOIN node y ON y.d = x.d - 1 AND y.k = left(x.k, 32 * (x.d - 1))
    LEFT JOIN (SELECT d - 1 AS d, left(k, 32 * (d - 1)) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL) z ON z.d = x.d AND z.k = x.k
), below AS (
  SELECT a AS d, left(k, 32 * a) AS k, sum((n_convs - 1) * b) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_node) GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN below USING (d, k)"""
