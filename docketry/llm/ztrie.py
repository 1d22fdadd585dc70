"""Prefix trie of conversations: z-fast tries over ranges of the sorted sequences, joined at their borders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.store import materialise

TURNS_PER_RANGE = 50_000
SEQUENCES_PER_BATCH = 1024
IDS_PER_SEGMENT = 1024
PRIME = (1 << 61) - 1
BASE = 0x1F3D5B79A2C4E687 % PRIME

NODES = (
    "depth bigint, conv_id bigint, parent_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved bigint, ends bigint, node_key binary, parent_key binary"
)


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the highest power of two."""
    return (high >> (low ^ high).bit_length() - 1) << (low ^ high).bit_length() - 1


@dataclass(eq=False)
class Node:
    """A compacted node: the turns of sequence `of` up to `extent`; its edge begins below the parent's extent."""

    of: int
    extent: int
    parent: Node | None
    children: dict[bytes, Node] = field(default_factory=dict)
    members: int = 0  # conversations that end here
    first: int | None = None  # the smallest of them
    n_convs: int = 0  # in the subtree
    least: int | None = None

    def handle(self) -> int:
        return two_fattest(self.parent.extent, self.extent) if self.extent else 0


class ZFastTrie:
    """A trie of turn sequences whose compacted nodes are found by hash at their two-fattest depth.

    A node's handle is the prefix whose length is the two-fattest number on its edge. The exit
    node of a sequence, where it leaves the trie, is found by fat binary search: look up the
    sequence's own prefix at the two-fattest depth still possible, go on below the node's extent
    if there is one, above that depth if not. Hashes only lead there; turns are compared before
    a node is believed.
    """

    def __init__(self):
        self.turns: list[list[bytes]] = []
        self.hashes: list[list[int]] = []
        self.root: Node | None = None
        self.handles: dict[tuple[int, int], Node] = {}

    def _hash(self, turns: list[bytes]) -> list[int]:
        out = [0]
        for t in turns:
            out.append((out[-1] * BASE + int.from_bytes(t[:8], "big") + 1) % PRIME)
        return out

    def _name(self, node: Node) -> None:
        f = node.handle()
        self.handles[f, self.hashes[node.of][f]] = node

    def _agrees(self, node: Node, turns: list[bytes]) -> bool:
        return node.extent <= len(turns) and self.turns[node.of][: node.extent] == turns[: node.extent]

    def exit(self, turns: list[bytes], hashes: list[int]) -> Node:
        """The deepest node all of whose turns begin the sequence."""
        node, low, high = self.root, 0, len(turns)
        while low < high:
            f = two_fattest(low, high)
            found = self.handles.get((f, hashes[f]))
            if found is None:
                high = f - 1
            elif found.extent <= len(turns) and self.hashes[found.of][found.extent] == hashes[found.extent]:
                node, low = found, found.extent
            else:
                node = found.parent
                break
        if not self._agrees(node, turns):  # two prefixes with one hash
            node = self.root
        return self._down(node, turns)

    def _down(self, node: Node, turns: list[bytes]) -> Node:
        """Follow whole edges from a node on the sequence's path."""
        while node.extent < len(turns):
            child = node.children.get(turns[node.extent])
            if child is None or not self._agrees(child, turns):
                return node
            node = child
        return node

    def insert(self, batch: list[tuple[list[bytes], int, int]]) -> list[Node]:
        """Add sequences, each with its number of conversations and the smallest; their end nodes.

        All exits of the batch are located first; then the sequences are hung there one by one,
        below what the batch itself has put in between.
        """
        hashes = [self._hash(turns) for turns, _, _ in batch]
        if self.root is None and batch:
            self.turns.append(batch[0][0])
            self.hashes.append(hashes[0])
            self.root = Node(0, 0, None)
            self._name(self.root)
        exits = [self.exit(turns, h) for (turns, _, _), h in zip(batch, hashes)]
        ends = []
        for (turns, members, first), own, node in zip(batch, hashes, exits):
            self.turns.append(turns)
            self.hashes.append(own)
            node = self._end(self._down(node, turns), turns)
            node.members += members
            node.first = first if node.first is None else min(node.first, first)
            ends.append(node)
        return ends

    def _end(self, node: Node, turns: list[bytes]) -> Node:
        """The node at which the sequence, the last one taken, ends; made where it is missing."""
        if node.extent == len(turns):
            return node
        child = node.children.get(turns[node.extent])
        if child is not None:
            node = self._split(node, child, turns)
        if node.extent < len(turns):
            leaf = Node(len(self.turns) - 1, len(turns), node)
            node.children[turns[node.extent]] = leaf
            self._name(leaf)
            node = leaf
        return node

    def _split(self, node: Node, child: Node, turns: list[bytes]) -> Node:
        """A new node on the child's edge, where the sequence leaves it."""
        edge = self.turns[child.of]
        at = node.extent + 1
        while at < len(turns) and at < child.extent and edge[at] == turns[at]:
            at += 1
        old = child.handle(), self.hashes[child.of][child.handle()]
        if self.handles.get(old) is child:
            del self.handles[old]
        middle = Node(child.of, at, node, {edge[at]: child})
        node.children[turns[node.extent]] = middle
        child.parent = middle
        self._name(middle)
        self._name(child)
        return middle

    def nodes(self) -> list[Node]:
        """All compacted nodes, parents first."""
        out = [self.root] if self.root else []
        for node in out:
            out += node.children.values()
        return out


def _keys(turns: list[bytes], upto: int) -> list[bytes]:
    """A 128-bit name for each prefix, the same in every range."""
    out = [hashlib.blake2b(b"", digest_size=16).digest()]
    for t in turns[:upto]:
        out.append(hashlib.blake2b(out[-1] + t, digest_size=16).digest())
    return out


def expand(trie: ZFastTrie, sizes: list[list[int]], ends: list[Node], before: int, after: int, goes_on: bool) -> Iterator[tuple]:
    """A row for each depth of each edge, in the order of `NODES`.

    The range's first sequence shares its prefixes up to depth `before` with the range before it
    (-1: there is none), its last those up to `after` with the next; `goes_on` tells that the last
    is itself a prefix there. Such border nodes carry a key, by which their rows are summed. What
    must count once, a node as a child and its saving, counts in the first range that has it.
    """
    first, last = ends[0], ends[-1]
    paths = [set(), set()]
    for path, node in zip(paths, (first, last)):
        while node is not None:
            path.add(id(node))
            node = node.parent
    keys = [_keys(trie.turns[n.of], min(upto, n.extent)) for n, upto in ((first, before), (last, after))]

    def key(node: Node, depth: int) -> bytes | None:
        if depth <= before and id(node) in paths[0]:
            return keys[0][depth]
        return keys[1][depth] if depth <= after and id(node) in paths[1] else None

    below: dict[int, list[int]] = {}  # leaves, saving and children of the node at the top of each edge
    nodes = trie.nodes()
    for node in reversed(nodes):
        found = [c for c in (node.first, *(child.least for child in node.children.values())) if c is not None]
        node.least, node.n_convs = min(found), node.members + sum(c.n_convs for c in node.children.values())
    for node in reversed(nodes):
        parts = [below.pop(id(child)) for child in node.children.values()]
        leaves, saved, children = (sum(p[i] for p in parts) for i in range(3))
        if not node.children and not (goes_on and node is last):
            leaves = 1
        top = node.parent.extent if node.parent else -1
        for depth in range(node.extent, top, -1):
            counted = not (depth <= before and id(node) in paths[0])
            saved += (node.n_convs - counted) * (sizes[node.of][depth - 1] if depth else 0)
            above = node if depth - 1 > top else node.parent
            above_key = key(above, depth - 1) if above and depth else None
            parent = above.least if above and depth and above_key is None else None
            end = node.first if depth == node.extent else None
            yield depth, node.least, parent, node.n_convs, children, leaves, saved, end, key(node, depth), above_key
            children = int(counted)
        below[id(node)] = [leaves, saved, children]


def _build(table: pa.Table) -> pa.Table:
    """The rows of one range of sequences, from a trie of its own."""
    rows = table.to_pydict()
    sequences = sorted(
        ([t["digest"] for t in turns], n, first, [t["bytes"] for t in turns])
        for turns, n, first in zip(rows["turns"], rows["n"], rows["first"])
    )
    trie, ends = ZFastTrie(), []
    for i in range(0, len(sequences), SEQUENCES_PER_BATCH):
        ends += trie.insert([s[:3] for s in sequences[i : i + SEQUENCES_PER_BATCH]])
    sizes = [s[3] for s in (sequences[0], *sequences)]
    found = list(zip(*expand(trie, sizes, ends, rows["before"][0], rows["after"][0], rows["goes_on"][0])))
    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in NODES.split(", ")]
    return pa.table({name: pa.array(values, kind) for name, values, kind in zip(names, found, kinds)})


def shared_turns(a: Column, b: Column) -> Column:
    """How many turns two sequences have in common from the start."""
    same = F.zip_with(a, b, lambda x, y: x["digest"].eqNullSafe(y["digest"]))
    until = F.array_position(same, False)
    return F.when(until == 0, F.size(same)).otherwise(until - 1).cast("bigint")


def gather_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each as a 128-bit digest of role and text and the text's UTF-8 bytes.

    Turns follow the column turn, null first; equal turns follow the digest. Null roles and texts
    are empty ones. Rows without conv_id belong to no conversation. From here on a conversation is
    one row of 24 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    spelled = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(spelled.cast("binary"), 256), 1, 32))
    turn = F.struct(F.col("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def _digest_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's segments, which follow one another in order."""
    sequence, running = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"sequence": pa.array([sequence]), "ends_sha256": pa.array([running.hexdigest()])})

    for batch in batches:
        for at, ids in zip(batch.column("sequence").to_pylist(), batch.column("ids").to_pylist()):
            if at != sequence:
                if running:
                    yield done()
                sequence, running = at, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
    if running:
        yield done()


def _ends(sequences: DataFrame) -> DataFrame:
    """For each sequence, the SHA-256 of its conversations' ids in ascending order.

    Ids are joined in segments of neighbouring ids, which are then hashed in order as a stream: no
    task holds more than a batch of them, however many conversations are equal.
    """
    segment = F.floor(F.col("conv_id") / IDS_PER_SEGMENT).alias("segment")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    segments = sequences.groupBy("sequence", segment).agg(ids.alias("ids"))
    ordered = segments.repartition("sequence").sortWithinPartitions("sequence", "segment")
    return ordered.select("sequence", "ids").mapInArrow(_digest_segments, "sequence string, ends_sha256 string")


def prefix_nodes(gathered: DataFrame) -> DataFrame:
    """A row for every distinct prefix of the conversations' turns, from `conv_id, turns` as `gather_turns` gives them.

    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; null for the root),
    n_convs (members), n_children, n_leaves (childless nodes in the subtree), saved_tokens (over
    the subtree, members less one times bytes of the last text), ends_sha256 (over the ids of the
    conversations that end here, ascending, joined by commas).

    1. Equal sequences are counted and from then on stand for their conversations.
    2. The sequences are sorted and dealt out in ranges of about `TURNS_PER_RANGE` turns. Since
       they are distinct, a first turn that a third of all conversations share is spread over as
       many ranges as it needs.
    3. Each range inserts its sequences into a z-fast trie, batch by batch, and expands the edges.
    4. Prefixes that reach over the border of two ranges were built on both sides; only these are
       summed up, by a 128-bit key. Neighbours are found by a join, and what counts once counts in
       the range that has it first.

    A conversation without turns ends at the root. conv_id must be unique and not null, as it is
    after `gather_turns`. An empty table has no node. Other columns are left alone.
    """
    spark = gathered.sparkSession
    spelled = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    sequence = F.sha2(spelled.cast("binary"), 256)
    rows = materialise(gathered.select("conv_id", "turns", sequence.alias("sequence")), "sequences")
    counted = materialise(
        rows.groupBy("sequence", "turns").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")), "distinct"
    )
    turns = counted.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    ranges = -(-turns // TURNS_PER_RANGE) or 1
    ranged = counted.repartitionByRange(ranges, "turns").withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")

    bounds = materialise(ranged.groupBy("range").agg(F.min("turns").alias("low"), F.max("turns").alias("high")), "bounds")
    present = sorted(r.range for r in bounds.select("range").collect())
    follows = pa.table({"range": pa.array(present, pa.int32()), "prev": pa.array([None, *present[:-1]][: len(present)], pa.int32())})
    borders = bounds.join(spark.createDataFrame(follows), "range").join(
        bounds.select(F.col("range").alias("prev"), F.col("high").alias("prev_high")), "prev", "left"
    )
    shared = F.coalesce(shared_turns(F.col("prev_high"), F.col("low")), F.lit(-1))
    borders = borders.select("range", "prev", shared.alias("before"), (shared == F.size("prev_high")).alias("goes_on"))
    after = borders.select(F.col("prev").alias("range"), F.col("before").alias("after"), "goes_on")
    borders = borders.select("range", "before").join(after, "range", "left")
    borders = borders.select(
        "range", "before", F.coalesce("after", F.lit(-1)).alias("after"), F.coalesce("goes_on", F.lit(False)).alias("goes_on")
    )
    built = materialise(
        ranged.select("range", "turns", "n", "first").join(borders, "range").groupBy("range").applyInArrow(_build, NODES), "nodes"
    )

    total = {c: F.sum(c) for c in ("n_convs", "n_children", "n_leaves", "saved")}
    total |= {c: F.min(c) for c in ("conv_id", "parent_id", "ends")}
    total |= {"parent_key": F.max("parent_key")}
    border = built.filter("node_key is not null").groupBy("depth", "node_key").agg(*[v.alias(c) for c, v in total.items()])
    border = materialise(border.select(*built.columns), "border")
    nodes = built.filter("node_key is null").unionByName(border)
    parents = border.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("key_id"))
    ends = _ends(rows).join(counted.select("sequence", F.col("first").alias("ends")), "sequence").drop("sequence")
    nothing = hashlib.sha256().hexdigest()
    return (
        nodes.join(parents, "parent_key", "left")
        .join(ends, "ends", "left")
        .select(
            "conv_id", "depth", F.coalesce("parent_id", "key_id").alias("parent_conv_id"), "n_convs", "n_children",
            "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )
