"""Burst tries over conversations: containers of suffixes under trie heads.

A conversation is the sequence of its turns' ids. Equal sequences are one suffix with its members. All
suffixes start in the root's container; a container with too many turns bursts: its suffixes move to
one container for each next turn id, below the path that all of them share. Containers that stay are
sorted and swept into nodes by a stack, one pass each; the burst heads are then summed up
from the last round to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.shared import table, written
from panelcast.session import small_side

#: Bytes of a turn's id: the first half of a SHA-256 over its role and text.
ID_BYTES = 16
#: Turns that a container may hold before it bursts.
CONTAINER_TURNS = 4096
#: Members of one sequence are listed in ranges of this many conversation numbers.
_RANGE = 1024
_NO_END = hashlib.sha256(b"").hexdigest()

_NODE = (
    "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, ends_sha256 string"
)


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, id, chars``: rows without their texts; null roles and texts are empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    spelt = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(spelt.cast("binary"), 256), 1, 2 * ID_BYTES))
    return conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", digest.alias("id"), F.char_length(text).alias("chars")
    )


def _turns(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per conversation: its turns in order, null first, ties by id."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("turns"))


def _path(turns: Column) -> tuple[Column, Column]:
    ids = F.array_join(F.transform(turns, lambda t: F.hex(t["id"])), "")
    return F.unhex(ids).alias("path"), F.transform(turns, lambda t: t["chars"]).alias("chars")


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, chars`` of conversations as they are; ids of the turns joined into one path."""
    return _turns(turn_ids(conversations), "conv_id").select("conv_id", *_path(F.col("turns")))


def rebuilt(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """``conv_id, path, chars``: the first h turns of the base conversation, then the own ones after the first h.

    The base of c is c - c % ``every``, h is crc32 of c's decimal digits modulo ``heads``. Turns
    meet their base in one shuffle of ids, by base, and never with their texts.
    """
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    rows = turn_ids(conversations).withColumn("base", base).repartition("base")
    own = _turns(rows, "base", "conv_id")
    first = _turns(rows.where("conv_id = base"), "base", "conv_id").select(
        "base", F.slice("turns", 1, heads).alias("first")
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    joined = own.join(first, "base", "left").withColumn("h", h)
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    both = F.concat(F.slice(F.coalesce("first", F.array().cast(first.schema["first"].dataType)), 1, F.col("h")), tail)
    return joined.select("conv_id", both.alias("turns")).select("conv_id", *_path(F.col("turns")))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of members, sorted by sequence and range, into one row a sequence; ids are hashed as they pass."""
    names = ["path", "chars", "n", "conv_id", "ends"]
    types = [pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
    path, state = None, None
    for batch in batches:
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("path", "chars", "n", "conv_id", "listed")), strict=True):
            if state is not None and row[0] == path:
                state[1] += row[2]
                state[3].update(b"," + row[4].encode())
                continue
            if state is not None:
                done.append((path, state[0], state[1], state[2], state[3].hexdigest()))
            path, state = row[0], [row[1], row[2], row[3], hashlib.sha256(row[4].encode())]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
    if state is not None:
        last = (path, state[0], state[1], state[2], state[3].hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types, strict=True)], names)


def suffixes(paths: DataFrame) -> DataFrame:
    """``path, chars, n, conv_id, ends``: distinct sequences, their members counted, the smallest, all hashed.

    Members are gathered by ranges of ids, so a sequence that a third of all conversations share is
    many rows of bounded length, which one pass reads in order and only hashes.
    """
    some = paths.withColumn("range", F.floor(F.col("conv_id") / _RANGE))
    ranges = some.groupBy("path", "range").agg(
        F.first("chars").alias("chars"), F.sort_array(F.collect_list("conv_id")).alias("ids")
    )
    listed = ranges.select(
        "path", "range", "chars", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("conv_id"),
        F.array_join("ids", ",").alias("listed"),
    )
    ordered = listed.repartition("path").sortWithinPartitions("path", "range")
    return ordered.mapInArrow(_members, "path binary, chars array<int>, n long, conv_id long, ends string")


def _shared(lo: Column, hi: Column) -> Column:
    """Turns that two paths share at their start."""
    short = F.least(F.octet_length(lo), F.octet_length(hi)) / ID_BYTES
    at = lambda path, i: F.substring(path, ID_BYTES * i + 1, F.lit(ID_BYTES))
    places = F.transform(F.sequence(F.lit(0), short.cast("int")), lambda i: F.coalesce(at(lo, i) == at(hi, i), F.lit(False)))
    differs = F.array_position(places, False).cast("int") - 1
    return F.when(differs < 0, short.cast("int")).otherwise(F.least(differs, short.cast("int")))


def _head() -> Column:
    """The path of the container that a suffix lies in."""
    return F.substring(F.col("path"), F.lit(1), F.col("at") * ID_BYTES)


def _length() -> Column:
    return (F.octet_length("path") / ID_BYTES).cast("int")


def burst(rows: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Containers that stay, and the burst ones of every round.

    A burst container's row holds its path, the depths ``at`` of its head and ``to`` where it branches, its
    members, and the sequence that ends there. It branches below all that its suffixes share, so a
    round ends at every branching, not at every turn. Few containers are too large: they are
    counted before they are broadcast.
    """
    kept, bursts = [], []
    rows = rows.withColumns({"at": F.lit(0), "parent_conv_id": F.lit(None).cast("long")})
    while True:
        sizes = rows.groupBy(_head().alias("head")).agg(
            F.count(F.lit(1)).alias("suffixes"),
            F.sum(_length() - F.col("at")).alias("turns"),
            F.sum("n").alias("n"),
            F.min("conv_id").alias("low"),
            F.min("path").alias("lo"),
            F.max("path").alias("hi"),
            F.min_by(F.struct("chars", "ends"), "path").alias("first"),
            F.first("at").alias("at"),
            F.first("parent_conv_id").alias("parent_conv_id"),
        )
        to = _shared(F.col("lo"), F.col("hi"))
        large = written(
            sizes.where((F.col("turns") > most) & (F.col("suffixes") > 1)).withColumn("to", to).select(
                "head", "at", "to", "parent_conv_id", "n", F.col("low").alias("conv_id"),
                F.col("first.chars").alias("chars"),
                F.when(F.octet_length("lo") == F.col("to") * ID_BYTES, F.col("first.ends")).otherwise(_NO_END).alias("ends"),
            ),
            "burst",
        )
        if large.isEmpty():
            return [*kept, rows], bursts
        small = small_side(large.select("head", F.col("to").alias("branch"), F.col("conv_id").alias("above")))
        keyed = rows.withColumn("head", _head())
        kept.append(keyed.join(small, "head", "left_anti").drop("head"))
        bursts.append(large)
        moved = keyed.join(small, "head").where(_length() > F.col("branch"))
        rows = written(
            moved.withColumns({"at": F.col("branch") + 1, "parent_conv_id": F.col("above")}).select(*rows.columns), "suffixes"
        )


class _Node:
    __slots__ = ("depth", "conv", "n", "children", "leaves", "saved", "ends", "chars")

    def __init__(self, depth: int, chars: int):
        self.depth, self.chars = depth, chars
        self.conv, self.n, self.leaves, self.saved = None, 0, 0, 0
        self.ends, self.children = _NO_END, []


def sweep_container(at: int, above: int | None, rows: list[tuple[bytes, list[int], int, int, str]]) -> list[tuple]:
    """All nodes of a container from its sorted suffixes (path, chars, members, smallest, hash of members).

    A stack holds the open path; a node is closed when the next suffix leaves it, and
    knows its children's numbers then. Rows are ``_NODE`` columns, the head's last.
    """
    out: list[tuple] = []
    stack: list[_Node] = []

    def close() -> None:
        node = stack.pop()
        node.saved += (node.n - 1) * node.chars
        node.leaves = node.leaves or 1
        out.extend((d, c, node.conv, *rest) for d, c, *rest in node.children)
        row = (node.depth, node.conv, node.n, len(node.children), node.leaves, node.saved, node.ends)
        if stack:
            up = stack[-1]
            up.n, up.leaves, up.saved = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
            up.children.append(row)
        else:
            out.append((row[0], row[1], above, *row[2:]))

    before = b""
    for path, chars, n, conv, ends in rows:
        depth = len(path) // ID_BYTES
        shared = at
        while stack and shared < min(depth, stack[-1].depth) and (
            path[shared * ID_BYTES : (shared + 1) * ID_BYTES] == before[shared * ID_BYTES : (shared + 1) * ID_BYTES]
        ):
            shared += 1
        while stack and stack[-1].depth > shared:
            close()
        for d in range(stack[-1].depth + 1 if stack else at, depth + 1):
            stack.append(_Node(d, chars[d - 1] if d else 0))
        node = stack[-1]
        node.n, node.ends = node.n + n, ends
        node.conv = conv if node.conv is None else min(node.conv, conv)
        before = path
    while stack:
        close()
    return out


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers one after another from a partition sorted by path."""
    names = [c.split()[0] for c in _NODE.split(", ")] + ["is_head"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [*[pa.int64()] * 7, pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def nodes(key: tuple[int, bytes, int | None], rows: list[tuple]) -> list[tuple]:
        found = sweep_container(key[0], key[2], rows)
        return [(*row, i == len(found) - 1) for i, row in enumerate(found)]

    key, rows, done = None, [], []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("at", "parent_conv_id", "path", "chars", "n", "conv_id", "ends"))
        for at, above, path, chars, n, conv, ends in zip(*columns, strict=True):
            mine = (at, path[: at * ID_BYTES], above)
            if mine != key and rows:
                done += nodes(key, rows)
                rows = []
            key = mine
            rows.append((path, chars, n, conv, ends))
            if len(done) > 20_000:
                yield batch_of(done)
                done = []
    if rows:
        done += nodes(key, rows)
    if done:
        yield batch_of(done)


def _summed(bursts: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of burst containers from their children's heads, and these containers' own heads.

    From ``to`` up to ``at`` a container has one node a depth, all with the same members.
    """
    below = heads.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).cast("int").alias("to")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")
    )
    chars = F.when(F.col("depth") > 0, F.get("chars", F.col("depth") - 1)).otherwise(0)
    deeper = F.aggregate(
        F.slice("chars", F.greatest(F.col("depth"), F.lit(1)), F.col("to") - F.greatest(F.col("depth"), F.lit(1)) + 1),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    last = F.col("depth") == F.col("to")
    nodes = (
        bursts.join(below, ["conv_id", "to"])
        .withColumn("depth", F.explode(F.sequence("at", "to")))
        .select(
            F.col("depth").cast("long").alias("depth"),
            "conv_id",
            F.when(F.col("depth") == F.col("at"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(last, F.col("n_children")).otherwise(1).alias("n_children"),
            "n_leaves",
            (F.col("saved") + (F.col("n") - 1) * F.when(F.col("to") > 0, deeper).otherwise(0)).alias("saved_tokens"),
            F.when(last, F.col("ends")).otherwise(_NO_END).alias("ends_sha256"),
            (F.col("depth") == F.col("at")).alias("is_head"),
        )
    )
    return nodes, nodes.where("is_head")


def prefix_trie(paths: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """One row per node of the trie of ``conv_id, path, chars``: its counts, parent and members' digest.

    Conversations without turns belong to the root. ``conv_id`` should be unique: rows that repeat one
    count as members of their own. A conversation travels as one row of 20 bytes a turn, like a
    text as one text; a container holds ``container_turns`` turns or one sequence. Rounds of bursts
    are as many as branchings one below the other with more turns than that. An empty table has no nodes.
    """
    kept, bursts = burst(written(suffixes(paths), "sequences"), container_turns)
    swept = []
    for level, rows in enumerate(kept):
        dealt = rows.withColumn("head", _head()).repartition("head").sortWithinPartitions("path").drop("head")
        swept.append(written(dealt.mapInArrow(_sweep, _NODE + ", is_head boolean"), f"nodes-{level}"))
    out = swept[-1]
    heads = swept[-1].where("is_head")
    for rows, nodes in zip(reversed(bursts), reversed(swept[:-1]), strict=True):
        own, own_heads = _summed(rows, heads)
        own = written(own, "heads")
        out = out.unionByName(nodes).unionByName(own)
        heads = nodes.where("is_head").unionByName(own.where("is_head"))
    return out.drop("is_head")


def op11_burst_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie(rebuilt(table(spark, folder, "conversations")))
