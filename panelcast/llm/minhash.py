"""Near-equal word sets by chosen paths over minwise tokens."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.components import LocalSets, components
from panelcast.llm.shared import WordHashes, by_group, mixed, sorted_groups, table, written
from panelcast.session import small_side

SIGNATURE = 128
TREES = 12
#: A node of at most so many sets is compared exhaustively.
LEAF = 1000
#: A node of at most so many sets is branched to its end in one task: 136 bytes a set.
NODE = 100_000
#: Sets of a candidate cluster that one task verifies against each other.
BLOCK = 400
#: Hashes of such a block together, about; long documents make smaller blocks.
BLOCK_HASHES = 500_000
#: Rows with full sets that are sent to Python at once.
SET_ROWS = 200
PERCENT = 80
#: Documents with candidates, their clusters, or nodes that are branched further, whose ids are
#: sent to all tasks up to this number: 16 bytes each.
MEMBERS = 1_000_000
#: Four words of 64 bits: two bits of each signature place, all low ones before all high ones.
BRIEF = ["b0", "b1", "b2", "b3"]

_RNG = np.random.Generator(np.random.PCG64(20))
_FACTORS = _RNG.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


class ShingleSets:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self.hashes = WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        """Whole sequence as one shingle where there are fewer words; empty without words."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = self.hashes.of(words)
        size = min(self.size, len(words))
        last = len(words) - size + 1
        total = np.full(last, np.uint64(size))
        for i in range(size):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + last])
        return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions, 32 bits each."""
    lowest = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        values = shingles[None, i : i + 512] * _FACTORS[:, None] + _SHIFTS[:, None]
        np.minimum(lowest, values.min(axis=1), out=lowest)
    return (lowest >> np.uint64(32)).astype(np.uint32)


def brief(sig: np.ndarray) -> bytes:
    """Two bits of each place, all low ones before all high ones: 32 bytes."""
    return np.packbits([sig & 1, sig >> 1 & 1], axis=1).tobytes()


def least_equal(percent: int) -> int:
    """Places in which the briefs of a similar pair agree at least.

    Two bits agree by chance in a quarter of the places. A pair at a similarity of 0.8 agrees in
    108.8 of 128 with a deviation of 4.0; six deviations leave out one such pair in a billion.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the trees branch for similarities of 80 to 100 percent")
    share = (percent + (100 - percent) / 4) / 100
    return math.ceil(SIGNATURE * share - 6 * math.sqrt(SIGNATURE * share * (1 - share)))


def depth_for(n: int, leaf: int) -> int:
    """Levels that ``n`` sets may need: unrelated ones part at each, pairs at 0.5 in three of eight cases."""
    return 4 + math.ceil(math.log(max(1.0, n / leaf)) / math.log(1.6))


def _agreeing(differ: np.ndarray) -> np.ndarray:
    """Equal places from the words in which two briefs differ."""
    half = differ.shape[-1] // 2
    return SIGNATURE - np.bitwise_count(differ[..., :half] | differ[..., half:]).sum(axis=-1, dtype=np.int64)


def equal_places(m: np.ndarray, i: int) -> np.ndarray:
    """Places in which the briefs after row ``i`` agree with its own; rows are 64-bit words."""
    return _agreeing(m[i + 1 :] ^ m[i])


def leaf_roots(m: np.ndarray, least: int) -> np.ndarray:
    """For each brief the first one that it reaches over pairs which agree in ``least`` places.

    A brief is compared only with those that nothing has reached yet, so copies cost a comparison each.
    """
    roots = np.arange(len(m))
    if len(m) <= 100 and np.count_nonzero(_agreeing(m[:, None] ^ m) >= least) == len(m):
        return roots
    left = roots[:]
    while len(left) > 1:
        first, left = left[0], left[1:]
        others, queue = m[left], [first]
        while queue and len(left):
            hit = _agreeing(others ^ m[queue.pop()]) >= least
            if hit.any():
                roots[left[hit]] = first
                queue.extend(left[hit].tolist())
                left, others = left[~hit], others[~hit]
    return roots


def _describe(size: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(size)
        for batch in batches:
            counts, keys, full = [], [], []
            briefs = np.zeros((len(batch), len(BRIEF)), np.int64)
            for row, text in enumerate(batch.column("text")):
                s = sets.of(text.as_py())
                counts.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig = signature(s) if len(s) else None
                full.append(None if sig is None else sig.view(np.int32))
                if sig is not None:
                    briefs[row] = np.frombuffer(brief(sig), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(full, pa.list_(pa.int32())),
                    *[pa.array(c) for c in np.ascontiguousarray(briefs.T)],
                ],
                ["doc_id", "n_shingles", "key", "signature", *BRIEF],
            )

    return describe


def _branches(path: Column, sig: Column) -> Column:
    """Children of a node: one, or with one chance in four two, signature places that the
    node's own hash picks: 1.25 = 1 / 0.8 on average, so that a pair at 0.8 stays
    together in one child on average."""
    place = lambda salt: F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(SIGNATURE)).cast("int")
    child = lambda p: F.xxhash64(path, p, F.get(sig, p))
    first, second = place(1), place(2)
    both = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(4)) == 0
    return F.when(both & (first != second), F.array(child(first), child(second))).otherwise(F.array(child(first)))


def _picked(path: int, *salts: int) -> list[int]:
    """Hashes of a node and each salt."""
    return mixed(mixed(np.array([path], np.uint64)) + np.array(salts, np.uint64)).tolist()


def _children(path: int, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Path and rows of the children with several sets, chosen as ``_branches`` does."""
    first, second, both = _picked(path, 1, 2, 3)
    for place in {first % SIGNATURE, second % SIGNATURE} if both % 4 == 0 else {first % SIGNATURE}:
        order = np.argsort(places[:, place], kind="stable")
        values = places[order, place]
        for rows in np.split(order, np.flatnonzero(values[1:] != values[:-1]) + 1):
            if len(rows) > 1:
                yield _picked(path, 4 + 256 * place + int(places[rows[0], place]))[0], rows


def node_roots(path: int, places: np.ndarray, least: int, leaf: int, depth: int | None = None) -> np.ndarray:
    """Candidates of one node, as the first set that each set reaches; ``places`` hold the low byte of each place.

    Branches on by the rules of ``candidate_links`` until nodes are small. Nodes whose sets are in one
    component already are done.
    """
    briefs = np.packbits(np.concatenate([places & 1, places >> 1 & 1], axis=1), axis=1).view(np.uint64)
    if len(places) <= leaf:
        return leaf_roots(briefs, least)
    sets, reach = LocalSets(len(places)), SIGNATURE - least
    nodes = [(path, np.arange(len(places)), depth or depth_for(len(places), leaf))]
    while nodes:
        path, at, levels = nodes.pop()
        if len(at) <= leaf:
            linked = leaf_roots(briefs[at], least)
        elif levels == 0:
            linked = np.zeros(len(at), int)
        else:
            away = SIGNATURE - _agreeing(briefs[at] ^ briefs[at[0]])
            linked = np.where(away <= reach, 0, np.arange(len(at)))
        for i in np.flatnonzero(linked != np.arange(len(at))).tolist():
            sets.join(int(at[i]), int(at[linked[i]]))
        if len(at) <= leaf or levels == 0 or (away <= reach).all():
            continue
        joined = sets.roots()[at]
        if (joined == joined[0]).all():
            continue
        # The nearest set that is not linked to the leader decides who stays.
        at = at[(away > reach) | (away[away > reach].min() - away <= reach)]
        nodes += [(child, at[rows], levels - 1) for child, rows in _children(path, places[at])]
    return sets.roots()


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Path, ids in order and places of each node of several sets, from rows sorted by path; one is held at a time."""
    path, held = None, []

    def whole() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        reps = np.concatenate([np.empty(0, np.int64), *(r for r, _ in held)])
        if len(reps) > 1:
            order = np.argsort(reps, kind="stable")
            yield path % (1 << 64), reps[order], np.concatenate([p for _, p in held])[order]

    for batch in batches:
        paths, reps = (batch.column(c).to_numpy() for c in (0, 1))
        places = batch.column(2).flatten().to_numpy().view(np.uint8).reshape(-1, SIGNATURE)
        ends = np.concatenate([[0], np.flatnonzero(paths[1:] != paths[:-1]) + 1, [len(paths)]])
        for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if low < high:
                if paths[low] != path:
                    yield from whole()
                    path, held = int(paths[low]), []
                held.append((reps[low:high], places[low:high]))
    yield from whole()


def _compare_nodes(least: int, leaf: int, depth: int | None):
    """Candidate pairs of each node as links to local roots; rows come by node."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for path, reps, places in _nodes(batches):
            roots = node_roots(path, places, least, leaf, depth)
            others = np.flatnonzero(roots != np.arange(len(roots)))
            a += reps[others].tolist()
            b += reps[roots[others]].tolist()
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare


def _differing() -> Column:
    """Places in which the briefs of a set and of its node's leader differ."""
    low = F.bit_count((F.col("b0").bitwiseXOR(F.col("l0"))).bitwiseOR(F.col("b2").bitwiseXOR(F.col("l2"))))
    high = F.bit_count((F.col("b1").bitwiseXOR(F.col("l1"))).bitwiseOR(F.col("b3").bitwiseXOR(F.col("l3"))))
    return low + high


def _sent(df: DataFrame, n: int) -> DataFrame:
    """A side of ``n`` counted rows, broadcast up to the limit."""
    return F.broadcast(df) if n <= MEMBERS else df


def candidate_links(
    classes: DataFrame,
    percent: int = PERCENT,
    trees: int = TREES,
    leaf: int = LEAF,
    depth: int | None = None,
    node: int = NODE,
) -> DataFrame:
    """Links (a, b) whose components hold every pair that shares a node and may be similar.

    Every tree starts with all sets and branches nodes of more than ``leaf`` sets; smaller ones are
    compared exhaustively. Nodes of more than ``node`` sets are branched level by level over all tasks, all others
    from there to their ends in one task each, in one job. A link may be returned more than once. In a
    node of more than ``leaf`` sets all meet its leader, the one of the
    smallest id: those whose briefs agree with the leader's are linked to it. Places in which briefs
    differ are a distance, so a set at distance x from the leader can be similar to another only if that lies
    within x plus the greatest distance of similar sets. Linked sets with no unlinked one so near
    leave the node, for all their pairs are in one component; a node of copies ends there, however large.
    The others branch on. Levels grow with the logarithm of the number of sets; a node that is still
    larger then becomes one cluster as it is, which loses nothing. A pair at
    the least similarity stays together in one child of a node on average.
    """
    least = least_equal(percent)
    reach = SIGNATURE - least
    # One byte of each place: sets move with what the rest of their branches needs.
    low = F.transform("signature", lambda x: (x.bitwiseAND(255) - F.when(x.bitwiseAND(128) > 0, 256).otherwise(0)).cast("tinyint"))
    sets = classes.select("rep", "signature", *BRIEF, low.alias("places"))
    leaders = classes.select(F.col("rep").alias("leader"), *[F.col(b).alias(f"l{i}") for i, b in enumerate(BRIEF)])
    roots = F.explode(F.array(*[F.xxhash64(F.lit(t), F.lit("tree")) for t in range(trees)]))
    level = sets.withColumn("path", roots)
    settled, smalls, deepest, d = [], [], depth or depth_for(classes.count(), node), 0
    n_open = 1
    while n_open:
        d += 1
        n_open = 0
        nodes = level.withColumn("path", F.explode(_branches(F.col("path"), F.col("signature"))))
        counts = nodes.groupBy("path").agg(F.count("*").alias("n"), F.min("rep").alias("leader"))
        large = written(counts.where(F.col("n") > node), "large-nodes")
        n_large = large.count()
        large = _sent(large, n_large)
        # Nodes within the limit wait for the end: one job finishes those of all levels. The first level is
        # read again from the classes, the few sets further down are written.
        small = nodes.select("path", "rep", "places").join(large.select("path"), "path", "left_anti")
        smalls.append(small if d == 1 else written(small, "small-nodes"))
        if n_large and d < deepest:
            known = written(large.join(leaders, "leader"), "node-leaders")
            met = nodes.join(_sent(known, n_large), "path").withColumn("away", _differing())
            linked = F.col("away") <= reach
            near = met.where(linked & (F.col("rep") != F.col("leader")))
            settled.append(written(near.select(F.col("rep").alias("a"), F.col("leader").alias("b")), "leader-links"))
            # The nearest set that is not linked to the leader decides who stays; none: the node is done.
            rest = met.groupBy("path").agg(F.min(F.when(~linked, F.col("away"))).alias("rest")).where("rest IS NOT NULL")
            rest = _sent(written(rest, "open-nodes"), n_large)
            staying = met.join(rest, "path").where(~linked | (F.col("rest") - F.col("away") <= reach))
            ids = written(staying.select("path", "rep"), "open-sets")
            n_open = ids.count()
            if n_open > MEMBERS >= n_large:
                # The sets stay where they are: the nodes to go on with were sent to them.
                level = staying.select("path", "rep", "signature", *BRIEF, "places")
            else:
                level = _sent(ids, n_open).join(sets, "rep")
        elif n_large:
            whole = nodes.join(large, "path").where("rep <> leader")
            settled.append(whole.select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    # Each node in one task. A node's path is a hash of its tree and level, too.
    small = by_group(reduce(DataFrame.unionByName, smalls), "path")
    return reduce(DataFrame.unionByName, settled, small.mapInArrow(_compare_nodes(least, leaf, depth), "a long, b long"))


def similar(sets: list[np.ndarray], percent: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union, from full sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    common = counts[at] > 1
    owner, at = owner[common], at[common]
    _, at = np.unique(at, return_inverse=True)
    both = np.zeros((n, n), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 8192):
        a, b = np.searchsorted(at, [low, low + 8192])
        m = np.zeros((n, 8192), np.float32)
        m[owner[a:b], at[a:b] - low] = 1
        both += m @ m.T
    inter = both.astype(np.int64)
    return 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)


def _verify(percent: int):
    """Verified links of each group, every set to the smallest id of its component there; with a column
    ``part``, rows of one part are not compared."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in sorted_groups(batches, 2):
            reps, parts, sets = zip(*sorted(rows, key=lambda row: row[0]), strict=True)
            if len(reps) > 1:
                linked = similar([s.view(np.uint64) for s in sets], percent)
                parts = np.array([-1 if p is None else p for p in parts])
                linked &= (parts[:, None] != parts[None, :]) | (parts[:, None] == -1)
                joined = LocalSets(len(reps))
                for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
                    joined.join(int(i), int(j))
                for i, r in enumerate(joined.roots()):
                    if reps[i] != reps[r]:
                        a.append(reps[i])
                        b.append(reps[r])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verify


def _full_sets(size: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(size)
        for batch in batches:
            hashes = [sets.of(t.as_py()).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cluster"), batch.column("rep"), batch.column("n"), pa.array(hashes, pa.list_(pa.int64()))],
                ["cluster", "rep", "n", "hashes"],
            )

    return full


def _links(groups: DataFrame, percent: int) -> DataFrame:
    """Groups of (cluster, block, rep, part, hashes) to verified links, written."""
    rows = by_group(groups.select("cluster", "block", "rep", "part", "hashes"), "cluster", "block")
    return written(rows.mapInArrow(_verify(percent), "a long, b long"), "verified-links", SET_ROWS)


def _flat(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links to first members, led on by ``new`` links between these, and the new ones: the components stay."""
    onward = new.select(F.col("a").alias("b"), F.col("b").alias("c"))
    led = links.join(_sent(onward, new.count()), "b", "left").select("a", F.coalesce("c", "b").alias("b"))
    return written(led.unionByName(new), "flat-links")


def verified_links(docs: DataFrame, clusters: DataFrame, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links with the components of all similar pairs inside each cluster, from full sets.

    Clusters of at most ``block`` sets and ``BLOCK_HASHES`` hashes are verified pair by pair in
    one group. A larger one is dealt into blocks, each verified within itself. Then the first members of the blocks'
    components are verified with each other. Where a cluster still has several components,
    the members outside its largest are verified with all blocks, so every pair of different
    components has been looked at.
    """
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    members = clusters.join(sizes, "component").select(F.col("component").alias("cluster"), F.col("node").alias("rep"), "n")
    # Few documents have candidates: their ids are counted and sent to the texts up to a limit,
    # beyond it the texts are shuffled to them.
    members = small_side(members, MEMBERS)
    texts = docs.join(members, docs["doc_id"] == members["rep"]).select("cluster", "rep", "n", "text")
    sets = written(texts.mapInArrow(_full_sets(size), "cluster long, rep long, n long, hashes array<bigint>"), "full-sets", 2000)
    held = F.greatest(F.count("*") / block, F.sum(F.size("hashes")) / BLOCK_HASHES)
    blocks = small_side(sets.groupBy("cluster").agg(F.ceil(held).cast("int").alias("blocks")), MEMBERS)
    none = F.lit(None).cast("long")
    sets = sets.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    links = _links(sets.withColumn("part", none), percent)
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return links
    # Every set is in one block: links lead to the first members of its components, and those are the heads.
    heads, new = large, links
    while True:
        heads = heads.join(_sent(new.select(F.col("a").alias("rep")).distinct(), new.count()), "rep", "left_anti")
        counts = heads.groupBy("cluster").agg(F.ceil(held).cast("int").alias("rounds"))
        dealt = heads.join(counts, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("rounds")).cast("int"))
        new = _links(dealt.withColumn("part", none), percent)
        if new.isEmpty():
            break
        links = _flat(links, new)
        if dealt.where("rounds > 1").isEmpty():
            break
    firsts = links.select(F.col("a").alias("rep"), F.col("b").alias("component"))
    parted = large.join(_sent(firsts, links.count()), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parted = written(parted, "parted-sets")
    weights = parted.groupBy("cluster", "component").agg(F.count("*").alias("w"))
    largest = weights.groupBy("cluster").agg(F.max_by("component", F.struct("w", "component")).alias("largest"), F.count("*").alias("k"))
    unsettled = small_side(largest.where("k > 1"), MEMBERS)
    if unsettled.isEmpty():
        return links
    open_sets = parted.join(unsettled, "cluster").withColumn("part", F.col("component"))
    outside = open_sets.where("component <> largest")
    chunks = outside.groupBy("cluster").agg(F.ceil(held).cast("int").alias("chunks"))
    # Every block meets every chunk of the members outside, in a group of its own.
    group = (F.col("block") * F.col("chunks") + F.col("chunk")).alias("block")
    columns = ["cluster", group, "rep", "part", "hashes"]
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    sides = open_sets.join(chunks, "cluster").withColumn("chunk", numbers("chunks"))
    dealt = outside.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("block", numbers("blocks"))
    return links.unionByName(_links(sides.select(*columns).unionByName(dealt.select(*columns)), percent))


def near_documents(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents with equal sets of ``size``-word shingles are one class with its smallest
    id; only classes are compared. Candidates come from chosen-path trees over
    minwise tokens and are confirmed on full sets. Null, empty and blank texts have no set and
    link with nothing; a text of fewer words is one shingle; a null id is left unlinked;
    repeated rows of an id get the same component; other columns are ignored.
    """
    texts = docs.select("doc_id", "text")
    columns = f"doc_id long, n_shingles long, key binary, signature array<int>, {', '.join(f'{b} long' for b in BRIEF)}"
    rows = written(texts.mapInArrow(_describe(size), columns), "signatures")
    usable = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
    mine = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    classes = written(
        usable.groupBy("key").agg(
            F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ["signature", *BRIEF]]
        ),
        "set-classes",
    )
    clusters = components(candidate_links(classes, percent))
    joined = components(verified_links(texts, clusters, size, percent)).withColumnRenamed("node", "rep")
    settled = classes.select("key", "rep").join(joined, "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = mine.join(settled, "key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near copies: that with the smallest id; columns unchanged.

    Repeated rows of an id leave the one of the smallest text, null first, ties by the smallest JSON of the row;
    rows with a null id all stay.
    """
    kept = near_documents(docs, size, percent).where("kept AND doc_id IS NOT NULL").select("doc_id")
    rows = docs.join(kept, "doc_id", "left_semi")
    # Only rows whose id is repeated move; the smallest of an id is found before the shuffle, too.
    repeated = small_side(docs.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1 AND doc_id IS NOT NULL").select("doc_id"), MEMBERS)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.min_by(whole, F.struct("text", F.to_json(whole)))
    several = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("__row")).select("__row.*")
    single = rows.join(repeated, "doc_id", "left_anti")
    return single.unionByName(several).unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def op8_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document by 2-word shingles at a similarity of 0.8."""
    return near_documents(table(spark, folder, "documents"), size=2)
