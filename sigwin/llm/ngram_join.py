"""Operator 3: n-gram Jaccard join with prefix trees.

Each document is the set of the hashes of its word n-grams.  All n-grams have one
global order: by how many documents hold them (counted over all documents in a sketch
of fixed size), then by hash.  Documents that link share an n-gram in the first
``n - ceil(t * n) + 1`` of both, so a set is filed under these only.  Where several
different sets share one, they are joined through a prefix tree: a traversal shares the
overlaps of common beginnings and leaves a subtree when the words that remain can't
reach the similarity, when its sizes don't fit, or when all in it are linked already.

Whole sets travel only where a link is possible.  A set's mark counts its n-grams by hash
range, about five to a range; two marks differ by no more than their sets do, so sets whose
marks differ by more than the similarity allows can't link, and of the members of a group
only those go to its tree that some mark fits.

Copies are one node.  First each set is joined with one member (the hub) of each of
its groups; groups that are not linked by that are joined in full, the members outside
the largest component against all, in blocks of bounded size.  So a large group of near copies costs about its size, and no group is
ever one task's or one row per pair.  Only links between sets not linked yet are
returned, which loses no component.

Hashes have 64 bits.  Defined results: null and empty texts, and texts without words,
have the empty set and are linked with nothing; texts of fewer words than the n-gram
have one n-gram, all their words; a row with a null doc_id has no component but counts
as a text; rows with one doc_id are separate texts; repeated rows share a component;
texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigwin.llm.common import added_up, arrow_schema, broadcast_if_small, slices, stored, task_batch
from sigwin.llm.components import components

#: Counters of the sketch: 2 ** 21 of 4 bytes are 8 MiB, whatever the input.
SKETCH_BITS = 21
SKETCH_CHUNK = 1 << 16
#: Sets of a block, and n-grams of its sets together (one longer set is a block alone); a task holds two blocks.
BLOCK = 64
BLOCK_GRAMS = 1 << 17
#: Fewest ranges of a mark.
MARK_RANGES = 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _FACTOR + h[k:len(h) - size + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(s: np.ndarray) -> int:
    """The node of a set: a hash of its members."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def mark_of(s: np.ndarray) -> bytes:
    """Counts (up to 255) of the set's members by equal hash ranges, a power of two of them by its size."""
    bits = (max(MARK_RANGES, 1 << max(len(s).bit_length() - 3, 0)) - 1).bit_length()
    held = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(held, 255).astype(np.uint8).tobytes()


def may_link(sizes: np.ndarray, marks: list[bytes], labels: np.ndarray, probe: np.ndarray,
             percent: int) -> np.ndarray:
    """Which sets may link with a probe of another label, or are such probes: no link is between others.

    The counts differ by at most the size of the symmetric difference, also when cut off at
    255 or added up to the ranges of a shorter mark.
    """
    keep = np.zeros(len(sizes), bool)
    counts = [np.frombuffer(m, np.uint8).astype(np.int32) for m in marks]
    width = np.array([len(m) for m in marks])
    for w in np.unique(width):
        # Two marks are compared at the width of the shorter one.
        at = np.flatnonzero(width >= w)
        level = np.stack([counts[i].reshape(w, -1).sum(axis=1) for i in at])
        n = sizes[at]
        for x in np.flatnonzero(probe[at]):
            i = at[x]
            fits = ((labels[at] != labels[i]) & ((width[at] == w) | (width[i] == w))
                    & (100 * np.minimum(n, sizes[i]) >= percent * np.maximum(n, sizes[i])))
            y = np.flatnonzero(fits)
            gap = np.abs(level[y] - level[x]).sum(axis=1)
            near = y[(100 + percent) * gap <= (100 - percent) * (n[y] + sizes[i])]
            keep[at[near]] = True
            keep[i] |= len(near) > 0
    return keep


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


class PrefixTree:
    """A compressed trie of ascending rank sequences with sizes and labels of its subtrees.

    A tree node is a list: [ranks of its segment (frozenset), last rank, children,
    members that end here, smallest size, largest size, most ranks below, label or None].
    """

    def __init__(self, sets: list[tuple[int, ...]], find: Callable[[int], int]) -> None:
        self.find, self.size = find, [len(s) for s in sets]
        order = sorted(range(len(sets)), key=sets.__getitem__)
        self.root = self._build(sets, order, 0, 0, len(order))

    def _build(self, sets: list[tuple[int, ...]], order: list[int], depth: int, lo: int, hi: int) -> list:
        """Builds with an explicit stack, so deep trees are no deep recursion."""
        root: list = [frozenset(), -1, [], [], 0, 0, 0, None]
        made, stack = [], [(root, depth, lo, hi)]
        while stack:
            node, depth, lo, hi = stack.pop()
            made.append(node)
            while lo < hi and len(sets[order[lo]]) == depth:
                node[3].append(order[lo])
                lo += 1
            while lo < hi:
                head = sets[order[lo]][depth]
                end = lo + 1
                while end < hi and sets[order[end]][depth] == head:
                    end += 1
                first, last = sets[order[lo]], sets[order[end - 1]]
                stop = depth + 1
                # Sequences are sorted: what first and last share, all between them share.
                while stop < len(first) and stop < len(last) and first[stop] == last[stop]:
                    stop += 1
                child: list = [frozenset(first[depth:stop]), first[stop - 1], [], [], 0, 0, 0, None]
                node[2].append(child)
                stack.append((child, stop, lo, end))
                lo = end
        for node in reversed(made):
            sizes = [self.size[i] for i in node[3]]
            low = sizes + [c[4] for c in node[2]]
            node[4], node[5] = (min(low), max(sizes + [c[5] for c in node[2]])) if low else (0, 0)
            node[6] = max([0] + [len(c[0]) + c[6] for c in node[2]])
            labels = {self.find(i) for i in node[3]} | {c[7] for c in node[2]}
            node[7] = labels.pop() if len(labels) == 1 else None
        return root

    def partners(self, i: int, s: tuple[int, ...], percent: int) -> Iterator[int]:
        """Members that link with set ``i`` and had another label when their subtree was reached."""
        own, n, find = frozenset(s), len(s), self.find
        least = -(-percent * n // 100)
        stack = [(self.root, 0)]
        while stack:
            (segment, last, children, ends, small, large, below, label), overlap = stack.pop()
            if large < least or 100 * n < percent * small or (label is not None and find(label) == find(i)):
                continue
            overlap += len(own & segment)
            rest = min(n - bisect_right(s, last), below)
            if (100 + percent) * (overlap + rest) < percent * (n + max(small, least)):
                continue
            for j in ends:
                if find(j) != find(i) and linked(overlap, n, self.size[j], percent):
                    yield j
            stack += [(child, overlap) for child in children]


def tree_join(nodes: list[int], sets: list[np.ndarray], labels: list[int], probes: Iterable[int],
              percent: int) -> list[tuple[int, int]]:
    """Links of ``probes`` (places in ``nodes``) with all sets, as few as join the same components.

    ``labels`` are the components known before; sets of one label are not compared.
    """
    parent: dict[int, int] = {}
    first = {}
    for i, label in enumerate(labels):
        parent[i] = first.setdefault(label, i)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    # Within the group the most frequent n-grams come first: so beginnings are shared the most.
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), dtype=np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
    ends = np.cumsum([len(s) for s in sets])
    # One Python integer for each rank, which all sets share.
    shared = np.arange(len(times)).astype(object)
    ranked = [tuple(shared[np.sort(r)]) for r in np.split(rank[which], ends[:-1])] if sets else []
    tree, out = PrefixTree(ranked, find), []
    for i in probes:
        for j in tree.partners(i, ranked[i], percent):
            if find(i) != find(j):
                parent[find(j)] = find(i)
                out.append((nodes[i], nodes[j]))
    return out


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """For each hash range (top ``SKETCH_BITS`` bits) the number of documents' n-grams in it."""
    schema = "chunk int, batch int, at binary, n binary"
    arrow = arrow_schema(schema)
    size = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, batch = np.zeros(size, np.uint32), task_batch()
        for b in slices(batches):
            held = np.concatenate([shingles(t, n) for t in b.column(0).to_pylist()])
            np.add.at(counts, (held >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        for chunk in range(0, size, SKETCH_CHUNK):
            at = np.flatnonzero(counts[chunk:chunk + SKETCH_CHUNK])
            if len(at):
                yield pa.RecordBatch.from_pydict({
                    "chunk": [chunk], "batch": [batch], "at": [at.astype("<u2").tobytes()],
                    "n": [counts[chunk + at].astype("<u4").tobytes()]}, schema=arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(SKETCH_CHUNK, np.uint32), 0
        for b in batches:
            for i in range(b.num_rows):
                chunk = b["chunk"][i].as_py()
                total[np.frombuffer(b["at"][i].as_py(), "<u2")] += np.frombuffer(b["n"][i].as_py(), "<u4")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({
            "chunk": [chunk], "batch": [0], "at": [at.astype("<u2").tobytes()],
            "n": [total[at].astype("<u4").tobytes()]}, schema=arrow)

    out = np.zeros(size, np.uint32)
    for row in added_up(docs.select("text").mapInArrow(run, schema), schema, add).toLocalIterator():
        out[row["chunk"] + np.frombuffer(row["at"], "<u2").astype(np.int64)] = np.frombuffer(row["n"], "<u4")
    return out


def _batches_of(rows: Iterator[tuple], schema: str, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    arrow, held = arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types,
                                                                             strict=True)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types,
                                                                         strict=True)], schema=arrow)


def document_nodes(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, node, n, mark, key)`` for each row of ``(doc_id, text, key)``; the empty set has no node."""
    schema = "doc_id long, node long, n long, mark binary, key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc_id, text, key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingles(text, n)
                rows.append((doc_id, node_of(s) if len(s) else None, len(s), mark_of(s), key))
            yield from _batches_of(iter(rows), schema)

    return docs.mapInArrow(run, schema)


def _filed(docs: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """``(gram, node, n)``: each set under the first n-grams in the global order; once a task for copies."""
    schema = "gram long, node long, n long"
    arrow, counts = arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            grams, nodes, sizes = [], [], []
            for text in b.column(0).to_pylist():
                s = shingles(text, n)
                node = node_of(s) if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                first = len(s) - -(-percent * len(s) // 100) + 1
                weight = counts.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                grams.append(s[np.lexsort((s, weight))[:first]].view(np.int64))
                nodes.append(np.full(first, node))
                sizes.append(np.full(first, len(s)))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams, nodes, sizes)],
                                                 schema=arrow)

    return docs.select("text").mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``(node, members)`` of the wanted ``(node, key)`` pairs; a repeated key may repeat its node, once a task."""
    schema = "node long, members binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            rows = []
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node in seen:
                    continue
                s = shingles(text, n)
                if len(s) and node_of(s) == node:
                    seen.add(node)
                    rows.append((node, s.tobytes()))
            yield from _batches_of(iter(rows), schema, 2_000)

    return docs.join(broadcast_if_small(wanted), "key").select("node", "text").mapInArrow(run, schema)


def _possible(cells: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The rows of ``cells`` that may link within their cell, by ``marks`` ``(node, n, mark)``."""
    columns = cells.columns
    keys = [c for c in columns if c not in ("node", "label", "probe")]

    def pick(rows: pa.Table) -> pa.Table:
        sizes, labels, probe = (rows[c].to_numpy() for c in ("n", "label", "probe"))
        keep = may_link(sizes, rows["mark"].to_pylist(), labels, probe, percent)
        return rows.select(columns).filter(pa.array(keep))

    return marks.join(broadcast_if_small(cells), "node").groupBy(*keys).applyInArrow(pick, cells.schema)


def _joined(cells: DataFrame, docs: DataFrame, wanted: DataFrame, n: int, percent: int) -> DataFrame:
    """Tree join of each cell: rows ``(key.., node, label, probe)`` -> ``(a, b)``.

    ``wanted`` has each node's size, mark and the key of a document that holds its set.
    """
    cells = stored(_possible(stored(cells, "cells"), wanted.select("node", "n", "mark"), percent), "possible")
    held = stored(wanted.join(cells.select("node").distinct(), "node").select("node", "key"), "held")

    def join(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("node", "ascending")])
        nodes, labels, probe = (rows[c].to_pylist() for c in ("node", "label", "probe"))
        sets = [np.frombuffer(m, np.uint64) for m in rows["members"].to_pylist()]
        found = tree_join(nodes, sets, labels, [i for i, p in enumerate(probe) if p], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                         "b": pa.array([y for _, y in found], pa.int64())})

    keys = [c for c in cells.columns if c not in ("node", "label", "probe")]
    sets = _sets(docs, held, n)
    return sets.join(broadcast_if_small(cells), "node").groupBy(*keys).applyInArrow(join, "a long, b long")


def _groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``(group, node, n, degree)``: nodes that share a filed n-gram and whose sizes may fit.

    Sizes are cut into classes of the ratio ``percent``; sets that link are in one class
    or in neighbouring ones, so each set is in its class and the next.  Of groups with the
    same members one stays.
    """
    # Dealt by gram once: the aggregate and the join read the same exchange, for which both
    # must read the same columns, n too.
    filed = _filed(docs, n, percent, _sketch(docs, n)).repartition("gram")
    shared = (filed.groupBy("gram").agg(F.min("node").alias("least"), F.max("node").alias("most"),
                                        F.max("n").alias("size")).where("least < most AND size > 0").select("gram"))
    sized = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9)
    both = F.explode(F.array(sized, sized + 1))
    # 64 bits: a collision joins two groups, which costs a comparison and loses none.
    filed = (filed.join(shared, "gram").select("gram", "node", "n", both.alias("class"))
             .select(F.xxhash64("gram", "class").alias("group"), "node", "n").distinct())
    filed = stored(filed, "filed")
    marks = (filed.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("least"),
                                        F.bit_xor(F.xxhash64("node")).alias("x"),
                                        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("members > 1"))
    kept = marks.groupBy("members", "least", "x", "y").agg(F.min("group").alias("group")).select("group", "members")
    filed = filed.join(kept, "group")
    # The text that others were made from shares the most with them: it makes the best hub.
    degree = filed.groupBy("node").agg(F.sum("members").alias("degree"))
    return stored(filed.drop("members").join(degree, "node"), "groups")


def _labelled(groups: DataFrame, known: DataFrame | None) -> DataFrame:
    """``groups`` that are not under one label yet, with labels and a hub, the member of the largest degree.

    Ties have one order, so that a task that runs again, or a plan read twice, takes the same hub.
    """
    label = F.col("node") if known is None else F.coalesce("component", "node")
    rows = groups if known is None else groups.join(known, "node", "left")
    rows = rows.select("group", "node", "n", label.alias("label"), "degree")
    hubs = (rows.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                      F.max(F.struct("degree", "node", "n")).alias("hub"))
            .where("lo < hi").select("group", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")))
    return rows.drop("degree").join(hubs, "group")


def links(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``(a, b)``: links between different nodes, enough to give their components."""
    groups = _groups(docs, n, percent)
    holders = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.coalesce(F.min("doc_id"), F.min("key")).alias("key"))
    holders = groups.select("node").distinct().join(holders, "node")
    # Rows without doc_id that are copies have one key: one of them is enough.
    nameless = rows.where("node IS NOT NULL AND doc_id IS NULL").dropDuplicates(["node", "key"])
    named = rows.where("doc_id IS NOT NULL").unionByName(nameless)
    wanted = stored(named.join(holders, ["node", "key"]).dropDuplicates(["node"]), "wanted")

    # A star around each group's hub: its members with the hub, if their sizes fit.
    spread = _labelled(groups, None)
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    spokes = _parts(spread.where(fits & (F.col("node") != F.col("hub"))).select("hub", "node", "n").distinct())
    heads = spokes.select("hub", "part", F.col("hub").alias("node")).distinct()
    star = spokes.withColumn("probe", F.lit(False)).unionByName(heads.withColumn("probe", F.lit(True)))
    found = stored(_joined(star.withColumn("label", F.col("node")), docs, wanted, n, percent), "star-links")
    # Nodes linked with one hub are in one component: the label is the hub with most links.
    linked_hubs = found.groupBy(F.col("a").alias("hub")).agg(F.count(F.lit(1)).alias("size"))
    either = found.select("a", F.col("b").alias("node")).unionByName(found.select("a", F.col("a").alias("node")))
    known = stored(either.withColumnRenamed("a", "hub").join(linked_hubs, "hub").groupBy("node").agg(
        F.max(F.struct("size", "hub")).alias("most")).select("node", F.col("most.hub").alias("component")), "known")

    # What is left in full: all members but those of the group's largest component against all
    # members.  Groups around one component are one group here, so no pair is compared over and over.
    spread = _labelled(groups, known).select("group", "node", "n", "label")
    largest = (spread.groupBy("group", "label").agg(F.count(F.lit(1)).alias("size"))
               .groupBy("group").agg(F.max(F.struct("size", "label")).alias("most"))
               .select("group", F.col("most.label").alias("largest"), F.col("most.size").alias("size")))
    around = F.when(F.col("size") > 1, F.col("largest")).otherwise(F.col("group"))
    spread = spread.join(largest, "group").select(
        around.alias("group"), "node", "n", "label", (F.col("label") != F.col("largest")).alias("probe")).distinct()
    own = F.col("probe").cast("long")
    sizes = spread.groupBy("group").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("members"),
                                        _blocks(F.sum(own), F.sum(own * F.col("n"))).alias("probes"))
    spread = spread.join(sizes, "group")

    def every(size: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(size) - 1))

    def mine(size: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(size)).cast("int")

    cells = spread.select("group", mine("members").alias("i"), every("probes").alias("j"), "node", "label",
                          F.lit(False).alias("probe")).unionByName(
        spread.where("probe").select("group", every("members").alias("i"), mine("probes").alias("j"), "node", "label",
                                     F.lit(True).alias("probe")))
    # A probe may be among the members of its cell: it is one set there.
    cells = cells.groupBy("group", "i", "j", "node").agg(F.min("label").alias("label"), F.max("probe").alias("probe"))
    return found.unionByName(stored(_joined(cells, docs, wanted, n, percent), "tree-links"))


def _blocks(sets: Column, grams: Column, most: int = 1) -> Column:
    """Into how many parts ``sets`` sets of ``grams`` n-grams are cut, for ``most`` blocks a part."""
    return F.ceil(F.greatest(sets / (most * BLOCK), grams / (most * BLOCK_GRAMS))).cast("int")


def _parts(spokes: DataFrame) -> DataFrame:
    """``spokes`` ``(hub, node, n)`` with ``part`` for ``n``: a hub's are cut into parts of about four blocks."""
    sizes = spokes.groupBy("hub").agg(_blocks(F.count(F.lit(1)), F.sum("n"), 4).alias("parts"))
    return spokes.join(sizes, "hub").select("hub", "node",
                                            F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # A row's text is fetched again by its key: the doc_id, or without one the text's hash.
    docs = docs.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    rows = stored(document_nodes(docs, n), "nodes")
    known = components(links(docs, rows, n, percent))
    # Each node's smallest doc_id, and of these the smallest of the component.
    nodes = (rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
             .join(known, "node", "left").withColumn("component", F.coalesce("component", "node")))
    nodes = stored(nodes, "labelled")
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = nodes.join(least, "component").select("node", "component_id")
    found = rows.join(by_node, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which no other row of the component has a smaller doc_id.

    Rows without doc_id stay.  Of rows that share the smallest doc_id, all stay (exact
    dedup goes before).
    """
    found = jaccard_components(docs, n, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
