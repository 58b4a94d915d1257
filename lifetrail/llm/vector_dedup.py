"""Near-duplicate vectors by search in a robust-pruned flat graph.

Rows are compared when their labels are equal and not null, by cosine in
double precision; rows with cosine ``threshold`` or more are linked.

1. Equal vectors of a label are one node with a multiplicity.
2. Overlapping cluster shards: the nodes with the smallest content digests
   are the pivots (at most ``MAX_CELLS``); a node belongs to its nearest
   pivots' cells, ``overlap`` of them and all within ``margin`` of the best
   product.  A cell larger than ``group`` rows is dealt into blocks, and
   every two blocks are a group of their own, so no group grows with a hot
   label or a cluster of near copies.
3. Flat graph: each group links its nodes by insertion in growing batches.
   A batch is searched in the graph so far and robustly pruned (a candidate
   goes when a kept neighbour is ``ALPHA`` times nearer to it than the node
   is); back edges are added and pruned alike.  A node's lists of all groups
   are united, so a search also uses edges that other shards found.
4. Range-expanding greedy search: from the group's medoid a beam walks
   towards each node; nodes within the threshold are then expanded until
   their neighbours are out of range.  Every query is itself a node: a walk
   that does not arrive there is repeated with a beam of ``WIDER`` times the
   width, and one that still fails starts at its own node.
5. Verification: what the search joins within a group, directly or through
   others, is compared in double precision; pairs below the threshold are no
   links.  A pair that two groups hold counts in the first cell that holds
   both.  A group returns link counts and a
   spanning forest, never its pairs.
6. Audit: ``AUDIT`` nodes (smallest digests) are compared with all nodes.
   While the links found are less than ``recall`` of theirs, cells overlap
   twice as far and beams are twice as wide; with every node in every cell
   and a beam of a whole group's size the search is exhaustive.
7. Components are those of the forest's links, in Spark.

Defined cases: rows whose label is null or whose vector is null, empty, zero
or holds null or non-finite components link with nothing; vectors of
different lengths are not linked.  Repeated rows and repeated ids are
vectors of their own, linked when near; a component is named by its smallest
id that is not null (null if there is none).  Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifetrail.llm.common import materialise
from lifetrail.llm.near_dedup import components
from lifetrail.llm.textbytes import mix

THRESHOLD = 0.98
#: Nodes of a cell that are aimed at, cells at most, and rows of a cell's block.
CELL, MAX_CELLS, GROUP = 768, 256, 2048
OVERLAP, MARGIN = 2, 0.05
DEGREE, BEAM, ALPHA, WIDER = 24, 24, 1.2, 4
#: Queries that walk together.
QUERIES = 512
AUDIT, RECALL = 64, 0.999
#: Slack of single precision while searching; links are verified in double precision.
SLACK = 1e-5


# ---------------------------------------------------------------- graph
class Graph:
    """Unit vectors (rows of ``x``) and at most ``degree`` neighbours of each (-1: none)."""

    def __init__(self, x: np.ndarray, degree: int):
        self.x = x.astype(np.float32)
        self.edges = np.full((len(x), degree), -1, np.int32)
        self.medoid = int(np.argmax(self.x @ self.x.mean(axis=0))) if len(x) else 0

    def walk(self, queries: np.ndarray, beam: int, least: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy search from the medoid for the nodes ``queries``: beams
        (nearest first, -1: none), what was met, and what of it has a product
        of at least ``least`` (also where the beam has no room for it)."""
        x, edges, q = self.x, self.edges, len(queries)
        met, close = np.zeros((q, len(x)), bool), np.zeros((q, len(x)), bool)
        ids, sims, done = np.full((q, beam), -1, np.int32), np.full((q, beam), -np.inf, np.float32), np.ones((q, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = self.medoid, x[queries] @ x[self.medoid], False
        met[:, self.medoid] = True
        close[:, self.medoid] = sims[:, 0] >= least
        active = np.arange(q)
        while active.size:
            first = np.argmin(done[active], axis=1)
            going = ~done[active, first]
            active, first = active[going], first[going]
            if not active.size:
                break
            done[active, first] = True
            near = edges[ids[active, first]]
            new = (near >= 0) & ~met[active[:, None], near]
            row, col = np.nonzero(new)
            met[active[row], near[row, col]] = True
            sim = np.full(near.shape, -np.inf, np.float32)
            sim[row, col] = np.einsum("nd,nd->n", x[near[row, col]], x[queries[active[row]]])
            here = sim[row, col] >= least
            close[active[row[here]], near[row[here], col[here]]] = True
            all_ids, all_sims = np.concatenate([ids[active], np.where(new, near, -1)], axis=1), np.concatenate([sims[active], sim], axis=1)
            all_done = np.concatenate([done[active], ~new], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active], sims[active] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
            done[active] = np.take_along_axis(all_done, order, 1)
        return ids, met, close

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        """Robust pruning: the nodes' new neighbours, of rows of distinct candidates (-1: none)."""
        x, degree = self.x, self.edges.shape[1]
        for at in range(0, len(nodes), QUERIES):
            p, c = nodes[at:at + QUERIES], candidates[at:at + QUERIES]
            far = np.maximum(2 - 2 * np.einsum("ncd,nd->nc", x[c], x[p]), 0)
            far[(c < 0) | (c == p[:, None])] = np.inf
            order = np.argsort(far, axis=1, kind="stable")
            c, far = np.take_along_axis(c, order, 1), np.take_along_axis(far, order, 1)
            held = x[c]
            between = np.maximum(2 - 2 * np.matmul(held, held.transpose(0, 2, 1)), 0)
            alive, kept = np.isfinite(far), np.zeros(len(p), np.int64)
            out = np.full((len(p), degree), -1, np.int32)
            for i in range(c.shape[1]):
                take = np.flatnonzero(alive[:, i] & (kept < degree))
                out[take, kept[take]] = c[take, i]
                kept[take] += 1
                alive[take] &= ALPHA * ALPHA * between[take, i] > far[take]
            self.edges[p] = out

    def _unique(self, candidates: np.ndarray) -> np.ndarray:
        c = np.sort(candidates, axis=1)[:, ::-1]
        c = np.where(np.concatenate([np.zeros((len(c), 1), bool), c[:, 1:] == c[:, :-1]], axis=1), -1, c)
        return np.ascontiguousarray(c)

    def insert(self, order: np.ndarray, beam: int) -> None:
        """Insert all nodes, in batches that double in size up to ``QUERIES``."""
        degree = self.edges.shape[1]
        order = np.concatenate([[self.medoid], order[order != self.medoid]]).astype(np.int32)
        at = min(len(order), degree + 1)
        start = order[:at]
        self.prune(start, np.broadcast_to(start, (at, at)).copy())
        while at < len(order):
            batch = order[at:at + min(at, QUERIES)]
            found, _, _ = self.walk(batch, beam)
            few = np.broadcast_to(batch, (len(batch), len(batch))) if len(batch) <= beam else self._mates(batch, beam)
            self.prune(batch, self._unique(np.concatenate([found, few], axis=1)))
            self._back(batch)
            at += len(batch)

    def _mates(self, batch: np.ndarray, most: int) -> np.ndarray:
        """Of the nodes that are inserted together (and so cannot find each other by walking), each one's nearest."""
        sim = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(sim, -np.inf)
        return batch[np.argpartition(-sim, most - 1, axis=1)[:, :most]]

    def _back(self, batch: np.ndarray) -> None:
        source, target = np.repeat(batch, self.edges.shape[1]), self.edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, n = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, n)
        most = self.edges.shape[1]
        for lo in range(0, int(n.max(initial=0)), most):  # the new edges of a node, some at a time
            part = (place >= lo) & (place < lo + most)
            row = np.searchsorted(nodes, target[part])
            new = np.full((len(nodes), most), -1, np.int32)
            new[row, place[part] - lo] = source[part]
            touched = np.flatnonzero((new >= 0).any(axis=1))
            self.prune(nodes[touched], self._unique(np.concatenate([self.edges[nodes[touched]], new[touched]], axis=1)))

    def in_range(self, queries: np.ndarray, beam: int, least: float) -> np.ndarray:
        """The nodes (queries x nodes) that the search finds with products of at least ``least``."""
        _, met, found = self.walk(queries, beam, least)
        own = np.arange(len(queries))
        lost = np.flatnonzero(~met[own, queries])
        if lost.size and beam < len(self.x):
            _, met[lost], found[lost] = self.walk(queries[lost], min(len(self.x), beam * WIDER), least)
        found[own, queries] = met[own, queries] = True
        row, node = np.nonzero(found)
        while row.size:  # expand what is in range
            key = []
            for at in range(0, len(row), 1 << 16):
                near = self.edges[node[at:at + (1 << 16)]]
                r = np.broadcast_to(row[at:at + (1 << 16), None], near.shape)
                new = (near >= 0) & ~met[r, near]
                r, near = r[new], near[new]
                met[r, near] = True
                key.append(np.unique(r.astype(np.int64) * len(self.x) + near))
            key = np.unique(np.concatenate(key))
            row, node = np.divmod(key, len(self.x))
            close = np.zeros(len(key), bool)
            for at in range(0, len(key), 1 << 16):
                part = slice(at, at + (1 << 16))
                close[part] = np.einsum("nd,nd->n", self.x[queries[row[part]]], self.x[node[part]]) >= least
            row, node = row[close], node[close]
            found[row, node] = True
        return found


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root (smallest member) of each of n nodes under the links a, b."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


# ---------------------------------------------------------------- tasks
def _vectors(rows, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), dim)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; dividing by the largest component first keeps squares finite."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


def _read(batches):
    """``vec_id, label, dim, digest, v``: what takes no part has no digest."""
    for batch in batches:
        digest, data, dims = [], [], []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist()):
            x = np.array(v, np.float64) + 0.0 if label is not None and v else np.zeros(0)
            good = len(x) and bool(np.isfinite(x).all()) and bool(x.any())
            data.append(x.astype("<f8").tobytes() if good else None)
            digest.append(hashlib.blake2b(data[-1], digest_size=16).digest() if good else None)
            dims.append(len(x) if good else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(digest, pa.binary()), pa.array(data, pa.binary())],
                                         names=["vec_id", "label", "dim", "digest", "v"])


def _cells(pivots: np.ndarray, overlap: int, margin: float):
    words = max(1, -(-len(pivots) // 64))

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            member = np.zeros((batch.num_rows, max(1, len(pivots))), bool)
            member[:, 0] = True
            if len(pivots) > 1:
                usual = np.flatnonzero(dims == pivots.shape[1])
                if len(usual):
                    data = batch.column("v").to_pylist()
                    sim = _unit(_vectors([data[i] for i in usual], pivots.shape[1])) @ pivots.T
                    rank = np.argsort(np.argsort(-sim, axis=1, kind="stable"), axis=1)
                    member[usual] = (rank < overlap) | (sim >= sim.max(axis=1, keepdims=True) - margin)
            bits = np.zeros((batch.num_rows, words), np.uint64)
            for c in range(member.shape[1]):
                bits[:, c // 64] |= member[:, c].astype(np.uint64) << np.uint64(c % 64)
            row, cell = np.nonzero(member)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("node", "label", "dim", "m", "v")), pa.array(cell, pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()).take(take)],
                                             names=["node", "label", "dim", "m", "v", "cell", "cells"])
    return run


def _ordered(group: pa.Table) -> pa.Table:
    return group.take(pa.array(np.argsort(group.column("node").to_numpy(), kind="stable")))


def _link(degree: int, beam: int):
    def run(group: pa.Table) -> pa.Table:
        group = _ordered(group)
        ids = group.column("node").to_numpy()
        graph = Graph(_unit(_vectors(group.column("v").to_pylist(), group.column("dim")[0].as_py())), degree)
        graph.insert(np.argsort(mix(ids.astype(np.uint64)), kind="stable"), beam)
        near = [ids[e[e >= 0]].astype("<i8").tobytes() for e in graph.edges]
        return pa.table({"node": pa.array(ids), "near": pa.array(near, pa.binary())})
    return run


def _restrict(graph: Graph, ids: np.ndarray, lists: list[bytes]) -> None:
    """The united lists of a group's nodes, cut to the group."""
    row = np.repeat(np.arange(len(ids)), [len(b) // 8 for b in lists])
    to = np.frombuffer(b"".join(lists), "<i8")
    place = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    inside = (ids[place] == to) & (place != row)
    key = np.unique(row[inside].astype(np.int64) * len(ids) + place[inside])
    row, place = np.divmod(key, len(ids))
    n = np.bincount(row, minlength=len(ids))
    graph.edges = np.full((len(ids), max(1, int(n.max(initial=0)))), -1, np.int32)
    graph.edges[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = place


def _search(threshold: float, beam: int):
    def run(group: pa.Table) -> pa.Table:
        group = _ordered(group)
        ids, sub, m = (group.column(c).to_numpy() for c in ("node", "sub", "m"))
        x = _unit(_vectors(group.column("v").to_pylist(), group.column("dim")[0].as_py()))
        cell, qb, tb = (group.column(c)[0].as_py() for c in ("cell", "qb", "tb"))
        cells = np.frombuffer(b"".join(group.column("cells").to_pylist()), np.uint64).reshape(len(ids), -1).copy()
        cells[:, cell // 64] &= np.uint64((1 << (cell % 64)) - 1)  # cells before this one
        cells[:, cell // 64 + 1:] = 0
        graph = Graph(x, 1)
        _restrict(graph, ids, group.column("near").to_pylist())
        found = np.zeros((len(ids), len(ids)), bool)
        for at in range(0, len(ids), QUERIES):
            queries = np.arange(at, min(at + QUERIES, len(ids)))
            found[queries] = graph.in_range(queries, min(beam, len(ids)), threshold - SLACK)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        joined = forest(*np.nonzero(found), len(ids))
        order = np.argsort(joined, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(joined[order])) + 1):
            for at in range(0, len(members) if len(members) > 1 else 0, QUERIES):
                a, b = np.nonzero(x[members[at:at + QUERIES]] @ x[members].T >= threshold)
                a, b = members[a + at], members[b]
                a, b = a[a < b], b[a < b]
                root = forest(root[a], root[b], len(ids))[root]
                mine = ~(cells[a] & cells[b]).any(axis=1) & (np.minimum(sub[a], sub[b]) == qb) & (np.maximum(sub[a], sub[b]) == tb)
                a, b = a[mine], b[mine]
                np.add.at(links, a, m[b])
                np.add.at(links, b, m[a])
        some, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"node": pa.array(np.concatenate([ids[some], ids[joined]])), "links": pa.array(np.concatenate([links[some], np.zeros(len(joined), np.int64)])),
                         "root": pa.array([*([None] * len(some)), *ids[root[joined]].tolist()], pa.int64())})
    return run


def _exact(asked: list, threshold: float):
    """Links of the audited nodes to the nodes of a task."""
    by_kind: dict = {}
    for node, label, dim, v in asked:
        by_kind.setdefault((label, dim), []).append((node, v))
    by_kind = {k: (np.array([n for n, _ in rows]), _unit(_vectors([v for _, v in rows], k[1]))) for k, rows in by_kind.items()}

    def run(batches):
        for batch in batches:
            kind = {}
            for i, k in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())):
                if k in by_kind:
                    kind.setdefault(k, []).append(i)
            ids, m, data = batch.column("node").to_numpy(), batch.column("m").to_numpy(), batch.column("v")
            for k, at in kind.items():
                nodes, x = by_kind[k]
                near = _unit(_vectors(data.take(pa.array(at)).to_pylist(), k[1])) @ x.T >= threshold
                near &= ids[at][:, None] != nodes[None]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array((near * m[at][:, None]).sum(axis=0))], names=["node", "links"])
    return run


# ---------------------------------------------------------------- whole table
def _nodes(read: DataFrame) -> DataFrame:
    """``node, label, dim, digest, v, m, first_id``: the distinct vectors of a label."""
    one = read.where("digest is not null").groupBy("label", "digest").agg(F.first("dim").alias("dim"), F.first("v").alias("v"), F.count("*").alias("m"), F.min("vec_id").alias("first_id"))
    return materialise(one.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")


def _groups(members: DataFrame, group: int) -> DataFrame:
    """``members`` once for each group they are in: ``qb, tb`` of a cell's blocks."""
    sizes = members.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks"))
    sizes = sizes.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("cell").alias("c"), "blocks")
    dealt = members.join(sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c"))).drop("l", "d", "c")
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("qb", F.least("sub", "other")).withColumn("tb", F.greatest("sub", "other")).drop("other", "blocks")


def search(nodes: DataFrame, pivots: np.ndarray, overlap: int, margin: float, beam: int, threshold: float = THRESHOLD, degree: int = DEGREE, group: int = GROUP) -> DataFrame:
    """``node, links, root``: link counts (to add up), and links to roots, from one build and search of the graph."""
    label = nodes.schema["label"].dataType.simpleString()
    row = f"node long, label {label}, dim int, m long, v binary, cell int, cells binary"
    members = nodes.select("node", "label", "dim", "m", "v").mapInArrow(_cells(pivots, overlap, margin), row)
    grouped = materialise(_groups(materialise(members, "vector-members"), group), "vector-groups")
    keys = ("label", "dim", "cell", "qb", "tb")
    lists = grouped.groupBy(*keys).applyInArrow(_link(degree, beam), "node long, near binary")
    # at most ``degree`` edges from each of a node's groups
    flat = materialise(lists.groupBy("node").agg(F.collect_list("near").alias("near")).select("node", F.expr("aggregate(near, X'', (a, x) -> a || x)").alias("near")), "vector-graph")
    found = grouped.join(flat, "node").groupBy(*keys).applyInArrow(_search(threshold, beam), "node long, links long, root long")
    return materialise(found, "vector-links")


def link_table(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, max_cells: int = MAX_CELLS, overlap: int = OVERLAP, margin: float = MARGIN, beam: int = BEAM,
               degree: int = DEGREE, group: int = GROUP, recall: float = RECALL, audit: int = AUDIT) -> tuple[DataFrame, float]:
    """``vec_id, n_links, component_id, kept`` of every row, and the audited recall."""
    label = vectors.schema["label"].dataType.simpleString()
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    read = source.mapInArrow(_read, f"vec_id long, label {label}, dim int, digest binary, v binary")
    nodes = _nodes(read)
    sizes = nodes.groupBy("dim", "label").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).orderBy(F.col("n").desc(), F.col("dim").desc()).limit(1).collect()
    cells = min(max_cells, -(-sizes[0]["most"] // cell)) if sizes else 0
    usual = nodes.where(F.col("dim") == (sizes[0]["dim"] if sizes else 0))
    first = usual.orderBy("digest", "label").limit(cells).select("v").collect()
    pivots = _unit(_vectors([bytes(r["v"]) for r in first], sizes[0]["dim"])) if first else np.zeros((0, 1))
    asked = [(r["node"], r["label"], r["dim"], bytes(r["v"])) for r in nodes.orderBy("digest", "label").limit(audit).select("node", "label", "dim", "v").collect()]
    true = nodes.select("node", "label", "dim", "m", "v").mapInArrow(_exact(asked, threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    wanted = {r["node"]: r["links"] for r in true.where("links > 0").collect()}  # of the audited nodes

    while True:
        found = search(nodes, pivots, overlap, margin, beam, threshold, degree, group)
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        got = {r["node"]: r["links"] for r in links.where(F.col("node").isin(list(wanted) or [-1])).collect()}
        measured = sum(got.get(n, 0) for n in wanted) / max(1, sum(wanted.values())) if wanted else 1.0
        if measured >= recall or (overlap >= len(pivots) and beam >= 2 * group):
            break
        overlap, margin, beam = 2 * overlap, 2 * margin, 2 * beam

    forest_links = materialise(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), "vector-forest")
    root = components(forest_links)
    known = nodes.select("node", "label", "digest", "m", "first_id").join(links, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialise(known, "vector-roots")
    name = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    info = known.join(name, "root").select(F.col("label").alias("l"), F.col("digest").alias("d"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = read.select("vec_id", "label", "digest").join(info, (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")), "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")), measured
