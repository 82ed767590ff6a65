"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import components, table, written

#: Distinct vectors of a label that a block, and so a tree, holds on average; slack for distances, whose rounding errors are smaller.
BLOCK, SLACK = 4096, 1e-7
#: Of a label of more nodes: nodes that its cells' centres are taken from, and cells, at most; nodes that a task assigns to cells on average.
SAMPLE, CELLS, ASSIGN = 2048, 1024, 16384
_TILE = 1 << 20


class CoverTree:
    """Unit vectors in nested levels: a node's centre is one of its points; the radii that part its points into children halve from level to level.

    Nodes 0 .. n-1 are the points; others follow. radius is the largest distance from a node's centre to its points.
    """

    def __init__(self, unit: np.ndarray, weight: np.ndarray) -> None:
        n = len(unit)
        self.n, self.unit = n, unit
        centre, radius, self.children, total = list(range(n)), [0.0] * n, {}, [int(w) for w in weight]
        todo = [(-1, np.arange(n), 2.0)]
        self.root = n if n > 1 else 0
        slot: dict[int, list[int]] = {}

        def add(points: np.ndarray, reach: float, mother: int, scale: float) -> None:
            if len(points) == 1:
                slot[mother].append(int(points[0]))
                return
            k = len(centre)
            centre.append(int(points[0]))
            radius.append(reach)
            total.append(int(weight[points].sum()))
            if mother >= 0:
                slot[mother].append(k)
            slot[k] = []
            todo.append((k, points, scale))

        todo.clear()
        if n > 1:
            add(np.arange(n), self._reach(0, np.arange(n)), -1, 1.0)
        while todo:
            k, points, scale = todo.pop()
            while scale > radius[k] and scale > 1e-9:
                scale /= 2
            if len(points) <= 4 or radius[k] < 1e-9:
                slot[k] = points.tolist()
                continue
            left = points
            while len(left):
                d = np.sqrt(np.maximum(0, 2 - 2 * (unit[left] @ unit[left[0]])))
                near = d <= scale
                near[0] = True
                add(left[near], float(d[near].max()), k, scale / 2)
                left = left[~near]
        self.centre, self.radius, self.total = np.array(centre), np.array(radius), np.array(total, np.int64)
        self.children = {k: np.array(sorted(v)) for k, v in slot.items()}

    def _reach(self, c: int, points: np.ndarray) -> float:
        return float(np.sqrt(np.maximum(0, 2 - 2 * (self.unit[points] @ self.unit[c]))).max())

    def top(self, n: int) -> list[int]:
        """The centres of the top of the tree, n at most: from the root down the widest node gives way to its children, the heaviest ones where there
        are too many (a centre more or less changes what is left out, not what is found)."""
        front = [(-self.radius[self.root], self.root)]
        while len(front) < n and front[0][0] < 0:
            _, k = heapq.heappop(front)
            heavy = sorted(self.children[k].tolist(), key=lambda c: (-self.total[c], c))
            for c in heavy[: n - len(front)]:
                heapq.heappush(front, (-self.radius[c], c))
        return sorted({int(self.centre[k]) for _, k in front})

    def points(self, k: int) -> np.ndarray:
        out, todo = [], [k]
        while todo:
            k = todo.pop()
            if k < self.n:
                out.append(k)
            else:
                todo += self.children[k].tolist()
        return np.array(out)


def dual(a: CoverTree, b: CoverTree, raw_a: np.ndarray, raw_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Over all pairs with cosine >= least: each a's and each b's weight of partners, and links (a, b) that span the same components.

    a is b: pairs within, each once. Node pairs farther apart than their radii and the threshold are dropped; those nearer
    count whole. Pairs of points near the threshold are decided by their double-precision cosine.
    """
    same, t = a is b, float(np.sqrt(2 - 2 * least))
    got_a = np.zeros(a.n, np.int64)
    got_b = got_a if same else np.zeros(b.n, np.int64)
    links: list[tuple[int, int]] = []
    stack = [(np.array([a.root]), np.array([b.root]), same)]
    while stack:
        i, j, sym = stack.pop()
        step = max(1, _TILE // len(j))
        if len(i) > step:
            stack += [(i[k : k + step], j, sym) for k in range(0, len(i), step)]
            continue
        dot = a.unit[a.centre[i]] @ b.unit[b.centre[j]].T
        d = np.sqrt(np.maximum(0, 2 - 2 * dot))
        reach = a.radius[i][:, None] + b.radius[j][None, :]
        ok = d <= reach + (t + SLACK)
        if sym:
            ok &= j[None, :] >= i[:, None]
        p, q = np.nonzero(ok)
        x, y, far, both = i[p], j[q], d[p, q], reach[p, q]
        leaf = (x < a.n) & (y < b.n)
        lx, ly, near = x[leaf], y[leaf], dot[p, q][leaf]
        hit = near >= least
        for k in np.flatnonzero(np.abs(near - least) < SLACK):
            u, v = raw_a[lx[k]], raw_b[ly[k]]
            hit[k] = float(u @ v) / (float(np.sqrt(u @ u)) * float(np.sqrt(v @ v))) >= least
        if same:
            hit &= lx != ly
        lx, ly = lx[hit], ly[hit]
        np.add.at(got_a, lx, b.total[ly])
        np.add.at(got_b, ly, a.total[lx])
        links += zip(lx.tolist(), ly.tolist(), strict=True)
        x, y, far, both = x[~leaf], y[~leaf], far[~leaf], both[~leaf]
        whole = (far + both <= t - SLACK) & ~(same & (x == y))
        for u, v in zip(x[whole].tolist(), y[whole].tolist(), strict=True):
            pu, pv = a.points(u), b.points(v)
            got_a[pu] += b.total[v]
            got_b[pv] += a.total[u]
            links += [(int(k), int(pv[0])) for k in pu] + [(int(pu[0]), int(k)) for k in pv[1:]]
        x, y = x[~whole], y[~whole]
        own = (x == y) if sym else np.zeros(len(x), bool)
        for u in x[own].tolist():
            stack.append((a.children[u], a.children[u], True))
        x, y = x[~own], y[~own]
        first = (y < b.n) | ((x >= a.n) & (a.radius[x] >= b.radius[y]))  # the wider of the two nodes opens
        for u in np.unique(x[first]).tolist():
            stack.append((a.children[u], y[first & (x == u)], False))
        for v in np.unique(y[~first]).tolist():
            stack.append((x[~first & (y == v)], b.children[v], False))
        if len(links) > 1 << 18:
            links = _spanning(links)
    return got_a, got_b, _spanning(links)


def _spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """At most as many links as there are points, with the same components. Ends of both sides of a pair are told apart by their side."""
    parent: dict = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for x, y in links:
        rx, ry = root(("a", x)), root(("b", y))
        if rx != ry:
            parent[rx] = ry
            out.append((x, y))
    return out


def _units(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they are, and of length 1."""
    raw = np.asarray(part["v"].combine_chunks().flatten(), np.float64).reshape(part.num_rows, -1)
    unit = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw, unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def _centres(part: pa.Table) -> pa.Table:
    """A label's sample -> its cells' centres: the top of the sample's cover tree, as many as cells says (equal sizes: fewer)."""
    part = part.sort_by("node")
    _, unit = _units(part)
    top = CoverTree(unit, np.ones(len(unit))).top(part["cells"][0].as_py())
    same = lambda c: pa.array([part[c][0].as_py()] * len(top), part[c].type)
    centre = pa.ListArray.from_arrays(pa.array(np.arange(len(top) + 1, dtype=np.int32) * unit.shape[1]), pa.array(unit[top].ravel()))
    return pa.table({"label": same("label"), "dim": same("dim"), "cell": np.arange(len(top), dtype=np.int32), "v": centre})


def _assign(least: float):
    t = float(np.sqrt(2 - 2 * least))

    def assign(part: pa.Table) -> pa.Table:
        """Points (cell null) and centres of a label -> each point's cell, its distance from the centre, and the later cells that may hold a partner.

        A partner is nearer than t, and its own centre is its nearest: so of a partner's cell the centre is no farther from the point than 2 t more
        than its own cell's.
        """
        centre = np.asarray(part["cell"].is_valid())
        _, unit = _units(part)
        points, middle = part.filter(pa.array(~centre)), part.filter(pa.array(centre))
        order = np.argsort(np.asarray(middle["cell"], np.int64))
        c = unit[centre][order]
        cells, reach, visits, ends = [], [], [], [0]
        step = max(1, _TILE // max(1, len(c)))
        x = unit[~centre]
        for k in range(0, len(x), step):
            d = np.sqrt(np.maximum(0, 2 - 2 * (x[k : k + step] @ c.T)))
            own = d.argmin(axis=1)
            near = d[np.arange(len(d)), own]
            row, q = np.nonzero((d <= near[:, None] + 2 * t + SLACK) & (np.arange(len(c))[None, :] > own[:, None]))
            cells.append(own)
            reach.append(near)
            visits.append(np.stack([q, d[row, q]], axis=1))
            ends += (ends[-1] + np.searchsorted(row, np.arange(1, len(d) + 1))).tolist()
        visit = np.concatenate(visits) if visits else np.zeros((0, 2))
        ends = pa.array(np.array(ends, np.int32))
        return pa.table(
            [points[k] for k in ("label", "dim", "node", "size", "v")]
            + [pa.array(np.concatenate(cells or [np.zeros(0)]).astype(np.int32)), pa.array(np.concatenate(reach or [np.zeros(0)]))]
            + [pa.ListArray.from_arrays(ends, pa.array(visit[:, 0].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(visit[:, 1]))],
            names=["label", "dim", "node", "size", "v", "cell", "reach", "visits", "far"],
        )

    return assign


def _meet(least: float):
    def meet(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        node, size, side = (np.asarray(part[k]) for k in ("node", "size", "side"))
        raw, unit = _units(part)
        at = [np.flatnonzero(side == k) for k in (0, 1)]
        ids, got, links = [], [], []
        if len(at[0]) and (len(at[1]) or not (side == 1).any()):
            trees = [CoverTree(unit[k], size[k]) if len(k) else None for k in at]
            if trees[1] is None and np.asarray(part["p"])[0] == np.asarray(part["q"])[0]:
                g, _, links = dual(trees[0], trees[0], raw[at[0]], raw[at[0]], least)
                ids, got, links = [node[at[0]]], [g], [(node[at[0][x]], node[at[0][y]]) for x, y in links]
            elif trees[1] is not None:
                g, h, links = dual(trees[0], trees[1], raw[at[0]], raw[at[1]], least)
                ids, got, links = [node[at[0]], node[at[1]]], [g, h], [(node[at[0][x]], node[at[1][y]]) for x, y in links]
        i, g = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, got))
        keep = g > 0
        a = np.concatenate([i[keep], np.array([x for x, _ in links], np.int64)])
        b = np.concatenate([np.zeros(keep.sum(), np.int64), np.array([y for _, y in links], np.int64)])
        n = np.concatenate([g[keep], np.zeros(len(links), np.int64)])
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "n": n.astype(np.int64)})

    return meet


def _celled(nodes: DataFrame, labels: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """nodes (label, dim, node, size, v) -> (label, dim, cell, node, size, v): at home in a cell, and visiting cells that may hold partners.

    Labels of one block are one cell. Of a larger one (labels: label, dim, n) a sample's cover tree gives the cells' centres; every node is
    at home with its nearest centre, and visits those later cells that the covering radius and its own distances leave.
    """
    kept = ["label", "dim", "cell", "node", "size", "v"]
    large = labels.where(F.col("n") > BLOCK).select("label", "dim", "n")
    small = nodes.join(large, ["label", "dim"], "left_anti").withColumn("cell", F.lit(0)).select(kept)
    if large.isEmpty():
        return small, small.where("false")
    own = nodes.join(F.broadcast(large) if large.count() <= 100_000 else large, ["label", "dim"])
    share = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cells = F.least(F.lit(CELLS), F.ceil(2 * F.col("n") / BLOCK)).cast("int").alias("cells")
    sample = own.where(share < F.lit(float(SAMPLE)) / F.col("n")).select("label", "dim", "node", "v", cells)
    at = f"label {dict(nodes.dtypes)['label']}, dim int"
    centres = written(sample.groupBy("label", "dim").applyInArrow(_centres, f"{at}, cell int, v array<double>"), "cover-centres")
    # by chance a label may have no sample: it stays one cell
    none = large.join(centres.select("label", "dim").distinct(), ["label", "dim"], "left_anti")
    small = small.unionByName(nodes.join(none, ["label", "dim"], "left_semi").withColumn("cell", F.lit(0)).select(kept))
    salts = F.ceil(F.col("n") / ASSIGN).cast("int")
    every = centres.join(large, ["label", "dim"]).select("label", "dim", "cell", "v", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    points = own.join(none.select("label", "dim"), ["label", "dim"], "left_anti").select("label", "dim", "node", "size", "v", F.pmod(F.xxhash64("node", F.lit(13)), salts).cast("int").alias("salt"))
    both = points.withColumn("cell", F.lit(None).cast("int")).unionByName(every.withColumn("node", F.lit(0).cast("long")).withColumn("size", F.lit(0).cast("long")))
    schema = f"{at}, node long, size long, v array<double>, cell int, reach double, visits array<int>, far array<double>"
    homes = written(both.groupBy("label", "dim", "salt").applyInArrow(_assign(least), schema), "cover-homes")
    radius = homes.groupBy("label", "dim", "cell").agg(F.max("reach").alias("radius"))
    to = F.explode(F.arrays_zip("visits", "far")).alias("to")
    guests = homes.select("label", "dim", "node", "size", "v", to).select("label", "dim", F.col("to.visits").alias("cell"), "node", "size", "v", F.col("to.far").alias("far"))
    guests = guests.join(F.broadcast(radius) if radius.count() <= 100_000 else radius, ["label", "dim", "cell"])
    t = float(np.sqrt(2 - 2 * least))
    return small.unionByName(homes.select(kept)), guests.where(F.col("far") <= F.col("radius") + t + SLACK).select(kept)


def near_duplicates(vectors: DataFrame, least: float) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept, over links of cosine >= least between equal labels.

    A row whose label is null, or whose vector is null, empty, zero or holds null or non-finite components, links with nothing, nor do
    vectors of different lengths. Equal vectors of one label are one node with a count, so that copies are never paired. A label's nodes are
    dealt to cells of the top of one cover tree; a node visits other cells only where radii and distances leave room for a partner. Each cell's
    nodes meet in blocks of BLOCK on average, as cover trees, a pair of blocks in a task: tasks stay the same size, whatever share a label or
    cell has. Tasks return sums of partners and a spanning set of links, not pairs. Repeated rows count as vectors of their own; an empty
    table gives no rows; other columns, whatever their names, play no part.
    """
    good = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select("vec_id", "embedding", "label").withColumn("node", F.when(F.expr(good), F.xxhash64("label", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)))))
    rows = rows.withColumn("dim", F.size("embedding"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("embedding").cast("array<double>").alias("v"), F.count("*").alias("size"), F.min("vec_id").alias("vec_id"))
    nodes = written(nodes, "cover-nodes")
    labels = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    homes, guests = _celled(nodes.select("label", "dim", "node", "size", "v"), labels, least)
    cell = ["label", "dim", "cell"]
    n_blocks = lambda name: F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias(name)
    blocks = homes.groupBy(*cell).agg(n_blocks("blocks")).join(guests.groupBy(*cell).agg(n_blocks("guests")), cell, "left").fillna(0, ["guests"])
    blocks = written(blocks, "cover-blocks")
    few = blocks.count() <= 100_000
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    homes, guests = (x.join(F.broadcast(blocks) if few else blocks, cell).withColumn("own", own(n)) for x, n in ((homes, "blocks"), (guests, "guests")))
    every = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))).alias("other")
    held = ["node", "size", "v"]
    # home block k meets every home block: as the left side those after it, as the right side those before it, and itself
    within = homes.select(*cell, "own", every("blocks"), *held)
    within = within.select(*cell, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), *held)
    hosts = homes.select(*cell, F.col("own").alias("p"), every("guests"), *held).select(*cell, "p", (-1 - F.col("other")).alias("q"), F.lit(0).alias("side"), *held)
    callers = guests.select(*cell, every("blocks"), (-1 - F.col("own")).alias("q"), *held).select(*cell, F.col("other").alias("p"), "q", F.lit(1).alias("side"), *held)
    met = within.unionByName(hosts).unionByName(callers)
    found = written(met.groupBy(*cell, "p", "q").applyInArrow(_meet(least), "a long, b long, n long"), "cover-links")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("partners")).withColumnRenamed("a", "node")
    group = components(found.where("n = 0").select("a", "b"), "cover-components").select(F.col("id").alias("node"), F.col("component").alias("group"))
    named = nodes.select("node", "size", "vec_id").join(counts, "node", "left").join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    named = named.join(named.groupBy("group").agg(F.min("vec_id").alias("component_id")), "group").select("node", (F.col("size") - 1 + F.coalesce("partners", F.lit(0))).cast("long").alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, cosine 0.93 or more within a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93
), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
