"""The most similar vectors of every vector, through a tree of k-means searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.heap import largest
from loamline.session import cores, cut, spread

#: Vectors that the tree is fitted on; all vectors are then assigned to it.
SAMPLE = 100_000
#: Sampled vectors of a leaf, and children of a node.
LEAF, BRANCH = 32, 100
#: Vectors that are held by one task at once.
CELL = 80_000
#: Queries that the number of leaf visits is calibrated on, against all vectors.
CALIBRATION = 1_000
#: How many times as many are drawn where too few of them have neighbours.
MORE = 8
#: Rows, and leaves of opened branches, that are scored at once, for the memory of a worker.
BLOCK, OPENED = 2_048, 2_000_000


@dataclass
class Tree:
    """Unit centroids of the nodes, level by level; ``paths``: the nodes from below the root down to each leaf, padded with its last."""

    centroids: np.ndarray
    children: dict[int, list[int]]
    leaves: np.ndarray
    paths: np.ndarray

    def order(self, query: np.ndarray) -> Iterator[int]:
        """The leaves (by number) in the order in which a best-bin-first search with a priority queue visits them."""
        number = {int(n): i for i, n in enumerate(self.leaves)}
        queue = [(-2.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node in number:
                yield number[node]
            below = self.children.get(node, [])
            if below:
                for c, s in zip(below, self.centroids[below] @ query, strict=True):
                    heapq.heappush(queue, (-float(s), c))

    def __post_init__(self):
        """The branches below the root: the leaves of each, which stand together, its nodes, and the paths by those."""
        top = self.paths[:, 0]
        self.starts = np.flatnonzero(np.diff(top, prepend=-1))
        self.sizes = np.diff([*self.starts, len(top)])
        self.tops = top[self.starts]
        self.branches = []
        for a, n in zip(self.starts, self.sizes, strict=True):
            nodes, local = np.unique(self.paths[a : a + n], return_inverse=True)
            self.branches.append((self.centroids[nodes], local.reshape(n, -1)))

    @staticmethod
    def _worst(away: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """For each query and leaf, what the search orders by; the lower the sooner. ``away``: by node.

        A node leaves the queue after all that precede it and after those above it, so leaves come by the worst priority
        on the way to each; of equals, which stand below one node, by the worst that follows it. For trees of three levels,
        as those of the sizes above are, that is the same search for a whole block, without a queue for each query.
        """
        worst = away[:, paths[:, 0]]
        after = np.full_like(worst, -2.0)
        for level in range(1, paths.shape[1]):
            own = away[:, paths[:, level]]
            after = np.where(own > worst, np.float32(-2.0), np.maximum(after, own))
            np.maximum(worst, own, out=worst)
        # Priorities are 32-bit floats: the second key is too small to change an order that the first one knows.
        return worst.astype(np.float64) + 1e-9 * after

    def priorities(self, queries: np.ndarray) -> np.ndarray:
        """What the search orders all leaves by."""
        return self._worst(-(queries @ self.centroids.T), self.paths)

    def visits(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` leaves of each query; the first is the one it belongs to.

        Only branches whose own priority is within the last of these leaves are opened, as by the queue: the nearest
        few at first, twice as many for the queries for which that doesn't do.
        """
        n = min(n, len(self.leaves))
        out = np.empty((len(queries), n), np.int64)
        top = -(queries @ self.centroids[self.tops].T)
        todo, opened = np.arange(len(queries)), 2
        while len(todo):
            opened = min(opened, len(self.tops))
            near = np.argsort(top[todo], axis=1, kind="stable")
            width = int(self.sizes.max())
            block = max(1, OPENED // (opened * width))
            again = []
            for i in range(0, len(todo), block):
                rows, chosen = todo[i : i + block], near[i : i + block, :opened]
                found = np.full((len(rows), opened, width), np.inf)
                for j in np.unique(chosen):
                    who, place = np.nonzero(chosen == j)
                    nodes, paths = self.branches[j]
                    found[who, place, : self.sizes[j]] = self._worst(-(queries[rows[who]] @ nodes.T), paths)
                flat = found.reshape(len(rows), -1)
                first = np.argpartition(flat, n - 1, axis=1)[:, :n] if n < flat.shape[1] else np.argsort(flat, axis=1)[:, :n]
                if first.shape[1] < n:
                    again.append(rows)
                    continue
                by = np.take_along_axis(flat, first, 1)
                order = np.argsort(by, axis=1, kind="stable")
                first, by = np.take_along_axis(first, order, 1), np.take_along_axis(by, order, 1)
                leaf = self.starts[np.take_along_axis(chosen, first // width, 1)] + first % width
                done = np.isfinite(by[:, -1])
                if opened < len(self.tops):
                    # The next branch comes later than the last leaf taken.
                    done &= by[:, -1] < top[rows, near[i : i + block][:, opened]] - 1e-6
                out[rows[done]] = leaf[done]
                again.append(rows[~done])
            todo, opened = np.concatenate(again) if again else todo[:0], opened * 2
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """The cluster of each row, by direction."""
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros((k, x.shape[1]), np.float64)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 0
        centroids = centroids.copy()
        centroids[full] = (sums[full] / norms[full, None]).astype(x.dtype)
    return np.argmax(x @ centroids.T, axis=1)


def fit_tree(x: np.ndarray, leaf: int = LEAF, branch: int = BRANCH, seed: int = 1) -> Tree:
    """The tree of a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    mean = lambda v: (m / n if (n := np.linalg.norm(m := v.mean(0))) > 0 else m).astype(np.float32)
    centroids, children, leaves, paths = [mean(x) if len(x) else np.zeros(1, np.float32)], {}, [], []
    todo = [(0, x, [])]
    while todo:
        node, own, path = todo.pop(0)
        k = min(branch, -(-len(own) // leaf))
        groups = []
        if k > 1:
            nearest = _kmeans(own, k, rng)
            groups = [own[nearest == i] for i in range(k) if np.any(nearest == i)]
        if len(groups) < 2:
            leaves.append(node)
            paths.append(path or [node])
            continue
        children[node] = []
        for g in groups:
            children[node].append(len(centroids))
            todo.append((len(centroids), g, [*path, len(centroids)]))
            centroids.append(mean(g))
    depth = max(map(len, paths))
    # Neighbouring leaves get neighbouring numbers, so that what a query visits lies in few cells.
    by = sorted(range(len(leaves)), key=lambda i: paths[i])
    padded = np.array([paths[i] + [paths[i][-1]] * (depth - len(paths[i])) for i in by])
    return Tree(np.stack(centroids), children, np.array([leaves[i] for i in by]), padded)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _smallest(k: int):
    """The ``k`` smallest of a column of numbers, ascending, by a heap of that size before and after the shuffle."""
    top = largest(F.bitwise_not(F.col("number")), k)
    return F.transform(top, lambda x: F.bitwise_not(x))


def usable(df: DataFrame, number: str, embedding: str, dim: int) -> DataFrame:
    """number and vec (the unit vector as bytes of 32-bit floats), a row each number.

    Left out are rows without a number and embeddings that are null, of another length, all zero, or that hold a null,
    NaN or infinity. Of several embeddings of a number the largest counts, so the result doesn't depend on the order.
    """
    e = F.col("e")
    rows = df.select(F.col(number).cast("bigint").alias("number"), F.col(embedding).cast("array<float>").alias("e"))
    rows = rows.where(F.col("number").isNotNull() & (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            unit = (x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in unit], pa.binary())], names=["number", "vec"])

    return rows.mapInArrow(run, "number bigint, vec binary").groupBy("number").agg(F.max("vec").alias("vec"))


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """Vectors of the same direction as one: vec, rep (the smallest number), ids (the k + 1 smallest), copies."""
    got = vectors.groupBy("vec").agg(_smallest(k + 1).alias("ids"), F.count("*").alias("copies"))
    return got.select("vec", F.col("ids")[0].alias("rep"), "ids", "copies")


class Index:
    """The tree over all classes, with the visits that reach the wanted recall."""

    def __init__(self, rows: DataFrame, dim: int, k: int, recall: float, min_cosine: float, sample: int = SAMPLE, leaf: int = LEAF, branch: int = BRANCH, cell: int = CELL, calibration: int = CALIBRATION):
        self.rows, self.dim, self.k, self.min_cosine, self.cell = rows, dim, k, min_cosine, cell
        self.spark = rows.sparkSession
        self.n = rows.count()
        self.visits, self.recall = 0, None
        if not self.n:
            return
        part = lambda size, salt: rows.where(F.pmod(F.xxhash64(F.lit(salt), "vec"), F.lit(1_000_000)) < min(1.0, 1.2 * size / self.n) * 1_000_000).limit(size)
        took = part(sample, "tree").select("vec").toArrow()
        self.tree = fit_tree(_matrix(took.column(0), dim), leaf, branch) if took.num_rows else fit_tree(np.ones((1, dim), np.float32) / dim**0.5)
        self.rows = cut(self._homes(rows), "homes")
        self._calibrate(lambda size: part(size, "calibration").select("rep", "vec").toArrow(), calibration, recall)

    def _homes(self, rows: DataFrame) -> DataFrame:
        """The classes with the leaf that each belongs to; written once, for everything that needs it."""
        tree, dim = self.tree, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("vec"), dim)
                home = np.concatenate([tree.visits(x[i : i + BLOCK], 1)[:, 0] for i in range(0, len(x), BLOCK)]) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("vec", "rep", "ids", "copies")], pa.array(home.astype(np.int32))], names=["vec", "rep", "ids", "copies", "leaf"])

        return rows.select("vec", "rep", "ids", "copies").mapInArrow(run, "vec binary, rep bigint, ids array<bigint>, copies bigint, leaf int")

    def _calibrate(self, draw: Callable[[int], pa.Table], size: int, recall: float) -> None:
        """The fewest visits with which the queries find that part of their neighbours.

        With too few neighbours to tell that part by, more queries are drawn. Where that isn't enough either, less similar
        neighbours count too: these are further off, so that the visits do for the similar ones. Only where all vectors have
        been asked are few neighbours, or none, all there are.
        """
        enough = min(size, int(np.ceil(1 / (1 - recall)))) if recall < 1 else size
        for n in (size, size * MORE):
            queries = draw(n)
            q, leaf = self._true(queries, self.min_cosine)
            if len(q) >= enough or queries.num_rows >= self.n:
                break
        else:
            queries = draw(size)
            q, leaf = self._true(queries, -1.5)
        tree, x = self.tree, _matrix(queries.column("vec"), self.dim)
        total = len(tree.leaves)
        if not len(q):
            self.visits, self.recall = min(2, total), None
            return
        ranks = np.empty(len(q), int)
        for i in range(0, len(x), BLOCK):
            p = tree.priorities(x[i : i + BLOCK])
            here = (q >= i) & (q < i + BLOCK)
            own = p[q[here] - i]
            ranks[here] = (own < own[np.arange(len(own)), leaf[here]][:, None]).sum(1) + 1
        ranks.sort()
        self.visits = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)])
        self.visits = min(total, max(2, self.visits))
        self.recall = float((ranks <= self.visits).mean())

    def _true(self, queries: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The query and the leaf of each of the ``k`` nearest of the queries that are similar enough, sought in all rows."""
        reps, x = queries.column("rep").to_numpy(), _matrix(queries.column("vec"), self.dim)
        dim, k = self.dim, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, every, home = batch.column("rep").to_numpy(), _matrix(batch.column("vec"), dim), batch.column("leaf").to_numpy()
                for i in range(0, len(x), 256):
                    s = x[i : i + 256] @ every.T
                    s[reps[i : i + 256, None] == own[None, :]] = -2
                    top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k] if s.size else np.zeros((len(s), 0), int)
                    score = np.take_along_axis(s, top, 1)
                    q, c = np.nonzero(score >= max(least, -1.5))
                    yield pa.RecordBatch.from_arrays([pa.array(q + i, pa.int32()), pa.array(score[q, c], pa.float32()), pa.array(home[top[q, c]], pa.int32())], names=["q", "score", "leaf"])

        found = self.rows.select("rep", "vec", "leaf").mapInArrow(run, "q int, score float, leaf int")
        top = largest(F.struct("score", "leaf"), k)
        near = found.groupBy("q").agg(top.alias("h")).select("q", F.explode("h.leaf").alias("leaf")).toArrow()
        return near.column("q").to_numpy(), near.column("leaf").to_numpy()

    def _cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each leaf its first cell, the number of its cells and of its vectors: small leaves share one, a leaf too large for one is dealt out over several."""
        tree = self.tree
        got = self.rows.groupBy("leaf").agg(F.count("*").alias("n")).toArrow()
        sizes = np.zeros(len(tree.leaves), np.int64)
        sizes[got.column("leaf").to_numpy()] = got.column("n").to_numpy()
        first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        # Two cells a core where they aren't many anyway, so that all cores have work and none waits for one large cell.
        cell = max(BLOCK, min(self.cell, -(-int(sizes.sum()) // (2 * cores(self.spark)))))
        now, filled = 0, 0
        for leaf, n in enumerate(sizes):
            parts[leaf] = max(1, -(-n // self.cell))
            if parts[leaf] > 1 or filled + n > cell:
                now, filled = now + (filled > 0), 0
            first[leaf] = now
            now, filled = (now + parts[leaf], 0) if parts[leaf] > 1 else (now, filled + n)
        return first, parts, sizes

    def neighbours(self, queries: DataFrame | None = None) -> DataFrame:
        """rep, near: the ``k`` most similar other classes of each query class (all by default) as (cosine, ids), best first.

        ``queries``: rows of the index. A class goes to the cell of its leaf, and as a query once to each cell that holds
        a leaf it visits, so the shuffle grows with the cells visited, not the leaves. Each cell keeps ``k`` candidates a
        query, and these are merged in heaps. A cell never holds more than about ``cell`` classes; its queries come in blocks.
        """
        if not self.n:
            return self.rows.select("rep", F.array().cast("array<struct<cosine:double,ids:array<bigint>>>").alias("near")).limit(0)
        tree, dim, k, visits, least = self.tree, self.dim, self.k, self.visits, self.min_cosine
        first, parts, sizes = self._cells()

        def wanted_leaves(x: np.ndarray) -> list[list[int]]:
            """The leaves of each query: as many as calibrated, more where they hold fewer than ``k`` others."""
            n, out = visits, [None] * len(x)
            todo = np.arange(len(x))
            while len(todo):
                seen = tree.visits(x[todo], n)
                enough = (sizes[seen].sum(1) > k) | (n >= len(sizes))
                for i, own in zip(todo[enough], seen[enough], strict=True):
                    out[i] = own.tolist()
                todo, n = todo[~enough], n * 2
            return out

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rep, vec = b.column("rep").to_numpy(), b.column("vec")
                x = _matrix(vec, dim)
                for i in range(0, len(x), BLOCK):
                    row, cell, leaves = [], [], []
                    for r, own in enumerate(wanted_leaves(x[i : i + BLOCK])):
                        by: dict[int, list[int]] = {}
                        for leaf in own:
                            for c in range(first[leaf], first[leaf] + parts[leaf]):
                                by.setdefault(c, []).append(leaf)
                        for c, those in by.items():
                            row.append(i + r)
                            cell.append(c)
                            leaves.append(those)
                    n = len(row)
                    none = pa.nulls(n, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.ones(n), pa.int32()), pa.array(rep[row], pa.int64()), vec.take(pa.array(row, pa.int64())), none, pa.array(leaves, pa.list_(pa.int32()))], names=["cell", "role", "rep", "vec", "ids", "leaves"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Data rows come first; then the queries, batch by batch."""
            data: list[pa.RecordBatch] = []
            held = None
            for b in batches:
                roles = b.column("role").to_numpy()
                stop = int(np.searchsorted(roles, 1))
                if stop:
                    data.append(b.slice(0, stop))
                if stop == b.num_rows:
                    continue
                if held is None and data:
                    leaf = np.concatenate([d.column("leaves").flatten().to_numpy() for d in data])
                    by = np.argsort(leaf, kind="stable")
                    matrix = np.concatenate([_matrix(d.column("vec"), dim) for d in data])[by]
                    reps = np.concatenate([d.column("rep").to_numpy() for d in data])[by]
                    ids = pa.concat_arrays([d.column("ids") for d in data]).take(pa.array(by))
                    held = leaf[by], matrix, reps, ids
                    data = []
                if held is None:
                    continue
                q = b.slice(stop)
                for i in range(0, q.num_rows, BLOCK):
                    yield score(held, q.slice(i, BLOCK))

        def score(held, q: pa.RecordBatch) -> pa.RecordBatch:
            leaf, matrix, reps, ids = held
            rep, x = q.column("rep").to_numpy(), _matrix(q.column("vec"), dim)
            lists = q.column("leaves")
            wanted = lists.flatten().to_numpy()
            asker = np.repeat(np.arange(len(rep)), pc_len(lists))
            best_s, best_i = np.full((len(rep), k), -2.0, np.float32), np.full((len(rep), k), -1, np.int64)
            by = np.argsort(wanted, kind="stable")
            wanted, asker = wanted[by], asker[by]
            edges = np.flatnonzero(np.diff(wanted, prepend=-1))
            for a, z in zip(edges, [*edges[1:], len(wanted)], strict=True):
                lo, hi = np.searchsorted(leaf, wanted[a]), np.searchsorted(leaf, wanted[a], side="right")
                if lo == hi:
                    continue
                who = asker[a:z]
                s = x[who] @ matrix[lo:hi].T
                s[rep[who][:, None] == reps[None, lo:hi]] = -2
                if hi - lo > k:
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    s, at = np.take_along_axis(s, top, 1), top + lo
                else:
                    at = np.broadcast_to(np.arange(lo, hi), s.shape)
                both_s, both_i = np.concatenate([best_s[who], s], 1), np.concatenate([best_i[who], at], 1)
                keep = np.argsort(-both_s, axis=1, kind="stable")[:, :k]
                best_s[who], best_i[who] = np.take_along_axis(both_s, keep, 1), np.take_along_axis(both_i, keep, 1)
            who, slot = np.nonzero((best_i >= 0) & (best_s > -1.5) & (best_s >= least - 1e-5))
            at = best_i[who, slot]
            cosine = np.einsum("ij,ij->i", x[who].astype(np.float64), matrix[at].astype(np.float64))
            cosine = np.clip(np.round(cosine, 7), -1, 1)
            fine = cosine >= least
            return pa.RecordBatch.from_arrays([pa.array(rep[who][fine], pa.int64()), pa.array(cosine[fine], pa.float64()), pa.array(reps[at][fine], pa.int64()), ids.take(pa.array(at[fine]))], names=["rep", "cosine", "other", "ids"])

        def pc_len(lists: pa.Array) -> np.ndarray:
            return np.diff(lists.offsets.to_numpy())

        kind = "cell bigint, role int, rep bigint, vec binary, ids array<bigint>, leaves array<int>"
        asked = self.rows if queries is None else queries
        # As many rows as the tree has leaves, which the sample bounds.
        place = F.broadcast(self.spark.createDataFrame(list(zip(range(len(first)), first.tolist(), parts.tolist(), strict=True)), "leaf int, first bigint, parts bigint"))
        held = self.rows.join(place, "leaf").select((F.col("first") + F.pmod(F.col("rep"), F.col("parts"))).alias("cell"), F.lit(0).alias("role"), "rep", "vec", "ids", F.array("leaf").alias("leaves"))
        sent = held.unionByName(asked.select("rep", "vec").mapInArrow(ask, kind))
        groups = int(first.max() + parts[first.argmax()])
        placed = sent.repartition(max(1, groups), "cell").sortWithinPartitions("cell", "role")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The cells of a partition, one after the other: rows of one cell stand together, its data before its queries."""

            def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
                for b in batches:
                    c = b.column("cell").to_numpy()
                    edges = np.flatnonzero(np.diff(c, prepend=c[:1] - 1))
                    for a, z in zip(edges, [*edges[1:], len(c)], strict=True):
                        yield int(c[a]), b.slice(a, z - a)

            for _, those in groupby(pieces(), key=lambda x: x[0]):
                yield from search(b for _, b in those)

        found = placed.mapInArrow(run, "rep bigint, cosine double, other bigint, ids array<bigint>")
        entry = F.struct(F.col("cosine"), F.bitwise_not("other").alias("o"), F.col("ids"))
        heap = largest(entry, k)
        return found.groupBy("rep").agg(heap.alias("h")).select("rep", F.transform("h", lambda e: F.struct(e["cosine"].alias("cosine"), e["ids"].alias("ids"))).alias("near"))


def _ranked(table: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """number, other, cosine, rank: the ``k`` best of each member of the classes of ``table``, those of its own class among them."""
    entries = "array<struct<cosine:double,o:bigint>>"
    own = F.transform("ids", lambda i: F.struct(F.lit(1.0), F.bitwise_not(i))).cast(entries)
    others = F.flatten(F.transform(F.coalesce("near", F.array().cast("array<struct<cosine:double,ids:array<bigint>>>")), lambda n: F.transform(n["ids"], lambda i: F.struct(n["cosine"], F.bitwise_not(i))))).cast(entries)
    rows = table.join(near, "rep", "left").select(F.explode("ids").alias("number"), F.concat(own, others).alias("all"))
    best = F.slice(F.sort_array(F.filter("all", lambda e: e["o"] != F.bitwise_not(F.col("number"))), asc=False), 1, k)
    out = rows.select("number", F.posexplode(best).alias("p", "e"))
    return out.select("number", F.bitwise_not("e.o").alias("other"), F.col("e.cosine").alias("cosine"), (F.col("p") + 1).alias("rank"))


def nearest(vectors: DataFrame, dim: int, k: int = 5, recall: float = 0.95, min_cosine: float = -1.0, every: int = 1, **sizes) -> DataFrame:
    """number, other, cosine, rank: the ``k`` vectors most similar to each vector, by cosine, of equals the smaller number.

    ``vectors``: number and vec as of ``usable``. ``min_cosine``: less similar ones aren't sought, and the visits are
    calibrated on the others. ``every``: only numbers divisible by it are queries; all vectors are searched.

    Vectors of one direction are searched as one and put in again afterwards, so that a group of copies of any size
    costs one entry; the members of a group of more than ``k`` are each other's nearest and need no search. An empty
    input gives no rows.
    """
    table = cut(classes(vectors, k), "knn")
    index = Index(table, dim, k, recall, min_cosine, **sizes)
    small = table.where(F.col("copies") <= k)
    if every > 1:
        small = small.where(F.exists("ids", lambda i: i % every == 0))
    one = _ranked(small, index.neighbours(small), k)
    large = table.where(F.col("copies") > k).select("vec", F.col("ids").alias("firsts"))
    rows = vectors.join(large, "vec").select("number", F.posexplode(F.slice(F.array_remove("firsts", F.col("number")), 1, k)).alias("p", "other"))
    many = rows.select("number", "other", F.lit(1.0).alias("cosine"), (F.col("p") + 1).alias("rank"))
    out = one.unionByName(many).where(F.col("cosine") >= min_cosine)
    return out.where(F.col("number") % every == 0) if every > 1 else out


def similar_pairs(vectors: DataFrame, dim: int, k: int = 5, min_cosine: float = 0.8, recall: float = 0.998, **sizes) -> DataFrame:
    """number_a, number_b: pairs, the smaller number first, of which one is among the ``k`` nearest of the other."""
    rows = nearest(vectors, dim, k, recall, min_cosine, **sizes)
    return rows.select(F.least("number", "other").alias("number_a"), F.greatest("number", "other").alias("number_b")).distinct()


def collection(chunks: DataFrame, probes: DataFrame, dim: int = 96) -> DataFrame:
    """The embeddings of chunks and probes as one collection, written once."""
    a = spread(chunks.select(F.col("chunk_no").alias("number"), "embedding"))
    b = spread(probes.select(F.col("catalyst_no").alias("number"), "embedding"))
    return cut(usable(a.unionByName(b), "number", "embedding", dim), "vectors")
