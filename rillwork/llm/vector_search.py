"""Exact top-k search by integer inner product in M-trees.

Components are turned into floor(``SCALE`` * x). Equal vectors are one entry that carries as many of its
smallest ids as a result can hold, so a vector that fills a third of the table is searched once.
Distinct vectors are dealt to trees of bounded size by the order of a projection. To search for the
largest inner product in a metric space, a data vector gets one more coordinate, sqrt(M² - |x|²) with M
the largest norm of the tree, and a query gets 0: then d(q, x)² = |q|² + M² - 2 <q, x>.

A tree is a set of pages. A page has a routing vector, a covering radius and its entries with their
distances to the routing vector (the parent distances). Search is best-first over pages: a page
whose nearest possible vector is no better than the k-th found ends it, and an entry whose parent
distance shows the same by the triangle inequality is passed over without computing its distance.
Bounds carry a margin for rounding; scores are integers computed exactly.

Queries are distinct vectors too, taken in blocks of bounded size that are broadcast; each block meets
every tree. A first bound for a block comes from a bounded sample of entries.

* Vectors that are null or hold null or non-finite components take no part; only vectors of equal
  length are compared. Rows without a vec_id take no part.
* Ties go to the smaller vec_id. Rows that repeat both id and vector count once.
* A vector so long that scores might not fit 64 bits is an error, never a wrong number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwork.llm.common import map_batches, stored

# Scale of a component, entries of a page, vectors of a tree, queries of a block, and
# entries that give the first bound.
SCALE = 256
PAGE = 64
TREE = 8192
QUERY_BLOCK = 4096
SEEDS = 2048


def quantise(rows: DataFrame, keep: int) -> DataFrame:
    """(vector binary, ids): distinct integer vectors with their ``keep`` smallest ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held: dict[bytes, set] = {}
        for vec_id, vector in zip(batch["vec_id"].to_pylist(), batch["embedding"]):
            values = vector.as_py()
            if vec_id is None or values is None or None in values:
                continue
            values = np.asarray(values, np.float64)
            if np.isfinite(values).all():
                scaled = np.floor(SCALE * values)
                if not float(scaled @ scaled) < 2.0**63:
                    raise OverflowError("a vector is too long for scores of 64 bits")
                held.setdefault(scaled.astype(np.int64).tobytes(), set()).add(vec_id)
        ids = [sorted(v)[:keep] for v in held.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["vector", "ids"])

    found = map_batches(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"),
                        run, "vector binary, ids array<long>")
    together = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return found.groupBy("vector").agg(together.alias("ids"))


def _integers(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.int64).reshape(len(vectors), -1)


class MTree:
    """Pages of one tree; built from distinct vectors of equal length."""

    def __init__(self, vectors: np.ndarray, seed: int = 3):
        self.vectors = vectors
        x = vectors.astype(np.float64)
        norms = (x * x).sum(axis=1)
        self.top = float(norms.max())
        # Largest component of a query up to which doubles hold all partial sums of a product.
        self.exact = int(2**53 // max(1, np.abs(vectors).max(initial=0) * max(1, vectors.shape[1])))
        self.points = np.c_[x, np.sqrt(np.maximum(self.top - norms, 0))]
        self.random = np.random.default_rng(seed)
        # A page: routing vector, covering radius, children (pages) or entries, their parent distances.
        self.routing: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.entries: list[np.ndarray | None] = []
        self.parent_distance: list[np.ndarray] = []
        self.root = self._build(np.arange(len(vectors)))

    def _page(self, members: np.ndarray, children: np.ndarray | None) -> int:
        centre = self.points[members].mean(axis=0)
        place = members[int(((self.points[members] - centre) ** 2).sum(axis=1).argmin())]
        routing = self.points[place]
        distance = np.sqrt(((self.points[members] - routing) ** 2).sum(axis=1))
        self.routing.append(routing)
        self.radius.append(float(distance.max()))
        self.children.append(children)
        self.entries.append(None if children is not None else members)
        if children is not None:
            hubs = np.stack([self.routing[c] for c in children])
            distance = np.sqrt(((hubs - routing) ** 2).sum(axis=1))
        self.parent_distance.append(distance)
        return len(self.routing) - 1

    def _build(self, members: np.ndarray) -> int:
        if len(members) <= PAGE:
            return self._page(members, None)
        fan = min(PAGE, -(-len(members) // PAGE))
        hubs = self.points[self.random.choice(members, fan, replace=False)]
        near = (hubs * hubs).sum(axis=1)[None, :] - 2 * self.points[members] @ hubs.T
        owner = near.argmin(axis=1)
        groups = [members[owner == g] for g in np.unique(owner)]
        if max(map(len, groups)) > 0.9 * len(members):  # too close together to be told apart
            groups = np.array_split(members[np.argsort(self.points[members] @ hubs[0])], fan)
        return self._page(members, np.array([self._build(g) for g in groups]))

    def _apart(self, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances between queries and points; rounding is covered by the margins of the bounds."""
        squares = (queries * queries).sum(axis=1)[:, None] - 2 * queries @ points.T + (points * points).sum(axis=1)
        return np.sqrt(np.maximum(squares, 0))

    def _leaves(self, queries: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(page, nearest possible distance, distance to its routing vector) of leaf pages for each query: from the root
        downwards, a page's children are looked at for those queries only that its bound or the parent distance leaves."""
        count = len(self.routing)
        low, own = np.full((len(queries), count), np.inf), np.zeros((len(queries), count))
        first = self._apart(queries, self.routing[self.root][None, :])[:, 0]
        own[:, self.root], low[:, self.root] = first, np.maximum(first - self.radius[self.root], 0)
        waiting = [self.root]
        while waiting:
            page = waiting.pop()
            if self.children[page] is None:
                continue
            asking = np.flatnonzero(low[:, page] <= limit)
            children = self.children[page]
            radii = np.array([self.radius[c] for c in children])
            near = np.abs(own[asking, page][:, None] - self.parent_distance[page]) - radii <= limit[asking, None]
            asking, near = asking[near.any(axis=1)], near[near.any(axis=1)]
            if len(asking):
                apart = self._apart(queries[asking], np.stack([self.routing[c] for c in children]))
                own[np.ix_(asking, children)] = apart
                low[np.ix_(asking, children)] = np.where(near, np.maximum(np.maximum(apart - radii, low[asking, page][:, None]), 0), np.inf)
                waiting.extend(children.tolist())
        leaves = np.array([p for p in range(count) if self.children[p] is None])
        return leaves, low[:, leaves], own[:, leaves]

    def nearest(self, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, score, entry) arrays of all entries that can be among the k best of each query; ``floors`` are scores that k
        entries are known to reach.

        Best-first for all queries at once: in each round a query visits the nearest page that it has not seen, and
        those that visit the same page share one product. A query rests when its next page cannot hold anything better.
        """
        asked = queries.astype(np.float64)
        length = (asked * asked).sum(axis=1) + self.top
        margin = 1e-9 * (length + 1)
        slack = np.sqrt(margin) + 1e-6 * np.sqrt(length + 1)
        extended = np.c_[asked, np.zeros(len(asked))]
        reach = lambda worst: np.sqrt(np.maximum(length - 2 * worst, 0) + margin) + slack
        best = np.full((len(asked), k), -np.inf)  # the k best scores so far
        worst = np.array(floors, np.float64)
        leaves, low, own = self._leaves(extended, reach(worst))
        order = np.argsort(low, axis=1, kind="stable")
        out = []
        open_ = np.arange(len(asked))
        for visit in range(len(leaves)):
            page = order[open_, visit]
            going = low[open_, page] <= reach(worst)[open_]
            open_, page = open_[going], page[going]
            if not len(open_):
                break
            for at in np.unique(page):
                mine = open_[page == at]
                members = self.entries[leaves[at]]
                far = np.abs(own[mine, at][:, None] - self.parent_distance[leaves[at]]) > reach(worst)[mine, None]
                used = ~far.all(axis=0)
                if not used.any():
                    continue
                members = members[used]
                scores = self._scores(queries[mine], members)
                row, column = np.nonzero(scores >= worst[mine, None])
                out.append((mine[row], scores[row, column], members[column]))
                both = np.concatenate([best[mine], scores.astype(np.float64)], axis=1)
                best[mine] = -np.partition(-both, k - 1, axis=1)[:, :k]
                worst[mine] = np.maximum(worst[mine], best[mine].min(axis=1))
        return [(q[keep], s[keep], e[keep]) for q, s, e in out if (keep := s >= worst[q]).any()]

    def _scores(self, queries: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Exact integer products: in doubles while they hold every sum, else in 64-bit integers."""
        if self.exact and np.abs(queries).max(initial=0) <= self.exact:
            return (queries.astype(np.float64) @ self.points[members, :-1].T).astype(np.int64)
        return queries @ self.vectors[members].T


def build_index(distinct: DataFrame) -> DataFrame:
    """(tree, vector, ids): every distinct vector dealt to a tree of at most ``TREE`` vectors, in the
    order of a projection, so that trees hold vectors that lie near each other."""

    def project(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = []
        for vector in batch["vector"]:
            values = np.frombuffer(vector.as_py(), np.int64)
            at.append(float(values @ np.random.default_rng(len(values)).normal(size=len(values))) if len(values) else 0.0)
        return pa.RecordBatch.from_arrays(
            [batch["vector"], batch["ids"], pa.array(at, pa.float64())], ["vector", "ids", "at"])

    placed = stored(map_batches(distinct, project, "vector binary, ids array<long>, at double"), "vectors")
    trees = max(1, -(-placed.count() // (TREE // 2)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            names = []
            for vector in batch["vector"]:
                size = len(vector.as_py())
                n = seen[size] = seen.get(size, -1) + 1
                names.append(f"{part}-{size}-{n // TREE}")
            yield pa.RecordBatch.from_arrays([pa.array(names), batch["vector"], batch["ids"]], ["tree", "vector", "ids"])

    dealt = placed.repartitionByRange(trees, "at").sortWithinPartitions("at")
    return stored(dealt.select("vector", "ids").mapInArrow(number, "tree string, vector binary, ids array<long>"), "index")


def search_block(index: DataFrame, queries: list[bytes], k: int) -> DataFrame:
    """(query binary, vec_id, score) of the k best per tree and distinct query vector."""
    spark = index.sparkSession
    sample = index.select("vector").orderBy(F.xxhash64("vector")).limit(SEEDS).toLocalIterator()
    seeds: dict[int, list[bytes]] = {}
    for row in sample:
        seeds.setdefault(len(row["vector"]), []).append(bytes(row["vector"]))
    floors = []
    for q in queries:
        known = seeds.get(len(q), [])
        if len(known) >= k and len(q):
            scores = _integers(known) @ np.frombuffer(q, np.int64)
            floors.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]))
        else:
            floors.append(float("-inf"))
    sent = spark.sparkContext.broadcast((queries, floors))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        queries, floors = sent.value
        size = len(rows["vector"].iloc[0])
        ids = rows["ids"].tolist()
        tree = MTree(_integers(rows["vector"].tolist())) if size else None
        out: list[tuple] = []
        asked = [(query, floor) for query, floor in zip(queries, floors) if len(query) == size]
        if not asked:
            return pd.DataFrame(out, columns=["query", "vec_id", "score"])
        found: list[list[tuple[int, int]]] = [[] for _ in asked]
        if tree:
            vectors = _integers([query for query, _ in asked])
            for q, scores, entries in tree.nearest(vectors, k, np.array([floor for _, floor in asked])):
                for at, score, entry in zip(q.tolist(), scores.tolist(), entries.tolist()):
                    found[at].extend((-score, int(i)) for i in ids[entry])
        else:
            found = [[(0, int(i)) for own in ids for i in own]]
        for (query, _), own in zip(asked, found):
            out.extend((query, i, -score) for score, i in sorted(own)[:k])
        return pd.DataFrame(out, columns=["query", "vec_id", "score"])

    return index.groupBy("tree").applyInPandas(run, "query binary, vec_id long, score long")


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row with other rows."""
    index = build_index(quantise(rows, k + 1))
    asked = rows.where(is_query)
    every = stored(_query_rows(asked), "queries")
    distinct = every.select("query").distinct().orderBy("query")
    found = None
    block: list[bytes] = []
    for row in distinct.toLocalIterator():
        block.append(bytes(row["query"]))
        if len(block) == QUERY_BLOCK:
            part = stored(search_block(index, block, k + 1), "found")
            found, block = part if found is None else found.unionByName(part), []
    if block or found is None:
        part = stored(search_block(index, block, k + 1), "found")
        found = part if found is None else found.unionByName(part)
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    answers = every.join(found, "query").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_rows(rows: DataFrame) -> DataFrame:
    """(query binary, query_id) of rows with a usable vector, each pair once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors, ids = [], []
        for vec_id, vector in zip(batch["vec_id"].to_pylist(), batch["embedding"]):
            values = vector.as_py()
            if vec_id is not None and values is not None and None not in values:
                values = np.asarray(values, np.float64)
                if np.isfinite(values).all():
                    vectors.append(np.floor(SCALE * values).astype(np.int64).tobytes())
                    ids.append(vec_id)
        return pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), pa.array(ids, pa.int64())], ["query", "query_id"])

    return map_batches(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"),
                       run, "query binary, query_id long").distinct()


def top_k_report(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 50 == 0, 5).withColumn("rank", F.col("rank").cast("int"))
