"""Exact top-k search by block-at-a-time pruning.

Vectors are quantised to integers and ordered by the leaf of a small tree of principal directions, so that neighbours are alike. That
order is cut into runs of blocks (ranges of it); a block keeps each dimension's extremes and a forward index, its matrix. For a query, the
sum over dimensions of the larger of query x maximum and query x minimum bounds every score in a block.

Queries go in groups. First each query meets the run of its largest bound; its k-th score there is its threshold. Then bounds are held
against thresholds, and only the (group, run) pairs that some query still needs are joined, by their numbers, and scored: blocks in falling
order of bound for each query, until bounds fall below the k-th score so far. All joins are on numbers of groups, runs and chunks of runs;
how many there are follows from the rows alone, not from the number of partitions.

Equal vectors are one: of each distinct vector the k + 1 smallest vec_ids are candidates (more can never be among the best k of another
row), and queries with equal vectors are searched once. So a vector that a third of all rows share costs no more than another.

The tree is fitted to at most ``SAMPLE`` rows, those with the smallest hash of vec_id; it decides only which vectors are neighbours, never
what is found. Products are summed in float32 or float64 where all sums are exact in them, and in Python integers beyond.

Defined results: a query with fewer than k candidates returns all; vectors of different lengths count missing components as 0; of rows that
share a vec_id the one with the smallest vector counts, once; null vec_ids take no part; an empty table gives no rows; scores beyond a
long are held at its ends; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import runs as starts_of
from .anchors import text_bytes
from .common import cut, table

K = 20
EVERY = 20
SCALE = 64
BLOCK = 1024
#: Blocks in a run.
RUN = 4
#: Queries that are searched together.
GROUP = 512
#: Runs whose bounds one task takes up at a time.
CHUNK = 256
SAMPLE = 4096
DEPTH = 8
_NONE = np.iinfo(np.int64).min
_TYPES = {1: "<i1", 2: "<i2", 4: "<i4", 8: "<f8"}


class Tree:
    """Median cuts along principal directions, in heap order; leaves are numbered from left to right."""

    def __init__(self, rows: np.ndarray, depth: int):
        self.depth, wide = depth, rows.shape[1]
        self.way, self.cut = np.zeros(((1 << depth) - 1, wide)), np.zeros((1 << depth) - 1)
        held = {0: rows}
        for node in range((1 << depth) - 1):
            mine = held.pop(node, rows[:0])
            if len(mine) < 4 or not wide:
                continue
            _, _, axes = np.linalg.svd(mine - mine.mean(0), full_matrices=False)
            at = mine @ axes[0]
            self.way[node], self.cut[node] = axes[0], np.median(at)
            right = at > self.cut[node]
            held[2 * node + 1], held[2 * node + 2] = mine[~right], mine[right]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        wide = min(x.shape[1], self.way.shape[1])
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x[:, :wide], self.way[node, :wide]) > self.cut[node])
        return (node - (1 << self.depth) + 1).astype(np.int32)


def _smallest(m: np.ndarray) -> np.ndarray:
    """Bytes per component that hold each row."""
    most = np.abs(m).max(1, initial=0)
    return np.where(most < 1 << 7, 1, np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8)))


def quantised(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the integer vectors of each length."""
    at = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(at)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield rows, np.floor(values[at[rows][:, None] + np.arange(n)] * SCALE)


def _place(tree: Tree, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, leaf and the vector as bytes: the size of a component and the components; equal bytes are equal vectors."""
    for b in batches:
        ids, leaf, order, packed = b.column("vec_id"), np.zeros(b.num_rows, np.int32), [], []
        for rows, m in quantised(b.column("embedding")):
            leaf[rows] = tree.leaf(m)
            size = _smallest(m)
            for s in np.unique(size).tolist():
                mine = np.flatnonzero(size == s)
                data = np.ascontiguousarray(m[mine].astype(_TYPES[s])).view(np.uint8).reshape(len(mine), -1)
                data = np.concatenate((np.full((len(mine), 1), s, np.uint8), data), 1)
                packed.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1]), len(mine), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary()))
                order.append(rows[mine])
        if order:
            back = np.argsort(np.concatenate(order))
            yield pa.RecordBatch.from_arrays([ids, pa.array(leaf), pa.concat_arrays(packed).take(pa.array(back))], ["vec_id", "leaf", "vec"])


def _matrix(vecs: pa.Array) -> np.ndarray:
    buf, at = text_bytes(vecs)
    size, length = buf[at[:-1]].astype(np.int64), np.diff(at)
    out = np.zeros((len(size), int(((length - 1) // size).max(initial=0))))
    for s in np.unique(size).tolist():
        for n in np.unique(length[size == s]).tolist():
            rows = np.flatnonzero((size == s) & (length == n))
            out[rows, : (n - 1) // s] = np.ascontiguousarray(buf[(at[rows] + 1)[:, None] + np.arange(n - 1)]).view(_TYPES[s]).reshape(len(rows), -1)
    return out


def _pack(name: str, with_extremes: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per run (or group): vec_ids, matrix, and the extremes of its blocks."""
    fields = [name, "ids", "data", "size", "wide"] + (["top", "low", "least"] if with_extremes else [])

    def done(held: list, number: int) -> pa.RecordBatch:
        ids = np.concatenate([x.column("vec_id").to_numpy() for x in held])
        m = _matrix(pa.concat_arrays([x.column("vec") for x in held]))
        size = int(_smallest(m).max(initial=1))
        row = [number, ids.tobytes(), m.astype(_TYPES[size]).tobytes(), size, m.shape[1]]
        if with_extremes:
            cuts = range(0, len(m), BLOCK)
            row += [np.array([f(m[a : a + BLOCK], axis=0) for a in cuts]).tobytes() for f in (np.max, np.min)]
            row.append(np.array([ids[a : a + BLOCK].min() for a in cuts]).tobytes())
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=False)], fields)

    now, held = None, []
    for b in batches:
        numbers = b.column(name).to_numpy()
        cuts = [*starts_of(numbers), len(numbers)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if numbers[a] != now and held:
                yield done(held, now)
                held = []
            now = int(numbers[a])
            held.append(b.slice(a, z - a))
    if held:
        yield done(held, now)


def _packed(rows: DataFrame, name: str, size: int, with_extremes: bool) -> DataFrame:
    """rows (vec_id, leaf, vec) in order of leaves, cut into runs of ``size``, numbered from 0."""
    ordered = cut(rows.orderBy("leaf", "vec_id").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    counts = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row per sort range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("start"))
    ranked = ordered.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = ranked.select(F.expr(f"rank DIV {size}").alias(name), "rank", "vec_id", "vec")
    ddl = f"{name} long, ids binary, data binary, size int, wide int" + (", top binary, low binary, least binary" if with_extremes else "")
    return cut(numbered.repartition(name).sortWithinPartitions(name, "rank").mapInArrow(partial(_pack, name, with_extremes), ddl))


def _read(row: dict, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}ids"], np.int64)
    return ids, np.frombuffer(row[f"{side}data"], _TYPES[row[f"{side}size"]]).reshape(len(ids), row[f"{side}wide"]).astype(np.float64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}


def _bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of each query and block; infinite where sums are not exact in a double."""
    wide = max(q.shape[1], top.shape[1])
    q, top, low = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (q, top, low))
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    big = float(np.abs(q).max(initial=0)) * max(float(np.abs(top).max(initial=0)), float(np.abs(low).max(initial=0))) * wide
    return bound if big < 1 << 53 else np.full_like(bound, np.inf)


def _scores(q: np.ndarray, d: np.ndarray, big: float) -> np.ndarray:
    """Exact inner products as integers. big: no sum of absolute products is over it."""
    if big < 1 << 24:
        return (q.astype(np.float32) @ d.astype(np.float32).T).astype(np.int64)
    if big < 1 << 53:
        return (q @ d.T).astype(np.int64)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in d] for x in q], object).reshape(len(q), len(d))
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search_run(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int, block: int, kth: np.ndarray | None = None, kth_id: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, vec_id, score) of each query's best k in the run, best first, and how many pairs were scored.

    kth, kth_id: the k-th best (score, vec_id) that a query has elsewhere; what is no better may be left out.
    """
    wide = max(q.shape[1], d.shape[1])
    q, d = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (q, d))
    cuts = np.arange(0, len(d), block)
    top, low = (np.array([f(d[a : a + block], axis=0) for a in cuts]).reshape(-1, wide) for f in (np.max, np.min))
    least_id = np.array([ids[a : a + block].min() for a in cuts], np.int64)
    bound = _bounds(q, top, low)
    big = float(np.abs(q).max(initial=0) * np.abs(d).max(initial=0) * wide)
    order = np.lexsort((np.broadcast_to(least_id, bound.shape), -bound), axis=1)
    row = who = score = np.zeros(0, np.int64)
    kth = np.full(len(q), _NONE) if kth is None else kth.copy()
    kth_id = np.full(len(q), np.iinfo(np.int64).max) if kth_id is None else kth_id.copy()
    work = 0
    for step in range(len(cuts)):
        turn = order[:, step]
        mine_bound = bound[np.arange(len(q)), turn]
        open_ = (mine_bound > kth) | ((mine_bound == kth) & (least_id[turn] <= kth_id))
        if not (mine_bound >= kth).any():
            break  # bounds only fall from here, and k-th scores only rise
        rows, whos, scores = [row], [who], [score]
        for b in np.unique(turn[open_]):
            mine = np.flatnonzero(open_ & (turn == b))
            a = b * block
            own = ids[a : a + block]
            s = _scores(q[mine], d[a : a + block], big)
            work += s.size
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(mine), _NONE)
            r, c = np.nonzero(s >= np.maximum(least, kth[mine])[:, None])
            rows.append(mine[r])
            whos.append(own[c])
            scores.append(s[r, c])
        row, who, score = map(np.concatenate, (rows, whos, scores))
        o = np.lexsort((who, -score, row))
        row, who, score = row[o], who[o], score[o]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row]
        full = rank == k - 1
        better = (score[full] > kth[row[full]]) | ((score[full] == kth[row[full]]) & (who[full] < kth_id[row[full]]))
        kth[row[full][better]], kth_id[row[full][better]] = score[full][better], who[full][better]
        row, who, score = row[rank < k], who[rank < k], score[rank < k]
    return row, who, score, work


def _unit_bounds(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a chunk's runs, each query's bound on each run, and the smallest vec_id of the run's blocks that reach it."""
    _, q = _read(row, "q_")
    numbers, bounds, least = [], [], []
    for r in row["runs"]:
        ids = np.frombuffer(r["least"], np.int64)
        of = _bounds(q, *(np.frombuffer(r[n]).reshape(len(ids), r["wide"]) for n in ("top", "low")))
        best = of.max(1)
        numbers.append(r["run"])
        bounds.append(best)
        least.append(np.where(of == best[:, None], ids, np.iinfo(np.int64).max).min(1))
    return np.array(numbers), np.stack(bounds, 1), np.stack(least, 1)


def _seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each query the run of this chunk with the largest bound; of equal ones that with the smallest vec_id."""
    for row in _rows(batches):
        numbers, bound, least = _unit_bounds(row)
        best = np.lexsort((np.broadcast_to(numbers, bound.shape), least, -bound), axis=1)[:, 0]
        every = np.arange(len(best))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), row["group"])), pa.array(every.astype(np.int32)), pa.array(-bound[every, best]), pa.array(least[every, best]), pa.array(numbers[best])], ["group", "q", "under", "least", "run"])


def _need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, run) pairs with the queries whose bound reaches their threshold, but for the runs that gave the thresholds."""
    for row in _rows(batches):
        numbers, bound, least = _unit_bounds(row)
        kth, kth_id, seed = _thresholds(row["known"], bound.shape[0])
        needs = ((bound > kth[:, None]) | ((bound == kth[:, None]) & (least <= kth_id[:, None]))) & (numbers != seed[:, None])
        at = np.flatnonzero(needs.any(0))
        if len(at):
            qs = [np.flatnonzero(needs[:, i]).astype(np.int32) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["group"])), pa.array(numbers[at]), pa.array(qs, pa.list_(pa.int32()))], ["group", "run", "qs"])


def _thresholds(known: list[dict] | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kth, kth_id, seed = np.full(n, _NONE), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    for x in known or ():
        seed[x["q"]] = x["run"]
        if x["score"] is not None:
            kth[x["q"]], kth_id[x["q"]] = x["score"], x["vec_id"]
    return kth, kth_id, seed


def _solve(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        qids, q = _read(row, "q_")
        qs = np.array(sorted(row["qs"]), np.int32)
        kth, kth_id, _ = _thresholds(row["known"], len(qids))
        at, who, score, work = search_run(q[qs], *_read(row), k, BLOCK, kth[qs], kth_id[qs])
        place = np.arange(len(at)) - np.searchsorted(at, np.arange(len(qs)))[at]
        number = lambda x: pa.array(np.full(len(at), x, np.int64))
        yield pa.RecordBatch.from_arrays([number(row["group"]), pa.array(qs[at]), number(row["run"]), pa.array(qids[qs[at]]), pa.array(place.astype(np.int32)), pa.array(who), pa.array(score), number(work)], ["group", "q", "run", "rep", "place", "vec_id", "score", "work"])


def _searched(pairs: DataFrame, groups: DataFrame, runs: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """pairs (group, run, qs) -> group, q, run, rep, place, vec_id, score; work is the number of products of the pair."""
    units = pairs.join(groups.join(known, "group", "left"), "group").join(runs.drop("top", "low", "least"), "run")
    return units.mapInArrow(partial(_solve, k), "group long, q int, run long, rep long, place int, vec_id long, score long, work long")


def found(placed: DataFrame, every: int, k: int) -> DataFrame:
    """placed (vec_id, leaf, vec) -> of each distinct query vector, named by its smallest vec_id (rep), the best k + 1 of all rows and more."""
    alike = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    candidates = placed.withColumn("n", alike).where(F.col("n") <= k + 1).drop("n")
    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("leaf", "vec").agg(F.min("vec_id").alias("vec_id"))
    runs = _packed(candidates, "run", RUN * BLOCK, True)
    groups = _packed(queries, "group", GROUP, False)
    groups = groups.select("group", *[F.col(c).alias(f"q_{c}") for c in groups.columns if c != "group"])
    chunks = max(1, -(-runs.count() // CHUNK))
    extremes = runs.groupBy(F.pmod("run", F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("run", "wide", "top", "low", "least")).alias("runs"))  # at most CHUNK of them
    units = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    first = units.join(extremes, "chunk").mapInArrow(_seed, "group long, q int, under double, least long, run long")
    first = cut(first.groupBy("group", "q").agg(F.min(F.struct("under", "least", "run"))["run"].alias("run")))
    nothing = F.lit(None).cast("array<struct<q:int,run:long,score:long,vec_id:long>>").alias("known")
    seeds = first.groupBy("group", "run").agg(F.collect_list("q").alias("qs"))  # at most GROUP of them
    begun = cut(_searched(seeds, groups, runs, groups.select("group", nothing), k + 1))
    last = begun.where(F.col("place") == k).select("group", "q", "score", "vec_id")
    known = first.join(last, ["group", "q"], "left").groupBy("group").agg(F.collect_list(F.struct("q", "run", "score", "vec_id")).alias("known"))
    known = cut(known)
    more = units.join(known, "group").join(extremes, "chunk").mapInArrow(_need, "group long, run long, qs array<int>")
    return begun.unionByName(_searched(cut(more), groups, runs, known, k + 1))


def _placed(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    sample = [r[0] for r in usable.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("embedding").collect()]  # at most SAMPLE rows
    wide = max(map(len, sample), default=0)
    tree = Tree(np.floor(np.array([v + [0.0] * (wide - len(v)) for v in sample]).reshape(len(sample), wide) * SCALE), DEPTH)
    one = usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return cut(one.mapInArrow(partial(_place, tree), "vec_id long, leaf int, vec binary"))


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every other row for each row whose vec_id is divisible by ``every``."""
    placed = _placed(vectors)
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))
    best = found(placed, every, k).select("rep", "vec_id", "score").withColumn("n", place).where(F.col("n") <= k + 1)
    lists = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))  # k + 1 entries
    mine = placed.where(F.pmod("vec_id", F.lit(every)) == 0)
    reps = mine.groupBy("vec").agg(F.min("vec_id").alias("rep")).withColumnRenamed("vec", "of")
    asked = mine.join(reps, F.col("vec") == F.col("of")).select(F.col("vec_id").alias("query_id"), "rep")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = asked.join(lists, "rep").select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
