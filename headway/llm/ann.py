"""Approximate nearest neighbours by inner product: inverted lists, scanned in blocks of rotated dimensions.

Vectors get one more dimension that makes all of equal length, so that the nearest by distance is the nearest by inner
product, and are rotated at random. Lists come from k-means over a bounded sample. In each probed list, partial
distances over the first blocks of dimensions are tested against the current k-th distance; candidates that fail are
abandoned. Equal vectors are held once with their smallest ids, so copies cost nothing; long lists are cut into chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import checkpointed

#: k-means learns from about SAMPLE vectors; LIST vectors a list are aimed at, with MAX_LISTS lists at most.
SAMPLE, LIST, MAX_LISTS = 20_000, 512, 4096
#: Vectors in a chunk of a list, dimensions in a block, and the test's strictness.
CHUNK, BLOCK, EPSILON = 4096, 16, 1.3
#: So many queries are answered by brute force; a query then probes as many lists as hold RECALL of their neighbours.
TRIALS, RECALL = 100, 0.96
#: Lists probed first, for a limit on the k-th distance.
FIRST = 4


def valid(vector: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Space:
    """The rotated space and its lists. longest: the largest squared length of all vectors."""

    def __init__(self, sample: np.ndarray, longest: float, n_lists: int, seed: int = 0, rounds: int = 8):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.longest = longest
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.float32)
        x = self.points(sample)
        self.centres = x[rng.choice(len(x), min(n_lists, len(x)), replace=False)]
        for _ in range(rounds):
            to = self.nearest(x, 1)[:, 0]
            sums, n = np.zeros_like(self.centres), np.bincount(to, minlength=len(self.centres))
            np.add.at(sums, to, x)
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centres).astype(np.float32)

    def points(self, vectors: np.ndarray) -> np.ndarray:
        """Candidates in the rotated space."""
        v = vectors.astype(np.float64)
        more = np.sqrt(np.maximum(0, self.longest - (v * v).sum(1)))
        return np.hstack([v, more[:, None]]).astype(np.float32) @ self.rotation

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        """Queries in the rotated space, scaled to the candidates' length: that keeps their order and tightens the distances."""
        v = vectors.astype(np.float64)
        v = v * np.sqrt(self.longest / np.maximum((v * v).sum(1), 1e-300))[:, None]
        return np.hstack([v, np.zeros((len(v), 1))]).astype(np.float32) @ self.rotation

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k nearest centres of each point, nearest first."""
        k = min(k, len(self.centres))
        out = np.zeros((len(x), k), np.int32)
        half = (self.centres * self.centres).sum(1) / 2
        for at in range(0, len(x), 1024):
            far = half - x[at : at + 1024] @ self.centres.T
            near = np.argpartition(far, k - 1, axis=1)[:, :k] if k < len(half) else np.tile(np.arange(k), (len(far), 1))
            out[at : at + 1024] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), 1), 1)
        return out


def scan(x: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int, block: int = BLOCK, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) that may be among the k nearest of the query.

    limit: a squared distance of each query, within which its k nearest are known to be; infinite where nothing is known
    yet, which the k nearest by the first block then bound. After d of D dimensions a pair is abandoned if
    partial * D / d > limit * (1 + epsilon / sqrt(d)) ** 2. While most pairs are left a block is a matrix product over
    all of them, later it is read for the pairs left only.
    """
    size, limit = x.shape[1], limit.copy()
    part = np.zeros((len(q), len(x)), np.float32)
    alive = np.ones(part.shape, bool)
    d, pairs, sums = 0, None, None
    while d < size:
        to = min(size, d + block)
        xb, qb = x[:, d:to], q[:, d:to]
        if pairs is None:
            part += np.maximum(0, (qb * qb).sum(1)[:, None] + (xb * xb).sum(1) - 2 * qb @ xb.T)
            if not d:
                for i in np.flatnonzero(np.isinf(limit)) if len(x) > k else ():
                    first = np.argpartition(part[i], k - 1)[:k]
                    limit[i] = ((x[first] - q[i]) ** 2).sum(1).max()
            d = to
            alive &= part * (size / d) <= (limit * (1 + epsilon / np.sqrt(d)) ** 2 * (1 + 1e-5) if d < size else limit * (1 + 1e-4))[:, None]
            if alive.mean() < 0.25:
                pairs = np.nonzero(alive)
                sums = part[pairs]
        else:
            i, j = pairs
            sums = sums + ((xb[j] - qb[i]) ** 2).sum(1)
            d = to
            keep = sums * (size / d) <= limit[i] * ((1 + epsilon / np.sqrt(d)) ** 2 * (1 + 1e-5) if d < size else 1 + 1e-4)
            pairs, sums = (i[keep], j[keep]), sums[keep]
    return pairs if pairs is not None else np.nonzero(alive)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows (query, rep, score, ...) of each query."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def _top(query: np.ndarray, rep: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best."""
    order = np.lexsort((rep, -score, query))
    q = query[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def _table(query: np.ndarray, rep: np.ndarray, score: np.ndarray) -> dict[str, np.ndarray]:
    return {"query": query.astype(np.int64), "rep": rep.astype(np.int64), "score": score.astype(np.float64)}


def probes_for(placed: DataFrame, space: Space, queries: list[tuple[int, list[float]]], k: int, recall: float = RECALL) -> int:
    """As many lists as hold `recall` of the k nearest of the given queries, found by brute force over all of `placed`."""
    reps, q = np.array([r for r, _ in queries]), np.array([v for _, v in queries])
    shared = placed.sparkSession.sparkContext.broadcast((reps, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, q = shared.value
        for batch in batches:
            if batch.num_rows:
                score = q @ _matrix(batch.column("embedding")).astype(np.float64).T
                rep, to = batch.column("rep").to_numpy(), batch.column("list").to_numpy()
                i, j = (x.ravel() for x in np.indices(score.shape))
                other = reps[i] != rep[j]
                i, j = i[other], j[other]
                top = _top(reps[i], rep[j], score[i, j], k)
                yield pa.RecordBatch.from_pydict(_table(reps[i][top], rep[j][top], score[i, j][top]) | {"list": to[j][top].astype(np.int32)})

    near = _best(placed.select("rep", "embedding", "list").mapInArrow(run, "query long, rep long, score double, list int"), k).select("query", "list").collect()
    order = space.nearest(space.queries(q), len(space.centres))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1], dtype=np.int32)[None, :].repeat(len(order), 0), 1)
    row = {int(r): i for i, r in enumerate(reps)}
    ranks = np.sort([int(rank[row[x.query], x.list]) for x in near])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1


def search(vectors: DataFrame, queries: Column, k: int = 20, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors(vec_id, embedding) for which `queries` holds, its k nearest found by inner product, itself left out.

    Scores are inner products of the original vectors in double precision; ties go to the smaller vec_id. Rows with a
    null id, with vectors that `valid` refuses, or of another length than most, take no part. Of repeated rows of an id
    and vector one counts. Fewer candidates than k: all. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return empty
    rows = rows.filter(F.size("embedding") == sizes[0].d)
    vector = dict(rows.dtypes)["embedding"]
    salted = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    ids = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
    index = checkpointed(ids.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids")).withColumn("rep", F.col("ids")[0]))
    asked = checkpointed(rows.filter(queries).distinct().join(index.select("embedding", "rep"), "embedding").select("vec_id", "rep"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = index.agg(F.count("*"), F.max(norm)).first()
    draw = lambda df, most, salt: sorted((r.rep, r.embedding) for r in df.filter(F.pmod(F.xxhash64(F.lit(seed + salt), "rep"), F.lit(1 << 30)) < (1 << 30) * min(1.0, most / n)).select("rep", "embedding").collect()) or [(r.rep, r.embedding) for r in df.orderBy("rep").limit(1).collect()]
    space = Space(np.array([v for _, v in draw(index, SAMPLE, 0)]), longest, max(1, min(MAX_LISTS, round(n / LIST))), seed)
    shared = spark.sparkContext.broadcast(space)

    def assign(n_lists: int, as_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("embedding"))
                    to = shared.value.nearest(shared.value.queries(x) if as_query else shared.value.points(x), n_lists)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(to), pa.list_(pa.int32()))], [*batch.schema.names, "lists"])

        return run

    schema = f"rep long, embedding {vector}, lists array<int>"
    placed = checkpointed(index.select("rep", "embedding").mapInArrow(assign(1, False), schema).select("rep", "embedding", F.col("lists")[0].alias("list")))
    probes = probes_for(placed, space, draw(index, TRIALS, 1), k)
    chunks = placed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    placed = placed.join(F.broadcast(chunks), "list").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))  # one row a list: MAX_LISTS at most
    wanted = index.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "embedding").mapInArrow(assign(probes, True), schema)

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_table(*np.zeros((3, 0)))]
        if left.num_rows and right.num_rows:
            v, w = _matrix(left["embedding"]).astype(np.float64), _matrix(right["embedding"]).astype(np.float64)
            x, q = shared.value.points(v), shared.value.queries(w)
            reps, asks, limit = left["rep"].to_numpy(), right["rep"].to_numpy(), right["far"].to_numpy()
            for at in range(0, len(q), 256):
                i, j = scan(x, q[at : at + 256], limit[at : at + 256], k + 1)
                i = i + at
                score = np.einsum("ij,ij->i", v[j], w[i])
                top = _top(asks[i], reps[j], score, k + 1)
                out.append(_table(asks[i][top], reps[j][top], score[top]))
        return pa.table({c: np.concatenate([o[c] for o in out]) for c in out[0]})

    def probed(part: DataFrame) -> DataFrame:
        """part: rep, embedding, far, lists to probe."""
        each = part.select("rep", "embedding", "far", F.explode("lists").alias("list")).join(F.broadcast(chunks), "list")
        each = each.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
        return placed.select("list", "chunk", "rep", "embedding").groupBy("list", "chunk").cogroup(each.groupBy("list", "chunk")).applyInArrow(probe, "query long, rep long, score double")

    near = checkpointed(_best(probed(wanted.select("rep", "embedding", F.lit(float("inf")).alias("far"), F.slice("lists", 1, FIRST).alias("lists"))), k + 1))
    # the squared distance that belongs to a score, with the query scaled to the common length
    kth = near.groupBy(F.col("query").alias("rep")).agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    far = F.when(F.col("n") > k, 2 * longest - 2 * F.col("kth") * F.sqrt(F.lit(longest) / norm) + 1e-5 * longest).otherwise(F.lit(float("inf")))
    rest = wanted.join(kth, "rep").select("rep", "embedding", far.alias("far"), F.slice("lists", FIRST + 1, MAX_LISTS).alias("lists"))
    found = _best(near.union(probed(rest)), k + 1).join(index.select("rep", "ids"), "rep")
    pairs = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id")))))
    answer = found.groupBy("query").agg(F.slice(F.array_sort(pairs), 1, k + 1).alias("near"))
    each = asked.join(answer, F.col("rep") == F.col("query")).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda p: p["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    return each.select("query_id", F.posexplode("near").alias("p", "n")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.far")).alias("score"))
