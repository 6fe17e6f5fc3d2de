"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles gives a signature of POSITIONS minima, BITS bits each. Sets of Jaccard similarity 0.85
differ in 15 % of the positions on average. Signatures are cut into chunks: two that differ in fewer than twice as many
positions as there are chunks differ in at most one position of some chunk (pigeonhole), so each chunk is looked up once
for each of its positions left out, and all such pairs share a key. The threshold says how many chunks it takes. Links are
confirmed on the full sets. Sets that are alike may still have signatures further apart, however seldom; `exact` adds keys
that any link shares (its sets' least shingles in one order of all), so that none is lost.

Copies (equal sets) are one vertex. Pairs of a bucket are never emitted: first every member is paired with the bucket's
most central member only. After those links, pairs are left only between different components of a bucket, so members
outside of its largest component are compared with all, and the largest not with itself. For these pairs, members have a
home, a tile of about HOME members of their fullest bucket; a member asks each home that holds a partner within the
signature limit, and is compared with the home's full sets at once. Only links that join components come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import checkpointed, pieces, stored
from headway.llm.words import lowered, mixed, window_hashes, word_hashes, word_spans

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: The signature. Keys are of whole positions; distances are counted on their low bytes, so they are never too large.
POSITIONS, BITS = 64, 16
#: Pairs at the threshold differ in more positions than chunks allow for with at most this probability.
LOSS = 1e-6
#: Members of a bucket whose signatures are compared in one group, members of a home, and askers in one group with it.
TILE, HOME, ASKERS = 2048, 256, 512


def limit_for(percent: int, loss: float = 1e-8) -> int:
    """The signature distance that a pair of similarity percent / 100 exceeds with a probability of `loss` at most."""
    p, tail = 1 - percent / 100, 0.0
    for k in range(POSITIONS, -1, -1):
        tail += math.comb(POSITIONS, k) * p**k * (1 - p) ** (POSITIONS - k)
        if tail > loss:
            return k
    return 0


def chunks_for(percent: int, loss: float = LOSS) -> int:
    """So many chunks that pairs within `limit_for(percent, loss)` positions differ in one position of some chunk at most.

    Chunks of two positions are the least; thresholds so low that they'd need smaller ones need `exact`.
    """
    return min(limit_for(percent, loss) // 2 + 1, POSITIONS // 2)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets as sorted distinct 64-bit hashes, one after another, and where each begins (with a last entry)."""
    data, starts, ends, first = word_spans([lowered(x.encode()) if x else b"" for x in texts])
    words = word_hashes(data, starts, ends)
    runs = window_hashes(words, size)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        sets.append(np.unique(runs[a : b - size + 1]) if b - a >= size else window_hashes(words[a:b], b - a, 1) if b > a else runs[:0])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum([0, *map(len, sets)])


def signatures(hashes: np.ndarray, first: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """(sets, positions) of BITS bits: by position, the minimum of a seeded rehash of the set. Sets must not be empty."""
    out = np.zeros((len(first) - 1, positions), np.uint16)
    rng = np.random.default_rng(12345)
    factors = rng.integers(1, 1 << 63, positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    adds = rng.integers(0, 1 << 63, positions, dtype=np.uint64)
    for k in range(positions if len(out) else 0):
        x = hashes * factors[k] + adds[k]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = mixed(np.minimum.reduceat(x, first[:-1])) >> np.uint64(64 - BITS)
    return out


def chunk_keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """(sets, keys): for each chunk and each of its positions, a hash of the chunk without that position."""
    bounds = np.linspace(0, sig.shape[1], chunks + 1).astype(int)
    wide, keys = sig.astype(np.uint64) + np.uint64(1), []
    for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        for out in range(a, b):
            h = np.full(len(sig), (c << 16) + out + 1, np.uint64)
            for k in range(a, b):
                if k != out:
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + wide[:, k]
            keys.append(mixed(h))
    return np.stack(keys, 1)


def prefix(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The least of a sorted set's hashes, as many as leave fewer than a link needs: two linked sets share one of these.

    A link has percent / 100 of the larger set in common. Of what two sets share, the least is outside of one's prefix
    only if so much of that set isn't shared that the link fails.
    """
    return hashes[: len(hashes) - -(-len(hashes) * percent // 100) + 1]


def _sets(docs: DataFrame, full: bool, percent: int | None = None) -> DataFrame:
    """doc_id with n_shingles, hash (of the set; null if empty), sig and, if a percentage is given, prefix; or, if full, with the set's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                hashes, first = shingle_sets(part.column("text").to_pylist())
                n = np.diff(first)
                raw = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                if full:
                    yield pa.RecordBatch.from_pydict({"id": part.column("doc_id"), "set": pa.array(raw, pa.binary())})
                    continue
                some = np.flatnonzero(n)
                sig: list[bytes | None] = [None] * len(n)
                for i, s in zip(some, signatures(hashes, np.append(first[:-1][some], len(hashes)))):
                    sig[i] = s.tobytes()
                least = [prefix(hashes[a:b], percent).view(np.int64) if percent else None for a, b in zip(first[:-1], first[1:])]
                digests = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in raw]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "hash": pa.array(digests, pa.binary()), "sig": pa.array(sig, pa.binary()), "prefix": pa.array(least, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "id long, set binary" if full else "doc_id long, n_shingles long, hash binary, sig binary, prefix array<long>")


def _keys(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1), chunks)
                ids = np.repeat(batch.column("id").to_numpy(), keys.shape[1])
                for at in range(0, len(ids), 1 << 18):
                    yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel()[at : at + (1 << 18)].view(np.int64)), "id": pa.array(ids[at : at + (1 << 18)])})

    return run


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = [np.frombuffer(x.as_buffer(), np.uint16).astype(np.uint8).tobytes() for x in batch.column("sig")]
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n": batch.column("n"), "sig": pa.array(low, pa.binary())})


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. sets: (id, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("right")), "b")
    fits = F.least(F.octet_length("left"), F.octet_length("right")) * 100 >= percent * F.greatest(F.octet_length("left"), F.octet_length("right"))
    return joined.filter(fits).select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over edges (a, b), for each id of an edge.

    Each round hooks every component onto its least neighbour, follows those pointers to their ends by doubling, and
    contracts the edges; the rounds grow with the logarithm of a component's size.
    """
    left = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = checkpointed(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("component", F.col("id")))
    while not left.isEmpty():
        to = left.select(F.col("b").alias("x"), F.col("a").alias("y")).groupBy("x").agg(F.min("y").alias("y"))
        to = checkpointed(to)
        while True:
            up = to.select(F.col("x").alias("y"), F.col("y").alias("z"))
            next_to = checkpointed(to.join(up, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")))
            to = next_to.select("x", "y")
            if next_to.filter("moved").isEmpty():
                break
        labels = checkpointed(labels.join(to, F.col("component") == F.col("x"), "left").select("id", F.coalesce("y", "component").alias("component")))
        point = lambda df, c: df.join(to, F.col(c) == F.col("x"), "left").withColumn(c, F.coalesce("y", c)).drop("x", "y")
        left = point(point(left, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = checkpointed(left)
    return labels


def _asked(limit: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        """For each asker of the tile, the homes of its partners among the hosts: of other components, near enough in size and signature."""
        ids, comp, home, n, asks, bulk = (group[c].to_numpy() for c in ("id", "component", "home", "n", "asks", "bulk"))
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint64).reshape(len(ids), -1).view(np.uint8)
        hosts = np.flatnonzero(~asks)
        hosts = hosts[np.argsort(n[hosts], kind="stable")]
        size, theirs = n[hosts], sig[hosts]
        out = {"id": [], "homes": []}
        for i in np.flatnonzero(asks):
            a, b = np.searchsorted(size, [-(-n[i] * percent // 100), n[i] * 100 // percent + 1])
            other = hosts[a:b]
            # two askers meet twice: the smaller id asks
            fits = (comp[other] != comp[i]) & (bulk[other] | (ids[other] > ids[i]))
            fits &= (theirs[a:b] != sig[i]).sum(1) <= limit
            if fits.any():
                out["id"].append(ids[i])
                out["homes"].append(np.unique(home[other[fits]]))
        return pa.table({"id": pa.array(out["id"], pa.int64()), "homes": pa.array(out["homes"], pa.list_(pa.int64()))})

    return run


def _flat(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sets' hashes in a row, and the set of each."""
    n = [len(x) // 8 for x in sets]
    return np.frombuffer(b"".join(sets), np.uint64), np.repeat(np.arange(len(sets)), n)


def _joining(percent: int):
    def run(home: pa.Table, askers: pa.Table) -> pa.Table:
        """Links between askers and members of a home, as many as it takes to join their components."""
        out = {"a": [], "b": []}
        if home.num_rows and askers.num_rows:
            ids, comp = home["id"].to_numpy(), home["component"].to_numpy()
            values, owner = _flat(home["set"].to_pylist())
            order = np.argsort(values, kind="stable")
            values, owner, sizes = values[order], owner[order], np.bincount(owner, minlength=len(ids))
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while up.get(x, x) != x:
                    x = up[x]
                return x

            for at in range(0, askers.num_rows, 32):
                part = askers.slice(at, 32)
                v, k = _flat(part["set"].to_pylist())
                n = np.bincount(k, minlength=part.num_rows)
                lo, hi = np.searchsorted(values, v, side="left"), np.searchsorted(values, v, side="right")
                runs = hi - lo
                within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                both = np.bincount(np.repeat(k, runs) * len(ids) + owner[np.repeat(lo, runs) + within], minlength=part.num_rows * len(ids)).reshape(part.num_rows, len(ids))
                mine, my_comp = part["id"].to_numpy(), part["component"].to_numpy()
                linked = (100 * both >= percent * (n[:, None] + sizes - both)) & (my_comp[:, None] != comp)
                for i, j in zip(*np.nonzero(linked)):
                    x, y = top(int(my_comp[i])), top(int(comp[j]))
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        out["a"].append(int(min(mine[i], ids[j])))
                        out["b"].append(int(max(mine[i], ids[j])))
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return run


def link(docs: DataFrame, percent: int = PERCENT, limit: int | None = None, exact: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id (least doc_id of those linked with it, directly or over others), kept (it is that document).

    Documents are linked if 100 * intersection >= percent * union. A link shares no key with a probability of LOSS at
    most. Of the pairs that share a key, those beyond `limit` positions aren't confirmed on their sets: by default
    `limit_for(percent)`, 1e-8 of the links; POSITIONS confirms all. If `exact`, all links share a key and all pairs that
    do are confirmed, at the price of (100 - percent) hundredths of the shingles as further keys.

    Null and empty texts, and texts without words, have 0 shingles and are linked with nothing. Rows of the same doc_id
    count as one document. Rows without doc_id keep a null component and aren't kept, unless their text equals that of
    another. Empty table: no rows. Other columns are ignored.
    """
    limit = POSITIONS if exact else limit_for(percent) if limit is None else limit
    sets = stored(_sets(docs, False, percent if exact else None), "shingle-sets")
    vertices = stored(sets.filter("hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix")), "vertices")
    keys = vertices.select("id", "sig").mapInArrow(_keys(chunks_for(percent)), "key long, id long")
    keys = stored(keys.union(vertices.select(F.explode("prefix"), "id")) if exact else keys, "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(keys.join(sizes, "key"), "buckets")
    central = members.groupBy("id").agg(F.sum("size").alias("central"))
    ranked = members.join(central, "id")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("neg"))).alias("m")).select("key", (-F.col("m.neg")).alias("leader"))
    slim = vertices.select("id", "n", "sig").mapInArrow(_low_bytes, "id long, n long, sig binary")
    star = members.join(leaders, "key").filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    star = star.join(slim.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(slim.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    star = star.filter(F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb")).select("a", "b")
    needed = central.select(F.col("id").alias("doc_id"))
    full = stored(_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "left_semi"), True).filter("octet_length(set) > 0"), "full-sets")
    edges = checkpointed(confirmed(star, full, percent))
    labels = components(edges)
    part_of = F.coalesce("component", "id").alias("component")
    held = members.join(labels, "id", "left").select("key", "id", "size", part_of)
    parts = held.groupBy("key", "component").agg(F.count("*").alias("members"))
    mixed_keys = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("members", "component")).alias("m")).filter("parts > 1").select("key", F.col("m.component").alias("largest"), F.col("m.members").alias("bulk_size"))
    held = stored(held.join(mixed_keys, "key"), "mixed-buckets")
    full_bucket = held.groupBy("id").agg(F.max(F.struct("size", "key")).alias("m"), F.first("component").alias("component"))
    homes = stored(full_bucket.select("id", "component", F.xxhash64("m.key", F.pmod(F.xxhash64("id"), F.ceil(F.col("m.size") / HOME))).alias("home")), "homes")
    held = held.join(homes.select("id", "home"), "id").join(slim, "id").withColumn("bulk", F.col("component") == F.col("largest"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    held = held.withColumn("rows", tiles(F.col("size") - F.col("bulk_size"))).withColumn("columns", tiles(F.col("size")))
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    columns = ["key", "id", "component", "home", "n", "sig", "bulk"]
    askers = held.filter("not bulk").select(*columns, F.lit(True).alias("asks"), place(F.col("rows")).alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    hosts = held.select(*columns, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), place(F.col("columns")).alias("column"))
    # dealt by count, not by bytes: these rows are few, and each costs much time
    tiled = askers.unionAll(hosts).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "row", "column")
    asks = tiled.groupBy("key", "row", "column").applyInArrow(_asked(limit, percent), "id long, homes array<long>")
    asks = asks.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("homes"))).alias("homes")).select("id", F.explode("homes").alias("home"))
    asks = stored(asks.join(homes.select("id", "component"), "id"), "asks")
    groups = asks.groupBy("home").agg(F.ceil(F.count("*") / ASKERS).alias("groups"))
    columns = [F.col(c).alias(c) for c in ("home", "group", "id", "component", "set")]  # new columns, as both sides of the cogroup have the same sources
    askers = asks.join(groups, "home").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups"))).join(full, "id").select(*columns)
    hosts = homes.join(groups, "home").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).join(full, "id").select(*columns)
    joins = hosts.groupBy("home", "group").cogroup(askers.groupBy("home", "group")).applyInArrow(_joining(percent), "a long, b long")
    labels = components(edges.union(checkpointed(joins)))
    named = vertices.select("hash", "id").join(labels, "id", "left").select("hash", F.coalesce("component", "id").alias("found"))
    rows = sets.select("doc_id", "n_shingles", "hash").join(named, "hash", "left").withColumn("component_id", F.coalesce("found", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
