"""Substring dedup with a log-structured fingerprint index.

Every window of WINDOW words has a fingerprint. An index holds immutable runs: rows of (bucket, sorted fingerprints,
the least doc_id of each). A batch of documents is merge-joined with all runs bucket by bucket and becomes a run itself;
FANOUT runs of a level are merged into one of the next. Matches name a witness document and count only after a second hash
of both windows' words, the witness's read from its text, has been compared: both hashes mix every 8 bytes of a word, by
different constants, so 128 bits of the words are equal in all. The index stays where it is: a
manifest names its runs, so a later session opens it and adds the next batch.

Windows are combined within some MB of text before they are shuffled, so a passage in a third of all documents gives one
fingerprint a block. Batches are ranges of doc_id in ascending order: what the index knows lies in smaller ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import pieces, scratch, shuffles_freed, stored
from headway.llm.words import mixed, window_hashes, word_hashes, word_spans

WINDOW = 13
BATCHES, FANOUT = 6, 4
#: The index is kept in so many slices of its buckets; a merge reads and shuffles one slice at a time.
SLICES = 4
#: Bytes of text whose windows are made and combined together.
PIECE = 1 << 20
#: Fingerprints aimed at in a bucket of the index.
BUCKET = 500_000


def packed(a: np.ndarray, rising: bool = False) -> bytes:
    """64-bit integers as compressed byte planes, of differences if they rise."""
    a = np.ascontiguousarray(a).view(np.uint64)
    if rising and len(a):
        a = np.diff(a, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(b: bytes, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    a = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(a, dtype=np.uint64) if rising else a


class Windows:
    """The windows of some texts, in order: hash, first word (at) and text of each. first: each text's first word."""

    def __init__(self, texts: list[bytes], size: int = WINDOW):
        self.size = size
        self.data, self.starts, self.ends, self.first = word_spans(texts)
        of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        h = window_hashes(word_hashes(self.data, self.starts, self.ends), size)
        self.inside = of[: len(h)] == of[size - 1 :][: len(h)]
        self.at = np.flatnonzero(self.inside)
        self.second: np.ndarray | None = None
        self.hash, self.text = h[self.inside], of[: len(h)][self.inside]

    def digests(self, of: np.ndarray) -> np.ndarray:
        """A second hash of the words of the windows numbered `of`."""
        if self.second is None:
            self.second = window_hashes(word_hashes(self.data, self.starts, self.ends, True), self.size, 2)[self.inside]
        return self.second[of]


def _raw(column) -> list[bytes]:
    return [x.encode() if x else b"" for x in column.to_pylist()]


_ENTRY = "bucket int, kind string, hashes binary, docs binary, others binary"
_ENTRY_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("hashes", pa.binary()), ("docs", pa.binary()), ("others", pa.binary())])


def _entries(buckets: int, size: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by bucket of the block's windows, each with its least document; and what is settled within the block."""
        for batch in batches:
            for part in pieces(batch, "text", piece):
                part = part.take(pa.array(np.argsort(part.column("doc_id").to_numpy(), kind="stable")))
                ids = part.column("doc_id").to_numpy()
                w = Windows(_raw(part.column("text")), size)
                if not len(w.hash):
                    continue
                order = np.argsort(w.hash, kind="stable")
                h, doc = w.hash[order], ids[w.text[order]]
                new = np.r_[True, h[1:] != h[:-1]]
                head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                inner = np.flatnonzero(doc != doc[head])
                inner = inner[np.r_[True, (h[inner][1:] != h[inner][:-1]) | (doc[inner][1:] != doc[inner][:-1])]] if len(inner) else inner
                rows = []
                if len(inner):
                    heads, back = np.unique(head[inner], return_inverse=True)
                    inner = inner[w.digests(order[inner]) == w.digests(order[heads])[back]]
                    rows.append((int(ids[0]) % buckets, "settled", packed(h[inner], True), packed(doc[inner]), b""))
                h, doc = h[new], doc[new]
                to = (h & np.uint64(buckets - 1)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(to[by]) != 0, True])
                rows += [(int(to[by[x]]), "new", packed(h[by[x:y]], True), packed(doc[by[x:y]]), b"") for x, y in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY_ARROW)], schema=_ENTRY_ARROW)

    return run


def _merged(hashes: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by hash, then document."""
    h, d = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, docs))
    d = d.view(np.int64)
    order = np.lexsort((d, h))
    return h[order], d[order]


def _segments(group: pa.Table, kind: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rows = group.filter(pc.equal(group["kind"], kind))
    return [unpacked(x, True) for x in rows["hashes"].to_pylist()], [unpacked(x).view(np.int64) for x in rows["docs"].to_pylist()]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _ENTRY_ARROW)], schema=_ENTRY_ARROW)


def _merge_join(group: pa.Table) -> pa.Table:
    """A bucket's batch against its runs: the batch's sorted run, and its hits with their witnesses."""
    rows = [tuple(r.values()) for r in group.filter(pc.equal(group["kind"], "settled")).to_pylist()]
    h, doc = _merged(*_segments(group, "new"))
    if not len(h):
        return _table(rows)
    new = np.r_[True, h[1:] != h[:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    witness, hit = doc[head], doc != doc[head]
    for old, owner in zip(*_segments(group, "run")):
        k = np.minimum(np.searchsorted(old, h), len(old) - 1)
        found = (old[k] == h) & (owner[k] < doc)
        witness, hit = np.where(found, np.minimum(owner[k], witness), witness), hit | found
    bucket = group["bucket"][0].as_py()
    rows.append((bucket, "run", packed(h[new], True), packed(doc[new]), b""))
    if hit.any():
        rows.append((bucket, "hit", packed(h[hit], True), packed(doc[hit]), packed(witness[hit])))
    return _table(rows)


def _compact(group: pa.Table) -> pa.Table:
    """A bucket's runs as one; of equal fingerprints the least document stays."""
    h, doc = _merged(*_segments(group, "run"))
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    return _table([(group["bucket"][0].as_py(), "run", packed(h[new], True), packed(doc[new]), b"")])


class FingerprintIndex:
    """Runs of window fingerprints below `path`. buckets: a power of two, fixed for the index's life.

    Each `add` ends by writing a new manifest, and only then drops runs that were merged, so an index whose session was
    lost opens as it was after its last whole `add`; what that one had begun is overwritten or left unread.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, window: int = WINDOW, fanout: int = FANOUT):
        self.spark, self.path, self.buckets, self.window, self.fanout = spark, path, buckets, window, fanout
        self.runs: list[tuple[int, str]] = []  # (level, path), oldest first
        self.made = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index below `path` as its last manifest has it."""
        names = sorted(x for x in cls(spark, path, 1)._folders(path) if x.startswith("manifest-"))
        if not names:
            raise ValueError(f"no index below {path}")
        held = json.loads(spark.read.text(f"{path}/{names[-1]}").first()[0])
        index = cls(spark, path, held["buckets"], held["window"], held["fanout"])
        index.made, index.runs = held["made"], [(n, f"{path}/{p}") for n, p in held["runs"]]
        return index

    def _commit(self) -> None:
        text = json.dumps({"buckets": self.buckets, "window": self.window, "fanout": self.fanout, "made": self.made, "runs": [(n, p.rpartition("/")[2]) for n, p in self.runs]})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{self.made:06d}")

    def _write(self, df: DataFrame, path: str) -> None:
        with shuffles_freed(self.spark):
            df.write.mode("overwrite").option("compression", "none").partitionBy("kind").parquet(path)

    def _read(self, path: str, kind: str) -> DataFrame:
        rows = self.spark.read.schema("bucket int, hashes binary, docs binary, others binary").parquet(f"{path}/kind={kind}")
        return rows.select("bucket", F.lit(kind).alias("kind"), "hashes", "docs", "others")

    def _folders(self, path: str) -> set[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()

    def _drop(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _slices(self, new: DataFrame | None, runs: list[str], job) -> tuple[str, list[tuple[str, str]]]:
        """Applies `job` to the buckets of new rows and runs, slice by slice: the new run's path, and the (path, kind) written."""
        self.made += 1
        path, wrote = f"{self.path}/{self.made:06d}", []
        for k in range(SLICES):
            parts = [self._read(f"{p}/{k}", "run") for p in runs if "kind=run" in self._folders(f"{p}/{k}")]
            if new is not None:
                parts.append(new.filter(F.col("bucket") % SLICES == k))
            rows = parts[0] if parts else None
            for p in parts[1:]:
                rows = rows.unionAll(p)
            if rows is None:
                continue
            self._write(rows.groupBy("bucket").applyInArrow(job, _ENTRY), f"{path}/{k}")
            wrote += [(f"{path}/{k}", x.removeprefix("kind=")) for x in sorted(self._folders(f"{path}/{k}")) if x.startswith("kind=")]
        return path, wrote

    def add(self, docs: DataFrame) -> dict[str, list[DataFrame]]:
        """Merge-joins a batch of docs(doc_id, text) with the runs, and adds its run. Returns its matches: `hit` (to be verified: others are witnesses) and `settled` (verified within a block)."""
        batch = f"{self.path}/batch-{self.made}"
        with shuffles_freed(self.spark):
            docs.mapInArrow(_entries(self.buckets, self.window, PIECE), _ENTRY).write.mode("overwrite").option("compression", "none").parquet(batch)
        path, wrote = self._slices(self.spark.read.schema(_ENTRY).parquet(batch), [p for _, p in self.runs], _merge_join)
        self._drop(batch)
        merged: list[str] = []
        if any(kind == "run" for _, kind in wrote):
            self.runs.append((0, path))
            merged = self._compacted()
        self._commit()
        for p in merged:
            self._drop_runs(p)
        return {k: [self._read(p, kind) for p, kind in wrote if kind == k] for k in ("hit", "settled")}

    def verified(self, found: dict[str, list[DataFrame]], history: DataFrame) -> DataFrame | None:
        """(doc, hash, digest) of matches that `add` returned; digest is null where they are settled. history: (doc_id, text) of all documents added so far. None if there are no matches."""
        sure = _matches(found["settled"]).select("doc", "hash", F.col("other").alias("digest")) if found["settled"] else None
        if found["hit"]:
            hits = _matches(found["hit"]).withColumnRenamed("other", "witness")
            asked = hits.select("witness", "hash").distinct().groupBy(F.col("witness").alias("doc_id")).agg(F.collect_list("hash").alias("asked"))
            told = stored(history.join(asked, "doc_id").mapInArrow(_witnessed(self.window, PIECE), "hash long, witness long, digest long"), "digests")
            checked = hits.join(told, ["hash", "witness"]).select("doc", "hash", "digest")
            sure = checked if sure is None else sure.unionAll(checked)
        return sure

    def _compacted(self) -> list[str]:
        """Merges full levels; returns the runs that aren't needed any more."""
        level, merged = self.runs[-1][0], []
        while sum(n == level for n, _ in self.runs) >= self.fanout:
            old = [p for n, p in self.runs if n == level]
            path, _ = self._slices(None, old, _compact)
            self.runs = [r for r in self.runs if r[0] != level]
            level += 1
            self.runs.append((level, path))
            merged += old
        return merged

    def _drop_runs(self, path: str) -> None:
        for k in range(SLICES):
            self._drop(f"{path}/{k}/kind=run")

    def drop(self) -> None:
        """Deletes the runs; matches stay."""
        for _, path in self.runs:
            self._drop_runs(path)
        self.runs = []
        self._commit()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            h = unpacked(r["hashes"], True).view(np.int64)
            other = unpacked(r["others"]).view(np.int64) if r["others"] else None
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(unpacked(r["docs"]).view(np.int64)), pa.nulls(len(h), pa.int64()) if other is None else pa.array(other)], ["hash", "doc", "other"])


def _matches(parts: list[DataFrame]) -> DataFrame:
    """(hash, doc, other) of packed rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("hashes", "docs", "others").mapInArrow(_unpack, "hash long, doc long, other long")


def _witnessed(size: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digests of the asked windows of each witness."""
        for batch in batches:
            for part in pieces(batch, "text", piece):
                w = Windows(_raw(part.column("text")), size)
                cuts = np.searchsorted(w.text, np.arange(part.num_rows + 1))
                out = []
                for k, (doc, asked) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("asked"))):
                    found, at = np.unique(w.hash[cuts[k] : cuts[k + 1]].view(np.int64), return_index=True)
                    keep = np.isin(found, asked.values.to_numpy())
                    out.append((found[keep], np.full(keep.sum(), doc), w.digests(cuts[k] + at[keep]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (zip(*out) if out else [[]] * 3)], ["hash", "witness", "digest"])

    return run


def _both(h: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Hash and digest as one."""
    return mixed(h.view(np.uint64)) ^ digest.view(np.uint64)


def _kept(size: int, keep: list[str], piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", piece):
                texts, verdicts = _raw(part.column("text")), part.column("verdicts")
                some = [k for k in range(len(texts)) if verdicts[k].is_valid]
                w = Windows([texts[k] for k in some], size)
                cuts = np.searchsorted(w.text, np.arange(len(some) + 1))
                gone: dict[int, np.ndarray] = {}
                for i, k in enumerate(some):
                    hashes, digests = (verdicts[k].values.field(c) for c in range(2))
                    sure = digests.is_null().to_numpy(zero_copy_only=False)
                    v, told = hashes.to_numpy(), digests.fill_null(0).to_numpy()
                    h = w.hash[cuts[i] : cuts[i + 1]]
                    hit = np.isin(h.view(np.int64), v[sure])
                    ask = np.flatnonzero(~hit & np.isin(h.view(np.int64), v[~sure]))
                    hit[ask] = np.isin(_both(h[ask], w.digests(cuts[i] + ask)), _both(v[~sure], told[~sure]))
                    at = w.at[cuts[i] : cuts[i + 1]][hit] - w.first[i]
                    edge = np.zeros(int(w.first[i + 1] - w.first[i]) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                    gone[k] = np.cumsum(edge)[:-1] > 0
                counts, removed, kept = [], [], []
                for k, raw in enumerate(texts):
                    words = raw.split()  # at the same characters as WORD
                    counts.append(len(words))
                    removed.append(int(gone[k].sum()) if k in gone else 0)
                    kept.append(b" ".join(compress(words, (~gone[k]).tolist()) if removed[-1] else words).decode())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*keep, "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, n_words, n_removed and kept_text (kept words joined by one space), one row per row of docs(doc_id, text).

    A word is removed if a window that covers it occurs in a document with a smaller doc_id, in the texts as given.
    Null and empty texts have no words; shorter texts than a window lose none. Rows without doc_id are compared with
    nothing. Rows of one doc_id don't remove each other's words; all lose what smaller ids have. Empty table: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in keep if c not in ("doc_id", "text")))
    some = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    stats = some.agg(F.sum(F.octet_length("text")), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], F.lit(1000))).first()
    buckets = 1 << max(4, int(np.ceil(np.log2(max(1, (stats[0] or 0) / 6 / BUCKET)))))
    index = FingerprintIndex(spark, scratch(spark, "fingerprints"), buckets, window)
    bounds = sorted(set(stats[1] or []))
    found: dict[str, list[DataFrame]] = {"hit": [], "settled": []}
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = some.filter((F.lit(True) if low is None else F.col("doc_id") > low) & (F.lit(True) if high is None else F.col("doc_id") <= high))
        for k, v in index.add(part).items():
            found[k] += v
    index.drop()  # it served this call only
    return cut(rows, index.verified(found, some), window, keep)


def add_batch(index: FingerprintIndex, docs: DataFrame, history: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds a batch to a lasting index and returns its rows as `remove_repeats` does, cut by what the batch and the index know of smaller doc_ids. history: (doc_id, text) of the batches before; earlier batches aren't cut anew."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in keep if c not in ("doc_id", "text")))
    some = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    found = index.add(some)
    known = some if history is None else some.unionAll(history.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text"))
    return cut(rows, index.verified(found, known), index.window, keep)


def cut(rows: DataFrame, sure: DataFrame | None, window: int, keep: tuple[str, ...]) -> DataFrame:
    """The rows without the words of the verified matches."""
    names = ["doc_id", *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
    if sure is None:
        joined = rows.withColumn("verdicts", F.lit(None).cast("array<struct<hash: bigint, digest: bigint>>"))
    else:
        per_doc = sure.groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("hash", "digest")).alias("verdicts"))
        joined = rows.join(stored(per_doc, "removals"), F.col("doc_id") == F.col("d"), "left")
    return joined.select(*dict.fromkeys([*names, "text", "verdicts"])).mapInArrow(_kept(window, names, PIECE), f"{schema}, n_words long, n_removed long, kept_text string")
