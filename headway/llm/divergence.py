"""Audit of how sources of a language differ in their terms, over hash-consed segment trees of term counts.

Each group (a source of a language, and the language as a whole) has a binary tree over the language's term ids, a leaf a
term with its count. Nodes are hash-consed: subtrees with equal counts are one node, within a group and between groups,
so all the rare terms that a source lacks are a few nodes. Two groups are compared by walking both trees down together; a
pair of nodes that was met before isn't walked again but counted, so it is priced once.

The trees are cut into chunks of about CHUNK terms, a subtree each, and a chunk's groups into tiles of TILE sources; a
task holds the counts of one chunk and two tiles, and the sums of chunks are added up by Spark. A hot language or source
is dealt over its chunks. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import pieces, stored

#: A term is a maximal run of A-Z, a-z and characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms are kept from so many documents of their language on; their smoothing; what shares are out of; terms reported of a group.
LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 10**9, 50
#: Terms of a chunk, about; sources of a tile.
CHUNK, TILE = 8192, 32
#: Different terms that a task counts before it hands them on.
HELD = 200_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms in UTF-8, A-Z lower-cased: what isn't part of one becomes a space."""
    return (text or "").encode().translate(_TABLE).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's texts, combined as far as HELD entries go; each group once a batch with the term null."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            size = len(counts) + 1
            term = [None, *(t.decode() for t in counts)]
            columns = [[lang] * size, [source] * size, term, [0, *counts.values()], [0, *map(docs[lang, source].__getitem__, counts)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    for batch in batches:
        for part in pieces(batch, "text"):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                key = (lang, source)
                counts, seen = n.setdefault(key, Counter()), docs.setdefault(key, Counter())
                terms = terms_of(text)
                before = len(counts)
                counts.update(terms)
                seen.update(set(terms))
                held += len(counts) - before
                if held > HELD:
                    yield from flush()
                    held = 0
    yield from flush()


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a row with a null term for every group. Nulls are ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counts, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), exactly: long division in three digits of a thousand, so for totals below 9e15."""
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


class Trees:
    """Segment trees of several groups over the same terms, with shared nodes.

    `levels` go from the leaves to the root. A level has a child pair a node (the leaves their count), and `at` holds
    each group's nodes from left to right; nodes are numbered a level.
    """

    def __init__(self, counts: np.ndarray):
        """counts: groups x terms."""
        width = 1
        while width < max(1, counts.shape[1]):
            width *= 2
        # a leaf of padding has no term: count -1
        full = np.full((len(counts), width), -1, np.int64)
        full[:, : counts.shape[1]] = counts
        self.leaf, place = np.unique(full, return_inverse=True)
        self.at = [place.reshape(full.shape)]
        self.levels: list[np.ndarray] = []
        self.nothing = [self.leaf <= 0]  # a level's nodes without a count
        while self.at[-1].shape[1] > 1:
            below = self.at[-1]
            pair = below[:, ::2].astype(np.int64) << 32 | below[:, 1::2]
            nodes, place = np.unique(pair, return_inverse=True)
            self.levels.append(nodes)
            self.nothing.append(self.nothing[-1][nodes >> 32] & self.nothing[-1][nodes & 0xFFFFFFFF])
            self.at.append(place.reshape(pair.shape))

    def root(self, group: int) -> int:
        return int(self.at[-1][group, 0])

    def meet(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of a, count of b, how often) of the leaf pairs of two groups: level by level from the roots, each pair of nodes once."""
        left, right, times = np.array([self.root(a)]), np.array([self.root(b)]), np.array([1])
        for nodes in reversed(self.levels):
            x, y = nodes[left], nodes[right]
            pair = np.concatenate([(x >> 32) << 32 | y >> 32, (x & 0xFFFFFFFF) << 32 | y & 0xFFFFFFFF])
            pair, place = np.unique(pair, return_inverse=True)
            times = np.bincount(place, np.concatenate([times, times]), len(pair)).astype(np.int64)
            left, right = pair >> 32, pair & 0xFFFFFFFF
        x, y = self.leaf[left], self.leaf[right]
        real = x >= 0
        return x[real], y[real], times[real]

    def distance(self, a: int, b: int, totals: np.ndarray) -> int:
        """The sum over all terms of how far the shares of two groups lie apart. totals: each group's denominator."""
        x, y, times = self.meet(a, b)
        return int((times * np.abs(shares(x + SMOOTHING, totals[a]) - shares(y + SMOOTHING, totals[b]))).sum())

    def places(self, group: int) -> np.ndarray:
        """The terms that a group has, found by walking its tree past the nodes that stand for nothing."""
        at = np.zeros(1, np.int64)
        for k in range(len(self.at) - 1, -1, -1):
            at = at[~self.nothing[k][self.at[k][group, at]]]
            if k:
                at = np.concatenate([2 * at, 2 * at + 1])
        return np.sort(at)


_RESULT = "lang string, source bigint, part string, other bigint, term string, value bigint"


def _audit(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a chunk gives for two tiles of `width` sources of a language: the pairs' sums; from a tile with itself also each group's first terms against the language.

    Rows: lang, i and j (the tiles), source (its number, 0 is the language), total, term (null: the group takes part), n.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lang, i, j = group["lang"].iloc[0], int(group["i"].iloc[0]), int(group["j"].iloc[0])
        members = group[group["term"].isna()].drop_duplicates("source").sort_values("source")
        sources, totals = members["source"].to_numpy(np.int64), members["total"].to_numpy(np.int64)
        cells = group[group["term"].notna()]
        # term ids in order of the language's counts: the rare ones, which most groups lack, lie together
        own = cells[cells["source"] == 0].sort_values(["n", "term"], ascending=[False, True], kind="stable")
        term = own["term"].to_numpy()
        ids = pd.Series(np.arange(len(term)), index=term)
        counts = np.zeros((len(sources), len(term)), np.int64)
        counts[np.searchsorted(sources, cells["source"].to_numpy(np.int64)), ids[cells["term"]].to_numpy(np.int64) if len(cells) else []] = cells["n"].to_numpy(np.int64)
        tile = np.where(sources > 0, (sources - 1) // width, -1)
        first, second = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        wanted = [(a, b) for a in first for b in second if a < b]
        trees, rows = Trees(counts), []
        for a, b in wanted:
            rows.append((lang, sources[a], "pair", sources[b], None, trees.distance(a, b, totals)))
        if i == j and len(term):
            for a in first:
                at = trees.places(a)
                value = shares(counts[a, at] + SMOOTHING, totals[a]) - shares(counts[0, at] + SMOOTHING, totals[0])
                at, value = at[value > 0], value[value > 0]
                text = np.array([t.encode() for t in term[at]], object)
                for k in sorted(range(len(at)), key=lambda k: (-value[k], text[k]))[:TOP]:
                    rows.append((lang, sources[a], "term", 0, term[at[k]], int(value[k])))
        return pd.DataFrame(rows, columns=["lang", "source", "part", "other", "term", "value"])

    return run


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of the documents.

    Terms count that are in LEAST_DOCS documents of their language; a group's share of a term is smoothed and an integer
    out of SCALE. part `pair`: item is each other source of the language, value the sum of the distances of all shares,
    all ranks. part `term`: item is a term of which the group has more than its language, value by how much, TOP ranks.
    Null text, lang and source are ''; every row is a document, repeated rows count each; groups without terms take part
    with counts of 0, and a language without terms has values of 0. Very long texts are read whole. An empty table gives
    no rows; other columns are ignored.
    """
    counts = stored(group_counts(docs), "term-counts")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS)
    kept = stored(kept.drop("docs"), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("n"))
    by_lang = Window.partitionBy("lang").orderBy("source")  # a row a source; their pairs are all in the result
    names = counts.filter("term IS NULL").select("lang", "source").withColumn("number", F.row_number().over(by_lang).cast("long"))
    cells = counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")
    totals = names.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(sizes.select("lang", "terms", F.col("n").alias("lang_n")), "lang", "left")
    total = lambda n: (F.coalesce(n, F.lit(0)) + SMOOTHING * F.coalesce("terms", F.lit(0))).alias("total")
    chunks = F.greatest(F.lit(1), F.ceil(F.coalesce("terms", F.lit(0)) / CHUNK)).cast("long").alias("chunks")
    groups = stored(totals.select("lang", "source", "number", total(F.col("n")), total(F.col("lang_n")).alias("lang_total"), chunks), "groups")
    langs = groups.groupBy("lang").agg(F.max("number").alias("sources"), F.max("chunks").alias("chunks"), F.max("lang_total").alias("total"))

    # rows of a chunk: cells and the language's counts, and each group once without a term
    chunk = F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk")
    none = F.lit(None).cast("string")
    mine = cells.join(groups, ["lang", "source"]).select("lang", chunk, F.col("number").alias("source"), "total", "term", "n")
    whole = kept.join(langs, "lang").select("lang", chunk, F.lit(0).cast("long").alias("source"), "total", "term", "n")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    present = groups.select("lang", every, F.col("number").alias("source"), "total", none.alias("term"), F.lit(0).cast("long").alias("n"))
    present = present.unionAll(langs.select("lang", every, F.lit(0).cast("long").alias("source"), "total", none.alias("term"), F.lit(0).cast("long").alias("n")))
    rows = mine.unionAll(whole).unionAll(present).join(langs.select("lang", F.ceil(F.col("sources") / TILE).alias("tiles")), "lang")
    # a row goes to the pairs of tiles that its own is in; the language's rows, which name the terms, to all
    tile = F.floor((F.col("source") - 1) / TILE)
    others = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    to = F.transform(others, lambda t: F.struct(F.least(t, tile).alias("i"), F.greatest(t, tile).alias("j")))
    everywhere = F.flatten(F.transform(others, lambda a: F.transform(F.sequence(a, F.col("tiles") - 1), lambda b: F.struct(a.alias("i"), b.alias("j")))))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("source") == 0, everywhere).otherwise(to))).select("lang", "chunk", "to.i", "to.j", "source", "total", "term", "n")
    found = stored(dealt.groupBy("lang", "chunk", "i", "j").applyInPandas(_audit(TILE), _RESULT), "chunk-sums")

    name = lambda number, as_: groups.select("lang", F.col("number").alias(number), F.col("source").alias(as_))
    pairs = found.filter("part = 'pair'").groupBy("lang", F.col("source").alias("a"), F.col("other").alias("b")).agg(F.sum("value").alias("value"))
    pairs = pairs.unionAll(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = pairs.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = found.filter("part = 'term'").withColumnRenamed("source", "a").join(name("a", "source"), ["lang", "a"]).select("lang", "source", "part", F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionAll(ranked(terms).filter(F.col("rank") <= TOP))
