"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

A word is read byte by byte, each byte behind the four before it (spaces and zeros before a word's first). Each class has
its own counts of these 5-grams; what they don't know backs off to lower orders that both classes share: Kneser-Ney
continuation counts, in how many different contexts a shorter gram occurs, over the words of all documents. So a rare
expression is judged by its parts. The two log-likelihoods are compared length-normalised, for a whole document and for
each of its words, as a document may be toxic by one word of thousands.

The class counts come from a bounded sample of labelled rows: about SAMPLE_BYTES of text a class, at most DOC_BYTES of a
document. The continuation counts cover every document and are distributed tables; of these the model holds the grams of
the sample only, because where neither class has seen a gram the shared part of their ratio cancels out. The weights of
the final logistic are fitted on about CALIBRATION_DOCS documents a class that the counts don't know.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import pieces, stored
from headway.llm.words import lowered

#: Bytes of a gram; the class counts have this order, the shared counts all lower ones.
ORDER = 5
#: The bound of the classes' sample: about so many bytes of text a class, at most so many of one document.
SAMPLE_BYTES, DOC_BYTES = 8 << 20, 64 << 10
#: The bound of the calibration's sample: about so many documents a class.
CALIBRATION_DOCS = 3000
#: What the shared counts give up for their backoff.
SHARED_DISCOUNT = 0.75
#: Folds by crc32 of the id mod 5: HELD_OUT's labels are never read, CALIBRATION's fit the logistic, the others' the counts.
HELD_OUT, CALIBRATION = 0, 4
#: Words that a task remembers with their ratios.
MEMORY = 200_000
FEATURES = ("mean", "peak", "peaks")
_PAD = bytes(ORDER - 2) + b" "


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def words_of(text: str | None) -> list[bytes]:
    """The words in UTF-8, A-Z lower-cased."""
    return lowered((text or "").encode()).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' grams as integers, one for each byte and one for the space behind, and where each word's begin."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    data = np.frombuffer(b"".join([x for w in words for x in (_PAD, w, b" ")]), np.uint8).astype(np.int64)
    span = size + ORDER - 1
    ends = np.cumsum(span)
    inside = np.ones(len(data), bool)
    for k in range(1, ORDER):
        inside[ends - k] = False
    out = np.zeros(max(0, len(data) - ORDER + 1), np.int64)
    for k in range(ORDER):
        out = (out << 8) | data[k : len(data) - ORDER + 1 + k]
    return out[inside[: len(out)]], np.cumsum(size) - size


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of a task's words, mostly once each."""
    known: set[bytes] = set()
    for batch in batches:
        for part in pieces(batch, "text"):
            new = {w for text in part.column("text").to_pylist() for w in words_of(text)} - known
            if len(known) > MEMORY:
                known.clear()
            known |= new
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(grams(list(new))[0]))], ["gram"])


def shared_probabilities(docs: DataFrame) -> DataFrame:
    """(gram, p): the continuation probability of every gram of ORDER - 1 bytes in the documents' words, by interpolated Kneser-Ney down to single bytes.

    How often a shorter gram counts is in how many longer ones it is the end. All orders are tables keyed by gram; a
    context has 256 followers at most, so no key is hot.
    """
    longest = docs.select("text").mapInArrow(_distinct_grams, "gram bigint").distinct()
    end = lambda k: F.col("gram").bitwiseAND((1 << 8 * k) - 1)
    counts = {ORDER - 1: stored(longest.groupBy(end(ORDER - 1).alias("gram")).agg(F.count("*").alias("c")), "continuations")}
    for k in range(ORDER - 2, 0, -1):
        counts[k] = counts[k + 1].groupBy(end(k).alias("gram")).agg(F.count("*").alias("c"))
    lower = None
    for k in range(1, ORDER):
        context = counts[k].groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("c").alias("n"), F.count("*").alias("t"))
        rows = counts[k].withColumn("context", F.shiftright("gram", 8)).join(context, "context")
        below = F.lit(1 / 256)
        if lower is not None:
            rows, below = rows.withColumn("end", end(k - 1)).join(lower.select(F.col("gram").alias("end"), F.col("p").alias("below")), "end"), F.col("below")
        lower = rows.select("gram", ((F.greatest(F.col("c") - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * F.col("t") * below) / F.col("n")).alias("p"))
    return lower


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, ordinary): how often the sample's texts have a gram, combined for a piece."""
    for batch in batches:
        for part in pieces(batch, "text"):
            counts = (Counter(), Counter())
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                counts[label].update(words_of(text))
            words = list(counts[0] | counts[1])
            if words:
                gram, first = grams(words)
                times = np.diff(np.append(first, len(gram)))
                rows = pd.DataFrame({"gram": gram, **{name: np.repeat([c[w] for w in words], times) for name, c in zip(("ordinary", "toxic"), counts)}})
                yield pa.RecordBatch.from_pandas(rows.groupby("gram", as_index=False)[["toxic", "ordinary"]].sum(), preserve_index=False)


class Model:
    """log P_toxic - log P_ordinary of a byte behind its context: `seen` for the grams that a class has seen, `unseen` for other followers of a known context, else 0."""

    def __init__(self, gram: np.ndarray, counts: tuple[np.ndarray, np.ndarray], shared: np.ndarray):
        order = np.argsort(gram)
        self.gram, shared = gram[order], shared[order]
        self.context, start, place = np.unique(self.gram >> 8, return_index=True, return_inverse=True)
        self.seen, self.unseen = np.zeros(len(gram)), np.zeros(len(self.context))
        for sign, n in zip((1, -1), counts):
            n = n[order].astype(float)
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            total, kinds = np.add.reduceat(n, start), np.add.reduceat((n > 0).astype(float), start)
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            p = np.maximum(n - discount, 0) / np.maximum(total, 1)[place] + back[place] * shared
            self.seen += sign * np.log(p)
            self.unseen += sign * np.log(back)

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """The words' log-likelihood ratios."""
        gram, first = grams(words)
        if not len(gram) or not len(self.gram):
            return np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        hit = self.gram[at] == gram
        ratio = np.where(hit, self.seen[at], 0.0)
        rest = np.flatnonzero(~hit)
        at = np.minimum(np.searchsorted(self.context, gram[rest] >> 8), len(self.context) - 1)
        ratio[rest] = np.where(self.context[at] == gram[rest] >> 8, self.unseen[at], 0.0)
        return np.add.reduceat(ratio, first)


def fit_counts(docs: DataFrame, labelled: DataFrame) -> Model | None:
    """The model from the sample's counts and all documents' continuation counts; None if a class has no labelled text. labelled: (doc_id, label)."""
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).filter("size > 0").join(labelled, "doc_id")
    capped = F.least("size", F.lit(DOC_BYTES))
    total = {r.label: r.n for r in sizes.groupBy("label").agg(F.sum(capped).alias("n")).collect()}  # a row a class
    if len(total) < 2:
        return None
    rate = F.when(F.col("label") == 1, min(1.0, SAMPLE_BYTES / total[1])).otherwise(min(1.0, SAMPLE_BYTES / total[0]))
    chance = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    chosen = stored(labelled.filter(chance < rate * (1 << 30)), "sample")  # a table of known size: Spark broadcasts it while it is small
    # a long text's part begins at a hashed place
    room = F.greatest(F.lit(1), F.length("text") - DOC_BYTES + 1)
    part = F.col("text").substr((F.pmod(F.xxhash64(F.lit("part"), "doc_id"), room) + 1).cast("int"), F.lit(DOC_BYTES))
    counts = docs.select("doc_id", "text").join(chosen, "doc_id").select(part.alias("text"), "label").mapInArrow(_class_counts, "gram bigint, toxic bigint, ordinary bigint")
    counts = counts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).withColumn("end", F.col("gram").bitwiseAND((1 << 8 * (ORDER - 1)) - 1))
    shared = shared_probabilities(docs).withColumnRenamed("gram", "end")
    rows = counts.join(shared, "end").select("gram", "toxic", "ordinary", "p").toArrow()  # the sample's grams: bounded by SAMPLE_BYTES
    column = lambda name: rows.column(name).to_numpy()
    return Model(column("gram"), (column("toxic"), column("ordinary")), column("p"))


def features(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows plus the FEATURES, in place of columns of these names: the length-normalised ratio of the whole text, of its highest word, and the mean of its three highest.

    Whole texts are read. A text without words has 0 in all.
    """
    docs = docs.select(*[c for c in docs.columns if c not in FEATURES])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{c} double" for c in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        ratio, normal, size = (np.zeros(0) for _ in range(3))
        for batch in batches:
            for part in pieces(batch, text):
                texts = [words_of(x) for x in part.column(text).to_pylist()]
                if len(known) > MEMORY:
                    known, ratio, normal, size = {}, np.zeros(0), np.zeros(0), np.zeros(0)
                new = list({w for words in texts for w in words} - known.keys())
                known.update(zip(new, range(len(known), len(known) + len(new))))
                now, length = model.ratios(new), np.fromiter(map(len, new), float, len(new)) + 1
                ratio, normal, size = np.append(ratio, now), np.append(normal, now / length), np.append(size, length)
                out = np.zeros((len(texts), len(FEATURES)))
                for i, words in enumerate(texts):
                    if words:
                        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                        high = normal[at]
                        top = np.sort(np.partition(high, -3)[-3:] if len(high) > 3 else high)
                        out[i] = ratio[at].sum() / size[at].sum(), top[-1], top.sum() / 3
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in out.T.copy())], [*part.schema.names, *FEATURES])

    return docs.mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Weights of a logistic with an intercept, by Newton's steps; penalty keeps them finite where the classes don't touch."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), slope)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrate(docs: DataFrame, labelled: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean and deviation of the features, and the logistic's weights, from a sample of `labelled` documents; None if a class is missing."""
    total = {r.label: r["count"] for r in labelled.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("label").count().collect()}  # a row a class
    if len(total) < 2:
        return None
    rate = F.when(F.col("label") == 1, min(1.0, CALIBRATION_DOCS / total[1])).otherwise(min(1.0, CALIBRATION_DOCS / total[0]))
    chosen = stored(labelled.filter(F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(1 << 30)) < rate * (1 << 30)), "calibration")
    rows = features(docs.select("doc_id", "text").join(chosen, "doc_id"), model).select("label", *FEATURES).toPandas()  # two classes of CALIBRATION_DOCS
    y = rows.label.to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    x = rows[list(FEATURES)].to_numpy(float)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    share = np.array([total[0], total[1]]) / sum(total.values())
    weight = np.where(y == 1, share[1] / max(1, y.sum()), share[0] / max(1, (1 - y).sum()))
    return mean, spread, fit_logistic((x - mean) / spread, y, weight)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows plus held_out, score and predicted; learns from the labels outside of the held-out fold. labels: (doc_id, toxic).

    Null and empty texts are scored as texts that say nothing for either class. Without labelled text of both classes
    everything gets the share of toxic labels (0 without labels). Labels that contradict each other count as toxic, null
    ones and those without doc_id not at all. Rows that repeat, and equal texts, are scored alike; a null doc_id belongs
    to the fold of an empty text. Very long texts are read whole. An empty table gives no rows. Columns named as those
    that are added are replaced.
    """
    added = ("held_out", "score", "predicted")
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label")).filter(fold(F.col("doc_id")) != HELD_OUT)
    texts = docs.select("doc_id", "text")
    model = fit_counts(texts, known.filter(fold(F.col("doc_id")) != CALIBRATION))
    scale = model and calibrate(texts, known.filter(fold(F.col("doc_id")) == CALIBRATION), model)
    docs = docs.select(*[c for c in docs.columns if c not in added])
    if scale is None:
        share = known.agg(F.avg("label")).first()[0] or 0.0
        rows, value = docs, F.lit(float(share))
    else:
        mean, spread, w = scale
        # the features have names of their own, so that columns of the rows stay
        inner = features(docs.select(F.struct("*").alias("row"), F.col("text").alias("read")), model, "read")
        z = F.lit(float(w[-1]))
        for name, m, s, k in zip(FEATURES, mean, spread, w):
            z = z + (F.col(name) - float(m)) / float(s) * float(k)
        rows = inner.select("row.*", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
        value = F.round("score", 6)
    rows = rows.withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT).withColumn("score", value)
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
