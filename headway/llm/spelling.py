"""Spelling variants: words of the corpus that differ by one character, found in bit-sliced position indexes.

An index holds, for each position and letter, the set of words that have this letter there, as bits. A query reads its own
letters one by one and keeps four sets: words without an error so far, with one replaced letter, with one more letter
(their positions are shifted by one) and with one less (shifted the other way). All sets of all queries of an index are
updated together, 64 words at a time.

Two words with one error share all but a part of their letters: the error lies in the first or in the second half. So the
vocabulary is dealt into blocks of words that share one half, and a word meets the words of its own blocks only. A block of
more than BLOCK words is dealt again by the halves of the part in which the error may lie, until that part is one letter:
whatever share of the words begins alike, no task holds more than a few blocks, and no pair is lost.

Letters are those of WORD; each is one byte of Latin-1, so bytes are code points and their order is that of code points.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import checkpointed, pieces, stored

#: A word is a maximal run of these.
WORD = r"[A-Za-zÀ-ÿ]+"
#: A run of a document whose crc32 is divisible by this loses a letter.
DROPPED = 31
#: Words have at least so many code points and occurrences; a form occurs at least RATIO times as often as its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words that a block holds before it is dealt again; words of a task's group of blocks; words of an index.
BLOCK, GROUP, INDEX = 4096, 1 << 15, 512
#: Different words that a task counts before it hands them on.
HELD = 200_000
_TABLE = bytes(32 if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """The maximal runs of letters in Latin-1, A-Z lower-cased. Characters beyond Latin-1 are no letters here."""
    return (text or "").encode("latin-1", "replace").translate(_TABLE).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts, combined as far as HELD words go."""
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in held]
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for part in pieces(batch, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(runs_of(text)).items():
                    if len(run) < LEAST_LENGTH:
                        continue
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % DROPPED == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LENGTH:
                            continue
                    held[run] += n
                if len(held) > HELD:
                    yield flush()
    if held:
        yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the documents' words with LEAST_COUNT occurrences: counted within tasks first, so that a frequent word is a row a task."""
    counts = docs.select("doc_id", "text").mapInArrow(_counts, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def near(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) of places of words that differ by exactly one inserted, deleted or replaced byte, both ways. The words are different."""
    count = len(words)
    size = np.fromiter(map(len, words), np.int64, count)
    longest = int(size.max(initial=0))
    letters = np.zeros((count, longest + 1), np.uint8)  # zero behind a word's end
    for i, w in enumerate(words):
        letters[i, : len(w)] = np.frombuffer(w, np.uint8)
    width = -(-count // 64)

    def bits(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), width * 8), np.uint8)
        packed = np.packbits(rows, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view("<u8")

    def position(k: int) -> np.ndarray:
        """For each query's letter at each place asked for: which words have it at place k, as a table by letter."""
        table = np.zeros((256, width), np.uint64)
        there, which = np.unique(letters[:, k], return_inverse=True)
        table[there] = bits(which == np.arange(len(there))[:, None])
        table[0] = 0  # behind the end there is no letter
        return table

    present = bits(letters[:, : longest + 1].T != 0)  # which words have a letter at a place
    zero = np.broadcast_to(bits(np.ones((1, count), bool)), (count, width)).copy()
    changed, more, less = (np.zeros_like(zero) for _ in range(3))
    before, here = None, position(0) if longest else None
    for k in range(longest):
        after = position(k + 1)
        reading = np.flatnonzero(size > k)  # queries that have a letter here
        letter = letters[reading, k]
        z, same = zero[reading], here[letter]
        changed[reading] = (changed[reading] & same) | (z & ~same & present[k])
        more[reading] = (more[reading] | (z & present[k])) & after[letter]
        less[reading] = z | (less[reading] & before[letter] if k else 0)
        zero[reading] = z & same
        before, here = here, after
    for n in np.unique(size):
        # a word may end with the letter that the query lacks
        at = np.flatnonzero(size == n)
        more[at] |= zero[at] & present[n]
        longer, equal, shorter = bits(np.stack([size == n + 1, size == n, size == n - 1]))
        changed[at] = (changed[at] & equal) | (more[at] & longer) | (less[at] & shorter)
    found = np.unpackbits(changed.view(np.uint8), axis=1, bitorder="little")[:, :count]
    return np.nonzero(found)


def _blocks(words: DataFrame) -> DataFrame:
    """(word, n, base, lo, hi, key): a word in the four blocks of its halves. A block holds words of base letters and of one more; the error lies between lo and hi."""
    rows = None
    for base in (F.length("word"), F.length("word") - 1):
        half = F.floor(base / 2).cast("int")
        for lo, hi in ((half, base), (F.lit(0), half)):
            row = words.filter(base >= LEAST_LENGTH).select("word", "n", base.alias("base"), lo.alias("lo"), hi.alias("hi"))
            rows = row if rows is None else rows.unionAll(row)
    return rows.withColumn("key", _key())


def _key() -> Column:
    """The letters that the words of a block share, with their place."""
    return F.concat_ws("|", "base", "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("substring(word, length(word) - base + hi + 1)"))


def _dealt(rows: DataFrame) -> DataFrame:
    """The blocks, those of more than BLOCK words dealt by the halves of the part that may differ, down to one letter."""
    done = None
    while True:
        big = checkpointed(rows.filter("hi - lo > 1").groupBy("key").count().filter(F.col("count") > BLOCK).select("key"))
        if big.isEmpty():
            return rows if done is None else done.unionAll(rows)
        fine = rows.join(big, "key", "left_anti").select(*rows.columns)
        done = fine if done is None else done.unionAll(fine)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
        parts = rows.join(big, "key", "left_semi").withColumn("half", F.explode(halves)).select("word", "n", "base", "half.lo", "half.hi")
        rows = checkpointed(parts.withColumn("key", _key()))


def _pairs(group: pd.DataFrame) -> pd.DataFrame:
    """The near pairs of a group of blocks. Small blocks share an index; a block is never cut."""
    group = group.sort_values(["base", "key"], kind="stable")
    size = group.groupby(["base", "key"], sort=False).size().to_numpy()
    ends, cuts, held = np.cumsum(size), [0], 0
    for n, end in zip(size, ends):
        if held and held + n > INDEX:
            cuts.append(end - n)
            held = 0
        held += n
    cuts.append(len(group))
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        part = group.iloc[lo:hi].drop_duplicates("word")
        a, b = near([w.encode("latin-1") for w in part["word"]])
        word, n = part["word"].to_numpy(), part["n"].to_numpy()
        out.append(pd.DataFrame({"word": word[a], "near": word[b], "near_n": n[b]}))
    return pd.concat(out, ignore_index=True).drop_duplicates(["word", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of near words of words(word, n), both ways, each once."""
    rows = _dealt(_blocks(words))
    groups = max(1, 4 * words.count() // GROUP)
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    pairs = rows.select("group", "base", "key", "word", "n").groupBy("group").applyInPandas(_pairs, "word string, near string, near_n bigint")
    return pairs.repartition("word").dropDuplicates(["word", "near"])  # clustered by word: grouping by it needs no other shuffle


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the last of a word's forms. Each round follows twice as far; a form occurs RATIO times as often as its word, so chains are short and end."""
    known = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = checkpointed(known.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        known = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return known


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least LEAST_LENGTH letters and LEAST_COUNT occurrences.

    Words are the letter runs of whole texts, of which every run with a crc32 divisible by DROPPED (over id and run) lacks
    a letter. form: the near word that occurs most, of equals the first by code point, if it occurs RATIO times as often
    as the word, else null; root: the last of the forms, or the word itself. Null and empty texts have no words; a null
    doc_id counts as an empty text, repeated rows count each. Runs of any length are words. An empty table gives no rows;
    other columns are ignored.
    """
    words = stored(vocabulary(docs), "vocabulary")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("m"))
    rows = words.join(best.select("word", "n_near", F.col("m.near").alias("form"), (-F.col("m.less")).alias("form_n")), "word", "left")
    far = F.col("form_n") >= RATIO * F.col("n")
    rows = stored(rows.select("word", F.when(far, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("form_n")).alias("form_n")), "forms")
    rows = rows.join(roots(rows.filter("form IS NOT NULL")), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
