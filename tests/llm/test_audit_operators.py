"""Toxicity, source divergence and spelling variants against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from headway.llm import divergence, spelling, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """rows of (doc_id, text, lang, source); other columns have names that the operators use inside."""
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    for c in ("n", "key", "term", "number", "total", "word", "group", "label", "size", "mean", "row", "read", "gram", "score"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# Toxicity


def texts(seed=0, n=400, length=(3, 60)):
    """Half of every tenth text's labels are 1: those have one or two words from a rude stem, each with a random ending."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ba", "lo", "ti", "re", "mun", "dé")) for _ in range(rng.randint(1, 4)))
    out = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(*length))]
        toxic = k % 5 == 0
        for _ in range(rng.randint(1, 2) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(("grukk", "zwisch", "Hexx")) + word())
        out.append((k, " ".join(words), int(toxic)))
    return out


def plain_ratio(word, counts, corpus):
    """log P_toxic - log P_ordinary of a word by the definition: both classes' own 5-grams, then continuation counts of all shorter ones."""
    pad = b"\0\0\0 "
    spelled = lambda w: pad + w + b" "
    cuts = lambda w: [spelled(w)[i - 4 : i + 1] for i in range(4, len(spelled(w)))]
    kinds = {g for w in corpus for g in cuts(w)}
    order = {4: Counter(g[1:] for g in kinds)}
    for k in (3, 2, 1):
        order[k] = Counter(g[1:] for g in order[k + 1])

    def shared(g):
        if not g:
            return 1 / 256
        c = order[len(g)]
        same = [x for x in c if x[:-1] == g[:-1]]
        n = sum(c[x] for x in same)
        return shared(g[1:]) if not n else (max(c[g] - 0.75, 0) + 0.75 * len(same) * shared(g[1:])) / n

    total = 0.0
    for sign, words in zip((1, -1), counts):
        grams = Counter()
        for w, n in words.items():
            for g in cuts(w):
                grams[g] += n
        once, twice = (sum(v == k for v in grams.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        for g in cuts(word):
            same = [x for x in grams if x[:-1] == g[:-1]]
            n = sum(grams[x] for x in same)
            p = shared(g[1:]) if not n else max(grams[g] - d, 0) / n + d * len(same) / n * shared(g[1:])
            total += sign * math.log(p)
    return total


def test_ratios_are_those_of_the_definition(spark):
    rows = texts(n=60, length=(2, 8))
    docs = frame(spark, [(k, t, "l", "s") for k, t, _ in rows] + [(70, "only here", "l", "s")])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, label int")
    model = toxicity.fit_counts(docs.select("doc_id", "text"), labels)
    counts = [Counter(w for _, t, label in rows if label == y for w in toxicity.words_of(t)) for y in (1, 0)]
    corpus = {w for _, t, _ in rows for w in toxicity.words_of(t)} | {b"only", b"here"}
    some = sorted(corpus)[::7] + [b"here"]
    assert np.allclose(model.ratios(some), [plain_ratio(w, counts, corpus) for w in some], atol=1e-6)
    assert model.ratios([]).tolist() == [] and model.ratios([b"\xff\xfe" * 9]).shape == (1,)


def test_toxic_words_are_found_in_held_out_and_long_texts(spark):
    rows = texts()
    rows += [(1000 + k, t, y) for k, (_, t, y) in enumerate(texts(9, 30, (3000, 4000)))] + [(2000, None, 0), (2001, "", 0), (None, "balo reti", 0), (5, rows[5][1], 1)]
    docs = frame(spark, [(k, t, None, "s") for k, t, _ in rows]).repartition(3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k is not None and k < 1000] + [(7, None), (None, 1), (99999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(r.term == "clash" and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and r.held_out]
    fold = lambda k: zlib.crc32(str(k).encode()) % 5
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in got) and len(held) > 40
    right = [r.predicted == int(r.doc_id % 5 == 0) for r in held]
    assert sum(right) >= 0.97 * len(right)
    long = {r.doc_id: r.predicted for r in got if r.doc_id is not None and 1000 <= r.doc_id < 2000}
    assert sum(long[1000 + k] == int(k % 5 == 0) for k in range(30)) >= 28
    assert {r.predicted for r in got if r.doc_id in (2000, 2001, None)} == {0}
    # labels of the held-out fold change nothing
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda rows: sorted(((r.doc_id, r.score) for r in rows), key=repr)
    assert key(toxicity.score(docs, other).collect()) == key(got) and fold(1) in range(5)


def test_toxicity_without_labels_or_rows(spark):
    docs = frame(spark, [(k, "some text", "l", "s") for k in range(20)])
    labels = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, toxic int")
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, labels).collect()} == {1.0}


# Divergence


def plain_audit(rows):
    find = re.compile(divergence.TERM)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(lang or "", source or "", Counter(find.findall(lower(t)))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for lang_, _, c in docs if lang_ == lang for t in c)
        kept = [t for t, n in seen.items() if n >= divergence.LEAST_DOCS]
        counts, whole = defaultdict(Counter), Counter()
        for lang_, source, c in docs:
            if lang_ == lang:
                mine = {t: c[t] for t in kept if t in c}
                counts[source].update(mine)
                whole.update(mine)
        share = lambda c, n: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept))
        for a, mine in counts.items():
            pair = [(sum(abs(share(mine, mine[t]) - share(theirs, theirs[t])) for t in kept), b) for b, theirs in counts.items() if b != a]
            term = [(share(mine, mine[t]) - share(whole, whole[t]), t) for t in kept if mine[t] > 0]
            for part, items, top in (("pair", pair, None), ("term", [x for x in term if x[0] > 0], 50)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, a, part, item, value, k) for k, (value, item) in enumerate(items, 1)]
    return sorted(out)


def sources(seed=0, n=500, names=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß東") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = []
    for k in range(n):
        lang = rng.choice(("aa", "aa", "aa", "b", None))
        source = f"s{rng.randrange(names)}" if k % 11 else None
        some = words[: 40 + 3 * len(source or "")] if lang == "b" else words[hash_of(source) % 50 :]
        rows.append((k, rng.choice((" ", "_", "1", "\0")).join(rng.choice(some) for _ in range(rng.randint(0, 40))).title(), lang, source))
    rows += [(k, None, "empty", f"e{k % 3}") for k in range(4)] + [(9, "", "aa", "silent"), (10, "x " * 50_000, "aa", "s1"), rows[3], rows[3]]
    return rows


def hash_of(text):
    return zlib.crc32((text or "").encode())


@pytest.mark.parametrize("chunk, tile", [(8192, 32), (16, 2)])
def test_divergence(spark, monkeypatch, chunk, tile):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = sources()
    got = divergence.audit(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got)) == plain_audit(rows)
    assert divergence.audit(frame(spark, rows).limit(0)).count() == 0


def test_tasks_hand_on_what_they_hold(monkeypatch):
    """Small bounds of what a task holds change how often a word or term comes, not the sums."""
    rows = [(k, f"{text or ''} {'abcdefgh'[k % 3 :]} longest{'xyz'[k % 3]}", lang, source) for k, text, lang, source in sources(2, 80)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], **{c: [r[k] or "" for r in rows] for k, c in ((1, "text"), (2, "lang"), (3, "source"))}})
    sums = []
    for held in (10, 10**6):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(spelling, "HELD", held)
        got = pa.Table.from_batches(divergence._counts(iter([batch]))).to_pandas()
        words = pa.Table.from_batches(spelling._counts(iter([batch]))).to_pandas()
        sums.append((got.groupby(["lang", "source", "term"], dropna=False)[["n", "docs"]].sum(), words.groupby("word").sum(), len(got) + len(words)))
    assert sums[0][0].equals(sums[1][0]) and sums[0][1].equals(sums[1][1]) and sums[0][2] > sums[1][2]


def test_equal_subtrees_are_one_node():
    counts = np.array([[0] * 60 + [3, 1, 0, 2], [0] * 60 + [3, 1, 0, 2], [5] + [0] * 63, [0] * 64])
    trees = divergence.Trees(counts)
    assert trees.root(0) == trees.root(1) != trees.root(2)
    assert all(len(nodes) <= 4 for nodes in trees.levels)
    x, y, times = trees.meet(0, 2)
    assert sorted(zip(x.tolist(), y.tolist(), times.tolist())) == [(0, 0, 60), (0, 5, 1), (1, 0, 1), (2, 0, 1), (3, 0, 1)]
    assert trees.places(0).tolist() == [60, 61, 63] and trees.places(3).tolist() == []


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randint(1, 8 * 10**15)
        n = rng.randint(0, total)
        assert divergence.shares(np.array([n]), np.array([total]))[0] == 1 + 10**9 * n // total


# Spelling


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = Counter()
    for k, t in rows:
        for run in re.findall(spelling.WORD, t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            words[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_error(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b and words[b] >= 10 * words[w] else None for w, b in best.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def misspelt(seed=0):
    rng = random.Random(seed)
    base = ["beginning", "Überraschung", "çadastro", "aaaaaaaaaa", "abababababab", "mississippi", "zzzzzzz"] + ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    rows = []
    for k in range(300):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = base[min(rng.randrange(len(base)), rng.randrange(len(base)))]
            if rng.random() < 0.2:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(("", "x", "é", "a")) + w[at + rng.randint(0, 1) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((k, rng.choice((" ", "-", "東", "1 ")).join(words)))
    # a chain of forms, each ten times as frequent, and words of many letters
    chain = [("stepping", 500), ("stepping"[:-1] + "k", 50), ("steppixk", 5)]
    rows += [(400 + i, (w + " ") * n) for i, (w, n) in enumerate(chain)]
    rows += [(500, "y" * 3000 + " " + "y" * 3001 + " "), (501, "y" * 3000 + " " + "y" * 3001), (502, None), (503, ""), (None, "nameless nameless"), rows[3], rows[3]]
    return rows


def test_near_words_of_an_index():
    rng = random.Random(3)
    for _ in range(150):
        words = list({bytes(rng.choice(b"ab\xe9") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 140))})
        a, b = spelling.near(words)
        assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if one_error(x, y)}


def test_variants(spark):
    rows = misspelt()
    docs = frame(spark, [(k, t, "l", "s") for k, t in rows]).repartition(3)
    got = spelling.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(rows)
    assert sorted(map(tuple, got.collect())) == want and any(r[2] != r[0] and r[2] != r[1] for r in want)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_hot_blocks_are_dealt_again(spark, monkeypatch):
    """Two thousand words that begin alike, and end alike: blocks of a few words at most, no pair lost, none twice."""
    monkeypatch.setattr(spelling, "BLOCK", 20)
    monkeypatch.setattr(spelling, "GROUP", 100)
    rng = random.Random(4)
    words = list({"prefixes" + "".join(rng.choice("abc") for _ in range(6)) for _ in range(400)} | {"".join(rng.choice("abc") for _ in range(6)) + "postfix" for _ in range(300)} | {"prefixes" + "abcabca"[:k] for k in range(8)})
    df = spark.createDataFrame([(w, 2 + len(w)) for w in words], "word string, n long")
    blocks = spelling._dealt(spelling._blocks(df)).groupBy("key").agg(F.count("*").alias("n"), F.max(F.expr("hi - lo")).alias("part"))
    assert blocks.filter("n > 20 AND part > 1").count() == 0
    got = [(r.word, r.near) for r in spelling.near_words(df).collect()]
    by_rest = defaultdict(set)
    for w in words:
        by_rest[w].add(w)
        for i in range(len(w)):
            by_rest[w[:i] + w[i + 1 :]].add(w)
    want = {(a, b) for same in by_rest.values() for a in same for b in same if one_error(a, b)}
    assert len(got) == len(set(got)) and set(got) == want
