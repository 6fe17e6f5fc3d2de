"""Near-dedup, substring dedup and nearest neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from headway.llm import ann, minhash, substring_index, suffix_array, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=90):
    """Texts with copies, near copies of many degrees, shared passages, repeats, odd white space and other scripts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé東") for _ in range(rng.randint(2, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(12, 40))) for _ in range(4)]
    texts = []
    for k in range(n):
        w = [word() for _ in range(rng.choice((0, 1, 3, 5, 12, 13, 14, 60, 200)))]
        if k % 3 == 0:
            w.insert(rng.randint(0, len(w)), rng.choice(passages))
        if k % 7 == 0:
            w += [rng.choice(passages)] * 2
        texts.append(rng.choice((" ", "  ", "\n", "\t")).join(w))
    base = [x for x in texts if len(x) > 300]
    for k in range(n // 2):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2, 4, 8, 12))):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w).upper() if k % 9 == 0 else " ".join(w))
    texts += [texts[0], "", None, "  \n", "same words " * 300, "same words " * 200, "Ä" * 200, "x" * 120 + "Ä" * 60]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, "l", "s", 0) for i, t in rows], DOCS)
    for c in ("id", "key", "hash", "d", "spans", "component", "n", "bucket"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_near_duplicates(spark, rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {r.doc_id: r for r in minhash.link(frame(spark, rows)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), top(i), top(i) == i) for i in sets}
    assert len({top(i) for i in sets}) < len(sets) - 20


def test_near_duplicates_odd_rows(spark):
    t = " ".join(map(str, range(50)))
    got = minhash.link(frame(spark, [(1, t), (1, t), (None, t), (None, "alone here"), (7, t + " x")])).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 46, 1, True), (1, 46, 1, True), (None, 46, 1, False), (None, 1, None, False), (7, 47, 1, False)], key=repr)
    assert minhash.link(frame(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_chunks_share_a_key(percent):
    rng = np.random.default_rng(0)
    chunks, far = minhash.chunks_for(percent), minhash.limit_for(percent, minhash.LOSS)
    assert far < 2 * chunks
    a = rng.integers(0, 1 << 16, (1, minhash.POSITIONS)).astype(np.uint16)
    for _ in range(200):
        b = a.copy()
        at = rng.choice(minhash.POSITIONS, far, replace=False)
        b[0, at] ^= 256
        assert np.isin(minhash.chunk_keys(a, chunks), minhash.chunk_keys(b, chunks)).any()


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_links_share_a_prefix(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n, both = int(rng.integers(1, 60)), 0
        pool = rng.choice(1 << 40, 2 * n, replace=False).astype(np.uint64)
        a, b = (np.sort(pool[rng.random(2 * n) < p]) for p in (0.9, rng.choice((0.5, 0.9, 1.0))))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            assert np.isin(minhash.prefix(a, percent), minhash.prefix(b, percent)).any()


def test_exact_finds_links_that_share_no_chunk(spark, monkeypatch):
    t = [f"w{k}" for k in range(304)]
    docs = [(k, " ".join(["x" if i in (20 + k, 100 + 3 * k, 200 + 7 * k) else w for i, w in enumerate(t)])) for k in range(12)]
    docs += [(50 + k, f"other words {k} stand here alone") for k in range(3)]
    whole = [0] * 12 + [50, 51, 52]
    ids = lambda **more: [r.component_id for r in minhash.link(frame(spark, docs), percent=80, **more).orderBy("doc_id").collect()]
    assert ids() == whole
    # chunks of 32 positions allow for one error each, and most of these texts differ in more
    monkeypatch.setattr(minhash, "chunks_for", lambda percent: 2)
    assert len(set(ids())) > 6
    assert ids(exact=True) == whole


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (200, 200)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 90: 90, 95: 90, 100: 90}


def brute_words(rows, size=13):
    seen: dict = {}
    split = {i: WORD.findall(t or "") for i, t in rows}
    for i, w in sorted(split.items()):
        for k in range(len(w) - size + 1):
            seen.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("batches", [1, 6])
def test_repeated_words(spark, rows, batches):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_index.remove_repeats(frame(spark, rows), batches=batches).collect()}
    assert got == brute_words(rows) and sum(x[1] for x in got.values()) > 500


def morse(n):
    """The first n letters of the Thue-Morse word, and their complement."""
    x = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [256, 512, 1024, 4096])
def test_words_that_defeat_polynomials(spark, n):
    a, b = morse(n)
    data, starts, ends, _ = words.word_spans([a.encode(), b.encode(), a.encode()])
    for second in (False, True):
        h = words.word_hashes(data, starts, ends, second)
        assert h[0] == h[2] != h[1]
    rest = [f"w{k}" for k in range(12)]
    docs = frame(spark, [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, " ".join([a, *rest]))])
    assert {r.doc_id: r.n_removed for r in substring_index.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 13}
    # 8 of 10 shingles in common, if the words that differ count as different
    assert {r.doc_id: r.component_id for r in minhash.link(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_near_duplicates_in_small_tiles(spark, rows, monkeypatch):
    want = sorted(minhash.link(frame(spark, rows)).collect())
    for name, n in (("TILE", 3), ("HOME", 2), ("ASKERS", 2)):
        monkeypatch.setattr(minhash, name, n)
    assert sorted(minhash.link(frame(spark, rows), limit=minhash.POSITIONS).collect()) == want


def test_limits():
    assert minhash.limit_for(85) < minhash.limit_for(80) < minhash.POSITIONS
    assert minhash.limit_for(80, 0) == minhash.POSITIONS


def test_lower_threshold(spark):
    t = [f"w{k}" for k in range(104)]  # 100 shingles; a word changed inside changes five of each
    docs = frame(spark, [(1, " ".join(t)), (2, " ".join(["x" if k in (20, 60) else w for k, w in enumerate(t)]))])  # 90 of 110
    assert [r.component_id for r in minhash.link(docs).orderBy("doc_id").collect()] == [1, 2]
    assert [r.component_id for r in minhash.link(docs, percent=80).orderBy("doc_id").collect()] == [1, 1]


def test_index_over_batches(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    index = substring_index.FingerprintIndex(spark, path, 16)
    part = lambda low, high: frame(spark, [r for r in rows if low <= r[0] < high]).select("doc_id", "text")
    got = []
    for k in range(0, 160, 32):
        got += substring_index.add_batch(index, part(k, k + 32), part(0, k)).collect()
        index = substring_index.FingerprintIndex.open(spark, path)
    assert sorted(n for n, _ in index.runs) == [0, 1]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_words(rows)
    with pytest.raises(ValueError, match="no index"):
        substring_index.FingerprintIndex.open(spark, str(tmp_path / "none"))


def test_repeated_words_in_small_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(substring_index, "PIECE", 2000)
    monkeypatch.setattr(substring_index, "BUCKET", 10)
    long = " ".join(f"w{k % 700}" for k in range(3000))
    rows = [*rows, (900, long), (901, long[:-900])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_index.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_words(rows)


def test_repeats_odd_rows(spark):
    t = " ".join(f"w{k}" for k in range(20))
    for module, n in ((substring_index, 20), (suffix_array, len(t))):
        got = sorted(((r[0], r.n_removed) for r in module.remove_repeats(frame(spark, [(3, t), (3, t), (None, t), (9, t), (10, None)])).collect()), key=repr)
        assert got == sorted([(3, 0), (3, 0), (None, 0), (9, n), (10, 0)], key=repr)
        assert module.remove_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0
        assert module.remove_repeats(frame(spark, [(1, "a"), (2, None)])).count() == 2


def brute_bytes(rows, size=50):
    seen: dict = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i, x in sorted(data.items()):
        for k in range(len(x) - size + 1):
            seen.setdefault(x[k : k + size], i)
    out = {}
    for i, x in data.items():
        gone = np.zeros(len(x) + size + 1, int)
        for k in range(len(x) - size + 1):
            if seen[x[k : k + size]] < i:
                gone[k] += 1
                gone[k + size] -= 1
        m = np.cumsum(gone)[: len(x)] > 0
        out[i] = (len(x), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~m])).hexdigest())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeated_bytes(spark, rows, monkeypatch, small):
    if small:  # many slices, stretches, blocks and ranges
        rows = [*rows, (901, "".join(random.Random(8).choices("ab", k=3000)) * 2), (900, "ab" * 900)]
        for name, n in (("SLICE", 700), ("STRETCH", 90), ("BLOCK", 3000), ("RANGE", 2000), ("SAMPLED", 5)):
            monkeypatch.setattr(suffix_array, name, n)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_array.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_bytes(rows) and sum(x[1] for x in got.values()) > 3000


def test_what_only_copies_share_is_sifted_out(spark):
    """Stretches of three copies are the first document's alone, so nothing is left to sort; hashes come back by parts of the documents, not by document."""
    t = "".join(random.Random(5).choices("abcdefgh ", k=4000))
    texts = spark.createDataFrame([(i, 1, t) for i in range(3)], "doc_id long, key long, text string")
    _, owners, _ = suffix_array._sifted(texts, suffix_array.GRAM, suffix_array.CUT, "texts")
    held = owners.selectExpr("owner AS doc_id", "digest AS key", "bytes AS text")
    assert {r.owner for r in owners.collect()} == {0} and suffix_array._sifted(held, suffix_array.SECOND, suffix_array.SECOND_CUT, "held")[1].count() == 0
    entry = suffix_array._rows([(0, "shared", suffix_array.packed(np.zeros(900), True), suffix_array.packed(np.arange(900)))], suffix_array._HASHES_ARROW)
    assert sum(b.num_rows for b in suffix_array._by_part(7)(iter(entry.to_batches()))) == 7


def test_suffix_order():
    rng = random.Random(3)
    raw = "".join(rng.choice("ab") for _ in range(300)).encode()
    b = suffix_array.Block({"block": 1, "digests": b"", "sizes": np.array([300]).tobytes(), "owners": np.array([1]).tobytes(), "text": raw + bytes(suffix_array._PAD)})
    at, names, ranks = b.sample(suffix_array._NAMED), np.zeros(b.length, np.uint64), np.zeros(b.length, np.uint64)
    names[at] = suffix_array.named(b.triples(at)) + 1
    at, w = b.sample(suffix_array._RANKED), suffix_array.wide(b.text)
    ranks[at] = suffix_array.named(np.stack([names[at], names[at + 24], w[at + 48] >> np.uint64(48)])) + 1
    assert [raw[k : k + 50] for k in at[np.argsort(ranks[at], kind="stable")] if k <= 250] == sorted(raw[k : k + 50] for k in at if k <= 250)
    p = b.starts()
    c = {"c0": w[p], "c1": w[p + 8], "r0": ranks[p], "r1": ranks[p + 8], "r2": ranks[p + 16]}
    order = p[suffix_array.merged(c, b.cls[p])]
    assert [raw[k : k + 50] for k in order] == sorted(raw[k : k + 50] for k in p)


def test_ranking_and_dealing_take_few_steps(monkeypatch):
    """Keys are sorted as often as their bits fill 64, not twice a column; and 100 MB of blocks make few chunks of keys."""
    rng, dense, sorts = np.random.default_rng(6), suffix_array._dense, []
    monkeypatch.setattr(suffix_array, "_dense", lambda a: sorts.append(len(a)) or dense(a))
    ranks = rng.integers(1 << 27, (1 << 27) + 50, (3, 800)).astype(np.uint64)
    wide = np.stack([rng.integers(0, 3, 800).astype(np.uint64) << np.uint64(62), ranks[0] << np.uint64(36), ranks[1] % np.uint64(2)])
    for keys, most in ((ranks, 1), (wide, 3), (np.zeros((3, 4), np.uint64), 1), (wide[:, :0], 1)):
        sorts.clear()
        columns = [tuple(x) for x in keys.T.tolist()]
        place = {x: k for k, x in enumerate(sorted(set(columns)))}
        assert suffix_array.named(keys).tolist() == [place[x] for x in columns] and len(sorts) <= most
    assert (100_000_000 // suffix_array.BLOCK) * (100_000_000 // suffix_array.RANGE) < 30_000


def test_columns_come_back():
    rng = np.random.default_rng(7)
    for n in (0, 1, 900):
        columns = [np.sort(rng.integers(0, 1 << 40, n)), rng.integers(-9, 9, n), np.full(n, 7), rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)]
        got = suffix_array._split(suffix_array._joined(columns))
        assert [x.tolist() for x in got] == [x.view(np.uint64).tolist() for x in columns]


def test_cut_by_spans():
    spans = [None, [], [(3, 5), (0, 2), (1, 2)], [(0, 4)], [(0, 1), (1, 3)], None]
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    cover = pa.array([x and [{"low": a, "high": b} for a, b in x] for x in spans], kind)
    texts = pa.array(["out", None, "abcdef", "abcd", "é東", "out"])
    got = [x.to_pylist() for x in suffix_array._cut(texts.slice(1, 4), cover.slice(1, 4))]
    assert got == [[0, 6, 4, 5], [0, 4, 4, 3], [0, 2, 1, 1], [b"", b"cf", b"", "é東".encode()[3:]]]
    assert [x.to_pylist() for x in suffix_array._cut(texts.slice(0, 1), cover.slice(0, 1))] == [[3], [0], [0], [b"out"]]


def test_dealing_by_whole_keys():
    rng = np.random.default_rng(4)
    keys, splits = rng.integers(0, 3, (3, 500)).astype(np.uint64), np.unique(rng.integers(0, 3, (9, 3)), axis=0).T.astype(np.uint64)
    bounds = [tuple(x) for x in splits.T.tolist()]
    got = {int(i): r for r, at in suffix_array.dealt(keys, splits) for i in at}
    assert got == {k: sum(b <= tuple(keys[:, k].tolist()) for b in bounds) for k in range(500)}
    assert [r for r, _ in suffix_array.dealt(keys, splits[:, :0])] == [0]


def test_least_hashes_agree():
    rng = np.random.default_rng(1)
    a, b = rng.integers(97, 100, 400).astype(np.uint8), rng.integers(97, 100, 300).astype(np.uint8)
    b[100:160] = a[50:110]
    assert (suffix_array.least_hashes(a)[50:61] == suffix_array.least_hashes(b)[100:111]).all()
    assert len(suffix_array.least_hashes(a[:49])) == 0


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[300:420] = x[7]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5, x[5].tolist()), (900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [1.0] * 15), (904, [1.0, None] * 8), (905, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("clash")).withColumn("list", F.lit(1))
    monkeypatch.setattr(ann, "LIST", 64)
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    y, hits = x.astype(np.float64), 0
    for q, near in got.items():
        scores = y @ y[q]
        best = [k for k in np.lexsort((np.arange(700), -np.round(scores, 9))) if k != q][:20]
        hits += len({k for _, k, _ in near} & set(best))
        assert [n[0] for n in near] == list(range(1, 21)) and q not in [n[1] for n in near]
        assert all(s == pytest.approx(scores[k], abs=1e-9) for _, k, s in near)
        assert near == sorted(near, key=lambda n: (-n[2], n[1]))
    assert hits >= 0.9 * 20 * len(got)
    few = ann.search(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in few] == [1, 2]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_scan_finds_the_nearest():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(400, 33)).astype(np.float32), rng.normal(size=(20, 33)).astype(np.float32)
    i, j = ann.scan(x, q, np.full(20, np.inf), 10, block=8, epsilon=3.0)
    for k in range(20):
        assert set(np.argsort(((x - q[k]) ** 2).sum(1))[:10]) <= set(j[i == k])
