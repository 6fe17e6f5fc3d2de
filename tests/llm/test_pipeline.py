"""The stages of the pipeline on odd rows, and the whole of it against a plain version of what its stages decide."""

import random
import re

import corpus_pipeline as cp
import pytest
import tiktoken
from pyspark.sql import functions as F

from headway.llm import bpe
from headway.llm.queries import QUERIES
from test_dedup_operators import brute_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"aa": ["kato", "milu", "sora", "neko", "tamo"], "bb": ["schrift", "wald", "zwerg", "pfund", "licht"]}


def frame(spark, rows):
    """(doc_id, text, lang, source) as documents, with more columns whose names clash with those of the operators."""
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)
    for c in ("id", "hash", "size", "taken", "key", "i", "h", "same", "kept", "ids", "score", "verdicts", "lang_pred"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    said = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice(("", "n", "ri", "lo", "sta")) for _ in range(n))
    rows = [(k, said("ab"[k % 2] * 2, 60), "ab"[k % 2] * 2, ("web", "book", None)[k % 3]) for k in range(90)]
    passage = said("aa", 30)
    rows += [(100 + k, f"{said('aa', 20)} {passage} {said('aa', 20)}", "aa", "web") for k in range(4)]
    changed = lambda text, n: " ".join("neko" if i in range(5, 5 + 9 * n, 9) else w for i, w in enumerate(text.split()))
    rows += [(200, rows[3][1], "bb", "web"), (201, changed(rows[4][1], 1), None, "book"), (202, rows[5][1].upper(), "bb", None)]
    return rows


ODD = [(None, "kato milu sora neko", "aa", "web"), (7, None, "aa", "web"), (8, "", None, None), (9, " \n\t ", "bb", ""), (10, "12 !! 34", None, "web"), (11, "kato " * 4000, "aa", "book"), (12, "kato milu sora neko tamo", "aa", "web"), (12, "kato milu sora neko tamo", "aa", "web"), (12, "wald licht zwerg", "bb", "web")]


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_empty_tables(spark, name, stage):
    assert stage(spark, frame(spark, ODD).limit(0), "").count() == 0


def test_language_stage(spark, corpus):
    got = rows_of(cp.language_id(spark, frame(spark, [*corpus, *ODD]), ""))
    gone = {(7, None, "aa", "web"), (8, "", None, None), (9, " \n\t ", "bb", ""), (10, "12 !! 34", None, "web")}
    filled = {201: "aa"}
    want = [(i, t, lang or filled[i], s) for i, t, lang, s in [*corpus, *ODD] if (i, t, lang, s) not in gone]
    assert got == sorted(want, key=repr)


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    """The rows that stay: by breadth-first search over links of 0.8 or more."""
    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(r[1]) for r in rows]
    left, kept = set(range(len(rows))), set()
    while left:
        group, todo = set(), [min(left)]
        while todo:
            a = todo.pop()
            if a in group:
                continue
            group.add(a)
            todo += [b for b in left if b not in group and (rows[a][0] == rows[b][0] or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))]
        left -= group
        kept.add(min(rows[a][0] for a in group))
    return sorted({r for r in rows if r[0] in kept}, key=repr)


def test_near_stage(spark, corpus):
    rows = [*corpus, *ODD]
    assert rows_of(cp.near_dedup(spark, frame(spark, rows), "")) == brute_near(rows)
    ids = {r[0] for r in brute_near(rows)}
    assert not ids & {200, 201, 202} and {3, 4, 5, 7, 8, 12} <= ids


def brute_cut(rows):
    first: dict = {}
    for i, t, _, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for i, t, lang, s in rows:
        w, gone = (t or "").split(), set()
        for k in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        if not gone or len(gone) < len(w):
            out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t, lang, s))
    return sorted(out, key=repr)


def test_substring_stage(spark, corpus):
    rows = [*corpus, *ODD]
    got = rows_of(cp.substring_dedup(spark, frame(spark, rows), ""))
    assert got == brute_cut(rows) and (200, rows[3][1], "bb", "web") not in got
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in cp.substring_dedup(spark, frame(spark, ODD), "").collect())


def test_mixing_stage(spark, corpus):
    rows = [*corpus, *ODD]
    got = rows_of(cp.mix_sources(spark, frame(spark, rows), ""))
    size: dict = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    for _ in order:
        rest, free = 1.5 * sum(size.values()) - 2 * sum(size[s] for s in full), sum(weight[s] for s in order if s not in full)
        full |= {s for s in order if s not in full and weight[s] * rest / free > 2 * size[s]}
    target = {s: 2 * size[s] if s in full else weight[s] * rest / free for s in order}
    taken: dict = {}
    for i, t, lang, s in got:
        taken[s] = taken.get(s, 0) + len(t.split())
        assert any(i == j and s == s2 and lang == l2 and (t == x or x.split()[: len(t.split())] == t.split()) for j, x, l2, s2 in rows if x)
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in order)
    copies = [sum(g == r for g in got) for r in set(rows) if r[1] and r[1].split()]
    assert max(copies) <= 4 and got == rows_of(cp.mix_sources(spark, frame(spark, rows[::-1]).repartition(3), ""))


def test_token_stage(spark):
    path, pattern = bpe.default_vocabulary()
    ranks = bpe.Vocabulary(path, pattern).ranks
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})
    got = sorted(((r.doc_id, r.lang, r.source, r.n_tokens, list(r.ids)) for r in cp.byte_bpe(spark, frame(spark, ODD), "").collect()), key=repr)
    assert got == sorted(((i, lang, s, len(x), x) for i, t, lang, s in ODD for x in [encoding.encode_ordinary(t or "")]), key=repr)


def test_whole_run(spark, corpus, tmp_path):
    rows = [r for r in corpus if r[0] < 150 or r[0] >= 200]
    spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    stay = brute_cut(brute_near([(i, t, lang or "aa", s) for i, t, lang, s in rows]))
    assert {r.doc_id for r in got} <= {r[0] for r in stay} and {r.source for r in got} == {r[3] for r in stay}
    words = {r[0]: len(r[1].split()) for r in stay}
    decode = bpe.Vocabulary(*bpe.default_vocabulary()).ranks
    back = {v: k for k, v in decode.items()}
    total = sum(len(b"".join(back[x] for x in r.ids).decode().split()) for r in got)
    assert abs(total - 1.5 * sum(words.values())) <= 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_have_their_columns(spark, name):
    """Each query on the smallest tables: its rows by id, its columns, no nulls where there must be none."""
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    key = {"op2": ("query_id", "rank"), "op5": ("page_id",), "op6": ("page_id",)}.get(name.split("_")[0], ("doc_id",))
    table = {"op2": "embeddings", "op5": "pages", "op6": "pages"}.get(name.split("_")[0], "documents")
    assert len({tuple(r[k] for k in key) for r in rows}) == len(rows) > 0
    if name[:4] != "op2_":
        assert len(rows) == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    assert all(r[c] is not None for r in rows for c in df.columns if c not in ("refers_to", "url"))


def test_repeats_agree_with_brute_force_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute_words([(r.doc_id, r.text) for r in docs])
    got = {r.doc_id: (r.n_words, r.n_removed) for r in QUERIES["op8_repeated_passages"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: x[:2] for i, x in want.items()}
