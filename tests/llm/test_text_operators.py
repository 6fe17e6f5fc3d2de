"""Encoding, media, archives, pages, languages and mixing: against other implementations, round trips and brute force."""

import base64
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from headway.llm import bpe, html_template, langid, mixing, mpeg_audio, warc

PATH, PATTERN = bpe.default_vocabulary()
TEXTS = [None, "", " ", "Hello, world! It's 2024.", "naïve ñandú 東京 🚀🚀", "a" * 3000, "x\t\n  y  \r\n", "<|endoftext|>", "ﬁ\u0000​", "word " * 500, "word " * 500]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH, PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(vocabulary):
    words = list(vocabulary.ranks)
    assert vocabulary.whole.size == len(words)
    assert sorted(vocabulary.whole(bpe.hashes(words)).tolist()) == list(range(len(words)))
    assert bpe.PerfectHash(np.zeros(0, np.uint64)).size == 0


def test_heap_merge(vocabulary, reference):
    rng = random.Random(4)
    for _ in range(400):
        w = "".join(rng.choice("abtheionrs éß東") for _ in range(rng.randint(1, 40))).replace(" ", "") or "a"
        assert list(bpe.heap_merge(w.encode(), vocabulary.ranks)) == reference._encode_single_piece(w.encode())


def test_long_pre_tokens_are_not_remembered(spark, reference):
    texts = ["x" * 700, "x" * 700 + " x", "é" * 300, "x" * 700]
    rows = bpe.encode(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).coalesce(1), PATH, PATTERN).collect()
    assert [r.ids for r in sorted(rows, key=lambda r: r.doc_id)] == [reference.encode_ordinary(t) for t in texts]


def test_encode_and_decode(spark, reference):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)]).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    rows = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0


# Media


def test_media_round_trip(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)]).withColumn("media", F.lit(0))
    out = mpeg_audio.features(mpeg_audio.with_media(df), ["doc_id", "n_bytes"]).collect()
    for r in out:
        raw = (TEXTS[r.doc_id] or "").encode()
        payload = mpeg_audio.units(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert payload == raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw)) and r.tail_crc32 == zlib.crc32(payload[-32:])
        media = mpeg_audio.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.payload_bytes % 576 == 0 and r.frames == r.table_frames == r.payload_bytes // 576 and r.table_bytes == 672 * (r.frames + 1)
        assert (r.bad_crc, r.resyncs, r.skipped, r.rate) == (0, 0, 0, 48000) and r.seconds == [r.samples // math.gcd(r.samples, 48000), 48000 // math.gcd(r.samples, 48000)]
        assert len(r.offsets) == r.frames and all(b - a == 672 for a, b in zip(r.offsets, r.offsets[1:]))


def test_media_damage():
    payload = bytes(range(256)) * 9
    good = mpeg_audio.encode(payload)
    at = mpeg_audio.parse(good).offsets
    junk = good[: at[2]] + b"\xff\xfbjunk\xff" * 9 + good[at[2] :]
    s = mpeg_audio.parse(junk)
    assert mpeg_audio.decode(s) == payload and s.resyncs == 1 and s.skipped == 63
    flipped = bytearray(good)
    flipped[at[1] + 10] ^= 1
    assert mpeg_audio.parse(bytes(flipped)).bad_crc == 1
    cut = mpeg_audio.parse(good[: at[3] + 100])
    assert len(cut.offsets) == 3 and cut.skipped
    assert mpeg_audio.parse(b"").samples == 0 and mpeg_audio.header(b"\xff\xff\xff\xff") is None
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7


def test_headers_of_other_kinds():
    layer2 = mpeg_audio.header(bytes((0xFF, 0xFD, 0x84, 0x00)))
    assert (layer2.layer, layer2.kbps, layer2.rate, layer2.size, layer2.samples) == (2, 128, 48000, 384, 1152)
    low = mpeg_audio.header(bytes((0xFF, 0xF3, 0x84, 0xC0)))
    assert (low.version, low.rate, low.samples, low.side, low.protected) == (2, 24000, 576, 9, False)


# Archives


def test_archives(spark, tmp_path):
    big, html = "x" * 1000, "<p>é</p>"
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a b/\n3", html), (4, "u", html), (5, "u", None), (6, "u", ""), (7, "u", "y" * 999), (8, "u", "y" * 999), (2, None, big), (9, "u", "z" * 300_000), (None, "u", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("last", F.lit(1))
    warc.write_archives(df, str(tmp_path / "w"), 1, 3)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    for r in got:
        want = next(h or "" for i, _, h in rows if i == r.page_id).encode()
        revisit = r.page_id == 1
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(want), hashlib.sha1(want).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)
        assert revisit or bytes(r.payload) == want
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    assert len(files) > 2 and sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1") for p in files) == len(rows)
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_damaged_archive():
    one, two = (warc.record(k, "u", b"body %d" % k, hashlib.sha1(b"body %d" % k).hexdigest(), None) for k in (1, 2))
    assert [warc.read_record(*m).intact for m in warc.members(one + warc.EMPTY_MEMBER + two)] == [True, True]
    hurt = bytearray(one)
    hurt[40] ^= 255
    assert [warc.read_record(*m).intact for m in warc.members(bytes(hurt) + two)][-1] is True
    assert not [m for m in warc.members(two[:-6]) if m[1]]
    wrong = warc.record(1, "u", b"body", "0" * 40, None)
    assert [warc.read_record(*m).intact for m in warc.members(wrong)] == [False]


# Pages

PAGE = "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/x>menu</a></ul></nav><div class=ad>buy</div><article><h1>Head &amp; more</h1><p><b>One<br><p>Two  \n words<div class='comments'>bad</div><p>{}</article><footer>&copy; f</footer>"


def test_pages(spark):
    pages = [(k, f"http://h.example/{k}", PAGE.format(f"Text {k}")) for k in range(6)] + [(6, None, None), (7, "http://[bad", ""), (8, "http://o.example", "<p>only &lt;this&gt;<aside>no</aside>"), (0, "http://h.example/0", PAGE.format("Text 0"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_template.extract(df).collect())
    body = "Head & more\nOne\nTwo words\nText {}"
    want = [(k, body.format(k), len(body.format(k))) for k in range(6)] + [(0, body.format(0), len(body.format(0))), (6, "", 0), (7, "", 0), (8, "only <this>", 11)]
    assert got == sorted(want)
    assert html_template.extract(df.limit(0)).count() == 0


def test_template_of_pages_without_articles(spark):
    html = "<body><div>Welcome to our site</div><div>Story {0} is here</div><div>All rights reserved</div>"
    df = spark.createDataFrame([(k, "http://h/x", html.format(k)) for k in range(8)], "page_id long, url string, html string")
    assert {r.text for r in html_template.extract(df).collect()} == {f"Story {k} is here" for k in range(8)}
    pages = html_template.hosted(df)
    t = html_template.templates(pages, pages.groupBy("host").agg(F.count("*").alias("of"))).first()
    assert len(t.constant) == 2 and t.main == []


def test_article_of_its_own_within_a_stable_main(spark):
    html = "<body><nav>menu</nav><main>Day {0}<article id=post-{0} class=post><h1>Story {0}</h1><p>Body {0}</article></main><footer>f</footer>"
    df = spark.createDataFrame([(k, "http://h/x", html.format(k)) for k in range(8)], "page_id long, url string, html string")
    assert {r.text for r in html_template.extract(df).collect()} == {f"Day {k}\nStory {k}\nBody {k}" for k in range(8)}


def test_constants_within_articles_go_and_words_name_the_rest(spark):
    body = "<article><div class=article-header><h1>Story {0}</h1></div><p>One {0}<p>Sign up now<h2 id=search>Search {0}</h2><div class=related>Also {0}</div><p>Two {0} <i class=share>and</i> more</article>"
    pages = [(k, "http://h/x", "<body><div class=banner>Top</div>" + body.format(k) + f"<p>{k}" * (k % 3)) for k in range(8)]
    pages += [(9, "http://alone/x", "<body><div class=banner>Top</div>" + body.format(9))]
    pages += [(10 + k, "http://copies/x", f"<body><p>menu<article><h1>Same</h1><p>Copy<p>of it<div class=share>Tell</div></article><p>{k // 4}") for k in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract(df).collect()}
    assert {k: got[k] for k in range(8)} == {k: f"Story {k}\nOne {k}\nSearch {k}\nTwo {k} more" for k in range(8)}
    assert got[9] == "Story 9\nOne 9\nSign up now\nSearch 9\nTwo 9 more"
    assert {got[10 + k] for k in range(5)} == {"Same\nCopy\nof it"}


#: Layouts in which comments, adverts, sidebars and forms vary from page to page: of the page's number and its body.
VARYING = (
    "<body><nav>menu</nav><main><article><h1>Title {0}</h1>{1}</article><section class=comments><p>First reply {0}</p><p>Second reply {0}</p></section></main><footer>f</footer>",
    "<body><div class=top-nav>menu</div><div class=content><h1>Title {0}</h1>{1}</div><div class=sidebar><p>Side {0}</p></div><div class=comments>Reply {0}</div><div class=ad>Buy {0}</div>",
    "<body><article><h1>Title {0}</h1>{1}<div class=comments><article class=comment>Reply {0}</article></div><form>Your mail {0}<input></form><div class=advert>Buy {0}</div></article><div>rights</div>",
    "<body><div class=widget-page><h1>Title {0}</h1>{1}</div><p>rights</p>",
)


@pytest.mark.parametrize("salt_pages", [1000, 3])
def test_what_varies_besides_the_article_goes(spark, salt_pages):
    rows, want = [], {}
    for h, layout in enumerate(VARYING):
        for k in range(10):
            body = [f"Part {n} of story {k} at {h}" for n in range(1 + k % 4)]
            rows.append((100 * h + k, f"http://v{h}.example/{k}", layout.format(k, "".join(f"<p>{x}</p>" for x in body))))
            want[100 * h + k] = "\n".join([f"Title {k}", *body])
        # alone on its host
        rows.append((100 * h + 50, f"http://alone{h}.example/", layout.format(50, "<p>Only this</p>")))
        if h < 3:
            want[100 * h + 50] = "Title 50\nOnly this"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract(df, salt_pages).collect()}
    assert {k: got[k] for k in want} == want


def generated_pages(seed=5, hosts=4, each=9):
    """Pages whose main text is known: hosts differ in markup, each has menus, notices and adverts of its own, some constant and some not."""
    rng = random.Random(seed)
    said = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = []
    for h in range(hosts):
        menu, notice, rights = said(3), said(6), said(4)
        for k in range(each):
            paragraphs = [said(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
            body = "".join(f"<p>{x}" if h % 2 else f"<p>{x}</p>\n" for x in paragraphs)
            title = said(4)
            page = (
                f"<html><head><title>{title}</title></head><body><nav>{menu}</nav><div class=x{h}>{notice}</div><article><h1>{title}</h1>{body}<p class=y>{notice}</p></article><aside>{said(3)}</aside>{rights}",
                f"<body><main id=m><h1>{title}</h1><p>{notice}</p><article id=a{k}>{body}</article></main><footer>{said(2)}</footer>",
                f"<body><div>{menu}</div><h1>{title}</h1>{body}<div>{rights}</div>",
                f"<body><header>{said(2)}</header><div>{notice}</div><section><h1>{title}</h1>{body}</section><p>{rights}</p>",
            )[h % 4]
            rows.append((100 * h + k, f"https://host{h}.example/{k}", page, "\n".join([title, *paragraphs])))
    return rows


def test_generated_pages_and_what_templates_do(spark, monkeypatch):
    rows = generated_pages()
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    want = {r[0]: r[3] for r in rows}
    for salt_pages in (1000, 2):
        assert {r.page_id: r.text for r in html_template.extract(df, salt_pages).collect()} == want
    none = spark.createDataFrame([], "host string, main array<long>, constant array<long>")
    monkeypatch.setattr(html_template, "templates", lambda *_: none)
    without = {r.page_id: r.text for r in html_template.extract(df).collect()}
    assert all(without[k] != want[k] for k in want)  # constants stay


def test_every_block_is_a_token():
    page = "<title>T</title><nav>menu</nav><p>a <b hidden>x</b> b<div class=ad>buy</div><form>all <p>in a form</form>"
    assert [(b.text, b.bare, b.aside) for b in html_template.read_page(page)[1]] == [("T", "T", True), ("menu", "menu", True), ("a b", "a b", False), ("buy", "", False), ("all", "", False), ("in a form", "", False)]


# Languages


def test_gradients():
    net = langid.Network(3, hidden=4, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    data, labels = rng.integers(97, 103, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, g = net.gradients(data, labels)
    for k in net.w:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in net.w[k].shape)
            if k[0] == "x":
                at = (at[0], int(rng.choice(data.ravel())), at[2])
            keep, diff = net.w[k][at], []
            for e in (1e-2, -1e-2):
                net.w[k][at] = keep + e
                diff.append(net.gradients(data, labels)[0])
            net.w[k][at] = keep
            assert g[k][at] == pytest.approx((diff[0] - diff[1]) / 2e-2, rel=0.05, abs=2e-4)


def test_languages(spark):
    words = {"aa": ["kato", "milu", "sora", "neko"], "bb": ["schrift", "wald", "zwerg", "pfund"]}
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, "s", None) for k, lang in ((k, "ab"[k % 2] * 2) for k in range(120))]
    rows += [(1000, None, "aa", None, None), (1001, "12 !! 34", "bb", None, None), (1002, "", None, None, None), (None, "kato milu sora", None, None, None), (1003, rows[0][1] * 200, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002)) and got[None].lang_pred == got[1003].lang_pred == "aa"
    held = [r for k, r in got.items() if k is not None and k < 1000 and r.held_out]
    assert len(held) > 20 and all(r.lang_pred == "ab"[r.doc_id % 2] * 2 and 0.5 < r.score <= 1 for r in held)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_byte_counts():
    net = langid.Network(2, hidden=4)
    texts = [b"x" * 700, b"", b"abc", bytes(range(256)) * 3]
    whole = net.pooled(texts)
    assert np.allclose(whole, np.vstack([net.pooled([t]) for t in texts]), atol=1e-5) and np.allclose(whole.sum(1), [1, 0, 1, 1], atol=1e-5)


# Mixing


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(["a", "b", "B", "é", None, "tiny"] if k % 50 == 0 else ["a", "b", "B"])) for k in range(300)]
    rows += [(900, None, "none"), (901, "", None), (1, rows[1][1], rows[1][2])]
    df = docs(spark, rows).withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=repr)
    size: dict = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    clamped: set = set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in clamped)
        free = sum(weight[s] for s in order if s not in clamped)
        above = {s for s in order if s not in clamped and weight[s] * rest / free > 2 * size[s]}
        if not above:
            break
        clamped |= above
    target = {s: 2.0 * size[s] if s in clamped else weight[s] * rest / free for s in order}
    taken: dict = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    assert mixing.mix(df.limit(0)).count() == 0
