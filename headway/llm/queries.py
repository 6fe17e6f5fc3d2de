"""The thin queries opN_<name> over the given tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import ann, bpe, divergence, html_template, langid, minhash, mixing, mpeg_audio, spelling, substring_index, suffix_array, toxicity, warc
from headway.llm.common import table


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that a smaller doc_id has in a string of 50; null and empty texts have none, repeated rows one result each. An empty table gives no rows. Very long texts are read whole; other columns are ignored."""
    rows = suffix_array.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by inner product; null, zero and odd vectors take no part, ties go to the smaller id. An empty table gives no rows. Other columns are ignored."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; null and empty texts have no tokens, repeated rows one result each. An empty table gives no rows. Very long texts are read whole; other columns are ignored."""
    vocabulary = bpe.default_vocabulary()
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary).drop("text"), *vocabulary)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents alike to 85 hundredths; those without words are alone, rows of one doc_id are one document. An empty table gives no rows. Very long texts are read whole; other columns are ignored."""
    return minhash.link(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; null html gives an empty one, repeated rows one result each. An empty table gives no rows. Very long pages are read whole; other columns are ignored."""
    return html_template.extract(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back; null html is an empty payload. intact: framing and digests held on reading. An empty table gives no rows. Very long pages are stored whole; other columns are ignored."""
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; `und` without a letter, repeated rows are judged alike. An empty table gives no rows. Very long texts are read whole; other columns are ignored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a smaller doc_id has in a window of 13; null and empty texts have none, repeated rows one result each. An empty table gives no rows. Very long texts are read whole; other columns are ignored."""
    rows = substring_index.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; null texts have size 0, a null source is one of its own. An empty table gives no rows. Very long texts are read whole; other columns are ignored."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an MPEG stream, read back; a null text is an empty one, equal texts give equal values. An empty table gives no rows. Very long texts are read whole; other columns are ignored."""
    media = mpeg_audio.with_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = mpeg_audio.features(media, ["doc_id", "n_bytes"])
    offsets = F.concat_ws(",", F.col("offsets").cast("array<string>"))
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in {"frames": F.col("frames"), "seconds": F.concat_ws("/", F.col("seconds").cast("array<string>")), "rate": F.col("rate"), "table": F.col("table_frames"), "bad_crc": F.col("bad_crc"), "skipped": F.col("skipped"), "offsets": F.sha2(offsets.cast("binary"), 256)}.items()))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; null and empty texts say nothing for either class, very long ones are read whole, repeated rows are judged alike. An empty table gives no rows; other columns are ignored."""
    return toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ; nulls are empty texts, very long texts are read whole, repeated rows count each. An empty table gives no rows; other columns are ignored."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with the form that it is a variant of; null and empty texts have no words, very long ones are read whole, repeated rows count each. An empty table gives no rows; other columns are ignored."""
    return spelling.variants(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size, md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
b AS (SELECT *, 2 * n AS cap, 1.5 * sum(n) OVER () AS budget FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_here FROM b),
f AS (SELECT *, cap * from_here < w * (budget - below) AS clamped FROM c),
t AS (SELECT source, n, CASE WHEN clamped THEN cap ELSE (budget - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN clamped THEN 0 ELSE w END) OVER () END AS target FROM f),
j AS (SELECT d.*, n, target, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target, CAST(whole * size + greatest(0, least(size, floor(target - whole * n + 0.5) - ahead)) AS BIGINT) AS taken FROM j
"""

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
l AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to, true AS intact FROM l
"""

# Strings of 50 bytes as 100 hexadecimal digits
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, x, n, unnest(range(n)) AS i FROM d),
s AS (SELECT doc_id, i, x[2 * i + 1:2 * i + 2] AS b, CASE WHEN i + 50 <= n THEN x[2 * i + 1:2 * i + 100] END AS s FROM p),
f AS (SELECT *, CASE WHEN s IS NOT NULL THEN min(doc_id) OVER (PARTITION BY s) < doc_id ELSE FALSE END AS again FROM s),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM c),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS r, count(*) FILTER (WHERE opens) AS spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
q AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inside FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM q JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * inside >= 85 * (m.n + o.n - inside)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id),
c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i + 12 <= len(w) THEN array_to_string(w[i:i + 12], ' ') END AS s FROM p),
f AS (SELECT *, CASE WHEN s IS NOT NULL THEN min(doc_id) OVER (PARTITION BY s) < doc_id ELSE FALSE END AS again FROM s),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS r, string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k USING (lang) GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p FROM m JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q FROM (SELECT lang, term, sum(n) AS n FROM m GROUP BY lang, term) JOIN v USING (lang)),
f AS (SELECT lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50
"""

# A run's crc32 bit by bit over the hexadecimal digits of its bytes. Near words are equal after the loss of one letter of one of them, or of the same letter of both.
SPELLING_SQL = r"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM o WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, n, list_transform(range(4 * length(x)), lambda k: CAST(((instr('0123456789ABCDEF', x[CAST(2 * (k // 8) + CASE WHEN k % 8 < 4 THEN 2 ELSE 1 END AS INT)]) - 1) >> CAST(k % 4 AS INT)) & 1 AS UBIGINT)) AS bits FROM u),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, bits), lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END), 4294967295::UBIGINT) AS h FROM b),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
e AS (SELECT word, i, left(word, CAST(i - 1 AS INT)) || substr(word, CAST(i + 1 AS INT)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
s AS (SELECT a.word, b.word AS near FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT e.word, w.word FROM e JOIN w ON e.rest = w.word UNION SELECT w.word, e.word FROM e JOIN w ON e.rest = w.word),
m AS (SELECT s.word, count(*) AS n_near, max(w.n) AS top, arg_min(near, (-w.n, encode(near))) AS best FROM s JOIN w ON w.word = s.near GROUP BY s.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN best END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN m USING (word)),
r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r USING (word) WHERE root IN (SELECT word FROM f WHERE form IS NULL)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_array, op2_nearest_neighbours, op3_byte_bpe, op4_minhash_dedup, op5_html_text, op6_warc, op7_language_id, op8_repeated_passages, op9_mix_sources, op10_mpeg_audio, op11_toxicity, op12_source_divergence, op13_spelling_variants)}
ORACLE_SQL: dict[str, str] = {"op1_suffix_array": REPEATS_SQL, "op4_minhash_dedup": NEAR_SQL, "op8_repeated_passages": PASSAGES_SQL, "op6_warc": WARC_SQL, "op9_mix_sources": MIX_SQL.format(documents="documents"), "op12_source_divergence": DIVERGENCE_SQL, "op13_spelling_variants": SPELLING_SQL}
