"""HTML extraction by template deduction.

Per host, tokens (start tags with their path, texts at a path) that share their occurrence vector over the host's pages
form an equivalence class. Classes that occur on many of the pages and nest within one parent class make the host's
template. What the template leaves open are slots: the text is taken from the slots within the template's article,
else from all slots. What HTML itself declares to be no main text (nav, aside, hidden ...) is left out besides, and so is
what forms hold and what a list of class and id words names, as comments and adverts vary like an article does. Counts are combined before the
shuffle, and the pages of a host are dealt by (host, salt), with as many salts as the host's size asks for.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import checkpointed, pieces

# Fixed values of the format and of common page markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp noembed".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("body dd dt head html li optgroup option tbody td tfoot th thead title tr legend".split())
#: A start tag closes an open element of the same group within its container.
GROUPS = {**dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu"))), **dict.fromkeys(("dd", "dt"), (("dd", "dt"), ("dl",))), **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
MAIN = frozenset(("article", "main"))
ASIDE_TAGS = frozenset("nav aside footer button select head title dialog menu svg canvas object audio video map search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert note menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A header of one of these is part of the text.
HEADED = frozenset("article entry post story".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup comment comments reply replies respond disqus share sharing social related recommended widget login search skip pagination pager toolbar copyright disclaimer".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


#: A host gets a salt for every so many of its pages, or for each part of 1 / LARGE_HOSTS of all pages if that is more:
#: so at most LARGE_HOSTS hosts have several salts, and their names are broadcast.
SALT_PAGES, LARGE_HOSTS = 1000, 100_000


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@dataclass
class Block:
    """A block of text. path: of the block elements around it; mains: paths of all article and main elements around it, outermost first; aside: declared to be a menu, hidden or the like; bare: the text without what the word list names."""

    path: str
    mains: tuple[str, ...]
    aside: bool
    text: str
    bare: str


@dataclass
class _Open:
    tag: str
    path: str
    mains: tuple[str, ...]
    aside: bool
    listed: bool


def _is_aside(tag: str, attrs: dict[str, str], within_main: bool) -> bool:
    """Declared by the element itself."""
    return tag in ASIDE_TAGS or tag == "header" and not within_main or "hidden" in attrs or attrs.get("role", "").lower() in ASIDE_ROLES or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I) is not None


def _is_listed(tag: str, attrs: dict[str, str], within_main: bool) -> bool:
    """A form, or named by the word list; a heading never is, nor an article's header."""
    if tag == "form":
        return True
    if tag in ("html", "body") or tag in MAIN or tag in HEADINGS:
        return False
    words = {w.lower() for name in ("class", "id") if name in attrs for w in _WORDS.findall(attrs[name])}
    if within_main or words & HEADED:
        words.discard("header")
    return bool(words & ASIDE_WORDS)


def read_page(page: str) -> tuple[list[tuple[str, str]], list[Block]]:
    """The start tags as (path, parent's path), and the blocks in page order. Unclosed and misnested elements are closed as browsers do."""
    tags: list[tuple[str, str]] = []
    blocks: list[Block] = []
    stack = [_Open("", "", (), False, False)]
    text: list[tuple[str, bool, bool]] = []  # with whether it counts for the text and for the bare text

    def top() -> _Open:
        return next(x for x in reversed(stack) if x.tag in BLOCK or not x.tag)

    def flush() -> None:
        if text:
            if joined := _SPACE.sub(" ", "".join(t for t, full, _ in text if full)).strip():
                over = top()
                bare = "" if over.listed else joined if all(full and bare for _, full, bare in text) else _SPACE.sub(" ", "".join(t for t, _, bare in text if bare)).strip()
                blocks.append(Block(over.path, over.mains, over.aside, joined, bare))
            text.clear()

    def close(k: int) -> None:
        if any(x.tag in BLOCK for x in stack[k:]):
            flush()
        del stack[k:]

    def within(tags: tuple[str, ...], until) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in until:
                break
        return 0

    at = 0
    while m := _TOKEN.match(page, at):
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0][:2] not in ("<!", "<?") and (not stack[-1].aside or top().aside):
                text.append((entities.unescape(m[0]), True, not stack[-1].listed))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                text.append((" ", True, True))
            elif k := within((tag,), ("article", "main", "td", "th") if tag == "p" else ()):
                close(k)
            continue
        if tag == "br":
            text.append((" ", True, True))
            continue
        attrs = {a[0].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3])} if m[3] and not m[3].isspace() else {}
        if tag in CLOSES_P and (k := within(("p",), ("article", "main", "aside", "section", "td", "th", "button", "object"))):
            close(k)
        if tag in GROUPS and (k := within(*GROUPS[tag])):
            close(k)
        if tag in BLOCK:
            flush()
        over = stack[-1]
        path = f"{over.path}/{tag}" + "".join(f".{c}" for c in sorted(attrs.get("class", "").split())) + (f"#{attrs['id']}" if attrs.get("id") else "")
        tags.append((path, over.path))
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        aside = over.aside or _is_aside(tag, attrs, bool(over.mains))
        listed = over.listed or _is_listed(tag, attrs, bool(over.mains))
        if (aside != over.aside or listed != over.listed) and tag not in BLOCK:  # inline: its text is left out, the block goes on
            text.append((" ", aside != over.aside, True))
        stack.append(_Open(tag, path, (*over.mains, path) if tag in MAIN else over.mains, aside, listed))
    flush()
    return tags, blocks


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for part in pieces(batch, "html", 1 << 20):
            yield part, [read_page(x or "") for x in part.column("html").to_pylist()]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("parent", pa.int64()), ("kind", pa.string()), ("n", pa.int32())])
    for part, read in _parsed(batches):
        rows = []
        for host, page, (tags, blocks) in zip(part.column("host").to_pylist(), part.column("page").to_pylist(), read):
            count: dict[tuple, int] = {}
            for path, parent in tags:
                last = path.rpartition("/")[2].split(".")[0].split("#")[0]
                k = (path, parent, "main" if last in MAIN else "tag")
                count[k] = count.get(k, 0) + 1
            for b in blocks:
                k = (f"{b.path}\n{b.text}", b.path, "text")
                count[k] = count.get(k, 0) + 1
            rows += [(host, page, hash64(t), hash64(p), kind, n) for (t, p, kind), n in count.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)


def hosted(pages: DataFrame) -> DataFrame:
    """page_id, url, html, with host (lower case; '' if there is none) and page, a hash of all three."""
    return pages.select("page_id", "url", "html").withColumn("host", F.lower(F.coalesce(F.expr("try_parse_url(url, 'HOST')"), F.lit("")))).withColumn("page", F.xxhash64("page_id", "url", "html"))


def templates(pages: DataFrame, hosts: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """(host, main, constant): hashes of the template's article paths and of its constant texts, wherever they are, one row per host that has a template.

    `pages` comes from `hosted`; hosts: (host, of), with the number of pages. A class counts if it has two tokens or more, occurs on `least` pages and on `share` of
    the host's pages, and all its tags whose parent is outside of it lie in one parent class. A constant text may lie in a tag of any class, such
    as one of many p.
    """
    tokens = pages.select("host", "page", "html").mapInArrow(_tokens, "host string, page long, token long, parent long, kind string, n int")
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)"))
    stats = checkpointed(tokens.groupBy("host", "token").agg(F.first("parent").alias("parent"), F.first("kind").alias("kind"), F.count("*").alias("pages"), vector.alias("vector")))
    frequent = stats.join(hosts, "host").filter((F.col("pages") >= least) & (F.col("pages") >= share * F.col("of")))
    above = frequent.select("host", F.col("token").alias("parent"), F.col("vector").alias("over"))
    outside = F.when((F.col("over") != F.col("vector")) & (F.col("kind") != "text"), F.col("over"))
    classes = frequent.join(above, ["host", "parent"], "left").groupBy("host", "vector").agg(F.count("*").alias("size"), F.min(outside).alias("low"), F.max(outside).alias("high"))
    valid = classes.filter((F.col("size") >= 2) & F.col("low").eqNullSafe(F.col("high"))).select("host", "vector")
    inside = frequent.join(valid, ["host", "vector"], "left_semi")
    return inside.groupBy("host").agg(F.collect_set(F.when(F.col("kind") == "main", F.col("token"))).alias("main"), F.collect_set(F.when(F.col("kind") == "text", F.col("token"))).alias("constant"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("mains", pa.list_(pa.int64())), ("token", pa.int64()), ("text", pa.string()), ("bare", pa.string())]))
    for part, read in _parsed(batches):
        col = [[([hash64(m) for m in b.mains], hash64(f"{b.path}\n{b.text}"), b.text, None if b.bare == b.text else b.bare) for b in blocks if not b.aside] for _, blocks in read]
        col = [[{"mains": m, "token": t, "text": x, "bare": y} for m, t, x, y in row] for row in col]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), pa.array(col, kind)], ["page_id", "url", "host", "blocks"])


def extract(pages: DataFrame, salt_pages: int = SALT_PAGES) -> DataFrame:
    """page_id, url, text (main text, '' if none) and n_chars, one row per row of pages(page_id, url, html).

    Slots anywhere within an article or main element that belongs to the host's template are the text; else those in any
    article or main element; where a page has none, all slots. The host's constant texts are no slots. Within an article,
    they count as such only if more of the page's texts there differ, as copies of an article may fill a host. What the
    word list names (comments, adverts, sidebars, forms) is left out everywhere, within articles too, unless nothing would
    be left of the slots. Very long pages are read whole. Null html or url: as empty. Repeated rows
    give repeated results. Empty table: no rows. Other columns are ignored.
    """
    pages = hosted(pages)
    hosts = checkpointed(pages.groupBy("host").agg(F.count("*").alias("of")))
    most = max(salt_pages, (hosts.agg(F.sum("of")).first()[0] or 0) // LARGE_HOSTS)
    large = F.broadcast(hosts.filter(F.col("of") > most).select("host", F.ceil(F.col("of") / most).alias("salts")))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    template = checkpointed(templates(pages, hosts)).join(large, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    blocks = pages.select("page_id", "url", "host", "html").mapInArrow(_blocks, "page_id long, url string, host string, blocks array<struct<mains: array<long>, token: long, text: string, bare: string>>")
    blocks = blocks.join(large, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), salts)).drop("salts")
    rows = blocks.join(template, ["host", "salt"], "left")
    has = F.col("constant").isNotNull()
    bare = lambda b: F.coalesce(b["bare"], b["text"])
    within = lambda b: F.coalesce(F.arrays_overlap(F.col("main"), b["mains"]), F.lit(False))
    inner = lambda b: F.size(b["mains"]) > 0
    slot = lambda b: ~F.array_contains(F.col("constant"), b["token"])
    rows = rows.withColumn("blocks", F.when(has, F.col("blocks")).otherwise(F.filter("blocks", lambda b: bare(b) != "")))
    rows = rows.withColumn("some", F.exists("blocks", inner))
    rows = rows.withColumn("blocks", F.when(F.exists("blocks", within), F.filter("blocks", within)).when(F.col("some"), F.filter("blocks", inner)).otherwise(F.col("blocks")))
    rows = rows.withColumn("slots", F.when(has, F.filter("blocks", slot)))
    told = has & (~F.col("some") | (2 * F.size("slots") > F.size("blocks")))
    # what varies may be a comment, an advert or a form too; a list that would take all names the container of the text
    named = lambda c: F.filter(F.transform(c, bare), lambda t: t != "")
    kept = F.when(told & (F.size(named("slots")) == 0), F.transform("slots", lambda b: b["text"])).when(told, named("slots")).otherwise(named("blocks"))
    text = F.concat_ws("\n", kept)
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
