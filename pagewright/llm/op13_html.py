"""Main text of pages by template deduction: what same-host pages share is their template, its slots hold the text.

Tokens are tags by their path of elements, and texts outside articles. Tokens of a host that occur
equally often on every page have one occurrence vector and are an equivalence class. A class is valid
if it is large and frequent enough and its tokens come in the same order on all pages; since paths
differ by element, a class whose tokens lie within an element nests in the gap that this element's
tag opens in another class. The valid classes are the template. Its texts are fixed and go; the
element that holds the slots with the pages' own words is chosen for the host, and the text of the
slots in it is a page's main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_limit, keep, table

#: A class has two tokens or more and is on this many pages of different text, and on this share of them; hosts of fewer such pages are taken together.
LEAST_PAGES, LEAST_SHARE = 3, 0.05
#: The element chosen holds this share of the words; of several articles those that hold this share of what the largest does.
MOST_WORDS, ALSO = 0.8, 0.5
#: Pages of one host that are joined with one copy of its template.
SALT_ROWS = 2_000

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp noembed noframes iframe".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOXES = set("html body div section article main td center".split())
NOT_MAIN = set("head nav footer aside form button select script style noscript template svg object dialog menu iframe textarea title".split())
#: What ends an element whose end tag is left out: the elements that it ends at, and those beyond which none is looked for.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Parts of class, id and role that name what is no main text.
NAMES = set("ad ads adv advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer disqus footer gdpr legal login menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
TALK = set("comment comments commentlist discussion replies reply respond responses".split())
HEADS = {"header", "masthead"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    """An element: its place in the page, the hash of its path, and whether it is main text or none."""

    parent: int
    tag: str
    path: int
    depth: int
    names: frozenset[str]
    hidden: bool
    block: bool
    article: bool = False
    out: bool = False
    words: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (element, text, words, words in links), in page order.
    blocks: list[tuple[int, str, int, int]] = field(default_factory=list)
    #: Of each tag: its hash and its element; -1 - i stands for block i.
    seq: list[tuple[int, int]] = field(default_factory=list)


def _hash(*parts: object) -> int:
    value = xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


@lru_cache(maxsize=20_000)
def _attributes(text: str) -> tuple[bool, str, frozenset[str], bool]:
    """(has a class or id, label, names, hidden) of a tag's attributes; numbers in class and id don't tell elements apart."""
    attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}
    names = frozenset(x.lower() for a in ("class", "id", "role") for x in _PART.findall(attrs.get(a, "")))
    label = f"{re.sub('[0-9]+', '0', ' '.join(sorted(attrs.get('class', '').split())))}#{re.sub('[0-9]+', '0', attrs.get('id', ''))}"
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    return bool({"class", "id"} & set(attrs)), label, names, hidden


@lru_cache(maxsize=100_000)
def _path(up: int, tag: str, label: str) -> int:
    """The hash of an element's path, even, which is its tag's token; the end tag's is one more."""
    return _hash(up, tag, label) & ~1


def parse(source: str | None) -> Page:
    """Elements, text blocks and tags of a page, however well formed; linear in its length.

    Only elements that aren't inline have a path, so an unclosed <b> doesn't change it; a span with a
    class or id is an element that breaks no block. Comments and scripts are none.
    """
    page, stack, pieces, links, anchors, opened = Page(), [], [], 0, 0, Counter()
    page.nodes.append(Node(-1, "", 0, 0, frozenset(), False, True))
    stack.append(0)
    source = source or ""

    def flush() -> None:
        nonlocal pieces, links
        words = "".join(pieces).split()
        if words:
            page.seq.append((0, -1 - len(page.blocks)))
            page.blocks.append((stack[-1], " ".join(words), len(words), min(links, len(words))))
        pieces, links = [], 0

    def close(tags: set[str], limits: set[str], ends: bool) -> bool:
        """Ends the nearest open element of `tags`, if none of `limits` is nearer, and all within it."""
        if not any(opened[t] for t in tags):
            return False
        for at in range(len(stack) - 1, 0, -1):
            tag = page.nodes[stack[at]].tag
            if tag in tags:
                if any(page.nodes[i].block for i in stack[at:]):
                    flush()
                if ends:
                    page.seq.append((page.nodes[stack[at]].path + 1, stack[at]))
                for i in stack[at:]:
                    opened[page.nodes[i].tag] -= 1
                del stack[at:]
                return True
            if tag in limits:
                return False
        return False

    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:  # a tag that never ends
            pieces.append(source[at])
            at += 1
            continue
        at = m.end()
        if m["text"] is not None:
            said = html.unescape(m["text"])
            pieces.append(said)
            links += len(said.split()) if anchors else 0
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            anchors = max(0, anchors - 1) if tag == "a" else anchors
            if tag not in INLINE or tag == "span":
                close({tag}, {"table"} if tag in ("p", "li", "div", "span") else set(), tag != "span")
            elif tag == "br":
                pieces.append(" ")
            continue
        own, label, names, hidden = _attributes(m["attrs"])
        if tag in ("br", "wbr", "img", "input"):
            pieces.append("" if tag == "wbr" else " ")
            continue
        anchors += tag == "a"
        if tag in INLINE and (tag != "span" or not own):
            continue
        block = tag != "span"
        if block:
            if tag in ENDS:
                close(*ENDS[tag], False)
            close({"p"}, {"td", "th", "table", "button", "li", "div", "article", "section", "blockquote"}, False)
            flush()
        up = page.nodes[stack[-1]]
        node = Node(stack[-1], tag, _path(up.path, tag, label), up.depth + 1, names, hidden, block)
        page.nodes.append(node)
        page.seq.append((node.path, len(page.nodes) - 1))
        if tag in RAW:
            found = _RAW_END[tag].search(source, at)
            at = found.end() if found else len(source)
        elif tag not in VOID and not (m["attrs"].endswith("/") and tag in ("svg", "path")):
            stack.append(len(page.nodes) - 1)
            opened[tag] += 1
    flush()
    _settle(page)
    return page


def _settle(page: Page) -> None:
    """Tell which elements are articles, which are no main text, and how many words not in links each holds."""
    inside = [False] * len(page.nodes)
    holds = [False] * len(page.nodes)
    for i, n in enumerate(page.nodes):
        n.article = n.tag in ("article", "main") and not n.names & (TALK | NAMES) or "main" in n.names and n.tag in ("div", "section") and not n.names & (TALK | NAMES | {"nav", "menu"})
        inside[i] = n.parent >= 0 and (inside[n.parent] or page.nodes[n.parent].article)
    for i in range(len(page.nodes) - 1, 0, -1):
        holds[page.nodes[i].parent] |= holds[i] or page.nodes[i].article
    for i, n in enumerate(page.nodes):
        named = bool(n.names & NAMES) or (not inside[i] and (n.tag == "header" or bool(n.names & HEADS)))
        wraps = n.tag in ("html", "body") or n.article or holds[i]
        n.out = n.hidden or bool(n.names & TALK and n.tag not in ("html", "body")) or (n.tag in NOT_MAIN and not (n.tag == "form" and holds[i])) or (named and not wraps)
        n.out |= n.parent >= 0 and page.nodes[n.parent].out
        n.article &= not n.out
    for i, _, words, links in page.blocks:
        page.nodes[i].words += 0 if page.nodes[i].out else words - links
    for i in range(len(page.nodes) - 1, 0, -1):
        page.nodes[page.nodes[i].parent].words += page.nodes[i].words


def tokens(page: Page) -> tuple[int, list[dict], list[int]]:
    """(key, tokens, seq): the hash of the page's longest text, its tokens with how often they occur, and their order.

    A token's kind is 0 for a text outside articles, 1 for a tag, 2 for one that may hold the main
    text and 3 for an article's.
    """
    within = [False] * len(page.nodes)
    for i, n in enumerate(page.nodes):
        within[i] = n.article or (n.parent >= 0 and within[n.parent])
    box = [0] * len(page.nodes)  # the nearest element around each that may hold the main text
    for i, n in enumerate(page.nodes):
        if n.parent >= 0:
            box[i] = page.nodes[n.parent].path if page.nodes[n.parent].tag in BOXES else box[n.parent]
    seq, found = [], {}
    for value, at in page.seq:
        if at < 0:
            node, text, words, links = page.blocks[-1 - at]
            n = page.nodes[node]
            if within[node]:
                continue
            t, kind, depth = _hash("text", n.path, text), 0, 0
            words, up = 0 if n.out else words - links, n.path if n.tag in BOXES else box[node]
        else:
            n = page.nodes[at]
            t, kind = value, 1 if value != n.path or n.out else 3 if n.article else 2 if n.tag in BOXES else 1
            words, depth, up = (n.words if kind > 1 else 0), n.depth, box[at]
        seq.append(t)
        one = found.setdefault(t, {"t": t, "n": 0, "kind": kind, "words": 0, "depth": depth, "up": up})
        one["n"] += 1
        one["words"] += words
        one["kind"] = max(one["kind"], kind)
    return _hash(max((b[1] for b in page.blocks), key=len, default="")), list(found.values()), seq


def choose(members: list[dict]) -> tuple[list[int], list[int]]:
    """(boxes, fixed) of a template: the elements that hold the main text, and its fixed texts.

    They are the articles that hold most words a page; without any, the deepest element, once on
    a page, that holds most of the words outside links once the fixed texts are taken off.
    """
    fixed = [m["t"] for m in members if m["kind"] == 0]
    articles = {m["t"]: m["words"] / m["seen"] for m in members if m["kind"] == 3 and m["words"] > 0}
    if articles:
        return [t for t, w in articles.items() if w >= ALSO * max(articles.values())], fixed
    boxes = {m["t"]: m for m in members if m["kind"] == 2 and m["most"] == 1}
    left = {t: m["words"] for t, m in boxes.items()}
    for m in members:
        up = m["up"] if m["kind"] == 0 else None
        while up in boxes:
            left[up] -= m["words"]
            up = boxes[up]["up"]
    top = max(left.values(), default=0)
    if top <= 0:
        return [], fixed
    deep = max(boxes[t]["depth"] for t, w in left.items() if w >= MOST_WORDS * top)
    return [t for t, w in left.items() if w >= MOST_WORDS * top and boxes[t]["depth"] == deep], fixed


def boxes_of(page: Page) -> set[int]:
    """The page's own choice of main elements (tokens of their tags), where the template has none: its articles, else the deepest element with most words."""
    most: Counter[int] = Counter()
    articles = [n for n in page.nodes if n.article and n.words > 0]
    if articles:
        for n in articles:
            most[n.path] += n.words
        top = max(most.values())
        return {p for p, w in most.items() if w >= ALSO * top}
    held = [n for n in page.nodes if not n.out and n.tag in BOXES | {""}]
    return {max((n for n in held if n.words >= MOST_WORDS * page.nodes[0].words), key=lambda n: n.depth).path}


def main_text(page: Page, boxes: set[int], fixed: set[int]) -> str:
    """The blocks in the slots of the innermost elements that `boxes` names (tokens of their tags), without the template's texts.

    Outside articles, blocks that are links alone are menus.
    """
    chosen = [n.path in boxes and not n.out for n in page.nodes] if boxes else []
    if not any(chosen):
        own = boxes_of(page)
        chosen = [n.path in own and not n.out for n in page.nodes]
    holds = [False] * len(page.nodes)
    for i in range(len(page.nodes) - 1, 0, -1):
        if chosen[i] or holds[i]:
            holds[page.nodes[i].parent] = True
    within, article = [False] * len(page.nodes), [False] * len(page.nodes)
    for i, n in enumerate(page.nodes):
        within[i] = (chosen[i] and not holds[i]) or (n.parent >= 0 and within[n.parent])
        article[i] = n.article or (n.parent >= 0 and article[n.parent])
    slots = ((page.nodes[at], text) for at, text, words, links in page.blocks if within[at] and not page.nodes[at].out and (links < words or article[at]))
    return "\n".join(text for n, text in slots if not fixed or _hash("text", n.path, text) not in fixed)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _page_tokens(pages: DataFrame) -> DataFrame:
    """(host, key, tokens, seq) of each of pages(host, html)."""
    kind = pa.list_(pa.struct([("t", pa.int64()), ("n", pa.int32()), ("kind", pa.int32()), ("words", pa.int64()), ("depth", pa.int32()), ("up", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, seqs = zip(*(tokens(parse(x.as_py())) for x in batch["html"]), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(keys, pa.int64()), pa.array(found, kind), pa.array(seqs, pa.list_(pa.int64()))], ["host", "key", "tokens", "seq"])

    return pages.select("host", "html").mapInArrow(run, "host string, key long, tokens array<struct<t: bigint, n: int, kind: int, words: bigint, depth: int, up: bigint>>, seq array<long>")


def _join(left: DataFrame, right: DataFrame, key: str, salt: Column, rows: int) -> DataFrame:
    """Left join with `right`, one row a key and `pages` of the left's rows; keys of very many rows meet several copies of it.

    Only the keys with many rows and how many copies they get, at most 2,000 short rows, go to all tasks.
    """
    hot = F.broadcast(right.filter(F.col("pages") > hot_limit(rows)).select(key, F.ceil(F.col("pages") / SALT_ROWS).cast("int").alias("_copies")))
    wide = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    salted = left.join(hot, key, "left").withColumn("_salt", F.pmod(salt, F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    return salted.join(wide, [key, "_salt"], "left").drop("_salt")


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((grp, pages, boxes, fixed), (host, pages, grp)): the template of each group of pages(host, html), and each host's group.

    A group is a host of LEAST_PAGES pages of different text or more; all other hosts are one. Pages
    of equal longest text count once. `boxes` are tokens of the elements that hold the main text and
    `fixed` the template's texts.
    """
    facts = keep(_page_tokens(pages), "html-tokens")
    once = facts.groupBy("host", "key").agg(F.min(F.struct("tokens", "seq")).alias("f")).select("host", "key", "f.*")
    once = keep(once, "html-once")
    sizes = once.groupBy("host").agg(F.count("*").alias("distinct"))
    hosts = keep(facts.groupBy("host").agg(F.count("*").alias("pages")).join(sizes, "host").withColumn("grp", F.when((F.col("distinct") >= LEAST_PAGES) & (F.col("host") != ""), F.col("host")).otherwise("")), "html-hosts")
    rows = once.count()
    own = _join(once, hosts.select("host", F.col("distinct").alias("pages"), "grp"), "host", F.col("key"), rows)
    groups = hosts.groupBy("grp").agg(F.sum("distinct").alias("pages"))
    one = own.select("grp", "host", "key", F.explode("tokens").alias("k")).select("grp", "host", "key", "k.*")
    vector = F.bit_xor(F.xxhash64("host", "key", "n"))
    vectors = one.groupBy("grp", "t").agg(F.count("*").alias("seen"), vector.alias("vector"), F.max("kind").alias("kind"), F.sum("words").alias("words"), F.max("depth").alias("depth"), F.max("up").alias("up"), F.max("n").alias("most"))
    often = vectors.join(groups, "grp").filter((F.col("seen") >= LEAST_PAGES) & (F.col("seen") >= LEAST_SHARE * F.col("pages"))).drop("pages")
    token = F.struct("t", "kind", "words", "depth", "seen", "up", "most")
    classes = keep(often.groupBy("grp", "vector").agg(F.collect_list(token).alias("members")).filter(F.size("members") >= 2), "html-classes")
    # A class is ordered if, on each page, its tokens come as one run of all of them, again and again, the same on all pages.
    sent = classes.groupBy("grp").agg(F.collect_list(F.struct("vector", F.transform("members", lambda m: m["t"]).alias("ts"))).alias("classes")).join(groups, "grp")
    seen = _join(own.select("grp", "key", "seq"), sent, "grp", F.col("key"), rows).filter("classes is not null")
    there = seen.select("grp", F.explode(F.transform("classes", lambda c: F.struct(c["vector"].alias("vector"), F.size(c["ts"]).alias("m"), F.filter("seq", lambda t: F.array_contains(c["ts"], t)).alias("run")))).alias("c")).select("grp", "c.*").filter(F.size("run") > 0)
    first = F.slice("run", 1, F.col("m"))
    regular = (F.size("run") % F.col("m") == 0) & F.forall(F.sequence(F.lit(0), F.size("run") - 1), lambda i: F.get("run", i) == F.get("run", (i % F.col("m")).cast("int")))
    order = F.when(regular & (F.size(F.array_distinct(first)) == F.col("m")), F.xxhash64(first))
    valid = there.withColumn("order", order).groupBy("grp", "vector").agg(((F.count("order") == F.count("*")) & (F.min("order") == F.max("order"))).alias("ok")).filter("ok")
    held = classes.join(valid, ["grp", "vector"], "left_semi").select("grp", F.explode("members").alias("m")).select("grp", "m.*")
    members = held.groupBy("grp").agg(F.collect_list(F.struct("t", "kind", "words", "depth", "seen", "up", "most")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [choose(x) for x in batch["members"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["grp"], *(pa.array([x[i] for x in made], pa.list_(pa.int64())) for i in (0, 1))], ["grp", "boxes", "fixed"])

    return members.mapInArrow(run, "grp string, boxes array<long>, fixed array<long>"), hosts.select("host", "pages", "grp")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page: its main text, a line a block.

    Articles without menus, headers, footers, sidebars, notices, adverts, forms, scripts and readers'
    comments, as their tags or the parts of their class, id and role name them and as the host's
    template tells; a page that the template doesn't fit, or of a host with too few pages, is read by
    its own tags. Texts in an article element are never the template's. White space in a block is
    one space, <br> too. A null or empty page has an empty text; a null url is of no host; null and
    repeated ids are pages of their own, and other columns of `pages` don't enter.
    """
    rows = pages.select(F.col(id_col), F.col(url_col), host_of(F.col(url_col)).alias("_ht_host"), F.col(html_col).alias("_ht_html"))
    made, hosts = templates(rows.select(F.col("_ht_host").alias("host"), F.col("_ht_html").alias("html")))
    per_host = keep(hosts.join(made, "grp", "left").select(F.col("host").alias("_ht_host"), "pages", "boxes", "fixed"), "html-templates")
    joined = _join(rows, per_host, "_ht_host", F.xxhash64("_ht_html"), per_host.agg(F.sum("pages")).first()[0] or 0)
    schema = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(parse(h.as_py()), set(b.as_py() or ()), set(f.as_py() or ())) for h, b, f in zip(batch["_ht_html"], batch["boxes"], batch["fixed"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return joined.select(id_col, url_col, "_ht_html", "boxes", "fixed").mapInArrow(run, schema)


def op13_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
