"""Main text of web pages by site template removal.

Each page is read once, as a tree. The subtrees of its block elements are hashed from the
leaves up (an element's name, then its texts and the hashes of its children), the hashes
are counted over the distinct pages of each host in Spark, and subtrees that recur on many
pages of the host are deleted. So are slots: elements whose kind, role, class or id names
furniture (``nav``, ``sidebar-box``) and that many pages of the host have, whatever is in them.

What the counts leave is freed from furniture that is marked as such beyond doubt: elements of a kind
(navigation, headers, footers, asides, forms, scripts), with a role, hidden, or with a class
that can mean nothing else (``advert``, ``comments``). Other words in a class or id decide
alone only where a host has too few pages to count, and never inside of an article: there
they need a second sign, that half of the element's text or more is links. Where a page
marks its article, only the article counts, and of it only containers, never its paragraphs
and headings, may be deleted as templates: a passage that many articles quote stays.
Comments, teasers and articles of which nothing is left do not mark a page's article.

Null and empty pages have an empty text; an empty table gives an empty table. Pages of any
length and depth are read whole, in time proportional to their length, whether tags and
quotes are closed or not. Repeated pages count once for their host and have equal texts. A
null url is a host of its own name "". Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import accumulate

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, cut

#: A subtree recurs if so many distinct pages of its host have it, and such a share of them.
MIN_PAGES, MIN_SHARE = 5, 0.1
#: Templates (16 bytes and the host's name each) that may be broadcast; more are joined to the pages by a shuffle.
BROADCAST_TEMPLATES = 200_000

#: A comment, a declaration, or a tag. Quotes count after an equals sign only; a tag of the last kind has quotes that never close and ends at the first >.
COMMENT, NAME = r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", r"<(/?)([A-Za-z][A-Za-z0-9:-]*)"
PLAIN = re.compile(rf"{COMMENT}|{NAME}([^>]*)>", re.S)
TOKEN = re.compile(rf"{COMMENT}|{NAME}((?:[^\"'>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>|{NAME}([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th".split())
LANDMARKS = frozenset(("article", "main"))
#: Classes of article elements that are readers' comments, and of those that lead to other pages.
COMMENTS = frozenset(("comment", "comments", "reply"))
TEASERS = frozenset(("teaser", "teasers", "related", "recommended"))
ROOTS = frozenset(("html", "body", "article", "main"))
FURNITURE = frozenset("head nav footer aside form button select menu dialog search label option fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Classes and ids that name furniture by themselves, and words that may name it.
CERTAIN = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo sidebar navbar breadcrumb breadcrumbs cookie cookies consent gdpr popup modal overlay newsletter subscribe comments disqus replies masthead pagination pager".split())
HINTS = CERTAIN | frozenset("promotion banner menu nav navigation notice notification signup login search comment respond reactions share sharing social related recommended footer widget toolbar copyright".split())
#: Share of links in the text of an element that is the second sign inside of an article.
LINKS = 0.5
#: An end tag that may be left out: what starts ends what is open.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_SCOPE = frozenset("ul ol menu dl table tbody thead tfoot select".split())
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Element:
    __slots__ = ("at_chars", "at_links", "digest", "drop", "first", "hinted", "in_article", "name", "protected", "slot")

    def __init__(self, name, drop, in_article, first, hinted, slot, page):
        self.name, self.drop, self.in_article, self.first, self.hinted, self.slot = name, drop, in_article, first, hinted, slot
        self.protected = name in ROOTS or in_article and name in PARAGRAPHS
        self.digest = xxhash.xxh64(name.encode())
        self.at_chars, self.at_links = page.chars, page.link_chars


def attributes_of(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def judged(name: str, own: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """(the element is furniture, words of its class or id hint at furniture)."""
    if name in ROOTS:
        return False, False
    if name in FURNITURE or name == "header" and not in_article:
        return True, False
    if not own:
        return False, False
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").lower().replace(" ", "") or own.get("role", "").lower() in ROLES:
        return True, False
    names = own.get("class", "").split() + own.get("id", "").split()
    if any(n.lower() in CERTAIN for n in names):
        return True, False
    words = {w.lower() for n in names for w in WORDS(CAMEL(r"\1 \2", n))}
    return False, bool(words & HINTS) or "header" in words and not in_article


WORDS, CAMEL = re.compile(r"[A-Za-z0-9]+").findall, re.compile(r"([a-z])([A-Z])").sub


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Page:
    """The blocks of text of a page in order, and the subtrees and slots that may be a template's."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.dropped: list[bool] = []
        self.inside: list[bool] = []  # of an article
        self.subtrees: list[tuple[int, int, int]] = []  # hash, first block, block after the last
        self.slots: list[tuple[int, int, int]] = []
        self.linked: list[tuple[int, int]] = []  # blocks of hinted elements in an article that are links above all
        self.stack: list[Element] = []
        self.open: list[dict[str, int]] = [{}]  # open elements by name, inside of each list or table
        self.every: dict[str, int] = {}
        self.text: list[str] = []
        self.chars = self.link_chars = 0
        self.in_link = False
        self.read(html)
        for first, end in self.linked:
            self.dropped[first:end] = [True] * (end - first)

    def say(self, text: str) -> None:
        if text:
            self.text.append(text)
            n = len(text) if text.isalnum() else len("".join(text.split()))
            self.chars += n
            if self.in_link:
                self.link_chars += n

    def flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            self.text.clear()
            if text:
                top = self.stack[-1] if self.stack else None
                self.texts.append(text)
                self.dropped.append(bool(top and top.drop))
                self.inside.append(bool(top and top.in_article))
                if top:
                    top.digest.update(text.encode(errors="replace") + b"\0")

    def pop(self) -> None:
        self.flush()
        element = self.stack.pop()
        self.every[element.name] -= 1
        if element.name in LIST_SCOPE:
            self.open.pop()
        self.open[-1][element.name] -= 1
        value, end = element.digest.intdigest(), len(self.texts)
        if self.stack:
            self.stack[-1].digest.update(value.to_bytes(8, "little"))
        if end == element.first or element.drop and self.stack and self.stack[-1].drop:
            return
        if not element.protected:
            self.subtrees.append((signed(value), element.first, end))
        if element.slot:
            self.slots.append((element.slot, element.first, end))
        elif element.hinted and self.link_chars - element.at_links >= LINKS * (self.chars - element.at_chars) and not (self.linked and self.linked[-1][0] <= element.first < self.linked[-1][1]):
            while self.linked and self.linked[-1][0] >= element.first:
                self.linked.pop()  # those inside
            self.linked.append((element.first, end))

    def close(self, names, scoped: bool = False) -> None:
        """End the innermost open element of these names, and all within; if scoped, not beyond the innermost list or table."""
        there = self.open[-1] if scoped else self.every
        if any(there.get(name) for name in names):
            while True:
                name = self.stack[-1].name
                self.pop()
                if name in names:
                    return

    def start(self, name: str, attributes: str) -> None:
        self.flush()
        if name in CLOSES:
            self.close(CLOSES[name], True)
        elif self.stack and self.stack[-1].name == "p":
            self.pop()
        parent = self.stack[-1] if self.stack else None
        own = attributes_of(attributes)
        classes = set(own.get("class", "").lower().split()) if name == "article" else set()
        in_article = name in LANDMARKS and not classes & (COMMENTS | TEASERS) or bool(parent and parent.in_article)
        furniture, hinted = judged(name, own, in_article)
        drop = bool(parent and parent.drop) or bool(classes & COMMENTS) or furniture
        slot = signed(xxhash.xxh64_intdigest(f"{name} {own.get('class', '')} {own.get('id', '')}".encode(errors="replace"), seed=1)) if furniture or hinted and not in_article else 0
        self.stack.append(Element(name, drop, in_article, len(self.texts), hinted, slot, self))
        self.open[-1][name] = self.open[-1].get(name, 0) + 1
        self.every[name] = self.every.get(name, 0) + 1
        if name in LIST_SCOPE:
            self.open.append({})

    def read(self, html: str) -> None:
        at, last = 0, html.rfind(">") + 1  # beyond, no tag can end
        lower = None
        search = TOKEN.search
        while True:
            m = search(html, at, last) if at < last else None
            if m is None:
                comment = html.find("<!--", max(at, last))
                self.say(html[at : comment if comment >= 0 else len(html)])
                break
            if m.start() > at:
                self.say(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None and m.re is TOKEN and m[5]:
                search = PLAIN.search  # quotes run to the end from here: they are ignored in what follows
                end, name, attributes = m[4], m[5], m[6]
            elif name is not None:
                end, attributes = m[1], m[3]
            else:
                if at == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
                    break  # never ends
                continue
            name = name.lower()
            if end:
                if name == "a":
                    self.in_link = False
                elif name in BLOCK:
                    self.flush()
                    self.close((name,))
                continue
            if name in RAW:
                if not attributes.endswith("/"):
                    lower = lower if lower is not None else ascii_lower(html)
                    close = lower.find(f"</{name}", at)
                    stop = html.find(">", close) if close >= 0 else -1
                    at = stop + 1 if stop >= 0 else len(html)
            elif name == "hr":
                self.flush()
            elif name in BLOCK:
                self.start(name, attributes)
            elif name == "br":
                self.text.append(" ")
            elif name == "a":
                self.in_link = True
        self.flush()
        while self.stack:
            self.pop()

    def main_text(self, deleted=frozenset()) -> str:
        flags = [drop + 2 * inside for drop, inside in zip(self.dropped, self.inside, strict=True)]
        found = [*self.subtrees, *self.slots]
        return main_text(self.texts, flags, [h for h, _, _ in found], [x for _, *span in found for x in span], deleted)


def main_text(texts: list[str], flags: list[int], hashes: list[int], spans: list[int], deleted) -> str:
    """The text of the blocks that are left. flags: 1 for furniture, 2 in an article; spans: first block and block after the last of each hash."""
    depth = [0] * (len(texts) + 1)
    for k, value in enumerate(hashes):
        if value in deleted:
            depth[spans[2 * k]] += 1
            depth[spans[2 * k + 1]] -= 1
    left = [not flag & 1 and not d for flag, d in zip(flags, accumulate(depth))]
    article = any(keep and flag & 2 for keep, flag in zip(left, flags))
    return "\n".join([text for text, keep, flag in zip(texts, left, flags) if keep and (flag & 2 or not article)])


UPPER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """A-Z in lower case; keeps all offsets."""
    return text.translate(UPPER)


def sources(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    html = F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    url = F.col(url_column).cast("string")
    return pages.select(F.col(id_column).cast("bigint").alias("page_id"), url.alias("url"), html.alias("html"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)).alias("host"), F.md5(html).alias("digest"))


PARSED = (("page_id", "bigint"), ("url", "string"), ("host", "string"), ("digest", "string"), ("texts", "array<string>"), ("flags", "array<int>"), ("hashes", "array<bigint>"), ("spans", "array<int>"), ("n_subtrees", "int"))


def parsed_pages(source: DataFrame) -> DataFrame:
    """Every page read once: its blocks, and the hashes of its subtrees, then of its slots, with the blocks that they span."""

    def make():
        def block(columns):
            rows = []
            for html in columns[2]:
                page = Page(html)
                found = [*page.subtrees, *page.slots]
                rows.append((page.texts, [d + 2 * i for d, i in zip(page.dropped, page.inside, strict=True)], [h for h, _, _ in found], [x for _, *span in found for x in span], len(page.subtrees)))
            parts = list(map(list, zip(*rows, strict=True))) if rows else [[]] * 5
            return [columns[0], columns[1], columns[3], columns[4], *parts]

        return block

    return arrow_map(source.select("page_id", "url", "html", "host", "digest"), make, PARSED, rows=64)


def hashes_of(parsed: DataFrame) -> DataFrame:
    """host, digest, hash and slot (whether it is one of a slot) of every distinct page of each host."""
    n, size = F.col("n_subtrees"), F.size("hashes")

    def marked(own, slot: bool):
        return F.transform(F.array_distinct(own), lambda h: F.struct(h.alias("hash"), F.lit(slot).alias("slot")))

    found = F.concat(marked(F.slice("hashes", F.lit(1), n), False), marked(F.slice("hashes", n + 1, size - n), True))
    return cut(parsed.select("host", "digest", found.alias("found")).dropDuplicates(["host", "digest"]))


def templates_of(distinct: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """host and the hashes of the subtrees and slots that recur on it; on a host of fewer than min_pages pages, all its slots.

    Counts are partial aggregations, so a host with most of the pages leaves each task
    as one row per subtree.
    """
    sizes = distinct.groupBy("host").agg(F.count("*").alias("of"))
    counted = distinct.select("host", F.inline("found")).groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("slot").alias("slot"))
    recurs = (F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("of")) | F.col("slot") & (F.col("of") < min_pages)
    return counted.where((F.col("n") >= min_pages) | F.col("slot")).join(sizes, "host").where(recurs).select("host", "hash")


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars and n_deleted (subtrees and slots deleted by counts) of every row."""
    spark = pages.sparkSession
    parsed = cut(parsed_pages(sources(pages, id_column, url_column, html_column)))
    distinct = hashes_of(parsed)
    templates = cut(templates_of(distinct, min_pages, min_share))
    shared = None
    if templates.count() <= broadcast_templates:
        by_host: dict[str, set[int]] = {}
        for row in templates.collect():
            by_host.setdefault(row.host, set()).add(row.hash)
        shared = spark.sparkContext.broadcast(by_host)
        source = parsed.withColumn("deleted", F.lit(None).cast("array<bigint>"))
    else:
        # Each page's own list, joined by a shuffle, which can be split where a page has many copies.
        lists = cut(distinct.select("host", "digest", F.inline("found")).join(templates, ["host", "hash"]).groupBy("host", "digest").agg(F.collect_list("hash").alias("deleted")))
        source = parsed.join(lists.hint("merge"), ["host", "digest"], "left")

    def make():
        known = shared.value if shared is not None else None

        def block(columns):
            ids, urls, hosts, texts, flags, hashes, spans, lists = columns
            deleted = [known.get(h, ()) for h in hosts] if known is not None else [frozenset(d or ()) for d in lists]
            found = [main_text(*row) for row in zip(texts, flags, hashes, spans, deleted, strict=True)]
            return [ids, urls, found, [len(t) for t in found], [sum(h in d for h in own) for own, d in zip(hashes, deleted, strict=True)]]

        return block

    schema = [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint"), ("n_deleted", "bigint")]
    return arrow_map(source.select("page_id", "url", "host", "texts", "flags", "hashes", "spans", "deleted"), make, schema, rows=256)
