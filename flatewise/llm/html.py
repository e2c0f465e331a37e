"""Operator 4: main text of web pages by consensus host paths.

First pass, by page: the containers of a page are scored by the text of the blocks directly in them (links do not
count, half of it goes to the enclosing container) and vote with their share of the page's score.  A container is
named by its generalised path: tags and classes from the root, with digits in class names blanked.  The votes are
added for each (host, path) in Spark.  Second pass: every page is extracted again with the first of its host's
winning paths that it has; a page with none uses its own best container.  A container inside an article or main
stands for the whole of it; one without takes the text containers beside it along, so headings, leads, sibling
sections and ends stay.

Site parts (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are known by
tag, role or the words of class and id, and are left out inside containers too; a paragraph, heading or item is one only
if all words of a class or id say so.

The winners of a host are at most 100 numbers.  They reach the pages as a broadcast while the table of hosts is
within `BROADCAST_HOSTS`; beyond it both sides are joined by host and a salt, so a hot host is spread.

Defined cases: null html is empty; a page without text gives the empty text; a null url or one without "://" belongs
to the host ""; repeated rows each give a row; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatewise.llm.common import checkpoint

LEAST_SHARE = 0.01  # of a host's votes, for a path to win: at most 100 paths a host can
BROADCAST_HOSTS = 50_000
SALTS = 32

OPENING = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ENDS_TAG = re.compile(r"[>\"']")
RAW = frozenset("script style noscript template textarea title".split())
NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
# fixed values: HTML elements by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul option select".split()
)
CONTAINER = frozenset("article main section div td body html blockquote center".split())
DROPPED = frozenset(
    "nav footer aside form head iframe object embed svg canvas math button select option input dialog menu noscript audio video map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
SITE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation "
    "menu menus sidebar sidebars aside footer foot header masthead topbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification "
    "popup modal overlay comment comments disqus reply replies respond discussion share sharing social related recommended newsletter subscribe signup "
    "login search pagination pager toolbar widget widgets skip disclaimer alert".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption address".split())
GOOD_WORDS = frozenset("article content main post entry story text body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"option", "html", "body", "head"}
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def tags(source: str):
    """(begin, end, closing, name, attributes) of every tag, comment and raw element, from left to right.

    Comments, declarations and raw elements (scripts and the like, with their content) have no name.  One cursor runs
    over the page; a quote that is never closed is an ordinary character, and what looks like a tag but has no end
    runs to the end of the page, so no text is read more than a few times.
    """
    at, size, lower, quotes = 0, len(source), None, {q: source.rfind(q) for q in "\"'"}
    last, closers = source.rfind(">"), {}
    while True:
        begin = source.find("<", at)
        if begin < 0 or begin + 1 >= size:
            return
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            yield begin, at, "", "", ""
            continue
        found = OPENING.match(source, begin + 1)
        if not found and source[begin + 1] not in "!?/":
            at = begin + 1
            continue
        if last < begin:
            yield begin, size, "", "", ""
            return
        stop = found.end() if found else begin + 2
        end = stop
        while found:
            m = ENDS_TAG.search(source, end)
            if m is None:  # a quoted part swallowed the end: from here on quotes count for nothing
                quotes = dict.fromkeys(quotes, -1)
                end = source.find(">", stop)
                break
            end = m.start()
            if m[0] == ">":
                break
            if quotes[m[0]] > end:
                end = source.find(m[0], end + 1)
            end += 1
        if not found:
            end = source.find(">", stop)
        closing, name = (found[1], found[2].lower()) if found else ("", "")
        at = end + 1
        if name in RAW and not closing:
            lower = source.lower() if lower is None else lower  # of equal length where it matters: see below
            if closers.get(name, 0) >= 0:
                closers[name] = find_closer(source, lower, name, at)
            end = closers[name]
            at = source.find(">", end) + 1 if end >= 0 else size
            at = at or size
            yield begin, at, "", "", ""
            continue
        yield begin, at, closing, name, source[stop:end]


def find_closer(source: str, lower: str, name: str, at: int) -> int:
    """Position of the end tag of a raw element, or -1; lower case can be longer than its source."""
    if len(lower) == len(source):
        return lower.find(f"</{name}", at)
    found = re.compile(f"</{name}", re.I).search(source, at)
    return found.start() if found else -1


class Page:
    """Elements and text blocks of one page, found by a forgiving single scan.

    Element k has a parent (a smaller index), a tag, a generalised path (the hash of its parent's path and its own
    label; 0 for the page) and a flag for site parts.  A block is (element, text, characters inside links).
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.site = [-1], [""], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.bonus = [0.0]
        self.whole = [False]
        self.scan(source)

    def open(self, parent: int, tag: str, attributes: str) -> int:
        label, site, bonus = tag, self.site[parent], 0.0
        if tag in DROPPED:
            site = True
        elif tag == "header":
            above, inside = parent, False
            while above > 0 and not inside:
                inside = self.tag[above] in ("article", "main")
                above = self.parent[above]
            site = site or not inside
        if tag in ("article", "main"):
            bonus = 1.0
        if attributes:
            classes = ""
            for name, value in NAMES.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "role":
                    site = site or value.lower() in ROLES
                    bonus += 1.0 * (value.lower() in ("main", "article"))
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    site = site or name == "hidden" or tag in CONTAINER
                elif name in ("class", "id"):
                    words = {w.lower() for w in WORDS.findall(value)}
                    if tag in PARAGRAPHS:  # a paragraph's subject may be named like a site part; it is one if all words say so
                        site = site or any(w and w <= SITE_WORDS for w in ({x.lower() for x in WORDS.findall(v)} for v in value.split()))
                    elif words & SITE_WORDS and tag not in ("html", "body", "article", "main") or words & {"comment", "comments", "reply", "replies"}:
                        site = True
                    if words & GOOD_WORDS:
                        bonus = max(bonus, 0.5)
                    if name == "class":
                        classes = ".".join(sorted(re.sub(r"\d+", "#", value).split()))
            if classes:
                label = f"{tag}.{classes}"
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), self.path[parent]) >> 1)
        self.site.append(site)
        self.bonus.append(bonus)
        self.whole.append(bonus >= 1.0)
        return len(self.tag) - 1

    def scan(self, source: str) -> None:
        stack, links, at = [0], 0, 0
        opened: Counter = Counter()
        parts: list[str] = []
        linked = 0

        def flush():
            nonlocal linked
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    owner = stack[-1]
                    while self.tag[owner] not in BLOCK and owner:
                        owner = self.parent[owner]
                    self.blocks.append((owner, text, linked))
                parts.clear()
            linked = 0

        def close(k: int, stop: int | None = None):
            for e in stack[k:stop]:
                opened[self.tag[e]] -= 1
            del stack[k:stop]

        for begin, end, closing, tag, attributes in tags(source):
            if begin > at:
                chunk = source[at:begin]
                parts.append(chunk)
                if links:
                    linked += len(chunk)
            at = end
            if not tag:
                continue
            if closing:
                if tag not in BLOCK:
                    if tag == "a" and links:
                        links -= 1
                    for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                        if self.tag[stack[k]] == tag:
                            close(k, k + 1)
                            break
                        if self.tag[stack[k]] in BLOCK:
                            break
                    continue
                flush()
                for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if self.tag[stack[k]] == tag:
                        close(k)
                        links = 0
                        break
                    if tag == "p" and self.tag[stack[k]] in CONTAINER:
                        break
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    parts.append(" " if tag in ("br", "img", "wbr") and tag != "wbr" else "")
                continue
            if tag not in BLOCK:
                if tag == "a":
                    links += 1
                if tag in DROPPED:
                    flush()
                if attributes and not attributes.endswith("/") or tag in DROPPED:
                    stack.append(self.open(stack[-1], tag, attributes))
                    opened[tag] += 1
                continue
            flush()
            links = 0
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                    if self.tag[stack[k]] == "p":
                        close(k)
                        break
                    if self.tag[stack[k]] in BLOCK:
                        break
            if tag in SIBLING:
                same, border = SIBLING[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in border:
                        break
                    if self.tag[stack[k]] in same:
                        close(k)
                        break
            stack.append(self.open(stack[-1], tag, attributes))
            opened[tag] += 1
        if at < len(source):
            parts.append(source[at:])
        flush()

    def containers(self, k: int):
        """The container of element k and the one around it (0 or less: none)."""
        while k > 0 and self.tag[k] not in CONTAINER:
            k = self.parent[k]
        above = self.parent[k] if k > 0 else -1
        while above > 0 and self.tag[above] not in CONTAINER:
            above = self.parent[above]
        return k, above

    def scores(self) -> dict[int, float]:
        """Score of every container path of the page."""
        score: dict[int, float] = {}
        for owner, text, linked in self.blocks:
            if self.site[owner]:
                continue
            value = max(0, len(text) - 2 * linked) + 1.0
            k, above = self.containers(owner)
            score[k] = score.get(k, 0.0) + value
            if above > 0:
                score[above] = score.get(above, 0.0) + value / 2
        paths: dict[int, float] = {}
        for k, value in score.items():
            paths[self.path[k]] = paths.get(self.path[k], 0.0) + value * (1 + self.bonus[k])
        return paths

    def best(self) -> int | None:
        found = self.scores()
        return min(found, key=lambda p: (-found[p], p)) if found else None

    def widened(self, tops: set[int]) -> tuple[set[int], set[int]]:
        """The nearest article or main around each element; without one, the element and the containers beside it that
        hold text rather than links (a heading, a lead, an end of the article in boxes of their own), and the elements
        around both, whose own text counts too."""
        out, beside = set(), set()
        for k in tops:
            above = k
            while above > 0 and not self.whole[above]:
                above = self.parent[above]
            out.add(above or k)
            if not above:
                beside.add(self.parent[k])
        if beside:
            text, linked = Counter(), Counter()
            for owner, block, links in self.blocks:
                if not self.site[owner]:
                    k = owner
                    while k > 0 and self.parent[k] not in beside:
                        k = self.parent[k]
                    text[k] += len(block)
                    linked[k] += links
            out |= {k for k in text if k > 0 and 2 * linked[k] <= text[k]}
        return out, beside

    def text(self, path: int | None) -> str | None:
        """Blocks inside the elements of a path, widened, one a line; None if the page has no such element with text."""
        def spread(chosen):
            inside = [k in chosen for k in range(len(self.tag))]
            for k in range(1, len(self.tag)):
                inside[k] = inside[k] or inside[self.parent[k]]
            return inside

        if path is None:
            return None
        tops = {k for k in range(len(self.tag)) if self.path[k] == path}
        inside = spread(tops)
        if not any(inside[k] and not self.site[k] for k, _, _ in self.blocks):
            return None
        chosen, around = self.widened({k for k in tops if not self.site[k]})
        inside = spread(chosen)
        return "\n".join(text for k, text, linked in self.blocks if not self.site[k] and (inside[k] or k in around and 2 * linked <= len(text)))


def host_of(url: F.Column) -> F.Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def vote_batches(batches):
    """(host, path, vote) of each page's containers, added up for the batch before they are shuffled."""
    for batch in batches:
        votes: dict[tuple[str, int], float] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = Page(source or "").scores()
            total = sum(found.values())
            for path, score in found.items():
                votes[host, path] = votes.get((host, path), 0.0) + score / total
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.int64()), pa.array(votes.values(), pa.float64())],
            names=["host", "path", "vote"],
        )


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths with `LEAST_SHARE` of a host's votes or more, most voted first."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote_batches, "host string, path long, vote double")
    total = checkpoint(votes.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote")))
    whole = total.groupBy("host").agg(F.sum("vote").alias("whole"))
    top = total.join(whole, "host").where(F.col("vote") >= LEAST_SHARE * F.col("whole"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("vote")).alias("v"), "path")))
    return top.groupBy("host").agg(ranked.alias("ranked")).select("host", F.col("ranked.path").alias("paths"))


def extract(source: str | None, paths: list[int] | None) -> str:
    page = Page(source or "")
    for path in paths or []:
        found = page.text(path)
        if found is not None:
            return found
    return page.text(page.best()) or ""


def extract_batches(batches):
    for batch in batches:
        texts = [extract(source, paths) for source, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    winners = checkpoint(winning_paths(pages))
    rows = pages.withColumn("host", host_of(F.col("url")))
    if winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "paths").mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")
