"""Main text of web pages by consensus host paths.

1. Each page's containers are scored by the text that lies directly in them (text in links does not
   count) and half of that of their child containers; ``article`` and ``main`` weigh more.
2. Containers have generalised paths: tag names and classes from the root, digits in classes
   dropped.  A path goes by a digest made from its parent's, so that deep pages hold no long paths.  The scores are
   votes, summed per host and path in Spark, and the best path of a host wins (ties: the one nearer to the root, then the
   smaller digest).
   The attributes of every element are read: one marked as noise hides its text and what lies in it, up to
   its end tag or, where that is left out, to where HTML closes it.
3. Every page is extracted again by its host's winning path; a page without that path falls back to its
   own best container.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.llm import text as tx

HOT = 1000  # a host with more than this part of all pages is dealt to several tasks (so there are at most as many)

# Elements by their role in HTML.
RAW = frozenset("script style textarea title noscript iframe xmp template select option".split())
CONTAINERS = frozenset("html body div article main section aside nav header footer form ul ol dl table tbody thead tr td th blockquote figure details center fieldset".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre hr address figcaption caption legend summary".split())
NOISE = frozenset("nav aside footer form button select option textarea noscript iframe object dialog menu head".split())
MAIN = frozenset(["article", "main"])
# Words in a class or id that mark what is not main text.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social "
    "related recommended comment comments disqus reply replies widget toolbar pagination pager skip".split()
)

COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search".split())
# How HTML closes elements whose end tags may be left out, and elements without content.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
LISTS = frozenset("ul ol dl menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# elements whose content is no markup
SKIPPED = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style textarea title noscript iframe xmp template select".split()}
# a tag whose attributes hold no < or >: looking for one ends at the next <
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*+)(?=[\s/>])((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_STOP = re.compile(r"[>\"']")
_NAME_END = re.compile(r"[\s/>]")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Za-z]+")


def _read(tag: str, attrs: str, words_count: frozenset = NOISE_WORDS) -> tuple[bool, str]:
    """Whether the attributes mark noise, and the class part of a path."""
    cls, noise = "", False
    for m in _ATTR.finditer(attrs or ""):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id"):
            words = {w.lower() for w in _WORDS.findall(value)}
            noise = noise or not words_count.isdisjoint(words)
            if name == "class":
                cls = "." + ".".join(sorted(words)) if words else ""
        elif name == "role":
            noise = noise or value.lower() in ROLES
        else:
            noise = noise or name == "hidden" or (name == "aria-hidden" and value.lower() == "true")
    return noise, cls


def step(path: bytes, name: str) -> bytes:
    """Digest of a path that goes on by one element."""
    return hashlib.blake2b(path + name.encode(), digest_size=16).digest()


def digest(path: str) -> bytes:
    """Digest of a path written out, such as ``/root/body/div.x``."""
    out = b""
    for name in path.split("/")[1:]:
        out = step(out, name)
    return out


class _Tags:
    """The markup of a page, met in order: each part is (start, end, tag or None, whether it is an end tag,
    attributes).  Every search that can fail remembers how far it has failed, so the time is linear in the page."""

    def __init__(self, page: str):
        self.page = page
        self.dead: set[int] = set()  # marks from which no > outside quotes follows
        self.none: set[str] = set()  # characters that do not come any more
        self.name_end = -1
        self.first = (0, -1)  # the first mark from one place on, and that place

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        got = self.page.find(what, at)
        if got < 0:
            self.none.add(what)
        return got

    def close(self, at: int) -> int:
        """Place of the first > outside quotes from ``at`` on, or -1."""
        page, seen = self.page, []
        if not self.first[0] <= at <= self.first[1]:
            self.first = (at, self._mark(at))
        stop = self.first[1]
        while stop < len(page) and stop not in self.dead:
            if page[stop] == ">":
                return stop
            seen.append(stop)
            at = self.find(page[stop], stop + 1) + 1
            if not at:
                break
            stop = self._mark(at)
        self.dead.update(seen)
        return -1

    def _mark(self, at: int) -> int:
        m = _STOP.search(self.page, at)
        return m.start() if m else len(self.page)

    def tag(self, at: int):
        """(end, name, whether it is an end tag, attributes) of the tag at ``at``, or None."""
        page = self.page
        m = _PLAIN.match(page, at)
        if m:
            return m.end(), m.group(2).lower(), bool(m.group(1)), m.group(3)
        first = at + 1 + page.startswith("/", at + 1)
        if not (page[first : first + 1].isascii() and page[first : first + 1].isalpha()):
            return None
        if self.name_end < first:
            found = _NAME_END.search(page, first) if "name" not in self.none else None
            if found is None:
                self.none.add("name")
                return None
            self.name_end = found.start()
        end = self.close(self.name_end)
        if end < 0:
            return None
        return end + 1, page[first : self.name_end].lower(), first > at + 1, page[self.name_end : end]

    def __iter__(self):
        page, pos = self.page, 0
        while True:
            at = self.find("<", pos)
            if at < 0:
                return
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
                yield at, end, None, False, None
                pos = end
                continue
            if page.startswith(("<!", "<?"), at):
                end = self.find(">", at + 2) + 1
                got = (end, None, False, None) if end else None
            else:
                got = self.tag(at)
            if got is None:
                pos = at + 1
                if page[pos : pos + 1] and (page[pos] in "/!?" or (page[pos].isascii() and page[pos].isalpha())) and self.find("<", pos) < 0:
                    yield at, len(page), None, False, None  # a tag that is cut off
                    return
                continue
            end, name, ending, attrs = got
            if name in SKIPPED and not ending:
                m = SKIPPED[name].search(page, end)
                yield at, m.end() if m else len(page), None, False, None
                pos = m.end() if m else len(page)
                continue
            yield at, end, name, ending, attrs
            pos = end


class _Node:
    __slots__ = ("parent", "tag", "path", "noise", "text", "links", "score", "depth", "lists", "inside")

    def __init__(self, parent, tag: str, attrs: str):
        self.parent, self.tag, self.text, self.links, self.score = parent, tag, 0, 0, 0.0
        self.depth = parent.depth + 1 if parent is not None else 0
        self.lists = (parent.lists if parent is not None else 0) + (tag in LISTS)
        nested = tag == "article" and parent is not None and parent.tag not in ("root", "html", "body")
        count = frozenset() if tag in ("html", "body") else NOISE_WORDS if tag not in MAIN else COMMENT_WORDS if nested else frozenset()
        noise, cls = _read(tag, attrs, count)
        self.inside = tag in MAIN or (parent is not None and parent.inside)
        if tag in NOISE or (tag == "header" and not (parent is not None and parent.inside)):
            noise = True
        self.noise = noise or (parent is not None and parent.noise)
        self.path = step(parent.path if parent is not None else b"", tag + cls)


class _Hush:
    """An element marked as noise that is no container; nothing in it is text."""

    __slots__ = ("tag", "at", "block", "opened")

    def __init__(self, tag: str, at: _Node, block: str | None):
        self.tag, self.at, self.opened = tag, at, 0
        self.block = block if tag not in BREAKS else None  # the block that an inline element lies in

    def start(self, tag: str, at: _Node) -> bool:
        """Whether the start of another element ends this one."""
        if tag in BREAKS and (self.tag == "p" or self.block == "p"):
            return True
        if tag in HEADINGS and self.tag in HEADINGS:
            return True
        if tag in ITEMS.get(self.block or self.tag, ()):
            return at.lists == self.at.lists
        self.opened += tag == self.tag
        return False

    def end(self, tag: str, at: _Node) -> bool:
        if tag == self.block or (tag == self.tag and tag in ITEMS):
            return at.lists == self.at.lists
        if tag == self.tag:
            self.opened -= 1
        return self.opened < 0


def parse(page: str):
    """(containers, blocks) of a page; a block is (container, its text pieces)."""
    root = _Node(None, "root", "")
    nodes, blocks, at, pieces, in_link = [root], [], root, [], 0
    hush, block = None, None

    def flush():
        nonlocal pieces
        if pieces:
            text = " ".join(entities.unescape("".join(p for p, _ in pieces)).split())
            if text:
                blocks.append((at, text))
                links = sum(len(p) for p, linked in pieces if linked)
                at.text += max(0, len(text) - links)
                at.links += links
            pieces = []

    pos, open_ = 0, {}
    for start, end, tag, ending, attrs in _Tags(page):
        if start > pos and hush is None:
            pieces.append((page[pos:start], in_link > 0))
        pos = end
        if tag is None:
            continue
        if ending:
            if hush is not None and hush.end(tag, at):
                hush = None
            if tag == block:
                block = None
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BREAKS:
                flush()
            if open_.get(tag):
                flush()
                while True:
                    closed, at = at, at.parent
                    open_[closed.tag] -= 1
                    if closed.tag == tag:
                        break
                block = None
                if hush is not None and at.depth < hush.at.depth:
                    hush = None
            continue
        if hush is not None and hush.start(tag, at):
            hush = None
        if tag == "br" or tag == "wbr":
            pieces.append((" " if tag == "br" else "", False))
        elif tag == "a":
            in_link = 1
        elif tag in CONTAINERS or tag in NOISE:
            flush()
            in_link = 0
            at = _Node(at, tag, attrs)
            at.noise = at.noise or hush is not None
            open_[tag] = open_.get(tag, 0) + 1
            nodes.append(at)
            block = None
        elif tag in BREAKS:
            flush()
            in_link = 0
            block = tag
        if hush is None and attrs and tag not in CONTAINERS and tag not in NOISE and tag not in VOID and _read(tag, attrs)[0]:
            hush = _Hush(tag, at, block)
    if pos < len(page) and hush is None:
        pieces.append((page[pos:], in_link > 0))
    flush()
    return nodes, blocks


def votes(nodes) -> dict[tuple[int, bytes], float]:
    """Score of each path (depth, digest) of a page's containers."""
    for n in nodes:
        if not n.noise:
            own = float(n.text)
            n.score += own
            if n.parent is not None:
                n.parent.score += own / 2
    out: dict[tuple[int, bytes], float] = {}
    for n in nodes:
        if not n.noise and n.score > 0:
            key = (n.depth, n.path)
            out[key] = out.get(key, 0.0) + n.score * (3 if n.tag in MAIN else 1)
    return out


def best(scores: dict[tuple[int, bytes], float]) -> bytes | None:
    return min(scores, key=lambda p: (-scores[p], p))[1] if scores else None


def extract(nodes, blocks, path: bytes | None) -> str:
    """Blocks that lie under the containers of ``path`` and not in noise, in page order."""
    inside: dict[int, bool] = {}
    for n in nodes:  # parents come before children
        inside[id(n)] = n.path == path or (n.parent is not None and inside[id(n.parent)])
    return "\n".join(text for at, text in blocks if inside[id(at)] and not at.noise)


def _score(it):
    for batch in it:
        for s in tx.slices(batch, "html"):
            host, depth, path, score = [], [], [], []
            for h, page in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
                for (d, p), v in votes(parse(page or "")[0]).items():
                    host.append(h)
                    depth.append(d)
                    path.append(p)
                    score.append(round(v))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(depth, pa.int64()), pa.array(path, pa.binary()), pa.array(score, pa.int64())], ["host", "depth", "path", "votes"])


def _extract(keep: list[str]):
    def run(it):
        for batch in it:
            for s in tx.slices(batch, "html"):
                get = lambda c, s=s: s.column(s.schema.get_field_index(c))
                out = []
                for page, path in zip(get("html").to_pylist(), get("winner").to_pylist(), strict=True):
                    nodes, blocks = parse(page or "")
                    if path is None or all(n.path != path or n.noise for n in nodes):
                        path = best(votes(nodes))
                    out.append(extract(nodes, blocks, path))
                yield pa.RecordBatch.from_arrays([*map(get, keep), pa.array(out, pa.string())], [*keep, "text"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` but ``html``, and ``text``, the main text of each page (columns of that name are
    replaced).  Blocks are joined by a line feed, white space inside a block is one space, character
    references are decoded.  Null or empty html gives an empty text; pages without a usable url share
    one host.  Every row is extracted, repeated ones alike.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))
    own = [c for c in pages.columns if c not in ("html", "text")]
    rest = (F.struct(*own) if own else F.lit(None).cast("int")).alias("rest")
    base = pages.select(host.alias("host"), F.col("html").cast("string").alias("html"), rest)
    scored = base.select("host", "html").transform(tx.arrow, _score, "host string, depth long, path binary, votes long")
    scored = scored.groupBy("host", "depth", "path").agg(F.sum("votes").alias("votes"))
    winners = scored.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "depth", "path"))["path"].alias("winner"))
    # the pages of a host that holds more than a HOT-th of all are dealt to parts of that size; at most HOT hosts are such
    sizes = base.groupBy("host").count()
    part = max(1, (sizes.agg(F.sum("count")).first()[0] or 0) // HOT)
    hot = F.broadcast(sizes.where(F.col("count") > part).select("host", F.ceil(F.col("count") / part).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    winners = winners.join(hot, "host", "left").select("host", "winner", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    salted = base.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("html"), parts).cast("int"))
    found = salted.join(winners, ["host", "salt"], "left").select("rest", "html", "winner")
    kind = tx.extended(base.select("rest").schema, text="string")
    out = found.transform(tx.arrow, _extract(["rest"]), kind)
    return out.select(*[F.col("rest").getField(c).alias(c) for c in own], "text")
