"""Main text of web pages by consensus host paths.

Every page is read into its elements by one tolerant scan of the markup. A container (article, main, section, div, table
cell, body) scores by the clean text below it, less the noise below it: text in links, and in elements that by tag, role or class are
menus, headers, footers, sidebars, notices, adverts, forms or reader comments. Its path is the chain of its ancestors' tags and classes,
with runs of digits made alike, so that pages of one template agree. Spark adds up the shares that paths win on the pages of
a host (partial sums first, so one host may hold any share of the pages) and the path with the largest sum is the consensus of
the host. Pages are then read again and give the clean blocks below the elements on that path; a page without such an element, or
with no clean text in it, falls back on its own best container.

The winners are one short row per host. They are broadcast only when their counted size is below ``broadcast_bytes``; above
it they meet the pages in a join that splits skewed hosts.

Defined cases
* null or empty html, and pages without clean text: empty text, 0 characters. A null url, or one without a host, takes part
  in no vote: such a page uses its own best container. Repeated ids and rows are all returned; null ids stay null.
* white space is what Unicode calls so, and a line break element counts as white space. Unclosed paragraphs, list items and
  cells end where the next one begins; stray end tags are ignored; an unfinished tag at the end of a page is dropped.
* an undecodable character reference stays as it stands. Equal votes: the path first in letter order.
* :func:`extract` keeps the other columns unless they are named like a new one (text, n_chars, path); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center div main section td".split())
NOISE_TAG = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe label menu nav noscript object select svg template video".split()
)
NOISE_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar tooltip".split())
NOISE_WORD = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot alert alerts aside banner breadcrumb breadcrumbs captcha comment comments consent"
    " cookie cookies copyright disclaimer discussion disqus dropdown footer gdpr legal login masthead menu modal nav navbar navigation newsletter"
    " notice notices notification notifications overlay pager pagination paywall popup promo promoted promotion rail recommended register related reply replies respond"
    " search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
PAIRED = {("side", "bar"), ("call", "action"), ("sign", "up"), ("log", "in"), ("read", "more"), ("bread", "crumb"), ("site", "header"), ("page", "header"), ("top", "header"), ("main", "header"), ("global", "header")}
NEGATED = frozenset("has is no not with without".split())  # "has-sidebar" names a page, not a sidebar
PLAIN = frozenset("html body main article h1".split())  # never noise by class alone
ENDS_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist")}
SIBLINGS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
ENDS_PARAGRAPH = BLOCK - {"html", "body", "caption", "legend", "summary", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
DEPTH = 32  # longer chains of blocks are named by a digest
HINT = frozenset("article body content entry main post story text".split())


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def is_noise(tag: str, found: dict[str, str], inside_text: bool) -> bool:
    """Menu, header, footer, sidebar, notice, advert, form or reader comment, by tag, role, visibility or class."""
    if tag in NOISE_TAG or found.get("role", "").lower() in NOISE_ROLE:
        return True
    if tag == "header" and not inside_text:  # the head of an article carries its title
        return True
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if tag in PLAIN:
        return False
    for name in (*found.get("class", "").split(), found.get("id", "")):
        words = [w.lower() for w in WORDS.findall(name)]
        if any(w in NOISE_WORD and b not in NEGATED for b, w in zip(["", *words], words)) or not PAIRED.isdisjoint(zip(words, words[1:])):
            return True
        if words == ["header"] and not inside_text:
            return True
    return False


def label(tag: str, found: dict[str, str]) -> str:
    """Tag and classes of one element, digits made alike."""
    names = [re.sub(r"\d+", "#", c) for c in found.get("class", "").split()]
    return ".".join([tag, *sorted(set(names))]) + ("@" + re.sub(r"\d+", "#", found["id"]) if found.get("id") else "")


class Page:
    """Elements and text blocks of one page: parents before children, blocks in page order."""

    def __init__(self, html: str):
        self.tags, self.parents, self.noise, self.hints = ["body"], [-1], [False], [False]
        self.blocks: list[tuple[int, str, int, bool]] = []  # owner, text, characters in links, noise
        self.muted: list[tuple[int, int]] = []  # owner and length of noise inside a line
        self._buffer: list[str] = []
        self.paths, self.depths = ["body"], [0]
        self._owners = [0]  # the innermost block element at or above each element
        self._opened = Counter({"body": 1})  # open elements by tag
        self._links, self._scan = 0, [0]
        self._read(html)

    def _owner(self) -> int:
        return self._owners[self._scan[-1]]

    def _flush(self) -> None:
        if not self._buffer:
            return
        text = " ".join("".join(self._buffer).split())
        if text:
            owner = self._owner()
            self.blocks.append((owner, text, self._links, self.noise[owner]))
        self._buffer, self._links = [], 0

    def _close_to(self, depth: int) -> None:
        if any(self.tags[e] in BLOCK for e in self._scan[depth:]):
            self._flush()
        self._opened.subtract(self.tags[e] for e in self._scan[depth:])
        del self._scan[depth:]

    def _open(self, tag: str, raw: str) -> None:
        scan = self._scan
        if tag in ENDS_PARAGRAPH:
            for d in range(len(scan) - 1, 0, -1):
                if self.tags[scan[d]] == "p":
                    self._close_to(d)
                    break
                if self.tags[scan[d]] in ENDS_PARAGRAPH or self.tags[scan[d]] in ("td", "th"):
                    break
        if tag in ENDS_ITSELF:
            for d in range(len(scan) - 1, 0, -1):
                if self.tags[scan[d]] in SIBLINGS.get(tag, (tag,)):
                    self._close_to(d)
                    break
                if self.tags[scan[d]] in ENDS_ITSELF[tag]:
                    break
        found = attributes(raw) if raw.strip(" \t\r\n/") else {}
        up = scan[-1]
        inside = self._opened["article"] + self._opened["main"] > 0
        noisy = self.noise[up] or is_noise(tag, found, inside)
        if tag in BLOCK:
            self._flush()
        self.tags.append(tag)
        self.parents.append(up)
        self.noise.append(noisy)
        self._opened[tag] += 1
        if tag in BLOCK:
            chain = f"{self.paths[up]}/{label(tag, found)}"
            self._owners.append(len(self.tags) - 1)
            self.depths.append(self.depths[up] + 1)
            self.paths.append(chain if self.depths[up] < DEPTH else "#" + md5(chain.encode(errors="replace")).hexdigest())
        else:
            self._owners.append(self._owners[up])
            self.depths.append(self.depths[up])
            self.paths.append(self.paths[up])
        self.hints.append(tag in ("article", "main") or found.get("role") == "main" or "articlebody" in found.get("itemprop", "").lower()
                          or (tag in CONTAINER and not HINT.isdisjoint(w.lower() for w in WORDS.findall(found.get("class", "") + " " + found.get("id", "")))))
        scan.append(len(self.tags) - 1)

    def _read(self, html: str) -> None:
        at, n, scan = 0, len(html), self._scan
        while at < n:
            m = TOKEN.search(html, at)
            end = m.start() if m else n
            if end > at:
                text = unescape(html[at:end])
                if self.noise[scan[-1]] and not self.noise[self._owner()]:
                    self.muted.append((self._owner(), len(text.strip())))
                else:
                    self._buffer.append(text)
                    if self._opened["a"]:
                        self._links += len(text.strip())
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None or m[0][-1] != ">":
                continue
            tag = tag.lower()
            if m[1]:
                if tag in ("html", "body") or not self._opened[tag]:
                    continue
                for d in range(len(scan) - 1, 0, -1):
                    if self.tags[scan[d]] == tag:
                        self._close_to(d)
                        break
                    if self.tags[scan[d]] in ("td", "th", "table") and tag not in BLOCK:
                        break
                continue
            if tag == "br":
                self._buffer.append(" ")
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = n if close is None else html.find(">", close.end()) + 1 or n
            elif tag == "body":
                for d in range(len(scan) - 1, 0, -1):
                    if self.tags[scan[d]] == "head":
                        self._close_to(d)
                        break
            elif tag == "hr":
                self._flush()
            elif tag != "html" and tag not in VOID:
                if tag in BLOCK and len(scan) > 1 and self.tags[scan[1]] == "head":  # a head that was never closed
                    self._close_to(1)
                self._open(tag, m[3])
        self._flush()

    def scores(self) -> dict[int, float]:
        """Clean text below each container less twice the noise below it; a quarter more, less half the noise, where tag or class says text."""
        clean, dirty = [0] * len(self.tags), [0] * len(self.tags)
        for owner, text, links, noise in self.blocks:
            clean[owner] += 0 if noise else len(text) - min(links, len(text))
            dirty[owner] += len(text) if noise else min(links, len(text))
        for owner, size in self.muted:
            dirty[owner] += size
        for e in range(len(self.tags) - 1, 0, -1):
            clean[self.parents[e]] += clean[e]
            dirty[self.parents[e]] += dirty[e]
        out = {}
        for e, tag in enumerate(self.tags):
            if tag in CONTAINER and not self.noise[e] and clean[e]:
                score = clean[e] * 1.25 - dirty[e] / 2 if self.hints[e] else clean[e] - 2.0 * dirty[e]
                if e == 0:
                    score *= 0.9  # the whole page is the last choice
                if score > 0:
                    out[e] = score
        return out

    def shares(self) -> dict[str, float]:
        """Share of the best score per path of this page's containers."""
        scores = self.scores()
        best = max(scores.values(), default=0.0)
        out: dict[str, float] = {}
        for e, s in scores.items():
            path = self.paths[e]
            out[path] = max(out.get(path, 0.0), s / best)
        return out

    def below(self, roots: set[int]) -> str:
        """Clean blocks below any of the elements, in page order, joined by line breaks."""
        inside = [False] * len(self.tags)
        for e in range(len(self.tags)):
            inside[e] = e in roots or (e > 0 and inside[self.parents[e]])
        return "\n".join(text for owner, text, _, noise in self.blocks if inside[owner] and not noise)

    def main_text(self, winner: str | None) -> tuple[str, str]:
        """Text and the path it came by."""
        if winner:
            text = self.below({e for e, tag in enumerate(self.tags) if tag in CONTAINER and not self.noise[e] and self.paths[e] == winner})
            if text:
                return text, winner
        scores = self.scores()
        best = max(scores, key=lambda e: (scores[e], -e), default=0)
        return self.below({best}), self.paths[best]


def host_column(url: Column) -> Column:
    """Lower-case host of a url, without port or user; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def path_votes(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Votes per host and path: host, path, votes, pages. Partial sums of each task meet per (host, path)."""
    rows = pages.select(host_column(F.col(url)).alias("host"), F.col(html).alias("html")).where("host IS NOT NULL AND html IS NOT NULL")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], list] = {}
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, share in Page(text).shares().items():
                    got = found.setdefault((host, path), [0, 0])
                    got[0] += round(share * 1000)
                    got[1] += 1
            hosts, paths = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), *(pa.array([v[i] for v in found.values()], pa.int64()) for i in (0, 1))], names=["host", "path", "votes", "pages"]
            )

    return rows.mapInArrow(vote, "host string, path string, votes bigint, pages bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"))


def consensus(votes: DataFrame) -> DataFrame:
    """The path with the most votes per host; the first in letter order of equal ones."""
    best = votes.groupBy("host", "votes").agg(F.min("path").alias("path")).groupBy("host").agg(F.max_by("path", "votes").alias("winner"))
    return best


def extract(pages: DataFrame, html: str = "html", url: str = "url", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """``pages`` with text, n_chars (code points) and path, the path the text came by; other columns but html are kept."""
    winners = written(consensus(path_votes(pages, html, url)).select(F.col("host").alias("__host"), F.col("winner").alias("__winner")))
    size = winners.agg(F.coalesce(F.sum(F.octet_length("__host") + F.octet_length("__winner") + 64), F.lit(0)).alias("b")).first()["b"]
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars", "path")]
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html}`").alias("__html"), host_column(F.col(f"`{url}`")).alias("__host"))
    joined = rows.join(F.broadcast(winners) if size <= broadcast_bytes else winners, "__host", "left").select(*(F.col(f"`{c}`") for c in keep), "__html", "__winner")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for batch in batches:
            texts, paths = [], []
            for raw, winner in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                text, path = Page(raw or "").main_text(winner)
                texts.append(text)
                paths.append(path)
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), counts, pa.array(paths, pa.string())], names=[*keep, "text", "n_chars", "path"])

    return joined.mapInArrow(read, ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "text string, n_chars bigint, path string"]))
