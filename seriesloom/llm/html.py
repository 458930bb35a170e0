"""Main text of web pages, by container paths that a host's pages agree on.

Each page is read once into blocks of text with the path of the containers around
them. A container scores the text it holds less the text that looks like page
furniture. The best container of every page votes, weighted by its text, for its
generalised path (tags with classes, digits masked), and the path with most votes of
a host is used to extract all of its pages; a page without that path falls back on
its own best container.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never article text.
SKIPPED = frozenset(
    "head script style noscript template iframe object svg math canvas audio video map nav aside footer form "
    "button select option textarea label fieldset dialog menu".split()
)
CONTAINERS = frozenset("html body main article section div td th table tbody tr center blockquote details figure".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre address figcaption caption summary header hgroup thead tfoot hr title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class, id and role names that mark page furniture.
FURNITURE = frozenset(
    "nav navbar navigation menu sidebar footer ad ads adv advert advertisement advertising banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup social share sharing related recommended recommendation recommendations breadcrumb "
    "breadcrumbs pagination pager comment comments disqus respond replies reply login search widget toolbar toc "
    "skip masthead hidden paywall contentinfo complementary".split()
)
#: A class with one of these parts tells what a layout has, not what the element is.
MODIFIERS = frozenset("has no not with without layout".split())
#: Between the containers of a path; white space, so no class can hold it.
STEP = "\x1f"
_DIGITS = re.compile(r"\d+")


class _Page(HTMLParser):
    """Blocks of a page: (container path, text, furniture, characters inside links).

    Elements that are never article text are furniture for certain. A form, and an element
    whose names say so, is furniture unless it turns out to hold most of the page's plain
    text; an element marked by its names must also hold the page's heading or article.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, tuple, tuple]] = []  # tag, furniture, doubtful elements around it, path
        self.found: list[tuple[tuple, str, bool, tuple, int]] = []
        self.doubtful: list[bool] = []  # whether such an element is a form or holds a heading or article
        self.text: list[str] = []
        self.links = self.inside_links = 0

    @property
    def around(self) -> tuple[str, bool, tuple, tuple]:
        return self.stack[-1] if self.stack else ("", False, (), ())

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                _, furniture, doubts, path = self.around
                self.found.append((path, text, furniture, doubts, self.links))
            self.text, self.links = [], 0

    def blocks(self) -> list[tuple[tuple, str, bool, int]]:
        total, held = 0, [0] * len(self.doubtful)
        for _, text, furniture, doubts, links in self.found:
            plain = 0 if furniture else max(0, len(text) - links)
            total += plain
            for d in doubts:
                held[d] += plain
        cleared = [may and 2 * own > total for may, own in zip(self.doubtful, held, strict=True)]
        return [
            (path, text, furniture or not all(cleared[d] for d in doubts), links)
            for path, text, furniture, doubts, links in self.found
        ]

    def pop(self, to: int) -> None:
        if any(tag in BLOCKS or tag in SKIPPED for tag, *_ in self.stack[to:]):
            self.flush()
        for tag, *_ in self.stack[to:]:
            self.inside_links -= tag == "a"
        del self.stack[to:]

    def close_open(self, tags: tuple[str, ...]) -> None:
        """Close an element that the new one ends implicitly, unless a container stands between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                self.pop(i)
                return
            if self.stack[i][0] in CONTAINERS or self.stack[i][0] in ("ul", "ol", "dl"):
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            if tag != "title":
                self.close_open(("p", *HEADINGS))
            if tag in ("li", "dt", "dd"):
                self.close_open(("li",) if tag == "li" else ("dt", "dd"))
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, furniture, doubts, path = self.around
        names = dict(attrs)
        marks = " ".join(filter(None, (names.get("class"), names.get("id"), names.get("role"))))
        inner = any(t in ("article", "main") for t, *_ in self.stack)
        furniture = (
            furniture
            or (tag in SKIPPED and tag != "form")
            or "hidden" in names
            or names.get("aria-hidden") == "true"
            or re.search(r"display\s*:\s*none", names.get("style") or "") is not None
            or (tag == "header" and not inner)
        )
        if not furniture and tag not in ("html", "body", "article", "main"):
            parts = self.parts(marks)
            if tag == "form" or parts & FURNITURE or (tag in ("div", "section") and not inner and "header" in parts):
                doubts = (*doubts, len(self.doubtful))
                self.doubtful.append(tag == "form")
        if tag in ("h1", "main") or (tag == "article" and not self.parts(marks) & FURNITURE):
            for d in doubts:
                self.doubtful[d] = True
        if tag in CONTAINERS:
            classes = ".".join(sorted({_DIGITS.sub("#", c.lower()) for c in (names.get("class") or "").split()}))
            path = (*path, f"{tag}.{classes}" if classes else tag)
        self.inside_links += tag == "a"
        self.stack.append((tag, furniture, doubts, path))

    @staticmethod
    def parts(marks: str) -> set[str]:
        """Lower-cased parts of all names but those with a modifier."""
        found: set[str] = set()
        for name in marks.split():
            own = {part.lower() for part in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", name)}
            if not own & MODIFIERS:
                found |= own
        return found

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop(i)
                return
            if self.stack[i][0] in CONTAINERS and tag not in CONTAINERS and tag not in SKIPPED:
                return  # an inline or paragraph end does not close containers

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "use", "circle", "rect"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.inside_links:
            self.links += len(data.strip())


def page_blocks(html: str | None) -> list[tuple[tuple, str, bool, int]]:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    return page.blocks()


def best_container(blocks: list[tuple[tuple, str, bool, int]]) -> tuple[tuple, float]:
    """Path of the container with the best score: its article text less half its other text;
    of equal ones the deepest, then the first in name order."""
    scores: dict[tuple, float] = {}
    for path, text, furniture, links in blocks:
        plain = len(text) - min(links, len(text))
        value = -0.5 * len(text) if furniture else plain - 0.5 * (len(text) - plain)
        for i in range(1, len(path) + 1):
            scores[path[:i]] = scores.get(path[:i], 0.0) + value
    if not scores:
        return (), 0.0
    path = min(scores, key=lambda p: (-scores[p], -len(p), p))
    return path, scores[path]


def main_text(blocks: list[tuple[tuple, str, bool, int]], path: tuple) -> str:
    n = len(path)
    return "\n".join(text for own, text, furniture, _ in blocks if not furniture and own[:n] == path)


def host_column(url):
    """Lower-cased host of a URL; null and host-less URLs share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extract_main_text(pages: DataFrame, *, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, ``text`` and ``n_chars`` (code points) of every page.

    A null or empty page, or one without article text, has an empty text. Pages
    without a host vote together. Tied paths: the longest, then the first in name
    order. Repeated rows vote as often as they occur and are each returned; further
    columns are ignored; an empty table gives an empty result.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, weights = [], []
            for page in batch.column(1):
                path, score = best_container(page_blocks(page.as_py()))
                paths.append(STEP.join(path))
                weights.append(math.log1p(max(score, 0.0)))
            yield pa.record_batch(
                [batch.column(0), pa.array(paths, pa.string()), pa.array(weights, pa.float64())], names=["host", "path", "weight"]
            )

    tagged = pages.select(id_column, url, html).withColumn("__host", host_column(F.col(url)))
    votes = tagged.select("__host", html).mapInArrow(vote, "host string, path string, weight double")
    # Votes are summed in thousandths, as whole numbers, so that their order does not matter.
    tally = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("weight") * 1000).cast("long")).alias("votes"))
    winners = materialise(
        tally.where("votes > 0").groupBy("host").agg(
            F.max_by("path", F.struct("votes", F.length("path"), "path")).alias("__path")
        ).withColumnRenamed("host", "__host")
    )
    kind, link = pages.schema[id_column].dataType, pages.schema[url].dataType
    schema = T.StructType(
        [T.StructField(id_column, kind), T.StructField(url, link), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, path in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                blocks = page_blocks(page.as_py())
                text = main_text(blocks, tuple(path.split(STEP))) if path else ""
                texts.append(text or main_text(blocks, best_container(blocks)[0]))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_column, url, "text", "n_chars"],
            )

    return tagged.join(winners, "__host", "left").select(id_column, url, html, "__path").mapInArrow(extract, schema)
