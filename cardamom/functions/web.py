"""Functions over URLs and pages. Well-formed marks are read by patterns; nested ones by a parser in a pandas UDF."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..session import ship
from .text import normalise


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    """The path, without query and fragment; '' if there is none."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


@F.pandas_udf(StringType())
def _absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:

    def one(b, h):
        if not h:
            return None
        try:
            out = urljoin(b or "", h)
            return out if urlsplit(out).scheme else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """href resolved against base; null if it is null or empty, or the result is no URL."""
    ship(SparkSession.active())
    return _absolute_url(base, href)


def meta_content(page: Column, name: str) -> Column:
    """Normalised content of the meta element of that name, else of that property; '' if neither is there."""
    found = [F.regexp_extract(page, rf'<meta[^>]*\b{key}="{name}"[^>]*\bcontent="([^"]*)"', 1) for key in ("name", "property")]
    return normalise(F.coalesce(*[F.nullif(f, F.lit("")) for f in found]))


def attribute_values(page: Column, element: str, attribute: str) -> Column:
    return F.regexp_extract_all(page, F.lit(rf'<{element}\b[^>]*?\b{attribute}="([^"]*)"'))


def image_urls(page: Column) -> Column:
    """Distinct http(s) URLs of images, in order: src, then the lazy ones, then the first of each srcset."""
    found = [attribute_values(page, "img", a) for a in ("src", "data-src", "data-original", "data-lazy")]
    sets = F.transform(attribute_values(page, "img", "srcset"), lambda s: F.get(F.split(F.trim(F.get(F.split(s, ","), F.lit(0))), r"\s+"), F.lit(0)))
    return F.array_distinct(F.filter(F.concat(*found, sets), lambda u: F.rlike(u, F.lit("^https?://"))))


def image_entries(card: Column, urls: Column, most: int = 4) -> Column:
    """The first `most` images: image_id <card>_<i>, role cover for the first and gallery for the others, source_url."""
    return F.transform(
        F.slice(urls, 1, most),
        lambda u, i: F.struct(F.concat_ws("_", card, i.cast("string")).alias("image_id"), F.when(i == 0, F.lit("cover")).otherwise(F.lit("gallery")).alias("role"), u.alias("source_url")),
    )


def wanted_image(url: Column, deny: list[str], allow: list[str]) -> Column:
    """No denied word and no svg, and one of the allowed words."""
    low = F.lower(url)

    def any_of(words):
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    return ~any_of(deny) & ~low.endswith(".svg") & any_of(allow)


def candidate(url: Column, hosts: list[str], excluded: str, least: int = 10, hyphens: int = 2) -> Column:
    """Whether a URL is a card's: its host, no excluded path, one path part, a slug long and hyphenated enough. Bad URLs are not."""
    parts = path_parts(url)
    slug = F.get(parts, F.lit(0))
    good = host(url).isin(hosts) & ~F.rlike(path(url), F.lit(excluded)) & (F.size(parts) == 1) & (F.length(slug) >= least) & (F.regexp_count(slug, F.lit("-")) >= hyphens)
    return F.coalesce(good, F.lit(False))


def json_ld(page: Column) -> Column:
    """Contents of the JSON-LD blocks; a broken block is left out."""
    blocks = F.regexp_extract_all(page, F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'))
    return F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())


def first_event(block: Column) -> Column:
    """The first node, in the block or its @graph, whose @type ends in Event, as a variant."""
    one = F.try_parse_json(block)
    nodes = F.coalesce(F.try_variant_get(one, "$['@graph']", "array<variant>"), F.try_variant_get(one, "$", "array<variant>"), F.array(one))
    return F.get(F.filter(nodes, lambda n: F.coalesce(F.try_variant_get(n, "$['@type']", "string"), F.lit("")).endswith("Event")), F.lit(0))


class _Lists(HTMLParser):
    """Items of the first list within some elements after a matching heading."""

    def __init__(self, wanted: str, reach: int) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, self.reach = wanted, reach
        self.heading: list[str] | None = None
        self.open = 0
        self.depth = 0
        self.item: list[str] | None = None
        self.items: list[str] = []
        self.done = False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag in ("h2", "h3", "h4") and not self.depth:
            self.heading = []
        elif self.open:
            if tag in ("ul", "ol"):
                self.depth += 1
            elif tag == "li" and self.depth == 1:
                self._flush()
                self.item = []
            elif not self.depth and tag in ("p", "div", "section", "table"):
                self.open -= 1

    def _flush(self):
        if self.item is not None and (text := " ".join("".join(self.item).split())):
            self.items.append(text)
        self.item = None

    def handle_endtag(self, tag):
        if self.heading is not None and tag in ("h2", "h3", "h4"):
            if self.wanted in "".join(self.heading).lower():
                self.open = self.reach
            self.heading = None
        elif tag in ("ul", "ol") and self.depth:
            self.depth -= 1
            if not self.depth:
                self._flush()
                self.done = True
        elif tag == "li" and self.depth == 1:
            self._flush()

    def handle_data(self, data):
        if self.heading is not None:
            self.heading.append(data)
        elif self.item is not None:
            self.item.append(data)


def heading_list(page: Column, wanted: str, reach: int = 5) -> Column:
    """Items of the first list among the `reach` elements after a heading that holds `wanted`."""
    ship(SparkSession.active())

    @F.pandas_udf(ArrayType(StringType()))
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for p in pages:
            parser = _Lists(wanted.lower(), reach)
            parser.feed(p or "")
            parser.close()
            out.append(parser.items)
        return pd.Series(out)

    return run(page)


class _Tree(HTMLParser):
    """A page as nested lists [tag, children], whose children are such lists or texts."""

    CLOSES = {"li": ("li", "p"), "p": ("p",), "ul": ("p",), "ol": ("p",), "h2": ("p",), "h3": ("p",), "h4": ("p",), "div": ("p",), "section": ("p",), "table": ("p",)}
    STOPS = ("ul", "ol", "div", "section", "article", "body", "td", "nav")
    VOID = ("br", "hr", "img", "input", "meta", "link", "wbr", "source")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in self.CLOSES.get(tag, ()):
                del self.open[k:]
                break
            if self.open[k][0] in self.STOPS:
                break
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1][1].append(data)


def _nodes(root: list):
    """(children of the same parent, place among them) of every element, in page order."""
    stack = [(root[1], 0)]
    while stack:
        children, i = stack.pop()
        while i < len(children) and isinstance(children[i], str):
            i += 1
        if i < len(children):
            yield children, i
            stack += [(children, i + 1), (children[i][1], 0)]


def _text(node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += reversed(x[1])
    return " ".join("".join(out).split())


def headed_lists(page: Column, wanted: str, other: str, labels: tuple[str, str] = ("included", "extra"), reach: int = 5, least: int = 2) -> Column:
    """array<struct<label, heading, item>>: the items of the first list among the `reach` elements after every heading that a pattern finds.

    Headings are h2, h3 and h4 that `wanted` finds in; those that `other` finds in too have the second label. Patterns are
    Python's and ignore case. Items are all <li> of the list, nested ones as well, of `least` characters or more. A null page has none.
    """
    ship(SparkSession.active())

    @F.pandas_udf("array<struct<label: string, heading: string, item: string>>")
    def run(pages: pd.Series) -> pd.Series:
        want, extra = re.compile(wanted, re.I), re.compile(other, re.I)

        def lists(p: str) -> list[dict]:
            parser, found = _Tree(), []
            parser.feed(p)
            parser.close()
            for siblings, i in _nodes(parser.root):
                if siblings[i][0] not in ("h2", "h3", "h4") or not want.search(heading := _text(siblings[i])):
                    continue
                after = [x for x in siblings[i + 1 :] if not isinstance(x, str)][:reach]
                block = next((x for x in after if x[0] in ("ul", "ol")), None)
                items = [_text(c[j]) for c, j in _nodes(block) if c[j][0] == "li"] if block else []
                label = labels[bool(extra.search(heading))]
                found += [{"label": label, "heading": heading, "item": x} for x in items if len(x) >= least]
            return found

        return pd.Series([lists(p) if p else [] for p in pages])

    return run(page)


def day_groups(lines: Column, is_title: str) -> Column:
    """Program days: a line that matches begins a day, the lines after it are joined by ' | ', cut at 4000 characters.

    Lines before the first title belong to no day; null lines don't count, nor do empty ones before a day's first text.
    Each line is read once, however many days there are.
    """
    starts = F.array_compact(F.transform(lines, lambda x, i: F.when(F.rlike(x, F.lit(is_title)), i + 1)))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(0))), F.array(F.size(lines) + 1))
    spans = F.filter(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))), lambda x: x["a"].isNotNull())

    def day(x: Column) -> Column:
        text = F.array_join(F.slice(lines, x["a"] + 1, x["b"] - x["a"] - 1), " | ")
        return F.struct(F.element_at(lines, x["a"]).alias("title"), F.left(F.regexp_replace(text, r"^(?: \| )+", ""), F.lit(4000)).alias("text"))

    return F.transform(spans, day)
