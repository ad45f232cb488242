"""Main text of web pages: marked-up structure, and differences between pages of near URLs.

A page is cut into lines, one for each block. Each page is paired with the page of its host whose URL path
is nearest among those that aren't copies of it (they share nearly all of what isn't on most pages of the host), the lines of both are aligned by a longest
common subsequence, and lines that both pages share are deleted. Markup then checks what is left: shared lines of a
marked article come back, and lines of marked menus, footers, adverts, forms or comments go. All other lines are
undecided by markup, and stay as differencing left them.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import deque
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import map_text, parts, returning, stored

# Element and class names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements whose content is no main text.
DROP = frozenset("head script style noscript template iframe nav footer aside form button select textarea object svg canvas audio video dialog menu search input label fieldset".split())
#: Blocks of text: inside an article, a class says nothing against one.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figure figcaption caption address hgroup summary a abbr b cite code em i mark q s small span strong sub sup time u".split())
#: Words of classes, ids and roles of parts that are no main text.
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond reply replies pagination pager toolbar skip contentinfo complementary search".split()
)
#: Those that no other meaning of a class is likely beside.
SURE_NAMES = frozenset("adsense advert adverts advertisement advertisements breadcrumb breadcrumbs cookie cookies disqus gdpr navbar newsletter pager pagination popup sidebar sponsored".split())
#: Words that stand beside those in a class without another meaning.
SIDE_NAMES = frozenset("area article bar block blog body bottom box button buttons col column container content cta entry fixed form global group header heading icon icons info inline inner item items large left legal link links list main mobile module nested news outer page panel post primary privacy reader rail right row secondary section site slot small sticky story strip tabs title top unit user widget widgets wrap wrapper".split())
#: Those that only count outside an article.
OUTER_NAMES = frozenset("header masthead topbar banner".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAMES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: Open elements that a start tag ends, besides a paragraph, and those that it doesn't look beyond.
ENDERS = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "tr", "td", "th"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("p", "option")}
SCOPE = ("ul", "ol", "dl", "table", "article", "section", "div", "nav", "aside", "footer", "main", "body", "form", "blockquote", "header")

OUT, UNDECIDED, IN = 0, 1, 2


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether a class, id or role has a token with a sure name, or one that is made of these names, and of words that go with them, alone."""
    for token in value.split():
        words = [w.lower() for w in _NAMES.findall(token)]
        if any(w in SURE_NAMES for w in words) or any(w in names for w in words) and all(w in names or w in DROP_NAMES or w in SIDE_NAMES for w in words):
            return True
    return False


def _marks(tag: str, attributes: str, inside: bool) -> int | None:
    """OUT or IN if a start tag says so. The element names come before class names."""
    if tag in DROP or (tag == "header" and not inside):
        return OUT
    out = main = False
    if attributes:
        names = DROP_NAMES if inside else DROP_NAMES | OUTER_NAMES
        for m in _ATTR.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "itemprop":
                if value == "articleBody":
                    return IN
                continue
            out = out or _named(value, names)
            main = main or m[1].lower() == "role" and value.lower() == "main"
    if tag == "article":
        return OUT if out else IN
    if out and tag not in ("body", "html", "main") and not (inside and tag in TEXT):
        return OUT
    return UNDECIDED if tag == "main" or main else None


def lines(page: str) -> list[tuple[str, int]]:
    """(text, OUT, UNDECIDED or IN) of each block that has text, in page order."""
    found: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    # where in the stack the open elements of each name, and the open blocks, are
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    text: list[str] = []
    state = UNDECIDED

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            if line:
                found.append((line, state))
            text.clear()

    def close(k: int) -> None:
        nonlocal state
        if any(t in BLOCK or t in DROP for t, _ in stack[k:]):
            flush()
        state = stack[k][1]
        for t, _ in stack[k:]:
            places[t].pop()
        while blocks and blocks[-1] >= k:
            blocks.pop()
        del stack[k:]

    def last(tags: Sequence[str]) -> int:
        return max((at[-1] for t in tags if (at := places.get(t))), default=-1)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text.append(html.unescape(page[at:lt]))
        if lt == n:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        named = page[lt + 2 : lt + 3] if nxt == "/" else nxt
        if nxt == "/" and named.isalpha() and not named.isascii():
            # the name of a tag begins with an ASCII letter; anything else that looks like an end tag is a comment
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (named.isalpha() and named.isascii()):
            text.append("<")
            at = lt + 1
            continue
        m = _TAG.match(page, lt)
        if m:
            ending, tag, attributes, at = m[1], m[2].lower(), m[3], m.end()
        else:  # an open quote, or the page ends in the tag
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            raw = re.match(r"</?([a-zA-Z][^\s/>]*)", page[lt : lt + 64])
            ending, tag, attributes = page[lt + 1 : lt + 2].replace(raw[1][0], ""), raw[1].lower(), ""
            ending = "/" if ending == "/" else ""
        if ending:
            k = last([tag])
            if tag in BLOCK and k < 0:
                flush()
            elif k >= 0 and (tag in BLOCK or tag in DROP or not blocks or blocks[-1] <= k):
                close(k)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = n if end is None else page.find(">", end.start())
            at = n if end is None or stop < 0 else stop + 1
            continue
        if tag in BLOCK:
            flush()
            # an open paragraph, list item, cell or the like ends here
            enders = ENDERS.get(tag, ("p",))
            while (k := last(enders)) > last(SCOPE):
                close(k)
        if tag in VOID:
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCK and tag not in DROP:
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append((tag, state))
        if state != OUT and (mark := _marks(tag, attributes, state == IN)) is not None and not (state == IN and mark == UNDECIDED):
            if mark != state:
                flush()
            state = mark
    flush()
    return found


def parse_url(url: str | None) -> tuple[str | None, str]:
    """Host in lower case, without port, and path; no host if the URL is null or has none."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or None), parts.path or "/"
    except ValueError:
        return None, "/"


def _rows(mine: Sequence[int], other: Sequence[int]) -> Iterator[int]:
    """For each beginning of `mine`, a number whose bit j is 0 where its common subsequence with `other` grows at j."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(other):
        places.setdefault(x, []).append(j)
    # few lines are frequent, so that few of these wide numbers are kept
    kept = {x: sum(1 << j for j in at) for x, at in places.items() if len(at) > 64}
    every = (1 << len(other)) - 1
    v = every
    for x in mine:
        u = v & (kept[x] if x in kept else sum(1 << j for j in places.get(x, ())))
        v = (v + u | v - u) & every
        yield v


#: Bits of the rows that an alignment keeps; longer ones are halved first.
ALIGNED_BITS = 1 << 28


def _lengths(row: int, n: int) -> np.ndarray:
    """Lengths of the common subsequences with each beginning of the other sequence, of which a row tells where they grow."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(mine: Sequence[int], other: Sequence[int], at: int) -> Iterator[int]:
    if not mine or not other:
        return
    n = len(other)
    if len(mine) * n <= ALIGNED_BITS or len(mine) == 1:
        rows, found, i, j = list(_rows(mine, other)), [], len(mine), n
        while i and j:
            if rows[i - 1] >> j - 1 & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> j - 1 & 1:
                j -= 1
                found.append(at + i)
        yield from reversed(found)
        return
    # the place in `other` at which both halves of `mine` share most with what is before and after it
    half = len(mine) // 2
    fore, back = (deque(_rows(*x), 1).pop() for x in ((mine[:half], other), (mine[half:][::-1], other[::-1])))
    cut = int((_lengths(fore, n) + _lengths(back, n)[::-1]).argmax())
    yield from _aligned(mine[:half], other[:cut], at)
    yield from _aligned(mine[half:], other[cut:], at + half)


def shared(mine: Sequence[int], other: Sequence[int]) -> list[int]:
    """Positions in `mine` of a longest common subsequence with `other`.

    Equal beginnings and ends go first, then lines that one side alone has. The rest is aligned by
    bits, a machine word of lines at once; of sequences too long to keep a row for each line,
    halves are aligned one after the other, so memory grows with the lines and not with their square.
    """
    n = min(len(mine), len(other))
    head = next((i for i in range(n) if mine[i] != other[i]), n)
    tail = next((i for i in range(n - head) if mine[-1 - i] != other[-1 - i]), n - head)
    a, b = mine[head : len(mine) - tail], other[head : len(other) - tail]
    in_a, in_b = set(a), set(b)
    places = [i for i, x in enumerate(a) if x in in_b]
    rest = [x for x in b if x in in_a]
    middle = _aligned([a[i] for i in places], rest, 0)
    return [*range(head), *(head + places[i] for i in middle), *range(len(mine) - tail, len(mine))]


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


#: Of two pages with less than this share of the characters of either's own lines unlike the other's, one is a copy of the other.
UNLIKE = 0.1
#: A line on so many different pages of a host, and on more than this share of the pages that the page's most widespread line is on, is of the template.
WIDESPREAD, SHARE = 3, 0.75
_ROW, _KEY, _DROP = "__row", "__key", "__drop"


def _chars_shared(mine: Sequence[int], sizes: Sequence[int], other: Sequence[int]) -> int:
    return sum(sizes[i] for i in shared(mine, other))


def copies(a: Sequence[int], a_sizes: Sequence[int], b: Sequence[int], b_sizes: Sequence[int]) -> bool:
    """Whether two pages, given by the main lines that aren't of the template and these lines' sizes, are copies: they share all of a text as well."""
    return _chars_shared(a, a_sizes, b) > (1 - UNLIKE) * min(sum(a_sizes), sum(b_sizes))


def _key(text: bytes | None, url: str | None) -> int:
    """The same for equal pages of equal URLs, whose results are the same."""
    return int.from_bytes(hashlib.blake2b((url or "").encode("utf-8", "replace") + b"\0" + (text or b""), digest_size=8).digest(), "little", signed=True)


def _lines(text: bytes | None) -> list[tuple[str, int]]:
    return lines((text or b"").decode("utf-8", "replace"))


def _outlined(texts, urls):
    keys, hosts, paths, every, main, sizes, opens = [], [], [], [], [], [], []
    for t, u in zip(texts, urls.to_pylist(), strict=True):
        host, path = parse_url(u)
        # without a host there is nothing to compare with
        found = _lines(t) if host is not None else []
        inside = [i for i, (_, kind) in enumerate(found) if kind != OUT]
        keys.append(_key(t, u))
        hosts.append(host)
        paths.append(path)
        every.append([_line_hash(x) for x, _ in found])
        main.append(inside)
        sizes.append([len(found[i][0]) for i in inside])
        opens.append([i for i, (_, kind) in enumerate(found) if kind == UNDECIDED])
    return keys, hosts, paths, every, main, sizes, opens


def outlines(pages: DataFrame) -> DataFrame:
    """A stored table, without texts, of what pairing needs of each page that has a host: a number for each row, the page's key, host and
    path, hashes of all lines, the places of main lines (all but those marked as none) and their sizes, and the places of undecided lines."""
    made = f"{_KEY} long, __host string, __path string, __every array<long>, __main array<int>, __sizes array<int>, __open array<int>"
    found = map_text(pages, made, lambda: _outlined, "html", [], ["url"]).where(F.col("__host").isNotNull())
    return stored(found.withColumn(_ROW, F.monotonically_increasing_id()), "outlines")


def _packed(texts, urls):
    keys, packed, inner, alone = [], [], [], []
    for t, u in zip(texts, urls.to_pylist(), strict=True):
        found = [(x, kind) for x, kind in _lines(t) if kind != OUT]
        marked = any(kind == IN for _, kind in found)
        keys.append(_key(t, u))
        packed.append(zlib.compress("\n".join(x for x, _ in found).encode("utf-8", "replace"), 1))
        inner.append([kind == IN for _, kind in found])
        alone.append([marked and kind == UNDECIDED for _, kind in found])
    return keys, packed, inner, alone


#: Bytes of packed lines that are unpacked at once.
UNPACKED = 1 << 20


def _finished(keep: Sequence[str]):
    """Text, n_chars, decided_by and n_shared of pages, given their packed main lines and what the nearest page shares of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts(batch, ["__packed"], UNPACKED):
                texts, decided, n_shared = [], [], []
                for packed, inner, alone, drop in zip(*(b.column(c).to_pylist() for c in ("__packed", "__inner", "__alone", _DROP)), strict=True):
                    left = zlib.decompress(packed).decode().split("\n") if inner else []
                    # markup checks what differencing left: an article's lines stay even if the nearest page has them too
                    gone = alone if drop is None else drop
                    texts.append("\n".join(x for x, i, d in zip(left, inner, gone, strict=True) if i or not d))
                    decided.append("markup" if any(inner) else None if drop is None else "difference")
                    n_shared.append(None if drop is None else sum(drop))
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(decided, pa.string()), pa.array(n_shared, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=[*keep, "text", "n_chars", "decided_by", "n_shared"])

    return run


def template_lines(light: DataFrame) -> DataFrame:
    """(__host, __digest, __common array<long>): the lines of each different page that are of its host's template.

    Pages of the same main lines count once. A line counts as one of the template if it is on WIDESPREAD
    pages or more, and on more than SHARE of the pages that the most widespread line of the page is on: a
    menu is on all pages of a template, a story and its copies on some. Lines are counted by host and
    hash before they are joined, and the counts are a stored table, so that the rows of a line that a
    host has everywhere may be split.
    """
    hashes = F.transform("__main", lambda i: F.get("__every", i))
    each = stored(light.select("__host", "__digest", F.explode(hashes).alias("line")).distinct(), "lines")
    counts = stored(each.groupBy("__host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= WIDESPREAD), "counts")
    per = each.join(counts, ["__host", "line"]).groupBy("__host", "__digest").agg(F.max("n").alias("most"), F.collect_list(F.struct("line", "n")).alias("found"))
    common = F.filter("found", lambda x: x["n"] > SHARE * F.col("most"))
    return stored(per.select("__host", "__digest", F.transform(common, lambda x: x["line"]).alias("__common")), "template")


_CARRIED = (_KEY, "__host", "__path", "__digest", "__every", "__main", "__open", "part")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's main lines that aren't of the template, their sizes, its place in its partition, the number of its run of copies, and whether it is the run's first or last row."""
    n, run, before, held = 0, -1, None, None

    def with_places(batch, own, sizes, at, runs, heads, tails):
        made = [pa.array(own, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(at, pa.int64()), pa.array(runs, pa.int64()), pa.array(heads, pa.bool_()), pa.array(tails, pa.bool_())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in _CARRIED), *made], names=[*_CARRIED, "own", "sizes", "at", "run", "head", "tail"])

    for b in batches:
        if not b.num_rows:
            continue
        own, sizes, runs, heads = [], [], [], []
        for r in b.select(["__host", "__digest", "__every", "__main", "__sizes", "__common"]).to_pylist():
            common = set(r["__common"] or ())
            kept = [(r["__every"][i], size) for i, size in zip(r["__main"], r["__sizes"], strict=True) if r["__every"][i] not in common]
            now = r["__host"], r["__digest"], [x for x, _ in kept], [size for _, size in kept]
            heads.append(before is None or now[0] != before[0] or now[1] != before[1] and not copies(*before[2:], *now[2:]))
            run += heads[-1]
            runs.append(run)
            own.append(now[2])
            sizes.append(now[3])
            before = now
        # whether a batch's last row ends its run is known when the next batch begins
        if held:
            yield with_places(*held, [*held[-1][1:], heads[0]])
        held = b, own, sizes, range(n, n + b.num_rows), runs, heads
        n += b.num_rows
    if held:
        yield with_places(*held, [*held[-1][1:], True])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and neighbour that isn't a copy of it: how long their paths are equal, and which main lines the neighbour has too."""
    for b in batches:
        keys, places, length, drop = [], [], [], []
        for r in b.to_pylist():
            if r["__digest"] == r["digest2"] or copies(r["own"], r["sizes"], r["own2"], r["sizes2"]):
                continue
            n = 0
            for x, y in zip(r["__path"], r["path2"], strict=False):
                if x != y:
                    break
                n += 1
            keys.append(r[_KEY])
            places.append(r["at2"])
            length.append(n)
            # undecided lines are aligned by themselves, so that no order of an article's lines stands against them
            undecided = set(r["__open"])
            marked = [i for i in r["__main"] if i not in undecided]
            gone = {at[i] for at in (r["__open"], marked) for i in shared([r["__every"][j] for j in at], r["every2"])}
            drop.append([i in gone for i in r["__main"]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(length, pa.int32()), pa.array(drop, pa.list_(pa.bool_()))], names=[_KEY, "at", "length", _DROP])


def pair_lines(outlined: DataFrame) -> DataFrame:
    """(__key, __drop array<boolean>), a stored table: whether each of a page's main lines is shared by the page of the nearest URL.

    The pages of all hosts are put in one order by host and path, in range
    partitions that split a host of any size, and numbered. Neighbours of a host that are copies
    share all of their text, beside the lines of the template (see template_lines()): they make one run and are not paired with each
    other. A page's nearest URL is the last of the run before its own or the first of the run
    after it, whichever path shares the longer beginning (the one before, if both do). Only hashes
    of lines travel.
    """
    spark = outlined.sparkSession
    digest = F.xxhash64(F.transform("__main", lambda i: F.get("__every", i))).alias("__digest")
    light = outlined.select(_ROW, _KEY, "__host", "__path", digest, "__every", "__main", "__sizes", "__open")
    ranged = light.join(template_lines(light), ["__host", "__digest"], "left")
    ranged = ranged.repartitionByRange("__host", "__path", _ROW).sortWithinPartitions("__host", "__path", _ROW).withColumn("part", F.spark_partition_id())
    carried = [ranged.schema[c] for c in _CARRIED]
    own = [StructField("own", ArrayType(LongType())), StructField("sizes", ArrayType(IntegerType()))]
    added = [*own, StructField("at", LongType()), StructField("run", LongType()), StructField("head", BooleanType()), StructField("tail", BooleanType())]
    ranged = stored(ranged.mapInArrow(_numbered, StructType([*carried, *added])), "pages")
    digest = F.struct(F.col("__host").alias("host"), F.col("__digest").alias("main"))
    ends = ranged.groupBy("part").agg(F.max("at").alias("at"), F.max("run").alias("run"), F.min_by(digest, "at").alias("first"), F.max_by(digest, "at").alias("last"))
    offsets, total, next_run, last = [], 0, 0, None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        # the first run of a part may be the end of the one before
        begun = last is not None and last["last"] == r["first"]
        if begun:
            offsets[-1][4] = last["run"]
        offsets.append([r["part"], total, next_run - begun, begun, -1])
        total, next_run, last = total + r["at"] + 1, next_run - begun + r["run"] + 1, r
    starts = spark.createDataFrame(offsets, "part int, at0 long, run0 long, begun boolean, going long")
    # a row for each range partition
    placed = ranged.join(F.broadcast(starts), "part").select(
        *_CARRIED[:-1], "own", "sizes", (F.col("at0") + F.col("at")).alias("at"), (F.col("run0") + F.col("run")).alias("run"),
        (F.col("head") & ~((F.col("run") == 0) & F.col("begun"))).alias("head"), (F.col("tail") & (F.col("run") != F.col("going"))).alias("tail"),
    )
    # pages with main lines ask the ends of the two runs beside their own
    asked = F.explode(F.array(F.struct((F.col("run") - 1).alias("run"), F.lit("tail").alias("end")), F.struct((F.col("run") + 1).alias("run"), F.lit("head").alias("end"))))
    asks = placed.where(F.size("__main") > 0).drop("at", "head", "tail").withColumn("asked", asked).drop("run").select("*", "asked.run", "asked.end").drop("asked")
    named = F.array_compact(F.array(F.when(F.col("head"), F.lit("head")), F.when(F.col("tail"), F.lit("tail"))))
    others = placed.where("head or tail").select("run", F.explode(named).alias("end"), F.col("at").alias("at2"), F.col("__host").alias("host2"), F.col("__path").alias("path2"), F.col("__digest").alias("digest2"), F.col("__every").alias("every2"), F.col("own").alias("own2"), F.col("sizes").alias("sizes2"))
    near = asks.join(others, ["run", "end"]).where("__host = host2").drop("host2", "end")
    aligned = near.mapInArrow(_paired, f"{_KEY} long, at long, length int, {_DROP} array<boolean>")
    # stored, as all that a key of very many equal pages is joined with
    return stored(aligned.groupBy(_KEY).agg(F.max_by(_DROP, F.struct("length", -F.col("at"))).alias(_DROP)), "shared")


def extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Kept columns, text string, n_chars long (code points), decided_by string: 'markup' if the page marks an article, else 'difference', null if neither had to decide, n_shared long: how many
    lines, but those that markup says are none of the text, the page of the nearest URL has too (null without such a page).

    Every page is differenced, and markup checks the result. Null and empty pages, and pages without main text, get an empty text. A text is the marked
    articles and, in page order, the undecided lines around them that the page of the nearest URL doesn't
    share: a title above an article, a text beside the teaser of another. A page whose host has no other
    page but copies, or whose URL is null, keeps its articles alone if it marks any, and all undecided lines if not. Equal rows get equal results. A page that is all template
    has no text. On a host of two different pages that share nearly all of their text, nothing tells a template from a story: both keep theirs.
    """
    keep = [c for c in keep if c not in ("text", "n_chars", "decided_by", "n_shared")]
    # by a shuffle at every size, so that what small tables take tells what large ones will
    # texts are neither stored nor moved until it is known what goes: pages are parsed once more then, and packed lines meet their page's row
    shared = pair_lines(outlines(pages))
    made = f"{_KEY} long, __packed binary, __inner array<boolean>, __alone array<boolean>"
    both = map_text(pages, made, lambda: _packed, "html", keep, ["url"]).join(shared.hint("merge"), _KEY, "left").select(*keep, "__packed", "__inner", "__alone", _DROP)
    added = [StructField("text", StringType()), StructField("n_chars", LongType()), StructField("decided_by", StringType()), StructField("n_shared", LongType())]
    return both.mapInArrow(returning(_finished(keep)), StructType([*(both.schema[c] for c in keep), *added]))
