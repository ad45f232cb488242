"""Personal data: fixed detectors, and contextual extraction bootstrapped from what they find.

The detectors' matches are seed entities, and so are random-looking strings of the kind that keys
and tokens are. The one or two words before an entity, and those after it, are lexical patterns;
patterns and the entity-like strings beside them form a bipartite graph. Over some rounds a
pattern is as trustworthy as the share of its occurrences in the whole corpus that stand beside
known entities, and a string as its best pattern. Strings that no detector knows but that stand
beside a trusted pattern are added; a random-looking string without such a pattern is not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, map_text, parts, returning, small, stored
from .wordhash import U64, binary, byte_class, many, packs, windows

KINDS = ("email", "ip", "card", "phone")
#: The kind of random-looking seeds, and of what is added for them.
SECRET = "secret"
#: Rounds of the bootstrap; share of a pattern's occurrences that must precede entities; different known entities it must precede.
ROUNDS, TRUST, SUPPORT = 3, 0.5, 3
#: Places of the fixed-size filter through which the corpus's words pass before they are counted.
FILTER_BITS = 23

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK, _MARKED = re.compile(r"[0-9@]"), re.compile(rb"[0-9@]")
_MARK_BYTE = byte_class(lambda b: b == 0x40 or 0x30 <= b <= 0x39)
_RANDOM = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
_TURN = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_SPACE_BEFORE = re.compile(r"\s")
_WHITE = " \t\n\r\x0b\x0c"
_TRIM = "\"'`.,;:!?()[]{}<>|*#$%&="

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the run of local-part characters before an @ that a domain follows."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        m = _DOMAIN.match(text, at)
        lo = at
        if m:
            while lo > done and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at:
                yield lo, m.end()
                done = at = m.end()
                continue
        at += 1


def addresses(text: str) -> Iterator[Span]:
    for m in _digits(_CHAIN, text):
        if all(len(part := p.lstrip("0")) < 4 and int(part or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _digits(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Leftmost matches of a pattern that begins with a maximal run of digits: a run is tried from its first digit alone."""
    at = 0
    for run in re.finditer(r"[0-9]+", text):
        if run.start() >= at and (m := pattern.match(text, run.start())):
            yield m
            at = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield m.span()


DETECTORS = dict(zip(KINDS, (emails, addresses, cards, phones), strict=True))


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start (code points, end exclusive)."""
    if not _MARK.search(text):
        return []
    return [(kind, a, b) for kind in KINDS for a, b in DETECTORS[kind](text)]


def random_looking(word: str) -> bool:
    """Whether a string is long and goes to and fro between letters and digits, as keys and tokens do."""
    return _RANDOM.fullmatch(word) is not None and len(_TURN.findall(word)) >= max(4, len(word) // 8)


def entity_like(text: str, known: Sequence[Span]) -> Iterator[Span]:
    """Strings between white space, without marks around, that hold four digits or an @ and touch no known span."""
    done, k, spans = 0, 0, sorted(known)
    for m in _MARK.finditer(text):
        if m.start() < done:
            continue
        lo = m.start()
        while lo > done and text[lo - 1] not in _WHITE:
            lo -= 1
        hi = m.end()
        gap = _SPACE_BEFORE.search(text, hi)
        hi = done = gap.start() if gap else len(text)
        word = text[lo:hi]
        lo += len(word) - len(word.lstrip(_TRIM))
        hi -= len(word) - len(word.rstrip(_TRIM))
        if hi - lo < 4 or "@" not in text[lo:hi] and sum("0" <= c <= "9" for c in text[lo:hi]) < 4:
            continue
        while k < len(spans) and spans[k][1] <= lo:
            k += 1
        if k == len(spans) or spans[k][0] >= hi:
            yield lo, hi


_ENTITY = "kind: string, start: int, end: int, instance: long, patterns: array<struct<gram: long, after: boolean>>"


def _entities(text: bytes) -> tuple[list[dict], list[dict]]:
    """Base and other entities of a text, with the bytes at which they begin and end."""
    s = text.decode("utf-8", "replace")
    base = detect(s)
    others = [(SECRET if random_looking(s[a:b]) else None, a, b) for a, b in entity_like(s, [x[1:] for x in base])]
    # bytes of the characters before each position, found once in their order
    at, before, done = {}, 0, 0
    for p in sorted({p for _, a, b in (*base, *others) for p in (a, b)}):
        before, done = before + len(s[done:p].encode()), p
        at[p] = before
    made = [
        [{"kind": k, "start": a, "end": b, "instance": int.from_bytes(hashlib.blake2b(s[a:b].lower().encode(), digest_size=8).digest(), "little", signed=True), "bytes": (at[a], at[b]), "patterns": []} for k, a, b in x]
        for x in (base, others)
    ]
    return made[0], made[1]


def _add_patterns(texts: list[bytes], entities: list[list[dict]]) -> None:
    """Gives entities their patterns: hashes of the word or two words before them, and of those after them.

    Words are what stands between white space, and those with digits or an @ are no context. An entity's
    own words are those that it begins and ends in.
    """
    h, s, e, first, joined = many([t.lower() for t in texts])
    marks = np.concatenate([[0], np.cumsum(_MARK_BYTE[np.frombuffer(joined, np.uint8)])])
    plain = marks[e] == marks[s]
    pairs = windows(h, 2).astype(np.int64)
    signed = h.astype(np.int64)
    offset = 0
    for t, own, lo, hi in zip(texts, entities, first[:-1].tolist(), first[1:].tolist(), strict=True):
        for x in own:
            a, b = x.pop("bytes")
            i, j = int(np.searchsorted(s, offset + a, "right")) - 1, int(np.searchsorted(s, offset + b - 1, "right"))
            if i - 1 >= lo and plain[i - 1]:
                x["patterns"].append({"gram": int(signed[i - 1]), "after": False})
                if i - 2 >= lo and plain[i - 2]:
                    x["patterns"].append({"gram": int(pairs[i - 2]), "after": False})
            if j < hi and plain[j]:
                x["patterns"].append({"gram": int(signed[j]), "after": True})
                if j + 1 < hi and plain[j + 1]:
                    x["patterns"].append({"gram": int(pairs[j]), "after": True})
        offset += len(t) + 1


def _mentions(texts: list[bytes | None]) -> tuple[list, list]:
    base, others = [[] for _ in texts], [[] for _ in texts]
    marked = [i for i, t in enumerate(texts) if t and _MARKED.search(t)]
    for i in marked:
        base[i], others[i] = _entities(texts[i])
    some = [i for i in marked if base[i] or others[i]]
    for lo, hi in packs([texts[i] for i in some]):
        _add_patterns([texts[i] for i in some[lo:hi]], [base[i] + others[i] for i in some[lo:hi]])
    return base, others


def mentions(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns, base and others: array<struct<kind, start, end, instance, patterns>>. Of others, random-looking ones have a kind."""
    return map_text(docs, f"base array<struct<{_ENTITY}>>, others array<struct<{_ENTITY}>>", lambda: _mentions, text, keep)


def occurrences(docs: DataFrame, grams: DataFrame, text: str = "text") -> DataFrame:
    """(gram, total): how often each of the words, or pairs of words, stands in the texts.

    One pass over the texts, however many there are to count. A filter of a fixed size goes to the
    tasks; what passes it is counted in each batch, and the counts are joined with the grams.
    """
    ship(docs.sparkSession)
    size = 1 << FILTER_BITS
    places = grams.select(F.pmod("gram", F.lit(size)).cast("int").alias("at")).distinct().toArrow()["at"].to_numpy()
    bits = np.zeros(size, bool)
    bits[places] = True
    packed = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(packed).astype(bool)
        for batch in batches:
            found = []
            for part in parts(batch, [0]):
                texts = binary(part.column(0))
                for lo, hi in packs(texts):
                    h, _, _, first, _ = many([(t or b"").lower() for t in texts[lo:hi]])
                    inside = np.ones(len(h), bool)
                    inside[first[1:-1][first[1:-1] < len(h)]] = False
                    for grams in (h, windows(h, 2)[inside[1:]]):
                        found.append(grams[passes[(grams & U64(size - 1)).astype(np.int64)]])
            keys, n = np.unique(np.concatenate(found) if found else np.empty(0, U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["gram", "n"])

    counted = docs.select(docs[text].cast("string")).mapInArrow(returning(run), "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("total")).join(grams, "gram")


_PATTERN = ["gram", "after"]


def trusted_patterns(docs: DataFrame, found: DataFrame, text: str = "text", rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """(gram, after, kind, conf) of the patterns that the bootstrap trusts, from a table that mentions() gave.

    Edges are counted by pattern and string before anything is joined, so a common pattern or
    string is one row of each task. Only patterns beside some string that no detector knows, and
    beside `support` different strings, can add anything; their occurrences are counted over all texts.
    """
    each = [found.select(F.explode(c).alias("m"), F.lit(c == "others").alias("new")) for c in ("base", "others")]
    both = each[0].unionByName(each[1]).select("new", "m.kind", "m.instance", F.explode("m.patterns").alias("p")).select("*", "p.gram", "p.after").drop("p")
    edges = stored(both.groupBy(*_PATTERN, "instance").agg(F.max("kind").alias("kind"), F.max("new").alias("new"), F.count("*").alias("n")), "edges")
    per = edges.groupBy(*_PATTERN).agg(F.count("*").alias("strings"), F.max("new").alias("new"))
    useful = stored(per.where(F.col("new") & (F.col("strings") >= support)).select(*_PATTERN), "patterns")
    totals = occurrences(docs, useful.select("gram").distinct(), text)
    graph = stored(edges.join(useful, _PATTERN, "left_semi").join(totals, "gram"), "graph")
    seeds = graph.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("sure")).distinct()
    strings, patterns, rest = seeds, None, [edges, useful, graph]
    for _ in range(rounds):
        patterns = (
            graph.drop("kind").join(strings, "instance")
            .groupBy(*_PATTERN, "kind")
            .agg((F.sum(F.col("n") * F.col("sure")) / F.max("total")).alias("conf"), F.count("*").alias("known"))
            .where((F.col("known") >= support) & (F.col("conf") >= trust))
        )
        best = graph.where("kind is null").drop("kind").join(patterns, _PATTERN).groupBy("instance", "kind").agg(F.max(F.least("conf", F.lit(1.0))).alias("sure"))
        strings = stored(seeds.unionByName(best), "strings")
        rest.append(strings)
    trusted = stored(patterns.groupBy(*_PATTERN).agg(F.max("conf").alias("conf"), F.max_by("kind", F.struct("conf", "kind")).alias("kind")), "trusted")
    discard(found.sparkSession, *rest)
    return trusted


def added_spans(found: DataFrame, patterns: DataFrame, row: str) -> DataFrame:
    """(row, added array<struct<kind, start, end>>): the strings beside trusted patterns, each of its best one's kind."""
    rest = found.where(F.col(row).isNotNull()).select(row, F.explode("others").alias("m")).select(row, "m.start", "m.end", F.explode("m.patterns").alias("p")).select("*", "p.gram", "p.after").drop("p")
    known = F.broadcast(patterns) if small(patterns, BROADCAST_PATTERNS) else patterns
    best = rest.join(known, _PATTERN).groupBy(row, "start", "end").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"))
    return best.groupBy(row).agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))


def extract(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """Kept columns, base and spans: arrays of struct<kind, start, end>, by kind and start; `spans` has the added ones too, of any of KINDS or SECRET.

    Positions are code points, ends exclusive. Null and empty texts have no spans. Rows are told
    apart by a number of their own, so repeated rows and null ids each keep their result.
    A pattern of unknown strings alone is never trusted: without seeds nothing is added.
    """
    found = stored(mentions(docs, text, keep).withColumn("__row", F.monotonically_increasing_id()), "mentions")
    added = added_spans(found, trusted_patterns(docs, found, text, rounds, trust, support), "__row")
    base = F.transform("base", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    both = found.withColumn("__base", base).join(added, "__row", "left")
    spans = F.when(F.col("added").isNull(), F.col("__base")).otherwise(ordered(F.concat("__base", "added")))
    return both.select(*[c for c in keep if c not in ("base", "spans")], F.col("__base").alias("base"), spans.alias("spans"))


#: Trusted patterns, and documents with added spans, that are sent to every task at most; more are joined by a shuffle.
BROADCAST_PATTERNS, BROADCAST_DOCS = 500_000, 500_000


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with every span masked in `text`, and `n_chars` set to its code points.

    Rows of one id are taken to be of one text. A null text stays null, its n_chars too; a row of null
    id is masked by the detectors alone. Other columns stay as they are.
    """
    found = stored(mentions(docs, text, [id]), "mentions")
    more = "__added"
    while more in docs.columns:
        more += "_"
    added = stored(added_spans(found, trusted_patterns(docs, found, text), id).withColumnRenamed("added", more), "added")
    joined = docs.join(F.broadcast(added) if small(added, BROADCAST_DOCS, F.size(more) * 32) else added, id, "left")

    def kernel(texts, more):
        out, sizes = [], []
        for t, extra in zip(texts, more.to_pylist(), strict=True):
            if t is None:
                out.append(None)
                sizes.append(None)
                continue
            s = t.decode("utf-8", "replace")
            s = mask(s, detect(s) + [(x["kind"], x["start"], x["end"]) for x in extra or ()])
            out.append(s)
            sizes.append(len(s))
        return out, sizes

    return map_text(joined, f"{text} string, {n_chars} long", lambda: kernel, text, docs.columns, [more]).select(docs.columns)


def ordered(spans: Column) -> Column:
    """Spans by kind, in the order of KINDS and SECRET, then start."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, SECRET)) for x in (k, i)])
    keyed = F.array_sort(F.transform(spans, lambda m: F.struct(F.element_at(rank, m["kind"]).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
    return F.transform(keyed, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def mask(text: str, spans: Sequence[tuple[str, int, int]]) -> str:
    """The text with each span, or overlapping spans together, replaced by [KIND] of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
