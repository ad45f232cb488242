"""Text functions: Column -> Column, inside whole-stage code generation, without Python.

Every function gives null for null unless its docstring names another result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the source language in durations, group sizes and ages, as patterns over lower-case text.
HOURS = r"(\d+(?:\.\d+)?)\s*(?:час|ч)"
MINUTES = r"(\d+)\s*(?:минут|мин)"
DAYS = r"(\d+)\s*(?:дн|день|дня|дней|суток)"
FROM_TO = r"от\s+(\d+)\s+до\s+(\d+)"
UP_TO = r"до\s+(\d+)"
AGE_FROM = r"от\s+(\d+)\s+лет"


def normalise(c: Column) -> Column:
    """Plain spaces, no white space before line ends, two line ends in a row at most, trimmed; null gives ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), " ", " ")
    c = F.regexp_replace(c, r"\s+\n", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _number(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("double")


def duration_minutes(c: Column, hours: str = HOURS, minutes: str = MINUTES, days: str = DAYS) -> Column:
    """Hours, minutes and days of a text, added up in minutes; null if there are none."""
    c = F.regexp_replace(F.lower(c), r"^([^,]*),", "$1.")
    total = F.coalesce(F.round(_number(c, hours) * 60), F.lit(0)) + F.coalesce(_number(c, minutes), F.lit(0)) + F.coalesce(_number(c, days) * 1440, F.lit(0))
    return F.nullif(total.cast("int"), F.lit(0))


def group_size(c: Column, from_to: str = FROM_TO, up_to: str = UP_TO) -> Column:
    """struct<min, max> of 'from n to m', or of 'to m' with a null min; null if neither stands there."""
    c = F.lower(c)
    low, high = (F.regexp_extract(c, from_to, i).try_cast("int") for i in (1, 2))
    most = F.regexp_extract(c, up_to, 1).try_cast("int")
    both = F.struct(low.alias("min"), high.alias("max"))
    return F.when(low.isNotNull() & high.isNotNull(), both).when(most.isNotNull(), F.struct(F.lit(None).cast("int").alias("min"), most.alias("max")))


def age_restriction(meta: Column, body: Column, pattern: str = AGE_FROM) -> Column:
    """'N+' from a meta value that is one, else from 'from N years' in the body; null if neither."""
    own = F.regexp_extract(meta, r"(\d+)\+", 1)
    other = F.regexp_extract(F.lower(body), pattern, 1)
    return F.when(own != "", F.concat(own, F.lit("+"))).when(other != "", F.concat(other, F.lit("+")))


def dates(c: Column, most: int = 50) -> Column:
    """Distinct dates 20YY-MM-DD of a text in order, the first `most`."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(20\d\d-\d\d-\d\d)")))), 1, most)


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def first_sentence(c: Column, least: int = 20, most: int = 200, fallback: Column | None = None) -> Column:
    """The first sentence of `least` characters or more, else the fallback (the text), cut at `most`."""
    found = F.get(F.filter(sentences(c), lambda s: F.length(s) >= least), F.lit(0))
    return F.left(F.coalesce(found, c if fallback is None else fallback), F.lit(most))


def longest(*cs: Column) -> Column:
    """The longest non-blank value, the first of equals; '' if all are blank or null."""
    all_ = F.array(*[F.struct(F.length(F.trim(c)).alias("n"), F.lit(-i).alias("i"), F.trim(c).alias("s")) for i, c in enumerate(cs)])
    best = F.array_max(F.filter(all_, lambda x: x["n"] > 0))
    return F.coalesce(best["s"], F.lit(""))


def short_description(c: Column, most: int = 200) -> Column:
    """The first line, trimmed; if longer than `most` it is cut there, and then at its last space."""
    line = F.trim(F.get(F.split(c, "\n"), F.lit(0)))
    cut = F.left(line, F.lit(most))
    at = F.length(cut) - F.coalesce(F.length(F.substring_index(cut, " ", -1)), F.lit(0))
    return F.when(F.length(line) <= most, line).when(F.locate(" ", cut) > 1, F.left(cut, at - 1)).otherwise(cut)


def tokens(c: Column) -> Column:
    """Lower-case words of letters and numbers; other signs part words like spaces do."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]+", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: t != "")


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct runs of k words, joined by spaces; none if there are fewer words.

    The words are bound to a lambda's variable, so that they are computed once and not for each run;
    the guard against short arrays is inside the expression, where no rule can move it.
    """

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        return F.when(F.size(w) >= k, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words), runs), F.lit(0))


def shingle_hashes(words: Column, k: int = 5) -> Column:
    """64-bit hashes of the distinct runs of k words, as shingles() has them, without their strings."""

    def runs(h: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, F.lit(k))))
        return F.when(F.size(h) >= k, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), runs), F.lit(0))


def topic_key(hint: Column, kind: Column, title: Column) -> Column:
    """The hint, lower-case and trimmed, or kind:first three title words if there is none."""
    words = F.slice(F.filter(F.split(F.lower(F.trim(title)), r"\s+"), lambda t: t != ""), 1, 3)
    return F.coalesce(F.nullif(F.trim(F.lower(hint)), F.lit("")), F.concat(kind, F.lit(":"), F.array_join(words, " ")))


def known_id(rule: Column, number: Column) -> Column:
    """The id of a rule's n-th generated case: synth_<rule>_<NNN>, of three digits at least."""
    n = number.cast("string")
    return F.concat(F.lit("synth_"), F.replace(F.lower(rule), F.lit("-"), F.lit("")), F.lit("_"), F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0")))


def truncated(c: Column, most: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def number_or_zero(c: Column) -> Column:
    """A number, or a string that is one, else 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def data_url(c: Column) -> Column:
    """struct<mime, base64> of a data URL, else null."""
    pattern = r"^data:([^;,]+);base64,(.+)$"
    return F.when(F.rlike(c, F.lit(pattern)), F.struct(F.regexp_extract(c, pattern, 1).alias("mime"), F.regexp_extract(c, pattern, 2).alias("base64")))


# Extensions of image types.
EXTENSIONS = {"image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/webp": "webp", "image/gif": "gif", "image/avif": "avif"}


def extension(mime: Column, fallback: str = "jpg") -> Column:
    """File extension of a MIME type, whose parameters don't count."""
    bare = F.lower(F.trim(F.get(F.split(mime, ";"), F.lit(0))))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), bare), F.lit(fallback))


def languages(c: Column, patterns: dict[str, str]) -> Column:
    """The languages whose pattern a text holds, in the order given."""
    return F.filter(F.array(*[F.when(F.rlike(c, F.lit(p)), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())


def excerpt(row: str, fields: list[str]) -> Column:
    """A struct of the named fields of a struct column."""
    return F.struct(*[F.col(f"{row}.{f}").alias(f) for f in fields])


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, in which a character outside the basic plane counts two."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")
