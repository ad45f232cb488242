"""Language identification of mixed-language texts.

Script ranges narrow the candidate languages of a word, letter trigrams score it under
each of them, and Viterbi with a penalty for each switch labels the words, so that a
text falls into spans of one language.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import map_text, returning
from .wordhash import binary, packs

#: First code points of blocks, and the script that their letters belong to.
RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
SCRIPTS = list(dict.fromkeys(s for _, s in RANGES))
MARK = 0x80
#: Buckets of letter trigrams.
BUCKETS = 1 << 16
#: Documents of each language that the model is fitted on, about; chosen by a hash of the id.
TRAIN_DOCS = 1500
#: What a change of language between two words costs, in nats.
SWITCH = 12.0
#: Share of a language's training words that a script must have to make the language a candidate for it.
SCRIPT_SHARE = 0.01
#: Score of a language that a word's script rules out.
RULED_OUT = -30.0
UNKNOWN = "und"
_CHARS = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """For each code point 0, or 1 and the number of the script of that letter or mark, with MARK added for a mark."""
    out = np.zeros(0x110000, np.uint8)
    starts = [a for a, _ in RANGES] + [0x110000]
    for (a, script), b in zip(RANGES, starts[1:], strict=True):
        out[a:b] = 1 + SCRIPTS.index(script)
    for c in (c for lo, hi in ((0, 0x323B0), (0xE0100, 0xE01F0)) for c in range(lo, hi)):
        kind = unicodedata.category(chr(c))[0]
        out[c] = out[c] if kind == "L" else out[c] | MARK if kind == "M" else 0
    out[0x323B0:0xE0100] = out[0xE01F0:] = 0
    return out


def _features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of a text's letters and marks, start of each word among them, script of each word (its last one's).

    A word is a run of letters and marks that has a letter.
    """
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    script = _letters()[np.minimum(code, 0x10FFFF)]
    at = np.flatnonzero(script)
    letter = script[at] < MARK
    if len(at) and not letter.all():
        word = np.cumsum(script[at - 1] == 0) - 1
        bare = np.bincount(word, letter) == 0
        script[at[bare[word]]] = 0
        at = np.flatnonzero(script)
        script &= MARK - 1
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.where(script > 0, code, 32).astype(np.uint32)
    h = (code[at - 1] * np.uint32(0x9E3779B1)) ^ (code[at] * np.uint32(0x85EBCA77) + (code[at + 1] * np.uint32(0xC2B2AE3D) >> np.uint32(7)))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    starts = np.flatnonzero(script[at - 1] == 0)
    ends = np.append(starts[1:], len(at)) - 1
    return (h >> np.uint32(16)).astype(np.int64), starts, script[at[ends]].astype(np.int64) - 1


class Model:
    """Log-probabilities of trigrams by language, and the candidates of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, switch: float = SWITCH) -> None:
        """counts: languages x BUCKETS; scripts: languages x len(SCRIPTS), in words."""
        self.langs, self.switch = langs, switch
        smooth = counts + 0.5
        self.table = np.ascontiguousarray((np.log(smooth) - np.log(smooth.sum(1, keepdims=True))).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.candidates = (share >= SCRIPT_SHARE).T
        self.ruled = np.where(self.candidates, 0, RULED_OUT).astype(np.float32)
        self.ruled[~self.candidates.any(1)] = 0
        self.common = int(scripts.sum(1).argmax()) if len(langs) else 0

    def scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (words x languages), relative to each word's best candidate; letters of each word; whether its script has candidates."""
        out, sizes, known = [], [], []
        step = max(1 << 12, _CHARS // max(1, len(self.langs) // 4))
        for part in _parts(text, step):
            buckets, starts, script = _features(part)
            if not len(starts):
                continue
            got = np.add.reduceat(self.table[buckets], starts, axis=0) + self.ruled[script]
            seen = self.candidates[script].any(1)
            got[~seen] = 0
            out.append(got - got.max(1, keepdims=True))
            sizes.append(np.diff(np.append(starts, len(buckets))))
            known.append(seen)
        if not out:
            return np.empty((0, len(self.langs)), np.float32), np.empty(0, np.int64), np.empty(0, bool)
        return np.concatenate(out), np.concatenate(sizes), np.concatenate(known)

    def _one_language(self, s: np.ndarray) -> int | None:
        """The language of the whole best path, if it can be proven without the recursion.

        Leaving language k for words i to j gains at most the sum over them of the best other
        score less k's, and costs a switch each way (one at either end of the text).
        """
        k = int(s.sum(0).argmax())
        if s.shape[1] == 1:
            return k
        gain = np.delete(s, k, 1).max(1) - s[:, k]
        total = np.concatenate([[0.0], np.cumsum(gain, dtype=np.float64)])
        inner = (total - np.minimum.accumulate(total)).max()
        ends = max(total.max(), total[-1] - total.min())
        return k if inner <= 2 * self.switch and ends <= self.switch else None

    def viterbi(self, s: np.ndarray) -> np.ndarray:
        """The language of each word on the best path."""
        if (k := self._one_language(s)) is not None:
            return np.full(len(s), k)
        stay = np.zeros(s.shape, bool)
        best = np.empty(len(s), np.int64)
        d = np.zeros(s.shape[1])
        for i, row in enumerate(s):
            top = best[i] = d.argmax()
            rest = d[top] - self.switch
            stay[i] = d >= rest
            d = np.maximum(d, rest) + row
            d -= d.max()
        path = np.empty(len(s), np.int64)
        k = int(d.argmax())
        for i in range(len(s) - 1, -1, -1):
            path[i] = k
            if not stay[i, k]:
                k = int(best[i])
        return path

    def label(self, text: str) -> tuple[str, float, list[dict]]:
        """Language with the most letters on the best path, its share of the letters, spans (in words)."""
        s, sizes, known = self.scores(text)
        if not len(s) or not self.langs:
            return UNKNOWN, 0.0, []
        if not known.any():
            return self.langs[self.common], 0.0, [{"start": 0, "end": len(s), "lang": self.langs[self.common]}]
        path = self.viterbi(s)
        mass = np.bincount(path, sizes, len(self.langs))
        k = int(mass.argmax())
        edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]]).tolist()
        spans = [{"start": a, "end": b, "lang": self.langs[path[a]]} for a, b in zip(edges, edges[1:], strict=False)]
        return self.langs[k], float(mass[k] / sizes.sum()), spans


def _parts(text: str, step: int) -> Iterator[str]:
    """Parts of step characters or so, cut at spaces; a longer word is cut anywhere."""
    at = 0
    while at < len(text):
        end = at + step
        if end < len(text) and (gap := text.rfind(" ", at, end)) > at:
            end = gap
        yield text[at:end]
        at = end


def fit(docs: DataFrame, train: Column, per_lang: int = TRAIN_DOCS, text: str = "text", lang: str = "lang", by: str = "doc_id") -> Model:
    """Fits a model on about `per_lang` whole documents of each language among the rows where `train` holds.

    The documents are chosen by a hash of `by`; rows of null language or text don't count. Without
    such rows the model knows no language and labels every text `und`. Trigrams are counted in the
    tasks and summed by language and bucket; what reaches the driver is languages x buckets at most.
    """
    ship(docs.sparkSession)
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang).cast("string")).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS))))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, per_lang / sizes[k])])
    draw = F.pmod(F.xxhash64(F.col(by), F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    picked = rows.where(draw < F.element_at(share, F.col(lang).cast("string")))
    n = len(langs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, scripts = np.zeros((n, BUCKETS), np.int64), np.zeros((n, len(SCRIPTS)), np.int64)
        index = {k: i for i, k in enumerate(langs)}
        for batch in batches:
            texts, names = binary(batch.column(0)), batch.column(1).to_pylist()
            for lo, hi in packs(texts, 1 << 20):
                for t, k in zip(texts[lo:hi], names[lo:hi], strict=True):
                    for part in _parts(t.decode("utf-8", "replace"), _CHARS):
                        buckets, _, script = _features(part)
                        counts[index[k]] += np.bincount(buckets, minlength=BUCKETS)
                        scripts[index[k]] += np.bincount(script, minlength=len(SCRIPTS))
        both = np.concatenate([counts, scripts], 1)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both[i, j], pa.int64())], names=["lang", "bucket", "n"])

    found = picked.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(returning(count), "lang int, bucket int, n long")
    both = np.zeros((n, BUCKETS + len(SCRIPTS)))
    got = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    both[got["lang"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, both[:, :BUCKETS], both[:, BUCKETS:])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns, lang_pred string, score double, spans array<struct<start, end, lang>> (words).

    `lang_pred` is `und` with score 0 and no spans if the text is null or without letters, or if the
    model knows no language. A text whose scripts were in no training text gets the commonest
    language with score 0. Whole texts are labelled, in one pass and without a shuffle; the model's
    size depends on the number of languages alone.
    """

    def factory():
        _letters()

        def kernel(texts):
            found = [model.label((t or b"").decode("utf-8", "replace")) for t in texts]
            return [f[0] for f in found], pa.array([f[1] for f in found], pa.float64()), [f[2] for f in found]

        return kernel

    return map_text(docs, "lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>", factory, text, keep)


def held_out(by: str = "doc_id") -> Column:
    """The fold that is kept from training: ids whose checksum leaves 2 when divided by 4. Null ids are not in it."""
    return F.coalesce(F.pmod(F.crc32(F.col(by).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
