"""Language identification (operator 5): scripts narrow the candidates, and Viterbi labels spans of mixed text.

A word's score for a language sums log-probabilities of its letters, pairs and triples of letters. Going over the words,
another language costs a fixed penalty, so a path through the words changes language only where that pays. Documents of a
batch take each step together; words that a task has scored are kept in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices

#: Documents of a language that the model learns from, as an expectation: a sample by hash, over whole texts.
DOCS_PER_LANGUAGE = 3000
#: Bins of hashed letter sequences for each length. Every language is learned: where there are more than MANY, bins are halved
#: for each doubling, down to LEAST_BINS, so that the model has at most 3 * MANY * BINS numbers up to 8192 languages.
BINS, MANY, LEAST_BINS = 1 << 14, 128, 1 << 8
#: A switch of language costs this much; overlapping sequences count each letter thrice, so scores are scaled.
PENALTY, SCALE = 10.0, 0.4
#: A language is a candidate for a script if at least this share of its letters has it; others lose so much a word.
SCRIPT_SHARE, OTHER_SCRIPT = 0.01, 30.0
#: Words that a task keeps, words whose path is searched at a time, and records in a batch.
KEPT_WORDS, CELLS, RECORDS = 150_000, 1 << 22, 1024
#: Words that are scored at a time, and bytes of texts in a batch: letters take a hundred bytes or so each on the way.
WORDS, BYTES = 20_000, 2 << 20
#: Type of a language number in paths.
STATE = "int16"
UNKNOWN = "und"
#: Least share of letters in the language that a kept document has.
LEAST_SHARE = 0.3
#: First code point of each script's ranges (fixed values of Unicode blocks); what comes after the last is the last.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE80, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
]
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_STARTS = np.array([s for s, _ in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


def bins_for(languages: int) -> int:
    """Bins for a number of languages."""
    return max(LEAST_BINS, BINS >> max(0, -(-languages // MANY) - 1).bit_length())


def features(words: list[str], size: int = BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of all words, lower-cased: the number of its word, its three bins, its script. Other characters part words."""
    line = "\0".join(["", *words, ""])
    if line.count("\0") > len(words) + 1:
        line = "\0".join(["", *(w.replace("\0", " ") for w in words), ""])
    codes = np.frombuffer(line.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype("int64")
    # Lower-casing never makes or removes a NUL, so word numbers follow the NULs between words.
    word = np.cumsum(codes == 0) - 1
    codes = np.where(_letters()[codes], codes, 0)
    i = np.nonzero(codes)[0]
    one, before, after = codes[i], codes[i - 1], codes[i + 1]
    mix = lambda x: ((x * 0x9E3779B1) >> 15) % size
    bins = np.stack([mix(one + 1), size + mix(before * 0x1F123 + one), 2 * size + mix((before * 0x1F123 + one) * 0x2545F + after)], 1)
    return word[i], bins, _SCRIPT_OF[np.searchsorted(_STARTS, one, "right") - 1]


@dataclass
class Model:
    """Languages, log-probabilities by bin and language, candidate languages by script, and the scripts that some language uses."""

    languages: list[str]
    logs: np.ndarray
    candidates: np.ndarray
    used: np.ndarray

    @property
    def bins(self) -> int:
        return len(self.logs) // 3

    @staticmethod
    def of(languages: list[str], counts: np.ndarray) -> Model:
        """From counts by language and bin; the last bins are those of scripts."""
        parts, size = [], (counts.shape[1] - len(SCRIPT_NAMES)) // 3
        for k in range(3):
            c = counts[:, k * size : (k + 1) * size].astype("float64") + 0.1
            parts.append(np.log(c / c.sum(1, keepdims=True)))
        scripts = counts[:, 3 * size :].astype("float64")
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        candidates = (share >= SCRIPT_SHARE).T
        used = candidates.any(1)
        candidates[~used] = True
        logs = np.concatenate(parts, 1).T
        return Model(languages, (SCALE * (logs - logs.max(1, keepdims=True, initial=-np.inf))).astype("float32"), candidates, used)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by word and language; letters by word; and of these the ones of a script that some language uses."""
        word, bins, script = features(words, self.bins)
        n, k = len(words), len(self.languages)
        letters = np.bincount(word, minlength=n)
        by_letter = self.logs[bins].sum(1) - OTHER_SCRIPT * ~self.candidates[script]
        out = np.empty((n, k), "float32")
        for j in range(k):
            out[:, j] = np.bincount(word, by_letter[:, j], minlength=n)
        return out, letters, np.bincount(word[self.used[script]], minlength=n)


def counts_of(texts: Iterator[tuple[str, str]], languages: list[str]) -> np.ndarray:
    """Counts by language and bin of labelled texts, and by script."""
    size, place = bins_for(len(languages)), {x: i for i, x in enumerate(languages)}
    out = np.zeros((len(languages), 3 * size + len(SCRIPT_NAMES)), "int64")
    for language, text in texts:
        row = out[place[language]]
        words = text.split()
        for at in range(0, len(words), 100_000):
            _, bins, script = features(words[at : at + 100_000], size)
            row += np.bincount(bins.ravel(), minlength=out.shape[1])
            row[3 * size :] += np.bincount(script, minlength=len(SCRIPT_NAMES))
    return out


def viterbi(scores: np.ndarray, rows: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """For each document (the rows of `scores` of its words) the best path: a language for each word. Ties go to the first."""
    k, out = scores.shape[1], [np.zeros(0, STATE)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: -len(rows[i]))
    at = 0
    while at < len(order):
        n = max(1, CELLS // (len(rows[order[at]]) * k))
        group, at = order[at : at + n], at + n
        lengths = np.array([len(rows[i]) for i in group])
        steps = int(lengths[0])
        words = np.zeros((steps, len(group)), "int64")
        for j, i in enumerate(group):
            words[: lengths[j], j] = rows[i]
        active = np.searchsorted(-lengths, -np.arange(steps), "left")  # documents with a word at this step come first
        came = np.empty((steps, len(group), k), STATE)
        own = np.arange(k, dtype=STATE)
        best = np.zeros((len(group), k), "float32")
        for t in range(steps):
            m = active[t]
            now = best[:m]
            if t:
                top = now.argmax(1)
                other = now[np.arange(m), top][:, None] - penalty
                switch = other > now
                came[t, :m] = np.where(switch, top[:, None], own)
                now = np.where(switch, other, now)
            now = now + scores[words[t, :m]]
            best[:m] = now - now.max(1, keepdims=True)
        path = np.zeros((steps, len(group)), STATE)
        state = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            path[t, :m] = state[:m]
            if t:
                state[:m] = came[t, np.arange(m), state[:m]]
        for j, i in enumerate(group):
            out[i] = path[: lengths[j], j]
    return out


class Labeller:
    """A task's model with the words that it has scored; it goes with the task, as idle workers would add up."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.scores = np.zeros((0, len(model.languages)), "float32")
        self.letters, self.fit = np.zeros(0, "int64"), np.zeros(0, "int64")

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, share of letters that are in it and of a script that some language uses, and spans of every text."""
        split = [(t or "").split() for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.__init__(self.model)
        new = list({w for words in split for w in words if w not in self.known})
        if new:
            parts = [self.model.scores(new[at : at + WORDS]) for at in range(0, len(new), WORDS)]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores, self.letters, self.fit = (np.concatenate([have, *more]) for have, more in zip((self.scores, self.letters, self.fit), zip(*parts)))
        get = self.known.__getitem__
        rows = [np.fromiter(map(get, words), "int64", len(words)) for words in split]
        k = len(self.model.languages)
        out = []
        for text, row, path in zip(texts, rows, viterbi(self.scores, rows) if k else [[]] * len(rows)):
            letters = np.bincount(path, self.letters[row], minlength=k) if k and len(row) else np.zeros(max(k, 1))
            if not letters.any():
                out.append((UNKNOWN, 0.0, []))
                continue
            top = int(letters.argmax())
            share = float(np.bincount(path, self.fit[row], minlength=k)[top] / letters.sum())
            out.append((self.model.languages[top], share, self.spans(text, path)))
        return out

    def spans(self, text: str, path: np.ndarray) -> list[tuple[int, int, str]]:
        """Runs of words of one language as (start, end, language) in code points, from the text's begin to its end."""
        turns = np.nonzero(np.diff(path))[0] + 1
        if not len(turns):
            return [(0, len(text), self.model.languages[path[0]])]
        starts = [m.start() for m in re.finditer(r"\S+", text)]
        cuts = [0, *(starts[t] for t in turns), len(text)]
        return [(a, b, self.model.languages[path[t]]) for a, b, t in zip(cuts, cuts[1:], [0, *turns])]


def remainder(key: str) -> Column:
    """crc32 of the key as text, modulo 4; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of every language of the labelled documents that aren't held out. Only counts by language and bin come to the driver.

    Null texts and null languages teach nothing, repeated rows count as often as they come, and a table without a labelled
    document gives a model without languages. A language's sample goes by a hash of key and text, and covers whole texts.
    """
    own = docs.filter((remainder(key) != 2) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.col(text).alias("text"))
    found = sorted((r["lang"], r["count"]) for r in own.groupBy("lang").count().collect())
    languages = [x for x, _ in found]
    size = bins_for(len(languages))
    counts = np.zeros((len(languages), 3 * size + len(SCRIPT_NAMES)), "int64")
    if not languages:
        return Model.of([], counts)
    # One row a language, so it may be broadcast.
    rates = docs.sparkSession.createDataFrame([(x, min(1_000_000, 1_000_000 * DOCS_PER_LANGUAGE // n + 1)) for x, n in found], "lang string, rate int")
    sample = own.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000)) < F.col("rate"))

    def run(batches: Iterator[pa.RecordBatch]):
        total = sum((counts_of(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), languages) for b in slices(batches, RECORDS)), 0)
        if isinstance(total, np.ndarray):
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (i, j, total[i, j])], ["lang", "bin", "n"])

    sums = sample.select("lang", "text").mapInArrow(run, "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts[sums["lang"].to_numpy(), sums["bin"].to_numpy()] = sums["n"].to_numpy()
    return Model.of(languages, counts)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score, spans: a row for each row.

    `und`, score 0 and no spans for a null text, a text without letters, or a model without languages. Repeated rows get the
    same, an empty table gives an empty one; other columns are left out and have no part in a prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    schema = T.StructType(
        [docs.schema[key], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]
    )
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]):
        labeller = Labeller(shared.value)
        for b in slices(batches, RECORDS, BYTES):
            got = labeller.label(b.column(2).to_pylist())
            spans = [[dict(zip(("start", "end", "lang"), s)) for s in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(spans, spans_type)], schema.names)

    return docs.select(F.col(key), (remainder(key) == 2).alias("held_out"), F.col(text).alias("__text")).mapInArrow(run, schema)


def kept_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with a known language that holds for at least LEAST_SHARE of their letters, with the columns of `docs`.

    Letters of a script that no learned language uses hold for none, so a text in another script goes, as do null texts and texts
    without letters. Repeated rows stay or go together, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]):
        labeller = Labeller(shared.value)
        for b in slices(batches, RECORDS, BYTES, place):
            yield b.filter(pa.array([lang != UNKNOWN and share >= LEAST_SHARE for lang, share, _ in labeller.label(b.column(place).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs))


QUERIES = {"op5_language": op5_language}
