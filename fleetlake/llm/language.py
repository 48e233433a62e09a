"""Language identification of mixed text: scripts narrow the candidates, Viterbi labels the words.

Learning: character trigram statistics of each language from a bounded, value-hashed sample of labelled rows (``per_language``
rows of every language or so, whole texts). A word's score for a language is the log-likelihood of its trigrams in that
language; languages that were never seen with the word's script are out, unless no language was. The best sequence of labels pays
``penalty`` for every change of language. Labels are merged to spans of code points (from a word's first letter to the last word's end).

A text is labelled by its best single language at once if no run of another language gains more than the penalty, and no first and last
run together: n runs cost n - 1 penalties, and so no labelling is better. Ties go to the first language in order.

Combining marks belong to the words of their letters. Null texts and texts without a letter have no spans and the label ``und`` with score 0. Rows without text or language are not learnt
from; without any learnt language every text is ``und``. Repeated rows give repeated results. Only named columns are returned.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import documents, fold, mixed, slices, uniform

UNKNOWN = "und"
FEW_LANGUAGES = 10_000
MOST_LANGUAGES = 400  # a model has 256 KB for each: 100 MB
BITS = 16
WORDS = re.compile(r"[^\W\d_]+")


def mark_ranges() -> str:
    """The combining marks of Unicode as ranges of a character class: vowel signs and accents that belong to the letter before them."""
    marks = [i for i in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "M"]
    edges = [(a, b) for a, b in zip([-2, *marks], [*marks, -2]) if b != a + 1]
    return "".join(f"{chr(b)}-{chr(c)}" for (_, b), (c, _) in zip(edges, edges[1:]))


MARK = re.compile(f"[{mark_ranges()}]")
MARKED_WORDS = re.compile(f"(?:[^\\W\\d_]+[{mark_ranges()}]*)+")
# First code points of the ranges of scripts (name, start, end), by the Unicode blocks.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x2FA1F),
)
NAMES = sorted({n for n, _, _ in SCRIPTS})


def word_pattern(text: str) -> re.Pattern:
    """Words of letters; in texts that hold combining marks, of letters and marks."""
    return WORDS if text.isascii() or not MARK.search(text) else MARKED_WORDS


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Script number of each code point, by range; len(NAMES) for any other."""
    spans = sorted((a, b, NAMES.index(n)) for n, a, b in SCRIPTS)
    starts, ends, which = (np.array(x, np.int64) for x in zip(*spans))
    at = np.searchsorted(starts, points, side="right") - 1
    inside = (at >= 0) & (points <= ends[np.maximum(at, 0)])
    return np.where(inside, which[np.maximum(at, 0)], len(NAMES))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words (bounded by blanks), the word each is of, and each word's script."""
    text = "".join(f"  {w} " for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths + 3)
    owner = np.repeat(np.arange(len(words)), lengths + 3)
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    a, b, c = points[inside], points[inside + 1], points[inside + 2]
    cell = mixed(mixed((a * 0x110000 + b).astype(np.uint64)) + c.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    return cell.astype(np.int64), owner[inside], scripts_of(points[ends - lengths - 1])


def learn(sample: list[tuple[str, str]], smooth: float = 0.02) -> dict:
    """Tables of a model from (language, text) pairs: a fixed 2^16 cells for each language."""
    langs = sorted({lang for lang, _ in sample})
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages make a model beyond {MOST_LANGUAGES} languages (100 MB)")
    table = np.zeros((1 << BITS, len(langs)), np.float32)
    uses = np.zeros((len(NAMES) + 1, len(langs)), bool)
    for j, lang in enumerate(langs):
        counts = np.zeros(1 << BITS)
        script = np.zeros(len(NAMES) + 1)
        for _, text in (x for x in sample if x[0] == lang):
            words = word_pattern(text).findall(text.lower())
            if words:
                cells, _, scripts = trigrams(words)
                counts += np.bincount(cells, minlength=1 << BITS)
                script += np.bincount(scripts, minlength=len(script))
        table[:, j] = np.log((counts + smooth) / (counts.sum() + smooth * (1 << BITS)))
        uses[:, j] = script >= 0.01 * max(script.sum(), 1)
    return {"langs": langs, "table": table, "uses": uses}


class Labeller:
    def __init__(self, model: dict, penalty: float = 12.0, most: int = 200_000):
        self.m, self.penalty, self.most = model, penalty, most
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.m["langs"])), np.float32)
        self.sizes = np.zeros(1 << 12)

    def learn_words(self, words: list[str]) -> None:
        first = len(self.slot)
        tri, owner, script = trigrams([w.lower() for w in words])
        while first + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sizes[first : first + len(words)] = [len(w) for w in words]
        cells = self.m["table"][tri]
        sums = np.add.reduceat(cells, np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), axis=0)
        allowed = self.m["uses"][script]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        sums = np.where(allowed, sums, -1e4)
        self.scores[first : first + len(words)] = sums - sums.max(axis=1, keepdims=True)
        self.slot.update(zip(words, range(first, first + len(words))))

    def labels(self, scores: np.ndarray) -> np.ndarray:
        """The best language of every word."""
        n, k = scores.shape
        best = int(scores.sum(axis=0, dtype=np.float64).argmax())
        gain = np.cumsum(scores.astype(np.float64) - scores[:, best : best + 1], axis=0)
        lowest = np.minimum.accumulate(np.concatenate([np.zeros((1, k)), gain[:-1]]), axis=0)
        ends = max(0.0, gain.max()) + max(0.0, (gain[-1] - lowest[-1]).max())
        if (gain - lowest).max() <= self.penalty and ends <= self.penalty:
            return np.full(n, best)
        rows, back, penalty = scores.tolist(), [], self.penalty
        value = rows[0]
        for row in rows[1:]:
            top = max(value)
            lead, floor = value.index(top), top - penalty
            back.append([lead if v < floor else i for i, v in enumerate(value)])
            value = [(floor if v < floor else v) + s for v, s in zip(value, row)]
        at = value.index(max(value))
        path = [at]
        for step in reversed(back):
            at = step[at]
            path.append(at)
        return np.array(path[::-1])

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """Spans (start, end, language number) of a text and the letters of each language."""
        k = len(self.m["langs"])
        if not k:
            return [], np.zeros(0)
        pattern = word_pattern(text)
        words = pattern.findall(text)
        # The pattern also takes numeric signs; a text has to hold a letter.
        if not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
            return [], np.zeros(k)
        if len(self.slot) > self.most:
            self.forget()
        fresh = [w for w in dict.fromkeys(words) if w not in self.slot]
        if fresh:
            self.learn_words(fresh)
        slot = self.slot
        slots = np.array([slot[w] for w in words])
        labels = self.labels(self.scores[slots])
        letters = np.bincount(labels, weights=self.sizes[slots], minlength=k)
        found = list(pattern.finditer(text)) if labels.min() != labels.max() else [pattern.search(text)]
        if len(found) == 1:
            end = text.rfind(words[-1]) + len(words[-1])
            return [(found[0].start(), end, int(labels[0]))], letters
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(words)]
        return [(found[a].start(), found[b - 1].end(), int(labels[a])) for a, b in zip(cuts, cuts[1:])], letters


def sample_of(rows: DataFrame, lang: str, text: str, per_language: int, key: str = "doc_id") -> list[tuple[str, str]]:
    """About ``per_language`` labelled texts of each language and at most twice as many, chosen by a hash of key and text.

    A language may hold most rows, so the shares go to the texts; only beyond FEW_LANGUAGES names do both meet in a shuffle. Copies of a text
    are drawn row by row; rows equal in key and text are drawn together, which the limit bounds.
    """
    known = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h")).where("lang is not null and text is not null")
    counts = known.groupBy("lang").count().select("lang", (F.lit(float(per_language)) / F.col("count")).alias("share"))
    few = counts.limit(FEW_LANGUAGES + 1).count() <= FEW_LANGUAGES
    chosen = known.join(F.broadcast(counts) if few else counts, "lang").where(uniform("h") < F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    bounded = chosen.withColumn("place", place).where(F.col("place") <= 2 * per_language)
    return [(r["lang"], r["text"]) for r in bounded.select("lang", "text").toLocalIterator()]


def identify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", penalty: float = 12.0) -> DataFrame:
    """(key, lang_pred, score, spans): the language with most letters, its share of all letters, and all labelled spans."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    tables = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 cells for each language
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        labeller = Labeller(tables.value, penalty)
        langs = tables.value["langs"]
        for batch in batches:
            for part in slices(batch):
                names, scores, spans = [], [], []
                for t in part.column("text").to_pylist():
                    found, letters = labeller.spans(t or "")
                    total = float(letters.sum()) if found else 0.0
                    names.append(langs[int(letters.argmax())] if total else UNKNOWN)
                    scores.append(float(letters.max()) / total if total else 0.0)
                    spans.append([{"start": a, "end": b, "lang": langs[j]} for a, b, j in found])
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(names), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["k", "lang_pred", "score", "spans"])

    schema = f"k {rows.schema['k'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


PER_LANGUAGE = 300


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("rest", fold("doc_id", 4))
    model = learn(sample_of(docs.where("rest <> 2"), "lang", "text", PER_LANGUAGE))
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
