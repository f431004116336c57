"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes homoglyphs and digit substitutions, the lexicon's entries are whole
words and word beginnings with log-odds weights, exception phrases match longer
than the entries they excuse, and the sum is set against the text's length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphweave.llm.labelled import SAMPLE_ROWS, labelled_sample
from glyphweave.llm.workspace import written

#: Look-alike letters, digits and signs, and what they stand for.
#: i, l, 1, ! and | share one letter, since each is written for the others.
_LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n",
    "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "г": "r",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "κ": "k", "τ": "t", "ι": "i", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
}
_FOLD = str.maketrans(_LOOKS | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | dict.fromkeys("​‌‍⁠﻿­", ""))
_FOLD[ord("ｌ")] = "i"
_WORD = re.compile(r"[^\W_]+")
_EDGE_SIGNS = re.compile(r"(?<!\w)[@$!|]+|[@$!|]+(?!\w)")
PREFIXES = range(3, 11)
#: Bits of the cells that candidate entries are hashed to, to leave other entries of clean texts out early.
CELL_BITS = 22


def folded_words(text: str | None) -> list[str]:
    """Words of a text after folding. Signs stand for letters only inside a word."""
    if not text:
        return []
    return _WORD.findall(_EDGE_SIGNS.sub(" ", text.lower()).translate(_FOLD))


@dataclass(frozen=True)
class Lexicon:
    """weights: entries ("word" or "begin*") to log-odds; exceptions: phrases that excuse what they hold."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: tuple[float, float, float] = (-4.0, 1.0, 1.0)


def _entries(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if k < len(word) + 1)]


def _pattern(entry: str) -> str:
    """Words are laid out as ' a  b  c ', so an entry starts at a space and a whole word ends at one."""
    return f" {entry[:-1]}" if entry.endswith("*") else f" {entry} "


@lru_cache(maxsize=8)
def _automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry, weight in entries:
        pattern = _pattern(entry)
        if weight > found.get(pattern, -1.0):
            found.add_word(pattern, weight)
    for phrase in exceptions:
        if words := folded_words(phrase):
            found.add_word("".join(f" {w} " for w in words), 0.0)
    if len(found):
        found.make_automaton()
    return found


def matches(words: list[str], automaton) -> float:
    """Weights of the leftmost longest entries; an exception phrase, being longer, takes their place."""
    if not words or not len(automaton):
        return 0.0
    laid = " " + "  ".join(words) + " "
    return float(sum(w for _, w in automaton.iter_long(laid)))


def _cells(entries: DataFrame) -> np.ndarray:
    """A bit for each cell that holds one of the entries."""
    cells = entries.select(F.crc32(F.col("entry").cast("binary")).bitwiseAND(F.lit((1 << CELL_BITS) - 1)).alias("cell")).distinct()
    bits = np.zeros(1 << CELL_BITS, bool)
    bits[cells.toArrow()["cell"].to_numpy()] = True
    return np.packbits(bits)


def _gather(sample: DataFrame, label: int, cells: np.ndarray | None = None) -> DataFrame:
    """(entry, contexts): in how many distinct neighbourhoods each entry stands in texts of one label.

    Copies repeat their neighbourhoods, so groups of near copies count once. With `cells`,
    entries of other cells are left out.
    """
    shared = sample.sparkSession.sparkContext.broadcast(cells)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if shared.value is None else np.unpackbits(shared.value).tobytes()
        for batch in batches:
            found, cut = set(), {}
            for text in batch.column("text").to_pylist():
                words = folded_words(text)
                for before, word in zip([""] + words, words, strict=False):
                    if word not in cut:
                        cut[word] = [e for e in _entries(word) if held is None or held[zlib.crc32(e.encode()) & ((1 << CELL_BITS) - 1)]]
                    found.update((e, before) for e in cut[word])
            yield pa.RecordBatch.from_arrays(
                [pa.array([e for e, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=["entry", "before"]
            )

    pairs = sample.where(F.col("label") == label).select("text").mapInArrow(entries, "entry string, before string")
    return pairs.groupBy("entry").agg(F.countDistinct("before").alias("contexts"))


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn weights and the score's slope from at most `rows` labelled documents where `usable` holds.

    An entry needs MIN distinct contexts in toxic texts and a lower bound of its
    log-odds (1.64 standard errors) above 1.5. Whole words under an entry that are
    commoner in clean texts become exceptions, and so do an entry's word and the word
    beside it where that pair is surely commoner in clean texts. Without both labels
    the lexicon is empty.
    """
    sample = written(labelled_sample(docs, labels, "toxic", usable, rows), "toxicity-sample")
    toxic = written(_gather(sample, 1).where("contexts >= 3"), "toxicity-candidates")
    if toxic.isEmpty():
        return Lexicon({}, (), (-4.0, 0.0, 0.0))
    clean = _gather(sample, 0, _cells(toxic)).withColumnRenamed("contexts", "clean")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.sum(F.length("text")).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    a, b = F.col("contexts") + 0.5, F.col("clean") + 0.5
    bound = F.log(a / n1) - F.log(b / n0) - 1.64 * F.sqrt(1 / a + 1 / b)
    counted = toxic.join(clean, "entry", "left").fillna(0, ["clean"]).withColumn("telling", bound > 1.5)
    whole = F.col("contexts") / n1 < F.col("clean") / n0
    counted = written(counted.withColumn("excusable", ~F.col("telling") & ~F.col("entry").endswith("*") & (F.col("clean") >= 3) & whole), "toxicity-counted")
    telling = counted.where("telling").orderBy(F.desc("contexts"), "entry").collect()
    weights = {r["entry"]: float(np.log((r["contexts"] + 0.5) / n1) - np.log((r["clean"] + 0.5) / n0)) for r in telling}
    begins = F.transform(F.sequence(F.lit(PREFIXES[0]), F.least(F.length("entry"), F.lit(PREFIXES[-1]))), lambda k: F.concat(F.col("entry").substr(F.lit(1), k), F.lit("*")))
    words = counted.where(F.col("excusable") & (F.length("entry") >= PREFIXES[0])).select(F.col("entry").alias("word"), F.explode(begins).alias("entry"))
    under = words.join(counted.where("telling").select("entry"), "entry", "left_semi").select("word").distinct()
    excused = tuple(sorted(r["word"] for r in under.collect())) + _excused_phrases(sample, frozenset(weights))
    measured = _measured(sample, weights, excused).collect()
    x = np.array([(r["total"], r["words"]) for r in measured], float).reshape(-1, 2)
    y = np.array([r["label"] for r in measured], float)
    return Lexicon(weights, excused, _fit_slope(x, y))


def _excused_phrases(sample: DataFrame, telling: frozenset[str]) -> tuple[str, ...]:
    """Pairs of neighbouring words, one of which an entry matches, whose upper bound of log-odds of texts (1.64 standard errors) is below 0."""
    shared = sample.sparkSession.sparkContext.broadcast(telling)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, known = shared.value, {}
        for batch in batches:
            found: list[str] = []
            labels: list[int] = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words, mine = folded_words(text), set()
                for k, word in enumerate(words):
                    if word not in known:
                        known[word] = any(e in entries for e in _entries(word))
                    if known[word]:
                        mine.update(" ".join(words[a : a + 2]) for a in (k - 1, k) if 0 <= a < len(words) - 1)
                found += mine
                labels += [label] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels, pa.int32())], names=["phrase", "label"])

    sizes = sample.agg(F.sum("label").alias("toxic"), F.count("*").alias("every")).first()
    n1, n0 = (sizes["toxic"] or 0) + 1, sizes["every"] - (sizes["toxic"] or 0) + 1
    counted = sample.mapInArrow(pairs, "phrase string, label int").groupBy("phrase").agg((F.sum("label") + 0.5).alias("a"), (F.sum(1 - F.col("label")) + 0.5).alias("b"))
    bound = F.log(F.col("a") / n1) - F.log(F.col("b") / n0) + 1.64 * F.sqrt(1 / F.col("a") + 1 / F.col("b"))
    return tuple(sorted(r["phrase"] for r in counted.where(bound < 0).select("phrase").collect()))


def _measured(sample: DataFrame, weights: dict[str, float], exceptions: tuple[str, ...]) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast((tuple(weights.items()), exceptions))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(*shared.value)
        for batch in batches:
            words = [folded_words(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([matches(w, automaton) for w in words], pa.float64()), pa.array([len(w) for w in words], pa.int64()), batch.column("label")],
                names=["total", "words", "label"],
            )

    return sample.mapInArrow(measure, "total double, words long, label int")


def _signals(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the score is made of: one, the weight per hundred words, and the weight's logarithm."""
    density = 100 * total / np.maximum(words, 20)
    return np.stack([np.ones(len(total)), np.minimum(density, 20), np.log1p(total)], axis=1)


def _fit_slope(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """A ridged logistic fit by Newton steps; slopes never fall below zero."""
    if len(np.unique(y)) < 2:
        return (-4.0, 0.5, 0.5)
    s, beta = _signals(x[:, 0], x[:, 1]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(s @ beta, -30, 30)))
        ridge = np.diag([1e-3, 0.1, 0.1])
        step = np.linalg.solve((s * (p * (1 - p))[:, None]).T @ s + ridge, s.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
    return (float(beta[0]), max(float(beta[1]), 0.0), max(float(beta[2]), 0.0))


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """Add score (double, 0 to 1), predicted (1 if score >= threshold) to every row of `docs`.

    Only the text is looked at; null and empty texts get the lexicon's score for no
    match. Columns named score or predicted are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*rest, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        automaton = _automaton(tuple(lex.weights.items()), lex.exceptions)
        for batch in batches:
            totals, counts = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            texts = batch.column("text")
            for k in range(batch.num_rows):
                words = folded_words(texts[k].as_py())
                totals[k], counts[k] = matches(words, automaton), len(words)
            s = 1 / (1 + np.exp(-np.clip(_signals(totals, counts) @ np.array(lex.slope), -30, 30)))
            new = {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return rows.mapInArrow(add, rows.schema)
