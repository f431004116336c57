"""Collocations: frequent phrases by contiguous pattern growth, scored by their weakest cut.

A first pass counts words, a second one hashes pairs of neighbours to learn which of
them can be frequent at all. The third projects the corpus: each occurrence of a
possible pair becomes a pointer row of the words that follow it, as far as they can
be frequent. Pointers of a prefix of two words meet in one task, sorted, which extends
the prefix to the right depth first. Equal pointers are added up before, in the task
that reads them and again by Spark, so a pair that fills a third of the corpus brings
no more rows to its task than there are different continuations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.llm import texthash
from glyphweave.llm.workspace import discard, sized, written

_U = np.uint64
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_WORD = ~_ENDS
_WORD[[9, 32]] = False
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=_U)
#: Occurrences that a task holds before it adds equal ones up and passes them on.
HELD = 1 << 20
SALTS = 64


@dataclass(frozen=True)
class PhraseSpec:
    """Phrases of 2 to `longest` words with at least `least` occurrences; `top` of each language are kept.

    A phrase is dropped if a longer candidate around it has at least `inside` per cent of its
    occurrences. `filter_bits` is the fixed size of the pair filter as a power of two.
    """

    longest: int = 3
    least: int = 10
    inside: int = 50
    top: int = 2000
    filter_bits: int = 27


Chunk = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[str], Chunk]]:
    """Names of languages and, for runs of texts, (bytes, starts, ends, hashes, language numbers, whether the next word follows in the piece)."""
    coded = batch.column(0).dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    for row, _, buf, offs in texthash.chunks(batch.column(1)):
        starts, ends, before = texthash.spans(buf, offs, _WORD)
        if not len(starts):
            continue
        hashes = texthash.hash_words(buf, starts, ends)
        hashes += hashes == 0  # 0 says: no word
        of = np.repeat(np.arange(len(offs) - 1), np.diff(before))
        piece = np.cumsum(_ENDS[buf], dtype=np.int32)[starts]
        follows = np.append((piece[1:] == piece[:-1]) & (of[1:] == of[:-1]), False)
        yield names, (buf, starts, ends, hashes, codes[row + of], follows)


def pair_keys(hashes: np.ndarray, codes: np.ndarray, names: list[str]) -> np.ndarray:
    """A hash of each word, the next word and the language (of the last word: without a next one)."""
    seeds = np.array([hash_of(n) for n in names], _U)
    after = np.append(hashes[1:], _U(0))
    with np.errstate(over="ignore"):
        return texthash.mix(hashes * _LANES[0] + after * _LANES[1] + seeds[codes] * _LANES[2])


def hash_of(name: str) -> int:
    raw = np.frombuffer(name.encode(), np.uint8)
    return int(texthash.hash_words(raw, np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit("")))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, w, n): occurrences of each lower-cased word in a language, w its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, (buf, starts, ends, hashes, codes, _) in chunks(batch):
                for code in np.unique(codes):
                    mine = np.flatnonzero(codes == code)
                    met, first, n = np.unique(hashes[mine], return_index=True, return_counts=True)
                    spots = mine[first]
                    raw = buf.tobytes()
                    words = [raw[a:b] for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)]
                    langs = pa.array([names[code]] * len(met), pa.string())
                    columns = [langs, pa.array(words, pa.binary()).cast(pa.string()), pa.array(met.view(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "w", "n"])

    counted = _texts(docs).mapInArrow(count, "lang string, word string, w long, n long")
    return counted.groupBy("lang", "word", "w").agg(F.sum("n").alias("n"))


def pair_filter(docs: DataFrame, spec: PhraseSpec) -> np.ndarray:
    """A bit map of 2**filter_bits places, set for every pair with `least` occurrences and few others.

    It has the same size for every corpus, 16 MB by default, so it may go to every task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for names, (_, _, _, hashes, codes, follows) in chunks(batch):
                keys = pair_keys(hashes, codes, names)[follows]
                held.append(keys)
                size += len(keys)
                if size >= HELD:
                    yield summed(held)
                    held, size = [], 0
        if size:
            yield summed(held)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        met, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(met.view(np.int64)), pa.array(n)], names=["pair", "n"])

    counted = _texts(docs).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    place = F.shiftrightunsigned("pair", 64 - spec.filter_bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    cells = counted.where(F.col("n") >= spec.least).groupBy(F.floor(place / 64).alias("cell")).agg(F.bit_or(bit).alias("bits"))
    table = written(cells, "phrases-filter")
    bits = np.zeros(max(1 << (spec.filter_bits - 6), 1), np.int64)
    found = table.toArrow()  # at most 2**filter_bits / 64 rows, whatever the corpus
    bits[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    discard(table)
    return bits.view(_U)


def passes(bits: np.ndarray, keys: np.ndarray, spec: PhraseSpec) -> np.ndarray:
    place = keys >> _U(64 - spec.filter_bits)
    return (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1


def pointers(docs: DataFrame, spec: PhraseSpec) -> DataFrame:
    """(lang, w0, w1, ..., n): the projected corpus, each occurrence of a possible pair with the words after it, added up.

    A word that can't go on a frequent phrase is 0, and so is all after it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pair_filter(docs, spec))
    columns = [f"w{k}" for k in range(spec.longest)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, []
        for batch in batches:
            for names, (_, _, _, hashes, codes, follows) in chunks(batch):
                good = follows & passes(shared.value, pair_keys(hashes, codes, names), spec)
                at = np.flatnonzero(good)
                known += [n for n in names if n not in known]
                rows = np.zeros((len(at), spec.longest + 1), np.int64)
                rows[:, 0] = np.array([known.index(n) for n in names])[codes[at]]
                rows[:, 1], rows[:, 2] = hashes[at].view(np.int64), hashes[at + 1].view(np.int64)
                on = np.ones(len(at), bool)
                for k in range(2, spec.longest):
                    spot = np.minimum(at + k - 1, len(hashes) - 1)
                    on &= good[spot]
                    rows[on, k + 1] = hashes[spot[on] + 1].view(np.int64)
                held.append(rows)
                size += len(rows)
                if size >= HELD:
                    yield summed(held, known)
                    held, size = [], 0
        if size:
            yield summed(held, known)

    def summed(held: list[np.ndarray], known: list[str]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.lexsort(rows.T[::-1])]
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1)))
        n = np.diff(np.append(first, len(rows)))
        langs = pa.array(known, pa.string()).take(pa.array(rows[first, 0]))
        words = [pa.array(np.ascontiguousarray(rows[first, k + 1])) for k in range(spec.longest)]
        return pa.RecordBatch.from_arrays([langs, *words, pa.array(n)], names=["lang", *columns, "n"])

    schema = ", ".join(["lang string", *(f"{c} long" for c in columns), "n long"])
    return _texts(docs).mapInArrow(project, schema).groupBy("lang", *columns).agg(F.sum("n").alias("n"))


def grown(rows: np.ndarray, n: np.ndarray, least: int, depth: int = 1) -> Iterator[tuple[int, int, int]]:
    """(row, words, occurrences) of the frequent phrases of sorted pointers: a prefix, then its extensions, depth first."""
    if depth > rows.shape[1]:
        return
    column = rows[:, depth - 1]
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    totals = np.add.reduceat(n, first)
    ends = np.append(first[1:], len(rows))
    on = np.flatnonzero((totals >= least) & (column[first] != 0))
    for at, end, total in zip(first[on].tolist(), ends[on].tolist(), totals[on].tolist(), strict=True):
        yield at, depth, total
        yield from ((at + r, d, t) for r, d, t in grown(rows[at:end], n[at:end], least, depth + 1))


def frequent_phrases(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """(lang, words, w0, w1, ..., a): phrases of 2 to `longest` words with a >= least occurrences; unused words are 0."""
    columns = [f"w{k}" for k in range(spec.longest)]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            codes = table.column("lang").combine_chunks().dictionary_encode()
            lang = codes.indices.to_numpy(zero_copy_only=False)
            rows = np.stack([table.column(c).to_numpy() for c in columns], 1)
            # the last prefix may go on in the next batch
            same = (lang == lang[-1]) & (rows[:, :2] == rows[-1, :2]).all(1)
            end = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = table.slice(end)
            if end:
                yield found(codes.dictionary, lang[:end], rows[:end], table.column("n").to_numpy()[:end])
        if rest is not None:
            codes = rest.column("lang").combine_chunks().dictionary_encode()
            rows = np.stack([rest.column(c).to_numpy() for c in columns], 1)
            yield found(codes.dictionary, codes.indices.to_numpy(zero_copy_only=False), rows, rest.column("n").to_numpy())

    def found(names: pa.Array, lang: np.ndarray, rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        keyed = np.column_stack([lang + 1, rows])
        got = np.array([(r, d - 1, t) for r, d, t in grown(keyed, n, spec.least) if d > 2], np.int64).reshape(-1, 3)
        at, size = got[:, 0], got[:, 1]
        words = [pa.array(np.where(k < size, rows[at, k], 0)) for k in range(spec.longest)]
        columns_ = [names.take(pa.array(lang[at])), pa.array(size.astype(np.int32)), *words, pa.array(got[:, 2])]
        return pa.RecordBatch.from_arrays(columns_, names=["lang", "words", *columns, "a"])

    schema = ", ".join(["lang string, words int", *(f"{c} long" for c in columns), "a long"])
    placed = pointers(docs, spec).repartition("lang", "w0", "w1").sortWithinPartitions("lang", *columns)
    return placed.mapInArrow(extend, schema)


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")).cast("long")


def scored(phrases: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """Phrases of `size` words with their texts and the cut of the lowest score (ties: the shortest first part)."""
    mine = phrases.where(F.col("words") == size)
    for k in range(size):
        side = words.select("lang", F.col("w").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("n").alias(f"f{k}_1"))
        mine = mine.join(side, ["lang", f"w{k}"])
    for width in range(2, size):
        for at in range(size - width + 1):
            if at in (0, size - width):
                part = phrases.where(F.col("words") == width)
                side = part.select("lang", *(F.col(f"w{i}").alias(f"w{at + i}") for i in range(width)), F.col("a").alias(f"f{at}_{width}"))
                mine = mine.join(side, ["lang", *(f"w{at + i}" for i in range(width))])
    cuts = []
    for k in range(1, size):
        left, right = F.col(f"f0_{k}"), F.col(f"f{k}_{size - k}")
        cuts.append(F.struct(exact_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    cut = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
    text = F.concat_ws(" ", *(F.col(f"t{k}") for k in range(size)))
    keys = [F.col(f"w{k}") for k in range(size)]
    return mine.withColumn("cut", cut).select("lang", "words", F.array(*keys).alias("ws"), text.alias("phrase"), "a", "cut.l", "cut.r", "cut.score")


def without_inner(candidates: DataFrame, spec: PhraseSpec) -> DataFrame:
    """Candidates that no longer candidate, with `inside` per cent of their occurrences, holds.

    A phrase occurs at least as often as any around it, so those of one word more decide.
    """
    around = candidates.where("words > 2").select("lang", "a", F.explode(F.array(*(F.slice("ws", at, F.col("words") - 1) for at in (1, 2)))).alias("ws"))
    most = around.groupBy("lang", "ws").agg(F.max("a").alias("most"))
    kept = F.col("most").isNull() | (100 * F.col("most") < spec.inside * F.col("a"))
    return candidates.join(most, ["lang", "ws"], "left").where(kept).drop("most")


def collocations(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language of `docs` (text, lang).

    By score descending, occurrences descending, phrase ascending by bytes, so there are no ties.
    A null text counts as the empty one, a null language as `und`; each row counts, repeated or
    not; no rows and no frequent phrase give no rows. Other columns are not read. Words are
    compared by 64-bit hashes; if a frequent word is seen to share its hash with another word
    of its language, an error says so.
    """
    counted = written(word_counts(docs), "phrases-words")
    shared = counted.groupBy("lang", "w").agg(F.count("*").alias("words"), F.max("n").alias("n"))
    if shared.where((F.col("words") > 1) & (F.col("n") >= spec.least)).limit(1).count():
        raise ValueError("two words of a language have the same hash")
    phrases = written(frequent_phrases(docs, spec), "phrases-found")
    words = sized(written(counted.where(F.col("n") >= spec.least), "phrases-frequent"), 200_000)
    parts = [scored(phrases, words, size) for size in range(2, spec.longest + 1)]
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    kept = without_inner(written(candidates, "phrases-scored"), spec)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = kept.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best)))
    ranked = first.where(F.col("place") <= spec.top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))  # a row for each language
    return ranked.where(F.col("rank") <= spec.top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
