"""Phrase collocations by level-wise passes (Apriori).

A pass for each phrase length reads the texts, emits the phrases of that length whose both overlapping shorter
phrases are frequent, already summed up within a stretch of texts, and keeps the frequent ones as a level table.
Frequent keys of the level before are sent to the tasks, either as they are or, beyond a bound on their number, as a
bitmap of fixed size, which lets some more phrases through; counts decide in any case. Cuts are scored by joins of
level tables alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopmill.llm.common import grouped_slices, materialize, text_or_empty, utf8
from loopmill.llm.wordscan import LOWER, mix, scan

MOST_WORDS, LEAST_COUNT, TOP = 3, 10, 2000
#: A phrase goes if a longer one has this share of its occurrences (percent).
SUBSUMED_PERCENT = 50
SCALE = 1_000_000
UNKNOWN = "und"
#: Text that is summed up at once.
STRETCH_BYTES = 4 << 20
#: Rows that a task hands over at once.
SENT_ROWS = 1 << 16
#: Frequent keys sent as they are, 8 bytes each; more become a bitmap of 2 ** BITMAP_BITS bits (32 MB).
BROADCAST_KEYS, BITMAP_BITS = 2_000_000, 28

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Word bytes: all but blanks, tabs and what ends a piece.
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 32, *_BREAKS]] = False
_BREAK = np.isin(np.arange(256), np.frombuffer(_BREAKS, dtype=np.uint8))
_COUNTED = "lang string, key long, phrase string, n long"


class Frequent:
    """Keys that are known to be frequent, as a sorted array or as a bitmap with other keys among them."""

    def __init__(self, keys: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.keys, self.bits = keys, bits

    def holds(self, asked: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            at = asked >> np.uint64(64 - BITMAP_BITS)
            return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        if not len(self.keys):
            return np.zeros(len(asked), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] == asked


def frequent(level: DataFrame, most: int = BROADCAST_KEYS) -> Frequent:
    """Keys of a level table for the tasks: at most ``most`` of them, else a bitmap of 2 ** BITMAP_BITS bits."""
    unsigned = lambda table, c: table.column(c).to_numpy().view(np.uint64)
    if level.limit(most + 1).count() <= most:
        return Frequent(keys=np.unique(unsigned(level.select("key").toArrow(), "key")))
    at = F.shiftrightunsigned("key", 64 - BITMAP_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = level.select(F.shiftright(at, 6).alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    bits[words.column("word").to_numpy()] = unsigned(words, "bits")
    return Frequent(bits=bits)


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def phrase_keys(words: np.ndarray, salt: np.ndarray, piece: np.ndarray, size: int, known: Frequent | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, keep): the key of ``size`` words from each place, and whether they are of one piece and may be frequent."""
    key, keep = mix(words * _ODD + salt), np.ones(len(words), dtype=bool)
    for k in range(2, size + 1):
        places = max(len(words) - k + 1, 0)
        keep = piece[:places] == piece[k - 1 :]
        if k == size:
            ok = known.holds(key)
            keep &= ok[:-1] & ok[1:]
        key = mix(key[:places] * _ODD + words[k - 1 :])
    return key, keep


def _phrases(w, size: int, at: np.ndarray) -> list[bytes]:
    """Words from each place, lowered and joined by blanks."""
    raw = np.frombuffer(w.buffer, dtype=np.uint8)
    text, start, end = LOWER[raw].tobytes(), w.start, w.end
    last = at + size - 1
    blank = np.ones(len(at), dtype=bool)
    for k in range(size - 1):
        blank &= (start[at + k + 1] - end[at + k] == 1) & (raw[end[at + k]] == 32)
    out = [text[a:b] for a, b in zip(start[at].tolist(), end[last].tolist())]
    for i in np.flatnonzero(~blank).tolist():
        out[i] = b" ".join(text[a:b] for a, b in zip(start[at[i] : last[i] + 1].tolist(), end[at[i] : last[i] + 1].tolist()))
    return out


def _count(size: int, shorter):
    """Texts to (lang, key, phrase, n) of one length, summed up within a stretch; of length 1 also with all words as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shorter.value if shorter is not None else None
        for batch in grouped_slices(batches, "text", STRETCH_BYTES):
            w = scan(utf8(batch.column("text")), _WORD)
            langs = batch.column("lang").dictionary_encode()
            names = langs.dictionary.to_pylist()
            own = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(w.first))
            # a line feed stands between texts, so that no piece spans two
            piece = np.cumsum(_BREAK[np.frombuffer(w.buffer, dtype=np.uint8)], dtype=np.int32)[w.start]
            key, keep = phrase_keys(w.hash, np.array([_salt(x) for x in names], dtype=np.uint64)[own], piece, size, known)
            at = np.flatnonzero(keep)
            unique, first, n = np.unique(key[at], return_index=True, return_counts=True)
            at = at[first]
            lang, phrases, total = own[at], _phrases(w, size, at), np.bincount(own, minlength=len(names))
            if size == 1:
                lang, phrases = np.concatenate([lang, np.arange(len(names))]), [*phrases, *[b""] * len(names)]
                unique, n = np.concatenate([unique, np.zeros(len(names), dtype=np.uint64)]), np.concatenate([n, total])
            lang = pa.DictionaryArray.from_arrays(pa.array(lang, type=pa.int32()), pa.array(names, type=pa.string())).cast(pa.string())
            columns = [lang, pa.array(unique.view(np.int64)), pa.array(phrases, type=pa.binary()).cast(pa.string()), pa.array(n, type=pa.int64())]
            counted = pa.RecordBatch.from_arrays(columns, names=["lang", "key", "phrase", "n"])
            for row in range(0, counted.num_rows, SENT_ROWS):
                yield counted.slice(row, SENT_ROWS)

    return run


def levels(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, broadcast_keys: int = BROADCAST_KEYS) -> tuple[list[DataFrame], DataFrame]:
    """(level tables lang, key, phrase, n for 1, 2, ... words; lang, n of all words). ``docs`` has lang and text."""
    tables, totals, sent = [], None, None
    for size in range(1, most_words + 1):
        # summed up once more only after the exchange: another table before it would hold as many rows
        counted = docs.mapInArrow(_count(size, sent), _COUNTED).repartition("lang", "key", "phrase")
        summed = counted.groupBy("lang", "key", "phrase").agg(F.sum("n").alias("n"))
        level = materialize(summed.filter((F.col("n") >= least) | (F.col("phrase") == "")))
        if size == 1:
            totals, level = level.filter("phrase = ''").select("lang", "n"), level.filter("phrase <> ''")
        tables.append(level)
        if size < most_words:
            sent = docs.sparkSession.sparkContext.broadcast(frequent(level, broadcast_keys))
    return tables, totals


def _part(phrase: str, first: int, words: int):
    return F.concat_ws(" ", F.slice(F.split(phrase, " ", -1), first, words))


def lowest_cuts(tables: list[DataFrame], size: int) -> DataFrame:
    """lang, phrase, a, l, r, score: each phrase of ``size`` words with its lowest-scoring cut, the first of equals."""
    whole, cuts = tables[size - 1].select("lang", "phrase", F.col("n").alias("a")), []
    for k in range(1, size):
        left = tables[k - 1].select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
        right = tables[size - k - 1].select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
        cut = whole.select("*", _part("phrase", 1, k).alias("head"), _part("phrase", k + 1, size - k).alias("tail"))
        cut = cut.join(left, ["lang", "head"]).join(right, ["lang", "tail"])
        wide = cut.select("*", *(F.col(c).cast("decimal(18,0)").alias(f"{c}_") for c in "alr"))
        cuts.append(wide.select("lang", "phrase", "a", F.expr(f"(a_ * a_ * {SCALE}) div (l_ * r_)").alias("score"), F.lit(k).alias("cut"), "l", "r"))
    if len(cuts) == 1:
        return cuts[0].drop("cut")
    lowest = reduce(DataFrame.unionByName, cuts).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    return lowest.select("lang", "phrase", "a", "x.score", "x.l", "x.r")


def subsumed(tables: list[DataFrame], size: int) -> DataFrame:
    """lang, phrase, longer: the largest count of a frequent phrase that is longer and holds this one of ``size`` words.

    One word more is enough to look at, as a longer phrase that holds it holds such a one, no less frequent.
    """
    inside = F.array(_part("phrase", 1, size), _part("phrase", 2, size))
    return tables[size].select("lang", F.explode(inside).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    most_words: int = MOST_WORDS,
    least: int = LEAST_COUNT,
    top: int | None = TOP,
    percent: int = SUBSUMED_PERCENT,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score, a and phrase.

    Words are what blanks and tabs separate in the pieces between marks and line breaks, ASCII capitals lowered. A
    phrase of 2 to ``most_words`` words in one piece that occurs ``least`` times (a) is scored by the cut into two
    parts, of l and r occurrences, that gives the least floor(SCALE * a * a / (l * r)); it goes if one longer has
    ``percent`` of its occurrences. n counts all words of the language. Whole decimals of 38 digits keep this exact
    for counts up to 10 ** 16. A null text is empty, a null language is UNKNOWN, repeated rows count each time, and
    other columns are not looked at; without a frequent phrase there is no row. Phrases are told apart by 64-bit
    keys inside a stretch of texts, and by themselves beyond it.
    """
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(text).alias("text"))
    tables, totals = levels(source, most_words, least, broadcast_keys)
    kept = []
    for size in range(2, most_words + 1):
        cut = lowest_cuts(tables, size)
        if size < most_words:
            cut = cut.join(subsumed(tables, size), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent))
        kept.append(cut.select("lang", "phrase", "a", "l", "r", "score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = reduce(DataFrame.unionByName, kept).withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
