"""Language identification: script ranges narrow the candidates of each word, per-word n-gram scores and a
switching penalty go through Viterbi, and the labelled words give spans and a language for the document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopmill.llm.common import grouped_slices, materialize, small_side, utf8

#: First and last code points of scripts (Unicode blocks that hold letters).
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul_jamo", 0x1100, 0x11FF),
    ("latin_more", 0x1E00, 0x1EFF),
    ("greek_more", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
NO_SCRIPT = len(SCRIPTS)
#: Documents of one language that a model is fitted on, at most: those of least text hash.
SAMPLE_DOCS = 1_000
#: Slots for hashed n-grams, lengths of n-grams, and the additive constant of their frequencies.
SLOTS, NGRAMS, SMOOTH = 1 << 17, (1, 2, 3, 4), 0.5
SWITCH_PENALTY = 8.0
#: A word in a script that a language's training texts hardly have (under this share) is not of that language.
SCRIPT_SHARE, FOREIGN = 0.001, -30.0
#: Text labelled at a time: working memory is some 60 times as much.
BATCH_BYTES = 1 << 19
UNDETERMINED = "und"

_FIRST = np.array([a for _, a, _ in SCRIPTS])
_LAST = np.array([b for _, _, b in SCRIPTS])
_P = np.uint64(0x9E3779B97F4A7C15)


def _letters(code: np.ndarray) -> np.ndarray:
    """True for letters; a table for the common planes, by Python's own notion of a letter."""
    return _LETTER[np.minimum(code, len(_LETTER) - 1)]


_LETTER = np.array([chr(c).isalpha() for c in range(0x30000)] + [False])


@dataclass
class Text:
    """Words (runs of letters) of a batch of texts as code points."""

    code: np.ndarray  #: lower-case code points, a line feed after each text
    start: np.ndarray  #: of words
    end: np.ndarray
    first: np.ndarray  #: of each text, the number of words before it; one more at the end
    script: np.ndarray  #: of each word, that of its first letter

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, from one prefix sum over powers of an odd number (modulo 2**64)."""
        power = np.full(len(self.code) + 1, _P)
        power[0] = 1
        np.cumprod(power, out=power)
        inverse = np.full(len(self.code) + 1, np.uint64(pow(int(_P), -1, 2**64)))
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        value = self.code.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(31)
        total = np.zeros(len(self.code) + 1, dtype=np.uint64)
        np.cumsum(value * power[:-1], out=total[1:])
        return (total[self.end] - total[self.start]) * inverse[self.start]


def read(texts: list[bytes]) -> Text:
    joined = b"\n".join([*texts, b""]).decode("utf-8", "replace")
    breaks = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
    code = np.frombuffer(joined.lower().encode("utf-32-le", "replace"), dtype="<u4")
    # lower() may lengthen a text, so texts are found again by counting: one part for each
    if len(code) == len(breaks):
        lengths = np.array([len(t.decode("utf-8", "replace")) + 1 for t in texts], dtype=np.int64)
    else:
        lengths = np.array([len(t.decode("utf-8", "replace").lower()) + 1 for t in texts], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    code = code.astype(np.int64)
    inside = np.zeros(len(code) + 2, dtype=np.int8)
    inside[1:-1] = _letters(code)
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    lead = code[start]
    at = np.maximum(np.searchsorted(_FIRST, lead, "right") - 1, 0)
    script = np.where((lead >= _FIRST[at]) & (lead <= _LAST[at]), at, NO_SCRIPT)
    return Text(code, start, end, np.searchsorted(start, bounds), script)


def features(t: Text) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: slots, and for each word where its n-grams begin in them (with its two edges)."""
    n = t.end - t.start + 2
    place = np.cumsum(n) - n
    padded = np.arange(n.sum()) - np.repeat(place - t.start + 1, n)
    edge = np.zeros(len(padded), dtype=bool)
    edge[place] = edge[place + n - 1] = True
    symbol = np.where(edge, 32, t.code[np.clip(padded, 0, max(len(t.code) - 1, 0))]).astype(np.uint64) if len(padded) else np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(symbol), dtype=np.uint64)
    left = np.repeat(place + n, n) - np.arange(len(symbol))  # symbols up to the word's end
    for size in range(1, max(NGRAMS) + 1):
        shifted = np.zeros_like(symbol)
        shifted[: len(symbol) - size + 1] = symbol[size - 1 :]
        h = h * _P + shifted + np.uint64(1)
        if size in NGRAMS:
            whole = left >= size
            x = h ^ (h >> np.uint64(29))
            slot = ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 17)).astype(np.int64)
            yield slot[whole], np.cumsum(np.concatenate([[0], np.maximum(n - size + 1, 0)]))


@dataclass
class Model:
    """langs; score (slot of each n-gram length x lang, log frequency); allowed (script x lang)."""

    langs: list[str]
    score: np.ndarray
    allowed: np.ndarray

    def words(self, t: Text) -> np.ndarray:
        """Log score of each word in each language; equal words of the batch are scored once."""
        _, first, back = np.unique(t.hashes(), return_index=True, return_inverse=True)
        return self._distinct(Text(t.code, t.start[first], t.end[first], t.first, t.script[first]))[back]

    def _distinct(self, t: Text) -> np.ndarray:
        """Mean log frequency of a word's n-grams over n-gram lengths; script first."""
        out = np.zeros((len(t.start), len(self.langs)), dtype=np.float32)
        for table, (slot, bounds) in zip(self.score, features(t)):
            sums = np.zeros((len(slot) + 1, len(self.langs)), dtype=np.float64)
            np.cumsum(table[slot], axis=0, out=sums[1:])
            out += (sums[bounds[1:]] - sums[bounds[:-1]]) / len(NGRAMS)
        return out + np.where(self.allowed[t.script], 0, FOREIGN)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float, length: int = 128) -> np.ndarray:
    """Best label of each word under a fixed price for each change.

    Texts are cut into chunks that advance together, a word at a time: once from each possible label, which
    gives how a chunk turns values before it into values after it; then, values known, for the way back.
    """
    words, states = score.shape
    label = np.zeros(words, dtype=np.int64)
    if not words:
        return label
    score = score.astype(np.float64)
    n = np.diff(first)
    per_text = -(-n // length)
    text = np.repeat(np.arange(len(n)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = first[:-1][text] + nth * length
    size = np.minimum(length, first[1:][text] - start)
    order = np.argsort(-size, kind="stable")  # chunks that have a step stand in front
    start, size = start[order], size[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0] + 1), "right")

    def advance(value: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        jump = value.max(axis=-1, keepdims=True) - penalty
        s = score[start[: len(value)] + step]
        return np.maximum(value, jump) + (s if value.ndim == 2 else s[:, None, :]), jump

    through = np.full((len(start), states, states), -1e12)
    through[:, np.arange(states), np.arange(states)] = 0
    for step in range(size[0]):
        k = alive[step]
        through[:k] = advance(through[:k], step)[0]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))  # of a chunk in text order
    before = np.zeros((len(start), states))
    head = np.cumsum(per_text) - per_text
    for k in range(1, int(per_text.max())):
        last = place[head[per_text > k] + k - 1]
        value = (before[last][:, :, None] + through[last]).max(axis=1)
        before[place[head[per_text > k] + k]] = value - value.max(axis=1, keepdims=True)
    came = np.zeros(words, dtype=np.int16)
    stays = np.zeros((words, states), dtype=bool)
    value = before
    for step in range(size[0]):
        k = alive[step]
        at = start[:k] + step
        came[at] = value[:k].argmax(axis=1)
        new, jump = advance(value[:k], step)
        stays[at] = value[:k] >= jump
        value[:k] = new
    path = np.zeros((words, states), dtype=np.int16)
    now = np.broadcast_to(np.arange(states), (len(start), states)).copy()  # by the label at a chunk's end
    for step in range(size[0] - 1, -1, -1):
        k = alive[step]
        at = start[:k] + step
        path[at] = now[:k]
        now[:k] = np.where(np.take_along_axis(stays[at], now[:k], 1), now[:k], came[at][:, None])
    final = np.zeros(len(start), dtype=np.int64)
    some = np.flatnonzero(per_text > 0)
    end = place[head[some] + per_text[some] - 1]
    final[end] = value[end].argmax(axis=1)
    for k in range(int(per_text.max()) - 1, 0, -1):
        last = place[head[per_text > k] + k]
        final[place[head[per_text > k] + k - 1]] = now[last, final[last]]
    owner = np.repeat(place, size[place])
    return path[np.arange(words), final[owner]].astype(np.int64)


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on the rows of ``docs`` where ``train`` holds and text and language are there.

    At most ``sample_docs`` whole texts of each language are counted, those of the least text hash; tasks send
    hashed n-gram counts, one row for each language. Without any such row the model knows no language.
    """
    rows = docs.filter(train & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.col(text).cast("string").alias("text"))
    # copies of a text are one: they must neither narrow the cut nor take places in the sample
    texts = materialize(rows.select("lang", "h").distinct())
    # a first cut by hash leaves about four times the sample, however many texts and tasks there are
    counts = small_side(materialize(texts.groupBy("lang").agg(F.count("*").alias("n"))))
    near = texts.join(counts, "lang").filter(F.col("h").cast("double") <= (F.least(F.lit(1.0), F.lit(4.0 * sample_docs) / F.col("n")) - 0.5) * 2.0**64)
    ranked = near.select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= sample_docs)
    limits = small_side(materialize(ranked.groupBy("lang").agg(F.max("h").alias("most"))))  # a row for each language
    # repeated texts share a hash: they may come along, so texts are told apart once more
    chosen = rows.join(limits, "lang").filter("h <= most").select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in grouped_slices(batches, "text", BATCH_BYTES):
            langs = batch.column("lang").to_pylist()
            texts = utf8(batch.column("text"))
            for name in set(langs):
                t = read([x for x, y in zip(texts, langs) if y == name])
                own = sums.setdefault(name, [*(np.zeros(SLOTS, dtype=np.int32) for _ in NGRAMS), np.zeros(NO_SCRIPT + 1, dtype=np.int32)])
                for total, (slot, _) in zip(own, features(t)):
                    total += np.bincount(slot, minlength=SLOTS).astype(np.int32)
                own[-1] += np.bincount(t.script, minlength=NO_SCRIPT + 1).astype(np.int32)
        for name, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([zlib.compress(np.concatenate(own).tobytes(), 1)], type=pa.binary())], names=["lang", "counts"])

    sums: dict[str, np.ndarray] = {}
    # the texts of a language, at most sample_docs, meet in one task; a packed row for each language comes back
    for row in chosen.repartition("lang").mapInArrow(count, "lang string, counts binary").collect():
        sums[row.lang] = sums.get(row.lang, 0) + np.frombuffer(zlib.decompress(row.counts), dtype=np.int32).astype(np.int64)
    langs = sorted(sums)
    if not langs:
        return Model([], np.zeros((len(NGRAMS), SLOTS, 0)), np.zeros((NO_SCRIPT + 1, 0), dtype=bool))
    table = np.stack([sums[x] for x in langs], axis=1)
    counts = table[: SLOTS * len(NGRAMS)].reshape(len(NGRAMS), SLOTS, len(langs)).astype(np.float64)
    score = np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * SLOTS)).astype(np.float32)
    scripts = table[SLOTS * len(NGRAMS) :]
    allowed = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True  # a script of no language excludes none
    return Model(langs, score, allowed)


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = SWITCH_PENALTY, least_run: int | None = None) -> DataFrame:
    """``docs`` with lang_pred, score and spans.

    score is the share of letters in words labelled with lang_pred. spans is an array of (lang, first_word,
    words), words being runs of letters. A null text, one without letters, or a model without languages gives
    ``und``, score 0 and no span. Ties go to the language first in the alphabet. With ``least_run`` there is also
    in_runs, the share of letters in spans of so many letters or more, of whatever languages. Columns of these
    names are replaced; all others, nulls included, pass through.
    """
    spark = docs.sparkSession
    runs = [] if least_run is None else ["in_runs"]
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "spans", *runs)]
    source = docs.select(*kept).withColumn(text, F.col(text).cast("string"))
    schema = source.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "spans": F.lit(None).cast("array<struct<lang:string,first_word:int,words:int>>"), **{c: F.lit(0.0) for c in runs}}).schema
    shared = spark.sparkContext.broadcast(model)  # of fixed size for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNDETERMINED], dtype=object)
        kind = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())])
        for batch in grouped_slices(batches, text, BATCH_BYTES):
            n = batch.num_rows
            pred, share, in_runs, spans = np.full(n, len(m.langs)), np.zeros(n), np.zeros(n), pa.array([[]] * n, type=pa.list_(kind))
            t = read(utf8(batch.column(text)))
            if m.langs and len(t.start):
                label = viterbi(m.words(t), t.first, penalty).astype(np.int64)
                doc = np.repeat(np.arange(n), np.diff(t.first))
                letters = np.bincount(doc * len(m.langs) + label, weights=t.end - t.start, minlength=n * len(m.langs)).reshape(n, len(m.langs))
                total = letters.sum(axis=1)
                has = total > 0
                pred[has] = letters.argmax(axis=1)[has]
                share[has] = letters.max(axis=1)[has] / total[has]
                new = np.ones(len(label), dtype=bool)
                new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(label)))
                if runs:
                    long = np.add.reduceat(t.end - t.start, begin)
                    in_runs[has] = np.bincount(doc[begin], weights=long * (long >= least_run), minlength=n)[has] / total[has]
                values = pa.StructArray.from_arrays(
                    [pa.array(names[label[begin]], type=pa.string()), pa.array((begin - t.first[doc[begin]]).astype(np.int32)), pa.array(size.astype(np.int32))], fields=list(kind)
                )
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[begin], np.arange(n + 1)).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names[pred], type=pa.string()), pa.array(share), spans, *(pa.array(in_runs) for _ in runs)], names=[*kept, "lang_pred", "score", "spans", *runs])

    return source.mapInArrow(run, schema)
