"""Personal data in texts: spans of plain rules, and those that a character tagger finds beside them.

The tagger (``tagger``: bidirectional LSTM with CRF transitions) is trained on labelled spans, by default those of the
rules in a bounded sample, set into each other's neighbourhood, where rules join or cut them. Texts are read in
overlapping windows; what the windows find is reconciled for the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopmill.llm import tagger
from loopmill.llm.common import slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Texts of the sample that gives labelled spans (on average), and at most so many spans of each kind and backgrounds.
SAMPLE_DOCS, SAMPLE_SPANS, SAMPLE_BACKGROUNDS = 20_000, 150, 400
#: Characters of a window, and from one window to the next: what is up to WINDOW - STRIDE long is whole in one.
WINDOW, STRIDE = 128, 64
#: Training windows that are made from the sample, and characters kept beside a labelled span.
TRAINING_WINDOWS, BESIDE = 1200, 60
BATCH_BYTES, DECODED = 4 << 20, 2048

#: Character classes: the marks below have one each; then digits, small and capital letters, other ASCII, all others.
_MARKS = " \n\t@.-_+()/:,;=\"'#%[]"
_CLASSES = len(_MARKS) + 6  # 0 is beyond the text
_CLASS = np.full(129, len(_MARKS) + 4, dtype=np.uint8)
_CLASS[128] = len(_MARKS) + 5
for _name, _chars in ((1, "0123456789"), (2, "abcdefghijklmnopqrstuvwxyz"), (3, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
    _CLASS[[ord(c) for c in _chars]] = len(_MARKS) + _name
for _at, _mark in enumerate(_MARKS):
    _CLASS[ord(_mark)] = _at + 1
#: What every accepted span has one of (see ``plausible``), so that windows without any need not be decoded.
_TELLING = np.isin(np.arange(129), [*range(48, 58), 64])

#: Tags: 0 none, 2 k + 1 the first and 2 k + 2 a further character of kind k. A further one follows its own kind.
_TAGS = 2 * len(KINDS) + 1
ALLOWED = np.zeros((_TAGS, _TAGS))
for _tag in range(2, _TAGS, 2):
    ALLOWED[:, _tag] = tagger.FORBIDDEN
    ALLOWED[[_tag - 1, _tag], _tag] = 0

# The rules. Possessive repeats give the same matches without going back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _is_card(found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


def _is_phone(found: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", found)) <= 15


def _emails(text: str) -> Iterator[Span]:
    """Found from each @ outwards, as only what stands before one can begin a match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield 0, start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by kind and start."""
    out = list(_emails(text)) if "@" in text else []
    for kind, pattern, holds in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        if kind != 3 or "+" in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end() - m.start() > 6 and holds(m.group())]
    return out


# -- labelled windows --------------------------------------------------------------------------------------------------


def labelled_spans(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, spans: int = SAMPLE_SPANS, backgrounds: int = SAMPLE_BACKGROUNDS) -> DataFrame:
    """kind, left, span, right: spans of the rules with what stands beside them, kind -1 for text without any.

    From about ``sample_docs`` texts, chosen by hash alike at every size; of each kind at most ``spans`` rows and of
    backgrounds ``backgrounds``, those of least hash.
    """
    n = docs.count()
    hashed = docs.select("text", F.pmod(F.xxhash64(F.lit("pii"), "text"), F.lit(1 << 32)).alias("h"))
    chosen = hashed.filter(F.col("h") < F.lit(int(min(1.0, sample_docs / max(n, 1)) * (1 << 32))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            rows = []
            for text, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist()):
                found = sorted(base_spans(text), key=lambda s: s[1:])
                ends = [0, *accumulate((e for _, _, e in found), max)]
                for i, (kind, start, end) in enumerate(found):
                    before, after = ends[i], found[i + 1][1] if i + 1 < len(found) else len(text)
                    if before <= start and end <= after and end - start <= WINDOW - STRIDE:
                        rows.append((kind, text[max(before, start - BESIDE) : start], text[start:end], text[end : min(after, end + BESIDE)], h))
                if not found:
                    at = h % max(1, len(text) - WINDOW)
                    rows.append((-1, text[at : at + WINDOW], "", "", h))
            names = ["kind", "left", "span", "right", "h"]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=names)

    found = chosen.mapInArrow(run, "kind int, left string, span string, right string, h long").distinct()
    parts = [found.filter(F.col("kind") == k).orderBy("h", "span", "left", "right").limit(backgrounds if k < 0 else spans) for k in range(-1, len(KINDS))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("h")


def _other(draw: np.random.Generator) -> str:
    """Something with digits that is no personal data."""
    digits = lambda a, b: "".join(draw.choice(list("0123456789"), int(draw.integers(a, b))))
    hexed = "".join(draw.choice(list("0123456789abcdef"), 40))
    forms = (
        digits(1, 6),
        digits(1, 9),
        f"{digits(1, 4)}.{digits(1, 3)}",
        f"{digits(2, 3)}:{digits(2, 3)}",
        f"20{digits(2, 3)}-0{digits(1, 2)}-1{digits(1, 2)}",
        f"{digits(1, 2)}.{digits(1, 2)}.{digits(1, 2)}",
        f'token = "{hexed}"',
        f"${digits(1, 4)},{digits(3, 4)}",
        f"@{digits(1, 3)}",
        "@",
    )
    return str(forms[int(draw.integers(len(forms)))])


def training_windows(rows: list[tuple[int, str, str, str]], n: int = TRAINING_WINDOWS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of ``n`` windows: labelled spans where they stood, beside each other and other numbers; and none."""
    draw = np.random.default_rng(seed)
    kinds = [[r for r in rows if r[0] == k] for k in range(len(KINDS))]
    plain, kinds = [r[1] for r in rows if r[0] < 0] or [" "], [k for k in kinds if k]
    between = (" ", " ", " ", ", ", "; ", "/", "\n", " - ", ".", ". ", " | ")
    classes, tags = np.zeros((n, WINDOW), dtype=np.uint8), np.zeros((n, WINDOW), dtype=np.int64)
    pick = lambda x: x[int(draw.integers(len(x)))]
    for w in range(n):
        form, (kind, left, span, right) = int(draw.integers(6)), pick(pick(kinds))
        parts = [(-1, left), (kind, span), (-1, right)]
        if form in (2, 3):  # another span beside it
            parts[2:2] = [(-1, pick(between)), pick(pick(kinds))[0:3:2]]
        if form in (3, 4):  # another number before or after it
            at = pick((1, len(parts) - 1))
            parts[at:at] = [(-1, pick(between)), (-1, _other(draw)), (-1, pick(between))]
        if form == 5:
            text = pick(plain)
            at = int(draw.integers(len(text) + 1))
            parts = [(-1, text[:at] + " "), (-1, _other(draw)), (-1, " " + text[at:])]
        text = "".join(p for _, p in parts)
        marks, at = np.zeros(len(text), dtype=np.int64), 0
        for k, p in parts:
            if k >= 0:
                marks[at : at + len(p)] = 2 * k + 2
                marks[at] = 2 * k + 1
            at += len(p)
        # a cut that leaves all spans whole, if there is one
        inside = np.flatnonzero(marks)
        low, high = (max(0, int(inside[-1]) + 1 - WINDOW), int(inside[0])) if len(inside) else (0, max(0, len(text) - WINDOW))
        start = int(draw.integers(low, high + 1)) if low <= high else low
        cut = marks[start : start + WINDOW]
        for i in np.flatnonzero((cut > 0) & (cut % 2 == 0)):  # a span whose first character was cut off
            if i and cut[i - 1] in (cut[i], cut[i] - 1):
                continue
            cut[i] = 0
        classes[w, : len(cut)], tags[w, : len(cut)] = char_classes(text[start : start + WINDOW]), cut
    return classes, tags


def char_classes(text: str) -> np.ndarray:
    return _CLASS[_codes(text)]


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 128)


def fit(docs: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> dict[str, np.ndarray] | None:
    """Weights of a tagger, or None if there is no labelled span.

    ``labelled`` (kind, left, span, right) is by default taken from ``docs``; it is bounded, as ``labelled_spans``
    says, and collected to train on the driver.
    """
    rows = labelled_spans(docs.select(text_or_empty(text).alias("text"))) if labelled is None else labelled
    listed = sorted((r.kind, r.left, r.span, r.right) for r in rows.select("kind", "left", "span", "right").collect())
    if not any(r[0] >= 0 for r in listed):
        return None
    return tagger.train(*training_windows(listed), _CLASSES, ALLOWED)


# -- decoding ----------------------------------------------------------------------------------------------------------

_EMAIL_LIKE = re.compile(r"[^\s@<>()\[\],;:\"']+ ?@ ?[^\s@<>()\[\],;:\"']+\.[^\s@<>()\[\],;:\"'.]{2,}")
_IP_LIKE = re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}")
_CARD_LIKE = re.compile(r"[0-9](?:[ ./-]{0,3}[0-9])*")
_PHONE_LIKE = re.compile(r"(?:\+|00|\()[0-9][ ()./0-9-]*[0-9]")
_LIKE = (_EMAIL_LIKE, _IP_LIKE, _CARD_LIKE, _PHONE_LIKE)


def plausible(kind: int, found: str) -> bool:
    """Whether a tagged stretch can be of its kind: like the rules, but with blanks and other marks inside.

    Each of these has a digit or an @, which ``_TELLING`` relies on.
    """
    if not _LIKE[kind].fullmatch(found):
        return False
    if kind == 1:
        return all(int(p) <= 255 for p in found.replace(" ", "").split("."))
    return kind == 0 or (_is_card if kind == 2 else _is_phone)(found)


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def reconcile(found: list[tuple[float, int, int, int]], taken: list[Span]) -> list[Span]:
    """Of (score, kind, start, end), the spans apart from each other and from ``taken`` that have the largest sum."""
    best: dict[Span, float] = {}
    for score, *span in found:
        best[tuple(span)] = max(score, best.get(tuple(span), score))
    starts, stops = _merged(taken)
    free = [s for s in best if not (i := bisect_left(starts, s[2])) or stops[i - 1] <= s[1]]
    free.sort(key=lambda s: (s[2], s[1], s[0]))
    ends, total, chosen = [s[2] for s in free], [0.0], [None]
    for i, s in enumerate(free):
        before = bisect_right(ends, s[1], 0, i)
        with_it = total[before] + best[s]
        total.append(max(total[i], with_it))
        chosen.append(before if with_it > total[i] else None)
    out, i = [], len(free)
    while i:
        if chosen[i] is None:
            i -= 1
        else:
            out.append(free[i - 1])
            i = chosen[i]
    return sorted(out)


def _window_spans(tags: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, float, int, int, int]]:
    """(window, score, kind, start, end) of tagged stretches; the score is what tags gain over none."""
    gain = np.take_along_axis(scores, tags[:, :, None].astype(np.int64), axis=2)[:, :, 0] - scores[:, :, 0]
    for w, start in zip(*(x.tolist() for x in np.nonzero(tags % 2 == 1))):
        kind, end = (int(tags[w, start]) - 1) // 2, start + 1
        while end < tags.shape[1] and tags[w, end] == 2 * kind + 2:
            end += 1
        yield w, float(gain[w, start:end].sum()), kind, start, end


def tagged(texts: list[str], weights: dict[str, np.ndarray]) -> list[list[tuple[float, int, int, int]]]:
    """For each text, plausible (score, kind, start, end) of all its windows; what a window's end cuts is left out."""
    places, parts = [], []
    for no, text in enumerate(texts):
        codes = _codes(text)
        telling = np.flatnonzero(_TELLING[codes])
        if not len(telling):
            continue
        last = max(0, -(-(len(text) - WINDOW) // STRIDE))
        numbers = np.unique(np.concatenate([telling // STRIDE, telling // STRIDE - 1]))
        for j in numbers[(numbers >= 0) & (numbers <= last)].tolist():
            places.append((no, j * STRIDE))
            parts.append(_CLASS[codes[j * STRIDE : j * STRIDE + WINDOW]])
    out: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    for at in range(0, len(parts), DECODED):
        some = parts[at : at + DECODED]
        classes = np.zeros((len(some), WINDOW), dtype=np.uint8)
        for i, p in enumerate(some):
            classes[i, : len(p)] = p
        scores = tagger.emissions(weights, classes)
        for w, score, kind, start, end in _window_spans(tagger.viterbi(scores, weights["step"], ALLOWED), scores):
            no, offset = places[at + w]
            text = texts[no]
            if (start == 0 and offset) or (end == WINDOW and offset + end < len(text)):
                continue
            start, end = start + offset, min(end + offset, len(text))
            while start < end and text[start] in " \n\t,;:.":
                start += 1
            while start < end and text[end - 1] in " \n\t,;:.-(+":
                end -= 1
            if plausible(kind, text[start:end]):
                out[no].append((score, kind, start, end))
    return out


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_spans(docs: DataFrame, weights: dict[str, np.ndarray] | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans: one row for each row of ``docs``.

    Counts and base_spans are those of the rules; spans has them and what the tagger adds, apart from them and from
    each other. Spans are kind:start:end in code points, end exclusive, by kind as in KINDS and start, joined by
    commas. A null text is empty and has none, without ``weights`` there are only the rules' spans, and other columns
    are not looked at. A text is in memory whole, with some ten bytes for each character.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            more = tagged(texts, weights) if weights is not None else [[] for _ in texts]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], type=pa.int64()) for k in range(len(KINDS))]
            spans = [_listed(b + reconcile(m, b)) if m else _listed(b) for b, m in zip(base, more)]
            both = [pa.array(x, type=pa.string()) for x in ([_listed(b) for b in base], spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *both], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def redact(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; ``found`` is from ``find_spans`` over the same rows.

    Of overlapping spans the one that begins first goes in, the longer of equals. Ids must be unique; null ids match.
    """
    spans = found.select(F.col("doc_id").alias("own_id"), F.split(F.col("spans"), ",").alias("parts")).filter("parts[0] <> ''")
    part = lambda p, k: F.split_part(p, F.lit(":"), F.lit(k))
    span = lambda p: F.struct(part(p, 2).cast("int").alias("a"), (-part(p, 3).cast("int")).alias("b"), part(p, 1).alias("k"))
    at = F.array_sort(F.transform("parts", span))
    names = docs.columns
    joined = docs.select(F.struct(*names).alias("row")).join(spans.select("own_id", at.alias("at")), F.col("row")[doc_id].eqNullSafe(F.col("own_id")), "left")
    own = F.col("row")[text].cast("string")
    start = F.struct(F.lit(0).alias("done"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        said = F.concat(s["out"], F.substr(own, s["done"] + 1, x["a"] - s["done"]), F.lit("["), x["k"], F.lit("]"))
        return F.when(x["a"] < s["done"], s).otherwise(F.struct((-x["b"]).alias("done"), said.alias("out")))

    clean = F.aggregate("at", start, step, lambda s: F.concat(s["out"], F.substr(own, s["done"] + 1)))
    return joined.select(*[F.when(F.col("at").isNull(), own).otherwise(clean).alias(c) if c == text else F.col("row")[c].alias(c) for c in names])
