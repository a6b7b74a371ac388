"""What operator 1 stores, read from the shards by hand; and operator 2's score and choice, labelled plainly."""

import hashlib
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from loopmill.llm import langid, media


def samples(png):
    """Rows of an 8-bit greyscale PNG without filters."""
    at, data = 8, b""
    while at < len(png):
        (size,) = struct.unpack(">I", png[at : at + 4])
        if png[at + 4 : at + 8] == b"IDAT":
            data += png[at + 8 : at + 8 + size]
        at += size + 12
    raw = zlib.decompress(data)
    assert len(raw) % 193 == 0 and all(raw[k] == 0 for k in range(0, len(raw), 193))
    return b"".join(raw[k + 1 : k + 193] for k in range(0, len(raw), 193))


def test_stored_media_and_features(spark, tmp_path):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "ä" * 1000), (5, "hello world"), (6, "line\n" * 300), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = media.media_columns(docs, folder=f"file://{tmp_path}/media").collect()
    assert len(got) == len(rows)
    for r in got:
        with open(f"{tmp_path}/media/{r.shard}", "rb") as shard:
            shard.seek(r.media_offset)
            stored = shard.read(r.media_length)
        text = (dict(rows)[r.doc_id] or "").encode()
        payload = samples(stored)
        assert payload == text + b" " * (len(payload) - len(text)) and len(payload) == max(-(-len(text) // 192), 1) * 192
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        mean = sum(payload) / len(payload)
        deviation = (sum((x - mean) ** 2 for x in payload) / len(payload)) ** 0.5
        step = sum(abs(a - b) for a, b in zip(payload, payload[1:])) / (len(payload) - 1)
        classes = [sum(x >> 5 == k for x in payload) for k in range(8)]
        found = dict(x.split("=") for x in r.feature.split(";"))
        assert [float(found[k]) for k in ("mean", "deviation", "step")] == pytest.approx([mean, deviation, step], abs=1e-4)
        assert [int(x) for x in found["classes"].split(",")] == classes


def label(scores, penalty):
    """The best labels, by trying each last label's best way for each word."""
    ways = [(s, [k]) for k, s in enumerate(scores[0])]
    for row in scores[1:]:
        ways = [max(((v - (penalty if w[-1] != k else 0) + s, [*w, k]) for v, w in ways), key=lambda x: x[0]) for k, s in enumerate(row)]
    return max(ways, key=lambda x: x[0])[1]


def test_language_and_score_follow_from_the_word_scores(spark):
    words = {"aa": "ba bebe bobo bibi bubu", "bb": "ka keke koko kiki kuku", "cc": "ξα ξεξε ξοξο ξιξι ξυξυ"}
    rows = [(i, " ".join(words[x].split()[k % 3 :]) + f" {words[x]}", x) for k, x in enumerate(list(words) * 10) for i in [k]]
    mixed = ["ba bebe keke koko kiki kuku ka", "bobo, ξα ξεξε! ka", "b" * 5000 + " keke " * 700, "BEBE keke ξιξι", "123 --", ""]
    docs = spark.createDataFrame(rows + [(100 + i, t, None) for i, t in enumerate(mixed)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for i, t in enumerate(mixed):
        r, found = got[100 + i], re.findall(r"[^\W\d_]+", t.lower())
        if not found:
            assert (r.lang_pred, r.score) == (langid.UNDETERMINED, 0.0)
            continue
        scores = model.words(langid.read([t.encode()]))
        labels = label([[float(x) for x in row] for row in scores], langid.SWITCH_PENALTY)
        letters = {x: sum(len(w) for w, k in zip(found, labels) if model.langs[k] == x) for x in model.langs}
        best = max(sorted(letters), key=letters.get)
        assert len(scores) == len(found) and r.lang_pred == best
        assert r.score == pytest.approx(letters[best] / sum(letters.values()))
