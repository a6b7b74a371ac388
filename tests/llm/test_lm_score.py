"""The whole score of operator 6 against interpolation written plainly, over its own estimation step."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopmill.llm import lm_score
from loopmill.llm.common import crc_bucket

START, END = "<start>", "<end>"


def grams(tokens, order):
    """For each level, the n-gram that ends at each token; the first ones begin with the start."""
    out = [list(tokens)]
    for _ in range(order - 1):
        out.append([(out[-1][i - 1] if i else START, w) for i, w in enumerate(tokens)])
    return out


class Counts:
    def __init__(self, texts, order):
        self.docs = len(texts)
        self.of = [collections.Counter(g for t in texts for g in grams(t, order)[k]) for k in range(order)]
        self.total, self.words = sum(self.of[0].values()), len(self.of[0])

    def estimates(self, tokens, order):
        levels = grams(tokens, order)
        for i in range(len(tokens)):
            p, bucket = [1 / (self.words + 1), self.of[0][tokens[i]] / max(self.total, 1)] + [0.0] * (order - 1), 0
            for k in range(order - 1):
                before = self.of[k][levels[k][i - 1]] if i else self.docs
                if before:
                    p[k + 2] = self.of[k + 1][levels[k + 1][i]] / before
                    bucket = 64 * (k + 1) + int(math.log2(before))
            yield bucket, p


@pytest.mark.parametrize("order", [1, 2, 3])
def test_score_is_the_plain_interpolation(spark, order):
    draw = random.Random(order)
    words = [f"W{i}" for i in range(30)]
    rows = [(i, " ".join(draw.choice(words[: draw.choice([3, 10, 30])]) for _ in range(draw.randint(0, 40)))) for i in range(150)] + [(200, None), (201, "x"), (7, "y y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held_out = crc_bucket("doc_id", 7) == 2
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in lm_score.score(docs, ~held_out, held_out, order=order).collect())
    ids = docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(lm_score.DELETED)).alias("d")).collect()
    deleted = {r.doc_id for r in ids if r.d == 0}
    tokens = [(i, [*re.findall(r"\S+", (t or "").lower()), END]) for i, t in rows]
    train = [(i, t) for i, t in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    left = Counts([t for i, t in train if i not in deleted], order)
    classes = collections.Counter()
    for i, t in train:
        if i in deleted:
            for bucket, p in left.estimates(t, order):
                classes[(bucket, *(round(math.log(x / p[0]) / lm_score.RATIO_STEP) if x else None for x in p[1:]))] += 1
    ratio = lambda key: [1.0, *(0.0 if x is None else math.exp(x * lm_score.RATIO_STEP) for x in key[1:])]
    learn = lambda keys: lm_score.expectation_maximisation(np.array([ratio(k) for k in keys]), np.array([float(classes[k]) for k in keys]))
    ordered = sorted(classes, key=lambda k: tuple(-(10**6) if x is None else x for x in k))
    pooled, weights = learn(ordered), {b: learn([k for k in ordered if k[0] == b]) for b in {k[0] for k in ordered}}
    whole, want = Counts([t for _, t in train], order), []
    for i, t in tokens:
        score = 0.0
        for bucket, p in whole.estimates(t, order):
            mixture = weights.get(bucket, pooled).copy()
            mixture[2 + bucket // 64 :] = 0
            score += math.log10(float(mixture @ np.array(p)) / mixture.sum())
        want.append((i, len(t), score))
    assert len(deleted) > 5
    for (a, n, x), (b, m, y) in zip(got, sorted(want)):
        assert (a, n) == (b, m) and x == pytest.approx(y, abs=1e-6)
