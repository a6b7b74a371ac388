"""Operator 13: phrases against plain counting, and the query against its SQL."""

import collections
import random
import re
from pathlib import Path

import duckdb
import pytest
from conftest import same_rows

from loopmill.llm import collocations, registry

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest, least, top, percent):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[(lang or "und", *words[i : i + k])] += 1
    found = collections.defaultdict(list)
    for (lang, *words), a in counts.items():
        if len(words) < 2 or a < least:
            continue
        best = min((1_000_000 * a * a // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k) for k in range(1, len(words)))
        inside = lambda longer: any(longer[i : i + len(words)] == tuple(words) for i in range(len(longer) - len(words) + 1))  # noqa: B023, E731
        if any(n >= least and 100 * n >= percent * a and len(q) - 1 > len(words) and q[0] == lang and inside(q[1:]) for q, n in counts.items()):
            continue
        l, r = counts[(lang, *words[: best[1]])], counts[(lang, *words[best[1] :])]
        found[lang].append((-best[0], -a, " ".join(words).encode(), l, r))
    return {(lang, rank, p[2].decode(), -p[1], p[3], p[4], totals[lang], -p[0]) for lang, ps in found.items() for rank, p in enumerate(sorted(ps)[:top], 1)}


def sentences(seed, n):
    draw = random.Random(seed)
    words = ["a", "B", "b", "Ä", "ä", "x y", "new", "york", "city", "of", "the", "z"]
    phrases = ["new york city", "NEW  york", "of\tthe", "a a a", "the city of"]
    rows = []
    for _ in range(n):
        parts = [draw.choice(words + phrases) + draw.choice([" ", " ", " ", "\t ", ". ", "\n", "!", "\r\n"]) for _ in range(draw.randrange(40))]
        rows.append((draw.choice(["en", "de", None, "und"]), "".join(parts)))
    return rows + [("en", None), ("fr", ""), ("fr", ". . ."), (None, "a " * 3000)]


@pytest.mark.parametrize("longest,least,broadcast", [(3, 4, 2_000_000), (3, 4, 5), (2, 2, 0), (5, 3, 2_000_000), (4, 3, 3)])
def test_phrases_are_the_plain_ones(spark, longest, least, broadcast):
    """Few keys sent as they are, or as a bitmap; long phrases too."""
    rows = sentences(longest, 120)
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, text string, n long")
    got = collocations.collocations(docs, most_words=longest, least=least, top=25, broadcast_keys=broadcast)
    assert {tuple(r) for r in got.collect()} == plain(rows, longest, least, 25, 50)


def test_texts_of_several_stretches(spark, monkeypatch):
    rows = sentences(9, 200)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    whole = sorted(map(tuple, collocations.collocations(docs).collect()))
    monkeypatch.setattr(collocations, "STRETCH_BYTES", 500)
    monkeypatch.setattr(collocations, "SENT_ROWS", 7)
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == whole == sorted(plain(rows, 3, 10, 2000, 50))


def test_odd_tables(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("x", "one two")], "lang string, text string")).count() == 0
    one = spark.createDataFrame([("x", "u v. " * 50)], "lang string, text string")
    assert [tuple(r) for r in collocations.collocations(one).collect()] == [("x", 1, "u v", 50, 50, 50, 100, 1_000_000)]


def test_exact_beyond_64_bits(spark):
    a, left, right = 3 * 10**12 + 1, 4 * 10**12 + 3, 5 * 10**12 + 7
    tables = [spark.createDataFrame([("x", 1, "u", left), ("x", 2, "v", right)], "lang string, key long, phrase string, n long"), spark.createDataFrame([("x", 3, "u v", a)], "lang string, key long, phrase string, n long")]
    assert collocations.lowest_cuts(tables, 2).first().score == 1_000_000 * a * a // (left * right)


def test_query_equals_sql(spark, sf):
    connection = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    same_rows(registry.op13_collocations(spark, sf).toPandas(), connection.sql(registry.oracle_sql()["op13_collocations"]).df())
