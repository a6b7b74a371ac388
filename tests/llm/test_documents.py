"""Operators over documents: brute force on small random tables, and the cases that each docstring defines."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopmill.llm import decontaminate, langid, line_dedup, lm_score, media, near_dedup, packing, token_counts
from loopmill.llm.common import crc_bucket
from loopmill.llm.tokens import default_path, encoder
from loopmill.llm.wordscan import ALNUM, scan

WORDS = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta,", "eta.", "theta", "x1", "don't", "the", "of"]


def text(draw, low, high, words=WORDS):
    return " ".join(draw.choice(words) for _ in range(draw.randint(low, high)))


def documents(spark, rows):
    """Rows (doc_id, text, lang) among columns whose names the operators use inside."""
    odd = "node long, bucket string, gone int, spans string, score double, ids string, part int, component string, deleted boolean"
    return spark.createDataFrame([(*r, 1, "b", 2, "s", 0.5, "i", 3, "c", True) for r in rows], f"doc_id long, text string, lang string, {odd}")


@pytest.fixture(scope="module")
def mixed(spark):
    """Nulls, empty and blank texts, repeated rows, near copies, and a very long text."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = text(draw, 80, 80, vocabulary)
    rows = [(1, None, "en"), (2, "", "en"), (3, "  \n ", None), (None, "alpha beta gamma", "en"), (None, None, None), (4, "one", "de"), (5, "one two", "de")]
    rows += [(10 + i, text(draw, 1, 60, vocabulary), draw.choice(["en", "de"])) for i in range(40)]
    rows += [(60 + i, " ".join(w if draw.random() > 0.02 else "edit" for w in base.split()), "en") for i in range(12)]
    rows += [(80, base, "en"), (81, base.upper(), "en"), (80, base, "en"), (82, text(draw, 20_000, 20_000, vocabulary), "en"), (83, "ü" * 300_000, "de")]
    return rows


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [(1, "x", "en")]).filter("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_scan_finds_words():
    draw = random.Random(1)
    texts = ["".join(draw.choice("aB \t\n.é9,") for _ in range(draw.randint(0, 40))) for _ in range(300)] + ["y" * 600_000 + " z"]
    for table, pattern in ((None, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = scan([t.encode() for t in texts], **({} if table is None else {"word": table}))
        each = [re.findall(pattern, t.translate(str.maketrans("AB", "ab"))) for t in texts]
        want = [x for found in each for x in found]
        assert [w.word(i).decode().translate(str.maketrans("AB", "ab")) for i in range(len(w.hash))] == want
        assert len({*zip(want, w.hash.tolist())}) == len(set(want)) == len(set(w.hash.tolist()))
        assert np.diff(w.first).tolist() == [len(found) for found in each]


def test_media_round_trip(spark, mixed, empty):
    got = media.media_columns(documents(spark, mixed)).collect()
    want = collections.Counter()
    for i, t, _ in mixed:
        raw = (t or "").encode()
        payload = raw + b" " * (max(-(-len(raw) // 192), 1) * 192 - len(raw))
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    places = {(r.shard, r.media_offset) for r in got}
    assert len(places) == len({r.payload_sha256 for r in got})
    assert all((r.media_width, r.bit_depth, r.colour_type) == (192, 8, 0) and r.media_height * 192 == r.payload_bytes for r in got)
    assert media.media_columns(empty).count() == 0
    sample = bytes(random.Random(2).randbytes(192 * 7))
    assert media.from_png(media.to_png(sample)) == sample
    with pytest.raises(ValueError):
        media.from_png(media.to_png(sample)[:-20] + b"x" * 20)


def plain_viterbi(score, penalty):
    value, back = np.zeros(score.shape[1]), []
    for s in score:
        jump = value.max() - penalty
        back.append(np.where(value >= jump, np.arange(len(value)), value.argmax()))
        value = np.maximum(value, jump) + s
    out = [int(value.argmax())] if len(score) else []
    for b in back[:0:-1]:
        out.append(int(b[out[-1]]))
    return out[::-1]


def test_viterbi_equals_plain():
    draw = np.random.default_rng(4)
    for _ in range(60):
        n = draw.integers(0, 30, draw.integers(1, 7))
        first = np.concatenate([[0], np.cumsum(n)])
        score = draw.normal(size=(first[-1], draw.integers(1, 5))) * 3
        want = [x for a, b in zip(first, first[1:]) for x in plain_viterbi(score[a:b], 4.0)]
        assert langid.viterbi(score, first, 4.0, length=int(draw.integers(1, 8))).tolist() == want


def test_language_spans(spark, empty):
    english, greek, german = "the quick brown fox jumps over the lazy dog and then sleeps", "η γρήγορη αλεπού πηδάει πάνω από το σκυλί", "der schnelle braune fuchs springt über den faulen hund und schläft"
    rows = [(i, t, n) for i, (t, n) in enumerate([(english, "en"), (greek, "el"), (german, "de")] * 4)]
    rows += [(100, f"{english} {german} {german}", None), (101, None, None), (102, "12 %% ...", None), (103, greek.upper(), None), (104, "", "en"), (None, english, None)]
    docs = documents(spark, rows)
    model = langid.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert model.langs == ["de", "el", "en"]
    assert [s.lang for s in got[100].spans] == ["en", "de"] and got[100].lang_pred == "de" and 0.5 < got[100].score < 1
    assert sum(s.words for s in got[100].spans) == len(f"{english} {german} {german}".split())
    assert all((got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, []) for k in (101, 102, 104))
    assert got[103].lang_pred == "el" and got[None].lang_pred == "en" and got[None].bucket == "b"
    nothing = langid.fit(docs, F.lit(False))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0 and langid.fit(empty, F.lit(True)).langs == []


def test_copies_do_not_change_the_language_model(spark):
    """Few texts, each thousands of times, give the model of the texts alone; so do copies beside many texts."""
    few = spark.range(60_000).selectExpr("concat('word', id % 3, ' other', id % 3) AS text", "'aa' AS lang")
    many = spark.range(12_000).selectExpr("concat('text', greatest(id, 6000)) AS text", "'bb' AS lang")
    copied = few.unionByName(many)
    one, other = langid.fit(copied, F.lit(True), sample_docs=5), langid.fit(copied.distinct(), F.lit(True), sample_docs=5)
    assert one.langs == other.langs == ["aa", "bb"] and np.array_equal(one.score, other.score) and np.array_equal(one.allowed, other.allowed)
    skewed = spark.range(4_000).selectExpr("concat('text', id % 20) AS text", "'cc' AS lang")
    one, other = langid.fit(skewed, F.lit(True), sample_docs=10), langid.fit(skewed.distinct(), F.lit(True), sample_docs=10)
    assert np.array_equal(one.score, other.score)


def test_held_out_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held_out = crc_bucket("doc_id", 3) == 1
    found = langid.identify(docs, langid.fit(docs, ~held_out)).filter(held_out)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_token_ids_equal_the_library():
    enc = encoder(default_path())
    texts = ["don't <|endoftext|> Stop.", "a b́ é.", "", " \n", "İstanbul ΣΑΣ Σ", "\x1c\x1f a\x85b c", "日本語 テスト。", "👍🏽 ok'll 123,456.", "x" * 5000, "end.,. a.b., it's."]
    ids, bounds = enc.encode([t.encode() for t in texts], 2)
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 2]
    assert enc.counts([t.encode() for t in texts]).tolist() == [len(enc.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing_covers_every_id(spark, mixed, empty):
    tokenizer = encoder(default_path()).tokenizer
    docs = documents(spark, mixed).repartition(5)
    got = packing.pack(docs, length=64).collect()
    want = collections.Counter(b"".join(int(x).to_bytes(4, "little") for x in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for _, t, _ in mixed)
    pieces, stream = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.length > 0
        stream.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.sequence_id * 64 + r.offset] = r
    assert sorted(stream) == list(range(len(stream)))
    for k, parts in stream.items():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 64 or k == max(stream))
    whole, texts = b"", collections.Counter()
    for _, r in sorted(pieces.items()):
        assert r.start == len(whole) // 4 and r.starts_doc == (r.start == 0)
        whole += r.ids
        if r.ends_doc:
            assert r.doc_tokens == len(whole) // 4
            texts[whole] += 1
            whole = b""
    assert texts == want
    assert packing.pack(empty).count() == 0


def test_length_histogram_answers(spark, mixed, empty):
    tokenizer = encoder(default_path()).tokenizer
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, _ in mixed]
    sums = token_counts.suffix_sums(token_counts.length_histogram(documents(spark, mixed)), block=16).persist()
    for r in sums.collect():
        assert (r.n_docs, r.docs_ge, r.docs_lt) == (n.count(r.n_tokens), sum(x >= r.n_tokens for x in n), sum(x < r.n_tokens for x in n))
        assert (r.tokens_ge, r.tokens_lt) == (sum(x for x in n if x >= r.n_tokens), sum(x for x in n if x < r.n_tokens))
        assert r.tokens_at_limit == sum(min(x, r.n_tokens) for x in n)
    limits = spark.createDataFrame([(x,) for x in (0, 1, 7, n[8], 100, 10**7, 7, None)], "context_limit long")
    for r in token_counts.answer_limits(sums, limits).collect():
        if r.context_limit is not None:
            assert (r.docs_longer, r.tokens_at_limit) == (sum(x > r.context_limit for x in n), sum(min(x, r.context_limit) for x in n))
    assert token_counts.suffix_sums(token_counts.length_histogram(empty)).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolated_scores(spark, mixed, empty, order):
    docs = documents(spark, mixed)
    held_out = crc_bucket("doc_id", 7) == 2
    got = lm_score.score(docs, ~held_out, held_out, order=order).collect()
    tokens = [(i, [*words(t), None]) for i, t, _ in mixed]
    count = collections.Counter(w for i, ws in tokens if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for w in ws)
    total = sum(count.values())
    want = collections.Counter()
    for i, ws in tokens:
        base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in ws)
        want[(i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(ws), sum(count[w] > 0 for w in ws), total, round(base, 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in got)
    if order > 1:
        assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm_score.score(empty, ~held_out, held_out).count() == 0
    untrained = lm_score.score(docs, F.lit(False), F.lit(True)).collect()
    assert {(r.score, r.base_score, r.n_known) for r in untrained} == {(0.0, 0.0, 0)}


def test_mixture_is_a_distribution():
    """Over all known words and one unknown, the estimates of a context sum to one."""
    ratios = np.array([[1.0, 5.0, 0.0], [1.0, 3.0, 20.0], [1.0, 0.0, 0.0]])
    mixture = lm_score.expectation_maximisation(ratios, np.array([5.0, 3.0, 1.0]))
    assert mixture.sum() == pytest.approx(1) and (mixture >= 0).all() and mixture[0] > 0


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, mixed, empty, size, percent):
    rows = [r for r in mixed if r[0] != 83]
    sets = {}
    for i, t, _ in rows:
        if i is not None:
            w = words(t)
            sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = near_dedup.near_duplicates(documents(spark, rows), size=size, percent=percent).collect()
    want = collections.Counter((i, len(sets[i]), find(i), find(i) == i) for i, _, _ in rows if i is not None)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert near_dedup.near_duplicates(empty).count() == 0


def test_cluster_around_the_threshold(spark):
    """Copies of one text with so many edits that some are linked to the hub, some to each other, some to none."""
    draw = random.Random(21)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(90)]
    rows = []
    for i in range(140):
        w = list(base)
        for k in draw.sample(range(90), draw.randint(0, 7)):
            w[k] += draw.choice("xy")
        rows.append((i, " ".join(w[draw.choice([0, 0, 0, 2]) :]), None))
    rows += [(200 + i, " ".join([*rows[100 + i][1].split()[:-1], "other"]), None) for i in range(30)]
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, rows), size=3, percent=85).collect()}
    assert len(set(got.values())) > 5 and got == {i: find(i) for i in sets}


def test_many_copies_of_one_hub(spark):
    """10,000 copies of one text, each edited by itself: one component, and the hub's text once for each part."""
    draw = random.Random(5)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(60)]
    rows = [(0, " ".join(base), None)]
    for i in range(1, 10_001):
        w = list(base)
        w[draw.randrange(60)] = f"own{i}"
        rows.append((i, " ".join(w), None))
    docs = documents(spark, rows)
    got = near_dedup.near_duplicates(docs, size=3, percent=85).agg(F.max("component_id"), F.sum(F.col("kept").cast("int")), F.count("*")).first()
    assert tuple(got) == (0, 1, 10_001)
    pairs = docs.filter("doc_id > 0").select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("hub"))
    beside = near_dedup.beside_hubs(pairs, docs.select(F.col("doc_id").alias("node"), "text"))
    counts = beside.groupBy("part").agg(F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("hubs"), F.sum(F.length("text")).alias("chars")).collect()
    assert sum(r.members for r in counts) == 10_000 and [r.hubs for r in counts] == [1] * 10
    assert max(r.members for r in counts) < 1.2 * near_dedup.PART_ROWS
    assert sum(r.chars for r in counts) == sum(len(t) for _, t, _ in rows) + 9 * len(rows[0][1])


def test_a_hub_id_with_other_texts(spark):
    """A member is compared with every text of its hub's id, repeated rows or not."""
    one, two = (" ".join(f"{c}{k}" for k in range(30)) for c in "pq")
    texts = documents(spark, [(1, one, None), (1, two, None), (1, two, None), (2, one + " more", None), (3, two + " more", None), (4, "", None)])
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "node long, hub long")
    found = near_dedup.confirm(pairs, texts.select(F.col("doc_id").alias("node"), "text"), 3, 85)
    assert sorted(tuple(r) for r in found.collect()) == [(2, 1), (3, 1)]


def test_line_dedup_equals_all_pairs(spark, empty):
    draw = random.Random(9)
    lines = [text(draw, 8, 14, [f"wort{i}" for i in range(60)]) for _ in range(30)]
    near = [" ".join([*x.split()[:-1], "änderung"]) for x in lines[:15]]
    rows = []
    for i in range(25):
        rows.append((i, "\n".join(draw.choice([*lines, *near, lines[0].upper() + "!", "", "short line here"]) for _ in range(draw.randint(1, 8))), "en"))
    rows += [(100, None, None), (101, "", None), (None, lines[3], None), (102, " ".join(f"v{i}" for i in range(900)), None), (103, " ".join(f"v{i}" for i in range(900)) + " end", None), (3, rows[3][1], "en")]
    got = collections.Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(documents(spark, rows)).collect())
    # brute force over the same fingerprints and the same measure of similarity
    frame = documents(spark, rows).select("doc_id", "text")
    seen = line_dedup.occurrences(frame).collect()
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    by_id = {(i, k): norm(x) for i, t, _ in rows if t for k, x in enumerate(t.split("\n"))}
    sim = {by_id[(r.doc_id, r.pos)]: r.sim for r in seen}
    assert {x for x in by_id.values() if len(x.split(" ")) >= 5} == set(sim)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    root = {x: x for x in sim}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for a, b in itertools.combinations(sorted(sim), 2):
        if bin(sim[a] ^ sim[b]).count("1") <= line_dedup.DISTANCE:
            if edits(a, b) <= max(len(a), len(b)) * 20 // 100:
                linked += 1
                root[find(a)] = find(b)
    assert linked > 0
    kept = {}
    for r in seen:
        g = find(by_id[(r.doc_id, r.pos)])
        kept[g] = min(kept.get(g, (math.inf, 0)), (-1 if r.doc_id is None else r.doc_id, r.pos))
    want = collections.Counter()
    for i, t, _ in rows:
        parts = (t or "").split("\n")
        stay = [x for k, x in enumerate(parts) if len(norm(x).split(" ")) < 5 or kept[find(norm(x))] == (-1 if i is None else i, k)]
        want[(i, None if t is None else "\n".join(stay), 0 if t is None else len(parts), len(parts) - len(stay))] += 1
    assert got == want
    assert line_dedup.dedup_lines(empty).count() == 0


def lines_left(spark, folder, rows):
    """n_removed of each document in the query of operator 8."""
    from loopmill.llm import registry

    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return {r.doc_id: r.n_removed for r in registry.op8_line_dedup(spark, str(folder)).collect()}


def test_lines_with_one_other_word_go(spark, tmp_path):
    """Edit similarity decides, not the distance of fingerprints: all pairs here have 80 % and differ by one word."""
    draw = random.Random(15)
    rows = []
    for i, n in enumerate([6, 8, 12, 20, 35, 60, 100, 150] * 3):
        line = [f"w{draw.randint(0, 10**5)}" for _ in range(n)]
        rows.append((i, " ".join(line)))
        line[draw.randrange(n)] = f"w{draw.randint(0, 10**5)}"
        rows.append((1000 + i, " ".join(line)))
    got = lines_left(spark, tmp_path, rows)
    assert got == {i: int(i >= 1000) for i, _ in rows}


def test_lines_with_a_word_more_or_an_edit_go(spark, tmp_path):
    """Dropped words and single letters, from three words on; all pairs here have an edit similarity of 80 %."""
    draw = random.Random(18)
    rows, at = [], 0
    for n in [3, 4, 5, 6, 7, 8, 9, 12, 20, 40, 80] * 2:
        line = [f"wort{draw.randint(10**5, 10**6)}" for _ in range(n)]
        k = draw.randrange(n)
        edits = [[*line[:k], line[k][:4] + "x" + line[k][4:], *line[k + 1 :]]] + ([[*line[:k], *line[k + 1 :]]] if n > 5 else [])
        for other in edits:
            # every pair has words of its own, so that no line is linked through another pair's
            rows += [(at, " ".join(f"{w}{at}" for w in line)), (1000 + at, " ".join(f"{w}{at}" for w in other))]
            at += 1
    assert lines_left(spark, tmp_path, rows) == {i: int(i >= 1000) for i, _ in rows}


def test_short_lines_and_lines_without_spaces_go(spark, tmp_path):
    """Equal lines of any length; near copies of few words or in scripts without spaces. Blank lines stay."""
    draw = random.Random(16)
    han = "".join(chr(0x4E00 + draw.randint(0, 2000)) for _ in range(60))
    rows = [(1, f"All rights reserved\n\nend\n{han}\nunconditionally guaranteed merchandise"), (2, f"all RIGHTS reserved!\n\nEnd."), (3, han), (4, han[:30] + "山" + han[31:]), (5, "短い"), (6, "短い"), (7, "unconditionally guaranteed merchandize"), (8, "once more")]
    assert lines_left(spark, tmp_path, rows) == {1: 0, 2: 2, 3: 1, 4: 1, 5: 0, 6: 1, 7: 1, 8: 0}


def test_simhash_forms_agree(spark):
    """Sums of lanes and slices of any number of features give the same fingerprint."""
    draw = random.Random(5)
    lines = [" ".join(f"w{draw.randint(0, 9)}" for _ in range(n)) for n in (5, 6, 50, 254, 255, 256, 700)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    features = rows.select("doc_id", line_dedup._features(line_dedup.line_words(F.col("text"))).alias("f")).select("doc_id", "f", line_dedup.simhash(F.col("f")).alias("s"))
    seen = {r.doc_id: r.sim for r in line_dedup.occurrences(rows).collect()}
    for r in features.collect():
        want = sum((sum((h >> b) & 1 for h in r.f) > len(r.f) // 2) << b for b in range(line_dedup.BITS))
        assert r.s == seen[r.doc_id] == want


def brute_windows(docs, items, size):
    found = []
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, {tuple(w[k : k + min(size, len(w))]) for k in range(max(len(w) - size + 1, 1))} if w else set()) for i, w in ((i, cut(t)) for i, t in items)]
    for i, t in docs:
        w, hit, own = cut(t), set(), set()
        for item, grams in windows:
            for g in grams:
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        hit |= {*range(k, k + len(g))}
                        own |= {str(item)} if item is not None else set()
        found.append((i, len(w), len(hit), tuple(sorted(own))))
    return collections.Counter(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_windows_equal_brute_force(spark, empty, block_bytes):
    draw = random.Random(6)
    few = ["a", "B", "c", "é", "d."]
    docs = [(i, text(draw, 0, 70, few), None) for i in range(30)] + [(50, None, None), (None, "a a a b", None), (51, "", None), (52, text(draw, 3000, 3000, few), None)]
    items = [(i, text(draw, 3, 9, few)) for i in range(8)] + [(20, None), (21, "..."), (None, "a a a"), (1, "é é"), (22, "a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_spans(documents(spark, docs), bench, window=4, block_bytes=block_bytes).select("doc_id", "n_words", decontaminate.span_words("spans").alias("n"), "items", "bucket").collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n, tuple(r["items"])) for r in got) == brute_windows([d[:2] for d in docs], items, 4)
    assert {r.bucket for r in got} == {"b"}
    clean = decontaminate.find_spans(documents(spark, docs), bench.filter("false"), window=4)
    assert clean.filter("size(spans) > 0").count() == 0 and clean.count() == len(docs)
    assert decontaminate.find_spans(empty, bench).count() == 0


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "red green blue yellow")], "item_id long, text string")
    docs = documents(spark, [(1, "Start: Red, green. BLUE yellow! end", None), (2, None, None), (3, "red green", None), (4, "red green blue yellow", None)])
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(decontaminate.find_spans(docs, bench)).collect()}
    assert got == {1: "Start: ! end", 2: None, 3: "red green", 4: ""}


def test_index_search_and_locate():
    draw = np.random.default_rng(8)
    for _ in range(30):
        symbols = draw.integers(0, 4, draw.integers(1, 200))
        symbols[-1] = 0
        index = decontaminate.FMIndex(symbols, 4, every=5)
        pattern = draw.integers(1, 4, (20, 3))
        length = draw.integers(1, 4, 20)
        low, high = index.search(np.where(np.arange(3) < length[:, None], pattern, 0), length)
        for p, n, a, b in zip(pattern, length, low, high):
            want = [i for i in range(len(symbols) - n + 1) if (symbols[i : i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_base32_digest_is_native():
    from loopmill.llm import warc

    raw = warc.record(5, "http://a/", base64.b32encode(hashlib.sha1(b"x\r\n\r\ny").digest()).decode(), None, b"x\r\n\r\ny", 6)
    assert warc.parse(raw) == {"page_id": 5, "record_type": "response", "payload_bytes": 6, "payload_digest": base64.b32encode(hashlib.sha1(b"x\r\n\r\ny").digest()).decode(), "refers_to": None}
