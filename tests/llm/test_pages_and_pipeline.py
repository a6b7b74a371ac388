"""WARC archives, chat perspectives, the SQL of this subpackage's queries, and the pipeline's stages."""

import base64
import collections
import hashlib
import random
from pathlib import Path

import duckdb
import pytest
from conftest import same_rows

import corpus_pipeline
from loopmill.llm import chat, registry, warc


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        duck.sql(f"create view {path.stem} as select * from '{path}'")
    same_rows(registry.queries()[name](spark, sf).toPandas(), duck.sql(registry.oracle_sql()[name]).df())


def test_every_operator_has_a_query():
    numbered = [n for n in registry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in numbered] == list(range(1, 14))
    assert set(registry.queries()) - set(numbered) == {"token_limits"}


def test_url_keys():
    assert warc.url_key("HTTP://www.Example.com:80/a?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("https://b.example.com:8443") == "com,example,b:8443)/"
    assert warc.url_key(None) == ")/" and warc.url_key("http://[x") == ")http://[x"


def test_archive_round_trip(spark):
    draw = random.Random(3)
    html = ["", None, "<p>a</p>", "ü" * 5000, "x\r\n\r\ny"] + [str(k) * k for k in range(30)]
    rows = [(i, draw.choice([None, "", "http://hot.example/", "http://[bad", "http://c\n.d/e\tf", *(f"http://h{k}.org/p" for k in range(4))]), draw.choice(html), 1, "k") for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, surt int, key string").repartition(4)
    got = warc.archive(pages).collect()
    last = {}
    for i, _, h, *_ in rows:
        last[h or ""] = max(last.get(h or "", -1), i)
    want = collections.Counter()
    for i, _, h, *_ in rows:
        raw, keep = (h or "").encode(), last[h or ""]
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == keep else "revisit", None if i == keep else keep)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_repeated_and_null_pages(spark):
    rows = [(1, "http://a/", "x"), (1, "http://a/", "x"), (None, "http://a/", "x"), (None, None, "y"), (7, "http://a/", "x")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(False, 1, "revisit", 7)] * 2 + [(False, 7, "response", 0), (True, 0, "response", 0), (True, 0, "revisit", 7)]
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lookup_reads_the_captures_asked_for(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"<p>{i}</p>") for i in range(500)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(warc.decide(pages), folder, archives=3, block_lines=10)
    assert files.count() > 1
    wanted = spark.createDataFrame([("http://h3.org/3", 3), ("http://h3.org/3", 3), ("http://h0.org/497", 497), ("http://h1.org/3", 3), (None, None)], "url string, page_id long")
    assert sorted(r.page_id for r in warc.read_captures(wanted, files, folder).collect()) == [3, 497]


def test_urls_with_control_characters_are_found(spark, tmp_path):
    urls = [f"http://a.org/x{c}{e}" for c in "\x01\x02 \x1f" for e in "zma"] + [f"http://[x{c}{e}" for c in "\x01\t" for e in "za"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(warc.decide(pages), folder, archives=2, block_lines=3)
    assert sorted(r.page_id for r in warc.read_captures(pages, files, folder).collect()) == list(range(len(urls)))


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, None, "hm"), (1, 2, "ann", "again"), (2, 0, "system", "alone"), (None, None, "ann", "x"), (None, None, "ann", "x")]
    odd = spark.createDataFrame([(*r, "m", 4, 1) for r in rows], "conv_id long, turn long, role string, text string, messages string, at long, rank int")
    got = {(r.conv_id, r.speaker): r for r in chat.rotate(odd).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = got[(1, "ann")]
    assert ann.rendered == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\nagain<|im_end|>\n"
        "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nhm<|im_end|>\n"
    )
    assert [ann.rendered[m.start : m.start + m.length] for m in ann.masks] == ["hi < |im_end|><|im_end|>", "again<|im_end|>"]
    assert got[(None, "ann")].turns == 2 and got[(None, "ann")].own_turns == 2
    assert chat.rotate(odd.filter("false")).count() == 0


def test_long_dialogues_come_in_chunks(spark):
    rows = [(9, i, "ab"[i % 2], f"t{i}") for i in range(150)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk_turns=40).orderBy("speaker", "chunk").collect()
    assert [(r.speaker, r.chunk, r.turns) for r in got] == [(s, k, n) for s in "ab" for k, n in enumerate([40, 40, 40, 30])]
    whole = "".join(r.rendered for r in got if r.speaker == "a")
    assert whole == "".join(f"<|im_start|>{'user name=b' if i % 2 else 'assistant'}\nt{i}<|im_end|>\n" for i in range(150))


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "123 ...", "en", "s", 7), (10**6 + 1, None, None, None, None), (None, "the and of the in that is it was", "en", "s", 1)], docs.schema)
    # the same words in one line and in several: the line stage keeps both, the near-duplicate stage one
    words = [f"wort{i * 7919 % 1009}" for i in range(90)]
    junk = junk.unionByName(spark.createDataFrame([(10**6 + 5, " ".join(words), "en", "s", 1), (10**6 + 6, "\n".join(" ".join(words[k : k + 9]) for k in range(0, 90, 9)), "en", "s", 1)], docs.schema))
    at, columns = docs.unionByName(junk), docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf).persist()
        seen[name] = at
        if name != "packed":
            assert at.columns == columns and at.schema == docs.schema
    assert {10**6, 10**6 + 1}.isdisjoint(r.doc_id for r in seen["language"].select("doc_id").collect())
    assert seen["language"].count() >= docs.count() * 0.98
    from loopmill.llm import decontaminate, near_dedup

    near = near_dedup.near_duplicates(seen["near_duplicates"])
    assert near.filter("NOT kept").count() == 0 < seen["lines"].count() - seen["near_duplicates"].count()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.find_spans(seen["near_duplicates"], bench).filter("size(spans) > 0").count() > 0
    assert decontaminate.find_spans(seen["benchmark"], bench).filter("size(spans) > 0").count() == 0
    assert seen["packed"].select("doc_id").distinct().count() == seen["benchmark"].select("doc_id").distinct().count()


CLASHES = "lang_pred string, score double, spans string, in_runs double, n_words long, items string, n_lines long, n_removed long, held string, kept boolean, gone int, text_hash long, component_id long"


def test_stages_leave_other_columns_alone(spark, sf):
    """Clashing names, nulls, repeated rows, ids with two texts, ties and a very long text go through all stages."""
    vocabulary = [f"w{i * 7919 % 1009}" for i in range(700)]
    base = " ".join(vocabulary[:120])
    other = (None, 0.5, "s", 0.25, -1, None, -2, -3, "h", True, 9, 8, 7)
    rows = [(1, base), (2, "\n".join(" ".join(vocabulary[k : k + 10]) for k in range(0, 120, 10))), (3, None), (4, ""), (5, " ".join(vocabulary * 40)), (6, " ".join(vocabulary[200:280])), (6, " ".join(vocabulary[200:280])), (6, " ".join(vocabulary[300:380])), (None, " ".join(vocabulary[400:480]))]
    docs = spark.createDataFrame([(i, t, "en", None if t is None else len(t), *other) for i, t in rows], f"doc_id long, text string, lang string, n_chars long, {CLASHES}")
    extra = [c.split()[0] for c in CLASHES.split(", ")]
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf).persist()
        assert at.columns == docs.columns
        assert {tuple(r) for r in at.select(*extra).collect()} == {other}
        assert at.filter("n_chars <> length(text)").count() == 0
    left = sorted((r.doc_id or 0, r.text) for r in at.collect())
    assert [(i, t) for i, t in left] == sorted([(0, rows[8][1]), (1, base), (5, rows[4][1]), (6, rows[5][1]), (6, rows[7][1])])
    assert corpus_pipeline.packed(spark, at, sf).select("doc_id").distinct().count() == 4


def test_mixed_languages_and_unknown_ones_stay(spark):
    words = {"en": "the house and garden with children", "de": "straße und häuser über schöne gärten", "fr": "où été déjà français élève forêt", "es": "niño mañana señor corazón también según"}
    rows = [(i, " ".join(words[x].split()[k % 5 :] + words[x].split()) + f" {i}", x) for k, x in enumerate(words) for i in range(40 * k, 40 * k + 40)]
    mixed = [(1000 + i, "\n".join(" ".join([words[x]] * 4) for x in words), None) for i in range(3)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [r[0] for r in rows + mixed]
    unnamed = spark.createDataFrame([(*r[:2], None) for r in rows + mixed], docs.schema)
    assert corpus_pipeline.language(spark, unnamed, "").count() == len(rows + mixed)


def test_pipeline_of_nothing(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
