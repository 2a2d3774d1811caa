"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rankloom.llm import bpe, html_text, licenses, neardup, packing, pii, quality, rules, topk, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, _row string, kept string, n_words string, _text string, `class_id` int"
LONG = " ".join(f"word{i % 977} of the text" for i in range(12000))
PROSE = "The house of the old man was on a hill and it had the view that he liked to see from his chair by the window every day."


def rows():
    made = [(1, PROSE), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, PROSE), (7, PROSE.upper()), (None, PROSE + " x"), (9, "tiny"), (9, "tiny"), (10, "Ünï <|endoftext|> 日本 a@b.co 10.0.0.1")]
    return [(i, t, "en" if t else None, None if i == 9 else "s", len(t or ""), "a", "b", "c", "d", "e", 0) for i, t in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, none):
    lib = Tokenizer.from_file(PATH)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.array(ids, "<u4").tobytes() == bytes(r.ids) and r.n_tokens == len(ids)
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(none, PATH), PATH).count() == 0


def test_rules(docs, none):
    got = {(r.doc_id, r.text): r for r in rules.apply_rules(docs).collect()}
    assert got[1, PROSE].kept and got[6, PROSE].kept and got[1, PROSE].n_words == 28
    assert all(got[k].base_failed and not got[k].kept and got[k].n_words == 0 for k in ((2, None), (3, ""), (4, " \n\t ")))
    assert got[5, LONG].n_repeat_words == 48000 and got[5, LONG].base_failed
    assert rules.apply_rules(none).count() == 0


def test_classifier(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, keep=("text",)).collect()
    assert len(got) == len(rows()) and all(0 <= r.chance <= 1 for r in got)
    assert all(r.kept for r in quality.classify(docs, labels.where("false")).collect())
    assert quality.classify(none, labels).count() == 0


def test_near_duplicates(docs, none):
    got = {(r.doc_id, r.class_id, r.n_copies) for r in neardup.with_classes(docs).collect()}
    assert got == {(1, 1, 3), (6, 1, 3), (7, 1, 3), (None, 1, 1), (2, 2, 3), (3, 2, 3), (4, 2, 3), (5, 5, 1), (9, 9, 2), (10, 10, 1)}
    left = neardup.one_of_each(docs)
    assert left.columns == docs.columns and left.count() == 5
    assert neardup.with_classes(none).count() == 0 and neardup.one_of_each(none).count() == 0


def test_one_of_each_keeps_the_values_of_clashing_columns(spark):
    schema = "doc_id long, text string, _row string, _n int, _low string, _a string, _b string, _bands string, _sketch string, root string, node string"
    rows_ = [(i, PROSE if i < 2 else f"{PROSE} and {i} more", f"row{i}", 7, "low", "a", "b", "bands", "sketch", "root", f"node{i}") for i in range(3)]
    got = neardup.one_of_each(spark.createDataFrame(rows_, schema))
    kept = sorted(map(tuple, got.collect()))
    assert got.columns == [c.split()[0] for c in schema.split(", ")] and len(kept) in (1, 2)
    assert all(r in rows_ for r in kept) and kept[0] == rows_[0]


def test_pii(docs, none):
    got = {r.doc_id: r for r in pii.sanitise(docs).collect() if r.doc_id == 10}
    assert got[10]["_clean"] == "Ünï <|endoftext|> 日本 [email] [ip]" and got[10]["_n"] == [1, 1, 0, 0]
    assert pii.sanitise(docs).count() == len(rows()) and pii.sanitise(none).count() == 0
    removed = pii.sanitise(docs, form="remove").where("doc_id = 5").first()
    assert removed["_clean"] == LONG


@pytest.mark.parametrize("targets", [None, {"s": 2.0}, {"absent": 1.0}])
def test_packing(docs, none, targets):
    lib = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH, targets=targets, window=512, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    place = (got.sequence_id * 512 + got.offset).to_numpy()
    assert place[0] == 0 and (place[1:] == (place + got.length.to_numpy())[:-1]).all() and (got.offset + got.length).max() <= 512
    want = sorted(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows())
    assert got.length.sum() == sum(want)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got.itertuples())
    assert packing.pack(none, PATH, targets=targets).count() == 0


def test_top_k(spark):
    schema = "vec_id long, embedding array<float>, _id string"
    bad = [(3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]
    rows_ = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, -0.01]), (2, [0.5, 0.5]), (7, [0.5]), (None, [0.5, 0.0]), (8, []), *bad]
    df = spark.createDataFrame([(*r, "x") for r in rows_], schema)
    got = topk.top_k(df, F.col("_id") % 20 == 0, k=20).collect()
    assert sorted({r.query_id for r in got}) == [0] and len(got) == 2 * 6
    first = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])][::2]
    assert first == [(0, 4096), (1, 2048), (2, 2048), (7, 2048), (None, 2048), (8, 0)]
    assert topk.top_k(df.where("false"), F.col("_id") % 20 == 0).count() == 0


def test_html(spark):
    page = (
        "<html><head><title>T t t</title></head><body><header><a href='/'>Site</a></header><nav><a>Menu</a></nav><div class='cookie-notice'>We use cookies here</div>"
        "<article><h1>Head &amp; line</h1><p>First  <b>bo</b>ld&nbsp;text\nhere.</p><aside>Side box</aside><form><input>Mail me</form><p>Second<br>part &lt;x&gt;</p>"
        "<section class='comments'><p>Reader says no</p></section></article><footer>Foot note</footer><script>var a = '</p>'</script></body></html>"
    )
    df = spark.createDataFrame([(1, "u", page, "a"), (2, None, None, "a"), (3, "u", "", "a"), (4, "u", "<p>only &am", "a"), (1, "u", page, "a")], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert [r.text for r in got] == ["Head & line First bold text here. Second part <x>", "", "", "only &am"][:4] + ["Head & line First bold text here. Second part <x>"]
    assert html_text.extract(df.where("false")).count() == 0


BODY = "<p>One two three four.</p><p>Five six seven eight.</p>"
WORDS = "One two three four. Five six seven eight."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><div class='content has-sidebar'><article>{BODY}</article><div class='sidebar'>Side box</div></div></body>", WORDS),
        (f"<body><div class=no-sidebar>{BODY}</div></body>", WORDS),
        (f"<body><div class='search'><article>{BODY}</article></div></body>", WORDS),
        (f"<body><form id=aspnetForm><div>{BODY}</div></form></body>", WORDS),
        (f"<body><form><nav>Menu of many words that are more than those of the text in the page</nav><main>{BODY}</main></form></body>", WORDS),
        (f"<body><article><h2 id='search'>Head</h2>{BODY}<p id=alert>Nine ten.</p></article></body>", f"Head {WORDS} Nine ten."),
        (f"<body><div data-id='comments' title='a class=login'>{BODY}</div></body>", WORDS),
        (f"<html><head><meta charset=utf-8><title>T t</title><script>var a</script><body>{BODY}</body></html>", WORDS),
        (f"<html><head lang=en><link rel=x href='a>b'>{BODY}", WORDS),
        (f"<body><svg class='a' viewBox='0 0 1 1'/>{BODY}<svg><path/><text>no</text></svg></body>", WORDS),
        (f"<body><svg><path/>{BODY}</body>", WORDS),
        (f"<body><svg><path/><text>no</text>{BODY}<p>Nine ten.</p></svg></body>", f"{WORDS} Nine ten."),
        (f"<body><svg><svg><text>no</text></svg><text>nor this</text></svg>{BODY}</body>", WORDS),
        (f"<body><nav>Home Blog</nav><div class='widget Blog'><h3>Head line</h3><div class='post-body'>{BODY}</div></div><footer>Foot</footer></body>", f"Head line {WORDS}"),
        (f"<body><nav>Home</nav><p></p><div class='related'>{BODY * 5}</div></body>", " ".join([WORDS] * 5)),
        (f"<body><div>{BODY}</div><div class='comments'>{BODY * 50}</div></body>", WORDS),
        (f"<body><div id='search'>{BODY}<div class='share'>Tell all</div></div></body>", WORDS),
        (f"<body><article>{BODY}</article><div class='comments'><article>Reader says no</article></div></body>", WORDS),
    ],
)
def test_html_keeps_whole_articles(page, text):
    assert html_text.main_text(page, html_text.Weights(other=-0.1)) == text


@pytest.mark.parametrize("part", ["<svg>", "<svg class='a'>x", "<head><title>", "<svg/>", "<!--", "<script>", "<div class='related'>", "<p"])
def test_malformed_pages_take_linear_time(part):
    start = time.perf_counter()
    html_text.main_text(part * (1_000_000 // len(part)), html_text.Weights(other=-0.1))
    warc.plain_text(part * (1_000_000 // len(part)))
    assert time.perf_counter() - start < 20


def test_plain_text_of_open_elements():
    assert warc.plain_text(f"<html><head><title>T t</title><body><svg/>{BODY}") == WORDS.replace(". F", ".\nF")


def test_licenses(spark, docs, none):
    text = licenses.KNOWN[0][1].upper().replace("\n\n", "\n  ").replace("MERCHANTABILITY", "merchantability")
    df = spark.createDataFrame([(1, "Copyright (c) 2020 Some One\n\n" + text), (2, "prose\nReleased under the MIT Licence\nmore"), (3, None), (4, ""), (5, text + " and more")], "doc_id long, text string")
    assert sorted((r.doc_id, r.unit, r.license) for r in licenses.scan(df).collect()) == [(1, 0, "MIT"), (2, 2, "MIT")]
    assert licenses.scan(none).count() == 0 and licenses.scan(docs).count() == 0


@pytest.mark.parametrize(
    "line",
    ["Copyright The Foo Authors", "Copyright: 2020 Acme", "Portions Copyright (c) 2020 A", "(c) Acme 2020", "Copyright Acme, Inc. 2019-2021", "# Copyright (C) 2020 Some One <a@b.c>", "\u00a9 2020 Acme", "All rights reserved."],
)
def test_copyright_lines_do_not_matter(spark, line):
    mit = licenses.KNOWN[0][1]
    df = spark.createDataFrame([(1, f"{line}\n\n{mit}"), (2, f"{line} {mit}")], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.scan(df).collect() if r.unit == 0] == [(1, "MIT")]


def test_wrapped_lines_that_speak_of_copyright_stay(spark):
    mit = licenses.KNOWN[0][1]
    at = mit.index("copyright notice")
    wrapped = mit[:at].rstrip() + "\n" + mit[at:]
    lost = mit[:at] + mit[at:].split(" ", 2)[2]
    df = spark.createDataFrame([(1, wrapped), (2, lost)], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.scan(df).collect() if r.unit == 0] == [(1, "MIT")]


def test_licences_from_a_table_and_by_digest(spark):
    known = spark.createDataFrame([("House-1", "You may use this house licence, whilst you sweep it.")], "license string, unit string")
    df = spark.createDataFrame([(1, "you MAY use this House License while you sweep it"), (2, "Licensed under the MIT License.")], "doc_id long, text string")
    assert [(r.doc_id, r.unit, r.license) for r in licenses.scan(df, known=known, digests=()).orderBy("doc_id", "unit").collect()] == [(1, 0, "House-1"), (1, 1, "House-1")]
    made = licenses.known_digests(spark, known, ()).first()
    by_digest = licenses.scan(df, known=(("MIT", "Licensed under the MIT License."),), digests=((made.license, made.start, made.size, made.digest),))
    assert {(r.doc_id, r.license) for r in by_digest.collect()} == {(1, "House-1"), (2, "MIT")}


def test_warc(spark):
    df = spark.createDataFrame([(1, "http://a/b", "<p>é one</p><p>two</p>", "x"), (2, None, None, "x"), (1, "http://a/b", "<p>é one</p><p>two</p>", "x")], "page_id long, url string, html string, record string")
    got = warc.derive(warc.responses(df)).collect()
    assert len(got) == 6
    ids = {}
    for r in got:
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        assert version == "WARC/1.1" and block.endswith(b"\r\n\r\n") and len(block) - 4 == int(fields["Content-Length"]) == r.content_length
        assert fields["WARC-Block-Digest"] == warc.digest(block[:-4]) and fields["WARC-Refers-To"] == r.refers_to and ("WARC-Target-URI" in fields) == (r.page_id == 1)
        ids.setdefault(r.page_id, set()).add(r.refers_to)
        if r.record_type == "conversion" and r.page_id == 1:
            assert block[:-4].decode() == "é one\ntwo"
        if r.record_type == "metadata" and r.page_id == 1:
            assert f"source-payload-digest: {warc.digest('<p>é one</p><p>two</p>'.encode())}" in block.decode() and "source-header-content-type: text/html; charset=utf-8" in block.decode()
    assert all(len(x) == 1 for x in ids.values()) and warc.derive(warc.responses(df.where("false"))).count() == 0


def test_records_with_one_id_and_url_but_other_bodies_differ(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>b</p>")], "page_id long, url string, html string")
    got = warc.derive(warc.responses(df)).collect()
    assert len({r.record_id for r in got}) == 4 and len({r.refers_to for r in got}) == 2


def test_parsed_responses_keep_their_ids_and_headers(spark):
    http = b"HTTP/1.1 203 Fine\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-Served-By: c7\r\n\r\n"
    body = "<p>caf\u00e9</p>\r\n\r\n<p>two</p>".encode("latin-1")
    record = warc.written("response", "<urn:uuid:1>", [("WARC-Target-URI", "http://a/b"), ("WARC-Date", "2020-05-06T07:08:09Z")], "application/http; msgtype=response", http + body)
    info = warc.written("warcinfo", "<urn:uuid:0>", [], "application/warc-fields", b"software: x\r\n")
    cases = [(1, bytearray(info + record + record.replace(b"urn:uuid:1", b"urn:uuid:2"))), (2, None), (3, bytearray(b"")), (4, bytearray(record[:60])), (5, bytearray(record[:-30]))]
    df = spark.createDataFrame(cases, "file long, record binary")
    got = warc.derive(warc.parse(df, "file"), "file").collect()
    assert sorted({(r.file, r.refers_to) for r in got}) == [(1, "<urn:uuid:1>"), (1, "<urn:uuid:2>")]
    meta = next(bytes(r.record).decode() for r in got if r.record_type == "metadata")
    assert "http-status: 203" in meta and "source-header-x-served-by: c7" in meta and f"source-payload-digest: {warc.digest(body)}" in meta and "WARC-Date: 2020-05-06T07:08:09Z" in meta
    assert f"source-block-digest: {warc.digest(http + body)}" in meta
    text = next(bytes(r.record) for r in got if r.record_type == "conversion")
    assert "caf\u00e9\ntwo".encode() in text
    assert warc.derive(warc.parse(df.where("false"), "file"), "file").count() == 0


def test_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        out.collect()
        assert name == "packing" or out.columns == list(corpus_pipeline.COLUMNS)
