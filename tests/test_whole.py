"""Queries over all rows and whole texts: nothing is left out to suit an engine."""

import hashlib
import unicodedata

import duckdb
import pytest

from guide_engine.catalogue import QUERIES

BLANK = "\t\n\x0b\f\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def made(spark, tmp_path, name, rows, ddl):
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def key(text):
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Mc", "Me")).lower()
    return " ".join(x for x in "".join(" " if c in BLANK else c for c in bare).split(" ") if x)


def test_title_key_takes_whole_texts_of_all_rows(spark, tmp_path):
    texts = ["Straße", "ﬁn ﬀ Ⅳ ①", "word " * 60 + "Ende", "é" * 199 + "ÀÉ   ß", "ascii ", "ascii\x85", "a\x1cB", "﻿A\xa0　b ", "ΟΔΟΣ", "İ", "", " \x0b\t ", None, "A" * 250 + "ﬁ"]
    path = made(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["k"] for r in QUERIES["title_key"](spark, path).collect()}
    assert got == {i: None if t is None else md5(key(t)) for i, t in enumerate(texts)}


def test_title_key_of_the_documents(spark):
    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert any("ß" in t[:200] for t in texts.values()) and any(len(t) > 200 for t in texts.values())
    assert {r["doc_id"]: r["k"] for r in QUERIES["title_key"](spark, path).collect()} == {i: md5(key(t)) for i, t in texts.items()}


def test_decode_entities_of_the_pages_as_they_stand(spark):
    path = "/root/testdata/sf0.01"
    nested = "replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"
    pages = duckdb.sql(f"SELECT page_id, md5({nested}), html <> {nested}, contains(html, '&copy;'), contains(html, '&#') FROM '{path}/pages.parquet'").fetchall()
    assert any(p[2] for p in pages) and all(p[3] and not p[4] for p in pages)
    assert {r["page_id"]: r["h"] for r in QUERIES["decode_entities"](spark, path).collect()} == {i: h for i, h, *_ in pages}


def test_decode_entities_of_references(spark, tmp_path):
    pairs = [("&#65;&#x42;&#X43;", "ABC"), ("&#0065;&#x1F600;", "A😀"), ("&amp;lt;&amp;#65;", "&lt;&#65;"), ("&copy;&middot;&nope;", None), ("&#xD800;&#1114112;&#x110000;", None), (f"&#{'9' * 5000};", None), (f"&#{'0' * 5000}65;", "A"), ("&#;&#x;&#6a;&lt &AMP;", None), ("&&lt;&", "&<&"), ("", None)]
    path = made(spark, tmp_path, "pages", [(i, "u", html) for i, (html, _) in enumerate(pairs)] + [(99, "u", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["h"] for r in QUERIES["decode_entities"](spark, path).collect()}
    assert got == {i: md5(html if plain is None else plain) for i, (html, plain) in enumerate(pairs)} | {99: None}


@pytest.mark.parametrize("name, sql", [
    ("new_channels", "SELECT c_custkey FROM '{0}/customer.parquet' EXCEPT SELECT o_custkey FROM '{0}/orders.parquet'"),
    ("gone_channels", "SELECT o_custkey FROM '{0}/orders.parquet' EXCEPT SELECT c_custkey FROM '{0}/customer.parquet' WHERE c_nationkey < 20"),
])
def test_channel_differences_take_all_orders(spark, name, sql):
    path = "/root/testdata/sf0.1"
    got = sorted(r["id"] for r in QUERIES[name](spark, path).collect())
    assert got and got == sorted(r[0] for r in duckdb.sql(sql.format(path)).fetchall())
