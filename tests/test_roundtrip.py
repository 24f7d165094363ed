"""The scanner's short ways give what its rules give, and a table of documents is read by all cores, without columns nobody asked for."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from test_xml import BROKEN, FULL

from guide_engine.catalogue import QUERIES
from guide_engine.functions.dates import DateError, date_of
from guide_engine.sources import xml_source

PLAIN = '<tv>\n<programme start="20240101000011 +0000" channel="ch5"><title lang="en">error &amp; &lt;x&gt; &amp;lt; &#65;</title><desc>a\n b </desc><language>l</language></programme>\n<channel id="q"><display-name>z</display-name></channel></tv>'
BITS = ["<", ">", "/", "</", "/>", '"', "'", "=", "<title>", "</title>", "<title/>", "<titlea>", "</ title>", "</title >", '<title lang="a">', '<title a="</title>">', "</programme>", '<programme start="20240101" channel="c">', "<credits>", "</credits>",
        "<!--", "-->", "<![CDATA[", "]]>", "&amp;", "&", "\n", "😀", " ", "<tv>", "</tv>", "__proto__=1 ", "<new/>", "<language>k</language>", ' lang="b"', ' lang=""', "<icon src=''/>", "<date>2020</date>"]


def test_a_table_of_one_row_group_is_read_by_all_cores(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["xml_roundtrip"](spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_what_is_wanted_is_handed_over(spark):
    docs = spark.createDataFrame([("p", FULL), ("q", BROKEN), ("r", PLAIN), ("s", None)], "path string, content string")
    whole = xml_source.tables(xml_source.parse_column(docs))
    fields = ["title", "start", "channel", "rating"]
    some = xml_source.parse_column(docs, wanted={"programme": fields})
    assert some.columns == ["path", "seq", "kind", "programme"] and set(xml_source.tables(some)) == {"programmes"}
    assert {r["kind"] for r in some.collect()} == {"programme"}
    assert xml_source.tables(some)["programmes"].collect() == whole["programmes"].select("path", "seq", *fields).collect()
    warned = xml_source.parse_column(docs, wanted={"warning": ()})
    assert xml_source.tables(warned)["warnings"].collect() == whole["warnings"].collect() and set(xml_source.tables(warned)) == {"warnings"}


def test_columns_made_a_field_at_a_time(spark):
    fields = to_arrow_schema(T.StructType.fromDDL(xml_source.EVENT))
    texts = [FULL, BROKEN, PLAIN, "<tv/>", FULL]
    rows = [{"path": str(n), "seq": seq, "kind": kind} | (value if kind == "warning" else {kind: value}) for n, t in enumerate(texts) for seq, (kind, value) in enumerate(xml_source.parse(t, typed=True))]
    got = list(xml_source.batches_of(((str(n), xml_source.parse(t, typed=True)) for n, t in enumerate(texts)), fields))
    assert len(got) == 1 and got[0].to_pylist() == pa.RecordBatch.from_pylist(rows, fields).to_pylist()


def test_short_ways_give_what_the_rules_give(monkeypatch):
    rng, cases = random.Random(11), []
    for _ in range(1500):
        t = rng.choice([FULL, BROKEN, PLAIN, PLAIN])
        for _ in range(rng.randint(0, 5)):
            k, j = rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)
            t = rng.choice([t[:k] + rng.choice(BITS) + t[k:], t[:k] + t[k + rng.randint(1, 9) :], t[:k] + t[j : j + rng.randint(1, 40)] + t[k:]])
        cuts = sorted(rng.randrange(len(t) + 1) for _ in range(rng.randint(0, 4)))
        cases.append([t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True)])

    def found(pieces):
        try:
            return list(xml_source.parse(pieces))
        except xml_source.NotAGuide as e:
            return str(e)

    short = [found(c) for c in cases]
    taken = []
    plain = xml_source.Scanner._plain
    monkeypatch.setattr(xml_source.Scanner, "_plain", lambda self, m: taken.append(m) or plain(self, m))
    assert found([PLAIN]) and len(taken) == 2
    never = xml_source.re.compile(r"(?!)")
    monkeypatch.setattr(xml_source, "_PLAIN", never)
    monkeypatch.setattr(xml_source, "_LEAF", never)
    assert short == [found(c) for c in cases]


@pytest.mark.parametrize("text", ["20240101240000 +0000", "20240230000000 +0000", "20240101006000 +0000", "20240101000060 +0000", "00990101000000 +0000"])
def test_full_dates_out_of_range(text):
    with pytest.raises(DateError):
        date_of(text)
