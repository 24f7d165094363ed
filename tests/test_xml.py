import random
import socket
import threading

import pytest
from pyspark.sql import functions as F

from guide_engine import schema
from guide_engine.sources import xml_sink, xml_source

FULL = """<?xml version="1.0"?><!DOCTYPE tv SYSTEM "x.dtd" [<!ENTITY a "b>">]>
<tv source-info-name="S &amp; T" x="1">
  <!-- a comment with <tags> -->
  <channel id="one.tv"><display-name lang="en">One</display-name><display-name>1</display-name><icon src="i.png" width="10"/><url system="s">http://x</url><odd a="b"><in/></odd></channel>
  <programme start="20240301060000 +0100" stop="202403010700 +0100" channel="one.tv" showview="7" q="z">
    <title lang="sk">Večer &amp;amp; noc 😀</title><title><![CDATA[a < b]]></title><sub-title>s</sub-title><desc>d</desc>
    <credits><director>D</director><actor role="R" guest="yes">A<image type="person">p.jpg</image><url>u</url></actor><boss>x</boss></credits>
    <date>2020</date><category>c</category><language>en</language><length units="minutes">6e1</length><icon src="a"/><url>http://y</url><country>SK</country>
    <episode-num system="xmltv_ns">0.1.0/1</episode-num><video><present>yes</present><aspect>16:9</aspect></video><audio><stereo>surround</stereo></audio>
    <previously-shown start="2019" channel="two"/><premiere/><last-chance lang="en">bye</last-chance><new/>
    <subtitles type="teletext"><language>sk</language></subtitles><rating system="X"><value>12</value><icon src="r"/></rating><star-rating><value>3/5</value></star-rating>
    <review type="url" source="s">http://r</review><image type="poster" size="2" orient="P">q.jpg</image><thing k="v">t<sub/></thing>
  </programme>
</tv>"""

BROKEN = """<tv>
<programme start="20240230" channel="a"><title>bad day</title></programme>
<programme start="2024" channel="a" start="2025" stop=""><title>x<b>y</b>z</title><date>2020</date><date>2021</date></wrong>
<rating><icon src="q"/></rating><icon/><length units="minutes">x</length><credits/><video><present>maybe</present></video></programme>
<channel><display-name>no id</display-name></channel><other><deep/></other></stray>
<programme start='202401020304 UTC' channel=b new><title>&#65;&bogus;&#x110000;</title></programme>
<programme start="20240101" channel="c"><title>cut"""


def events(text, **options):
    return list(xml_source.parse(text, **options))


def test_values():
    got = events(FULL)
    assert [k for k, _ in got] == ["meta", "channel", "programme"]
    meta, channel, p = (v for _, v in got)
    assert meta == {"source_info_name": "S & T", "attrs": {"x": "1"}}
    assert channel["icon"] == [{"src": "i.png", "width": 10.0}] and channel["extra"] == ['{"name": "odd", "attributes": {"a": "b"}, "children": [{"name": "in"}]}']
    assert p["start"] == {"ts": "2024-03-01T05:00:00.000Z", "off": 60, "prec": 14} and p["stop"]["prec"] == 12
    assert [t["value"] for t in p["title"]] == ["Večer &amp; noc 😀", "a < b"] and p["premiere"] == {"flag": True}
    assert p["last_chance"]["text"] == {"lang": "en", "value": "bye"} and p["length"]["value"] == 60.0 and p["credits"]["actor"][0]["guest"] is True


def test_warnings_and_their_places():
    got = events(BROKEN)
    codes = [(w["code"], w["line"]) for k, w in got if k == "warning"]
    assert codes == [
        ("invalid-attribute", 2), ("invalid-programme", 2), ("invalid-attribute", 3), ("malformed-markup", 3), ("invalid-attribute", 3), ("unknown-element", 3), ("invalid-element", 3),
        ("invalid-element", 4), ("invalid-element", 4), ("invalid-element", 4), ("invalid-element", 4), ("invalid-element", 4), ("invalid-element", 5), ("unknown-element", 5), ("malformed-markup", 5), ("truncated-input", 7),
    ]
    ps = [v for k, v in got if k == "programme"]
    assert [t["value"] for p in ps for t in p["title"]] == ["xz", "A&bogus;&#x110000;"] and ps[0]["date"]["prec"] == 4 and ps[0]["video"] == {}
    one = [w for k, w in events("<tv>\n <channel a='😀' a='2' id='x'/></tv>") if k == "warning"]
    assert [(w["line"], w["col"]) for w in one] == [(2, 18)]


@pytest.mark.parametrize("text", [FULL, BROKEN, "<tv/>", "<tv></tv>trailing"])
def test_any_pieces_give_the_same(text):
    whole = events(text)
    rng = random.Random(1)
    for size in (1, 2, 7, 13, 64):
        assert events([text[k : k + size] for k in range(0, len(text), size)]) == whole
    at = sorted(rng.randrange(len(text)) for _ in range(9))
    assert events([text[a:b] for a, b in zip([0, *at], [*at, len(text)])]) == whole


def test_roots():
    for text in ("", " \n", "<?xml version='1.0'?>", "<!-- only -->"):
        assert events(text) == []
    with pytest.raises(xml_source.NotAGuide):
        events("<html></html>")
    with pytest.raises(xml_source.NotAGuide):
        events("<!--" + "x" * 100, head_limit=50)
    assert [v["channel"] for k, v in events("<tv><programme start='2024'/></tv>", tolerate_missing_id=True) if k == "programme"] == [""]


@pytest.mark.parametrize("indent", [None, 2, "\t"])
def test_round_trip_in_python(indent):
    w = xml_sink.Writer(indent)
    first = events(FULL)
    text = w.header(first[0][1]) + w.channel(first[1][1]) + w.programme(first[2][1]) + w.footer()
    assert events(text) == first and (indent is None) == ("\n" not in text)


def test_round_trip_in_spark(spark, tmp_path):
    for n, text in enumerate((FULL, BROKEN, "<tv/>")):
        (tmp_path / f"{n}.xml").write_text(text, encoding="utf-8")
    got = xml_source.read_guide(spark, str(tmp_path))
    assert got["warnings"].count() == 16 and got["meta"].count() == 3
    ps = got["programmes"].where(F.col("path").endswith("0.xml"))
    xml = ps.select(xml_sink.to_xml("programme", F.struct(*schema.PROGRAMME)).alias("xml")).first()["xml"]
    assert events(f"<tv>{xml}</tv>")[1] == events(FULL)[2]
    docs = spark.createDataFrame([("p", FULL)], "path string, content string")
    assert xml_source.tables(xml_source.parse_column(docs))["programmes"].drop("path", "seq").collect() == ps.drop("path", "seq").collect()


def test_outputs(tmp_path):
    target = tmp_path / "a" / "b" / "g.xml"
    xml_sink.write_output(str(target), ["x", "y"])
    assert target.read_text() == "xy"

    def fails():
        yield "z"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        xml_sink.write_output(str(target), fails())
    with pytest.raises(RuntimeError):
        xml_sink.write_output(str(tmp_path / "new" / "g.xml"), fails())
    assert target.read_text() == "xy" and not (tmp_path / "new").exists() and [p.name for p in target.parent.iterdir()] == ["g.xml"]
    path = str(tmp_path / "s")
    with socket.socket(socket.AF_UNIX) as server:
        server.bind(path)
        server.listen()
        got = []
        t = threading.Thread(target=lambda: got.append(server.accept()[0].makefile().read()))
        t.start()
        xml_sink.write_output(path, ["s", "t"])
        t.join()
    assert got == ["st"]
