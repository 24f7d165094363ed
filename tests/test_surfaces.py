import pytest

from guide_engine import builder, config, fetch, lineups, stages
from guide_engine.functions import dates, text
from guide_engine.sources import xml_sink, xml_source


def test_conf(spark, tmp_path):
    source = "a=1\n# note\n\nchannel=x # picked\nchannel!y\r\nb= two words  \n"
    conf = config.parse_conf(source)
    assert conf == {"a": ["1"], "channel": ["x"], "no_channel": ["y"], "b": [" two words"]}
    assert config.parse_conf(config.conf_text(conf)) == conf and config.parse_conf("a=1\nbad line") is None
    path = str(tmp_path / "d" / "x.conf")
    config.save_conf(path, conf)
    (tmp_path / "d" / "bad.conf").write_text("ok=1\nnot a setting\n")
    assert config.load_conf(path) == conf and config.load_conf(path + "x") is None
    assert {r["key"]: r["values"] for r in config.read_confs(spark, str(tmp_path / "d")).collect()} == conf
    answers = config.Answers(config.mapping_reader({"k": [""]}), config.env_reader("G_", {"G_K": "env", "G_E": ""}), config.mapping_reader({"k": ["d"], "e": ["d"]}))
    assert (answers.get("k"), answers.get("e"), answers.get("z", "q")) == ("env", "d", "q")
    with pytest.raises(config.ConfigError):
        answers.get("z")


def test_selection():
    assert config.parse_selection("3-1, 5", 6) == [0, 1, 2, 4] and config.parse_selection("ALL", 2) == [0, 1] and config.parse_selection(" none", 2) == []
    assert config.parse_selection("0", 2) is None and config.parse_selection("1-9", 2) is None and config.parse_selection("x", 2) is None


def test_stages():
    S, Q = stages.Stage, stages.Field
    good = [S("start", "two", [Q("string", "user", "User", default="me"), Q("constant", "v", default="2")]), S("two", "select-channels", [Q("selectone", "q", "Q", options=[("a", "A"), ("b", "B")])])]
    answers = iter(["", "9", "2", "1"])
    conf = stages.walk(good, [("c1", "One"), ("c2", None)], lambda _: next(answers))
    assert conf == {"user": ["me"], "v": ["2"], "q": ["b"], "channel": ["c1"], "no_channel": ["c2"]}
    assert stages.walk(good, [("c1", "One")], None)["channel"] == ["c1"]
    assert '<nextstage stage="two" />' in stages.stage_xml(good[0], "g&h") and "g&amp;h" in stages.stage_xml(good[0], "g&h")
    for bad in ([S("start", "start")], [S("start", "gone")], [S("x", "end")], [S("start", "end"), S("start", "end")], [S("start", "end", [Q("string", "no_x")])], [S("start", "end", [Q("string", "channel")])], [S("start", "end", [Q("selectone", "a")])], [S("start", "end", [Q("string", "a"), Q("string", "a")])], [S("end", "end")]):
        with pytest.raises(TypeError):
            stages.resolve(bad)


def test_lineups(spark):
    rows = spark.createDataFrame([("s", 0, "a.b", "A", None, None, "1"), ("s", 1, "c.d", None, "sk", "l", None)], "site string, channel_rank int, xmltv_id string, name string, lang string, logo string, preset string")
    got = lineups.entries(rows, "en").orderBy("channel_rank").collect()
    assert [r["station"]["lang"] for r in got] == ["en", "sk"]
    assert lineups.chosen(rows, spark.createDataFrame([("c.d",)], "xmltv_id string")).count() == 1
    doc = lineups.lineups_xml([{"id": "x", "display_name": [{"value": "X & Y", "lang": "en"}], "entries": [{"station": {"xmltv_id": "a.b", "name": "A"}, "preset": "1", "analog": [{"system": "PAL", "number": "5"}]}]}])
    assert "X &amp; Y" in doc and "<cni />" in doc and doc.index("<preset>") < doc.index("<station")
    with pytest.raises(TypeError):
        lineups.lineups_xml([{"id": "x", "display_name": [], "entries": [{"station": {"xmltv_id": "a"}, "stb": [{"preset": "1"}], "iptv": [{"url": "u", "port": 1}]}]}])


def test_pacing():
    assert fetch.retry_after_ms(" 2 ") == 2000 and fetch.retry_after_ms("-1") == 0 and fetch.retry_after_ms("  ") is None and fetch.retry_after_ms("soon") is None
    assert fetch.retry_after_ms("Thu, 01 Jan 1970 00:00:10 GMT", now=4) == 6000
    now = [0.0]

    def sleep(s):
        now[0] += s

    p = fetch.Pacing(concurrency=4, rate=2, interval_ms=1000, clock=lambda: now[0], sleep=sleep)
    times = []
    for status in (200, 200, 200, 429, 200):
        p.enter()
        times.append(now[0])
        p.leave(status, "3" if status == 429 else None)
    assert times[:4] == [0, 0, 1, 1] and times[4] == 4 and p.width == 2
    for _ in range(9):
        p.enter()
        p.leave(200)
    assert p.width == 3
    out = fetch.fetch_site([1, 2, 3], lambda r: (200, {}, r * 10) if r != 2 else 1 / 0, fetch.Pacing(concurrency=2))
    assert [(r, x) for r, x, _ in out] == [(1, 10), (2, None), (3, 30)] and "ZeroDivision" in out[1][2]
    with pytest.raises(TypeError):
        fetch.checked_site({"site": "s"})


def test_builder_and_dates():
    p = builder.programme("a.b", "202401020304 +0200", title=[("T", "en"), "U"], stop=1704164400, episode_num=builder.episode(1, 12, 1, 2), desc=[], attrs={"x": 1, "y": None}, is_new=None)
    assert p["attrs"] == {"x": "1"} and "desc" not in p and [e["value"] for e in p["episode_num"]] == ["0.11.0/2", "S01E12 (1/2)"]
    xml = xml_sink.Writer().programme(p)
    assert 'start="202401020304 +0200"' in xml and 'stop="20240102030000 +0000"' in xml
    assert list(xml_source.parse(f"<tv>{xml}</tv>"))[1][1]["title"] == [{"lang": "en", "value": "T"}, {"value": "U"}]
    for bad, at in (("2024023", 7), ("20240230", 6), ("20241301", 4), ("2024 XYZ", 5), ("20240101 +2400", 9), ("0099", 0), (" 20240132", 7)):
        with pytest.raises(dates.DateError) as e:
            dates.date_of(bad)
        assert e.value.index == at
    assert dates.date_of("2024 cet", {"CET": 60})["off"] == 60 and dates.text_of(dates.date_of("2024 cet", {"CET": 60})) == "2024 +0100"
    assert dates.day_range("2024-02-28", 3) == ["2024-02-28", "2024-02-29", "2024-03-01"] and dates.day_range("2024-01-01", -1) == []
    assert dates.is_day("2024-02-29") and not dates.is_day("2026-99-99") and dates.diff_days("2024-03-01", "2024-02-28") == 2


def test_text():
    assert text.title_key("  Správy \n ČT ﬁn ") == "spravy ct fin" and text.title_key("ß") == "ß"
    assert text.decode("&amp;lt; &#x1F600; &#0; &nope; &lt") == "&lt; 😀 &#0; &nope; &lt"
