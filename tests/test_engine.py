"""File store, options, capabilities, matcher, channel information, cancellation, event writer, expressions against Python."""

import io
import json
import threading

import pytest
from pyspark.sql import functions as F
from test_xml import FULL, events

from guide_engine import builder, cli, config, fetch, grabber, options, scaffold, schema
from guide_engine.functions import text
from guide_engine.operators import fusion
from guide_engine.plans import guide
from guide_engine.sources import files, xml_sink, xml_source
from guide_engine.streaming import fold_stream, writer


def programmes(spark, rows):
    """(site, channel, day, seq, programme) as a cache's rows."""
    fields = list(schema.PROGRAMME)
    data = [(k, *(p.get(f) for f in fields), s, c, d) for s, c, d, k, p in rows]
    return spark.createDataFrame(data, f"seq long, {schema.ddl(schema.PROGRAMME)}, site string, channel_id string, day string").withColumn("day", F.to_date("day"))


@pytest.mark.parametrize("format", ["ndjson", "xml"])
def test_file_store(spark, tmp_path, format):
    store = files.FileStore(spark, str(tmp_path / "c"), format)
    assert store.entries().count() == 0 and store.programmes().count() == 0 and store.prune(F.lit("2030-01-01").cast("date")) == 0
    one = lambda start, title: builder.programme("x", start, title=title, date="2020", attrs={"a": "1"})
    rows = programmes(spark, [("s/1", "a é.tv", "2024-05-01", 1, one("202405011200 +0200", "T & <u>")), ("s/1", "a é.tv", "2024-05-01", 0, one("2024050106", "first"))])
    entries = spark.createDataFrame([("s/1", "a é.tv", "2024-05-01", "2024-05-01T00:00:00Z"), ("s/1", "a é.tv", "2024-05-02", "2024-05-02T00:00:00Z")], "site string, channel_id string, day string, grabbed_at string").withColumn("day", F.to_date("day"))
    store.write(rows, entries)
    got = store.programmes().orderBy("seq").collect()
    assert [r["title"][0]["value"] for r in got] == ["first", "T & <u>"] and got[1]["start"]["off"] == 120 and got[0]["date"]["prec"] == 4 and got[0]["attrs"] == {"a": "1"}
    assert {(r["site"], r["channel_id"], str(r["day"]), r["programme_count"]) for r in store.entries().collect()} == {("s/1", "a é.tv", "2024-05-01", 2), ("s/1", "a é.tv", "2024-05-02", 0)}
    other = files.FileStore(spark, str(tmp_path / "c"), "xml" if format == "ndjson" else "ndjson")
    assert other.programmes().count() == 2  # of the other format, since the own has no file
    base = tmp_path / "c" / files.segment("s/1") / files.segment("a é.tv")
    (base / "2024-05-01.meta.json").write_text("{broken")
    if format == "ndjson":
        with open(base / "2024-05-01.ndjson", "a") as f:
            f.write("\n{not json\n")
        assert [r["line"] for r in store.broken_lines().collect()] == ["{not json"]
    assert store.programmes().count() == 0 and store.sweep() == 1 and not (base / f"2024-05-01.{format}").exists()
    assert store.prune(F.lit("2024-05-03").cast("date")) == 1 and not (tmp_path / "c" / files.segment("s/1")).exists()


def test_first_format_goes_by_entries(spark):
    ddl = "site string, channel_id string, day string, x int"
    first, second = (spark.createDataFrame(r, ddl) for r in ([("s", "a", "1", 1)], [("s", "a", "1", 9), ("s", "b", "1", 2), ("s", "c", "1", 3)]))
    present = spark.createDataFrame([("s", "a", "1"), ("s", "b", "1")], "site string, channel_id string, day string")  # b is an empty entry
    assert sorted(r["x"] for r in files.first_format(first, second, present).collect()) == [1, 3]


def test_xml_by_expression_equals_the_writer(spark):
    docs = spark.createDataFrame([("p", FULL), ("q", FULL.replace("60", "1.5").replace("<thing", "<!-- <thing").replace("</thing>", "</thing> -->")), ("r", "<tv><programme start='2024' channel='c'><title/><new/><premiere/><video/></programme><channel id='z'/></tv>")], "path string, content string")
    tables = xml_source.tables(xml_source.parse_column(docs))
    for kind, fields, rows in (("programme", schema.PROGRAMME, tables["programmes"]), ("channel", schema.CHANNEL, tables["channels"])):
        rows = rows.cache()
        for indent in (None, 2):
            for own in (list(fields), [f for f in fields if f not in ("extra", "credits", "attrs")]):
                a = [r["xml"] for r in xml_sink.with_xml(rows, kind, F.struct(*own), "path", indent=indent).orderBy("path").collect()]
                b = [r["xml"] for r in rows.select("path", xml_sink.to_xml(kind, F.struct(*own), indent).alias("xml")).orderBy("path").collect()]
                assert a == b and len(a) == rows.count()


def test_selection_by_expression(spark):
    texts = ["3-1, 5", "ALL", " none", "0", "1-9", "x", "", "2 2,2-2", "all 1", "6", "7", "1--2", "-1", "1-2-3"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["p"] for r in rows.select("k", config.selection(F.col("t"), F.lit(6)).alias("p")).collect()}
    assert got == {k: config.parse_selection(t, 6) for k, t in enumerate(texts)}


def test_titles_of_arrays(spark):
    lists = [["A  b", "Ünï"], [" X\tY "], [], None, ["ﬁn", None], [None, "q Q"]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, x array<string>")
    got = {r["k"]: r["y"] for r in rows.select("k", text.normal_titles(F.col("x")).alias("y")).collect()}
    assert got == {k: None if x is None else [None if t is None else text.title_key(t) for t in x] for k, x in enumerate(lists)}


def test_options():
    O = options.Option
    specs = {"days": O("number", low=1, high=9, short="d"), "cache": O("text", bare="here", default="", negatable=True), "quiet": O(negatable=True), "mode": O("text", convert=options.one_of("a", "b"), default="a"), "tag": O("text", repeat=True)}
    parse = lambda *argv: options.parse(argv, specs, 1)
    assert parse() == ({"days": None, "cache": "", "quiet": False, "mode": "a", "tag": None}, [])
    values, rest = parse("--days=3", "--cache", "--quiet", "--no-quiet", "--tag", "x", "--tag=y", "--mode", "b", "--", "--word")
    assert (values, rest) == ({"days": 3, "cache": "here", "quiet": False, "mode": "b", "tag": ["x", "y"]}, ["--word"])
    assert parse("-d", "2")[0]["days"] == 2 and parse("-d2")[0]["days"] == 2 and parse("--cache", "dir")[0]["cache"] == "dir" and parse("--no-cache")[0]["cache"] is None
    for bad in (["--days"], ["--days", "0"], ["--days", "x"], ["--days", "nan"], ["--mode", "c"], ["--no-days"], ["--quiet=1"], ["--fly"], ["a", "b"], ["--no-cache=1"], ["-x"]):
        with pytest.raises(options.OptionError):
            parse(*bad)
    shown = options.usage("prog", [["quiet", "days"], ["mode"]], specs)
    assert shown.startswith("prog --[no-]quiet [--days VALUE]\nprog [--mode VALUE]\n") and "--[no-]cache [VALUE]" in shown


def _site(name, ids, **more):
    return {"site": name, "channels": [{"xmltv_id": i, "name": i.upper(), "lang": "en"} for i in ids], "request": lambda ps: (200, {}, ps.days), "parse_day": lambda days, c, d: [builder.programme(c, d.replace("-", "") + "06", title=f"{name} {c}")], **more}


def test_capabilities_and_hooks(spark, tmp_path):
    seen = []

    def hook(run):
        run.config_tasks.append(lambda r: seen.append(sorted(r.conf)))
        run.adjust_tasks.append(lambda r, own, chosen: (chosen.discard("b.tv"), {**own, "days": 1})[1])
        run.finish_tasks.append(lambda: seen.append("done"))
        run.pages.append(grabber.stages.Stage("mine", grabber.stages.SELECT_CHANNELS, [grabber.stages.Field("string", "colour", default="red")]))
        return 5 if run.values["stop"] else None

    mine = grabber.Plugin("mine", hook, {"stop": options.Option()})
    g = {"name": "tv_grab_xx", "description": "D", "version": "1", "config": {"sites": [_site("s", ["a.tv", "b.tv"])], "cache": str(tmp_path / "c"), "days": 3, "start_day": "2031-01-01"}, "capabilities": ["manualconfig", "apiconfig", mine]}
    out = io.StringIO()
    assert grabber.run(["--capabilities"], spark, g, out=out) == 0 and out.getvalue().split() == ["baseline", "manualconfig", "apiconfig", "mine"]
    assert grabber.run(["--stop"], spark, g, out=out) == 5 and seen == ["done"]
    out = io.StringIO()
    assert grabber.run([], spark, g, out=out) == 0 and seen == ["done", ["channel"], "done"]
    assert [v["channel"] for k, v in xml_source.parse(out.getvalue()) if k == "programme"] == ["a.tv"]
    path = str(tmp_path / "g.conf")
    assert grabber.run(["--configure", "--config-file", path], spark, g) == 0 and config.load_conf(path)["colour"] == ["red"]
    out = io.StringIO()
    assert grabber.run(["--help"], spark, g, out=out) == 0 and "tv_grab_xx --configure" in out.getvalue()
    with pytest.raises(TypeError):
        grabber.capabilities({"capabilities": [grabber.Plugin("x", hook, {"days": options.Option()})]})


def test_sites_fail_alone_and_runs_are_called_off(spark, tmp_path):
    late = []

    def asks_more(payload, channel, day, fetch):
        late.append(fetch([channel])[0])
        return [builder.programme(channel, day.replace("-", "") + "07", title="more")]

    class Pairs(list):
        days = []

    bad = {"site": "bad", "channels": lambda: 1 / 0, "request": lambda ps: (200, {}, None), "parse_day": lambda *a: []}
    info = lambda c, default: {**default, "url": [{"value": "http://x"}], "attrs": {"k": "v"}}
    more = _site("more", ["m.tv"], parse_here=True)
    more |= {"parse_day": asks_more, "request": lambda ps: (200, {}, "asked")}
    conf = {"sites": [_site("s", ["a.tv"], channel_info=info), bad, more], "cache": lambda spark: files.FileStore(spark, str(tmp_path / "c")), "days": 1, "start_day": "2031-01-01", "output": str(tmp_path / "g.xml")}
    told = cli.grab(spark, conf)
    assert (told["fetched"], told["failed"]) == (2, 1) and told["failures"][0]["channel"] == "*" and "ZeroDivision" in told["failures"][0]["error"] and late == ["asked"]
    good = {**conf, "sites": [conf["sites"][0], conf["sites"][2]]}
    cli.merge(spark, good)
    channel = next(v for k, v in xml_source.parse((tmp_path / "g.xml").read_text()) if k == "channel")
    assert channel["url"] == [{"value": "http://x"}] and channel["attrs"] == {"k": "v"} and channel["display_name"] == [{"lang": "en", "value": "A.TV"}]
    before = (tmp_path / "g.xml").read_text()
    with pytest.raises(cli.Cancelled):
        cli.merge(spark, good, cancelled=lambda: True)
    assert (tmp_path / "g.xml").read_text() == before
    off = threading.Event()
    off.set()
    told = cli.grab(spark, {**good, "days": 2}, cancelled=off.is_set)
    assert told["cancelled"] and told["fetched"] == 0 and "pruned" not in told


def test_matcher_on_programmes(spark):
    day = "2024-05-01"
    one = lambda site, seq, start, title, **more: (site, "a.tv", day, seq, builder.programme("a.tv", start, title=title, **more))
    rows = programmes(spark, [one("s0", 0, "2024050106", "News", category="c0"), one("s0", 1, "2024050110", "Film"), one("s1", 0, "2024050109", "Other name", showview="7", category="c1")])
    channels = spark.createDataFrame([(f"s{k}", k, 0, "a.tv", "a.tv", "A", None, None, None) for k in range(2)], "site string, site_rank int, channel_rank int, xmltv_id string, site_id string, name string, lang string, logo string, preset string")
    same = lambda held, incoming: held["title"][0]["value"] == "News" and incoming.get("showview") == "7" and held["start"]["ts"].hour == 6
    got = guide.build(spark, channels, rows, day, 1, guide.MergeOptions(match=same))["programmes"].orderBy("out_seq").collect()
    assert [[t["value"] for t in r["title"]] for r in got] == [["News", "Other name"], ["Film"]]
    assert got[0]["showview"] == "7" and [c["value"] for c in got[0]["category"]] == ["c0", "c1"] and got[0]["stop"]["ts"] == got[1]["start"]["ts"]
    a, b = (json.loads(json.dumps(r)) for r in ({"title": [{"value": "x"}], "credits": {"actor": [{"value": "p", "role": "r"}], "extra": ["e"]}, "is_new": False}, {"title": [{"value": "x"}, {"value": "y", "lang": "z"}], "credits": {"actor": [{"value": "p"}]}, "is_new": True, "attrs": {"k": "1"}}))
    assert fusion.merge_programmes(a, b) == {"title": [{"value": "x"}, {"value": "y", "lang": "z"}], "credits": {"actor": [{"value": "p", "role": "r"}, {"value": "p"}]}, "is_new": False, "attrs": {"k": "1"}}


def test_events_to_documents(spark, tmp_path):
    found = events(FULL)
    whole = "".join(xml_sink.serialize(found))
    assert events(whole) == found
    warned = []
    assert events("".join(xml_sink.serialize([("warning", {"code": "c"}), *found], {"source_info_name": "mine"}, 1, warned.append)))[0][1]["source_info_name"] == "mine" and warned == [{"code": "c"}]
    with pytest.raises(ValueError):
        list(xml_sink.serialize([found[1], found[0]]))
    with pytest.raises(TypeError):
        list(xml_sink.serialize([("odd", {})]))
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.xml").write_text(FULL, encoding="utf-8")
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(src))
    out = io.StringIO()
    sink = writer.DocumentSink(out, on_warning=warned.append)
    q = fold_stream.parse_stream(stream).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    sink.close()
    assert events(out.getvalue()) == found


def test_builder_scaffold_and_context(tmp_path):
    d = builder.Document(1, source_info_name="S").add(builder.channel("a.tv", "A", icon="i.png", url=("u") and "u"))
    d.add(builder.programme("a.tv", "2024", title="T", credits=builder.credits(actor=[("N", "R"), "M"], director="D"), image=builder.image("p", "poster", 2), review=[builder.review("r", source="s")], rating="12", premiere=True, video=builder.video("yes", False), length=builder.length(5), subtitles=builder.subtitles("onscreen", "sk"), previously_shown=builder.shown("2019"), extra=[builder.element("x", "v", {"k": 1, "n": None}, [builder.element("y")])], desc=[]))
    got = events(d.text())
    p = got[2][1]
    assert got[0][1]["source_info_name"] == "S" and [a["value"] for a in p["credits"]["actor"]] == ["N", "M"] and p["video"] == {"present": True, "colour": False} and p["image"][0]["size"] == "2"
    assert json.loads(p["extra"][0]) == {"name": "x", "attributes": {"k": "1"}, "value": "v", "children": [{"name": "y"}]} and p["premiere"] == {"flag": True} and "desc" not in p
    with pytest.raises(TypeError):
        builder.credits(boss="x")
    path = scaffold.write("tv_grab_sk_x", "conf.py", "A line", str(tmp_path / "g"))
    compile(open(path).read(), path, "exec")
    with pytest.raises(FileExistsError):
        scaffold.write("tv_grab_sk_x", "conf.py", path=path)
    assert scaffold.country("tv_grab_sk_x") == "SK"
    c = fetch.Context([{"channel_id": "b", "day": "2"}, {"channel_id": "a", "day": "1"}, {"channel_id": "b", "day": "1"}])
    assert c.channels == ["b", "a"] and (c.first_day, c.last_day) == ("1", "2")
