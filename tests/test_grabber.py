import io

from guide_engine import config, grabber
from guide_engine.builder import programme
from guide_engine.sources import xml_source


def made(tmp_path):
    site = lambda n, ids: {"site": n, "channels": [{"xmltv_id": i, "name": i.upper(), "preset": str(k)} for k, i in enumerate(ids)], "request": lambda ps: (200, {}, None), "parse_day": lambda _, c, d: [programme(c, d.replace("-", "") + "06", title="T")]}
    conf = {"sites": [site("s1", ["a.tv", "b.tv"]), site("s2", ["b.tv", "c.tv"])], "cache": str(tmp_path / "cache"), "days": 2, "start_day": "2030-05-01"}
    return {"name": "tv_grab_xx", "description": "Example", "version": "1", "config": conf, "lineups": True}


def test_protocol(spark, tmp_path):
    g, path = made(tmp_path), str(tmp_path / "g.conf")
    say = lambda *argv, ask=None: (lambda out: (grabber.run(argv, spark, g, ask, out), out.getvalue()))(io.StringIO())
    assert say("--description") == (0, "Example\n") and "newchannels" in say("--capabilities")[1] and say("--fly")[0] == 1
    ids = [v["id"] for k, v in xml_source.parse(say("--list-channels")[1]) if k == "channel"]
    assert ids == ["a.tv", "b.tv", "c.tv"]
    assert "<preset>1</preset>" in say("--get-lineup", "s2")[1] and say("--get-lineup", "zz")[0] == 1 and "select-channels" in say("--stage", "start")[1]
    assert say("--configure", "--config-file", path, ask=lambda _: "1-2")[0] == 0
    assert sorted(config.load_conf(path)["channel"]) == ids[:2]
    code, text = say("--config-file", path, "--channel-updates", "signal", "--quiet")
    got = list(xml_source.parse(text))
    assert code == 0 and len([1 for k, _ in got if k == "programme"]) == 4
    config.save_conf(path, {"channel": ["a.tv", "old.tv"]})
    assert say("--config-file", path, "--channel-updates", "signal", "--quiet")[0] == grabber.SIGNAL
    code, text = say("--config-file", path, "--channel-updates", "add")
    assert code == 0 and len([1 for k, _ in xml_source.parse(text) if k == "channel"]) == 3
    assert say("--config-file", path + "x")[0] == 1


def test_cache_options(spark, tmp_path):
    g = made(tmp_path)
    count = lambda *argv: (lambda out: (grabber.run(argv, spark, g, None, out), len([1 for k, _ in xml_source.parse(out.getvalue()) if k == "programme"])))(io.StringIO())
    assert count("--no-cache") == (0, 6) and not list(tmp_path.iterdir())
    assert count("--cache", str(tmp_path / "own")) == (0, 6) and [p.name for p in tmp_path.iterdir()] == ["own"]
    assert count("--cache") == (0, 6) and (tmp_path / "cache").is_dir()
