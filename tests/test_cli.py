from guide_engine import cli
from guide_engine.sources import xml_source

CONFIG = '''
from guide_engine.builder import programme
calls = []
def request(pairs):
    calls.append([(p["channel_id"], p["day"]) for p in pairs])
    if any(p["channel_id"] == "bad.tv" for p in pairs):
        return 500, {}, None
    return 200, {}, {p["channel_id"]: p["day"] for p in pairs}
def parse_day(payload, channel, day):
    d = day.replace("-", "")
    return [] if channel == "empty.tv" else [programme(channel, f"{d}18", title=f"late {channel}"), programme(channel, f"{d}12", title="noon")]
def site(name, ids):
    return {"site": name, "channels": lambda: [{"xmltv_id": i, "name": i.upper()} for i in ids], "request": request, "parse_day": parse_day, "batching": {"mode": "days", "days": 2}}
config = {"sites": [site("one", ["a.tv", "empty.tv"]), site("two", ["a.tv", "bad.tv"])], "cache": CACHE, "output": OUT, "days": 3, "start_day": "2030-01-01", "indent": 1}
'''


def test_build_then_cached(spark, tmp_path, capsys):
    path, out = tmp_path / "c.py", tmp_path / "guide.xml"
    path.write_text(f"CACHE, OUT = {str(tmp_path / 'cache')!r}, {str(out)!r}\n" + CONFIG)
    assert cli.main(["--config", str(path)], spark) == 0
    assert "'fetched': 9, 'empty': 3, 'from_cache': 0, 'failed': 3" in capsys.readouterr().err
    got = list(xml_source.parse(out.read_text()))
    ps = [v for k, v in got if k == "programme"]
    assert [v["id"] for k, v in got if k == "channel"] == ["a.tv", "empty.tv", "bad.tv"]
    assert [p["title"][0]["value"] for p in ps] == ["noon", "late a.tv"] * 3 and ps[0]["stop"]["ts"] == ps[1]["start"]["ts"] and "stop" not in ps[-1]
    assert cli.main(["grab", "--config", str(path)], spark) == 0
    assert "'fetched': 0, 'empty': 0, 'from_cache': 9, 'failed': 3" in capsys.readouterr().err
    assert cli.main(["prune", "--config", str(path), "--before", "2030-01-02"], spark) == 0
    assert capsys.readouterr().err.strip().endswith("3")


def test_usage(spark, tmp_path):
    assert cli.main(["fly"], spark) == 2 and cli.main(["--start-day", "2026-99-99"], spark) == 2 and cli.main(["prune"], spark) == 2
    assert cli.main(["merge", "--config", str(tmp_path / "none.py")], spark) == 1
