"""A PySpark engine for programme guides: tolerant sources, ordered sinks, incremental ingest, and the fusion of many sources into one schedule."""

from __future__ import annotations

from importlib import import_module

#: Public name -> the module that has it; loaded when first asked for.
_HOME = {
    **{n: "cli" for n in ("grab", "merge", "load_config", "site_channels")},
    **{n: "config" for n in ("Answers", "ConfigError", "env_reader", "mapping_reader", "parse_conf", "conf_text", "load_conf", "save_conf", "parse_selection")},
    **{n: "functions.dates" for n in ("DateError", "coerce_date", "date_of", "day_range", "diff_days", "format_date", "is_day", "parse_date", "text_of")},
    **{n: "functions.text" for n in ("decode", "decode_entities", "escape", "escape_xml", "normal_title", "title_key", "titles_match")},
    **{n: "options" for n in ("Option", "OptionError")},
    **{n: "sources.xml_source" for n in ("GuideSource", "NotAGuide", "Scanner", "parse", "parse_column", "read_guide")},
    **{n: "sources.xml_sink" for n in ("EventWriter", "Writer", "document", "serialize", "to_xml", "with_xml", "write_output")},
    **{n: "sources.cache" for n in ("Cache",)},
    **{n: "sources.files" for n in ("CacheStore", "FileStore")},
    **{n: "builder" for n in ("Document", "channel", "episode", "programme", "words")},
    **{n: "operators.ingest" for n in ("Policy", "is_stale")},
    **{n: "operators.fold" for n in ("ChannelFold", "Rules", "fold")},
    **{n: "operators.fusion" for n in ("fuse", "merge_programmes")},
    **{n: "plans.guide" for n in ("MergeOptions", "build", "write_guide")},
    **{n: "fetch" for n in ("Pacing", "retry_after_ms")},
    **{n: "lineups" for n in ("lineups_xml",)},
    **{n: "stages" for n in ("Field", "Stage", "stage_xml", "walk")},
    **{n: "grabber" for n in ("Plugin", "Run")},
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(f".{_HOME[name]}", __name__), name)
    raise AttributeError(name)
