"""Configuration stages: a chain of question pages, checked before it is walked, and its XML."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from .config import parse_selection
from .functions.text import escape

START, SELECT_CHANNELS, END = "start", "select-channels", "end"
_ID = re.compile(r"[^\s=!#]+")


@dataclass(frozen=True)
class Field:
    type: str  # string, secretstring, constant, selectone, selectmany
    id: str
    title: str | dict = ""
    description: str | dict = ""
    options: Sequence[tuple[str, str]] = ()  # value, text
    default: str | None = None


@dataclass(frozen=True)
class Stage:
    name: str
    next: str
    fields: Sequence[Field] = ()


#: What a field must not be: rule -> whether a field of a stage breaks it.
FIELD_RULES: dict[str, Callable[[Field, Stage], bool]] = {
    "ids are written before = or ! in a line of their own, so they hold no blank, =, ! or #": lambda f, s: _ID.fullmatch(f.id) is None,
    "no_ marks declined answers": lambda f, s: f.id.startswith("no_"),
    "channel is the channel page's own answer": lambda f, s: f.id == "channel",
    "an id stands for one question of a page": lambda f, s: sum(g.id == f.id for g in s.fields) > 1,
    "a choice needs options": lambda f, s: f.type in ("selectone", "selectmany") and not f.options,
}


def faults(stages: Sequence[Stage]) -> list[str]:
    """Everything that is wrong with declared pages, found in one pass over their graph."""
    last, names = {SELECT_CHANNELS, END}, [s.name for s in stages]
    found = [f"{s.name}.{f.id}: {rule}" for s in stages for f in s.fields for rule, broken in FIELD_RULES.items() if broken(f, s)]
    found += [f"{n}: the name is taken" for n in sorted({n for n in names if names.count(n) > 1 or n in last})]
    found += [f"{s.name}: goes on to {s.next}, which is no page" for s in stages if s.next not in last and s.next not in names]
    if START not in names:
        found.append(f"{START}: there is no first page")
    # pages from which an end is reached, grown backwards from the ends; a missing page was told of above
    ending = last | {s.next for s in stages if s.next not in names}
    while more := {s.name for s in stages if s.next in ending} - ending:
        ending |= more
    return found + [f"{n}: the pages after it go round" for n in dict.fromkeys(names) if n not in ending]


def resolve(stages: Sequence[Stage]) -> dict[str, Stage]:
    """The stages by name; raises TypeError with all their faults."""
    if wrong := faults(stages):
        raise TypeError("; ".join(wrong))
    return {s.name: s for s in stages}


def _texts(tag: str, text: str | dict, pad: str) -> str:
    pairs = text.items() if isinstance(text, dict) else [("en", text)]
    return "".join(f'{pad}<{tag} lang="{escape(lang)}">{escape(t)}</{tag}>\n' for lang, t in pairs if t)


def stage_xml(stage: Stage, grabber: str) -> str:
    out = f'<?xml version="1.0" encoding="UTF-8"?>\n<xmltvconfiguration grabber="{escape(grabber)}">\n'
    for f in stage.fields:
        given = f' default="{escape(f.default)}"' if f.default is not None else ""
        out += f'  <{f.type} id="{escape(f.id)}"{given}>\n' + _texts("title", f.title, "    ") + _texts("description", f.description, "    ")
        for value, text in f.options:
            out += f'    <option value="{escape(value)}">\n' + _texts("text", text, "      ") + "    </option>\n"
        out += f"  </{f.type}>\n"
    return out + f'  <nextstage stage="{escape(stage.next)}" />\n</xmltvconfiguration>\n'


def channels_stage(channels: Sequence[tuple[str, str | None]]) -> Stage:
    return Stage(SELECT_CHANNELS, END, [Field("selectmany", "channel", "Channels", "Channels to receive", [(i, n or i) for i, n in channels])])


def walk(stages: Sequence[Stage], channels: Sequence[tuple[str, str | None]], ask: Callable[[str], str] | None) -> dict[str, list[str]]:
    """A configuration from answers; without anyone to ask, defaults hold and every channel is chosen."""
    by, conf, at = resolve(stages), {}, START
    chain = []
    while at in by:
        chain.append(by[at])
        at = by[at].next
    if at == SELECT_CHANNELS:
        chain.append(channels_stage(channels))
    for stage in chain:
        for f in stage.fields:
            if f.type == "constant":
                conf[f.id] = [f.default or ""]
            elif f.type == "selectmany":
                while (picks := parse_selection(ask(f.id) if ask else "all", len(f.options))) is None:
                    pass
                for k, (value, _) in enumerate(f.options):
                    conf.setdefault(f.id if k in picks else f"no_{f.id}", []).append(value)
            elif f.type == "selectone":
                values = [v for v, _ in f.options]
                while True:
                    text = ask(f.id).strip() if ask else ""
                    if not text:
                        conf[f.id] = [f.default if f.default in values else values[0]]
                        break
                    if text.isdigit() and 1 <= int(text) <= len(values):
                        conf[f.id] = [values[int(text) - 1]]
                        break
            else:
                conf[f.id] = [(ask(f.id) if ask else "") or f.default or ""]
    return conf
