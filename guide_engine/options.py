"""Command line options from typed declarations: one table parses them, checks them and writes the usage text."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any


class OptionError(ValueError):
    """The command line can't be understood; its message is for the user."""


@dataclass(frozen=True)
class Option:
    """``kind`` is flag, text or number. ``bare`` is the value of an option that may stand without one; a ``negatable``
    option has a ``--no-`` form, which turns a flag off and any other option to None; ``repeat`` gathers values in a list."""

    kind: str = "flag"
    help: str = ""
    placeholder: str = "VALUE"
    short: str | None = None
    default: Any = None
    bare: Any = None
    negatable: bool = False
    repeat: bool = False
    low: float | None = None
    high: float | None = None
    convert: Callable[[str], Any] | None = None

    def read(self, name: str, word: Any) -> Any:
        if word is None or not isinstance(word, str):
            return word
        if self.kind == "number":
            try:
                number = float(word)
            except ValueError:
                raise OptionError(f"--{name} takes a number, not {word!r}") from None
            if number != number or (self.low is not None and number < self.low) or (self.high is not None and number > self.high):
                raise OptionError(f"--{name} is out of its range: {word}")
            return int(number) if number.is_integer() else number
        try:
            return self.convert(word) if self.convert else word
        except OptionError:
            raise
        except ValueError as e:
            raise OptionError(f"--{name}: {e}") from None

    def shown(self, name: str) -> str:
        value = "" if self.kind == "flag" else f" [{self.placeholder}]" if self.bare is not None else f" {self.placeholder}"
        return ("--[no-]" if self.negatable else "--") + name + value


def one_of(*words: str) -> Callable[[str], str]:
    def check(word: str) -> str:
        if word not in words:
            raise OptionError(f"{word!r} is none of {', '.join(words)}")
        return word

    return check


def _is_option(word: str, option: Option | None = None) -> bool:
    negative = option is not None and option.kind == "number" and word[1:2].isdigit()
    return word.startswith("-") and word != "-" and not negative


def parse(argv: Sequence[str], specs: Mapping[str, Option], positionals: int = 0) -> tuple[dict[str, Any], list[str]]:
    """Values by name (absent options have their default) and the words that belong to none."""
    shorts = {o.short: n for n, o in specs.items() if o.short}
    values: dict[str, Any] = {n: o.default if o.default is not None else False if o.kind == "flag" else None for n, o in specs.items()}
    given: dict[str, list] = {}
    words, rest = deque(argv), []
    while words:
        word = words.popleft()
        if word == "--":
            rest += words
            break
        if not _is_option(word):
            rest.append(word)
            continue
        name, has_value, value = (word[2:] if word.startswith("--") else shorts.get(word[1:2], word) + (f"={word[2:]}" if word[2:] else "")).partition("=")
        off = name.startswith("no-") and name not in specs
        option = specs.get(name[3:] if off else name)
        if option is None or (off and (not option.negatable or has_value)):
            raise OptionError(f"there is no option {word}")
        if off:
            values[name[3:]] = False if option.kind == "flag" else None
            given.pop(name[3:], None)
        elif option.kind == "flag":
            if has_value:
                raise OptionError(f"--{name} takes no value")
            values[name] = True
        else:
            if not has_value:
                if words and not _is_option(words[0], option):
                    value = words.popleft()
                elif option.bare is not None:
                    value = option.bare
                else:
                    raise OptionError(f"--{name} needs a value")
            got = option.read(name, value)
            given.setdefault(name, []).append(got)
            values[name] = given[name] if option.repeat else got
    if len(rest) > positionals:
        raise OptionError(f"{rest[positionals]!r} belongs to no option")
    return values, rest


def usage(program: str, forms: Sequence[Sequence[str]], specs: Mapping[str, Option], width: int = 79) -> str:
    """One synopsis a form (its first name is its mode), wrapped, and then every option with its help."""
    lines = []
    for form in forms:
        line = program
        for k, name in enumerate(form):
            word = specs[name].shown(name)
            word = word if k == 0 and specs[name].kind == "flag" else f"[{word}]"
            if len(line) + 1 + len(word) > width:
                lines.append(line)
                line = " " * (len(program) + 2) + word
            else:
                line += " " + word
        lines.append(line)
    wide = max((len(o.shown(n)) for n, o in specs.items()), default=0)
    told = [f"  {o.shown(n):<{wide}}  {o.help}".rstrip() for n, o in sorted(specs.items())]
    return "\n".join([*lines, "", *told]) + "\n"
