"""A new grabber: one executable file that runs the grabber protocol over a configuration."""

from __future__ import annotations

import os
import re

NAME = re.compile(r"tv_grab_[a-z]{2}(_[a-z0-9]+)*")
#: A line about a grabber: printable, without a line break.
DESCRIPTION = re.compile(r"[^\x00-\x1f\x7f]*")

_TEXT = """#!/usr/bin/env python3
import sys

from pyspark.sql import SparkSession

from guide_engine import cli, grabber

spark = SparkSession.builder.appName({name!r}).config("spark.sql.session.timeZone", "UTC").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN").getOrCreate()
about = {{"name": {name!r}, "description": {description!r}, "version": "1.0", "config": cli.load_config({config!r})}}
sys.exit(grabber.run(sys.argv[1:], spark, about))
"""


def country(name: str) -> str:
    """The two letters of the country that a grabber's name tells."""
    if not NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no name of a grabber")
    return name.split("_")[2].upper()


def write(name: str, config: str, description: str = "", path: str | None = None, force: bool = False) -> str:
    """Write the file, executable, and return its path; one that is there is kept unless forced."""
    target = path or name
    described = description or f"Programme guide ({country(name)})"
    if not DESCRIPTION.fullmatch(described):
        raise ValueError("a description is one line")
    handle = os.open(target, os.O_WRONLY | os.O_CREAT | (os.O_TRUNC if force else os.O_EXCL), 0o755)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(_TEXT.format(name=name, description=described, config=os.path.abspath(config)))
    return target
