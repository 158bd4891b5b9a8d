"""Operators never pull data to the driver."""

import pathlib
import re

LIB = pathlib.Path(__file__).resolve().parents[1] / "costlens"
BANNED = re.compile(r"\.(collect|toPandas|toLocalIterator|localCheckpoint)\(")


def test_library_has_no_driver_collects():
    bad = []
    for p in LIB.rglob("*.py"):
        for i, line in enumerate(p.read_text().splitlines(), 1):
            if BANNED.search(line):
                bad.append(f"{p.name}:{i}: {line.strip()}")
    assert not bad, bad
