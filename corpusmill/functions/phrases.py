"""Phrase lists and character maps: defaults of the filters and transforms, all of them parameters.

phrases.json holds fixed values: the rules that use them give the expected verdicts with these
values only. Lists and maps are plain, in the order in which replacements are made.
"""

from __future__ import annotations

import json
from pathlib import Path

_ALL = json.loads(Path(__file__).with_name("phrases.json").read_text(encoding="utf-8"))


def phrases(name: str, *groups: str) -> list[str]:
    """A list; of a grouped list, all groups or those named."""
    values = _ALL[name]
    if isinstance(values, dict):
        return [x for g, xs in values.items() if not groups or g in groups for x in xs]
    return list(values)


def mapping(name: str) -> dict[str, str]:
    return dict(_ALL[name])


#: Marks the end of a document in delimited text.
END = "<|endoftext|>"
