"""Character references in titles and snippets."""

from __future__ import annotations

import re
from html.entities import html5, name2codepoint

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_UNKNOWN = set("alefsym dArr frasl hArr image lArr lang middot rArr rang real uArr weierp".split())
_INVISIBLE = set("Tab NewLine nbsp shy ensp emsp thinsp zwnj zwj lrm rlm".split())


def _table() -> dict[str, str]:
    table = {n: chr(c) for n, c in name2codepoint.items() if n not in _UNKNOWN}
    table |= {n[:-1]: c for n, c in html5.items() if n.endswith(";") and len(c) == 1 and 0x100 <= ord(c) <= 0x17F and n != "inodot;"}
    table |= {n: chr(c) for n, c in (("Ebreve", 0x114), ("ebreve", 0x115), ("gcedil", 0x123), ("Ibreve", 0x12C), ("ibreve", 0x12D), ("Obreve", 0x14E), ("obreve", 0x14F), ("dot", 0xB7), ("quot", 0x201C))}
    return table | dict.fromkeys(_INVISIBLE, "")


NAMED = _table()
_REFERENCE = re.compile(r"&([A-Za-z0-9#]{1,31});")


def _one(match: re.Match) -> str:
    name = match.group(1)
    if not name.startswith("#"):
        return NAMED.get(name, "")
    try:
        code = int(name[2:], 16) if name[1:2] == "x" else int(name[1:], 10)
        return "" if 0xD800 <= code <= 0xDFFF or code == 0 else chr(code)
    except (ValueError, OverflowError):
        return ""


def decode(text: str | None) -> str | None:
    """References replaced in one pass; unknown and bad ones go, a bare & stays."""
    return text if text is None or "&" not in text else _REFERENCE.sub(_one, text)


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    return text.map(decode, na_action="ignore")
