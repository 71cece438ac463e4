"""CSS references: a lossless scan of a sheet into pieces, of which some are url(), image-set strings or @import targets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECE = re.compile(r"""/\*.*?(?:\*/|\Z)|(?P<url>url\(\s*(?P<arg>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|(?:[^\s"'()\\]|\\.)*)\s*\))|(?P<string>"(?:[^"\\\n]|\\(?:.|\n))*"?|'(?:[^'\\\n]|\\(?:.|\n))*'?)|(?P<at>@[\w-]+)|(?P<open>[\w-]*\()|[)]|[{};]|\s+|[\w-]+|.""", re.S | re.I)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})(?:\r\n|[ \t\n\r\f])?|(\r\n|[\n\r\f])|(.))", re.S)
SCAN = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("raw", T.StringType())]))


def unquote(token: str) -> str:
    """The value of a string or bare token: quotes dropped, escapes resolved, bad code points replaced."""
    if token[:1] in "\"'" and token:
        token = token[1:-1] if len(token) > 1 and token[-1] == token[0] else token[1:]

    def one(m: re.Match) -> str:
        if m[1]:
            point = int(m[1], 16)
            return "\ufffd" if not point or point > 0x10FFFF or 0xD800 <= point < 0xE000 else chr(point)
        return "" if m[2] else m[3]

    return _ESCAPE.sub(one, token)


def escape(value: str) -> str:
    """A double-quoted CSS string of ``value``."""
    return '"' + re.sub(r'["\\\n\r\f<]', lambda m: f"\\{ord(m[0]):x} ", value) + '"'


def scan(text: str, imports: bool = True) -> list[tuple[str, str, str]]:
    """Consecutive pieces (text, kind, raw) of a sheet: kind is url, import or empty, raw the reference's value."""
    out: list[tuple[str, str, str]] = []
    plain, opened, rule = [], [], False

    def emit(piece: str, kind: str = "", raw: str = "") -> None:
        if kind:
            if plain:
                out.append(("".join(plain), "", ""))
                plain.clear()
            out.append((piece, kind, raw))
        else:
            plain.append(piece)

    for m in _PIECE.finditer(text):
        piece = m[0]
        if piece.startswith("/*") or piece.isspace():
            emit(piece)
            continue
        if m["url"]:
            value = unquote(m["arg"])
            emit(piece, ("import" if rule and imports else "url") if value.strip() else "", value) if not (rule and not imports) else emit(piece)
            rule = False
        elif m["string"]:
            if rule and imports:
                emit(piece, "import", unquote(piece))
            elif opened and opened[-1] in ("image-set(", "-webkit-image-set(") and unquote(piece).strip():
                emit(piece, "url", unquote(piece))
            else:
                emit(piece)
            rule = False
        else:
            if m["at"]:
                rule = piece.lower() == "@import" and not opened
            else:
                rule = False
            if m["open"]:
                opened.append(piece.lower())
            elif piece == ")" and opened:
                opened.pop()
            elif piece in "{};":
                opened.clear()
            emit(piece)
    if plain:
        out.append(("".join(plain), "", ""))
    return out


@F.pandas_udf(SCAN)
def _scan_all(text: pd.Series, imports: pd.Series) -> pd.Series:
    return pd.Series([[{"text": a, "kind": b, "raw": c} for a, b, c in scan(t, bool(i))] if t is not None else None for t, i in zip(text, imports, strict=True)])


def may_refer(text: Column) -> Column:
    """The cheap test that keeps sheets without references from the scan."""
    return F.lower(text).rlike(r"url\(|image-set\(|@import")


def pieces(text: Column, imports: Column) -> Column:
    """The scan of a sheet as array<struct<text, kind, raw>>; joined texts are the sheet again."""
    return _scan_all(text, imports)


@F.pandas_udf(T.StringType())
def quoted(value: pd.Series) -> pd.Series:
    return value.map(lambda v: escape(v) if v is not None else None)
