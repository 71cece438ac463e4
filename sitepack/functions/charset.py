"""Decoding of captured bytes: byte-order marks, declared charsets, defaults.

Everything but the decoding of charsets other than UTF-8 is Column expressions over the first kilobyte; those few rows go
through one Arrow helper.
"""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNIFFED = 1024

# Parts of ISO 8859 with their registration number, year and further names, of which regular labels are made.
ISO_8859 = {
    2: (101, 1987, "latin2 l2 csisolatin2"), 3: (109, 1988, "latin3 l3 csisolatin3"), 4: (110, 1988, "latin4 l4 csisolatin4"), 5: (144, 1988, "cyrillic csisolatincyrillic"),
    6: (127, 1987, "arabic asmo-708 ecma-114 csiso88596e csiso88596i csisolatinarabic iso-8859-6-e iso-8859-6-i"), 7: (126, 1987, "greek greek8 ecma-118 elot_928 sun_eu_greek csisolatingreek"),
    8: (138, 1988, "hebrew visual logical csiso88598e csiso88598i csisolatinhebrew iso-8859-8-e iso-8859-8-i"), 10: (157, None, "latin6 l6 csisolatin6"), 13: (None, None, ""), 14: (None, None, ""), 15: (None, None, "l9 latin9 csisolatin9"), 16: (None, None, ""),
}
# Labels of other encodings; a declared UTF-16 means UTF-8, and labels of ISO 8859-1, -9 and -11 mean Windows code pages.
OTHERS = {
    "utf-8": "utf-8 utf8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8 utf-16 utf-16le utf-16be ucs-2 unicode csunicode iso-10646-ucs-2 unicodefeff unicodefffe",
    "windows-1252": "ascii us-ascii ansi_x3.4-1968 cp819 ibm819 l1 latin1 csisolatin1 iso-ir-100 iso-8859-1 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 x-user-defined",
    "windows-1254": "l5 latin5 csisolatin5 iso-ir-148 iso-8859-9 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989",
    "windows-874": "windows-874 dos-874 tis-620 iso-8859-11 iso8859-11 iso885911",
    "ibm866": "ibm866 866 cp866 csibm866", "koi8-r": "koi8-r koi8_r koi8 koi cskoi8r", "koi8-u": "koi8-u koi8-ru",
    "macintosh": "macintosh mac x-mac-roman csmacintosh", "x-mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "shift_jis": "shift_jis shift-jis sjis x-sjis ms_kanji ms932 windows-31j csshiftjis", "euc-jp": "euc-jp x-euc-jp cseucpkdfmtjapanese", "iso-2022-jp": "iso-2022-jp csiso2022jp",
    "euc-kr": "euc-kr cseuckr korean ksc5601 ksc_5601 ks_c_5601-1987 ks_c_5601-1989 csksc56011987 iso-ir-149 windows-949",
    "gbk": "gbk x-gbk gb2312 gb_2312 gb_2312-80 chinese csgb2312 csiso58gb231280 iso-ir-58", "gb18030": "gb18030", "big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
}


def _names() -> dict[str, str]:
    """Every label and the encoding that it names."""
    names = {label: name for name, labels in OTHERS.items() for label in labels.split()}
    for page in range(1250, 1259):
        names |= dict.fromkeys((f"windows-{page}", f"cp{page}", f"x-cp{page}"), f"windows-{page}")
    for part, (register, year, more) in ISO_8859.items():
        labels = [f"iso-8859-{part}", f"iso8859-{part}", f"iso8859{part}", f"iso_8859-{part}", *more.split()]
        labels += [f"iso-ir-{register}"] * bool(register) + [f"iso_8859-{part}:{year}"] * bool(year)
        names |= dict.fromkeys(labels if part != 16 else labels[:1], f"iso-8859-{part}")
    return names


_NAMES = _names()
# Python codecs of encodings whose web meaning differs from the codec of the same name.
_CODECS = {"shift_jis": "cp932", "euc-kr": "cp949", "gbk": "gb18030", "big5": "big5hkscs", "ibm866": "cp866", "macintosh": "mac_roman", "x-mac-cyrillic": "mac_cyrillic", "windows-874": "cp874"}


def bom(content: Column) -> Column:
    """utf-8, utf-16be or utf-16le where the bytes begin with that byte-order mark, else null."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head == "EFBBBF", "utf-8").when(head.startswith("FEFF"), "utf-16be").when(head.startswith("FFFE"), "utf-16le")


def charset_name(label: Column) -> Column:
    """The encoding a label names, or null."""
    known = F.create_map(*(F.lit(x) for pair in _NAMES.items() for x in pair))
    return F.try_element_at(known, F.lower(F.regexp_replace(label, r"^[\t\n\f\r ]+|[\t\n\f\r ]+$", "")))


def _head(content: Column) -> Column:
    text = F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1")
    return F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", "")


def sniff_html(content: Column) -> Column:
    """The first charset that a meta element declares in the first kilobyte, comments skipped; null if none."""
    metas = F.regexp_extract_all(_head(content), F.lit(r"(?is)<meta(?=[\s/])[^>]*+>"), 0)
    own = lambda m: F.regexp_extract(m, r"""(?is)\scharset\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>/;]+))""", 0)
    inner = lambda m: F.when(m.rlike(r"""(?is)http-equiv\s*=\s*["']?\s*content-type"""), F.regexp_extract(m, r"""(?is)content\s*=\s*(?:"[^"]*?|'[^']*?|[^\s"'>]*?)charset\s*=\s*["']?([^\s"'>;]+)""", 1)).otherwise("")
    value = lambda m: F.regexp_replace(F.regexp_replace(own(m), r"(?is)^\s*charset\s*=\s*", ""), r"""["']""", "")
    found = F.filter(F.transform(metas, lambda m: F.when(m.rlike(r"""(?is)http-equiv"""), inner(m)).otherwise(value(m))), lambda v: F.trim(v) != "")
    return F.try_element_at(found, F.lit(1))


def sniff_css(content: Column) -> Column:
    """The charset of an @charset rule that begins the sheet exactly; null if none."""
    found = F.regexp_extract(F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1"), r'^@charset "([^"]*)";', 1)
    return F.when(found != "", found)


def strip_css_charset(text: Column) -> Column:
    """Drop an @charset rule at the start, whatever white space stands around and within it."""
    return F.regexp_replace(text, r'^\s*@charset\s+"[^"]*"\s*;\s*', "")


@F.pandas_udf(T.StringType())
def _decode_other(content: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or n is None else codecs.decode(bytes(c), _CODECS.get(n, n), "replace") for c, n in zip(content, name, strict=True)], dtype=object)


def decode(files: DataFrame, labels: list[Column], content: str = "content") -> DataFrame:
    """``files`` with ``text`` and ``charset``: by byte-order mark, else the first label that is known, else UTF-8.

    What does not decode becomes U+FFFD, and a leading byte-order mark is dropped.  Null bytes give a null text.
    """
    data = F.col(content)
    name = F.coalesce(bom(data), *(charset_name(x) for x in labels), F.lit("utf-8"))
    rows = files.withColumn("charset", name)
    plain = rows.filter(F.col("charset") == "utf-8").withColumn("text", F.make_valid_utf8(data.cast("string")))
    other = rows.filter(F.col("charset") != "utf-8").withColumn("text", _decode_other(data, F.col("charset")))
    return plain.unionByName(other).withColumn("text", F.regexp_replace("text", "^\ufeff", ""))


def first_known(*labels: str | None) -> str:
    """The driver-side twin of the label chain, for options: the first label that names an encoding, else utf-8."""
    for label in labels:
        found = _NAMES.get(re.sub(r"^[\t\n\f\r ]+|[\t\n\f\r ]+$", "", label or "").lower())
        if found:
            return found
    return "utf-8"
