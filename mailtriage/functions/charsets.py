"""Text in single-byte charsets, and compatibility forms of letters, as columns.

Both are tables that Python's own codecs and Unicode data generate when the module is loaded; Spark gets
them as two strings to translate between.
"""

from __future__ import annotations

import codecs
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Single-byte charsets; the label of Latin-1 means Windows-1252 in mail, as in browsers.
SINGLE_BYTE = [f"windows-{n}" for n in range(1250, 1259)] + [f"iso-8859-{n}" for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)] + ["koi8-r", "koi8-u", "ibm866", "macintosh"]
ALIASES = {"iso-8859-1": "windows-1252", "latin1": "windows-1252", "us-ascii": "windows-1252", "ascii": "windows-1252", "iso-8859-9": "windows-1254", "latin5": "windows-1254", "cp1251": "windows-1251", "cp1252": "windows-1252", "latin2": "iso-8859-2"}
_UPPER = bytes(range(128, 256)).decode("latin-1")


def upper_half(charset: str) -> str:
    """The characters of bytes 128 to 255; U+FFFD for those without one."""
    name = "mac-roman" if charset == "macintosh" else charset.replace("windows-", "cp") if charset.startswith("windows-") else charset
    decoder = codecs.lookup(name)
    return "".join(decoder.decode(bytes([b]), "replace")[0] for b in range(128, 256))


TABLES = {name: upper_half(name) for name in SINGLE_BYTE}


def single_byte(content: Column, charset: Column) -> Column:
    """Bytes as text in the named charset; null for charsets that are not in the table."""
    low = F.lower(F.trim(charset))
    known = F.create_map(*[F.lit(x) for name in [*TABLES, *ALIASES] for x in (name, TABLES[ALIASES.get(name, name)])])
    return F.call_function("translate", F.decode(content, "ISO-8859-1"), F.lit(_UPPER), F.try_element_at(known, low))


def _compatible() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form is one ASCII letter or digit, those forms, and the others
    whose form is several."""
    one, forms, several = [], [], {}
    for code in range(0x80, 0x1FBFA):
        form = unicodedata.normalize("NFKC", chr(code)).lower()
        if form != chr(code) and form.isascii() and form.isalnum():
            if len(form) == 1:
                one.append(chr(code))
                forms.append(form)
            else:
                several[chr(code)] = form
    return "".join(one), "".join(forms), several


_ONE, _FORMS, _SEVERAL = _compatible()
_LIST = "".join(f"{c}={form};" for c, form in _SEVERAL.items())


def compatible(text: Column) -> Column:
    """Text with full-width, mathematical, circled and ligature forms of ASCII letters and digits as
    those letters, lower-cased. ASCII text passes as it is."""

    def spelled(t: Column) -> Column:
        single = F.translate(t, _ONE, _FORMS)
        found = F.array_distinct(F.regexp_extract_all(single, F.lit("[" + "".join(_SEVERAL) + "]"), F.lit(0)))

        def put(s: Column, c: Column) -> Column:
            form = F.call_function("substring_index", F.call_function("substring_index", F.lit(_LIST), F.concat(c, F.lit("=")), F.lit(-1)), F.lit(";"), F.lit(1))
            return F.call_function("replace", s, c, form)

        return F.when(F.octet_length(t) == F.length(t), t).otherwise(F.aggregate(found, single, put))

    return F.transform(F.array(text), spelled)[0]
