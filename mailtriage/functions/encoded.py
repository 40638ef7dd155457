"""Text that stands for bytes: hex in its usual spellings, hex dumps, Base64 and data URIs, as columns.

The form is inferred: a data URI by its head, hex if nothing but pairs of digits is left once separators,
prefixes and a dump's offsets and letters are gone, else Base64 of either alphabet, with or without
padding and line ends. What fits none has a reason instead of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .net import let

#: A line of a hex dump: an offset, pairs of digits, and after two blanks or a bar what they show.
_DUMP = r"(?im)^[ \t]*[0-9a-f]{4,16}[:\s][ \t]*((?:[0-9a-f]{2}[ \t]{1,2}){1,32}).*$"
_URI = r"(?is)\Adata:[^,]*;base64,(.*)\z"


def hex_digits(text: Column) -> Column:
    """The digits of hex text without prefixes, separators and what a dump adds; null if others are left."""
    bare = F.regexp_replace(F.regexp_replace(F.concat(text, F.lit("\n")), r"\r?\n", " \n"), _DUMP, "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)0x|\\x|%", " "), r"[\s,:;-]+", "")
    return F.when(bare.rlike(r"(?i)\A[0-9a-f]+\z"), bare)


def base64_bytes(text: Column) -> Column:
    """The bytes of Base64 text; null if it is none."""

    def decoded(clean: Column) -> Column:
        padded = F.rpad(clean, (F.ceil(F.length(clean) / 4) * 4).cast("int"), "=")
        sound = clean.rlike(r"\A[A-Za-z0-9+/]*\z") & (F.length(clean) % 4 != 1)
        return F.when(sound, F.try_to_binary(padded, F.lit("base64")))

    return let(F.regexp_replace(F.translate(F.regexp_replace(text, r"\s+", ""), "-_", "+/"), "=+$", ""), decoded)


def decoded(text: Column) -> Column:
    """struct(kind, content, reason) of text: kind is `data URI`, `hex` or `base64`, or null with a
    reason. Null and blank text is empty."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\s+|\s+\z", ""))

    def told(kind: Column | None, content: Column | None, reason: Column) -> Column:
        none = F.lit(None)
        return F.struct((none.cast("string") if kind is None else kind).alias("kind"), (none.cast("binary") if content is None else content).alias("content"), reason.cast("string").alias("reason"))

    def judged(x: Column) -> Column:
        wrong = F.lit("neither hex nor Base64")
        pairs = F.length(x["digits"]) % 2 == 0
        return (
            F.when(x["clean"] == "", told(None, None, F.lit("empty")))
            .when(x["clean"].rlike(_URI), let(base64_bytes(F.regexp_extract(x["clean"], _URI, 1)), lambda b: told(F.when(b.isNotNull(), "data URI"), b, F.when(b.isNull(), wrong))))
            .when(x["digits"].isNotNull() & ~pairs, told(None, None, F.concat(F.lit("an odd number of hex digits: "), F.length(x["digits"]).cast("string"))))
            .when(x["digits"].isNotNull(), told(F.lit("hex"), F.unhex(x["digits"]), F.lit(None)))
            .otherwise(let(base64_bytes(x["clean"]), lambda b: told(F.when(b.isNotNull(), "base64"), b, F.when(b.isNull(), wrong))))
        )

    return let(let(clean, lambda c: F.struct(c.alias("clean"), hex_digits(c).alias("digits"))), judged)
