"""Text, HTML, defanging and file-name functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import refdata as R
from .net import let, literals

#: White space beyond ASCII counts as well.
BLANK = "[\\x20\\t\\n\\x0B\\f\\r\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: The characters of BLANK.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BIDI = "[\\u202A-\\u202E\\u2066-\\u2069\\u200E\\u200F]"
INVISIBLE = "[\\u00AD\\u200B-\\u200D\\u2060\\uFEFF]"


def trimmed(text: Column) -> Column:
    """Text without blanks at its ends; what stands between is not read."""
    return F.trim(text, F.lit(BLANKS))


def is_ascii(text: Column) -> Column:
    """Whether a text has no character beyond ASCII: cheap, and rules out all that other scripts do."""
    return F.octet_length(text) == F.length(text)


def squeezed(text: Column) -> Column:
    """One space for each run of blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


#: Entities that bodies use in prose.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def named_entities(text: Column) -> Column:
    """Entities decoded in one pass: the named ones of ENTITIES and numbers of either base. Others, and
    numbers that are no character, stay."""

    def one(e: Column) -> Column:
        name = F.lower(F.regexp_extract(e, r"&#?([0-9A-Za-z]+);", 1))
        code = F.when(F.startswith(name, F.lit("x")), F.conv(F.substr(name, F.lit(2)), 16, 10)).otherwise(name).try_cast("long")
        sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.coalesce(*[F.when(name == n, F.lit(sign)) for n, sign in ENTITIES.items()], e)
        return F.when(~e.contains("#"), named).when(sound, char).otherwise(e)

    return spliced(text, "(?i)&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z]{2,6});", one)


def strip_html(html: Column) -> Column:
    """Readable text: scripts and styles go, tags become a space, common entities are decoded."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, sign in (("nbsp", " "), ("#39", "'"), ("#x27", "'"), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        out = F.regexp_replace(out, rf"(?i)&{entity};", sign)
    return squeezed(out)


def html_links(html: Column) -> Column:
    """array of struct(href, label): the anchors of a page with their visible text."""
    pattern = F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>""")
    hrefs = F.transform(F.regexp_extract_all(html, pattern, F.lit(1)), trimmed)
    labels = F.transform(F.regexp_extract_all(html, pattern, F.lit(2)), strip_html)
    pairs = F.arrays_zip(hrefs.alias("href"), labels.alias("label"))
    return F.transform(pairs, lambda p: F.struct(p["href"].alias("href"), F.when(p["label"] == "", p["href"]).otherwise(p["label"]).alias("label")))


def looks_like_html(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)<(?:!doctype html|html|head|body|script|form|iframe|meta|div|table|a\s)"), F.lit(False))


def defang_light(value: Column) -> Column:
    """hxxp and [.] as in indicator rows."""
    return F.replace(F.regexp_replace(value, "(?i)http", "hxxp"), F.lit("."), F.lit("[.]"))


def defang_domain(domain: Column) -> Column:
    return F.replace(domain, F.lit("."), F.lit("[.]"))


def defang_ip(ip: Column) -> Column:
    return F.replace(F.replace(ip, F.lit("."), F.lit("[.]")), F.lit(":"), F.lit("[:]"))


def defang_email(email: Column) -> Column:
    """The last @ and the dots behind it."""
    at = F.length(email) - F.length(F.substring_index(email, "@", -1))
    cut = F.concat(F.substr(email, F.lit(1), at - 1), F.lit("[@]"), defang_domain(F.substring_index(email, "@", -1)))
    return F.when(email.contains("@"), cut).otherwise(email)


def defang_url(url: Column) -> Column:
    """hxxps[://]host[.]tld, path unchanged."""
    scheme = F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    rest = F.substr(url, F.length(scheme) + F.length(host) + 4)
    whole = F.concat(F.regexp_replace(scheme, "(?i)http", "hxxp"), F.lit("[://]"), defang_domain(host), rest)
    return F.when(scheme != "", whole).otherwise(defang_domain(url))


# Endings of dotted names that are files, and property names of authentication results.
FILE_ENDINGS = "exe pdf doc docx docm xls xlsx xlsm ppt pptx rar 7z gz tar cab js vbs vbe wsf hta html htm iso img lnk scr bat cmd ps1 dll jar msi txt csv png jpg jpeg gif svg eml msg ics json xml py sh".split()
PROPERTY = r"\A(?:header|smtp|policy|body)\.[a-z-]+\z"

#: What text defanging looks for; at one place the first kind counts.
_LINK = r"\b(?:https?|ftp)://[^\s<>\"'`)\]]+"
# A run of an address's characters is tried from its start alone, or from where the last match ended.
_ADDRESS = r"(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++@(?:[a-z0-9-]++\.)+[a-z]{2,}"
_DOTTED = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
_NAME = r"\b(?:[a-z0-9-]++\.)+[a-z]{2,}\b"
_TARGETS = f"(?i){_LINK}|{_ADDRESS}|{_DOTTED}|{_NAME}"


def spliced(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """text with change applied to each leftmost match of a pattern, in one pass."""
    return _joined(_pieces(text, pattern), change)


#: Set around the matches of a pattern; a text that holds it is read twice instead.
_MARK = "\u0001"


def _pieces(text: Column, pattern: str) -> Column:
    """A text in turns of what stands between matches of a pattern and a match, n + 1 and n of them."""
    marked = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    turns = F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda b, m: F.array(b, m)))
    return F.when(text.contains(_MARK), F.slice(turns, F.lit(1), F.size(found) * 2 + 1)).otherwise(marked)


def _joined(pieces: Column, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, change(p)).otherwise(p)), "")


def defang_targets(text: Column) -> Column:
    """How many links, addresses and names, file names included, defang_text looks at."""
    return F.size(F.regexp_extract_all(text, F.lit(_TARGETS), F.lit(0)))


def defang_text(text: Column) -> Column:
    """Links, e-mail addresses, dotted addresses and names inside free text defanged in one pass, links
    with what stands in their path. File names and names of authentication properties stay."""
    return defanged(text)["text"]


def defanged(text: Column) -> Column:
    """struct(text, n): what defang_text and defang_targets tell, in one pass."""

    def plain(m: Column) -> Column:
        low = F.lower(m)
        kept = F.substring_index(low, ".", -1).isin(FILE_ENDINGS) | low.rlike(PROPERTY)
        return F.when(m.contains("@"), defang_email(m)).when(kept, m).otherwise(defang_domain(m))

    def link(m: Column, rest: Callable[[Column], Column]) -> Column:
        scheme = F.lower(F.substring_index(m, "://", 1))
        host = F.regexp_extract(m, "://([^/?#]*)", 1)
        tail = F.substr(m, F.length(scheme) + F.length(host) + 4)
        safe = F.regexp_replace(F.regexp_replace(scheme, "^http", "hxxp"), "^ftp", "fxp")
        return F.concat(safe, F.lit("[://]"), F.replace(defang_domain(host), F.lit("@"), F.lit("[@]")), rest(tail))

    names = f"(?i){_ADDRESS}|{_DOTTED}|{_NAME}"

    def inside(tail: Column) -> Column:
        return spliced(tail, names, plain)

    def safe(m: Column) -> Column:
        return F.when(m.contains("://"), link(m, inside)).otherwise(plain(m))

    return let(_pieces(text, _TARGETS), lambda p: F.struct(_joined(p, safe).alias("text"), F.floor(F.size(p) / 2).cast("int").alias("n")))


def subject_key(subject: Column) -> Column:
    """A subject without one reply mark, with numbers as #."""
    low = F.regexp_replace(F.lower(F.coalesce(subject, F.lit(""))), rf"\A{BLANK}*(?:re|fw|fwd){BLANK}*:{BLANK}*", "")
    return squeezed(F.regexp_replace(low, "[0-9]+", "#"))


def extension_of(name: Column) -> Column:
    """Lower-case letters and digits after the last dot, or an empty string."""
    return F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)\z", 1)


def risky_extension(name: Column) -> Column:
    return F.coalesce(extension_of(name).isin(R.RISKY_EXTENSIONS), F.lit(False))


def double_extension(name: Column) -> Column:
    return F.coalesce(F.exists(literals(["." + d for d in R.DOUBLE_EXTENSIONS]), lambda d: F.lower(name).contains(d)), F.lit(False))


def mixed_script_words(text: Column) -> Column:
    """Distinct words that mix Latin letters with Cyrillic, Greek, Armenian or Cherokee ones."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]{3,}"), F.lit(0))
    other = r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}]"
    mixed = F.array_distinct(F.filter(words, lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(other)))
    # Most texts hold no letter of the other scripts; their words are not taken apart.
    return F.when(is_ascii(text) | ~text.rlike(other), F.array().cast("array<string>")).otherwise(mixed)


def bidi_control(text: Column) -> Column:
    return F.coalesce(text.rlike(BIDI), F.lit(False))


def invisible_in_words(text: Column) -> Column:
    """Number of invisible characters between two letters."""
    found = F.regexp_count(text, F.lit(rf"\p{{L}}{INVISIBLE}+(?=\p{{L}})"))
    return F.coalesce(F.when(is_ascii(text), 0).otherwise(found), F.lit(0))


def half_up(x: Column) -> Column:
    """Rounding as floor(x + 1/2)."""
    return F.floor(x + 0.5)


def diminishing(n: Column, first: int, more: int) -> Column:
    """first for one, more for each of up to four others."""
    return F.when(n > 0, first + F.least(n - 1, F.lit(4)) * more).otherwise(0)


# File types by their first bytes (hex), first match wins, and the extensions they have
# by right. A disk image is told by bytes further in.
FILE_TYPES = (
    ("PE program", "4D5A", "exe dll scr sys cpl ocx msi"), ("ELF program", "7F454C46", "elf so bin"), ("Mach-O program", "CFFAEDFE", "dylib bin app"), ("PDF", "25504446", "pdf"),
    ("ZIP", "504B", "zip docx xlsx pptx odt ods odp jar apk epub vsdx xlsm docm pptm"), ("RAR", "52617221", "rar"), ("7-Zip", "377ABCAF271C", "7z"), ("GZIP", "1F8B", "gz tgz"),
    ("OLE", "D0CF11E0", "doc xls ppt msg vsd"), ("RTF", "7B5C727466", "rtf doc"), ("PNG", "89504E47", "png"), ("JPEG", "FFD8FF", "jpg jpeg"), ("GIF", "47494638", "gif"), ("BMP", "424D", "bmp"),
    ("ICO", "00000100", "ico"), ("shortcut", "4C000000", "lnk"), ("Java class", "CAFEBABE", "class"), ("ISO", "4344303031", "iso"),
)
OFFSETS = {"ISO": 0x8001}
PROGRAMS = ("PE program", "ELF program", "Mach-O program", "shortcut", "Java class")


def sniffed(content: Column) -> Column:
    """The type that a file's bytes tell, or null."""
    return F.coalesce(*[F.when(F.hex(F.substring(content, OFFSETS.get(kind, 0) + 1, len(code) // 2)) == code, F.lit(kind)) for kind, code, _ in FILE_TYPES])


def belongs(kind: Column, extension: Column) -> Column:
    """Whether a file type has an extension by right; a file without extension or known type does."""
    known = F.create_map(*[x for name, _, ends in FILE_TYPES for x in (F.lit(name), F.array(*[F.lit(e) for e in ends.split()]))])
    return kind.isNull() | (F.coalesce(extension, F.lit("")) == "") | F.array_contains(F.element_at(known, kind), extension)


def stripped(text: Column) -> Column:
    """Text without the characters that turn its direction."""
    return F.regexp_replace(text, BIDI, "")
