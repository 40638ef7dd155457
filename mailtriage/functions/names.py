"""Names as Column expressions: file names, lists of domains, DOS times, passwords said in a text, hidden
controls made visible. A null name is an empty one unless a function says otherwise."""

from __future__ import annotations

from functools import lru_cache
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .net import let, literals

# Endings that run, or carry what runs, when a file is opened.
EXECUTABLE = "exe com scr pif bat cmd ps1 psm1 vbs vbe js jse wsf wsh hta msi msp dll cpl ocx sys lnk reg jar apk app sh bash command docm xlsm pptm iso img vhd vhdx one url".split()

# Control characters by code, with the names that standards give them.
CONTROLS = {
    0x202A: "LRE", 0x202B: "RLE", 0x202C: "PDF", 0x202D: "LRO", 0x202E: "RLO", 0x2066: "LRI", 0x2067: "RLI", 0x2068: "FSI", 0x2069: "PDI", 0x200E: "LRM", 0x200F: "RLM", 0x061C: "ALM",
}

# Words for a password in nine languages, and words that follow them without being one.
PASSWORD_WORDS = ("password", "passcode", "passphrase", "pass code", "pwd", "pw", "kennwort", "passwort", "mot de passe", "contraseña", "contrasena", "senha", "parola", "wachtwoord", "пароль")
NO_PASSWORD = (
    "is the your a an to for of protected required below above attached reset reminder expired expires expiry policy change changed update manager field here this that will be has have was".split()
)
MOST_PASSWORDS = 10

LONGEST_NAME, LONGEST_SLUG = 180, 40


def executable_name(name: Column) -> Column:
    """Whether a file name's ending is one of EXECUTABLE."""
    return F.coalesce(T.extension_of(name).isin(EXECUTABLE), F.lit(False))


def safe_filename(name: Column, raw: bool = False, program: Column | None = None) -> Column:
    """A file name without control characters, path and reserved signs, blanks or dots at its ends, of 180
    characters at most; `file` where nothing is left. With raw, names without an ending, with an
    executable one, or of contents that are a program get `.bin` behind."""
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r"[\x00-\x1F\x7F]", "")
    clean = F.regexp_replace(clean, r'[\\/:*?"<>|]', "_")
    ends = "[." + T.BLANK[1:]
    clean = F.substring(F.regexp_replace(clean, rf"\A{ends}+|{ends}+\z", ""), 1, LONGEST_NAME)
    clean = F.when(F.coalesce(clean, F.lit("")) == "", "file").otherwise(clean)
    if not raw:
        return clean
    runs = F.coalesce(program, F.lit(False)) if program is not None else F.lit(False)
    return let(clean, lambda c: F.when((T.extension_of(c) == "") | executable_name(c) | runs, F.concat(c, F.lit(".bin"))).otherwise(c))


@lru_cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Characters whose decomposition holds ASCII: those that give one sign, that sign, and the others."""
    single, several = {}, {}
    for code in range(0x80, 0x1F200):
        if 0x3400 <= code < 0xF900:  # ideographs, syllables and surrogates
            continue
        held = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c < "\x80")
        if len(held) == 1:
            single[chr(code)] = held
        elif held:
            several[chr(code)] = held
    return "".join(single), "".join(single.values()), several


def ascii_letters(text: Column) -> Column:
    """text with every character as the ASCII part of its compatibility decomposition."""
    origin, twin, several = _plain_letters()
    table = F.map_from_arrays(literals(list(several)), literals(list(several.values())))
    text = T.spliced(text, "[" + "".join(several) + "]", lambda c: F.element_at(table, c))
    return F.regexp_replace(F.translate(text, origin, twin), r"[^\x00-\x7F]", "")


def report_filename(subject: Column, day: Column, ending: str) -> Column:
    """phishing-report_<day>_<slug of the subject>.<ending>; slugs longer than 40 characters end at a word."""
    bare = F.lower(ascii_letters(F.coalesce(subject, F.lit(""))))
    full = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), r"\A-|-\z", "")

    def cut(whole: Column) -> Column:
        start = F.substring(whole, 1, LONGEST_SLUG)
        slug = F.when(F.length(whole) > LONGEST_SLUG, F.regexp_replace(start, r"-[^-]*\z", "")).otherwise(start)
        return F.when(slug == "", "email").otherwise(slug)

    return F.concat(F.lit("phishing-report_"), F.date_format(day, "yyyy-MM-dd"), F.lit("_"), let(full, cut), F.lit(f".{ending}"))


def dos_time(at: Column) -> Column:
    """struct(time, day): a timestamp in the session's zone as archives store it, in steps of two seconds."""
    time = F.hour(at) * 2048 + F.minute(at) * 32 + F.floor(F.second(at) / 2).cast("int")
    day = (F.year(at) - 1980) * 512 + F.month(at) * 32 + F.dayofmonth(at)
    return F.struct(time.alias("time"), day.alias("day"))


def from_dos_time(time: Column, day: Column) -> Column:
    """The timestamp of dos_time()'s numbers, or null if they name none."""
    fields = [F.shiftright(day, 9) + 1980, F.shiftright(day, 5) % 16, day % 32, F.shiftright(time, 11), F.shiftright(time, 5) % 64, (time % 32) * 2]
    return F.try_make_timestamp(*fields)


#: Labels of 1 to 63 letters, digits and inner hyphens, two of them at least.
_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_DOMAIN = rf"\A{_LABEL}(?:\.{_LABEL})+\z"


def domain_list(text: Column) -> Column:
    """struct(valid, invalid): the domains that a hand-written list names, each once, and its other entries.

    Line ends, commas and semicolons part entries, and blanks do where all words between look like
    domains. Links and addresses stand for their domain; a leading www. goes.
    """

    def pieces(chunk: Column) -> Column:
        words = F.split(chunk, T.BLANK + "+")
        several = (F.size(words) > 1) & F.forall(words, lambda w: w.rlike(r"(?i)\.[a-z]{2,}"))
        return F.when(several, words).otherwise(F.array(chunk))

    def read(entry: Column) -> Column:
        domain = F.regexp_extract(F.lower(entry), r"(?s)\A(?:[a-z]+://)?(?:.*@)?([^/?#]*)", 1)
        return F.struct(entry.alias("entry"), F.regexp_replace(domain, r"\Awww\.|\.\z", "").alias("domain"))

    chunks = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n,;]+"), T.trimmed)
    entries = F.filter(F.flatten(F.transform(chunks, pieces)), lambda e: e != "")

    def parted(judged: Column) -> Column:
        valid = F.transform(F.filter(judged, lambda j: j["domain"].rlike(_DOMAIN)), lambda j: j["domain"])
        invalid = F.transform(F.filter(judged, lambda j: ~j["domain"].rlike(_DOMAIN)), lambda j: j["entry"])
        return F.struct(F.array_distinct(valid).alias("valid"), invalid.alias("invalid"))

    return let(F.transform(entries, read), parted)


def _password_pattern() -> str:
    """A word for a password, what it is for, a verb or sign, and the candidate as group 1."""
    blank = T.BLANK
    words = "|".join(w.replace(" ", f"{blank}+") if w != "pass code" else f"pass{blank}*code" for w in PASSWORD_WORDS)
    object_ = f"(?:for{blank}+the{blank}+(?:file|archive|attachment|zip|document){blank}*)?"
    verb = f"(?:is|[:=–—-])?{blank}*(?:is{blank}*)?(?:{blank}|:)*"
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_]){blank}*{object_}{verb}[\"'“‘«]?([^\s\"'”’»<>]{{3,40}})"


def said_passwords(text: Column) -> Column:
    """The passwords that a text names (`the password is: 7731`), each once, in order, ten at most: more are
    not tried on an archive."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_password_pattern()), F.lit(1))
    bare = F.transform(found, lambda p: F.regexp_replace(p, r"[.,;:!?)\]]+\z", ""))
    kept = F.filter(bare, lambda p: (F.length(p) >= 3) & ~F.lower(p).isin(NO_PASSWORD))
    return F.slice(F.array_distinct(kept), 1, MOST_PASSWORDS)


def revealed(text: Column) -> Column:
    """text with direction controls written out: `invoice[U+202E RLO]fdp.exe`."""
    out = F.coalesce(text, F.lit(""))
    for code, name in CONTROLS.items():
        out = F.replace(out, F.lit(chr(code)), F.lit(f"[U+{code:04X} {name}]"))
    return out
