"""Addresses and domains as Column expressions: no Python runs on the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charsets
from . import refdata as R

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: without it, every use of value would repeat its expression."""
    return F.transform(F.array(value), body)[0]


def _whole(pattern: str) -> str:
    """A pattern for all of a text; Java's $ would also match before a last line feed."""
    return pattern.replace("$", r"\z")


def valid_ipv4(value: Column) -> Column:
    """Four octets up to 255 without leading zeros."""
    return F.coalesce(value.rlike(_whole(IPV4)), F.lit(False))


def valid_ipv6(value: Column) -> Column:
    """Eight groups of up to four hex digits, or fewer with one ::; an IPv4 tail counts as two."""
    low = F.lower(value)
    tail = F.regexp_extract(low, r":([0-9.]*\.[0-9.]*)\z", 1)
    has_tail = F.length(tail) > 0
    head = F.when(has_tail, F.concat(F.substr(low, F.lit(1), F.length(low) - F.length(tail)), F.lit("0"))).otherwise(low)
    pairs = F.size(F.split(head, "::", -1)) - 1
    groups = F.filter(F.split(F.replace(head, F.lit("::"), F.lit(":")), ":", -1), lambda g: g != "")
    sound = F.forall(groups, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
    total = F.size(groups) + has_tail.cast("int")
    fits = F.when(pairs == 1, total <= 7).otherwise((pairs == 0) & (total == 8))
    # Without :: no group may be empty.
    plain = (pairs == 1) | ~head.rlike(r"(\A:|:\z|::)")
    return F.coalesce(low.contains(":") & (~has_tail | valid_ipv4(tail)) & sound & fits & plain, F.lit(False))


def private_ipv4(value: Column) -> Column:
    """Whether a valid address is private, loopback, link-local, shared, multicast or reserved."""
    part = F.split(value, r"\.")
    a, b = F.try_element_at(part, F.lit(1)).try_cast("int"), F.try_element_at(part, F.lit(2)).try_cast("int")
    reserved = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    return F.coalesce(valid_ipv4(value) & reserved, F.lit(False))


def private_ip(value: Column) -> Column:
    low = F.lower(value)
    six = low.isin("::1", "::") | low.rlike(r"\A(f[cd]|fe[89ab])") | private_ipv4(F.regexp_extract(low, r":([0-9.]+\.[0-9.]+)\z", 1))
    return private_ipv4(value) | (valid_ipv6(value) & six)


def routable_ip(value: Column) -> Column:
    return (valid_ipv4(value) | valid_ipv6(value)) & ~private_ip(value)


def find_ipv4(text: Column) -> Column:
    """Array of the distinct valid IPv4 addresses of a text, in order. A run of digits and dots
    counts as a whole, so longer dotted numbers yield no slice."""
    runs = F.regexp_extract_all(text, F.lit(r"(?=[0-9])(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda x: x.rlike(_whole(IPV4))))


def find_ipv6(text: Column) -> Column:
    """Array of the distinct valid IPv6 addresses of a text as written, in order. A run of letters,
    digits, dots and colons counts as a whole, without the `IPv6:` that servers write before an address
    and without a dot or single colon at its end."""
    run = "(?<![0-9A-Za-z:.])[0-9A-Za-z.]*+:[0-9A-Za-z.]*+:[0-9A-Za-z:.]*+"  # two colons at least
    runs = F.regexp_extract_all(text, F.lit(run), F.lit(0))
    bare = F.transform(runs, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)\Aipv6:", ""), r"\.+\z|(?<!:):\z", ""))
    return F.array_distinct(F.filter(bare, valid_ipv6))


def find_ips(text: Column) -> Column:
    """Array of the distinct addresses of a text, IPv4 ones first."""
    return F.concat(find_ipv4(text), find_ipv6(text))


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits.cast("int"))


def ip_value(address: Column) -> Column:
    """An address as 128 bits, struct(hi, lo) of two longs; null if it is none. All spellings of an
    address have one value; an IPv4 address has that of ::ffff:a.b.c.d."""

    def of_octets(dotted: Column) -> Column:
        return F.aggregate(F.split(dotted, r"\."), F.lit(0).cast("long"), lambda n, o: n * 256 + o.try_cast("long"))

    def of_groups(low: Column) -> Column:
        tail = F.regexp_extract(low, r":([0-9]+(?:\.[0-9]+){3})\z", 1)
        hexed = F.lpad(F.lower(F.hex(of_octets(tail))), 8, "0")
        plain = F.when(tail != "", F.concat(F.substr(low, F.lit(1), F.length(low) - F.length(tail)), F.substr(hexed, F.lit(1), F.lit(4)), F.lit(":"), F.substr(hexed, F.lit(5)))).otherwise(low)

        def filled(x: Column) -> Column:
            sides = F.transform(F.split(x, "::", -1), lambda side: F.filter(F.split(side, ":"), lambda g: g != ""))
            left, right = sides[0], F.coalesce(F.try_element_at(sides, F.lit(2)), F.array().cast("array<string>"))
            zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
            return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")

        def words(digits: Column) -> Column:
            part = [_number(F.substr(digits, F.lit(8 * i + 1), F.lit(8))) for i in range(4)]
            return F.struct((_shifted(part[0], F.lit(32)).bitwiseOR(part[1])).alias("hi"), (_shifted(part[2], F.lit(32)).bitwiseOR(part[3])).alias("lo"))

        return let(let(plain, filled), words)

    four = F.struct(F.lit(0).cast("long").alias("hi"), (of_octets(address) + 0xFFFF_0000_0000).cast("long").alias("lo"))
    return F.when(valid_ipv4(address), four).when(valid_ipv6(address), of_groups(F.lower(address)))


def ip_masked(value: Column, length: Column) -> Column:
    """The first `length` of an address's 128 bits, the others 0."""
    ones = F.lit(-1).cast("long")
    hi = F.when(length <= 0, F.lit(0).cast("long")).when(length >= 64, ones).otherwise(_shifted(ones, 64 - length))
    lo = F.when(length <= 64, F.lit(0).cast("long")).when(length >= 128, ones).otherwise(_shifted(ones, 128 - length))
    return F.struct(value["hi"].bitwiseAND(hi).alias("hi"), value["lo"].bitwiseAND(lo).alias("lo"))


def ip_full(value: Column) -> Column:
    """One spelling for each value: dotted for IPv4, else eight groups of four digits."""
    lo = value["lo"]
    dotted = F.concat_ws(".", *[F.call_function("shiftright", lo, F.lit(s)).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    digits = F.lower(F.concat(F.lpad(F.hex(value["hi"]), 16, "0"), F.lpad(F.hex(lo), 16, "0")))
    groups = F.regexp_replace(digits, "(.{4})(?!$)", "$1:")
    return F.when((value["hi"] == 0) & (F.call_function("shiftright", lo, F.lit(32)) == 0xFFFF), dotted).when(value.isNotNull(), groups)


def find_emails(text: Column) -> Column:
    """Array of the lower-cased e-mail addresses of a text, in order, repeats included."""
    found = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda x: F.lower(x))
    return F.when(~text.contains("@"), F.array().cast("array<string>")).otherwise(found)


def domain_part(address: Column) -> Column:
    """What follows the last @, lower-cased, without trailing marks; null without one."""
    part = F.regexp_replace(F.lower(F.substring_index(address, "@", -1)), r"[>\s;,]+\z", "")
    return F.when(address.contains("@") & (part != ""), part)


def org_domain(domain: Column) -> Column:
    """The organisational domain: two labels, or three above a two-label suffix."""

    def of_parts(parts: Column) -> Column:
        n = F.size(parts)
        two = F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), 2), ".")
        three = F.array_join(F.slice(parts, F.greatest(n - 2, F.lit(1)), 3), ".")
        return F.when(n <= 2, F.nullif(F.array_join(parts, "."), F.lit(""))).when(F.array_contains(literals(R.TWO_LABEL_SUFFIXES), two), three).otherwise(two)

    return let(F.filter(F.split(F.regexp_replace(F.lower(domain), r"\.\z", ""), r"\."), lambda p: p != ""), of_parts)


def url_host(url: Column) -> Column:
    """The lower-cased host of an absolute URL, without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"\A[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.\z", ""), F.lit(""))


def under_domain(host: Column, domains: list[str]) -> Column:
    """Whether host is one of the domains or below one: a test of its suffixes against the set."""

    def suffixes(parts: Column) -> Column:
        return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))

    return F.coalesce(F.arrays_overlap(let(F.split(F.lower(host), r"\."), suffixes), literals(domains)), F.lit(False))


def risky_tld(host: Column) -> Column:
    return F.coalesce(F.substring_index(F.lower(host), ".", -1).isin(R.RISKY_TLDS), F.lit(False))


def skeleton(text: Column) -> Column:
    """The shape a reader sees: compatibility forms become plain letters, confusable letters their twin,
    rn is m, vv is w, marks go."""
    folded = F.translate(charsets.compatible(F.lower(text)), R.CONFUSABLE_FROM, R.CONFUSABLE_TO)
    return F.regexp_replace(F.replace(F.replace(folded, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w")), "[^a-z0-9]", "")


def mixed_script(label: Column) -> Column:
    """Latin letters together with Cyrillic or Greek ones."""
    return F.coalesce(label.rlike("[A-Za-z]") & label.rlike("[Ͱ-ϿЀ-ӿ]"), F.lit(False))


def brand_entries(own: tuple[str, ...] = ()) -> Column:
    """array of struct(brand, domains, own): the protected own domains, then the brands."""
    entries = [(o.split(".")[0], [o], True) for o in dict.fromkeys(own)] + [(n, d, False) for n, d in R.BRANDS.items()]
    return F.array(*[F.struct(F.lit(n).alias("brand"), literals(d).alias("domains"), F.lit(mine).alias("own")) for n, d, mine in entries])


def lookalike(host: Column, own: tuple[str, ...] = ()) -> Column:
    """struct(brand, kind, own) of the strongest resemblance of a host to a brand, or null.

    Kinds in order of strength: confusable, tld-swap (own domains only), typosquat, contains; of
    one kind the first entry counts, own domains before brands. The entries are a literal array, so
    no join is needed.
    """

    def graded(e: Column, x: Column) -> Column:
        n = F.length(e["brand"])
        kind = (
            F.when((x["shape"] == e["brand"]) & (x["name"] != e["brand"]), 1)
            .when(e["own"] & (x["name"] == e["brand"]), 2)
            .when((n >= 5) & (F.abs(x["length"] - n) <= 2) & let(F.levenshtein(x["shape"], e["brand"]), lambda away: (away > 0) & (away <= F.when(n >= 8, 2).otherwise(1))), 3)
            .when((n >= 4) & (x["flat"] != e["brand"]) & F.array_contains(x["words"], e["brand"]), 4)
        )
        return F.struct(kind.alias("grade"), e["brand"].alias("brand"), e["own"].alias("own"))

    def best(x: Column) -> Column:
        entries = brand_entries(own)
        hits = F.filter(F.transform(entries, lambda e: graded(e, x)), lambda g: g["grade"].isNotNull())
        top = F.array_min(F.transform(hits, lambda g, i: F.struct(g["grade"].alias("grade"), i.alias("ord"), g["brand"].alias("brand"), g["own"].alias("own"))))
        known = F.exists(entries, lambda e: F.array_contains(e["domains"], x["org"]))

        def told(t: Column) -> Column:
            kind = F.element_at(literals(["confusable", "tld-swap", "typosquat", "contains"]), t["grade"])
            return F.when(t.isNotNull(), F.struct(t["brand"].alias("brand"), kind.alias("kind"), t["own"].alias("own")))

        return F.when((x["bare"] != "") & ~known, let(top, told))

    def shaped(x: Column) -> Column:
        name = F.substring_index(x["org"], ".", 1)
        flat = skeleton(F.regexp_replace(x["bare"], r"\.[a-z.]+\z", ""))
        words = F.transform(F.split(x["bare"], r"[.\-_]"), skeleton)
        formed = F.struct(x["bare"].alias("bare"), x["org"].alias("org"), name.alias("name"), skeleton(name).alias("shape"), flat.alias("flat"), words.alias("words"))
        return let(formed, lambda y: let(y.withField("length", F.length(y["shape"])), best))

    bare = F.regexp_replace(F.lower(host), r"\Awww\.", "")
    return F.when(host.isNotNull(), let(bare, lambda b: let(F.struct(b.alias("bare"), F.coalesce(org_domain(b), b).alias("org")), shaped)))
