"""Registration data: which server answers for a target, and what its answer says.

Nothing is fetched here. The bootstrap lists (RFC 9224) and the answers are tables; a provider asks what
questions() lists and stores the answers. The server of a domain is that of its longest listed suffix, of
an address that of the longest listed prefix: each target's ladder of suffixes or prefixes is spelled out
and meets the list in an equi-join, so a list of any size needs no broadcast and no range join. Addresses
are compared as 128-bit values, so every spelling of one address finds the same prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net

_SERVICES = "struct<services:array<array<array<string>>>>"

_ENTITY = "roles:array<string>,vcardArray:array<string>"
#: Of RDAP's JSON what is read; vCards stay JSON text until a field is asked for.
_RDAP = (
    "struct<ldhName:string,handle:string,name:string,country:string,type:string,startAddress:string,endAddress:string,status:array<string>,"
    "events:array<struct<eventAction:string,eventDate:string>>,nameservers:array<struct<ldhName:string>>,"
    f"entities:array<struct<{_ENTITY},entities:array<struct<{_ENTITY}>>>>>"
)


def services(bootstrap: DataFrame) -> DataFrame:
    """bootstrap (body: the JSON of a bootstrap list) to (kind, suffix, hi, lo, length, server): a row for
    each listed suffix or prefix. Entries that are neither a label nor a prefix are left out; of two
    servers for one entry the first in order of their names counts."""
    listed = bootstrap.select(F.explode(F.from_json("body", _SERVICES)["services"]).alias("s"))
    rows = listed.select(F.explode(F.col("s")[0]).alias("entry"), F.regexp_replace(F.try_element_at(F.col("s")[1], F.lit(1)), "/+$", "").alias("server")).where("server is not null")
    address = F.substring_index("entry", "/", 1)
    size = F.regexp_extract("entry", r"/([0-9]{1,3})\z", 1).try_cast("int")
    rows = rows.withColumn("value", net.ip_value(address)).withColumn("length", F.when(F.col("value").isNotNull(), size + F.when(address.contains(":"), 0).otherwise(96)))
    prefix = (F.col("length") >= 0) & (F.col("length") <= 128)
    domain = F.col("value").isNull() & F.lower("entry").rlike(r"\A[a-z0-9-]+(\.[a-z0-9-]+)*\z")
    suffix = F.when(domain, F.lower("entry"))
    masked = net.ip_masked(F.col("value"), F.col("length"))
    known = rows.where(prefix | domain).select(F.when(prefix, "ip").otherwise("domain").alias("kind"), suffix.alias("suffix"), masked["hi"].alias("hi"), masked["lo"].alias("lo"), F.when(prefix, F.col("length")).alias("length"), "server")
    return known.groupBy("kind", "suffix", "hi", "lo", "length").agg(F.min("server").alias("server"))


def server_of(targets: DataFrame, listed: DataFrame) -> DataFrame:
    """targets (kind, value) to (kind, value, server, matched): each distinct target with the server of
    its longest listed suffix or prefix; null where none is listed. matched is the suffix, or the number
    of bits. Targets that are neither a domain nor an address have no server."""
    asked = targets.select("kind", F.lower(F.trim("value")).alias("value")).distinct()
    labels = F.split(F.regexp_replace("value", r"\.\z", ""), r"\.")
    ladder = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("step"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("suffix")))
    names = asked.where("kind = 'domain'").select("kind", "value", F.explode(ladder).alias("l")).select("kind", "value", "l.step", "l.suffix")
    by_name = names.join(listed.where("kind = 'domain'").select("suffix", "server"), "suffix").groupBy("kind", "value").agg(F.min_by(F.struct("server", F.col("suffix").alias("matched")), "step").alias("found"))

    # Only lengths that are listed are spelled out: 129 at most, a row of their own for the join.
    prefixes = listed.where("kind = 'ip'")
    lengths = prefixes.groupBy("kind").agg(F.collect_set("length").alias("lengths"))
    addresses = asked.where("kind = 'ip'").withColumn("ip", net.ip_value(F.col("value"))).where("ip is not null").join(lengths, "kind")
    steps = addresses.select("kind", "value", "ip", F.explode("lengths").alias("length")).withColumn("m", net.ip_masked(F.col("ip"), F.col("length")))
    steps = steps.select("kind", "value", "length", F.col("m.hi").alias("hi"), F.col("m.lo").alias("lo"))
    by_address = steps.join(prefixes.select("hi", "lo", "length", "server"), ["hi", "lo", "length"]).groupBy("kind", "value").agg(F.max_by(F.struct("server", F.col("length").cast("string").alias("matched")), "length").alias("found"))

    return asked.join(by_name.unionByName(by_address), ["kind", "value"], "left").select("kind", "value", "found.server", "found.matched")


def question(kind: Column, value: Column, server: Column) -> Column:
    """The address to ask, or null."""
    return F.when(server.isNotNull(), F.concat(server, F.when(kind == "ip", "/ip/").otherwise("/domain/"), F.url_encode(value)))


def questions(targets: DataFrame, listed: DataFrame, answers: DataFrame) -> DataFrame:
    """(kind, value, url) still to be asked: distinct targets with a server, without a good answer in
    answers (kind, value, ok). Failed ones are asked again."""
    known = answers.where("ok").select("kind", F.lower("value").alias("value")).distinct()
    found = server_of(targets, listed).withColumn("url", question(F.col("kind"), F.col("value"), F.col("server"))).where("url is not null")
    return found.join(known, ["kind", "value"], "left_anti").select("kind", "value", "url")


def _contact(entity: Column) -> Column:
    """struct(roles, name, org, email, country) of an RDAP entity."""
    card = F.coalesce(F.from_json(F.try_element_at(entity["vcardArray"], F.lit(2)), "array<array<string>>"), F.array().cast("array<array<string>>"))

    def of(fields: Column) -> Column:
        def text(name: str) -> Column:
            # A value that is JSON itself (a list) is no text.
            value = F.try_element_at(F.try_element_at(F.filter(fields, lambda f: f[0] == name), F.lit(1)), F.lit(4))
            return F.when(~value.rlike(r"\A[\[{]"), F.nullif(value, F.lit("")))

        address = F.try_element_at(F.try_element_at(F.filter(fields, lambda f: f[0] == "adr"), F.lit(1)), F.lit(4))
        country = F.nullif(F.try_element_at(F.from_json(address, "array<string>"), F.lit(7)), F.lit(""))
        roles = F.coalesce(entity["roles"], F.array().cast("array<string>"))
        return F.struct(roles.alias("roles"), text("fn").alias("name"), text("org").alias("org"), text("email").alias("email"), country.alias("country"))

    return net.let(card, of)


def registration(body: Column) -> Column:
    """What an RDAP answer says: struct(target, registrar, registrant, country, registered, updated,
    expires, statuses, nameservers, abuse_email, range, network, type). Null if it is no JSON object."""

    def read(d: Column) -> Column:
        none = F.array().cast("array<struct<roles:array<string>,name:string,org:string,email:string,country:string>>")
        contacts = F.coalesce(F.transform(d["entities"], _contact), none)
        inner = F.coalesce(F.flatten(F.transform(d["entities"], lambda e: F.coalesce(F.transform(e["entities"], _contact), none))), none)

        def summary(c: Column) -> Column:
            def in_role(role: str) -> Column:
                return F.try_element_at(F.filter(c["outer"], lambda e: F.array_contains(e["roles"], role)), F.lit(1))

            def date(*actions: str) -> Column:
                return F.coalesce(*[F.try_element_at(F.filter(d["events"], lambda e: e["eventAction"] == a), F.lit(1))["eventDate"] for a in actions])

            holder, first = in_role("registrant"), F.try_element_at(c["outer"], F.lit(1))
            abuse = F.filter(F.concat(F.filter(c["outer"], lambda e: F.array_contains(e["roles"], "abuse")), c["inner"]), lambda e: F.array_contains(e["roles"], "abuse") | e["email"].isNotNull())
            network = d["startAddress"].isNotNull()
            return F.struct(
                F.coalesce(d["ldhName"], d["handle"]).alias("target"), F.coalesce(in_role("registrar")["name"], in_role("registrar")["org"]).alias("registrar"),
                F.coalesce(holder["org"], holder["name"], F.when(network, F.coalesce(first["org"], first["name"]))).alias("registrant"), F.coalesce(F.when(network, d["country"]), holder["country"]).alias("country"),
                date("registration").alias("registered"), date("last changed", "last update of RDAP database").alias("updated"), date("expiration").alias("expires"), F.coalesce(d["status"], F.array().cast("array<string>")).alias("statuses"),
                F.filter(F.coalesce(F.transform(d["nameservers"], lambda n: n["ldhName"]), F.array().cast("array<string>")), lambda n: n != "").alias("nameservers"), F.try_element_at(abuse, F.lit(1))["email"].alias("abuse_email"),
                F.when(network & d["endAddress"].isNotNull(), F.concat(d["startAddress"], F.lit(" – "), d["endAddress"])).alias("range"), d["name"].alias("network"), d["type"].alias("type"),
            )

        return net.let(F.struct(contacts.alias("outer"), inner.alias("inner")), summary)

    # An object without any known field is an answer that says nothing.
    return F.when(F.trim(body).rlike(r"(?s)\A\{.*\}\z"), net.let(F.from_json(body, _RDAP), read))


def registrations(answers: DataFrame) -> DataFrame:
    """answers (kind, value, ok, body) with one column `registration`; failed answers have none."""
    return answers.withColumn("registration", F.when(F.col("ok"), registration(F.col("body"))))


def enriched(targets: DataFrame, answers: DataFrame) -> DataFrame:
    """targets (kind, value, ...) with the registration of their good answer, or null. Equal targets share
    one answer; of several good answers for one target the least body counts, so reruns agree."""
    best = answers.where("ok").groupBy("kind", F.lower("value").alias("a_value")).agg(F.min("body").alias("body")).withColumnRenamed("kind", "a_kind")
    read = best.select("a_kind", "a_value", registration(F.col("body")).alias("registration"))
    return targets.join(read, (F.col("kind") == F.col("a_kind")) & (F.lower(F.trim("value")) == F.col("a_value")), "left").drop("a_kind", "a_value")
