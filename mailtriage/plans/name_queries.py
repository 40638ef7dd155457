"""Queries over names: of files, reports, domains, passwords and hidden controls, all derived from the
documents by their ids and texts, so that the results can be said again in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..session import table
from .intake_queries import pick, text_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


@query("""
    select doc_id, doc_id || list_extract(['.pdf', '_b_c.EXE.bin', '.js.bin', 'noending.bin'], (doc_id % 4 + 1)::int) as safe, doc_id % 4 in (1, 2) as executable,
        'phishing-report_2024-01-15_groe-12-file-no' || doc_id || '.csv' as report from documents""")
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to store files under, whether their endings run, and the name of each one's report."""
    n = F.col("doc_id")
    name = text_of(" ..", n, pick(n, ".pdf", "/b:c.EXE", ".js. ", "noending"))
    safe = names.safe_filename(name, raw=True)
    report = names.report_filename(text_of("Größe: ½ ﬁle № ", n), F.lit("2024-01-15").cast("date"), "csv")
    report = F.replace(report, F.lit("no-"), F.lit("no"))
    return table(spark, sf_dir, "documents").select("doc_id", safe.alias("safe"), names.executable_name(F.rtrim(F.regexp_replace(name, r"[. ]+\z", ""))).alias("executable"), report.alias("report"))


@query("""
    with t as (select doc_id, doc_id % 86400 as s from documents)
    select doc_id, (s // 3600) * 2048 + (s // 60 % 60) * 32 + s % 60 // 2 as time, 44 * 512 + 1 * 32 + 15 as day, s - s % 2 as seconds from t""")
def archive_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time of day for each document as archives store it, and the second that is read back."""
    s = F.pmod("doc_id", F.lit(86_400))
    at = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(15), F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), (s % 60).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", names.dos_time(at).alias("d"))
    rows = rows.select("doc_id", "d.*", names.from_dos_time(F.col("d.time"), F.col("d.day")).alias("back"))
    seconds = F.hour("back") * 3600 + F.minute("back") * 60 + F.second("back")
    return rows.select("doc_id", F.col("time").cast("long").alias("time"), F.col("day").cast("long").alias("day"), seconds.cast("long").alias("seconds"))


@query("""
    select doc_id, 'd' || doc_id || '.example.com,corp' || doc_id || '.net' as valid, case when doc_id % 2 = 0 then 'not a domain,localhost' else 'localhost' end as invalid,
        case when doc_id % 4 = 3 then '' else 'Key' || doc_id end as passwords from documents""")
def lists_and_passwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains and other entries of a hand-written list, and the password that a note names."""
    n = F.col("doc_id")
    listed = text_of("Www.D", n, ".example.com, https://u@corp", n, ".net/p; ", pick(n, "not a domain", "corp"), F.when(n % 2 == 0, "").otherwise(text_of(n, ".net")), "\nlocalhost")
    note = text_of("see below. ", pick(n, "The password is: ", "Kennwort: ", "mot de passe = ", "no secret "), "Key", n, ".")
    rows = table(spark, sf_dir, "documents").select("doc_id", names.domain_list(listed).alias("l"), names.said_passwords(note).alias("p"))
    return rows.select("doc_id", F.array_join("l.valid", ",").alias("valid"), F.array_join("l.invalid", ",").alias("invalid"), F.array_join("p", ",").alias("passwords"))


def _revealed_sql(text: str) -> str:
    for code, name in names.CONTROLS.items():
        text = f"replace({text}, chr({code}), '[U+{code:04X} {name}]')"
    return text


@query(f"""
    select doc_id, sha256({_revealed_sql("coalesce(text, '') || chr(8238) || 'fdp.exe' || chr(8297)")}) as revealed_sha256,
        octet_length(encode({_revealed_sql("coalesce(text, '') || chr(8238) || 'fdp.exe' || chr(8297)")})) as n_bytes from documents""")
def revealed_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, with a reversed file name behind it, with its direction controls written out."""
    text = names.revealed(text_of(F.coalesce(F.col("text"), F.lit("")), "‮fdp.exe⁩"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("revealed_sha256"), F.octet_length(text).cast("long").alias("n_bytes"))
