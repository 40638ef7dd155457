"""The queries of this package: thin opN_<name> functions over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunk_dedup, conversation_repair, decontamination, divergence, exact_dedup, jaccard_join, language_id, mixing, quality, secrets, suffix_dedup, tokens
from .common import ascii_lower, text_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    rows = found.select("doc_id", count("assign"), count("access"), count("hex"), secrets.joined(F.col("secrets")).alias("spans"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.deduplicate(_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.training_order(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"), 3, 90, 100)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(ascii_lower(text_of()), 256).alias("text_sha256"))
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.compare(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(_table(spark, sf_dir, "conversations")), lost="lost", with_text=False)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_chunk_dedup": op4_chunk_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_chat_format": op7_chat_format,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_repair": op13_conversation_repair,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(value: str) -> str:
    return f"replace(replace({value}, '<\\', '<\\\\'), '<|', '<\\|')"


_CHAT = f"""
    with t as (select conv_id, turn, coalesce(role, 'unknown') as speaker, {_quoted("coalesce(text, '')")} as body,
                      {_quoted("regexp_replace(coalesce(role, 'unknown'), '[|' || chr(10) || ']', ' ', 'g')")} as name from conversations),
         p as (select distinct conv_id as of_conv, speaker as assistant from t where speaker <> 'system'),
         s as (select conv_id, assistant, turn, speaker, body,
                      case when speaker = 'system' then '<|system|>' when speaker = assistant then '<|assistant|>' else '<|user name=' || name || '|>' end || chr(10) as head
               from t join p on conv_id is not distinct from of_conv),
         g as (select *, head || body || '<|end|>' || chr(10) as segment from s),
         w as (select *, coalesce(sum(length(segment)) over (partition by conv_id, assistant order by turn nulls first, speaker, segment rows between unbounded preceding and 1 preceding), 0)::bigint as start from g)
    select conv_id, assistant, turn, speaker, segment, start, start + length(segment) as "end",
        case when speaker = assistant then start + length(head) end as learn_from, case when speaker = assistant then start + length(segment) end as learn_to
    from w"""

_JACCARD = f"""
    with recursive w as (select doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') as words from documents),
         s as (select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
                      else list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) end as shingles from w),
         n as (select doc_id, len(shingles) as n_shingles from s),
         u as (select doc_id, unnest(shingles) as shingle from s),
         pairs as (select x.doc_id as a, y.doc_id as b, count(*) as c from u x join u y on x.shingle = y.shingle and x.doc_id < y.doc_id group by 1, 2),
         links as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n_shingles + nb.n_shingles - c)),
         both_ways as (select a, b from links union all select b, a from links),
         reach as (select doc_id, doc_id as other from n union select reach.doc_id, b from reach join both_ways on other = a)
    select n.doc_id, n_shingles, min(other) as component_id from n join reach using (doc_id) group by 1, 2"""


def _spans(number: int, pattern: str, group: int, least: int) -> str:
    """A list of (start, rule, end): running sums over the pieces between matches and the matches."""
    p = pattern.replace("'", "''")
    pieces, found, values = f"string_split_regex(t, '{p}')", f"regexp_extract_all(t, '{p}')", f"regexp_extract_all(t, '{p}', {group})"
    before = f"(list_sum(list_transform({pieces}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: length(x))), 0))::bigint"
    all_of = f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': {before}, 'n': {number}, 'e': {before} + length({found}[i]), 'v': length({values}[i])}})"
    return f"list_filter({all_of}, lambda x: x.v >= {least})"


def _secrets() -> str:
    parts = [_spans(n, r.pattern, r.group, r.least) for n, r in enumerate(secrets.RULES)]
    names = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    return f"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
         a as (select doc_id, {parts[0]} as a0, {parts[1]} as a1, {parts[2]} as a2 from d),
         j as (select doc_id, len(a0) as n_assign, len(a1) as n_access, len(a2) as n_hex,
                      coalesce(array_to_string(list_transform(list_sort(list_concat(a0, a1, a2)), lambda x: {names}[x.n + 1] || ':' || x.s || ':' || x.e), ','), '') as spans from a)
    select doc_id, n_assign, n_access, n_hex, sha256(spans) as base_sha256, spans from j"""


_DIVERGENCE = """
    with w as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words from documents),
         t as (select row, lang, source, unnest(words) as term from w),
         kept as (select lang, term from t group by 1, 2 having count(distinct row) >= 3),
         c as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by 1, 2, 3),
         g as (select lang, source, coalesce(sum(n), 0) as total from (select distinct lang, source from w) left join c using (lang, source) group by 1, 2),
         v as (select lang, count(*) as terms from kept group by 1),
         p as (select lang, source, term, coalesce(n, 0) as n, 1 + 1000000000 * (coalesce(n, 0)::hugeint + 1) // (total + terms) as p
               from g join v using (lang) join kept using (lang) left join c using (lang, source, term)),
         q as (select lang, term, 1 + 1000000000 * (sum(n)::hugeint + 1) // (any_value(total) + any_value(terms)) as q
               from p join (select lang, sum(total) as total from g group by 1) using (lang) join v using (lang) group by 1, 2),
         pairs as (select a.lang, a.source, 'pair' as part, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
                   from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3, 4),
         every as (select a.lang, a.source, 'pair' as part, b.source as item from g a join g b on a.lang = b.lang and a.source <> b.source),
         items as (select lang, source, part, item, coalesce(value, 0)::bigint as value from every left join pairs using (lang, source, part, item)
                   union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p join q using (lang, term) where n > 0 and p > q)
    select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
    from items qualify part = 'pair' or rank <= 200"""


ORACLE_SQL = {
    "op12_source_divergence": _DIVERGENCE,
    "op2_secret_scan": _secrets(),
    "op7_chat_format": _CHAT,
    "op9_jaccard_join": _JACCARD,
    "op10_exact_dedup": f"""
        with d as (select doc_id, sha256({_LOWERED}) as text_sha256 from documents),
             g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, text_sha256
        from d join g using (text_sha256)""",
}
