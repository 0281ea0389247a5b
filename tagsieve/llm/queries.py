"""Queries of the text corpus operators over the whole test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve.llm import confusables, encode, format_copies, leaks, sentences, term_counts
from tagsieve.plans.runtime import table

#: Names of the fields that texts of named fields may have.
FIELD_NAMES = ["item", "place", "topic", "channel", "remark", "replaces", "count"]
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _copies(spark: SparkSession, sf_dir: str) -> format_copies.FormatCopies:
    return format_copies.FormatCopies(table(spark, sf_dir, "instances"), FIELD_NAMES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).pairs()


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).records()


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of both tables in its consistent form, with what the original held."""
    parts = [
        confusables.consistent_forms(table(spark, sf_dir, tab).withColumnRenamed(row_id, "rec_id"), "rec_id", text).withColumn("tab", F.lit(tab))
        for tab, row_id, text in (("instances", "id", "text"), ("spans", "span_id", "surface_form"))
    ]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_forms(spark, sf_dir).where(" or ".join(confusables.FLAGS)).select("tab", "rec_id")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "tokens")
    counts = term_counts.term_counts(tokens, {"token": F.lower("token"), "noisy": F.col("noisy")}, "sent_id")
    return term_counts.mark_terms(counts, tokens, "sent_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_terms(spark, sf_dir).where("mark <> 'useful'").select("field", "term")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a passage of an item, altered ones included."""
    return leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_passages(spark, sf_dir).where("exact").select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
    "p8_found": p8_found,
}

_NAME = "(?:" + "|".join(FIELD_NAMES) + ")"
_SIGN = rf'(?:\[\s*{_NAME}\s*\]|"\s*{_NAME}\s*"\s*:|{_NAME}\s*[:=]|{_NAME}\s+-\s)'
_START = rf"(?i)(?:^[^\pL\pN]*){_SIGN}"
_MARKER = rf"(?i)(?:^[^\pL\pN]*|[|,;\n{{]\s*){_SIGN}"
_LETTERS = r"regexp_replace(lower({}), '[^\pL\pM\pN]+', '', 'g')"
_SETS = f"""
with marked as (
    select id, text, noisy, regexp_extract_all(text, '{_MARKER}') as marks, string_split_regex(text, '{_MARKER}')[2:] as vals
    from instances where text is not null
), keyed as (
    select id, coalesce('+' || {_LETTERS.format("noisy")}, '-') as label,
        case when regexp_matches(text, '{_START}') and len(marks) > 1
        then chr(1) || array_to_string(list_sort(list_transform(list_zip(marks, vals),
            lambda x: {_LETTERS.format("x[1]")} || '=' || {_LETTERS.format("x[2]")})), chr(2))
        else {_LETTERS.format("text")} end as own
    from marked
), sets as (select id, min(id) over (partition by own, label) as keep_id from keyed)"""

_TERMS = """
with rows_of as (
    select 'token' as field, lower(token) as term, sent_id from tokens where token is not null
    union all select 'noisy', noisy, sent_id from tokens where noisy is not null
), counts as (
    select field, term, count(*) as occurrences, count(distinct sent_id) as records from rows_of group by 1, 2
), marked as (
    select *, case when records < 3 then 'rare'
        when records > 0.5 * (select count(distinct sent_id) from tokens) then 'common' else 'useful' end as mark
    from counts
)"""

ORACLES = {
    "p1_found": _SETS + " select keep_id, id as copy_id from sets where id > keep_id",
    "p1_records": _SETS
    + """ select keep_id, count(*) as copies from sets group by 1
union all select id, 1 from instances where text is null""",
    "p4_found": _TERMS + " select field, term from marked where mark <> 'useful'",
    "p4_terms": _TERMS + " select field, term, occurrences, records, mark from marked",
}
