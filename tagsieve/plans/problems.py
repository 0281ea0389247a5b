"""Queries of the general data problems: heavy keys and rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve.operators import skew
from tagsieve.plans.runtime import table
from tagsieve.sources import tsv

#: Share of all rows of a table from which a key counts as heavy.
HEAVY_SHARE = 0.02


def _forms(spark: SparkSession, sf_dir: str, tab: str) -> DataFrame:
    column = {"spans": "surface_form", "tokens": "token"}[tab]
    return table(spark, sf_dir, tab).withColumn("form", F.lower(column))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        skew.heavy_keys(_forms(spark, sf_dir, tab), "form", HEAVY_SHARE).select(F.lit(tab).alias("tab"), "form")
        for tab in ("spans", "tokens")
    ]
    return found[0].unionByName(found[1])


def p3_span_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span with the majority label of its form and whether its own label differs."""
    spans = _forms(spark, sf_dir, "spans")
    rows = skew.majority_by_key(spans, "form", "noisy", "span_id", HEAVY_SHARE)
    return rows.select("span_id", "form", "majority", "n", (F.col("noisy") != F.col("majority")).alias("differs"))


def p3_token_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with the majority label of its form and whether its own label differs."""
    tokens = _forms(spark, sf_dir, "tokens").withColumn("tid", F.col("sent_id") * 100_000 + F.col("pos"))
    rows = skew.majority_by_key(tokens, "form", "noisy", "tid", HEAVY_SHARE)
    return rows.select("tid", "form", "majority", "n", (F.col("noisy") != F.col("majority")).alias("differs"))


def _label_results(rows: DataFrame) -> DataFrame:
    wrong = F.sum(F.when(F.col("noisy") != F.col("gold"), 1).otherwise(0)).alias("wrong")
    per_label = rows.groupBy("form", "noisy").agg(F.count("*").alias("n"), wrong)
    return per_label.groupBy("form").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"), F.count("noisy").alias("labels"))


def p3_key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per form of both tables: rows, rows whose label is wrong, distinct labels."""
    parts = []
    for tab in ("spans", "tokens"):
        per_form = skew.results_by_key(_forms(spark, sf_dir, tab).select("form", "noisy", "gold"), "form", _label_results, HEAVY_SHARE)
        parts.append(per_form.select(F.lit(tab).alias("tab"), "form", "n", "wrong", "labels"))
    return parts[0].unionByName(parts[1])


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.parse_records(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "label_set"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.failed_records(_parsed(spark, sf_dir)).select("line_id", "reason")


def p5_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.valid_records(_parsed(spark, sf_dir))


def p5_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the whole files of ``raw_lines``, parsed on from anchors after broken ones."""
    parsed = tsv.parse_lines_by_file(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "label_set"))
    return parsed.select("file_name", "begin_at", "texts", "gold", "noisy", "reason")


QUERIES = {
    "p3_found": p3_found,
    "p3_span_majority": p3_span_majority,
    "p3_token_majority": p3_token_majority,
    "p3_key_results": p3_key_results,
    "p5_found": p5_found,
    "p5_valid": p5_valid,
    "p5_recovered": p5_recovered,
}

#: One field of a record as a regular expression, and the record without its final carriage return.
_FIELD = r'("(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)'
_CUT = """
    select line_id, case when ends_with(line, chr(13)) then left(line, length(line) - 1) else line end as l
    from raw_lines"""
_READ = f"""
with cut as ({_CUT}), shaped as (
    select line_id, l,
        regexp_full_match(l, '{_FIELD}(\\t{_FIELD})*', 's') as quoted_well,
        regexp_full_match(l, '{_FIELD}\\t{_FIELD}\\t{_FIELD}', 's') as three,
        regexp_extract(l, '^{_FIELD}\\t{_FIELD}\\t{_FIELD}$', ['a', 'b', 'c'], 's') as f
    from cut
), plain as (
    select line_id, quoted_well, three,
        case when f.a[1] = '"' then replace(f.a[2:-2], '""', '"') else f.a end as texts,
        case when f.b[1] = '"' then replace(f.b[2:-2], '""', '"') else f.b end as gold,
        case when f.c[1] = '"' then replace(f.c[2:-2], '""', '"') else f.c end as noisy
    from shaped
), judged as (
    select line_id, texts, gold, noisy, case
        when quoted_well is null then 'columns'
        when not quoted_well then 'quoting'
        when not three then 'columns'
        when gold not in (select label from label_set) or noisy not in (select label from label_set)
            or regexp_full_match(texts, '[\\s\\p{{Z}}]*')
            or regexp_matches(texts, '[\\x{{FFFD}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]') then 'value'
        end as reason
    from plain
)"""

#: A field, and a record with its line break, at the begin of a text that goes on.
_OPEN_FIELD = r'(?:"(?:[^"]|"")*"|(?:[^"\t\n][^\t\n]*?)?)'
_ENDED = r"\r?(?:\n|\z)"
_TEXT = "case when {f}[1] = '\"' then replace({f}[2:-2], '\"\"', '\"') else {f} end"
_BAD = r"[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"


def _recovered_sql() -> str:
    """Records of each file from place to place: a whole record, or after a broken quotation line after line up to a valid one."""
    three = r"\t".join([f"({_OPEN_FIELD})"] * 3)
    place = "whole[spot + 1:]"
    fields = f"regexp_extract({place}, '\\A{three}{_ENDED}', ['a', 'b', 'c'], 's')"
    return f"""
with recursive whole_files as (
    select file_name, string_agg(coalesce(line, ''), chr(10) order by line_no) as whole from raw_lines group by 1
), steps as (
    select file_name, whole, 0::bigint as spot, false as lost, 0::bigint as step from whole_files where whole <> ''
    union all
    select file_name, whole, spot + case when record is null or lost and not valid then line_size else record end, lost and not valid or record is null, step + 1
    from (
        select *, {_valid_sql("f")} as valid from (
            select *, {fields} as f, regexp_matches({place}, '\\A{three}{_ENDED}', 's') as three,
                case when strpos({place}, chr(10)) = 0 then length(whole) - spot else strpos({place}, chr(10)) end as line_size,
                length(nullif(regexp_extract({place}, '\\A{_OPEN_FIELD}(?:\\t{_OPEN_FIELD})*{_ENDED}', 0, 's'), '')) as record
            from steps where spot < length(whole)))
), judged as (
    select file_name, spot, lost, record, three, f, {_valid_sql("f")} as valid from (
        select *, {fields} as f, regexp_matches({place}, '\\A{three}{_ENDED}', 's') as three,
            length(nullif(regexp_extract({place}, '\\A{_OPEN_FIELD}(?:\\t{_OPEN_FIELD})*{_ENDED}', 0, 's'), '')) as record
        from steps where spot < length(whole))
)
select file_name, spot as begin_at, case when valid then {_TEXT.format(f="f.a")} end as texts, case when valid then {_TEXT.format(f="f.b")} end as gold,
    case when valid then {_TEXT.format(f="f.c")} end as noisy, case when valid then null when record is null then 'quoting' when not three then 'columns' else 'value' end as reason
from judged where not lost or valid"""


def _valid_sql(f: str) -> str:
    text = _TEXT.format(f=f"{f}.a")
    labels = " and ".join(f"{_TEXT.format(f=f'{f}.{k}')} in (select label from label_set)" for k in "bc")
    return f"coalesce(three and {labels} and not regexp_full_match({text}, '[\\s\\p{{Z}}]*') and not regexp_matches({text}, '{_BAD}'), false)"


_HEAVY = """
select '{tab}' as tab, lower({col}) as form from {tab} where {col} is not null
group by 2 having count(*) >= 0.02 * (select count(*) from {tab})"""

_KEYS = """
select '{tab}' as tab, lower({col}) as form, count(*) as n,
    cast(sum(case when noisy <> gold then 1 else 0 end) as bigint) as wrong, count(distinct noisy) as labels
from {tab} where {col} is not null group by 2"""

ORACLES = {
    "p3_token_majority": """
with c as (
    select lower(token) as form, noisy, count(*) as c, min(sent_id * 100000 + pos) as first
    from tokens where token is not null and noisy is not null group by 1, 2
), best as (select form, arg_max(noisy, (c, -first)) as majority, cast(sum(c) as bigint) as n from c group by 1)
select sent_id * 100000 + pos as tid, lower(token) as form, majority, n, noisy <> majority as differs
from tokens left join best on lower(token) = form""",
    "p3_found": _HEAVY.format(tab="spans", col="surface_form") + " union all " + _HEAVY.format(tab="tokens", col="token"),
    "p3_span_majority": """
with c as (
    select lower(surface_form) as form, noisy, count(*) as c, min(span_id) as first
    from spans where surface_form is not null and noisy is not null group by 1, 2
), best as (select form, arg_max(noisy, (c, -first)) as majority, cast(sum(c) as bigint) as n from c group by 1)
select span_id, lower(surface_form) as form, majority, n, noisy <> majority as differs
from spans left join best on lower(surface_form) = form""",
    "p3_key_results": _KEYS.format(tab="spans", col="surface_form") + " union all " + _KEYS.format(tab="tokens", col="token"),
    "p5_found": _READ + " select line_id, reason from judged where reason is not null",
    "p5_recovered": _recovered_sql(),
    "p5_valid": _READ + " select line_id, texts, gold, noisy from judged where reason is null",
}
