"""The operators as registered queries: each runs over its whole table with production parameters."""

from __future__ import annotations

import importlib

#: Module and function of each query.
_WHERE = {
    "op1_html_extraction": "html_extract",
    "op3_sharding": "shards",
    "op4_chat_formatting": "chat",
    "op5_ngram_jaccard": "ngram_join",
    "op6_quality_classifier": "quality_zstd",
    "op7_decontamination": "decontaminate",
    "op8_quality_rules": "quality_rules",
    "op9_license_scan": "licenses",
    "op10_pii": "pii",
    "op2_sentencepiece": "sp_wfst",
}


def quality_base(spark, sf_dir):
    """The base columns of op8's result, which SQL can tell."""
    from . import quality_rules

    return quality_rules.query(spark, sf_dir).select("doc_id", *quality_rules.BASE, "base_failed")


def pii_base(spark, sf_dir):
    """The base counts of op10's result, which SQL can tell."""
    from . import pii

    return pii.query(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.BASE])


QUALITY_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, count(*) - count(DISTINCT s) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 7], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM t) GROUP BY 1),
b AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
"""
PII_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS e,
 regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS i, list_transform(regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c, list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS p FROM d)
SELECT doc_id, len(e) AS n_email, len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda q: TRY_CAST(q AS DOUBLE) > 255)) = 0)) AS n_ip,
 len(list_filter(c, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(x)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(substr(x, length(x) - CAST(k AS INT), 1) AS INT) ELSE 2 * CAST(substr(x, length(x) - CAST(k AS INT), 1) AS INT) - CASE WHEN CAST(substr(x, length(x) - CAST(k AS INT), 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
 len(list_filter(p, lambda x: x BETWEEN 9 AND 15)) AS n_phone FROM f
"""


def queries() -> dict:
    out = {"quality_base": quality_base, "pii_base": pii_base}
    for name, module in _WHERE.items():
        out[name] = importlib.import_module(f"evigraph.llm.{module}").query
    return out


def oracle_sql() -> dict[str, str]:
    out = {"quality_base": QUALITY_BASE_SQL, "pii_base": PII_BASE_SQL}
    for name, module in _WHERE.items():
        sql = getattr(importlib.import_module(f"evigraph.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
