"""Registration of queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: SQL of the rendered document notes, as a CTE named notes.
NOTES = r"""notes AS (SELECT d.doc_id, 'docs/'||source||'/'||lang||'/'||d.doc_id||'.md' AS path, 'Document '||d.doc_id AS title, lang, source, n_chars, quality, toxic, text AS body
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
#: SQL of the windows of document notes, as a CTE named chunks.
CHUNKS = (
    NOTES
    + r""", chunks AS (SELECT doc_id, path, title, lang, source, CAST((s - 1) / 2720 AS INT) AS ord, CASE WHEN length(body) <= 3200 THEN body ELSE substring(body, s, 3200) END AS body
 FROM (SELECT *, unnest(CASE WHEN length(body) <= 3200 THEN [1] ELSE generate_series(1, greatest(length(body) - 480 - 1, 0) + 1, 2720) END) AS s FROM notes))"""
)
#: SQL of conversation notes, as a CTE named talks.
TALKS = r"""talks AS (SELECT 'talk/'||conv_id||'.md' AS path, 'Talk '||conv_id AS title, string_agg('## '||role||chr(10)||coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)"""
#: SQL of entity notes, as a CTE named entities.
ENTITIES = r"""entities AS (
 SELECT 'region/region-'||r_regionkey||'.md' AS path, r_name AS title, '# '||r_name AS body FROM region
 UNION ALL SELECT 'nation/nation-'||n_nationkey||'.md', n_name, '# '||n_name||chr(10)||'See [[region-'||n_regionkey||']].' FROM nation
 UNION ALL SELECT 'supplier/supplier-'||s_suppkey||'.md', s_name, '# '||s_name||chr(10)||'In [the nation](../nation/nation-'||s_nationkey||'.md).' FROM supplier
 UNION ALL SELECT 'customer/customer-'||c_custkey||'.md', c_name, '# '||c_name||chr(10)||'See [[nation-'||c_nationkey||']].'||CASE WHEN c_custkey % 7 = 0 THEN chr(10)||'Also [[order-'||c_custkey||'|Last order]].' ELSE '' END FROM customer)"""
BLANK = r"[\s\x0B\x{0085}\p{Z}]"


def terms(x: str) -> str:
    """SQL of the search terms of a text."""
    return rf"list_filter(string_split_regex(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{BLANK}+', ' ', 'g'))"


def bm25(source: str, columns: dict[str, float], query: list[str], keys: str) -> str:
    """SQL of BM25 over a relation: a SELECT of keys and score."""
    distinct = list(dict.fromkeys(query))
    tok = ", ".join(f"{terms(f'coalesce({c}, {chr(39)}{chr(39)})')} AS t_{i}" for i, c in enumerate(columns))
    tf = lambda t: " + ".join(f"{w} * len(list_filter(t_{i}, lambda x: x = '{t}'))" for i, w in enumerate(columns.values()))
    length = " + ".join(f"len(t_{i})" for i in range(len(columns)))
    tfs = ", ".join(f"{tf(t)} AS tf{j}" for j, t in enumerate(distinct))
    dfs = ", ".join(f"count(*) FILTER (tf{j} > 0) AS df{j}" for j in range(len(distinct)))
    part = " + ".join(f"{query.count(t)} * greatest(ln((n - df{j} + 0.5) / (df{j} + 0.5)), 1e-6) * tf{j} * 2.2 / (tf{j} + 1.2 * (0.25 + 0.75 * len / mean))" for j, t in enumerate(distinct))
    some = " OR ".join(f"tf{j} > 0" for j in range(len(distinct)))
    return f"(WITH a AS (SELECT {keys}, {tok} FROM {source}), b AS (SELECT {keys}, {length} AS len, {tfs} FROM a), s AS (SELECT count(*) AS n, avg(len) AS mean, {dfs} FROM b) SELECT {keys}, CAST({part} AS DOUBLE) AS score FROM b, s WHERE {some})"


def cosine(a: str, b: str) -> str:
    """SQL of the similarity of two float lists of equal length."""
    d = lambda x, y: f"list_sum(list_transform(generate_series(1, len({x})), lambda i: CAST({x}[i] AS DOUBLE) * CAST({y}[i] AS DOUBLE)))"
    return f"({d(a, b)} / (sqrt({d(a, a)}) * sqrt({d(b, b)})))"
