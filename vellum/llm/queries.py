"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, fingerprints, html_text, jaccard, licenses, merkle, packing, pii, quality, rans, scratch, suffixes, token_counts, word_shuffle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of the shortest repeated passage that op1 counts, beside the 400-byte strings that it removes.
PASSAGE_WORDS = 51


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), passages=PASSAGE_WORDS)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=2048, end_id=0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch.fresh(spark, "token-files")
    rans.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out, end_id=2)
    scratch.release(spark)
    return rans.read(spark, out)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_shuffle.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_jaccard_join, op3_html_text, op4_best_fit_packing, op5_quality_rules, op6_token_counts, op7_license_scan, op8_fingerprints, op9_token_files, op10_byte_bpe, op11_pii_spans, op12_collocations, op13_merkle_manifest)}

def _merkle_sql() -> str:
    """Levels by a recursive query, siblings by number, folding by a list reduction; CRC-32 bit by bit."""
    field = "coalesce(strlen({0}) || ':' || {0}, '-')"
    of = lambda n: " || ".join(field.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", n, "text"))
    step = "CASE WHEN x[1] = 'L' THEN sha256(x[2:] || a) WHEN x[1] = 'R' THEN sha256(a || x[2:]) ELSE sha256(a) END"
    sides = "list(CASE WHEN t.h IS NULL THEN 'N' WHEN t.i < b.i >> l.k THEN 'L' || t.h ELSE 'R' || t.h END ORDER BY l.k)"
    levels = lambda base, out: f"{out}(k, g, i, n, h) AS (SELECT 0, g, i, n, h FROM {base} UNION ALL SELECT any_value(k) + 1, g, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {out} WHERE n > 1 GROUP BY g, i // 2)"
    ways = lambda base, tree, out: f"{out} AS (SELECT b.r, {sides} AS s FROM {base} b JOIN (SELECT DISTINCT g, k FROM {tree} WHERE n > 1) l ON l.g = b.g LEFT JOIN {tree} t ON t.g = b.g AND t.k = l.k AND t.i = xor(b.i >> l.k, 1) GROUP BY b.r)"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, sha256({of("n_chars")}) AS h, sha256({of("(n_chars + 1)")}) AS c,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * strlen(CAST(doc_id AS VARCHAR))), lambda j: j)), lambda a, j: xor(CASE WHEN j % 8 = 0 THEN xor(a, ascii(CAST(doc_id AS VARCHAR)[j // 8 + 1])) ELSE a END >> 1, CASE WHEN CASE WHEN j % 8 = 0 THEN xor(a, ascii(CAST(doc_id AS VARCHAR)[j // 8 + 1])) ELSE a END % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS crc FROM documents),
 b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
 {levels("b", "t")}, {ways("b", "t", "w")},
 u AS (SELECT g AS r, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM t WHERE n = 1),
 {levels("u", "v")}, {ways("u", "v", "x")},
 z AS (SELECT b.*, u.h AS subroot, (SELECT h FROM v WHERE n = 1) AS root, list_concat(coalesce(w.s, []), coalesce(x.s, [])) AS s FROM b JOIN u ON u.r = b.g LEFT JOIN w ON w.r = b.r LEFT JOIN x ON x.r = b.g),
 y AS (SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(s, lambda q: q[2:]), '')) AS proof_sha256,
  list_reduce(list_prepend(CASE WHEN n_claim THEN coalesce(c, h) ELSE h END, s), lambda a, x: {step}) AS folded_root FROM (SELECT *, xor(crc, 4294967295::BIGINT) % 7 = 0 AS n_claim FROM z))
 SELECT *, folded_root = root AS verified FROM y"""


#: Exact sets, all pairs and reachability; the other operators' results can't be expressed in SQL and are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS i FROM d)),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
 u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach),
 c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
 SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
    "op12_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
 w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
 g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS s, count(*) AS f FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS k(m)) GROUP BY ALL),
 n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY 1),
 c AS (SELECT lang, m, s, f AS a, string_split(s, ' ') AS w FROM g WHERE m >= 2 AND f >= 10),
 x AS (SELECT lang, m, s, a, k, array_to_string(w[1:k], ' ') AS ls, array_to_string(w[k + 1:], ' ') AS rs FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
 y AS (SELECT x.lang, x.s, x.m, x.a, l.f AS l, r.f AS r, x.k, CAST(1000000 AS HUGEINT) * x.a * x.a // (CAST(l.f AS HUGEINT) * r.f) AS score FROM x JOIN g l ON l.lang = x.lang AND l.s = x.ls AND l.m = x.k JOIN g r ON r.lang = x.lang AND r.s = x.rs AND r.m = x.m - x.k),
 z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1),
 b AS (SELECT DISTINCT t.lang, array_to_string(t.w[i:i + 1], ' ') AS s, t.a FROM c t, (VALUES (1), (2)) AS v(i) WHERE t.m = 3),
 d AS (SELECT lang, s, max(a) AS a FROM b GROUP BY ALL),
 q AS (SELECT z.* FROM z LEFT JOIN d ON z.m = 2 AND d.lang = z.lang AND d.s = z.s WHERE d.a IS NULL OR 100 * d.a < 50 * z.a)
 SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q JOIN n ON n.lang = q.lang QUALIFY rank <= 2000""",
    "op13_merkle_manifest": _merkle_sql(),
}
