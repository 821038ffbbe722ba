"""Queries over change feeds, governance, contradictions and federation (milestones 5 and 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import federation as FED
from vellum.operators import globs as GL
from vellum.operators import incremental as I
from vellum.operators import snapshots as SN
from vellum.operators import temporal as TP
from vellum.operators.graph import written
from vellum.sources import tables as T

from .base import NOTES, TALKS, query, terms

CURSOR = 9000
#: The feed that stands for a history: event_id is the commit, the user the path, the type the status (error: deleted).
FEED = """feed AS (SELECT event_id AS seq, CASE WHEN user_id % 3 = 0 THEN 'area'||(user_id % 5)||'/' ELSE '' END||'note-'||user_id||'.md' AS path, CASE WHEN event_type = 'error' THEN 'D' ELSE 'M' END AS status, user_id, event_type FROM events)"""


def feed(spark, d):
    user = F.col("user_id").cast("string")
    area = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("area"), (F.col("user_id") % 5).cast("string"), F.lit("/"))).otherwise("")
    return T.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(area, F.lit("note-"), user, F.lit(".md")).alias("path"), F.when(F.col("event_type") == "error", "D").otherwise("M").alias("status"), "user_id", "event_type")


def versions(spark, d):
    """Two snapshots of the notes: the old one lacks every seventh and has others' texts cut; the new one lacks every eleventh."""
    n = T.document_notes(spark, d)
    old = n.where("doc_id % 7 <> 0").select("path", X.content_hash(F.when(F.col("doc_id") % 5 == 0, F.substring("body", 1, 10)).otherwise(F.col("body"))).alias("content_hash"))
    return n.where("doc_id % 11 <> 0").select("path", X.content_hash(F.col("body")).alias("content_hash")), old


VERSIONS = f"{NOTES}, old AS (SELECT path, sha256(CASE WHEN doc_id % 5 = 0 THEN substring(body, 1, 10) ELSE body END) AS h FROM notes WHERE doc_id % 7 <> 0), new AS (SELECT path, sha256(body) AS h FROM notes WHERE doc_id % 11 <> 0)"


@query("incremental_diff", f"WITH {VERSIONS} SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM new n FULL JOIN old o ON n.path = o.path")
def incremental_diff(spark, d):
    return I.difference(*versions(spark, d))


@query("prune_deleted", f"WITH {VERSIONS} SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)")
def prune_deleted(spark, d):
    new, old = versions(spark, d)
    return I.pruned(old, new).select("path")


@query("upsert_catalog", f"WITH {VERSIONS} SELECT path, h AS content_hash FROM new")
def upsert_catalog(spark, d):
    new, old = versions(spark, d)
    diff = I.difference(new, old)
    fresh = new.join(diff.where("status in ('added', 'changed')").select("path"), "path")
    return I.upsert(old, fresh.select("path", "content_hash"), diff.where("status = 'deleted'")).select("path", "content_hash")


@query("vector_reuse", f"WITH {VERSIONS} SELECT n.path, EXISTS (SELECT 1 FROM old o WHERE o.h = n.h) AS reused FROM new n")
def vector_reuse(spark, d):
    new, old = versions(spark, d)
    stored = old.select(F.col("content_hash").alias("chunk_hash"), F.lit("m1").alias("model"), F.array(F.lit(1.0)).alias("vec"))
    return I.embed_plan(new.withColumnRenamed("content_hash", "chunk_hash"), stored, "m1").select("path", "reused")


@query("second_run_noop", "SELECT 'x' AS path, 'y' AS status WHERE false")
def second_run_noop(spark, d):
    new, _ = versions(spark, d)
    return I.difference(new, new).where("status <> 'unchanged'")


@query("digest_since_cursor", f"WITH {FEED}, p AS (SELECT path, max_by(status, seq) AS status FROM feed WHERE seq > {CURSOR} GROUP BY 1) SELECT CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '(root)' END AS area, count(*) AS n, count(*) FILTER (status = 'D') AS deleted, array_to_string(list_sort(list(path))[1:3], ',') AS first_paths FROM p GROUP BY 1")
def digest_since_cursor(spark, d):
    return TP.digest(TP.since(feed(spark, d), CURSOR))


@query("digest_by_area", f"WITH {FEED} SELECT CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '(root)' END AS area, count(DISTINCT path) AS n FROM feed GROUP BY 1")
def digest_by_area(spark, d):
    return TP.digest(TP.since(feed(spark, d), None)).select("area", "n")


#: Lines with cues, made of the conversations: the whole text after a fixed phrase for each turn.
LINES = r"""cued AS (SELECT 'talk/'||conv_id||'-'||turn||'.md' AS path, '# head todo'||chr(10)||CASE turn % 4 WHEN 0 THEN 'TODO check ' WHEN 1 THEN 'we decided on ' WHEN 2 THEN 'This is no longer ' ELSE '- [ ] ' END||regexp_replace(coalesce(text, ''), '[\n\r\s]+', ' ', 'g')||chr(10)||'plain words'||chr(10)||CASE WHEN turn % 4 = 1 THEN 'never mind the knot' ELSE 'I will go' END AS body FROM conversations)"""


def cued(spark, d):
    turn = F.col("turn") % 4
    lead = F.when(turn == 0, "TODO check ").when(turn == 1, "we decided on ").when(turn == 2, "This is no longer ").otherwise("- [ ] ")
    body = F.concat(F.lit("# head todo\n"), lead, F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r\s]+", " "), F.lit("\nplain words\n"), F.when(turn == 1, "never mind the knot").otherwise("I will go"))
    return T.table(spark, d, "conversations").select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".md")).alias("path"), body.alias("body"))


BODY_LINES = r"lines AS (SELECT path, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no, trim(unnest(string_split(body, chr(10)))) AS line FROM cued)"


@query("commitments", rf"WITH {LINES}, {BODY_LINES} SELECT path, CAST(line_no AS INT) AS line_no, line FROM lines WHERE line <> '' AND line NOT LIKE '#%' AND regexp_matches(line, '(?i)(\btodo\b|\bfixme\b|\bi''ll\b|\bi will\b|\bneed to\b|\[ \])')")
def commitments(spark, d):
    return TP.commitments(cued(spark, d))


def _cue_sql(cues: list[str]) -> str:
    return "CASE " + " ".join("WHEN regexp_matches(line, '(?i)\\b{}\\b') THEN '{}'".format(c.replace("'", "''"), c.replace("'", "''")) for c in cues) + " END"


ANCHORS = f"{LINES}, {BODY_LINES}, an AS (SELECT path, line_no, line, {_cue_sql(X.REVERSAL_CUES)} AS rev, {_cue_sql(X.ASSERTION_CUES)} AS ass FROM lines WHERE NOT starts_with(line, '#'))"


@query("anchors_classify", f"WITH {ANCHORS} SELECT path, CAST(line_no AS INT) AS line_no, coalesce(rev, ass) AS cue, rev IS NOT NULL AS reversal FROM an WHERE rev IS NOT NULL OR ass IS NOT NULL")
def anchors_classify(spark, d):
    return TP.anchors(cued(spark, d)).select("path", "line_no", "cue", "reversal")


@query("anchor_cases", "SELECT * FROM (VALUES ('We decided against it', 'decided against', true), ('it was decided', 'decided', false), ('knot', NULL, NULL), ('Do NOT go', 'not', true), ('this isn''t so', 'isn''t', true), ('énot', 'not', true)) t(line, cue, reversal)")
def anchor_cases(spark, d):
    lines = ["We decided against it", "it was decided", "knot", "Do NOT go", "this isn't so", "énot"]
    return spark.createDataFrame([(x,) for x in lines], "line string").withColumn("a", X.anchor(F.col("line"))).select("line", F.col("a.cue").alias("cue"), F.col("a.reversal").alias("reversal"))


STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def _tokens_sql(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: strlen(t) >= 2 AND t NOT IN ({STOP})))"


@query("jaccard_pairs", f"WITH a AS (SELECT item_id, {_tokens_sql('text')} AS t FROM benchmark) SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.t, y.t))::DOUBLE / greatest(len(list_distinct(list_concat(x.t, y.t))), 1), 9) AS jaccard FROM a x JOIN a y ON x.item_id % 20 = 0 AND x.item_id <> y.item_id AND len(list_intersect(x.t, y.t)) > 0")
def jaccard_pairs(spark, d):
    b = T.table(spark, d, "benchmark").select("item_id", X.content_tokens(F.col("text")).alias("t"))
    posts = b.select(F.col("item_id").alias("b"), F.explode("t").alias("w"))
    asked = posts.where("b % 20 = 0").withColumnRenamed("b", "a")
    shared = asked.join(posts, "w").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    sizes = b.select("item_id", F.size("t").alias("k"))
    both = shared.join(sizes.withColumnsRenamed({"item_id": "a", "k": "ka"}), "a").join(sizes.withColumnsRenamed({"item_id": "b", "k": "kb"}), "b")
    return both.select("a", "b", F.round(F.col("n") / (F.col("ka") + F.col("kb") - F.col("n")), 9).alias("jaccard"))


SAID = r"""said AS (SELECT CASE WHEN conv_id % 17 = 0 THEN 'x/Templates/' WHEN conv_id % 17 = 1 THEN 'template.md/' ELSE 'talk/' END||conv_id||'-'||turn||'.md' AS path,
  CASE conv_id % 11 WHEN 0 THEN 'talk/new.md' WHEN 1 THEN '  ' END AS superseded_by, CASE WHEN conv_id % 13 = 0 THEN '2026-01-01' END AS valid_to, CASE WHEN conv_id % 7 = 0 THEN 'old.md' END AS supersedes, conv_id % 19 = 0 AND turn = 0 AS is_index,
  '# no longer a head'||chr(10)||CASE (conv_id + turn) % 4 WHEN 0 THEN 'We will ' WHEN 1 THEN 'we decided on ' WHEN 2 THEN 'This is no longer ' ELSE 'never mind ' END||string_split(t, '. ')[1]||chr(10)||substring(t, length(string_split(t, '. ')[1]) + 1) AS body
  FROM (SELECT *, regexp_replace(coalesce(text, ''), '[\n\r\s]+', ' ', 'g') AS t FROM conversations))"""
LEFT_OUT = "(coalesce(trim(superseded_by), '') <> '' OR valid_to IS NOT NULL OR len(list_intersect(string_split(lower(path), '/'), ['template', 'templates', '_templates'])) > 0)"


def said(spark, d):
    """Turns of conversations as notes: some replaced, some with an end, some that replace others, some under template folders."""
    c, k = T.table(spark, d, "conversations"), F.col("conv_id")
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r\s]+", " ")
    way = (k + F.col("turn")) % 4
    lead = F.when(way == 0, "We will ").when(way == 1, "we decided on ").when(way == 2, "This is no longer ").otherwise("never mind ")
    folder = F.when(k % 17 == 0, "x/Templates/").when(k % 17 == 1, "template.md/").otherwise("talk/")
    first = F.substring_index("t", ". ", 1)
    front = F.struct(F.when(k % 11 == 0, "talk/new.md").when(k % 11 == 1, "  ").alias("superseded_by"), F.when(k % 13 == 0, "2026-01-01").alias("valid_to"), F.when(k % 7 == 0, "old.md").alias("supersedes"))
    body = F.concat(F.lit("# no longer a head\n"), lead, first, F.lit("\n"), F.substring("t", F.char_length(first) + 1, F.char_length("t")))
    path = F.concat(folder, k.cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".md"))
    return c.withColumn("t", t).select(path.alias("path"), F.to_json(front).alias("frontmatter"), body.alias("body"), ((k % 19 == 0) & (F.col("turn") == 0)).alias("is_index"))


OPPOSED = f"""{SAID}, src AS (SELECT path, body FROM said WHERE NOT {LEFT_OUT} AND NOT is_index), ln AS (SELECT path, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no, trim(unnest(string_split(body, chr(10)))) AS line FROM src),
 an AS (SELECT path, line_no, line, {_cue_sql(X.REVERSAL_CUES)} AS rev, {_cue_sql(X.ASSERTION_CUES)} AS ass FROM ln WHERE NOT starts_with(line, '#')),
 tk AS (SELECT path, line_no, line, coalesce(rev, ass) AS cue, rev IS NOT NULL AS reversal, {_tokens_sql('line')} AS t FROM an WHERE rev IS NOT NULL OR ass IS NOT NULL),
 wd AS (SELECT path, {terms('body')} AS w FROM said), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM wd), po AS (SELECT path, t, any_value(len) AS len, count(*) AS tf FROM (SELECT path, len(w) AS len, unnest(w) AS t FROM wd) GROUP BY 1, 2),
 fr AS (SELECT t, count(*) AS df FROM po GROUP BY 1), im AS (SELECT path, po.t, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS w FROM po JOIN fr ON fr.t = po.t, st),
 qs AS (SELECT path AS path_a, line_no AS na, unnest({terms('line')}) AS t FROM tk WHERE len(t) >= 2), sc AS (SELECT path_a, na, im.path AS path_b, sum(w) AS score FROM qs JOIN im ON im.t = qs.t GROUP BY 1, 2, 3),
 rk AS (SELECT *, row_number() OVER (PARTITION BY path_a, na ORDER BY round(score, 9) DESC, path_b) AS r FROM sc QUALIFY r <= 40), ht AS (SELECT path_a, na, path_b, CAST(1 AS DOUBLE) / (60 + r) AS hit, row_number() OVER (PARTITION BY path_a, na ORDER BY r) AS place FROM rk QUALIFY place <= 8),
 pr AS (SELECT h.path_a, h.na, h.path_b, b.line_no AS nb, a.line AS line_a, b.line AS line_b, h.hit, h.place, CASE WHEN a.reversal THEN a.cue ELSE b.cue END AS cue, list_sort(list_intersect(a.t, b.t)) AS shared, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) AS jaccard
  FROM ht h JOIN tk a ON a.path = h.path_a AND a.line_no = h.na JOIN tk b ON b.path = h.path_b WHERE h.path_a <> h.path_b AND h.hit >= 0.012 AND a.reversal <> b.reversal),
 best AS (SELECT * FROM pr WHERE len(shared) > 0 AND jaccard >= 0.12 QUALIFY row_number() OVER (PARTITION BY path_a, na, path_b ORDER BY jaccard DESC, nb) = 1),
 few AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY path_a, na ORDER BY place) <= 3),
 one AS (SELECT *, round(jaccard + hit, 9) AS score FROM few QUALIFY row_number() OVER (PARTITION BY least(path_a, path_b), greatest(path_a, path_b) ORDER BY round(jaccard + hit, 9) DESC, path_a, path_b, line_a, na, line_b) = 1)"""


def _opposed(spark, d):
    n = said(spark, d)
    lines = written(TP.anchors(TP.sources(n, n.where("is_index"))), "anchors")
    chunks = n.select("path", F.lit(0).alias("ord"), X.terms(F.col("body")).alias("words"))
    return TP.opposed(lines, lines, TP.recalled(lines, chunks, {"words": 1.0}))


@query("contradictions", f"WITH {OPPOSED} SELECT path_a, path_b, line_a, line_b, cue, array_to_string(shared, ' ') AS shared, score FROM one ORDER BY one.score DESC, path_a, path_b, line_a, na, line_b LIMIT 20")
def contradictions(spark, d):
    found = TP.contradictions(_opposed(spark, d))
    return found.select("path_a", "path_b", "line_a", "line_b", "cue", F.array_join("shared", " ").alias("shared"), F.round("score", 9).alias("score"))


@query("contradiction_recall", f"WITH {OPPOSED} SELECT path_a, CAST(na AS INT) AS line_no_a, path_b, round(hit, 9) AS hit, CAST(place AS INT) AS place FROM ht")
def contradiction_recall(spark, d):
    n = said(spark, d)
    lines = TP.anchors(TP.sources(n, n.where("is_index")))
    found = TP.recalled(lines, n.select("path", F.lit(0).alias("ord"), X.terms(F.col("body")).alias("words")), {"words": 1.0})
    return found.select("path_a", "line_no_a", "path_b", F.round("hit", 9).alias("hit"), "place")


@query("lag_behind_head", f"SELECT count(*) FILTER (event_id > {CURSOR}) AS behind FROM events")
def lag_behind_head(spark, d):
    return TP.lag(feed(spark, d), CURSOR)


@query("cursor_independence", f"SELECT 'contradictions' AS consumer, CAST(count(*) AS BIGINT) AS pending FROM events WHERE event_id > 100 UNION ALL SELECT 'digest', count(*) FROM events WHERE event_id > {CURSOR}")
def cursor_independence(spark, d):
    cursors = {"digest": CURSOR, "contradictions": 100}
    f = feed(spark, d)
    parts = [TP.since(f, c).agg(F.lit(k).alias("consumer"), F.count("*").alias("pending")) for k, c in cursors.items()]
    return parts[0].unionByName(parts[1]).select("consumer", "pending")


@query("last_change", f"WITH {FEED} SELECT path, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM feed GROUP BY 1")
def last_change(spark, d):
    return TP.last_changes(feed(spark, d))


BOUND = f"{FEED}, docs AS (SELECT 'user-'||user_id AS path, seq FROM feed WHERE event_type = 'purchase'), files AS (SELECT 'file-'||event_type||(user_id % 4) AS path, seq FROM feed), bind AS (SELECT DISTINCT 'user-'||user_id AS doc, 'file-'||event_type||(user_id % 4) AS file FROM feed), last AS (SELECT path, max(seq) AS last_seq FROM docs GROUP BY 1)"


def _bound(spark, d):
    f = feed(spark, d)
    user, file = F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.concat(F.lit("file-"), "event_type", (F.col("user_id") % 4).cast("string"))
    return f.where("event_type = 'purchase'").select(user.alias("path"), "seq"), f.select(user.alias("doc"), file.alias("file")).distinct(), f.select(file.alias("path"), "seq")


@query("commit_distance_drift", f"WITH {BOUND} SELECT doc, file, count(DISTINCT f.seq) AS commits FROM bind JOIN last ON last.path = doc JOIN files f ON f.path = file WHERE f.seq > last_seq GROUP BY 1, 2")
def commit_distance_drift(spark, d):
    return TP.drift(*_bound(spark, d))


STATUS = "status AS (SELECT 'user-'||user_id AS doc, CASE max_by(event_type, event_id) WHEN 'purchase' THEN 'Implemented' ELSE 'Draft' END AS status FROM events GROUP BY 1)"


@query("stale_docs", f"WITH {BOUND}, {STATUS} SELECT doc, count(DISTINCT f.seq) AS commits FROM bind JOIN last ON last.path = doc JOIN status USING (doc) JOIN files f ON f.path = file WHERE f.seq > last_seq AND status = 'Implemented' GROUP BY 1")
def stale_docs(spark, d):
    """Of all documents those of status Implemented, here those whose last event is a purchase."""
    e = T.table(spark, d, "events")
    status = e.groupBy(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("doc")).agg(F.when(F.max_by("event_type", "event_id") == "purchase", "Implemented").otherwise("Draft").alias("status"))
    return TP.stale(*_bound(spark, d), status)


@query("governs_glob_match", f"WITH {NOTES} SELECT 'plan-'||lang||'.md' AS path, p AS pattern, count(*) AS files FROM (SELECT *, unnest(['docs/src1/'||lang||'/*.md', 'docs/*/'||lang||'/1?.md', 'docs/src[23]/'||lang||'/?.md']) AS p FROM (SELECT DISTINCT lang FROM notes)) g JOIN notes n ON regexp_full_match(n.path, replace(replace(replace(p, '.', '\\.'), '*', '[^/]*'), '?', '[^/]')) AND n.lang = g.lang GROUP BY 1, 2".replace("SELECT 'plan-'||lang", "SELECT 'plan-'||g.lang"))
def governs_glob_match(spark, d):
    n = T.document_notes(spark, d)
    docs = T.table(spark, d, "documents").select("lang").distinct()
    lang = F.col("lang")
    globs = F.array(F.concat(F.lit("docs/src1/"), lang, F.lit("/*.md")), F.concat(F.lit("docs/*/"), lang, F.lit("/1?.md")), F.concat(F.lit("docs/src[23]/"), lang, F.lit("/?.md")))
    found = TP.governed(docs.select(F.concat(F.lit("plan-"), lang, F.lit(".md")).alias("path"), globs.alias("governs")), n.select("path"))
    return found.groupBy("path", "pattern").agg(F.count("*").alias("files"))


GLOBS = "unnest(['docs/'||source||'/*/*.md', '*/'||source||'/'||lang||'/?.md', 'src/'||lang||'/*'||(doc_id % 10)||'.py', 'src/[a-e]*/'||(doc_id % 7)||'*', '*/*/'||doc_id||'.*', 'none/'||lang])"


@query("governed_two_trees", rf"""WITH {NOTES}, g AS (SELECT DISTINCT p AS pattern, replace(replace(replace(p, '.', '\.'), '*', '[^/]*'), '?', '[^/]') AS re FROM (SELECT {GLOBS} AS p FROM notes)),
 l AS (SELECT pattern, path AS file, 'local' AS tree FROM g JOIN notes ON len(string_split(pattern, '/')) = len(string_split(path, '/')) AND regexp_full_match(path, re)),
 c AS (SELECT DISTINCT 'src/'||lang||'/'||source||(doc_id % 50)||'.py' AS file FROM documents UNION SELECT 'src/'||lang||'/'||doc_id FROM documents),
 s AS (SELECT pattern, file, 'source' AS tree FROM g JOIN c ON len(string_split(pattern, '/')) = len(string_split(file, '/')) AND regexp_full_match(file, re) WHERE pattern NOT IN (SELECT pattern FROM l))
 SELECT pattern, tree, count(*) AS files, min(file) AS first_file, max(file) AS last_file FROM (SELECT * FROM l UNION ALL SELECT * FROM s) GROUP BY 1, 2""")
def governed_two_trees(spark, d):
    """Each pattern's files and their tree: the notes' own where it matches any, else a tree of code."""
    n, text = T.document_notes(spark, d), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    docs = T.table(spark, d, "documents")
    i, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    patterns = F.array(text("docs/", source, "/*/*.md"), text("*/", source, "/", lang, "/?.md"), text("src/", lang, "/*", i % 10, ".py"), text("src/[a-e]*/", i % 7, "*"), text("*/*/", i, ".*"), text("none/", lang))
    code = docs.select(text("src/", lang, "/", source, i % 50, ".py").alias("file")).union(docs.select(text("src/", lang, "/", i)))
    found = GL.governed(docs.select(F.lit("plan.md").alias("path"), patterns.alias("governs")), n.select(F.col("path").alias("file")), code)
    return found.groupBy("pattern", "tree").agg(F.count("*").alias("files"), F.min("file").alias("first_file"), F.max("file").alias("last_file"))


#: Two snapshots of the documents as line notes: some kept, changed, moved (with and without edits), copied, gone, new.
SNAPSHOTS = r"""src AS (SELECT doc_id, 'No '||doc_id||chr(10)||replace(coalesce(text, ''), '. ', '.'||chr(10)) AS body FROM documents),
 a AS (SELECT 'old/'||doc_id||'.md' AS path, body FROM src WHERE doc_id % 9 <> 0),
 b AS (SELECT CASE WHEN doc_id % 9 = 1 THEN 'new/'||doc_id||'.md' WHEN doc_id % 9 IN (2, 3) THEN 'moved/x'||doc_id||'.md' ELSE 'old/'||doc_id||'.md' END AS path,
  CASE WHEN doc_id % 9 = 3 THEN replace(body, 'No ', 'Number ') WHEN doc_id % 9 = 4 THEN body||'!' ELSE body END AS body FROM src WHERE doc_id % 9 <> 5 UNION ALL SELECT 'copy/'||doc_id||'.md', body FROM src WHERE doc_id % 9 = 6)"""


def snapshots(spark, d):
    i, body = F.col("doc_id"), F.col("body")
    src = T.table(spark, d, "documents").select("doc_id", F.concat(F.lit("No "), i.cast("string"), F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n"))).alias("body"))
    name = lambda folder: F.concat(F.lit(folder), i.cast("string"), F.lit(".md"))
    path = F.when(i % 9 == 1, name("new/")).when((i % 9).isin(2, 3), name("moved/x")).otherwise(name("old/"))
    now = F.when(i % 9 == 3, F.replace(body, F.lit("No "), F.lit("Number "))).when(i % 9 == 4, F.concat(body, F.lit("!"))).otherwise(body)
    b = src.where("doc_id % 9 <> 5").select(path.alias("path"), now.alias("body")).union(src.where("doc_id % 9 = 6").select(name("copy/"), "body"))
    return src.where("doc_id % 9 <> 0").select(name("old/").alias("path"), "body"), b


#: The most similar pairs first: rounds of pairs that are the best of both sides; five rounds settle all pairs of the test tables.
_ROUNDS = ", ".join(
    f"p{k} AS (SELECT * FROM p WHERE share >= 0.5" + "".join(f" AND old_path NOT IN (SELECT old_path FROM e{j}) AND path NOT IN (SELECT path FROM e{j})" for j in range(k)) + "), "
    f"e{k} AS (SELECT * FROM p{k} QUALIFY row_number() OVER (PARTITION BY old_path ORDER BY share DESC, path) = 1 AND row_number() OVER (PARTITION BY path ORDER BY share DESC, old_path) = 1)"
    for k in range(5)
) + ", e AS (" + " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(5)) + ")"


@query("snapshot_changes", rf"""WITH {SNAPSHOTS}, m AS (SELECT path FROM a JOIN b USING (path) WHERE a.body <> b.body), g AS (SELECT path, body FROM a WHERE path NOT IN (SELECT path FROM b)), f AS (SELECT path, body FROM b WHERE path NOT IN (SELECT path FROM a)),
 r AS (SELECT f.path, g.path AS old_path FROM g JOIN f USING (body)), c AS (SELECT f.path, min(a.path) AS old_path FROM f JOIN a USING (body) WHERE f.path NOT IN (SELECT path FROM r) GROUP BY 1),
 g2 AS (SELECT * FROM g WHERE path NOT IN (SELECT old_path FROM r)), f2 AS (SELECT * FROM f WHERE path NOT IN (SELECT path FROM r UNION ALL SELECT path FROM c)),
 hs AS (SELECT side, path, list_sort(list_distinct(list_transform(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: md5(x))))[1:32] AS h FROM (SELECT 0 AS side, * FROM g2 UNION ALL SELECT 1, * FROM f2)),
 p AS (SELECT x.path AS old_path, y.path, len(list_intersect(x.h, y.h))::DOUBLE / greatest(len(x.h), len(y.h)) AS share FROM hs x JOIN hs y ON x.side = 0 AND y.side = 1),
 {_ROUNDS}
 SELECT 'M' AS status, path, NULL AS old_path, NULL::DOUBLE AS share FROM m UNION ALL SELECT 'R', path, old_path, 1.0 FROM r UNION ALL SELECT 'C', path, old_path, NULL FROM c UNION ALL SELECT 'R', path, old_path, round(share, 9) FROM e
 UNION ALL SELECT 'D', path, NULL, NULL FROM g2 WHERE path NOT IN (SELECT old_path FROM e) UNION ALL SELECT 'A', path, NULL, NULL FROM f2 WHERE path NOT IN (SELECT path FROM e)""")
def snapshot_changes(spark, d):
    return SN.changes(*snapshots(spark, d)).select("status", "path", "old_path", F.round("share", 9).alias("share"))


@query("contradiction_exclusions", f"WITH {SAID} SELECT path, {LEFT_OUT} AS excluded FROM said")
def contradiction_exclusions(spark, d):
    return said(spark, d).select("path", TP.excluded(F.col("path"), F.col("frontmatter")).alias("excluded"))


@query("governing_docs", "SELECT 'plan-'||lang||'.md' AS path, 'docs/*/'||lang||'/1?.md' AS matched FROM (SELECT DISTINCT lang FROM documents) WHERE lang = 'en'")
def governing_docs(spark, d):
    lang = F.col("lang")
    globs = F.array(F.concat(F.lit("docs/src1/"), lang, F.lit("/*.md")), F.concat(F.lit("docs/*/"), lang, F.lit("/1?.md")))
    docs = T.table(spark, d, "documents").select("lang").distinct().select(F.concat(F.lit("plan-"), lang, F.lit(".md")).alias("path"), globs.alias("governs"))
    return TP.governing(docs, "docs/src7/en/12.md").select("path", F.array_join("matched", ",").alias("matched"))


def _mounts(spark, d):
    def pages(q, n):
        p = T.table(spark, d, "pages").orderBy("page_id").limit(n)
        return p.select((F.col("page_id") + 1).cast("int").alias("rank"), F.lit("page").alias("title"), F.col("url").alias("ref"), F.lit("").alias("snippet"))

    def talks(q, n):
        c = T.table(spark, d, "conversations").where("turn = 0").orderBy("conv_id").limit(n)
        return c.select((F.col("conv_id") + 1).cast("int").alias("rank"), F.col("role").alias("title"), F.concat(F.lit("talk-"), F.col("conv_id").cast("string")).alias("ref"), F.lit("").alias("snippet"))

    def broken(q, n):
        raise OSError("not reachable")

    return [FED.Mount("Web", pages, "pages of the web", ("html",), (1.0, 0.0)), FED.Mount("Talks", talks, "conversations with people", ("chat",), (0.0, 1.0)), FED.Mount("Down", broken, "a web page store", ("html",), (1.0, 0.1))]


@query("mount_fusion", "SELECT * FROM (SELECT 'Web' AS source, url AS ref, round(1.0 / (61 + page_id), 9)::DOUBLE AS score FROM pages WHERE page_id < 12 UNION ALL SELECT 'Talks', 'talk-'||conv_id, round(1.0 / (61 + conv_id), 9)::DOUBLE FROM conversations WHERE turn = 0 AND conv_id < 12) ORDER BY score DESC, source, ref LIMIT 12")
def mount_fusion(spark, d):
    found, _ = FED.query(None, _mounts(spark, d), "web talks", 12, ["web", "talks"])
    return found.select("source", "ref", F.round("score", 9).alias("score"))


def _plan(spark, plan: FED.Plan):
    return spark.createDataFrame([(plan.mode, ",".join(plan.search), ",".join(plan.skipped))], "mode string, searched string, skipped string")


@query("route_semantic", "SELECT 'routed' AS mode, 'Web,Down' AS searched, 'Talks' AS skipped")
def route_semantic(spark, d):
    return _plan(spark, FED.route(_mounts(spark, d), "where is it", (), (0.9, 0.1)))


@query("route_lexical", "SELECT 'routed' AS mode, 'Talks' AS searched, 'Web,Down' AS skipped")
def route_lexical(spark, d):
    return _plan(spark, FED.route(_mounts(spark, d), "chat about it"))


@query("route_fallback", "SELECT 'fallback' AS mode, 'Web,Talks,Down' AS searched, '' AS skipped")
def route_fallback(spark, d):
    return _plan(spark, FED.route(_mounts(spark, d), "zzz"))


@query("mount_result_parse", "SELECT * FROM (VALUES (1, 'A', 'r1', 's'), (1, 'r2', 'r2', 'x'), (2, NULL, NULL, 'just text'), (3, 'N', 'u', '')) t(id, title, ref, snippet)")
def mount_result_parse(spark, d):
    rows = [(1, '{"hits":[{"title":"A","ref":"r1","snippet":"s"},{"title":" ","ref":"r2","text":"x"}]}'), (2, "just   text"), (3, '{"results":[{"name":"N","url":"u"}]}')]
    return spark.createDataFrame(rows, "id int, raw string").select("id", F.explode(FED.parsed_hits(F.col("raw"))).alias("h")).select("id", "h.title", "h.ref", "h.snippet")


@query("count_talks", f"WITH {TALKS} SELECT count(*) AS talks FROM talks")
def count_talks(spark, d):
    return T.conversation_notes(spark, d).agg(F.count("*").alias("talks"))


