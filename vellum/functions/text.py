"""Scalar text functions as Column expressions (inventory B). All stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a regular-expression class.
BLANK = r"[\s\u000B\u0085\p{Z}]"
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

#: Cues of a reversal and of an assertion; earlier ones win.
REVERSAL_CUES = [
    "no longer", "rolled back", "replaced by", "instead of", "decided against", "changed our mind", "not", "never", "isn't", "aren't", "won't",
    "can't", "don't", "deprecated", "reverted", "cancelled", "abandoned", "dropped", "removed", "obsolete", "superseded",
]
ASSERTION_CUES = ["we will", "decided", "chose", "locked", "canonical", "must", "always", "default"]
#: Words that never count as a subject: function words and the cues' own words.
STOPWORDS = (
    "a an the and or but is are was were be been to of in on for with as at by from into than then so up out off its it this that these those we our us "
    "you your i do does did has have had use used using will no not never longer must always default chose decided locked canonical isn aren won can don "
    "deprecated reverted cancelled abandoned dropped removed obsolete superseded replaced instead against changed mind"
).split()


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")


def squeeze(c: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def content_hash(c: Column) -> Column:
    """B1: hex SHA-256."""
    return F.sha2(c, 256)


def snippet(c: Column, limit: int = 280) -> Column:
    """One line, cut after `limit` characters."""
    s = squeeze(c)
    return F.when(F.char_length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)


def one_line(c: Column, limit: int) -> Column:
    """One line of at most `limit` characters and an ellipsis."""
    return snippet(c, limit)


def truncate_tokens(c: Column, tokens: int) -> Column:
    """About four characters a token, then a marker."""
    return F.when(F.char_length(c) > tokens * 4, F.concat(F.substring(c, 1, tokens * 4), F.lit("\n..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    """UTF-8 bytes over four."""
    return F.floor(F.octet_length(c) / 4).cast("int")


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def terms(c: Column) -> Column:
    """Search terms in order, with repeats."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def count_terms(c: Column) -> Column:
    """How many terms there are; unaccented letters are letters as well, so only the case counts."""
    return F.regexp_count(F.lower(c), F.lit(r"[\p{L}\p{N}]+"))


def query_terms(query: str) -> list[str]:
    """The same terms of a query text, on the driver."""
    table = str.maketrans(ACCENTED, PLAIN)
    return [t for t in re.split(r"[\W_]+", query.lower().translate(table)) if t]


def content_tokens(c: Column) -> Column:
    """Distinct subject words of two bytes and more, without stop words."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(words, lambda t: (F.octet_length(t) >= 2) & ~F.array_contains(stop, t)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; 0 where either is empty."""
    inter, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / F.greatest(union, F.lit(1)))


def bounded(phrase: str) -> str:
    """A pattern for the phrase between ASCII word boundaries, any case."""
    return rf"(?i)(?<![A-Za-z0-9_]){re.escape(phrase)}(?![A-Za-z0-9_])"


def first_cue(line: Column, cues: list[str]) -> Column:
    return F.coalesce(*[F.when(line.rlike(bounded(c)), F.lit(c)) for c in cues])


#: Any cue, so that one test leaves out the lines without one.
ANY_CUE = "(?i)(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, [*REVERSAL_CUES, *ASSERTION_CUES])) + ")(?![A-Za-z0-9_])"


def anchor(line: Column) -> Column:
    """struct(cue, reversal) of a line, null without a cue; a reversal wins. The cues are looked for once a line."""
    cues = F.struct(first_cue(line, REVERSAL_CUES).alias("rev"), first_cue(line, ASSERTION_CUES).alias("ass"))
    told = F.transform(F.array(cues), lambda c: F.struct(F.coalesce(c["rev"], c["ass"]).alias("cue"), c["rev"].isNotNull().alias("reversal")))[0]
    return F.when(line.rlike(ANY_CUE), told)


COMMITMENT = r"(?i)(?<![A-Za-z0-9_])(todo|fixme|i'll|i will|need to)(?![A-Za-z0-9_])|\[ \]"


def is_commitment(line: Column) -> Column:
    """An action item; headings and blank lines are none."""
    t = strip(line)
    return (t != "") & ~t.startswith("#") & t.rlike(COMMITMENT)


def top_area(path: Column) -> Column:
    """First path segment, or (root)."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("(root)")


def slugify(c: Column, limit: int = 40) -> Column:
    """Lower-case words joined by hyphens, `note` where nothing is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    s = F.regexp_replace(s, "-+$", "")
    return F.when(s == "", "note").otherwise(s)


def first_words(c: Column, n: int) -> Column:
    """The first n words."""
    return F.array_join(F.slice(F.split(squeeze(c), " "), 1, n), " ")


def leading_date(c: Column) -> Column:
    """A leading YYYY-MM-DD or an empty text."""
    return F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)


def leading_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d+)", 1)


def fingerprint(kind: Column, path: Column, detail: Column) -> Column:
    """Hash of an issue that outlives changed numbers and spacing."""
    d = F.regexp_replace(squeeze(detail), r"[0-9]+", "N")
    return F.sha2(F.concat(kind, F.lit("\x00"), path, F.lit("\x00"), d), 256)


def url_identity(c: Column) -> Column:
    """Host and path of a repository URL without scheme, user, port 443/22, .git, query, fragment and final slashes."""
    s = F.regexp_replace(F.lower(strip(c)), r"[?#].*$", "")
    s = F.regexp_replace(s, r"^[a-z][a-z0-9+.-]*://", "")
    s = F.regexp_replace(s, r"^[^/@]*@", "")
    s = F.regexp_replace(s, r"^([^/:]+):(443|22)?/?", "$1/")
    return F.regexp_replace(F.regexp_replace(s, r"/+$", ""), r"\.git$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash, empty without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


PAGE_SUFFIX = r"(?i)\.(md|markdown|adoc|asciidoc|rst|rest|textile|org|mediawiki|wiki|creole|pod|pod6|rdoc)$"


def clean_path(path: Column) -> Column:
    """Lexical clean-up of `.`, `..` and empty segments, as a fold over the segments."""

    def step(acc: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        grown = F.concat(acc, F.array(s))
        return F.when((s == "") | (s == "."), acc).when(F.coalesce(back, F.lit(False)), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(grown)

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def page_key(path: Column) -> Column:
    """Node key of a note: docs/<collection>/.../x is <collection>/x, any other path itself; lower case, no suffix."""
    p = F.regexp_replace(F.lower(path), PAGE_SUFFIX, "")
    parts = F.split(p, "/")
    in_docs = (F.element_at(parts, 1) == "docs") & (F.size(parts) >= 3) & F.get(parts, F.lit(1)).isin("specs", "plans", "adr", "research")
    return F.when(in_docs, F.concat_ws("/", F.get(parts, F.lit(1)), F.element_at(parts, -1))).otherwise(p)


def collection_key(path: Column) -> Column:
    """Base name of a note, after its folder for one under docs/<folder>/; lower case, no .md."""
    parts = F.split(path, "/")
    folder = F.when((F.get(parts, F.lit(0)) == "docs") & (F.size(parts) >= 3), F.lower(F.get(parts, F.lit(1))))
    return F.concat_ws("/", folder, normal_link(path))


def normal_link(target: Column) -> Column:
    """Base name without .md, lower case."""
    return F.lower(F.regexp_replace(base_name(strip(target)), r"(?i)\.md$", ""))


def spaced_alias(key: Column) -> Column:
    """Hyphens as spaces, where there are any."""
    return F.when(F.instr(key, "-") > 0, F.translate(key, "-", " "))


def escape_cell(c: Column) -> Column:
    """One table cell."""
    return F.replace(squeeze(c), F.lit("|"), F.lit("\\|"))


def ensure_sentence(c: Column) -> Column:
    """Ends with a full stop or the like."""
    s = squeeze(c)
    return F.when(s.rlike(r"[.!?]$") | (s == ""), s).otherwise(F.concat(s, F.lit(".")))


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.concat(F.least(a, b), F.lit("\x00"), F.greatest(a, b))


def glob_pattern(glob: Column) -> Column:
    """A regular expression for a path glob: * and ? stay within a segment, [..] are classes."""
    quoted = F.regexp_replace(glob, r"([.+^${}()|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
