"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Each text gives a vector of transformed statistics: log of the mean word length, root of symbols per word, root of
the share of repeated lines, root of the share of repeated words (the shares with a constant in the denominator, as
few lines or words say little). For each language and source the minimum covariance determinant is sought from three
deterministic starts about the medians: the median deviations alone, the second moments of the standardised vectors'
directions (spatial signs), and those of their hyperbolic tangents. From each start concentration steps follow: mean
and covariance of the half of the rows with the least Mahalanobis distance, until no determinant falls by more than
TOLERANCE; of a group's three the least determinant is kept. All starts and groups share each pass over the rows. The
covariance has the least variances FLOOR on its diagonal, as most statistics are constant in clean text, and is scaled
to its rows' median distance. Estimates shrink towards their language's, and these towards those of all rows, by
n / (n + SHRINK) of n rows: small groups lean on their pool, without a border. Rows beyond CUTOFF are rejected.

The table of groups meets the rows by broadcast up to GROUPS rows; a larger one is joined under SALTS salts, so that a
hot language or source is dealt over as many tasks.

Edge cases: a null or empty text has no words and fails the base rule; null language or source is a group of its own;
repeated rows are judged alike; an empty table gives an empty result; other columns are kept by `keep_good`, whatever
their names, and not read by `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ["x0", "x1", "x2", "x3"]
FLOOR = [0.04, 0.08, 0.06, 0.08]
#: Squared distance beyond which a row is an outlier; share of rows that an estimate rests on; rows whose weight the pool has.
CUTOFF, SHARE, SHRINK = 60.0, 0.5, 40.0
#: Fall of a log determinant that still counts; steps at most.
TOLERANCE, STEPS = 1e-2, 30
#: Median of the chi-squared distribution with four degrees of freedom.
CHI2_MEDIAN = 3.3567
#: Rows of the group table that are broadcast at most (about 50 numbers each); salts of the join beyond it.
GROUPS, SALTS = 50_000, 64
N, STARTS = len(FEATURES), 3
LOWER = [(i, j) for i in range(N) for j in range(i + 1)]


def let(value: Column, body) -> Column:
    """body(v) with v bound to the value, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more among the words."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(p: Column) -> Column:
            hit = F.transform(p, lambda s, k: F.when(F.get(p, k - 1)["h"].eqNullSafe(s["h"]) | F.get(p, k + 1)["h"].eqNullSafe(s["h"]), s["i"]))
            starts = F.sort_array(F.filter(hit, lambda x: x.isNotNull()))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(starts, zero, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, marked))

    windows = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows, covered))


def statistics(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, lang, source (and the columns `keep`) with the base statistics of every text."""
    kept = list(dict.fromkeys(["doc_id", "lang", "source", *keep]))
    t = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*kept, t.alias("__t"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    with_words = base.select(*kept, "__t", F.array_remove(F.split("__t", SPACE), "").alias("__w"), lines.alias("__l"))
    return with_words.select(
        *kept,
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.translate("__t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("__t") - F.char_length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__w")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )


def vectors(stats: DataFrame) -> DataFrame:
    """The statistics with base_failed and the transformed vector."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return stats.select(
        "*",
        failed.alias("base_failed"),
        F.log((F.col("word_chars") + 1) / words).alias("x0"),
        F.sqrt(F.col("n_symbols") / words).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10)).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 100)).alias("x3"),
        F.coalesce("lang", F.lit("\x00")).alias("g0"),
        F.coalesce("source", F.lit("\x00")).alias("g1"),
    )


def _attach(rows: DataFrame, groups: DataFrame, n_groups: int, how: str = "inner") -> DataFrame:
    """Rows with the columns of their group; groups: settled, one row for each g0, g1, n_groups in all."""
    if n_groups <= GROUPS:
        return rows.join(F.broadcast(groups), ["g0", "g1"], how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)))
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["g0", "g1", "__salt"], how).drop("__salt")


def _distance(k: str = "") -> Column:
    """Squared distance of a row from the centre m.. under the Cholesky factor l.. of start k."""
    y: list[Column] = []
    for i in range(N):
        s = F.col(f"x{i}") - F.col(f"m{k}{i}")
        for j in range(i):
            s = s - F.col(f"l{k}{i}{j}") * y[j]
        y.append(s / F.col(f"l{k}{i}{i}"))
    d = y[0] * y[0]
    for v in y[1:]:
        d = d + v * v
    return d


def _factors(groups: DataFrame, k: str = "") -> DataFrame:
    """Adds the Cholesky factor l.. of start k's covariance c.. with its floor, and det, the log of its determinant."""
    out = groups
    for i, j in LOWER:
        s = F.col(f"c{k}{i}{j}") + (FLOOR[i] ** 2 if i == j else 0.0)
        for r in range(j):
            s = s - F.col(f"l{k}{i}{r}") * F.col(f"l{k}{j}{r}")
        out = out.withColumn(f"l{k}{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / F.col(f"l{k}{j}{j}"))
    return out.withColumn(f"det{k}", 2 * sum((F.log(f"l{k}{i}{i}") for i in range(1, N)), F.log(f"l{k}00")))


def _all_factors(groups: DataFrame) -> DataFrame:
    out = groups
    for k in range(STARTS):
        out = _factors(out, f"{k}_")
    return out


def _moments(k: str, where: Column) -> list[Column]:
    """Mean m.. and second moments s.. of the rows where the condition holds."""
    x = [F.when(where, F.col(f)) for f in FEATURES]
    return [*[F.avg(x[i]).alias(f"m{k}{i}") for i in range(N)], *[F.avg(x[i] * x[j]).alias(f"s{k}{i}{j}") for i, j in LOWER]]


def _starts(rows: DataFrame) -> tuple[DataFrame, int]:
    """Centres and covariances of the three starts of each group, and the number of groups."""
    mid = lambda c: F.percentile_approx(c, 0.5, 1000)
    medians = scratch.settle(rows.groupBy("g0", "g1").agg(*[mid(f).alias(f"med{i}") for i, f in enumerate(FEATURES)]), "mcd")
    n_groups = medians.count()
    spread = [mid(F.abs(F.col(f"x{i}") - F.col(f"med{i}"))).alias(f"mad{i}") for i in range(N)]
    mads = _attach(rows, medians, n_groups).groupBy("g0", "g1").agg(*spread, *[F.first(f"med{i}").alias(f"med{i}") for i in range(N)])
    scales = scratch.settle(mads.select("g0", "g1", *[f"med{i}" for i in range(N)], *[F.greatest(1.4826 * F.col(f"mad{i}"), F.lit(FLOOR[i])).alias(f"mad{i}") for i in range(N)]), "mcd")
    z = _attach(rows, scales, n_groups).select("*", *[((F.col(f"x{i}") - F.col(f"med{i}")) / F.col(f"mad{i}")).alias(f"z{i}") for i in range(N)])
    norm = F.sqrt(F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, N)), F.col("z0") * F.col("z0")), F.lit(1e-12)))
    t = [F.tanh(f"z{i}") for i in range(N)]
    kinds = [[F.avg(F.col(f"z{i}") / norm * F.col(f"z{j}") / norm).alias(f"u{i}{j}") for i, j in LOWER], [F.avg(t[i] * t[j]).alias(f"t{i}{j}") for i, j in LOWER]]
    found = z.groupBy("g0", "g1").agg(*kinds[0], *kinds[1], *[F.first(f"{c}{i}").alias(f"{c}{i}") for c in ("med", "mad") for i in range(N)])
    cov = [lambda i, j: F.lit(1.0 if i == j else 0.0), lambda i, j: N * F.col(f"u{i}{j}"), lambda i, j: F.col(f"t{i}{j}")]
    centre = [F.col(f"med{i}").alias(f"m{k}_{i}") for k in range(STARTS) for i in range(N)]
    return found.select("g0", "g1", *centre, *[(cov[k](i, j) * F.col(f"mad{i}") * F.col(f"mad{j}")).alias(f"c{k}_{i}{j}") for k in range(STARTS) for i, j in LOWER]), n_groups


def _concentrate(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """One step of all starts, from the half of the rows nearest to each start's centre; was.. are the determinants before."""
    ks = range(STARTS)
    before = [f"det{k}_" for k in ks]
    near = _attach(rows, groups, n_groups).select(*rows.columns, *before, *[_distance(f"{k}_").alias(f"d{k}") for k in ks])
    limits = scratch.settle(near.groupBy("g0", "g1").agg(*[F.percentile_approx(f"d{k}", SHARE, 1000).alias(f"limit{k}") for k in ks]), "mcd")
    halves = _attach(near, limits, n_groups).groupBy("g0", "g1").agg(*[m for k in ks for m in _moments(f"{k}_", F.col(f"d{k}") <= F.col(f"limit{k}"))], *[F.first(f"det{k}_").alias(f"was{k}") for k in ks])
    c = [(F.col(f"s{k}_{i}{j}") - F.col(f"m{k}_{i}") * F.col(f"m{k}_{j}")).alias(f"c{k}_{i}{j}") for k in ks for i, j in LOWER]
    return halves.select("g0", "g1", *[f"was{k}" for k in ks], *[f"m{k}_{i}" for k in ks for i in range(N)], *c)


def least_determinants(rows: DataFrame) -> tuple[DataFrame, int]:
    """Settled: g0, g1, n rows, centre m.., covariance c.. (scaled to the median distance) and det of each group's best start; the number of groups."""
    starts, n_groups = _starts(rows)
    groups = scratch.settle(_all_factors(starts), "mcd")
    for step in range(STEPS):
        groups = scratch.settle(_all_factors(_concentrate(rows, groups, n_groups)), "mcd")
        if step and not groups.where(" or ".join(f"det{k}_ < was{k} - {TOLERANCE}" for k in range(STARTS))).limit(1).count():
            break
    best = F.least(*[F.col(f"det{k}_") for k in range(STARTS)])

    def chosen(c: str) -> Column:
        pick = F.col(c.format(STARTS - 1))
        for k in reversed(range(STARTS - 1)):
            pick = F.when(F.col(f"det{k}_") <= best, F.col(c.format(k))).otherwise(pick)
        return pick

    names = [f"m{{}}_{i}" for i in range(N)], [f"c{{}}_{i}{j}" for i, j in LOWER], [f"l{{}}_{i}{j}" for i, j in LOWER]
    one = scratch.settle(groups.select("g0", "g1", best.alias("det"), *[chosen(c).alias(c.format("").replace("_", "")) for part in names for c in part]), "mcd")
    scale = _attach(rows, one, n_groups).select("g0", "g1", _distance().alias("d")).groupBy("g0", "g1").agg((F.percentile_approx("d", 0.5, 1000) / CHI2_MEDIAN).alias("scale"), F.count("*").alias("n"))
    grown = one.join(scale, ["g0", "g1"]).withColumn("scale", F.greatest("scale", F.lit(1.0)))
    return scratch.settle(grown.select("g0", "g1", "n", "det", *[f"m{i}" for i in range(N)], *[(F.col("scale") * (F.col(f"c{i}{j}") + (FLOOR[i] ** 2 if i == j else 0.0)) - (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in LOWER]), "mcd"), n_groups


def shrunk(groups: DataFrame) -> DataFrame:
    """Settled: g0, g1, m.. and the Cholesky factor l.. of each group, drawn towards its language and towards all."""
    values = [*[f"m{i}" for i in range(N)], *[f"c{i}{j}" for i, j in LOWER]]
    mean = lambda p: [(F.sum(F.col(v) * F.col("n")) / F.sum("n")).alias(f"{p}{v}") for v in values]
    all_ = groups.agg(*mean("")).first().asDict()
    langs = groups.groupBy("g0").agg(F.sum("n").cast("double").alias("lang_n"), *mean("own_"))
    langs = langs.select("g0", *[((F.col("lang_n") * F.col(f"own_{v}") + SHRINK * F.lit(all_[v] or 0.0)) / (F.col("lang_n") + SHRINK)).alias(f"lang_{v}") for v in values])
    drawn = groups.join(langs, "g0").select("g0", "g1", *[((F.col("n") * F.col(v) + SHRINK * F.col(f"lang_{v}")) / (F.col("n") + SHRINK)).alias(v) for v in values])
    return scratch.settle(_factors(drawn).drop(*[f"c{i}{j}" for i, j in LOWER], "det"), "mcd")


def _judged(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The statistics (settled once, with the columns `keep`) with d and kept."""
    rows = scratch.settle(vectors(statistics(docs, keep)), "statistics")
    sound = rows.where("not base_failed").select("g0", "g1", *FEATURES)
    found, n_groups = least_determinants(sound)
    groups = shrunk(found)
    d = F.when(~F.col("base_failed"), _distance())
    judged = _attach(rows, groups, n_groups, "left").withColumn("d", d).withColumn("kept", ~F.col("base_failed") & (F.coalesce("d", F.lit(0.0)) <= CUTOFF))
    return judged.drop(*groups.columns, *FEATURES)


def judge(docs: DataFrame) -> DataFrame:
    """Every document's statistics, base_failed, the squared distance d (null: base_failed) and kept."""
    return _judged(docs)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the rules keep."""
    whole = docs.select("doc_id", "lang", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return _judged(whole, ["__row"]).where("kept").select("__row.*")
