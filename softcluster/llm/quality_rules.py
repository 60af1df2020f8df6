"""Quality rules with robust multivariate outliers, in DataFrame functions (operator 10).

Counts of each text are transformed to a vector; per language and source, a
minimum covariance determinant estimate of centre and scatter is made, and
documents whose Mahalanobis distance is beyond a chi-squared quantile are
rejected.  Three deterministic starts have the medians as centre and absolute
deviations as spreads, with no correlations, those of squashed values and
those of spatial signs.  Each is moved by concentration steps (the
``keep_share`` of a group's rows nearest to the centre give the next centre
and scatter) until no determinant falls, and a group takes its start of the
least determinant.  A group counts together with ``prior`` rows' worth of all
groups' core rows, so that small groups are held against what is usual.

Everything per group is a grouped sum: starts are a second key of the same
sums, quantiles are read off counts of fixed bins, and scatter, its Cholesky
factor and the distances are columns, so a group of any size is combined in
part before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softcluster.llm.tables import written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
VECTOR = ("x0", "x1", "x2", "x3", "x4")
#: Standard deviations added to the vector's parts, against singular scatter: most texts of a group repeat nothing.
FLOORS = (0.1, 0.03, 0.15, 0.07, 0.07)
STARTS = ("diagonal", "tanh", "sign")
#: Quantiles of the chi-squared distribution with five degrees of freedom.
CHI2_MEDIAN, CHI2_CUTOFF = 4.351, 30.86  # 0.5, 1 - 1e-5
#: A core of about half of normal rows has a scatter 1.8 (if all five parts vary) to 5.6 times (if one does) too small.
CONSISTENCY = 3.0
BIN = 0.005


def _once(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(w: Column) -> Column:
    """Words in windows of three that occur twice or more, by sorted 64-bit hashes."""
    grams = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    again = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    places = F.sort_array(F.transform(_once(F.sort_array(grams), again), lambda x: x["i"]))
    return F.aggregate(
        places, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + (i + 3 - F.greatest(i, s["end"]))).alias("n")), lambda s: s["n"])


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of ``keep`` and the counts of each whole text; null has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACE, "")
    words = _once(F.split(F.btrim(text, F.lit(SPACE)), r"[\x20\x09-\x0D]+"), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), _repeated(w).alias("r")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    none = bare == ""
    return docs.select(
        *keep, F.when(none, F.lit(None)).otherwise(words).alias("w"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _once(lines, F.size).cast("long").alias("n_lines"),
    ).withColumns({"n_words": F.coalesce("w.n", F.lit(0).cast("long")), "n_repeat_words": F.coalesce("w.r", F.lit(0).cast("long"))}).drop("w")


def vector() -> list[Column]:
    """Length, mean word length, and densities of symbols, repeated lines and repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(n), F.log1p(F.col("word_chars") / n), F.asinh(20 * F.col("n_symbols") / n),
            F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / n)]


def _quantiles(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """by, q: the upper edge of the bin in which a group's rows reach ``share``."""
    binned = rows.select(*by, F.ceil(F.col(value) / BIN).alias("bin")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(*by)
    upto = F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return (binned.withColumns({"upto": upto, "all": F.sum("n").over(part)})
            .where(F.col("upto") >= F.col("all") * share).groupBy(*by).agg((F.min("bin") * BIN).alias("q")))


def _cells() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]


def _factor(params: DataFrame) -> DataFrame:
    """start, grp, m0.. and the scatter's s00, s10, ... to its Cholesky factor
    l00, l10, ... and det, half the logarithm of the determinant."""
    for i, j in _cells():
        rest = F.col(f"s{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # The floors keep the diagonal positive.
        params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    det = sum((F.log(f"l{i}{i}") for i in range(1, len(VECTOR))), F.log("l00"))
    return params.withColumn("det", det).drop(*[f"s{i}{j}" for i, j in _cells()])


def _distances(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows, once per start of their group, with start and away, the logarithm
    of the squared Mahalanobis distance to the group's centre."""
    p = len(VECTOR)
    out = rows.join(params, "grp")
    for i in range(p):
        rest = F.col(VECTOR[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0"))
    return out.select(*rows.columns, "start", F.log(F.greatest(total, F.lit(1e-9))).alias("away"))


def _starts(rows: DataFrame) -> DataFrame:
    """start, grp, medians m0.. and scatter s00, s10, ... of every start."""
    p = range(len(VECTOR))
    parts = rows.select("grp", F.posexplode(F.array(*VECTOR)).alias("i", "x"))
    centre = written(_quantiles(parts, ["grp", "i"], "x", 0.5), "mcd_centre")
    spread = _quantiles(parts.join(centre, ["grp", "i"]).select("grp", "i", F.abs(F.col("x") - F.col("q")).alias("a")),
                        ["grp", "i"], "a", 0.5).withColumnRenamed("q", "a")
    both = written(centre.join(spread, ["grp", "i"]).groupBy("grp").agg(
        *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"m{i}") for i in p],
        *[F.max(F.when(F.col("i") == i, F.sqrt((F.col("a") * 1.4826) ** 2 + FLOORS[i] ** 2))).alias(f"a{i}") for i in p]), "mcd_spread")
    z = rows.join(both, "grp").select("grp", *[((F.col(VECTOR[i]) - F.col(f"m{i}")) / F.col(f"a{i}")).alias(f"z{i}") for i in p])
    size = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in p), F.lit(1e-12)))
    squashed = {"tanh": [F.tanh(f"z{i}") for i in p], "sign": [F.col(f"z{i}") / size for i in p]}
    products = z.groupBy("grp").agg(*[F.avg(v[i] * v[j]).alias(f"{name}{i}{j}") for name, v in squashed.items() for i, j in _cells()])

    def scatter(name: str, i: int, j: int) -> Column:
        own = F.col(f"a{i}") * F.col(f"a{j}")
        if i == j:
            return own
        norm = F.sqrt(F.col(f"{name}{i}{i}") * F.col(f"{name}{j}{j}")) if name in squashed else F.lit(0.0)
        return F.when(norm > 0, 0.99 * own * F.col(f"{name}{i}{j}") / norm).otherwise(0.0) if name in squashed else F.lit(0.0)

    starts = F.array(*[F.struct(F.lit(n).alias("start"), *[scatter(name, i, j).alias(f"s{i}{j}") for i, j in _cells()])
                       for n, name in enumerate(STARTS)])
    return both.join(products, "grp").select("grp", *[f"m{i}" for i in p], F.explode(starts).alias("x")).select("grp", *[f"m{i}" for i in p], "x.*")


def _estimate(core: DataFrame, prior: float) -> DataFrame:
    """start, grp, mean and scatter of each group's core rows together with
    ``prior`` rows that are spread as those of all groups."""
    p = range(len(VECTOR))
    own = written(core.groupBy("start", "grp").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(VECTOR[i]).alias(f"m{i}") for i in p],
        *[F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i, j in _cells()]), "mcd_moments")
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    every = own.groupBy("start").agg(*[mean(F.col(f"m{i}")).alias(f"p{i}") for i in p],
                                     *[mean(F.col(f"c{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}")).alias(f"q{i}{j}") for i, j in _cells()])
    w = prior / (F.col("n") + prior)
    apart = [F.col(f"m{i}") - F.col(f"p{i}") for i in p]
    return own.join(every, "start").select(
        "start", "grp", *[(F.col(f"m{i}") - w * apart[i]).alias(f"m{i}") for i in p],
        *[((1 - w) * F.col(f"c{i}{j}") + w * (F.col(f"q{i}{j}") - F.col(f"p{i}") * F.col(f"p{j}")) + w * (1 - w) * apart[i] * apart[j]
           + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i, j in _cells()])


def outliers(rows: DataFrame, keep_share: float = 0.55, most_steps: int = 8, settled: float = 0.01, prior: float = 50.0,
             cutoff: float = CHI2_CUTOFF) -> DataFrame:
    """rows (grp, x0.., others) with far: whether the row is beyond the cutoff.

    Steps end when no group's determinant falls by a factor of more than
    1 - 2 * ``settled`` under any start, and after ``most_steps``.
    """
    params, fell = written(_factor(_starts(rows)), "mcd"), True
    for step in range(most_steps):
        near = _distances(rows, params)
        reach = written(_quantiles(near, ["start", "grp"], "away", keep_share), "mcd_reach")
        core = near.join(reach, ["start", "grp"]).where(F.ceil(F.col("away") / BIN) * BIN <= F.col("q") + BIN / 2)
        moved = written(_factor(_estimate(core, prior)), "mcd")
        if step:
            last = params.select("start", "grp", F.col("det").alias("last"))
            fell = moved.join(last, ["start", "grp"]).agg(F.max(F.col("last") - F.col("det")) > settled).first()[0]
        params = moved
        if not fell:
            break
    first = params.groupBy("grp").agg(F.min(F.struct("det", "start")).alias("x")).select("grp", "x.start")
    placed = _distances(rows, written(params.join(first, ["grp", "start"]), "mcd")).drop("start")
    # The core's scatter is too small by a factor that the median shows where
    # all parts vary, and never by less than CONSISTENCY; a small group's
    # factor is mostly that of all rows.
    shift = F.log(F.lit(CHI2_MEDIAN))
    own = _quantiles(placed, ["grp"], "away", 0.5).join(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp")
    every = _quantiles(placed.select(F.lit(0).alias("one"), "away"), ["one"], "away", 0.5).select("one", F.col("q").alias("all"))
    scale = written(own.withColumn("one", F.lit(0)).join(every, "one").select(
        "grp", F.greatest((F.col("n") * F.col("q") + prior * F.col("all")) / (F.col("n") + prior) - shift, F.log(F.lit(CONSISTENCY))).alias("scale")), "mcd_scale")
    return placed.join(scale, "grp").withColumn("far", F.col("away") > F.col("scale") + F.log(F.lit(cutoff))).drop("scale", "away")


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept.

    A text fails the base rules with fewer than 50 words or with more than
    half of them in repeated windows of three.  Documents that pass are held
    against their group, language and source, of any size.  Null languages
    and sources are values of their own, null texts have no words, repeated
    rows each give a row.
    """
    rows = counts(docs, "doc_id", "lang", "source")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(rows.withColumns({"row": F.monotonically_increasing_id(), "base_failed": failed}
                                    | dict(zip(VECTOR, vector()))), "quality_rules")
    held = written(rows.where("not base_failed").select("row", F.to_json(F.struct("lang", "source")).alias("grp"), *VECTOR), "quality_vectors")
    far = outliers(held, **options).where("far").select("row", "far")
    return rows.join(far, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("far").isNull()).alias("kept"))
