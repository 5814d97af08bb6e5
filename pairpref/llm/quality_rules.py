r"""Quality rules: simple limits, then robust multivariate outliers per language and source.

Only DataFrame and SQL functions. Per document: words ``[^\x20\x09-\x0D]+``, code points in them, symbols,
repeated lines and words in repeated three-word windows. From these come five transformed statistics, kept as
integers (1/1000), so that every sum below is exact and reruns agree whatever the partitioning.

For each (language, source) the minimum covariance determinant is estimated from the documents that pass the
simple limits. It has several starts, medians with median deviations and the moments of seeded random parts; each
concentration step takes the 75 % of documents with the smallest distances and their mean and covariance, until no
determinant changes (at most ``STEPS`` times), and the start of least determinant counts. Distances are cut by
bins of 1/64 octave, so all documents of the last bin enter. Covariances carry a small floor on their diagonal
(``FLOOR``), since most documents have no repeated line at all. Distances are scaled so that their median is that
of a chi-square. A document farther than ``LIMIT`` (squared) is rejected. Groups of fewer than ``LEAST`` such documents use the
estimate of their language, and if that is small too, of all documents; fewer than ``LEAST`` in all: nothing is rejected.

Null text counts as empty: no words, so it fails the limits. Null languages and sources are groups of their own.
Repeated rows are judged alike. An empty table gives no rows. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairpref.llm.catalog import free_name, query, table
from pairpref.session import broadcast_if_small, stored

SPACE = r"[\\x20\\x09-\\x0D]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LEAST_WORDS, REPEAT_PERCENT = 50, 50
SCALE = 1000
LEAST, STEPS, KEPT_SHARE = 60, 8, 0.75
#: Seeded random starts besides the medians; each is fitted to one document in PART.
RANDOM_STARTS, PART = 1, 4
#: Standard deviation, in units of each statistic, that is added to what a group shows.
FLOOR = (0.10, 0.05, 0.02, 0.10, 0.10)
#: Median of the chi-square with five degrees of freedom, and the squared distance beyond which a document goes.
MEDIAN, LIMIT = 4.351, 90.0
DIMENSIONS = range(len(FLOOR))
X = [f"x{i}" for i in DIMENSIONS]


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with BASE (long) and ``base_failed``; other columns unchanged."""
    text = "coalesce(text, '')"
    # Positions of three-word windows found twice: hash and position share one long, so sorting brings equal windows together.
    starts = """
      transform(array(transform(sequence(0, size(words) - 3), i ->
          pmod(xxhash64(words[i], words[i + 1], words[i + 2]), shiftright(4611686018427387904, 0) div size(words)) * size(words) + i)), keys ->
        transform(array(sort_array(keys)), s -> transform(filter(
          transform(s, (k, j) -> if(coalesce(k div size(words) = get(s, j - 1) div size(words), false)
            or coalesce(k div size(words) = get(s, j + 1) div size(words), false), k % size(words), -1L)), p -> p >= 0), p -> cast(p as int)))[0])[0]
    """
    counted = docs.withColumn(
        "__m",
        F.expr(f"""transform(array(filter(split({text}, '{SPACE}+'), w -> w <> '')), words -> named_struct(
            'n_words', cast(size(words) as long),
            'word_chars', cast(length(translate({text}, ' \\t\\n\\u000B\\u000C\\r', '')) as long),
            'n_symbols', cast(length({text}) - length(translate({text}, '#*$%&|<>', '')) as long),
            'n_repeat_words', case when size(words) < 4 then 0L else
              cast(size(array_distinct(flatten(transform({starts}, p -> array(p, p + 1, p + 2))))) as long) end))[0]"""),
    ).withColumn(
        "__l",
        F.expr(f"""transform(array(filter(split({text}, '\\n'), l -> length(translate(l, ' \\t\\n\\u000B\\u000C\\r', '')) > 0)),
            lines -> cast(size(lines) - size(array_distinct(lines)) as long))[0]"""),
    )
    out = counted.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        *[(F.col("__l") if name == "n_dup_lines" else F.col("__m").getField(name)).alias(name) for name in BASE],
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def statistics() -> list[Column]:
    """The transformed statistics as integers: sizes and lengths by logarithm, shares by square root."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = [
        F.log1p(F.col("n_words")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return [F.round(v * SCALE).cast("long").alias(x) for v, x in zip(values, X)]


def _factor(estimate: DataFrame) -> DataFrame:
    """Adds l{i}{j}, the Cholesky factor of the covariances c{i}{j}, row by row."""
    for i in DIMENSIONS:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimate = estimate.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return estimate.select("group", *[f"m{i}" for i in DIMENSIONS], *[f"l{i}{j}" for i in DIMENSIONS for j in range(i + 1)])


def _distances(rows: DataFrame, factor: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d`` in 1/1000, by forward substitution; null where a group has no estimate."""
    joined = rows.join(broadcast_if_small(factor), "group", "left")
    for i in DIMENSIONS:
        y = F.col(X[i]) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        joined = joined.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    square = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in DIMENSIONS), F.lit(0.0))
    return joined.select(*rows.columns, F.when(square.isNotNull(), F.round(F.least(square, F.lit(1e6)) * SCALE).cast("long")).alias("d"))


def _floor(i: int) -> Column:
    return F.lit(float((FLOOR[i] * SCALE) ** 2))


def _start(good: DataFrame) -> DataFrame:
    """Medians and median absolute deviations (exact: values are small integers, so histograms are bounded)."""
    middle = stored(good.groupBy("group").agg(*[F.expr(f"percentile({x}, 0.5)").alias(f"m{i}") for i, x in enumerate(X)]))
    off = good.join(broadcast_if_small(middle), "group")
    spread = off.groupBy("group").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in DIMENSIONS],
        *[F.expr(f"percentile(abs({x} - m{i}), 0.5)").alias(f"s{i}") for i, x in enumerate(X)],
    )
    return spread.select(
        "group", *[f"m{i}" for i in DIMENSIONS],
        *[((F.pow(1.4826 * F.col(f"s{i}"), 2) + _floor(i)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in DIMENSIONS for j in range(i + 1)],
    )


def _moments(rows: DataFrame) -> DataFrame:
    """Mean m{i} and covariance c{i}{j} of each group, from exact sums."""
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    sums = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        *[exact(F.col(x)).alias(f"t{i}") for i, x in enumerate(X)],
        *[exact(F.col(X[i]) * F.col(X[j])).alias(f"t{i}{j}") for i in DIMENSIONS for j in range(i + 1)],
    )
    double = lambda name: F.col(name).cast("double")
    mean = {i: double(f"t{i}") / F.col("n") for i in DIMENSIONS}
    cov = lambda i, j: double(f"t{i}{j}") / F.col("n") - mean[i] * mean[j] + (_floor(i) if i == j else F.lit(0.0))
    return sums.select(
        "group", *[mean[i].alias(f"m{i}") for i in DIMENSIONS],
        *[cov(i, j).alias(f"c{i}{j}") for i in DIMENSIONS for j in range(i + 1)],
    )


def _binned(rows: DataFrame, factor: DataFrame) -> DataFrame:
    """Rows with their distance and its bin, 1/64 of an octave wide."""
    return _distances(rows, factor).withColumn("bin", F.floor(F.log2(F.col("d") + 1) * 64).cast("int"))


def _nearest(binned: DataFrame) -> DataFrame:
    """(group, at): the bins of the median distance and of that within which KEPT_SHARE of the documents lie."""
    return binned.groupBy("group").agg(F.expr(f"percentile(bin, array(0.5, {KEPT_SHARE}))").alias("at"))


def _random_start(good: DataFrame, seed: int) -> DataFrame:
    """Moments of a random part of each group: one document in PART, by a hash of its statistics."""
    return _moments(good.where(F.pmod(F.xxhash64(F.lit(seed), "group", *X), F.lit(PART)) == 0))


def _determinants(factor: DataFrame) -> DataFrame:
    """(group, det): logarithm of the determinant, twice the sum of those of the Cholesky factor's diagonal."""
    return factor.select("group", sum((2 * F.log(f"l{i}{i}") for i in DIMENSIONS), F.lit(0.0)).alias("det"))


def estimates(good: DataFrame) -> DataFrame:
    """(group, m*, l*, scale) by concentration steps from every start; ``good``: group and X of documents that pass the limits."""
    starts = [_start(good), *[_random_start(good, seed) for seed in range(1, RANDOM_STARTS + 1)]]
    named = [start.withColumn("group", F.concat("group", F.lit(f"#{k}"))) for k, start in enumerate(starts)]
    union = named[0]
    for more in named[1:]:
        union = union.unionByName(more)
    every = F.explode(F.array(*[F.concat("group", F.lit(f"#{k}")) for k in range(len(starts))])).alias("group")
    rows = good.select(every, *X)
    factor = stored(_factor(union))
    for _ in range(STEPS):
        measured = _binned(rows, factor)
        cut = stored(_nearest(measured))
        near = measured.join(broadcast_if_small(cut), "group").where(F.col("bin") <= F.col("at")[1])
        before, factor = factor, stored(_factor(_moments(near)))
        moved = _determinants(factor).join(_determinants(before).withColumnRenamed("det", "old"), "group")
        if moved.where(F.abs(F.col("det") - F.col("old")) > 1e-9).isEmpty():
            break
    least = _determinants(factor).groupBy(F.substring_index("group", "#", -1).alias("start"), F.regexp_replace("group", "#[0-9]+$", "").alias("own")).agg(F.first("det").alias("det"))
    best = least.groupBy("own").agg(F.min(F.struct("det", "start")).alias("b")).select(F.concat("own", F.lit("#"), "b.start").alias("group"), "own")
    chosen = stored(factor.join(best, "group").drop("group").withColumnRenamed("own", "group"))
    middle = _nearest(_binned(good, chosen)).select("group", (F.pow(2.0, F.col("at")[0] / 64) / SCALE / MEDIAN).alias("scale"))
    return chosen.join(middle, "group")


def _groups(stats: DataFrame) -> DataFrame:
    """(lang, source, group): the finest group of at least LEAST good documents, null where even all are fewer."""
    counts = stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("own"))
    both = stats.select("lang", "source").distinct().alias("s").join(
        counts.alias("c"), F.col("s.lang").eqNullSafe(F.col("c.lang")) & F.col("s.source").eqNullSafe(F.col("c.source")), "left"
    ).select("s.lang", "s.source", F.coalesce("own", F.lit(0)).alias("own"))
    langs = both.groupBy("lang").agg(F.sum("own").alias("same"))
    total = both.agg(F.sum("own").alias("total"))
    sized = both.alias("b").join(langs.alias("l"), F.col("b.lang").eqNullSafe(F.col("l.lang"))).select("b.*", "same", total.scalar().alias("total"))
    group = (
        F.when(F.col("own") >= LEAST, F.to_json(F.struct(F.lit(3).alias("by"), "lang", "source")))
        .when(F.col("same") >= LEAST, F.to_json(F.struct(F.lit(2).alias("by"), "lang")))
        .when(F.col("total") >= LEAST, F.lit("all"))
    )
    return sized.select("lang", "source", group.alias("group"))


def judge(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with BASE, base_failed, ``distance`` (squared, scaled) and ``kept``, in place of columns of these names;
    without ``keep_text`` no text is stored or returned."""
    made = {*BASE, "base_failed", "distance", "kept"}
    columns = [c for c in docs.columns if (keep_text or c != "text") and c.lower() not in made]
    rest = F.struct(*[F.col(f"`{c}`") for c in columns if c not in ("text", "lang", "source")], F.lit(0).alias("__row")).alias("__rest")
    counted = base_statistics(docs.select("text", "lang", "source", rest)).select("*", *statistics())
    stats = stored(counted if keep_text else counted.drop("text"))
    groups = stored(_groups(stats))
    named = stats.alias("s").join(
        broadcast_if_small(groups).alias("g"),
        F.col("s.lang").eqNullSafe(F.col("g.lang")) & F.col("s.source").eqNullSafe(F.col("g.source")), "left",
    ).select("s.*", "g.group")
    # Small groups' documents also count in the group they fall back to, and large ones in their own only.
    good = stored(_members(named))
    fitted = stored(estimates(good))
    measured = _distances(named, fitted.drop("scale")).join(broadcast_if_small(fitted.select("group", "scale")), "group", "left")
    distance = F.col("d") / SCALE / F.greatest(F.col("scale"), F.lit(1e-3))
    kept = ~F.col("base_failed") & F.coalesce(distance <= LIMIT, F.lit(True))
    back = [F.col(c) if c in ("text", "lang", "source") else F.col("__rest").getField(c).alias(c) for c in columns]
    return measured.select(*back, *BASE, "base_failed", distance.alias("distance"), kept.alias("kept"))


def keep_kept(docs: DataFrame) -> DataFrame:
    """``docs`` without what the rules reject. A verdict depends on text, language and source alone, so only two hashes
    of these are stored of rejected documents, and texts are shuffled only where those are too many to broadcast."""
    parts = [F.col(c) for c in ("text", "lang", "source")] + [F.isnull(c) for c in ("text", "lang", "source")]
    one, two = (free_name(name, docs.columns) for name in ("one", "two"))
    keys = {one: F.xxhash64(*parts), two: F.xxhash64(F.lit(1), *parts)}
    keyed = docs.withColumns(keys)
    bad = stored(judge(keyed.select("text", "lang", "source", *keys), False).where("not kept").select(*keys).distinct())
    return keyed.join(broadcast_if_small(bad), list(keys), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _members(named: DataFrame) -> DataFrame:
    """Rows each estimate is fitted to: its own documents, and for a language or all, every good document there."""
    good = named.where(~F.col("base_failed") & F.col("group").isNotNull())
    used = stored(named.select("group").distinct())
    wide = used.where(~F.col("group").startswith('{"by":3'))
    language = F.to_json(F.struct(F.lit(2).alias("by"), "lang"))
    levels = F.array(
        F.when(F.col("group").startswith('{"by":3'), F.col("group")), language, F.lit("all")
    )
    listed = good.select(F.explode(F.array_distinct(F.filter(levels, lambda g: g.isNotNull()))).alias("group"), *X)
    own = listed.where(F.col("group").startswith('{"by":3'))
    return own.unionByName(listed.where(~F.col("group").startswith('{"by":3')).join(broadcast_if_small(wide), "group", "left_semi"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs, False).select("doc_id", *BASE, "base_failed", "kept", "distance")
