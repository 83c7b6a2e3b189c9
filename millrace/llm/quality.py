"""Word statistics of whole texts and robust outlier rejection, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, small

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5


def _let(value: Column, body) -> Column:
    """body(value), evaluating `value` once however often it is used."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words under windows that occur twice or more; `windows` holds a hash for each place."""

    def marks(s):
        def twice(x, i):
            return ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))

        return F.filter(s, twice)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    places = F.array_sort(F.transform(_let(F.array_sort(pairs), marks), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        places,
        zero,
        lambda a, x: F.struct((x + WINDOW).alias("end"), (a["n"] + x + WINDOW - F.greatest(a["end"], x)).alias("n")),
        lambda a: a["n"],
    )


def _repeats(words: Column) -> Column:
    def of_windows(w):
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))

    def of_words(w):
        n = F.size(w)
        return F.when(n < WINDOW + 1, F.lit(0)).otherwise(_let(F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW))), of_windows))

    return _let(words, of_words)


def word_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the helpers n_lines, n_upper, n_bangs.

    Everything is computed inside the row, so there is no shuffle: windows are
    64-bit hashes in an array, and only a text with a repeated window sorts
    them. A null text has no words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = df.withColumn("_words", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    stats = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.array_join("_words", "")),
        "n_symbols": F.char_length(F.regexp_replace(body, SYMBOLS, "")),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeats(F.col("_words")),
        "n_lines": F.size(lines),
        "n_upper": F.char_length(F.regexp_replace(body, r"\P{Lu}+", "")),
        "n_bangs": F.char_length(F.regexp_replace(body, r"[^!?]+", "")),
    }
    return read.withColumns({k: v.cast("long") for k, v in stats.items()}).drop("_words")


#: The transformed statistics, and the least standard deviation taken for each: most texts have
#: none of some kinds, so that the half with the least spread would have no spread at all.
VECTOR = {
    "word_length": (lambda: F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), 0.10),
    "symbols": (lambda: F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))), 0.05),
    "dup_lines": (lambda: F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), 0.12),
    "repeats": (lambda: F.sqrt(F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))), 0.12),
    "upper": (lambda: F.sqrt(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))), 0.10),
    "bangs": (lambda: F.sqrt(F.col("n_bangs") / F.greatest(F.col("word_chars"), F.lit(1))), 0.05),
}
BINS_PER_E, LEAST_LOG = 16, -14.0


def chi2_cdf(x: float, p: int) -> float:
    """Of a chi-square variable with p degrees of freedom (series of the incomplete gamma function)."""
    a, h = p / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while abs(term) > 1e-16 * abs(total):
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, p) < q:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def _factor(table: DataFrame, names: list[str]) -> DataFrame:
    """Adds the Cholesky factor l_i_j of each row's covariances c_i_j with the least variances added."""
    floors = [VECTOR[n][1] ** 2 for n in names]
    for i in range(len(names)):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            cell = F.sqrt(F.greatest(rest, F.lit(0.0)) + floors[i]) if i == j else rest / F.col(f"l_{j}_{j}")
            table = table.withColumn(f"l_{i}_{j}", cell)
    return table


def _distance(rows: DataFrame, p: int) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(p):
        rest = F.col(f"x_{i}") - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(p)), F.lit(0.0)))


def robust_estimates(rows: DataFrame, store: Scratch, names: list[str], prior_rows: float, share: float = 0.75, most_steps: int = 8, settled: float = 0.02) -> DataFrame:
    """The minimum covariance determinant of each group of `rows` (g, x_0 .. x_{p-1}): g, means m_i, covariances c_i_j and log_det.

    Starts from each group's medians and median deviations and takes concentration steps: distances, the share of rows with the least of them,
    their mean and covariance, until no group's log determinant changes by more than `settled` (a group of n rows counts
    by n^2 / (n^2 + prior_rows^2), as in the mixture), or `most_steps`. A step is one aggregate by group with partial
    sums; the cut comes from a histogram of the logarithm of the distances, so
    that no group's rows are ever brought together. The estimates have one row
    per group.
    """
    p = len(names)
    xs = range(p)
    n_groups = rows.select("g").distinct().count()
    medians = store.keep(rows.groupBy("g").agg(*[F.percentile_approx(f"x_{i}", 0.5, 2000).alias(f"m_{i}") for i in xs], F.count(F.lit(1)).alias("n_rows")), "medians", n_groups)
    spread = rows.join(small(medians, n_groups), "g").groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(f"x_{i}") - F.col(f"m_{i}")), 0.5, 2000).alias(f"s_{i}") for i in xs])
    start = medians.join(small(spread, n_groups), "g")
    start = start.withColumns({f"c_{i}_{j}": (1.4826 * F.col(f"s_{i}")) ** 2 if i == j else F.lit(0.0) for i in xs for j in range(i + 1)})
    log_det = sum((2 * F.log(f"l_{i}_{i}") for i in xs), F.lit(0.0)).alias("log_det")
    now, sizes = store.keep(_factor(start, names).select("*", log_det), "start", n_groups), medians.select("g", "n_rows")
    scale = share / chi2_cdf(chi2_quantile(share, p), p + 2)
    for step in range(most_steps):
        far = _distance(rows.join(small(now, n_groups), "g"), p).withColumn("bin", F.floor(F.log(F.greatest(F.col("d2"), F.lit(1e-6))) * BINS_PER_E).cast("int"))
        counts = far.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"))
        order = "PARTITION BY g ORDER BY bin"
        cut = store.keep(
            counts.withColumns({"below": F.expr(f"sum(n) OVER ({order} ROWS UNBOUNDED PRECEDING)"), "n_all": F.expr("sum(n) OVER (PARTITION BY g)")})
            .where(F.col("below") >= share * F.col("n_all")).groupBy("g").agg(F.min("bin").alias("cut")),
            "cut", n_groups,
        )
        near = far.join(small(cut, n_groups), "g").where("bin <= cut")
        sums = [F.avg(f"x_{i}").alias(f"m_{i}") for i in xs] + [F.avg(F.col(f"x_{i}") * F.col(f"x_{j}")).alias(f"q_{i}_{j}") for i in xs for j in range(i + 1)]
        est = near.groupBy("g").agg(*sums)
        est = est.withColumns({f"c_{i}_{j}": scale * (F.col(f"q_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) for i in xs for j in range(i + 1)})
        after = store.keep(_factor(est, names).select("*", log_det), f"step{step}", n_groups)
        change = F.abs(F.col("log_det") - F.col("was")) / (1 + (prior_rows / F.col("n_rows")) ** 2)
        moved = now.select("g", F.col("log_det").alias("was")).join(small(after, n_groups), "g").join(small(sizes, n_groups), "g").agg(F.max(change)).first()[0]
        store.drop(now, cut)
        now = after
        if moved is None or moved <= settled:
            break
    return now.select("g", *(f"m_{i}" for i in xs), *(f"c_{i}_{j}" for i in xs for j in range(i + 1)), "log_det")


def _pooled(pairs: DataFrame, estimates: DataFrame, n_pairs: int, names: list[str], prior_rows: float) -> DataFrame:
    """lang and source with mean and Cholesky factor of the mixture of the estimates of the pair, its language and the table.

    `pairs` has lang, source, and the row counts n and n_lang. Of a level's n rows and what is left of the weight, the level
    takes n^2 / (n^2 + prior_rows^2), so that a pair of many rows is judged by its own estimate and one of few
    rows by its language's, and nothing changes at once at any size. The mixture's covariance holds what the
    levels' means differ by; as a level's own mean is no more than 1 / weight away by that, a few odd rows don't
    make themselves the rule: at the bound of alpha = 1e-6 it takes 33 rows, of 200.
    """
    xs = range(len(names))
    cells = [f"m_{i}" for i in xs] + [f"c_{i}_{j}" for i in xs for j in range(i + 1)]
    table = pairs
    for k, g in (("p", F.to_json(F.array("lang", "source"))), ("l", F.to_json(F.array("lang"))), ("a", F.lit("[]"))):
        table = table.withColumn("g", g).join(small(estimates.select("g", *(F.col(c).alias(f"{k}_{c}") for c in cells)), n_pairs), "g").drop("g")
    own, wide = (1 / (1 + (prior_rows / F.col(n)) ** 2) for n in ("n", "n_lang"))
    table = table.withColumns({"w_p": own, "w_l": (1 - own) * wide, "w_a": (1 - own) * (1 - wide)})
    table = table.withColumns({f"m_{i}": sum((F.col(f"w_{k}") * F.col(f"{k}_m_{i}") for k in "pla"), F.lit(0.0)) for i in xs})

    def mixed(i: int, j: int) -> Column:
        return sum((F.col(f"w_{k}") * (F.col(f"{k}_c_{i}_{j}") + (F.col(f"{k}_m_{i}") - F.col(f"m_{i}")) * (F.col(f"{k}_m_{j}") - F.col(f"m_{j}"))) for k in "pla"), F.lit(0.0))

    table = table.withColumns({f"c_{i}_{j}": mixed(i, j) for i in xs for j in range(i + 1)})
    return _factor(table.select("lang", "source", *cells), names)


def quality(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least_words: int = 10, most_repeated: int = 20, prior_rows: float = 200.0, share: float = 0.75, alpha: float = 1e-6, carry: bool = False) -> DataFrame:
    """Statistics, the base rule and a robust outlier verdict for every row of `df`.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long), base_failed (fewer than `least_words` words, or over `most_repeated`
    per cent of them in repeated five-word windows), kept and distance (squared,
    null where base_failed). Over the rows that pass the base rule, estimates are made for each pair of lang and source,
    each language and the whole table. A row is judged by a mixture of its three ones, in which
    a level of n rows takes n^2 / (n^2 + `prior_rows`^2) of the weight that the levels below it leave: 0.99 for
    a pair of 2000 rows, 0.5 for one of 200, 0.0025 for one of 10. A null lang or
    source is a value of its own. Each repeated row gets its own row; an empty table
    gives none. Other columns are not read, but with `carry` each row of `df` comes
    along whole, as the column row.
    """
    store = Scratch(df.sparkSession)
    read = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("\0")).alias("lang"), F.coalesce(F.col(source), F.lit("\0")).alias("source"), F.col(text).alias("text"), *([F.struct(*df.columns).alias("row")] if carry else []))
    stats = word_statistics(read).drop("text")
    stats = stats.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    names = list(VECTOR)
    stats = store.keep(stats.withColumns({f"x_{i}": VECTOR[n][0]().cast("double") for i, n in enumerate(names)}), "stats")
    good = stats.where("NOT base_failed")
    by_pair = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    pairs = store.keep(by_pair.withColumn("n_lang", F.sum("n").over(_by("lang"))), "pairs", 0)
    n_pairs = pairs.count()
    levels = F.array(F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("[]"))
    estimates = robust_estimates(good.select(F.explode(levels).alias("g"), *(f"x_{i}" for i in range(len(names)))), store, names, prior_rows, share)
    judge = store.keep(_pooled(pairs, estimates, n_pairs, names, prior_rows), "judge", n_pairs)
    store.keep_only(stats, judge)
    found = _distance(good.join(small(judge, n_pairs), ["lang", "source"]), len(names))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(["row"] if carry else [])]
    failed = stats.where("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return found.select(*out, (F.col("d2") <= chi2_quantile(1 - alpha, len(names))).alias("kept"), F.col("d2").alias("distance")).union(failed)


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)
