"""Quality rules: a learned decision list over native text statistics.

``text_statistics`` measures every whole text with DataFrame functions only. ``learn_rules`` grows threshold
conjunctions by sequential covering on labelled rows and prunes them on rows held back from growing.
``rule_column`` turns the list into one ordered ``CASE WHEN`` expression, which is how it is applied.

Defined cases: a null text has no words and all its counts are 0; an empty text likewise. Repeated rows are
measured and judged each on its own. Labels that are null, or whose document is missing, are not learned from;
a document with several labels is learned from once for each. Without usable labels the list is empty and every
document that passes the base checks is kept. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.session import cut

SPACE = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Features that conditions are put on. Each is a number for every text, 0 where its denominator is 0.
FEATURES = {
    "f_words": "CAST(n_words AS DOUBLE)",
    "f_word_chars": "coalesce(try_divide(word_chars, n_words), 0D)",
    "f_symbols": "coalesce(try_divide(n_symbols, n_words), 0D)",
    "f_marks": "coalesce(try_divide(n_marks, n_words), 0D)",
    "f_upper": "coalesce(try_divide(n_upper, word_chars), 0D)",
    "f_digits": "coalesce(try_divide(n_digits, word_chars), 0D)",
    "f_dup_lines": "coalesce(try_divide(n_dup_lines, n_lines), 0D)",
    "f_repeats": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
    "f_distinct": "coalesce(try_divide(n_distinct, n_words), 0D)",
}
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# Windows found twice are neighbours after sorting; their starts, sorted, cover min(WINDOW, gap) words each.
REPEATS = f"""
CASE WHEN _distinct_windows = size(_windows) THEN 0L ELSE
  transform(array(array_sort(transform(_windows, (x, i) -> named_struct('x', x, 'i', i)))), s ->
    transform(array(array_sort(transform(filter(s, (e, k) ->
        get(s, k - 1).x <=> e.x OR get(s, k + 1).x <=> e.x), e -> e.i))), p ->
      aggregate(transform(p, (v, k) -> CAST(least({WINDOW}, coalesce(get(p, k + 1), v + {WINDOW}) - v) AS BIGINT)),
                0L, (a, b) -> a + b))[0])[0]
END"""


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the counts of every row of ``docs``; one row out for each row in, no shuffle.

    A window of five words is known by the 64-bit hash of its words' hashes.
    """
    plain = docs.select(
        *keep,
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    split = plain.select(
        *keep,
        "_text",
        F.expr(f"filter(split(_text, '{SPACE}'), w -> w <> '')").alias("_words"),
        F.expr("filter(split(_text, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')").alias("_lines"),
    )
    counted = split.select(
        *keep,
        F.expr("CAST(size(_words) AS BIGINT)").alias("n_words"),
        F.expr(r"CAST(length(translate(_text, ' \t\n\u000B\u000C\r', '')) AS BIGINT)").alias("word_chars"),
        F.expr(f"CAST(length(_text) - length(translate(_text, '{SYMBOLS}', '')) AS BIGINT)").alias("n_symbols"),
        F.expr("CAST(length(_text) - length(translate(_text, '!?', '')) AS BIGINT)").alias("n_marks"),
        F.expr("CAST(length(_text) - length(translate(_text, '0123456789', '')) AS BIGINT)").alias("n_digits"),
        F.expr(
            "CAST(length(_text) - length(translate(_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT)"
        ).alias("n_upper"),
        F.expr("CAST(size(_lines) AS BIGINT)").alias("n_lines"),
        F.expr("CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)").alias("n_dup_lines"),
        F.expr("transform(_words, w -> xxhash64(w))").alias("_hashes"),
    )
    following = ", ".join(f"get(_hashes, i + {k})" for k in range(1, WINDOW))
    windows = counted.select(
        *keep,
        *[c for c in counted.columns if c not in keep and not c.startswith("_")],
        F.expr("CAST(size(array_distinct(_hashes)) AS BIGINT)").alias("n_distinct"),
        F.expr(
            f"transform(slice(_hashes, 1, greatest(size(_hashes) - {WINDOW - 1}, 0)), (x, i) -> xxhash64(x, {following}))"
        ).alias("_windows"),
    )
    sized = windows.withColumn("_distinct_windows", F.expr("size(array_distinct(_windows))"))
    return sized.withColumn("n_repeat_words", F.expr(REPEATS)).drop("_windows", "_distinct_windows")


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({name: F.expr(sql) for name, sql in FEATURES.items()})


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        feature = F.col(self.feature)
        return feature >= self.threshold if self.at_least else feature < self.threshold


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule))


def rule_column(rules: list[Rule]) -> Column:
    """False where one of the rules, tried in order, holds; true where none does."""
    verdict = None
    for rule in rules:
        verdict = F.when(holds(rule), False) if verdict is None else verdict.when(holds(rule), False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    from math import log2

    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p and p0 else 0.0


#: A condition on a feature's bin: the feature, the bin's number, and whether the bin or a higher one is wanted.
Step = tuple[str, int, bool]


def _within(steps: list[Step]) -> Column:
    return reduce(lambda a, b: a & b, ((F.col(f) >= k) == F.lit(up) for f, k, up in steps), F.lit(True))


def _best_step(rows: DataFrame, bins: dict[str, int]) -> tuple[Step | None, int, int, int, int]:
    """The step of most information gain, the bad and good rows under it, and those before; one aggregation."""
    each = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in bins])
    counts = (
        rows.select("bad", F.explode(each).alias("e"))
        .groupBy("e.f", "e.b")
        .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        .collect()  # at most a row for each feature and threshold
    )
    own = {f: {r["b"]: (r["p"], r["n"]) for r in counts if r["f"] == f} for f in bins}
    p0, n0 = (sum(v[j] for v in own[next(iter(bins))].values()) for j in (0, 1))
    best, most = (None, 0, 0), 0.0
    for feature, top in sorted(bins.items()):
        for k in range(1, top + 1):
            above = [sum(v[j] for b, v in own[feature].items() if b >= k) for j in (0, 1)]
            for up, (p, n) in ((True, above), (False, (p0 - above[0], n0 - above[1]))):
                if (gain := _gain(p, n, p0, n0)) > most + 1e-9:
                    best, most = ((feature, k, up), int(p), int(n)), gain
    return *best, int(p0), int(n0)


def learn_rules(
    labelled: DataFrame,
    thresholds: int = 16,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_cover: int = 5,
) -> list[Rule]:
    """Sequential covering over ``labelled`` (the features, ``bad`` 0 or 1, ``prune`` boolean).

    Each round grows one conjunction on the rows for growing, condition by condition, cuts it back to the
    beginning that does best on the rows for pruning, and removes what it covers. It ends when a rule does not
    reach ``min_precision`` on the pruning rows or covers fewer than ``min_cover`` bad rows of both kinds.
    The features are first put in bins between their thresholds, quantiles of the bad and of the good rows. Every
    count is one Spark aggregation; only the counts come to the driver.
    """
    quantiles = [k / (thresholds + 1) for k in range(1, thresholds + 1)]
    found = labelled.agg(
        *[F.percentile(F.when(F.col("bad") == bad, F.col(f)), F.array(*map(F.lit, quantiles))).alias(f"{f}_{bad}") for f in FEATURES for bad in (0, 1)]
    ).first()
    cuts = {f: sorted({round(x, 6) for bad in (0, 1) for x in found[f"{f}_{bad}"] or []}) for f in FEATURES}
    cuts = {f: at for f, at in cuts.items() if at}
    if not cuts:
        return []
    binned = [F.expr(f"size(filter(array({', '.join(f'{x!r}D' for x in at)}), c -> {f} >= c))").alias(f) for f, at in cuts.items()]
    rest = cut(labelled.select("bad", "prune", *binned))
    bins = {f: len(at) for f, at in cuts.items()}
    rules: list[Rule] = []
    while len(rules) < max_rules:
        steps: list[Step] = []
        p = n = None
        while len(steps) < max_conditions and n != 0:
            step, p1, n1, p0, n0 = _best_step(rest.filter(~F.col("prune")).filter(_within(steps)), bins)
            if step is None or not p0 or not n0:
                break
            steps, p, n = [*steps, step], p1, n1
        if not steps or p < min_cover:
            break
        starts = [steps[:k] for k in range(1, len(steps) + 1)]
        sums = [F.sum(F.when(_within(s), v)).alias(f"c{k}_{j}") for k, s in enumerate(starts) for j, v in enumerate((F.col("bad"), 1 - F.col("bad")))]
        one = rest.filter("prune").agg(*sums).first()
        scores = [(one[f"c{k}_0"] or 0, one[f"c{k}_1"] or 0) for k in range(len(starts))]
        best = max(range(len(starts)), key=lambda k: ((scores[k][0] - scores[k][1]) / max(1, sum(scores[k])), scores[k][0], -k))
        p, n = scores[best]
        if p < min_cover or p < min_precision * (p + n):
            break
        rules.append(tuple(Condition(f, up, cuts[f][k - 1]) for f, k, up in starts[best]))
        rest = rest.filter(~_within(starts[best]))
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Features and labels of at most ``max_rows`` labelled documents, those of the smallest hashes of doc_id.

    Documents that fail the base checks are rejected without the list, so it does not learn from them.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sample = usable.orderBy(order, "doc_id", "quality").limit(max_rows)  # the bound is what makes the broadcast safe
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return cut(
        with_features(text_statistics(rows, ["doc_id", "quality"])).select("*", base_failed().alias("failed")).select(
            "failed",
            (1 - F.col("quality")).alias("bad"),
            (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("prune")), F.lit(3)) == 0).alias("prune"),
            *FEATURES,
        )
    ).filter("NOT failed")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, max_fit_rows: int = 20_000
) -> DataFrame:
    """``keep`` columns of ``docs`` with the statistics, ``base_failed`` and ``kept``.

    ``max_fit_rows`` bounds the labelled rows that the decision list is learned from.
    """
    keep = keep or ["doc_id"]
    rules = learn_rules(labelled_sample(docs, labels, max_fit_rows))
    judged = with_features(text_statistics(docs, keep))
    return judged.select(
        *keep,
        *STATISTICS,
        base_failed().alias("base_failed"),
        (~base_failed() & rule_column(rules)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that pass the base checks and that no rule rejects, with all columns as they were."""
    rules = learn_rules(labelled_sample(docs, labels, max_fit_rows))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # they clash with no statistic
    given = docs.select(*[F.col(c).alias(x) for c, x in names.items()])
    judged = with_features(text_statistics(given, list(names.values()), names["text"]))
    # The row number keeps the filter above the statistics: pushed below them, it would hold a copy of each for
    # every place where a rule names it.
    verdict = judged.select(*names.values(), (~base_failed() & rule_column(rules)).alias("kept"), F.monotonically_increasing_id().alias("row"))
    return verdict.filter("kept AND row >= 0").select(*[F.col(x).alias(c) for c, x in names.items()])
