"""Quality rules: a learned decision list over document statistics, in DataFrame expressions only.

``document_statistics`` computes counts of a whole text without leaving its row; ``learn`` grows and prunes
threshold conjunctions by sequential covering over labelled statistics; ``verdict`` turns the ordered rules
into one conditional expression.  Every pass over rows is an aggregation; the driver sees only per-bin counts.

Defined results: a null text has no words (all counts 0) and fails the base rule; ties between candidate
conditions go to the first feature by name, then to the lower threshold; repeated rows give repeated rows;
an empty table gives an empty one; without labels the list is empty and only the base rule rejects.
Columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, materialize, release, table

#: The statistics a condition may test, as SQL over the columns of document_statistics.
FEATURES = {
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "exclaim_share": "n_exclaim / greatest(n_words, 1)",
    "log_words": "log2(greatest(n_words, 1))",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; hits and misses are counted on the rows that prune it."""

    conditions: tuple[Condition, ...]
    rejected: int = 0
    clean: int = 0

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def rule_number(self) -> Column:
        """1 for the first rule that fires, 2 for the second and so on; 0 where none does."""
        out = F.lit(0)
        for number, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(F.expr(rule.sql()), F.lit(number)).otherwise(out)
        return out


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of each whole text; all columns of docs stay except clashing ones, which are replaced.

    n_repeat_words: positions covered by 3-word windows that occur twice or more.  Windows are sorted once by
    a 64-bit hash chained over the three words, equal neighbours marked, and the marked positions merged, so
    a text costs n log n whatever its length.
    """
    out = (
        docs.withColumn("_t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
        .withColumn("_w", F.expr(r"array_remove(split(_t, '[\\x20\\x09-\\x0D]+'), '')"))
        .withColumn("_lines", F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
        .withColumn("n_words", F.expr("cast(size(_w) AS bigint)"))
        .withColumn("word_chars", F.expr(r"cast(length(regexp_replace(_t, '[\\x20\\x09-\\x0D]+', '')) AS bigint)"))
        .withColumn("n_symbols", F.expr(r"cast(length(regexp_replace(_t, '[^#*$%&|<>]+', '')) AS bigint)"))
        .withColumn("n_upper", F.expr(r"cast(length(regexp_replace(_t, '[^A-Z]+', '')) AS bigint)"))
        .withColumn("n_exclaim", F.expr("cast(length(_t) - length(replace(_t, '!', '')) AS bigint)"))
        .withColumn("n_lines", F.expr("cast(size(_lines) AS bigint)"))
        .withColumn("n_dup_lines", F.expr("cast(size(_lines) - size(array_distinct(_lines)) AS bigint)"))
        .withColumn("_h", F.expr("CASE WHEN n_words >= 4 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"))
        .withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h AS h, i AS p))) END"))
        .withColumn("_p", F.expr("array_sort(transform(filter(_s, (x, i) -> x.h = get(_s, i - 1).h OR x.h = get(_s, i + 1).h), x -> x.p))"))
        .withColumn("n_repeat_words", F.expr("cast(coalesce(aggregate(transform(_p, (p, k) -> least(3, coalesce(get(_p, k + 1), p + 3) - p)), 0, (a, x) -> a + x), 0) AS bigint)"))
    )
    return out.drop("_t", "_w", "_lines", "_h", "_s", "_p").withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({name: F.expr(f"cast({sql} AS double)") for name, sql in FEATURES.items()})


def _bin_counts(rows: DataFrame, where: str) -> dict[tuple[str, int], tuple[int, int]]:
    """(feature, bin) -> (rejected, clean) rows there; at most features x bins rows reach the driver."""
    pairs = ", ".join(f"'{f}', _bin_{f}" for f in FEATURES)
    counted = rows.where(where).select("_bad", F.expr(f"stack({len(FEATURES)}, {pairs}) AS (feature, bin)")).groupBy("feature", "bin").agg(F.expr("count_if(_bad)").alias("bad"), F.expr("count_if(NOT _bad)").alias("good"))
    return {(r.feature, r.bin): (r.bad, r.good) for r in counted.collect()}


def _best_condition(counts: dict[tuple[str, int], tuple[int, int]], cuts: dict[str, list[float]]) -> tuple[float, Condition | None, int, int]:
    """The threshold with the highest information gain over what the rule covers now."""
    best: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
    for feature in sorted(cuts):
        bins = [counts.get((feature, b), (0, 0)) for b in range(len(cuts[feature]) + 1)]
        bad, good = sum(b for b, _ in bins), sum(g for _, g in bins)
        if not bad or not good:
            continue
        start, low_bad, low_good = math.log2(bad / (bad + good)), 0, 0
        for k, cut in enumerate(cuts[feature]):
            low_bad, low_good = low_bad + bins[k][0], low_good + bins[k][1]
            for above, b, g in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                if b:
                    gain = b * (math.log2((b + 0.0) / (b + g)) - start)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(feature, above, cut), b, g)
    return best


def learn(
    stats: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", bins: int = 24, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.97, min_share: float = 0.01
) -> DecisionList:
    """Sequential covering over every labelled row that the base rule keeps.

    Two thirds of the keys (by hash) grow a rule, condition by condition, by information gain; the other third
    prunes it: trailing conditions go while (rejected - clean) / (rejected + clean) does not fall.  A rule that
    is under min_precision there, or covers under min_share of the rejects, ends the list.
    """
    marked = bare(labels, key, label).where(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_label"))
    rows = with_features(stats.where("NOT base_failed")).select(key, *FEATURES).join(marked, key).withColumn("_bad", F.col("_label") == 0).withColumn("_prune", F.pmod(F.xxhash64(key), F.lit(3)) == 0)
    rows = materialize(rows, "labelled-statistics")
    steps = f"array({', '.join(str(i / bins) for i in range(bins + 1))})"
    quantiles = [f"percentile_approx({f}, {steps}, 2000) FILTER (WHERE {where}) AS {side}_{f}" for f in FEATURES for side, where in (("b", "_bad"), ("g", "NOT _bad"))]
    found = rows.selectExpr(*quantiles).first()
    cuts = {f: sorted({*(found[f"b_{f}"] or []), *(found[f"g_{f}"] or [])}) for f in FEATURES}
    binned = rows.withColumns({f"_bin_{f}": F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts[f]) or 'CAST(NULL AS double)'}), c -> c <= {f}))") for f in FEATURES})
    binned = materialize(binned.select("_bad", "_prune", *FEATURES, *[f"_bin_{f}" for f in FEATURES]), "binned-statistics")
    release(rows)

    def tally(where: str) -> tuple[int, int]:
        r = binned.where(where).agg(F.expr("count_if(_bad)").alias("bad"), F.expr("count_if(NOT _bad)").alias("good")).first()
        return r.bad, r.good

    total, _ = tally("true")
    rules, left = DecisionList(), "true"
    while total and len(rules.rules) < max_rules:
        conditions: list[Condition] = []
        while len(conditions) < max_conditions:
            where = " AND ".join([left, "NOT _prune", *(c.sql() for c in conditions)])
            _, condition, _, good = _best_condition(_bin_counts(binned, where), cuts)
            if condition is None:
                break
            conditions.append(condition)
            if not good:
                break
        worth, best = -2.0, None
        for n in range(1, len(conditions) + 1):
            bad, good = tally(" AND ".join([left, "_prune", *(c.sql() for c in conditions[:n])]))
            if bad + good and (value := (bad - good) / (bad + good)) > worth:
                worth, best = value, Rule(tuple(conditions[:n]), bad, good)
        if best is None or best.rejected / max(1, best.rejected + best.clean) < min_precision or best.rejected < min_share * total / 3:
            break
        rules.rules.append(best)
        left += f" AND NOT ({best.sql()})"
    release(binned)
    return rules


def apply_rules(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds rule (number of the first that rejects, 0 for none) and kept."""
    return with_features(stats).withColumn("rule", F.when(F.col("base_failed"), F.lit(-1)).otherwise(rules.rule_number())).withColumn("kept", F.col("rule") == 0).drop(*FEATURES)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; the list is learnt from all labelled rows of the folder."""
    docs = bare(table(spark, sf_dir, "documents"), "doc_id", "text")
    stats = materialize(document_statistics(docs).drop("text"), "document-statistics")
    rules = learn(stats, table(spark, sf_dir, "labels"))
    return apply_rules(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or the learnt list rejects; the columns stay as they are.

    Statistics are computed once and written beside the rows; learning reads only the numbers.  A document with a
    null id is judged like any other, but takes no part in learning.
    """
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("text").alias("_text"))
    stats = materialize(document_statistics(keyed, "_text").drop("_text"), "rows-with-statistics")
    rules = learn(stats.drop("_row").where("doc_id IS NOT NULL"), table(spark, sf_dir, "labels"))
    return apply_rules(stats, rules).where("kept").select("_row.*")
