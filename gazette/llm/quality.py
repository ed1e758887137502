"""Quality rules: a learned decision list over interpretable statistics of a text.

Statistics come from whole texts in DataFrame operations. From labelled rows, sequential covering grows a conjunction of
thresholds for the bad class by information gain on two thirds of the rows, prunes it on the last third, keeps it if it is
precise enough there, removes what it covers and goes on. The list becomes one ordered Spark conditional expression.

The fit uses at most ``SAMPLE_ROWS`` labelled rows (smallest hashes of the id), reduced to counts of rows in cells between
candidate thresholds. Statistics and verdicts cover all rows.

Cases: a null or empty text has no word and fails the base rule, as any text of fewer than 20 words. Without labels, or with
one class only, the list is empty and the base rules decide. A repeated id in the labels takes its lowest quality. Repeated
rows get equal verdicts; other columns stay, whatever their names, but for older ones of the added names in any case. Very long
texts are read whole, as arrays of one row. Ties between conditions go to the first in the order of ratios and cuts. An empty table
gives none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

SAMPLE_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
PRECISION = 0.9
WINDOW = 8
#: Ratios that rules may speak of, as SQL over the statistics.
RATIOS = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}


def _let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: a generator of one row stands between it and what uses it, so the optimizer
    does not copy its expression into each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct and n_digits of each text.

    Words are runs of characters other than ASCII white space. n_repeat_words counts the words that lie in some window of
    eight words which occurs twice or more in the text. Windows are compared by 64-bit hashes of their words' hashes.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    has_word = "[^ \\t-\\r]"
    names: dict[str, str] = {}
    for k in "wlxhop":
        names[k] = fresh([*docs.columns, *names.values()], f"_{k}")
    w, l, x, h, o, p = (names[k] for k in "wlxhop")
    base = _let(docs, w, F.array_remove(F.split(F.regexp_replace(text, "[\\t-\\r]", " "), " "), ""))
    base = _let(base, l, F.filter(F.split(text, "\n"), lambda y: y.rlike(has_word)))
    n = F.size(w)
    base = _let(base, x, F.when(n >= WINDOW, F.transform(w, lambda y: F.xxhash64(y))))
    base = _let(base, h, F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col(x), i + j) for j in range(WINDOW))))))
    # Windows in order of their hash; those with an equal neighbour are repeated.
    order = F.sort_array(F.transform(h, lambda y, i: F.struct(y.alias("h"), i.alias("i"))))
    base = _let(base, o, F.when(F.size(F.array_distinct(h)) < F.size(h), order))
    none = F.lit(-1)
    at = F.transform(
        o,
        lambda y, k: F.when((F.get(F.col(o), k - 1)["h"] == y["h"]) | (F.get(F.col(o), k + 1)["h"] == y["h"]), y["i"]).otherwise(none),
    )
    base = _let(base, p, F.sort_array(F.array_remove(at, -1)))
    covered = F.aggregate(F.transform(p, lambda y, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(p), k + 1), y + WINDOW) - y)), F.lit(0).cast("long"), lambda a, y: a + y)
    out = {
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size(l).cast("long"),
        "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        "n_distinct": F.size(F.array_distinct(w)).cast("long"),
        "n_digits": F.char_length(F.regexp_replace(text, "[^0-9]+", "")).cast("long"),
    }
    return base.select(*(F.col(c) for c in docs.columns if c.lower() not in out), *(v.alias(k) for k, v in out.items()))


def base_failed() -> Column:
    """Too short, or more than 30 percent of its words in repeated windows."""
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (ratio, whether at least, threshold), with the rows it covered and the share of bad ones among them."""

    conditions: tuple[tuple[str, bool, float], ...]
    covered: int
    precision: float

    def column(self) -> Column:
        parts = [F.expr(RATIOS[name]) >= F.lit(cut) if up else F.expr(RATIOS[name]) < F.lit(cut) for name, up, cut in self.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<'} {c:g}" for n, up, c in self.conditions)


def _counts(cells: list, conditions, part: int) -> tuple[int, int]:
    """Bad and good rows of one part that the conditions cover."""
    bad = good = 0
    for bins, third, quality, rows in cells:
        if (third == 2) == (part == 2) and all((bins[f] > k) == up for f, up, k in conditions):
            bad, good = bad + rows * (quality == 0), good + rows * (quality != 0)
    return bad, good


def _cover(cells: list, cuts: list[list[float]], names: list[str]) -> list[Rule]:
    """Sequential covering. cells: (bins, third, quality, rows); a condition (f, up, k): bin of f over k, or not."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        conditions: list[tuple[int, bool, int]] = []
        inside = cells
        while len(conditions) < MAX_CONDITIONS:
            grow = [c for c in inside if c[1] != 2]
            bad, good = sum(c[3] for c in grow if c[2] == 0), sum(c[3] for c in grow if c[2] != 0)
            if not bad or not good:
                break
            before, best = math.log2(bad / (bad + good)), (0.0, None)
            for f in range(len(names)):
                below: dict[int, list[int]] = {}
                for bins, _, quality, rows in grow:
                    below.setdefault(bins[f], [0, 0])[quality != 0] += rows
                b = g = 0
                for k in range(len(cuts[f])):
                    b, g = b + below.get(k, (0, 0))[0], g + below.get(k, (0, 0))[1]
                    for up, p, q in ((False, b, g), (True, bad - b, good - g)):
                        if p and (gain := p * (math.log2(p / (p + q)) - before)) > best[0] + 1e-9:
                            best = gain, (f, up, k)
            if best[1] is None:
                break
            conditions.append(best[1])
            f, up, k = best[1]
            inside = [c for c in inside if (c[0][f] > k) == up]
        if not conditions:
            break

        def worth(some) -> float:
            bad, good = _counts(cells, some, 2)
            return (bad - good) / (bad + good) if bad + good else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        bad, good = (sum(x) for x in zip(_counts(cells, conditions, 0), _counts(cells, conditions, 2), strict=True))
        own = _counts(cells, conditions, 2)
        if bad < 3 or (bad + 1) / (bad + good + 2) < PRECISION or own[0] < PRECISION * sum(own):
            break
        rules.append(Rule(tuple((names[f], up, cuts[f][k]) for f, up, k in conditions), bad + good, bad / (bad + good)))
        cells = [c for c in cells if not all((c[0][f] > k) == up for f, up, k in conditions)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """A decision list for bad texts from at most ``rows`` labelled rows."""
    known = labels.select(F.col(id_column).alias("_id"), F.col("quality").cast("int").alias("_q")).where("_id is not null and _q is not null")
    known = known.groupBy("_id").agg(F.min("_q").alias("_q")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # rows is the bound of what is broadcast here, 12 bytes each.
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text")).join(F.broadcast(known), "_id")
    names = list(RATIOS)
    # Columns of the texts themselves are none here: nothing clashes with a ratio's name.
    table = statistics(texts).where(~base_failed()).select("_q", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(3)).alias("_t"), *(F.expr(f"cast({e} as double)").alias(k) for k, e in RATIOS.items())).persist()
    found = table.agg(*(F.percentile_approx(k, [i / 64 for i in range(1, 64)], 4096).alias(k) for k in names)).first()
    cuts = [sorted(set(found[k] or [])) for k in names]
    bins = [sum((F.when(F.col(k) >= c, 1).otherwise(0) for c in cut), F.lit(0)).alias(k) for k, cut in zip(names, cuts, strict=True)]
    cells = [(tuple(r[k] for k in names), r["_t"], r["_q"], r["n"]) for r in table.select("_q", "_t", *bins).groupBy("_q", "_t", *names).agg(F.count("*").alias("n")).collect()]
    table.unpersist()
    return _cover(cells, cuts, names)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that fires, from 1; 0: none."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), i).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], text_column: str = "text") -> DataFrame:
    """Adds the statistics, base_failed, rule and kept."""
    docs = docs.drop("base_failed", "rule", "kept")
    out = statistics(docs, text_column).withColumn("base_failed", base_failed()).withColumn("rule", F.when(F.col("base_failed"), 0).otherwise(verdict(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every whole text of ``documents``, with rules learnt from ``labels``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    judged = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
