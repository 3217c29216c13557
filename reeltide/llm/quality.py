"""Quality rules: weak supervision. Rules vote or abstain, EM estimates their accuracies, the posterior decides."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged, table, whole, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Characters that base rules count as symbols.
SYMBOLS = "#*$%&|<>"
STOPS = ".!?"
BLANKS = " \t\n\x0b\x0c\r"


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    def covered(found):
        starts = F.sort_array(F.transform(found, lambda e: e["at"]))
        steps = let(starts, lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(s):
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        return covered(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, twice))


def _word_measures(w: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.when(F.size(w) > WINDOW, let(hashes, _repeated)).otherwise(0).cast("long").alias("n_repeat_words"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """One row per document with the counts that the rules use; with_row adds all its columns as the struct row.

    A null text has no words; repeated rows stay.
    """
    carried = ["row"] if with_row else []
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_row else []
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    m = F.col("_m")
    return (docs.select(*row, F.col(id_col).alias("doc_id"), whole(text_col).alias("_t"))
            .select(*carried, "doc_id", let(words(t), _word_measures).alias("_m"), let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("_l"),
                    F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"), _removed(t, SYMBOLS).cast("long").alias("n_symbols"), _removed(t, STOPS).cast("long").alias("n_stops"),
                    F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long").alias("n_letters"))
            .select(*carried, "doc_id", m["n_words"].alias("n_words"), "word_chars", "n_symbols", (F.col("_l")["n"] - F.col("_l")["d"]).cast("long").alias("n_dup_lines"),
                    m["n_repeat_words"].alias("n_repeat_words"), m["n_distinct"].alias("n_distinct"), "n_letters", "n_stops", F.col("_l")["n"].cast("long").alias("n_lines")))


def _rule(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule votes 1 (good), -1 (bad) or 0 (abstains) on the columns of measures()."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    share = lambda x, d: c(x) / F.greatest(d, F.lit(1))
    return {
        "length": _rule(c("n_words") >= 40, c("n_words") < MIN_WORDS),
        "symbols": _rule(c("n_symbols") / n <= 0.05, c("n_symbols") / n > 0.1),
        "symbol_share": _rule(share("n_symbols", c("word_chars")) <= 0.005, share("n_symbols", c("word_chars")) > 0.02),
        "sentences": F.when(c("n_words") < MIN_WORDS, 0).otherwise(_rule(c("n_stops") / n >= 0.03, c("n_stops") / n < 0.015)),
        "lines": F.when(c("n_lines") < 3, 0).otherwise(_rule(share("n_dup_lines", c("n_lines")) <= 0.1, share("n_dup_lines", c("n_lines")) > 0.4)),
        "repeats": _rule(c("n_repeat_words") / n <= 0.05, c("n_repeat_words") / n > 0.3),
        "word_length": _rule((c("word_chars") / n >= 3) & (c("word_chars") / n <= 10), (c("word_chars") / n < 2) | (c("word_chars") / n > 14)),
        "variety": F.when(c("n_words") < 40, 0).when(c("n_words") > 2000, 0).otherwise(_rule(c("n_distinct") / n >= 0.3, c("n_distinct") / n < 0.15)),
        "letters": F.when(c("word_chars") == 0, -1).otherwise(_rule(share("n_letters", c("word_chars")) >= 0.92, share("n_letters", c("word_chars")) < 0.8)),
    }


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents; for each rule how often its vote is right on good and on bad documents."""
    prior: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def weights(self, rule: str) -> tuple[float, float]:
        """Log odds that a good and a bad vote of the rule add."""
        g, b = self.on_good[rule], self.on_bad[rule]
        return math.log(g / (1 - b)), math.log((1 - g) / b)


def _expect(prior: float, g: list[float], b: list[float], votes: tuple[int, ...]) -> float:
    log = math.log(prior / (1 - prior)) + sum(math.log(x / (1 - y)) if v > 0 else math.log((1 - x) / y) for v, x, y in zip(votes, g, b) if v)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, log))))


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 50) -> LabelModel:
    """EM over counts of vote patterns. There are at most 3 ** rules patterns, however many documents.

    Abstaining carries no weight. Each accuracy has a small Dirichlet prior; that on good documents stays above 0.55, that
    on bad ones above the share of wrong votes on good ones, which fixes which class is the good one. Without documents
    the starting values are returned.
    """
    k = len(names)
    prior, good, bad = 0.8, [0.95] * k, [0.6] * k
    for _ in range(rounds if patterns else 0):
        mass, total = 1.0, 2.0
        g_right, g_cast, b_right, b_cast = [9.5] * k, [10.0] * k, [6.0] * k, [10.0] * k
        for votes, n in patterns:
            p = _expect(prior, good, bad, votes)
            mass, total = mass + n * p, total + n
            for j, v in enumerate(votes):
                if v:
                    g_cast[j] += n * p
                    b_cast[j] += n * (1 - p)
                    g_right[j] += n * p * (v > 0)
                    b_right[j] += n * (1 - p) * (v < 0)
        prior = min(0.99, max(0.01, mass / total))
        good = [min(0.999, max(0.55, r / c)) for r, c in zip(g_right, g_cast)]
        bad = [min(0.999, max(1.05 * (1 - x), r / c)) for r, c, x in zip(b_right, b_cast, good)]
    return LabelModel(prior, dict(zip(names, good)), dict(zip(names, bad)))


def posterior(model: LabelModel) -> Column:
    """Probability that a document is good, from its vote_ columns."""
    log = F.lit(math.log(model.prior / (1 - model.prior)))
    for name in model.on_good:
        good, bad = model.weights(name)
        log = log + F.when(F.col(f"vote_{name}") > 0, good).when(F.col(f"vote_{name}") < 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-log))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, with_row: bool = False) -> DataFrame:
    """Measures, votes, posterior and verdict of every document; with_row adds all its columns as the struct row.

    Only the histogram of vote patterns (at most 3 ** 9 rows) reaches the driver. Null and empty texts fail the base
    rules, repeated rows and ids keep one output row each, an empty table gives an empty result, other columns are ignored.
    """
    voted = staged(measures(docs, id_col, text_col, with_row).withColumns({f"vote_{k}": v for k, v in rules().items()}), "quality")
    names = list(rules())
    votes = [f"vote_{k}" for k in names]
    patterns = sorted((tuple(r[v] for v in votes), r["count"]) for r in voted.groupBy(*votes).count().collect())
    model = fit_label_model(patterns, names)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("posterior", posterior(model)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
