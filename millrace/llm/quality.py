"""Quality filtering by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (null). Votes are counted by
pattern; there are at most 3**len(RULES) patterns whatever the corpus holds,
so the driver reads a table of bounded size. Expectation-maximisation over the
patterns estimates the prior and, for every rule, its rate of "good" votes on
good and on bad documents. The posterior is then a sum of log-odds in plain
column arithmetic, and replaces a filter that needs every rule to pass.

Defined results: a null text counts as empty (no words, base_failed); a table
without rows gives no rows and parameters at their start values; repeated rows
are scored alike; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Fixed value: very frequent function words of four languages.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "de", "la", "le", "les", "et", "des", "un", "une", "der", "die", "das", "und", "ist", "den", "von", "zu", "el", "los", "las", "que", "en", "es", "del", "con")


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document; one narrow pass, no shuffle.

    Windows of three words are keyed by hash; only a text with a repeated key
    pays for the sort that finds where the repeats lie. Every array that is
    used twice is a column of its own, so that no plan evaluates it twice.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.withColumn("_b", F.btrim("_t", F.lit(" \t\n\x0b\f\r")))
    d = d.withColumn("_w", F.when(F.length("_b") > 0, F.split("_b", SPACES, -1)).otherwise(F.array().cast("array<string>")))
    at = lambda c, i: F.get(F.col(c), i)
    every = F.transform("_w", lambda w, i: F.xxhash64(w, at("_w", i + 1), at("_w", i + 2)))
    none = F.array().cast("array<bigint>")
    d = d.withColumn("_k", F.when(F.size("_w") >= 3, F.slice(every, 1, F.size("_w") - 2)).otherwise(none))
    d = d.withColumn("_r", F.when(F.size(F.array_distinct("_k")) < F.size("_k"), F.sort_array(F.transform("_k", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(at("_r", j)["k"] == x["k"], F.lit(False))
    found = F.transform("_r", lambda x, j: F.when(same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))), x["i"]))
    d = d.withColumn("_p", F.sort_array(F.array_compact(found)))
    cover = F.transform("_p", lambda x, j: F.coalesce(F.least(at("_p", j + 1) - x, F.lit(3)), F.lit(3)))
    repeats = F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0))
    less = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))
    return d.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_intersect("_w", F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        (less(F.col("_b"), ".") + less(F.col("_b"), ",")).cast("long").alias("n_stops"),
    )


@dataclass(frozen=True)
class Rule:
    """Bad where `bad` holds, good where `good` holds, else no vote; `needs` gates both."""

    name: str
    good: Column
    bad: Column
    needs: Column

    def vote(self) -> Column:
        return F.when(self.needs & self.bad, F.lit(0)).when(self.needs & self.good, F.lit(1))


def rules() -> list[Rule]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    ratio = lambda name: F.col(name) / words
    some = F.col("n_words") >= 20
    mean_word = F.col("word_chars") / words
    return [
        Rule("symbols_per_word", ratio("n_symbols") <= 0.05, ratio("n_symbols") > 0.2, F.col("n_words") > 0),
        Rule("symbol_share", F.col("n_symbols") <= 0.01 * F.col("word_chars"), F.col("n_symbols") > 0.03 * F.col("word_chars"), F.col("n_words") > 0),
        Rule("word_length", mean_word.between(3.0, 10.0), ~mean_word.between(2.0, 14.0), some),
        Rule("line_copies", F.col("n_dup_lines") / lines <= 0.1, F.col("n_dup_lines") / lines > 0.3, F.col("n_lines") >= 2),
        Rule("repeats", ratio("n_repeat_words") <= 0.15, ratio("n_repeat_words") > 0.35, some),
        Rule("stop_words", F.col("n_stop_words") >= 3, F.col("n_stop_words") == 0, some),
        Rule("punctuation", ratio("n_stops").between(0.01, 0.4), ~ratio("n_stops").between(0.002, 0.6), F.col("n_words") >= 50),
        Rule("length", F.col("n_words") >= 80, F.col("n_words") < 30, F.lit(True)),
    ]


@dataclass(frozen=True)
class Model:
    prior: float
    good_rate: tuple[float, ...]  # P(votes good | good document)
    bad_rate: tuple[float, ...]  # P(votes good | bad document)

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, g, b in zip(votes, self.good_rate, self.bad_rate):
            odds = odds + F.when(v == 1, math.log(g / b)).when(v == 0, math.log((1 - g) / (1 - b))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int | None, ...], int]], n_rules: int, rounds: int = 50, start: tuple[float, float, float] = (0.8, 0.95, 0.7)) -> Model:
    """Expectation-maximisation over vote patterns and their counts.

    Rates are held so that a good vote never speaks against a document: this
    fixes which of the two latent classes is called good. Counts are smoothed
    by ten pseudo-documents at the start values, which say that a bad document
    is bad in few respects: it gets good votes from most rules.
    """
    prior, good, bad = start[0], [start[1]] * n_rules, [start[2]] * n_rules
    weight = 10.0
    for _ in range(rounds):
        g_yes, g_all, b_yes, b_all = ([0.0] * n_rules for _ in range(4))
        mass = total = 0.0
        for votes, n in patterns:
            odds = math.log(prior / (1 - prior))
            for r, v in enumerate(votes):
                if v is not None:
                    odds += math.log(good[r] / bad[r]) if v else math.log((1 - good[r]) / (1 - bad[r]))
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            mass, total = mass + n * p, total + n
            for r, v in enumerate(votes):
                if v is not None:
                    g_all[r] += n * p
                    b_all[r] += n * (1 - p)
                    g_yes[r] += n * p * v
                    b_yes[r] += n * (1 - p) * v
        prior = min(0.99, max(0.05, (mass + weight * start[0]) / (total + weight)))
        for r in range(n_rules):
            good[r] = min(0.995, max(0.5, (g_yes[r] + weight * start[1]) / (g_all[r] + weight)))
            bad[r] = min(good[r] - 0.01, max(0.02, (b_yes[r] + weight * start[2]) / (b_all[r] + weight)))
    return Model(prior, tuple(good), tuple(bad))


def score(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, votes, posterior probability of being good, base_failed and kept."""
    base = cut(metrics(docs, id_col, text_col))
    all_rules = rules()
    names = [f"vote_{r.name}" for r in all_rules]
    voted = base.select("*", *(r.vote().alias(n) for r, n in zip(all_rules, names)))
    counted = voted.groupBy(*names).count().collect()  # 3**len(RULES) rows at most
    model = fit([(tuple(row[:-1]), row[-1]) for row in counted], len(names))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("posterior", model.posterior([F.col(n) for n in names])).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def query(spark, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
