"""Quality rules as weak supervision, JVM side only.

Each rule votes junk, votes good or abstains. The latent class of a text is good or one of several kinds
of junk (KINDS); texts of one kind look good to the rules for the others. Expectation-maximisation over
the counts of vote patterns (at most 3^rules rows, whatever the corpus size) estimates the share of each
class and how often each rule that doesn't abstain votes junk on it. The posterior probability of the
good class replaces all-must-pass filtering: a vote of a rule that its fellows contradict doesn't sink a
text. Features come from one row's own text, so nothing but the pattern counts is shuffled.

Defined cases: null and empty texts have no words and fail the base rule; a null id is kept as
null; repeated rows are judged one by one; texts are judged whole, a very long one as one row in memory
(about 60 bytes a word); an empty table gives an empty result; columns of the input that clash with
names made here are untouched because only id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import whole, words, written

WINDOW = 8
#: Kinds of junk, by the rules that look for each.
KINDS = {"symbols": ("word_length", "symbols", "symbol_share"), "repetition": ("dup_lines", "repeats", "stutter", "vocabulary"), "shouting": ("capitals", "shouts")}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_upper", "n_shouts", "n_distinct"]


def _window_hashes(h: str) -> Column:
    n = F.size(h)
    each = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(WINDOW)]))
    return F.when(n >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))


def _covered(at: Column) -> Column:
    """Words covered by windows that start at the sorted positions."""
    return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)


def features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (all when None), then FEATURES as longs with the prefix `_q_`.

    Windows are compared by 64-bit hashes of their words; within one text a chance collision has a
    probability below 1e-10 even at 20,000 words.
    """
    own = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    names = list(docs.columns if keep is None else keep)
    back = [F.col(f"`{c}`") for c in names]
    a = docs.select(*own, whole(text).alias("_q_t"))
    b = a.select(*back, "_q_t", words(F.col("_q_t")).alias("_q_w"), F.filter(F.split("_q_t", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("_q_l"))
    c = b.select(*back, "_q_t", "_q_w", "_q_l", F.transform("_q_w", lambda w: F.xxhash64(w)).alias("_q_h"))
    d = c.select(*back, "_q_t", "_q_w", "_q_l", "_q_h", _window_hashes("_q_h").alias("_q_x"), F.array_join("_q_w", "").alias("_q_j"))
    repeats = F.size("_q_x") > F.size(F.array_distinct("_q_x"))
    pairs = F.when(repeats, F.sort_array(F.transform("_q_x", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    e = d.select(*back, "_q_t", "_q_w", "_q_l", "_q_h", "_q_j", pairs.alias("_q_s"))
    s = F.col("_q_s")
    again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    f = e.select(*back, "_q_t", "_q_w", "_q_l", "_q_h", "_q_j", F.sort_array(F.transform(again, lambda x: x["i"])).alias("_q_p"))
    h, j = F.col("_q_h"), F.col("_q_j")
    made = {
        "n_words": F.size("_q_w"),
        "word_chars": F.char_length(j),
        "n_symbols": F.when(j.rlike("[#*$%&|<>]"), F.regexp_count(j, F.lit("[#*$%&|<>]"))).otherwise(0),
        "n_dup_lines": F.size("_q_l") - F.size(F.array_distinct("_q_l")),
        "n_repeat_words": F.when(F.col("_q_p").isNull(), 0).otherwise(_covered(F.col("_q_p"))),
        "n_lines": F.size("_q_l"),
        "n_stutter": F.size(F.filter(h, lambda x, k: F.coalesce(F.get(h, k - 1) == x, F.lit(False)))),
        "n_upper": F.regexp_count(j, F.lit("[A-Z]")),
        "n_shouts": F.when(j.contains("!"), F.regexp_count(j, F.lit("!"))).otherwise(0),
        "n_distinct": F.size(F.array_distinct("_q_h")),
    }
    return f.select(*back, *[made[k].cast("long").alias(f"_q_{k}") for k in FEATURES])


def _rules() -> dict[str, tuple[Column, Column]]:
    """name -> (junk vote, good vote): elsewhere the rule abstains."""
    q = {k: F.col(f"_q_{k}") for k in FEATURES}
    n, chars, lines = (F.greatest(q[k], F.lit(1)) for k in ("n_words", "word_chars", "n_lines"))
    mean = q["word_chars"] / n
    return {
        "word_length": ((mean < 3.5) | (mean > 6.5), mean.between(4, 6)),
        "symbols": (q["n_symbols"] > 0.1 * n, q["n_symbols"] == 0),
        "symbol_share": (q["n_symbols"] > 0.03 * chars, q["n_symbols"] <= 0.005 * chars),
        "dup_lines": ((q["n_dup_lines"] >= 2) & (q["n_dup_lines"] > 0.3 * lines), (q["n_dup_lines"] == 0) & (lines >= 3)),
        "repeats": (q["n_repeat_words"] > 0.2 * n, (q["n_repeat_words"] == 0) & (n >= 50)),
        "stutter": (q["n_stutter"] > 0.1 * n, q["n_stutter"] <= 0.03 * n),
        "vocabulary": ((q["n_distinct"] < 0.55 * n) & (n >= 30), (q["n_distinct"] >= 0.65 * n) & (n >= 50)),
        "capitals": (q["n_upper"] > 0.3 * chars, q["n_upper"] <= 0.06 * chars),
        "shouts": (q["n_shouts"] > 0.3 * n, q["n_shouts"] == 0),
    }


def estimate(counts: dict[int, int], kinds: list[tuple[int, ...]], n_rules: int, rounds: int = 60, prior_weight: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns, coded in base 3 (0 junk, 1 abstains, 2 good).

    kinds: the rules that look for each kind of junk. Returns the share of each class (good, then the kinds)
    and, by class and rule, the rate of junk votes among its votes. Abstaining is no evidence: it says what a
    rule can't see, not what a text is. Prior counts are a share of the corpus (prior_weight), so results
    don't depend on its size; they say that rules are right more often than not and that most texts are good.
    """
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes.tolist()], float)
    vote = codes[:, None] // 3 ** np.arange(n_rules) % 3
    junk, good = (vote == 0).astype(float), (vote == 2).astype(float)
    mass0 = np.array([0.85, *[0.15 / len(kinds)] * len(kinds)])
    rate0 = np.full((len(kinds) + 1, n_rules), 0.03)
    for k, members in enumerate(kinds):
        rate0[k + 1, list(members)] = 0.8
    strength = prior_weight * max(1.0, n.sum())
    mass, rate = mass0, rate0
    for _ in range(rounds):
        log = np.log(mass) + junk @ np.log(rate).T + good @ np.log1p(-rate).T
        share = np.exp(log - log.max(axis=1, keepdims=True))
        share *= (n / share.sum(axis=1))[:, None]
        weight = share.sum(axis=0) + strength * mass0
        mass = weight / weight.sum()
        before = strength * mass0[:, None]
        rate = (share.T @ junk + before * rate0) / (share.T @ (junk + good) + before)
    return mass, rate


def fit(feats: DataFrame) -> Column:
    """Posterior probability of the good class, as a column over `_q_` features; one pass counts vote patterns."""
    rules = _rules()
    code = sum((F.when(junk, 0).when(good, 2).otherwise(1) * 3**j for j, (junk, good) in enumerate(rules.values())), F.lit(0))
    counts = {r[0]: r[1] for r in feats.groupBy(code.alias("c")).count().collect()}  # at most 3^9 rows
    names = list(rules)
    mass, rate = estimate(counts, [tuple(map(names.index, k)) for k in KINDS.values()], len(names))
    others = F.lit(0.0)
    for m, r in zip(mass[1:].tolist(), rate[1:].tolist()):  # odds of each kind of junk against good
        odds = F.lit(math.log(m / mass[0]))
        for (junk, good), x, y in zip(rules.values(), r, rate[0].tolist()):
            odds = odds + F.when(junk, math.log(x / y)).when(good, math.log((1 - x) / (1 - y))).otherwise(0.0)
        others = others + F.exp(odds)
    return 1 / (1 + others)


def base_failed() -> Column:
    return (F.col("_q_n_words") < 20) | (100 * F.col("_q_n_repeat_words") > 30 * F.col("_q_n_words"))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: id, the five counts, base_failed, kept, and the posterior as `quality`."""
    feats = written(features(docs, text, [id_col]), "quality")
    quality = fit(feats)
    return feats.select(
        F.col(f"`{id_col}`"),
        *[F.col(f"_q_{c}").alias(c) for c in FEATURES[:5]],
        base_failed().alias("base_failed"),
        (~base_failed() & (quality >= least)).alias("kept"),
        quality.alias("quality"),
    )


def keep_quality(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The input's rows and columns without those that the base rule or the posterior rejects.

    Rows are written once with their features, so these are made once; the patterns are counted from the few
    columns that they need.
    """
    feats = written(features(docs, text), "quality")
    return feats.filter(~base_failed() & (fit(feats) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
