"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how far to trust them.

Every rule looks at one document and votes 1 (good), -1 (bad) or 0 (abstains). The model has two classes and, for each
rule and class, the share of bad votes, which is free: EM estimates it from the votes alone, with a Beta prior of ten
pseudo-votes that a corpus of some size outweighs. The posterior probability of being good then replaces all-must-pass:
one bad vote of a rule that is often wrong, or that the other rules outvote, doesn't reject a document. For two classes
to be told apart by their votes, a defect must show in more than one rule, so the rules overlap (repeated windows and
variety of words; symbols, share of letters and words with letters; case and sentence ends; repeated lines).
Documents enter the estimate only through their vote pattern, so EM runs over a table of at most 3 ** rules rows (59,049),
whatever the size of the corpus. A document is kept if its posterior reaches `threshold` and the base rules don't fail it.

Edge cases: a null text has no words, so it is rejected; ties of the posterior at the threshold are kept; repeated
rows are judged alike; an empty table gives an empty table; extra columns stay untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged, text_of, whole, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\u000b\f\r"


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    threshold: float = 0.5
    iterations: int = 40
    tolerance: float = 1e-6
    #: Where EM starts: the share of good documents, and of bad votes on good and on bad ones.
    start_good: float = 0.85
    start_rates: tuple[float, float] = (0.02, 0.25)
    #: Pseudo-votes (bad, good) of every rule on good and on bad documents, and pseudo-documents (good, bad).
    prior_on_good: tuple[float, float] = (0.2, 9.8)
    prior_on_bad: tuple[float, float] = (2.0, 8.0)
    prior_classes: tuple[float, float] = (8.5, 1.5)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more; in n log n, without a set per document."""

    def covered(windows: Column) -> Column:
        def from_ordered(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            again = F.filter(
                F.transform(
                    pairs,
                    lambda x, j: F.when(
                        ((j > 0) & (F.get(pairs, j - 1)["h"] == x["h"]))
                        | ((j < last) & (F.get(pairs, j + 1)["h"] == x["h"])),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return let(
                F.sort_array(again),
                lambda at: F.aggregate(
                    at,
                    F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
                    lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["at"])).alias("n"), i.alias("at")),
                    lambda s: s["n"],
                ),
            )

        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(ordered, from_ordered)
        )

    windows = let(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`row`, a struct of the columns to keep, and what the rules need."""
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    with_words = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return (
        docs.select(whole(keep).alias("row"), text_of().alias("text"))
        .withColumns({"words": words_of(text), "lines": with_words})
        .select(
            "row",
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).alias("n_distinct"),
            F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).alias("n_lettered"),
            F.size(F.filter(words, lambda w: F.substring(w, -1, 1).isin(".", "!", "?"))).alias("n_stops"),
            F.length(F.regexp_replace(text, r"[^\p{Ll}]+", "")).alias("n_lower"),
            F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("n_upper"),
        )
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def rules(config: QualityConfig) -> dict[str, Column]:
    """Name -> vote; the rules read measured() columns only."""
    n, w = F.col("n_words"), F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    repeat, symbols, dup = F.col("n_repeat_words") / w, F.col("n_symbols") / w, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    length, lettered, stops = F.col("word_chars") / w, F.col("n_lettered") / w, F.col("n_stops") / w
    cased = (F.col("n_lower") + F.col("n_upper")).cast("double")
    upper, share = F.col("n_upper") / F.greatest(cased, F.lit(1.0)), cased / F.greatest(F.col("word_chars"), F.lit(1))
    # Distinct words grow as a power of all words; the power doesn't depend on the length, as their ratio would.
    variety = F.log(F.greatest(F.col("n_distinct"), F.lit(1)).cast("double")) / F.log(F.greatest(w, F.lit(2.0)))
    return {
        "length": _vote(n < config.min_words, (n >= 2 * config.min_words) & (n <= 100_000)),
        "repetition": _vote(repeat > 0.5, repeat < 0.15),
        "variety": _vote((n >= 20) & (variety < 0.8), (n >= 20) & (variety > 0.9)),
        "lines": _vote(dup > 0.5, (F.col("n_lines") > 1) & (dup < 0.3)),
        "symbols": _vote(symbols > 0.2, symbols < 0.05),
        "letter_share": _vote((cased > 0) & (share < 0.75), share > 0.9),
        "letters": _vote(lettered < 0.75, lettered > 0.9),
        "word_length": _vote((length < 3) | (length > 10), (length >= 3.5) & (length <= 8)),
        "case": _vote((cased > 0) & (upper > 0.35), (cased > 0) & (upper < 0.2)),
        "sentences": _vote((n > 20) & (stops > 0.5), (stops > 0.0) & (stops < 0.35)),
    }


def posterior(model: Column, votes: Column) -> Column:
    """Probability that a document with these votes (an array) is good; an abstention says nothing."""

    def weight(i: Column, vote: Column) -> Column:
        g, b = F.get(model["on_good"], i), F.get(model["on_bad"], i)
        return F.when(vote == -1, F.log(g / b)).when(vote == 1, F.log((1 - g) / (1 - b))).otherwise(0.0)

    log_odds = F.aggregate(
        F.transform(votes, lambda vote, i: weight(i, vote)), F.log(model["good"] / (1 - model["good"])), lambda s, x: s + x
    )
    return 1 / (1 + F.exp(-log_odds))


def fit(votes: DataFrame, names: list[str], config: QualityConfig) -> DataFrame:
    """One row, `model`: the share of good documents (good) and every rule's share of bad votes (on_good, on_bad).

    The counted vote patterns are one row of at most 3 ** rules entries, in which one expression iterates."""
    counted = votes.groupBy(*[F.col(r).cast("int").alias(r) for r in names]).agg(F.count(F.lit(1)).alias("n"))
    packed = counted.agg(F.sort_array(F.collect_list(F.struct(F.array(*names).alias("votes"), "n"))).alias("patterns"))

    def state(good: Column, on_good: Column, on_bad: Column, moved: Column) -> Column:
        return F.struct(good.alias("good"), on_good.alias("on_good"), on_bad.alias("on_bad"), moved.alias("moved"))

    def shares(parts: Column, kind: str, prior: tuple[float, float]) -> Column:
        def share(rule: Column) -> Column:
            sums = F.aggregate(
                parts,
                F.struct(F.lit(prior[0]).alias("bad"), F.lit(float(sum(prior))).alias("all")),
                lambda s, p: F.struct(
                    (s["bad"] + F.when(F.get(p["votes"], rule) == -1, p[kind]).otherwise(0.0)).alias("bad"),
                    (s["all"] + F.when(F.get(p["votes"], rule) != 0, p[kind]).otherwise(0.0)).alias("all"),
                ),
            )
            return let(sums, lambda x: x["bad"] / x["all"])

        return F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), share)

    def again(model: Column) -> Column:
        def parted(p: Column) -> Column:
            return let(
                posterior(model, p["votes"]),
                lambda q: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * q).alias("good"), (p["n"] * (1 - q)).alias("bad")),
            )

        def maximized(parts: Column) -> Column:
            good = F.aggregate(parts, F.lit(config.prior_classes[0]), lambda s, p: s + p["good"])
            total = F.aggregate(parts, F.lit(float(sum(config.prior_classes))), lambda s, p: s + p["n"])
            new = state(good / total, shares(parts, "good", config.prior_on_good), shares(parts, "bad", config.prior_on_bad), F.lit(0.0))
            farthest = lambda x, kind: F.array_max(F.zip_with(x[kind], model[kind], lambda a, b: F.abs(a - b)))
            return let(
                new,
                lambda x: state(
                    x["good"], x["on_good"], x["on_bad"],
                    F.greatest(F.abs(x["good"] - model["good"]), farthest(x, "on_good"), farthest(x, "on_bad")),
                ),
            )

        return let(F.transform("patterns", parted), maximized)

    start = state(
        F.lit(config.start_good),
        *[F.array_repeat(F.lit(x), len(names)) for x in config.start_rates],
        F.lit(1.0),
    )
    steps = F.sequence(F.lit(1), F.lit(config.iterations))
    fitted = F.aggregate(steps, start, lambda model, _: F.when(model["moved"] < config.tolerance, model).otherwise(again(model)))
    return packed.select(fitted.alias("model"))


def judged(docs: DataFrame, keep: list[str], config: QualityConfig = QualityConfig()) -> DataFrame:
    """measured() with a vote_ column per rule, posterior, base_failed and kept.

    The rules read every text once: counts and kept columns are a written table, which both the fit and the verdict read."""
    named = {f"vote_{k}": v for k, v in rules(config).items()}
    voted = staged(measured(docs, keep), "quality-documents").withColumns(named)
    names, n = list(named), F.col("n_words")
    fitted = fit(voted, names, config).first()["model"]
    model = F.struct(
        F.lit(fitted["good"]).alias("good"), *[F.array(*map(F.lit, fitted[k])).alias(k) for k in ("on_good", "on_bad")]
    )
    failed = (n < config.min_words) | (100 * F.col("n_repeat_words") > config.max_repeat_percent * n)
    return voted.withColumns({"posterior": posterior(model, F.array(*names)), "base_failed": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= config.threshold)
    )


def filter_quality(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judged(docs, docs.columns, config).filter("kept").select("row.*")


def quality_report(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, the counts, base_failed, kept, posterior."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(docs, ["doc_id"], config).select("row.doc_id", *counts, "base_failed", "kept", "posterior")
