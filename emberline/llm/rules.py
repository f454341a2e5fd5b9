"""Quality rules by weak supervision, in DataFrame operations alone.

Each rule votes good (1) or bad (0) or abstains.  Expectation-maximisation over the counts of the patterns of votes (as
many as there are combinations of votes, however many documents) estimates how often each rule votes each way on good
and on bad documents; a document's verdict is the posterior probability that it is good, given its votes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.shared import WHITE, written

WINDOW = 8
_TRIM = "\x20\x09\x0a\x0b\x0c\x0d"
#: (rule, SQL that votes bad, SQL that votes good; else it abstains).  Rates are per word unless named otherwise.  That a
#: detector of junk finds none says little, so it abstains; only the rule that looks for prose votes good.
RULES = [
    ("symbols", "n_symbols > 0.1 * n_words", "false"),
    ("capitals", "n_upper > 0.3 * word_chars", "false"),
    ("shouts", "n_shouts > 0.1 * n_words", "false"),
    ("repeats", "n_repeat_words > 0.2 * n_words", "false"),
    ("same_words", "n_distinct_words < 0.15 * least(n_words, 1000)", "false"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "false"),
    ("prose", "n_stops < 0.01 * n_words", "n_stops > 0.03 * n_words AND n_symbols <= 0.01 * n_words"),
]


def _words() -> Column:
    text = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(_TRIM))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, WHITE))


def _count(pattern: str) -> Column:
    """Characters of the text in a class, by what is left when all others go."""
    return F.char_length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"[^{pattern}]+", "")).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read, for each row; a null text has none of anything."""
    rows = docs.select(
        "doc_id",
        _words().alias("words"),
        F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.char_length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), WHITE, "")).cast("long").alias("word_chars"),
        _count("#*$%&|<>").alias("n_symbols"), _count(r"\p{Lu}").alias("n_upper"), _count("!?").alias("n_shouts"), _count(".,;:").alias("n_stops"),
    )
    n = F.size("words")
    # Every window of WINDOW words, hashed: the i-th of WINDOW shifted copies of the words, zipped.
    shifted = [F.slice("words", k + 1, F.greatest(n - WINDOW + 1, F.lit(0))).alias(f"w{k}") for k in range(WINDOW)]
    windows = F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(w))
    rows = rows.withColumn("windows", windows)
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    # Where a window comes twice: windows in order of hash, kept if equal to a neighbour, then their starts in order.
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(some, ordered))
    neighbour = F.arrays_zip(F.col("ordered").alias("own"), F.slice("ordered", 2, F.size("ordered")).alias("after"), F.concat(F.array(F.lit(None)), F.slice("ordered", 1, F.size("ordered") - 1)).alias("before"))
    twice = F.filter(neighbour, lambda x: F.coalesce(x["own"]["h"] == x["after"]["h"], F.lit(False)) | F.coalesce(x["own"]["h"] == x["before"]["h"], F.lit(False)))
    rows = rows.withColumn("starts", F.when(some, F.array_sort(F.transform(twice, lambda x: x["own"]["i"]))))
    gaps = F.zip_with(F.slice("starts", 2, F.size("starts")), F.slice("starts", 1, F.size("starts") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    repeated = F.when(some, F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g)).otherwise(F.lit(0))
    return rows.select(
        "doc_id", n.cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated.cast("long").alias("n_repeat_words"),
        "n_upper", "n_shouts", "n_stops", F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
    )


def _vote(bad: str, good: str) -> Column:
    return F.when(F.expr(bad), F.lit(0)).when(F.expr(good), F.lit(1)).otherwise(F.lit(2)).cast("tinyint")


def _posterior(prior: float, odds: dict[str, list[float]]) -> Column:
    """Probability of good, from the log likelihood ratio of each rule's vote (bad, good, abstains)."""
    total = F.lit(math.log(prior / (1 - prior)))
    for name, by_vote in odds.items():
        total = total + F.element_at(F.array(*[F.lit(x) for x in by_vote]), F.col(name).cast("int") + 1)
    return 1 / (1 + F.exp(-total))


#: Documents of either kind that are taken as seen before the data, and how a rule that votes is taken to have judged them.
SEEN_GOOD, SEEN_BAD, TRUST = 8.0, 2.0, 0.9

#: One expectation-maximisation over ``pats``, the patterns (votes, n).  m: the model; p: each pattern's posterior; s: a
#: rule's votes on good and bad documents; transform(array(x), y -> ...)[0] names a value.
_EM = """
aggregate(sequence(1, {rounds}), named_struct('prior', {prior}D, 'odds', array_repeat(array(-ln({odds}D), ln({odds}D), 0D), {rules})),
  (m, i) -> transform(array(transform(pats, x -> 1D / (1D + exp(-(ln(m.prior / (1D - m.prior)) + aggregate(zip_with(x.votes, m.odds, (v, o) -> o[v]), 0D, (a, b) -> a + b)))))), p ->
    named_struct(
      'prior', ({good}D + aggregate(zip_with(pats, p, (x, q) -> x.n * q), 0D, (a, b) -> a + b)) / ({good}D + {bad}D + aggregate(pats, 0D, (a, x) -> a + x.n)),
      'odds', transform(sequence(0, {rules} - 1), r -> transform(array(transform(sequence(0, 2), v -> named_struct(
          'g', {good}D * array({missed}D, {trust}D, 0.1D)[v] + aggregate(zip_with(pats, p, (x, q) -> if(x.votes[r] = v, x.n * q, 0D)), 0D, (a, b) -> a + b),
          'b', {bad}D * array({trust}D, {missed}D, 0.1D)[v] + aggregate(zip_with(pats, p, (x, q) -> if(x.votes[r] = v, x.n * (1D - q), 0D)), 0D, (a, b) -> a + b)))), s ->
        transform(s, y -> ln(y.g / aggregate(s, 0D, (a, z) -> a + z.g)) - ln(y.b / aggregate(s, 0D, (a, z) -> a + z.b))))[0])))[0])
"""


def estimate(votes: DataFrame, rounds: int = 25) -> tuple[float, dict[str, list[float]]]:
    """The share of good documents, and each rule's log likelihood ratios (bad, good, abstains), by expectation-maximisation.

    It starts from rules that are right TRUST of the times they vote, which settles what good means.  The patterns of
    votes, 3 to the number of rules at most, are summed where documents stand; their table is one row.
    """
    names = [r[0] for r in RULES]
    patterns = votes.groupBy(F.array(*[F.col(name).cast("int") for name in names]).alias("votes")).agg(F.count("*").cast("double").alias("n"))
    whole = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("pats"))
    em = _EM.format(rounds=rounds, rules=len(names), prior=SEEN_GOOD / (SEEN_GOOD + SEEN_BAD), odds=TRUST / (1 - TRUST), trust=TRUST, missed=round(1 - TRUST, 9), good=SEEN_GOOD, bad=SEEN_BAD)
    model = whole.select(F.expr(em).alias("m")).first()["m"]
    return model["prior"], dict(zip(names, model["odds"], strict=True))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior and votes of each row.

    base_failed: under 20 words, or over 30 % of the words in 8-word windows that the text has twice.  kept: not that,
    and a posterior of ``least`` or more.  Null and empty texts have no words and fail the base.  Repeated rows are each
    judged; an empty table gives an empty result; other columns are not read.
    """
    counted = written(measures(docs), "rule-measures")
    votes = counted.select("*", *[_vote(bad, good).alias(name) for name, bad, good in RULES])
    prior, odds = estimate(votes.filter("n_words >= 20"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    p = _posterior(prior, odds)
    return votes.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (p >= least)).alias("kept"), p.alias("posterior"), *[F.col(r[0]).alias(f"vote_{r[0]}") for r in RULES])
