"""Quality by weak supervision, in DataFrame functions only.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0). The
documents are counted by their pattern of votes, at most 3 ** rules patterns, and
expectation-maximisation over these counts estimates how often each rule says
good of a good and bad of a bad text, and the share of good texts. A document's
probability of being good follows from its votes and these rates.

Texts are read once: the counts are written and serve both the fit and the
verdict. A text stays one row throughout; nothing is exploded.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import store

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GRAM = 5
ROUNDS = 40
RULES = ("word_length", "symbols", "repeats", "duplicate_lines", "line_ends", "short_words", "variety")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * 5), " "), "")


def repeated_words(words: Column, gram: int = GRAM) -> Column:
    """Words inside runs of ``gram`` words that the text has twice or more.

    Only texts with a repeated hash are sorted; then neighbours of one hash are the repeats, and each adds the words
    up to the next one.
    """
    def spread(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(gram), F.coalesce(F.get(starts, k + 1) - p, F.lit(gram))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def starts(sorted_: Column) -> Column:
        again = F.filter(sorted_, lambda s, k: F.coalesce(s["h"] == F.get(sorted_, k - 1)["h"], F.lit(False))
                         | F.coalesce(s["h"] == F.get(sorted_, k + 1)["h"], F.lit(False)))
        return F.array_sort(F.transform(again, lambda s: s["i"]))

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(pairs, starts), spread))

    hashes = F.when(F.size(words) >= gram, F.transform(
        F.sequence(F.lit(0), F.size(words) - gram),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(gram)]))).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    return let(hashes, count)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per row: those of the base rules and those the voting rules use."""
    text = F.coalesce(text_col, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), repeated_words(words).cast("bigint").alias("n_repeat_words"),
                        F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
                        F.size(F.filter(words, lambda w: F.length(w) <= 3)).cast("bigint").alias("n_short"))

    def of_lines(found: Column) -> Column:
        ended = F.filter(found, lambda x: F.rtrim(x).substr(-1, 1).isin(".", "!", "?", ":", ";", '"'))
        return F.struct(F.size(found).cast("bigint").alias("n_lines"), F.size(ended).cast("bigint").alias("n_ended"),
                        (F.size(found) - F.size(F.array_distinct(found))).cast("bigint").alias("n_dup_lines"))

    return docs.select(
        F.col(id_col).alias("id"), F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(words_of(text), of_words).alias("w"), let(lines, of_lines).alias("l")).select(
        "id", "word_chars", "n_symbols", "w.*", "l.*")


def votes() -> Column:
    """The rules' votes as an array in the order of ``RULES``; a text without words gets none."""
    n, lines = F.col("n_words"), F.col("n_lines")

    def vote(good: Column, bad: Column, asked: Column = F.lit(True)) -> Column:
        return F.when((n > 0) & asked, F.when(bad, -1).when(good, 1)).otherwise(0)

    share = lambda part, whole: F.col(part) / F.greatest(whole, F.lit(1))
    mean, symbols, repeats = share("word_chars", n), share("n_symbols", n), share("n_repeat_words", n)
    same, ended, short = share("n_dup_lines", lines), share("n_ended", lines), share("n_short", n)
    variety = share("n_distinct", n)
    several, long_ = lines >= 2, n >= 20
    all_ = [vote(mean.between(4.0, 6.0), (mean < 3.5) | (mean > 7.0), long_),
            vote(symbols <= 0.02, symbols > 0.1),
            vote(repeats <= 0.05, repeats > 0.2),
            vote(same <= 0.1, same > 0.3, several),
            vote(ended >= 0.8, ended < 0.5),
            vote(short.between(0.15, 0.75), (short < 0.05) | (short > 0.9), long_),
            vote(variety >= 0.4, variety < 0.25, long_ & (n <= 2000))]
    return F.array(*[F.coalesce(v, F.lit(0)) for v in all_])


def fit(patterns: DataFrame, rules: int = len(RULES), rounds: int = ROUNDS) -> DataFrame:
    """One row ``share``, ``good``, ``bad`` from ``patterns (votes, n)``: share of good texts and, per rule, the chance
    to vote good on a good and bad on a bad text. A fold over rounds inside one row; patterns are few whatever the
    number of documents. One imagined vote of each kind keeps every chance between 0 and 1."""
    def half(vote: str, weight: str, rate: str) -> str:
        hit = f"aggregate(p, 0D, (a, x) -> a + IF(x.votes[j] = {vote}, x.n * {weight}, 0D))"
        all_ = f"aggregate(p, 0D, (a, x) -> a + IF(x.votes[j] <> 0, x.n * {weight}, 0D))"
        return f"transform(sequence(0, {rules - 1}), j -> ({hit} + {rate}) / ({all_} + 1D))"

    odds = ("aggregate(sequence(0, size(x.votes) - 1), ln(s.share / (1D - s.share)), (o, j) -> o + CASE x.votes[j] "
            "WHEN 1 THEN ln(s.good[j] / (1D - s.bad[j])) WHEN -1 THEN ln((1D - s.good[j]) / s.bad[j]) ELSE 0D END)")
    scored = f"transform(all_patterns, x -> named_struct('votes', x.votes, 'n', CAST(x.n AS DOUBLE), 'r', 1D / (1D + exp(-({odds})))))"
    step = ("transform(array(" + scored + "), p -> named_struct("
            "'share', (aggregate(p, 0D, (a, x) -> a + x.n * x.r) + 0.8D) / (aggregate(p, 0D, (a, x) -> a + x.n) + 1D), "
            f"'good', {half('1', 'x.r', '0.9D')}, 'bad', {half('-1', '(1D - x.r)', '0.6D')}))[0]")
    start = (f"named_struct('share', 0.8D, 'good', array_repeat(0.9D, {rules}), 'bad', array_repeat(0.6D, {rules}))")
    return (patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("all_patterns"))
            .select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, t) -> {step})").alias("model")).select("model.*"))


def posterior(share: float, good: list[float], bad: list[float], votes_col: str = "votes") -> Column:
    """Probability of a good text from its votes."""
    given, odds = F.col(votes_col), F.lit(log(share / (1 - share)))
    for j, (g, b) in enumerate(zip(good, bad)):
        odds = odds + F.when(given[j] == 1, log(g / (1 - b))).when(given[j] == -1, log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """Per row of ``docs``: ``id_col``, the counts, ``votes``, ``quality`` (probability of a good text),
    ``base_failed`` and ``kept``.

    A null text has no words and no lines: every rule abstains and the base rule fails. Repeated rows each come back
    and each count in the fit. Other columns are not looked at. An empty table gives an empty result.
    """
    rows = store(counts(docs, id_col, text_col).withColumn("votes", votes()), "quality")
    model = fit(rows.groupBy("votes").agg(F.count("*").alias("n"))).first()
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    quality = posterior(model["share"], model["good"], model["bad"])
    return (rows.withColumn("quality", quality).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (quality >= keep_at)).withColumnRenamed("id", id_col))
