"""Document quality by weak supervision, with DataFrame functions only.

Rules look at a text's counts and vote for good (+1), for bad (-1) or abstain (0). Nobody labels documents:
expectation-maximisation over how often each pattern of votes occurs in the corpus estimates, for good and
for bad documents, how each rule votes (its accuracies) and how common good documents are; the posterior
probability of being good then replaces a filter that all rules must pass. A pattern is one of
3 ** len(RULES), so its counts (summed on the executors) are bounded whatever the corpus.

Defined cases: a null text counts as empty; a text without words has no repeated words or lines, fails the
base rules (fewer than ``least_words`` words) and isn't kept; repeated rows are kept each; an empty table
gives an empty result; other columns of the input are kept by ``filter_documents`` and don't clash.

Everything is computed within a row: nothing but the votes' counts is shuffled. Equal 5-word windows are
found by 64-bit hashes that are sorted within the row, in n log n steps for texts of any length.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of words
KEEP_FROM = 0.5
SPACE = r"[ \t\n\x0B\f\r]"
#: Frequent function words of the languages that the rules know, besides which a text may be in any language.
FUNCTION_WORDS = "the of and to in a is that it for was on are as with be by this at from la de le les et des en un une du que qui dans pour pas el los las y se del por con der die das und ist nicht mit den von zu im für auf ein eine il che di non per".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    """How often a pattern of one character occurs."""
    return F.size(F.split(text, pattern, -1)) - 1


def repeated_words(words: Column) -> Column:
    """The number of words inside windows that occur at least twice in ``words``."""
    k = WINDOW

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(of_windows(w)))

    def of_windows(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, of_sorted)

    def of_sorted(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        again = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(j - 1, j)) | ((j < last) & same(j, j + 1)))
        return let(F.sort_array(F.transform(again, lambda j: F.get(s, j)["i"])), covered)

    def covered(at: Column) -> Column:
        n = F.size(at)
        return F.aggregate(
            F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, j: total + F.when(j == n - 1, k).otherwise(F.least(F.lit(k), F.get(at, j + 1) - F.get(at, j)))
        )

    return F.when(F.size(words) < k + 1, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def measures(text: Column) -> Column:
    """A struct of the counts that rules look at."""

    def of_words(text: Column, words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))
        long = lambda c: c.cast("long")
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(F.array_join(words, ""))).alias("word_chars"),
            long(count_of(text, r"[#*$%&|<>]")).alias("n_symbols"),
            long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
            long(repeated_words(words)).alias("n_repeat_words"),
            long(F.size(lines)).alias("n_lines"),
            long(F.size(F.array_distinct(words))).alias("n_distinct"),
            long(count_of(text, r"\p{Lu}")).alias("n_upper"),
            long(count_of(text, "!")).alias("n_shouts"),
            long(count_of(text, r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]")).alias("n_marks"),
            long(F.size(F.array_intersect(words, F.array(*map(F.lit, FUNCTION_WORDS))))).alias("n_function"),
        )

    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(F.array_remove(F.split(t, SPACE + "+", -1), ""), lambda w: of_words(t, w)))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules(q: Column) -> dict[str, Column]:
    """The vote of each rule on measures q."""
    n, chars = F.greatest(q["n_words"], F.lit(1)), F.greatest(q["word_chars"], F.lit(1))
    return {
        "symbols": _vote(q["n_symbols"] < 0.05 * n, q["n_symbols"] > 0.25 * n),
        "repeats": _vote(q["n_repeat_words"] == 0, q["n_repeat_words"] > 0.2 * n),
        "lines": _vote((q["n_dup_lines"] == 0) & (q["n_lines"] > 1), q["n_dup_lines"] > 0.5 * q["n_lines"]),
        "capitals": _vote(q["n_upper"] < 0.1 * chars, q["n_upper"] > 0.3 * chars),
        "variety": F.when(q["n_words"] < 30, F.lit(0)).otherwise(_vote(q["n_distinct"] * q["n_distinct"] > 4 * n, (q["n_distinct"] < 0.1 * n) & (q["n_distinct"] * q["n_distinct"] < 2 * n))),
        "word_length": _vote((chars > 3 * n) & (chars < 10 * n), (chars < 2 * n) | (chars > 15 * n)),
        "shouts": _vote(q["n_shouts"] < 0.02 * n, q["n_shouts"] > 0.2 * n),
        "marks": _vote(q["n_marks"] < 0.3 * n, q["n_marks"] > 0.4 * n + 5),
        "function_words": F.when(q["n_words"] < 30, F.lit(0)).otherwise(_vote(q["n_function"] >= 3, q["n_function"] == 0)),
    }


RULES = ("symbols", "repeats", "lines", "capitals", "variety", "word_length", "shouts", "marks", "function_words")


def base_failed(q: Column) -> Column:
    return (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])


class VoteModel:
    """How rules vote, if they don't abstain: the share of good documents, and accuracy[rule] = (P(-1 | bad), P(1 | good))."""

    def __init__(self, prior: float, accuracy: list[tuple[float, float]]):
        self.prior, self.accuracy = prior, accuracy

    def weights(self) -> list[list[float]]:
        """For each rule, the log odds of good that its votes -1, 0 and 1 add; who abstains adds none."""
        return [[log((1 - good) / bad), 0.0, log(good / (1 - bad))] for bad, good in self.accuracy]

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = log(self.prior / (1 - self.prior)) + sum(w[v + 1] for w, v in zip(self.weights(), votes))
        return 1 / (1 + exp(-max(-500.0, min(500.0, odds))))


def fit(counts: dict[tuple[int, ...], int], rounds: int = 200, smooth: float = 1.0) -> VoteModel:
    """Expectation-maximisation over counts of vote patterns; starts from: any vote for bad makes a bad document."""
    belief = {votes: 0.05 if -1 in votes else 0.95 for votes in counts}
    total, model = sum(counts.values()), VoteModel(0.5, [(0.5, 0.5)] * len(RULES))
    for _ in range(rounds):
        good = sum(belief[v] * c for v, c in counts.items())
        accuracy = []
        for k in range(len(RULES)):
            right = {1: smooth, -1: smooth}
            wrong = {1: smooth, -1: smooth}
            for votes, count in counts.items():
                if vote := votes[k]:
                    agrees = (belief[votes] if vote > 0 else 1 - belief[votes]) * count
                    right[vote] += agrees
                    wrong[vote] += count - agrees
            # of the bad documents it votes on, the share it calls bad; the same for good ones
            accuracy.append((right[-1] / (right[-1] + wrong[1]), right[1] / (right[1] + wrong[-1])))
        model = VoteModel((good + smooth) / (total + 2 * smooth), accuracy)
        after = {votes: model.posterior(votes) for votes in counts}
        moved = sum(abs(after[v] - belief[v]) * c for v, c in counts.items())
        belief = after
        if moved <= 1e-9 * max(total, 1):
            break
    return model


def vote_counts(measured: DataFrame, column: str) -> dict[tuple[int, ...], int]:
    """How often each pattern of votes occurs: at most 3 ** len(RULES) rows."""
    votes = rules(F.col(column))
    rows = measured.select(*(votes[r].alias(r) for r in RULES)).groupBy(*RULES).agg(F.count(F.lit(1)).alias("n")).collect()
    return {tuple(r[:-1]): r.n for r in rows}


def posterior(q: Column, model: VoteModel) -> Column:
    """The probability of a good document, rounded to 9 places, as a column."""
    votes, odds = rules(q), F.lit(log(model.prior / (1 - model.prior)))
    for rule, (bad, none, good) in zip(RULES, model.weights()):
        odds = odds + F.when(votes[rule] < 0, bad).when(votes[rule] > 0, good).otherwise(none)
    return F.round(1 / (1 + F.exp(-odds)), 9)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, quality (the posterior) of each row."""
    from .shared import written

    measured = written(docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("q")), "measures")
    model = fit(vote_counts(measured, "q"))
    q = F.col("q")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed, quality = base_failed(q), posterior(q, model)
    return measured.select("doc_id", *(q[n].alias(n) for n in names), failed.alias("base_failed"), (~failed & (quality >= KEEP_FROM)).alias("kept"), quality.alias("quality"))


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns. Rows are written with their measures, so that these are taken once."""
    from .shared import written

    name = "q"
    while name in docs.columns:
        name += "_"
    measured = written(docs.withColumn(name, measures(F.col(text_col))), "measured")
    model = fit(vote_counts(measured, name))
    q = F.col(name)
    return measured.where(~base_failed(q) & (posterior(q, model) >= KEEP_FROM)).drop(name)
