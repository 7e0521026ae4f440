"""Quality rules by weak supervision: votes, accuracies by expectation-maximisation, posteriors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_row, table
from weftgraph.plans.lineage import stored

_SPACES = " \t\n\r\x0b\x0c"
#: What a code point counts as, in bits: white space 1, symbol 2, upper case 4, letter 8.
_FLAGS = np.array([1 * (chr(c) in _SPACES) + 2 * (chr(c) in "#*$%&|<>") + 4 * chr(c).isupper() + 8 * chr(c).isalpha() for c in range(0x30000)], np.uint8)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_once", "top_word")
BASE = MEASURES[:5]


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a whole text: words, their code points, symbols, lines equal to an earlier one,
    words inside of 3-word windows that come twice or more, lines with a word, upper-case letters,
    letters, words that differ, and how often the most frequent word comes."""
    if not text:
        return (0,) * len(MEASURES)
    flags = _FLAGS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(_FLAGS) - 1)]
    each = np.bincount(flags, minlength=16)
    spaces, symbols, upper, letters = (int(each[[f for f in range(16) if f >> b & 1]].sum()) for b in range(4))
    words = text.encode("utf-8", "surrogatepass").split()  # at the six ASCII white-space characters
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    ids = dict(zip(words, range(n), strict=True))
    at = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    top = int(np.bincount(at).max()) if n else 0
    return (n, len(text) - spaces, symbols, len(lines) - len(set(lines)), _in_repeats(at), len(lines), upper, letters, len(ids), top)


def _in_repeats(at: np.ndarray) -> int:
    """Words inside of 3-word windows that come twice or more; words are given as small numbers."""
    n = len(at)
    if n < 4:
        return 0
    pair = at[:-1] * n + at[1:]
    if n >= 1 << 20:  # keep the products within 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[: n - 2] * n + at[2:]
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    found = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
    padded = np.r_[False, False, found, False, False]
    return int((padded[2:] | padded[1:-1] | padded[:-2]).sum())


def measured(docs: DataFrame) -> DataFrame:
    """docs with the columns MEASURES (long) of the whole text; null and empty texts have zeros,
    repeats repeat, columns of these names are replaced, and an empty table gives no rows."""

    def each(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")

    udf = F.pandas_udf(each, ", ".join(f"{m} long" for m in MEASURES))
    d = docs.select(as_row(docs, *MEASURES), udf(F.col("text").cast("string")).alias("_m"))
    return d.select("_row.*", "_m.*")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def votes() -> dict[str, Column]:
    """Each rule votes -1 (drop), 1 (keep) or 0 (abstains), from the measures alone. None repeats the
    base rule. Words that differ are held against the root of all words, so that long texts, which
    come back to their words, aren't at a disadvantage."""
    c = {m: F.col(m).cast("double") for m in MEASURES}
    words, lines, letters = (F.greatest(c[m], F.lit(1.0)) for m in ("n_words", "n_lines", "n_letters"))
    length, symbols, upper = c["word_chars"] / words, c["n_symbols"] / words, c["n_upper"] / letters
    return {
        "word_length": _vote((length < 2) | (length > 15), (length >= 3) & (length <= 10)),
        "few_symbols": _vote(symbols > 0.1, symbols < 0.01),
        "letters_in_words": _vote(c["n_letters"] < 0.75 * c["word_chars"], c["n_letters"] > 0.9 * c["word_chars"]),
        "lower_case": _vote(upper > 0.4, upper < 0.2),
        "new_lines": _vote(c["n_dup_lines"] > 0.3 * lines, c["n_dup_lines"] < 0.1 * lines),
        "new_phrases": _vote(c["n_repeat_words"] > 0.3 * words, c["n_repeat_words"] < 0.15 * words),
        "varied_words": _vote((c["n_once"] < 3 * F.sqrt(words)) & (c["n_words"] >= 20), c["n_once"] > 4.5 * F.sqrt(words)),
        "no_single_word": _vote((c["top_word"] > 0.2 * words) & (c["n_words"] >= 20), c["top_word"] < 0.15 * words),
    }


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: tuple[float, float] = (0.4, 0.95), strength: float = 5.0) -> tuple[float, np.ndarray]:
    """Share of good texts and, for each class (0: bad, 1: good) and rule, the probabilities of the
    votes -1 and 1 where it votes, shape (2, rules, 2), by expectation-maximisation over distinct
    vote patterns. To abstain says nothing about a text.

    It starts from the share of a text's votes that say keep, the same for all rules, so that what a
    rule counts for in the end comes from how it agrees with the others. A prior worth `strength` texts holds that
    a rule is right about a bad text and about a good one with the probabilities `prior` (bad texts
    are bad in one way or two); it keeps the classes' meaning where votes are few.
    """
    voted = (patterns[:, :, None] == np.array([-1, 1])).astype(float)
    fails, passes = (patterns < 0).sum(axis=1), (patterns > 0).sum(axis=1)
    good = (passes + 0.5) / (passes + fails + 1)
    right = np.array([[prior[0], 1 - prior[0]], [1 - prior[1], prior[1]]])[:, None, :]
    share, table_ = 0.5, np.repeat(right, patterns.shape[1], axis=1)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        share = (weight[1].sum() + 0.5 * strength) / (counts.sum() + strength)
        table_ = np.einsum("yp,prv->yrv", weight, voted) + strength * right
        table_ /= table_.sum(axis=2, keepdims=True)
        old, good = good, posterior(patterns, share, table_)
        if np.abs(old - good).max(initial=0.0) < 1e-9:
            break
    return float(share), table_


def posterior(patterns: np.ndarray, share: float, table_: np.ndarray) -> np.ndarray:
    """The probability that a text with these votes is good."""
    logs = np.log(np.maximum(table_, 1e-12))
    of = [(logs[y, :, 0] * (patterns < 0) + logs[y, :, 1] * (patterns > 0)).sum(axis=1) for y in (0, 1)]
    return 1 / (1 + np.exp(np.clip(of[0] + np.log(1 - share) - of[1] - np.log(share), -700, 700)))


def judge(docs: DataFrame, threshold: float = 0.5, rules: dict[str, Column] | None = None) -> DataFrame:
    """judge_measured() of measured(docs); the texts are measured twice, as they aren't written."""
    return judge_measured(measured(docs), threshold, rules)


def judge_measured(docs: DataFrame, threshold: float = 0.5, rules: dict[str, Column] | None = None) -> DataFrame:
    """docs, which have the MEASURES, with base_failed, the posterior quality probability and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows.
    kept: not base_failed and a posterior of at least `threshold`. Votes of all texts are counted by
    pattern before anything reaches the driver, which gets at most 3 ** rules rows. A null text has
    no words. Rows are independent but for the accuracies; an empty table gives no rows. Input
    columns with the output's names are replaced.
    """
    rules = rules or votes()
    names = [f"_v_{r}" for r in rules]
    d = docs.select(as_row(docs, "base_failed", "posterior", "kept"), *[v.alias(n) for n, v in zip(names, rules.values(), strict=True)])
    code = sum(((F.col(n) + 1) * 3**i for i, n in enumerate(names)), F.lit(0)).cast("long")
    d = d.select("_row", code.alias("_code"))
    seen = d.groupBy("_code").agg(F.count("*").alias("n")).toPandas()
    codes = seen["_code"].to_numpy(np.int64)
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(names))], axis=1) if len(codes) else np.zeros((0, len(names)), np.int64)
    share, table_ = fit_label_model(patterns, seen["n"].to_numpy(float))
    found = docs.sparkSession.createDataFrame([(int(k), float(p)) for k, p in zip(codes, posterior(patterns, share, table_), strict=True)], "_code long, posterior double")
    base = (F.col("_row.n_words") < 50) | (100 * F.col("_row.n_repeat_words") > 50 * F.col("_row.n_words"))
    out = d.join(F.broadcast(found), "_code", "left")  # at most 3 ** rules rows
    return out.select("_row.*", base.alias("base_failed"), "posterior", (~base & (F.col("posterior") >= threshold)).alias("kept"))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge_measured() of all documents, measured once. A null or empty text has no words and so
    fails; ties can't arise, repeats repeat, an empty table gives no rows, and further columns play
    no part."""
    out = judge_measured(stored(measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")))
    return out.select("doc_id", *BASE, "base_failed", "kept", "posterior")
