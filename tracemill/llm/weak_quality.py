"""Quality rules by weak supervision.

Each rule looks at the whole text and votes good, bad or abstains.  No rule
decides alone: expectation-maximisation estimates from agreement over all
documents how accurate each rule is, without labels, and a document's posterior
probability of good quality replaces all-must-pass filtering.

EM needs only how often each pattern of votes occurs.  That table has at most
3 ** len(RULES) rows however large the corpus is: nothing but counts is
shuffled, and the EM itself is a few matrix products on the driver.  To score,
the votes are kept, a number a document; to filter, the texts are read a second
time where they are, which moves none of them.

Defined cases: a null or empty text, or one without words, is bad on the
`length` rule and abstains elsewhere; a very long text is scanned whole; rows
that repeat are each scored, alike; an empty table gives no rows; further
columns of any name are kept by `filter_quality`, and ids may be of any type.
Text is measured in words between ASCII white space.  Rules made for words in
Latin letters abstain on other texts: `function_words` where most letters are
of another script, `word_length` and `sentences` where many are of a script
that has no spaces or stops of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracemill.llm import textkit as tk
from tracemill.llm.cluster import prepare, settle
from tracemill.llm.columns import fresh, own, quoted

#: name: (measure, bad below, good from, good to, bad above); None: no such side.
RULES: dict[str, tuple[str, float | None, float, float, float | None]] = {
    "length": ("words", 1, 20, 1e9, None),
    "word_length": ("mean_word", 1.5, 3.0, 9.0, 16.0),
    "letters": ("letter_share", 0.60, 0.90, 1.0, None),
    "symbols": ("symbol_share", None, 0.0, 0.005, 0.03),
    "capitals": ("capital_share", None, 0.0, 0.10, 0.30),
    "shouting": ("bang_share", None, 0.0, 0.01, 0.10),
    "same_word": ("stutter_share", None, 0.0, 0.02, 0.20),
    "variety": ("distinct_share", 0.12, 0.25, 1.0, None),
    "same_line": ("line_repeat_share", None, 0.0, 0.05, 0.30),
    "sentences": ("sentence_words", None, 2.0, 40.0, 80.0),
    "columns": ("bar_share", None, 0.0, 0.01, 0.10),
    "function_words": ("function_share", 0.01, 0.06, 0.9, None),
}
NAMES = tuple(RULES)
ABSTAIN, BAD, GOOD = 0, 1, 2
ITERATIONS, SMOOTHING, TOLERANCE = 200, 1.0, 1e-9
KEEP_FROM = 0.5

#: Everyday words of English, German, French and Spanish, Portuguese and Italian.
FUNCTION_WORDS = (
    "the of and to a in is it that for was with as be on by this are at from or an not have you he she they we but his her which will would there their been has had were "
    "der die das und ist nicht ein eine mit für auf den im von zu dem des sich auch als an es bei aus nach wie über er sie "
    "le la les de du des et un une est que qui dans pour pas sur avec au aux ce il elle en par ne se plus "
    "el los las del y una por con para su al lo como más o es se no "
    "os um uma não com em no na do da il di che è per non sono con si"
).split()
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC2:0xF5] = 1
# These begin punctuation, symbols and pictures.
_LETTER[[0xE2, 0xEE, 0xF0]] = 0
#: First bytes of letters beyond Latin ones, and of those of scripts written without spaces (Thai, Khmer, Chinese, Japanese and the like).
_OTHER, _DENSE = np.zeros(256, np.int64), np.zeros(256, np.int64)
# Not E2, EE, EF and F0: punctuation, symbols, pictures.
_OTHER[0xCD:0xE2] = _OTHER[0xE3:0xEE] = 1
_DENSE[[0xE0, 0xE1, *range(0xE3, 0xEA)]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 1
_SEEN = np.ones(256, np.int64)
_SEEN[tk.SPACE] = 0
_SEEN[0x80:0xC0] = 0


def _per_row(counted: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(counted) + 1, np.int64)
    np.cumsum(counted, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the weight of items equal to an earlier item of the row."""
    key = tk.mix(h ^ tk.mix(row.astype(tk.U) * tk.GOLD))
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return np.bincount(row[later], weights=weight[later], minlength=rows)


def _function_hashes() -> np.ndarray:
    words = [v for w in FUNCTION_WORDS for v in {w, w.capitalize()}]
    data, off = tk.buffers(pa.array(words))
    return np.unique(tk.Words(data, off).hash)


_FUNCTION = _function_hashes()


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """What the rules look at, for each text of the column; NaN where there is nothing to measure."""
    parts: list[dict[str, np.ndarray]] = []
    for _, _, data, off in tk.chunks(column):
        w = tk.Words(data, off)
        n = np.diff(w.first).astype(float)
        some = np.where(n > 0, n, np.nan)
        seen = _per_row(_SEEN[data], off)
        shown = np.where(seen > 0, seen, np.nan)
        letters = _per_row(_LETTER[data], off)
        latin = 2 * _per_row(_OTHER[data], off) <= letters
        spaced = 4 * _per_row(_DENSE[data], off) <= letters
        # Capitals outside ASCII: C3 80..C3 9E, the Latin-1 ones.
        upper = _UPPER[data]
        if len(data) > 1:
            upper[1:] += (data[:-1] == 0xC3) & (data[1:] < 0x9F)
        last = data[w.end - 1] if len(w) else np.zeros(0, np.uint8)
        same = np.zeros(len(w), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
        bar = (w.end - w.start == 1) & (last == ord("|"))
        line_kind = np.ones(256, bool)
        line_kind[10] = False
        lines = tk.Words(data, off, line_kind)
        stops = np.bincount(w.row[np.isin(last, [46, 33, 63])], minlength=w.rows)
        parts.append({
            "words": n,
            "mean_word": np.where(spaced, seen / some, np.nan),
            "letter_share": letters / shown,
            "symbol_share": _per_row(_SYMBOL[data], off) / shown,
            "capital_share": _per_row(upper, off) / np.where(letters > 0, letters, np.nan),
            "bang_share": np.bincount(w.row[last == 33], minlength=w.rows) / some,
            "stutter_share": np.bincount(w.row[same], minlength=w.rows) / some,
            "distinct_share": 1 - _repeats(w.row, w.hash, np.ones(len(w)), w.rows) / some,
            "line_repeat_share": _repeats(lines.row, lines.hash, (lines.end - lines.start).astype(float), lines.rows) / np.where(n > 0, np.maximum(1, np.bincount(lines.row, weights=lines.end - lines.start, minlength=lines.rows)), np.nan),
            "sentence_words": np.where(latin & spaced, some / np.maximum(1, stops), np.nan),
            "function_share": np.bincount(w.row[_FUNCTION[np.minimum(np.searchsorted(_FUNCTION, w.hash), len(_FUNCTION) - 1)] == w.hash], minlength=w.rows) / np.where((n >= 12) & latin, n, np.nan),
            "bar_share": np.bincount(w.row[bar], minlength=w.rows) / some,
        })
        # A long text uses its common words again: compare with what its length leads to expect.
        parts[-1]["distinct_share"] = parts[-1]["distinct_share"] * np.maximum(1.0, (n / 200.0) ** 0.4)
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (parts[0] if parts else {m for m, *_ in RULES.values()})}


def votes(column: pa.Array) -> np.ndarray:
    """rows x rules: ABSTAIN, BAD or GOOD."""
    m = measures(column)
    out = np.full((len(column), len(RULES)), ABSTAIN, np.int8)
    for j, (what, bad_below, good_from, good_to, bad_above) in enumerate(RULES.values()):
        x = m[what]
        out[(x >= good_from) & (x <= good_to), j] = GOOD
        if bad_below is not None:
            out[x < bad_below, j] = BAD
        if bad_above is not None:
            out[x > bad_above, j] = BAD
    return out


_PLACE = 3 ** np.arange(len(RULES), dtype=np.int64)


def encode(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ _PLACE


def decode(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // _PLACE[None, :] % 3).astype(np.int8)


def _encoded(text: pa.Array) -> pa.Array:
    return pa.array(encode(votes(text)), pa.int64())


#: Called non-deterministic so that no inferred filter evaluates it a second time.
_code = F.arrow_udf(_encoded, LongType()).asNondeterministic()


def fit(pattern: np.ndarray, count: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns: (share of good documents, accuracies, posterior of each pattern).

    A rule's vote depends on the class alone: theta[y, rule, vote] is the
    chance of the vote, when the rule does vote, given class y; to abstain says
    nothing.  The start is whether any rule votes bad, so class 1 stays the
    good one.  A rule's accuracy is its chance of being right when it votes.
    """
    v = decode(pattern)
    one_hot = np.stack([v == k for k in (BAD, GOOD)], 2).astype(float)
    bad = (v == BAD).sum(1)
    q = np.where(bad >= 2, 0.05, np.where(bad == 1, 0.3, 0.95))
    weight = count.astype(float)
    prior, theta = 0.5, np.zeros((2, len(RULES), 2))
    for _ in range(ITERATIONS):
        before = q
        prior = (weight @ q + SMOOTHING) / (weight.sum() + 2 * SMOOTHING)
        for y, p in ((0, 1 - q), (1, q)):
            t = np.einsum("p,prk->rk", weight * p, one_hot) + SMOOTHING
            theta[y] = t / t.sum(1, keepdims=True)
        score = np.einsum("prk,yrk->yp", one_hot, np.log(theta))
        odds = np.log(prior) - np.log1p(-prior) + score[1] - score[0]
        q = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.max(np.abs(q - before), initial=0) < TOLERANCE:
            break
    return prior, prior * theta[1, :, 1] + (1 - prior) * theta[0, :, 0], q


def with_code(docs: DataFrame, name: str) -> DataFrame:
    return docs.select(*own(docs), _code(quoted("text").cast("string")).alias(name))


def posteriors(coded: DataFrame, name: str) -> DataFrame:
    """(code, quality) for each pattern of votes that occurs; at most 3 ** len(RULES) rows."""
    counted = coded.groupBy(quoted(name).alias("code")).count().toPandas().sort_values("code")
    pattern, count = counted["code"].to_numpy(np.int64), counted["count"].to_numpy(np.int64)
    q = fit(pattern, count)[2] if len(pattern) else np.zeros(0)
    return coded.sparkSession.createDataFrame(pd.DataFrame({"code": pattern, "quality": np.round(q, 6)}), "code long, quality double")


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, each rule's vote (-1 bad, 0 abstains, 1 good), quality in 0..1 and keep."""
    prepare(docs.sparkSession)
    # The votes are a number a document: kept, so that the texts are read once.
    coded = settle(with_code(docs.select("doc_id", "text"), "votes").drop("text"))
    scored = coded.join(F.broadcast(posteriors(coded, "votes")), F.col("votes") == F.col("code"))
    vote = [
        F.when(F.floor(F.col("votes") / F.lit(int(p))) % 3 == GOOD, 1).when(F.floor(F.col("votes") / F.lit(int(p))) % 3 == BAD, -1).otherwise(0).alias(f"vote_{r}")
        for r, p in zip(NAMES, _PLACE)
    ]
    return scored.select("doc_id", *vote, "quality", (F.col("quality") >= KEEP_FROM).alias("keep"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents of posterior quality KEEP_FROM or more, with all their columns."""
    prepare(docs.sparkSession)
    votes, code, quality = fresh(docs, "votes", "code", "quality")
    learnt = posteriors(with_code(docs.select("text"), "votes"), "votes").toDF(code, quality).filter(F.col(quality) >= KEEP_FROM).select(code)
    return with_code(docs, votes).join(F.broadcast(learnt), F.col(votes) == F.col(code)).select(*own(docs))


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
