"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled web text is labelled documents with their labels unread, so no
negative is ever used. With a class prior p, estimated from the scores of positives and unlabelled, the non-negative unbiased risk

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])

is minimised for the sigmoid loss l(g) = 1 / (1 + exp(g)), which is bounded, so that far-off rows don't outweigh others; while
its second part is below zero the step goes against that part alone. The model is additive: statistics of a text, among them
how much its hashed n-grams of bytes and words occur in positives rather than in all, each cut into bins at quantiles and at
even distances, with one weight a bin, so it is small and can't memorise.

The model is fitted on the driver from a sample of labelled rows: at most ``most`` positives and ``most`` unlabelled. All rows
are then scored in one pass.

Defined results: a null text counts as empty and gets a score like any other; a very long text is described whole; a null
doc_id is never labelled nor held out; labels other than 0 and 1 are ignored, of repeated labels the mean decides, of repeated
ids the text with the smallest hash is learned from; without positives all scores are the prior, 0.5 if that is unknown;
repeated rows get equal scores; an empty table gives an empty result; other columns are kept by ``keep`` and dropped by
``score``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.llm.common import hold, materialize, remove, ship, text_or_empty


def _classes() -> np.ndarray:
    """Byte classes as columns: letters, upper case, digits, spaces, line ends, sentence marks, other ASCII, beyond ASCII."""
    b = np.arange(256)
    chars = np.array([chr(x) for x in b])
    ascii_ = b < 128
    letter = np.array([c.isalpha() for c in chars]) & ascii_
    upper = np.array([c.isupper() for c in chars]) & ascii_
    digit = np.array([c.isdigit() for c in chars]) & ascii_
    space, line = b == 32, b == 10
    mark = np.isin(chars, list(".,;:'\"-()?"))
    other = ascii_ & (b > 32) & ~letter & ~digit & ~mark
    return np.stack([letter, upper, digit, space, line, mark, other, ~ascii_], axis=1).astype(np.float64)


CLASSES = _classes()
NAMES = (
    "letters", "upper", "digits", "spaces", "lines", "marks", "others", "beyond", "top_other", "log_words", "word_length", "distinct_words",
    "adjacent_equal", "upper_words", "distinct_lines", "words_a_line", "packed", "longest_word", "alpha_words", "entropy",
)


def features(text: str) -> list[float]:
    """Statistics of one text, by ``NAMES``; zeros for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    w = text.split()
    if not w:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist / len(raw)
    live = share[share > 0]
    n = len(w)
    lines = [x for x in text.split("\n") if x]
    return [
        *(share @ CLASSES).tolist(),
        float((share * CLASSES[:, 6]).max()),
        float(np.log1p(n)),
        len(text) / n,
        len(set(w)) / n,
        sum(map(str.__eq__, w, w[1:])) / n,
        sum(map(str.isupper, w)) / n,
        len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        len(zlib.compress(raw, 1)) / len(raw),
        float(max(map(len, w))),
        sum(map(str.isalpha, w)) / n,
        float(-(live * np.log2(live)).sum()),
    ]


#: Kinds of hashed n-grams and the bits of their buckets: three bytes in lower case, a word, two words.
GRAMS = (("bytes", 12), ("word", 15), ("words", 16))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = [np.uint64(xxhash.xxh64_intdigest(b"mix", k) | 1) for k in range(4)]


@lru_cache(8)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def buckets(text: str) -> list[np.ndarray]:
    """The bucket of each n-gram of a text, by ``GRAMS``. Words are hashed from running sums over the bytes, all at once."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    space = np.concatenate([[True], raw <= 32, [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return [np.zeros(0, np.int64) for _ in GRAMS]
    size = max(1 << 12, 1 << len(raw).bit_length())
    x = raw.astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x + np.uint64(1)) * _powers(size, _BASE)[: len(x)])])
        word = (sums[ends] - sums[starts]) * _powers(size, _INVERSE)[starts] * _MIX[0]
        three = (x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]) * _MIX[1]
        two = (word[:-1] ^ word[1:] * _MIX[2]) * _MIX[3]
    return [(h >> np.uint64(64 - bits)).astype(np.int64) for h, (_, bits) in zip((three, word, two), GRAMS, strict=True)]


def ratios(counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each kind the smoothed log ratio of a bucket's share in the positives and in all, from counts (2, buckets)."""
    out = []
    for c in counts:
        total = c.sum(axis=1, keepdims=True)
        share = (c + 4.0 * (total[1:] + 1) / c[1].size / (total[1:] + 1)) / (total + 4.0)
        out.append(np.log(share[0] / share[1]).astype(np.float32))
    return out


def described(text: str, tables: list[np.ndarray]) -> list[float]:
    """``features`` and, for each kind of n-grams, the mean log ratio of those in the text."""
    return features(text) + [float(t[b].mean()) if len(b) else 0.0 for b, t in zip(buckets(text), tables, strict=True)]


@dataclass
class Model:
    edges: list[np.ndarray]  # of each statistic's bins
    weights: np.ndarray
    bias: float
    tables: list[np.ndarray]  # log ratios of the n-grams
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        g = self.bias + self.weights[places(x, self.edges)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def places(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of the weight of each row's bin, by feature."""
    first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    return np.stack([first[k] + np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, tables: list[np.ndarray], bins: int = 24, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimises the non-negative risk by Adam over all rows given."""
    grid = np.linspace(0, 1, bins + 1)[1:-1]
    fine = np.concatenate([[0.002, 0.005, 0.01, 0.02], grid, [0.98, 0.99, 0.995, 0.998]])  # rare kinds sit at the ends
    even = np.linspace(0, 1, 18)[1:-1]  # and at even distances: a rare kind that stands far off gets bins of its own
    edges = [np.unique(np.concatenate([np.quantile(c, fine), c.min() + even * np.ptp(c)])) for c in unlabelled.T]
    p, u = places(positive, edges), places(unlabelled, edges)
    size = sum(len(e) + 1 for e in edges)
    to_weights = lambda at, d: np.bincount(at.ravel(), np.repeat(d, at.shape[1]), size)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(b + w[at].sum(axis=1), -40, 40))) for at in (p, u))
        negative = su.mean() - prior * sp.mean()  # the loss of g as a negative is sigmoid(g)
        dp, du = prior * sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        dp_all, du_all = (-2 * dp, du) if negative >= 0 else (dp, -du)
        grad = np.concatenate([to_weights(p, dp_all) + to_weights(u, du_all) + decay * w, [dp_all.sum() + du_all.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(edges, w, b, tables, prior)


def risk(model: Model, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The non-negative unbiased risk of the sigmoid loss."""
    sp, su = model.scores(positive), model.scores(unlabelled)
    return model.prior * float((1 - sp).mean()) + max(0.0, float(su.mean()) - model.prior * float(sp.mean()))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.25) -> float:
    """The share of positives among the unlabelled, from scores of either that a model gave which hadn't seen them.

    Above a threshold that no negative reaches, the share of the unlabelled is the prior times that of the positives; below
    it the quotient is larger. So the least quotient over all thresholds that ``least`` of the positives reach is taken.
    """
    cut = np.quantile(positive, np.linspace(0, 1 - least, 31))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cut, side="left") / len(s)
    return float(np.clip((above(unlabelled) / above(positive)).min(), 0.05, 0.99))


def held_out() -> Column:
    """Whether a row's label is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, positive, unlabelled, half): labelled documents that may be learned from, one row for each id.

    Of repeated ids the text with the smallest hash is taken. Positives are ``most`` of those labelled 1, the unlabelled ``most``
    of all labelled ones with their labels unread, both by the hash of their ids.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("quality")).where(~held_out())
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    first = [F.xxhash64("doc_id"), "doc_id"]
    ids = known.where("quality >= 0.5").orderBy(*first).limit(most).select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    ids = ids.union(known.orderBy(*first).limit(most).select("doc_id", F.lit(0), F.lit(1))).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")  # 2 x most ids at most
    one = rows.groupBy("doc_id", "p", "u").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    half = (F.xxhash64(F.lit(3), "doc_id") % 2 != 0).cast("int")
    return one.select("doc_id", "text", (F.col("p") == 1).alias("positive"), (F.col("u") == 1).alias("unlabelled"), half.alias("half"))


def gram_counts(rows: DataFrame) -> np.ndarray:
    """Counts (half, positive or unlabelled, bucket) of the n-grams of ``sample``, kinds one after the other."""
    size = sum(1 << bits for _, bits in GRAMS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("counts")
        total = np.zeros((4, size), np.int64)
        for b in batches:
            for t, p, u, h in zip(b["text"], b["positive"], b["unlabelled"], b["half"], strict=True):
                at, first = [], 0
                for x, (_, bits) in zip(buckets(t), GRAMS, strict=True):
                    at.append(x + first)
                    first += 1 << bits
                n = np.bincount(np.concatenate(at), minlength=size)
                if p:
                    total[2 * h] += n
                if u:
                    total[2 * h + 1] += n
        place, bucket = np.nonzero(total)
        yield pd.DataFrame({"at": place * size + bucket, "n": total[place, bucket]})

    found = rows.select("text", "positive", "unlabelled", "half").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # 4 x size numbers
    out = np.zeros(4 * size, np.int64)
    out[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out.reshape(2, 2, size)


def _by_kind(counts: np.ndarray) -> list[np.ndarray]:
    return np.split(counts, np.cumsum([1 << bits for _, bits in GRAMS])[:-1], axis=1)


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, prior: float | None = None) -> Model | float:
    """The model from documents and labels; without positives the prior alone.

    n-gram ratios of one half of the sample describe the other half, so none describes what it was counted on; new texts are
    described by the ratios of both. An unknown prior is estimated on each half from a model of the other.
    """
    rows, path = materialize(sample(docs, labels, most), "sample")
    counts = gram_counts(rows)
    other = [ratios(_by_kind(counts[1])), ratios(_by_kind(counts[0]))]

    @F.pandas_udf("array<float>")
    def describe(texts: pd.Series, halves: pd.Series) -> pd.Series:
        hold("statistics")
        return pd.Series([np.array(described(t, other[h]), np.float32) for t, h in zip(texts, halves, strict=True)])

    got = rows.select("doc_id", "positive", "unlabelled", "half", describe("text", "half").alias("x")).toPandas().sort_values("doc_id")  # 2 x most rows at most
    remove(docs.sparkSession, path)
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(NAMES) + len(GRAMS))
    p, u, half = (got[c].to_numpy() for c in ("positive", "unlabelled", "half"))
    p, u = p.astype(bool), u.astype(bool)
    if not p.any() or not u.any():
        return 0.5 if prior is None else prior
    if prior is None:
        found = []
        for h in (0, 1):
            here, there = half == h, half != h
            if min((p & here).sum(), (u & here).sum(), (p & there).sum(), (u & there).sum()):
                m = fit(x[p & there], x[u & there], 0.5, [], steps=150)
                found.append(estimated_prior(m.scores(x[p & here]), m.scores(x[u & here])))
        prior = float(np.mean(found)) if found else 0.5
    return fit(x[p], x[u], prior, ratios(_by_kind(counts.sum(axis=0))))


def score(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    ship(docs.sparkSession)
    probability = scorer(train(docs, labels, most))
    out = docs.select("doc_id", held_out().alias("held_out"), probability(text_or_empty()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scorer(model: Model | float) -> Callable[[Column], Column]:
    """A column function from texts to scores."""

    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        hold("score")
        if not isinstance(model, Model):
            return pd.Series(np.full(len(texts), model))
        x = np.array([described(t, model.tables) for t in texts], dtype=np.float32).reshape(-1, len(NAMES) + len(GRAMS))
        return pd.Series(model.scores(x.astype(np.float64)))

    return udf


def keep(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns."""
    ship(docs.sparkSession)
    probability = scorer(train(docs, labels, most))
    return docs.where(probability(text_or_empty()) >= 0.5)
