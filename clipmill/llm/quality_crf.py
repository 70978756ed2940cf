"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are shares and counts of its
characters and words, and those of the lines before and after it. The marginals of
forward-backward, weighted by the lengths of the lines, are the document's quality.

Labels are of documents, so line labels are latent: a document's label says that
most of its length is good (or bad), not which lines are. After a start from the
document's label, expectation steps find, for each document, the distribution over
line labels that is closest to the chain's own among those whose length-weighted
share of good lines keeps that bound (posterior regularisation: one multiplier on
the lines' lengths), and maximisation steps fit the chain to it.

Fitting is on the driver, on at most ``max_docs`` labelled documents and
``max_lines`` neighbouring lines of each, chosen by a hash of the id: a bounded
sample, whatever the size of the corpus. Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

CUTOFF = 0.3
#: Least share of a good document's length that is good, and most of a bad one's.
SHARE_GOOD, SHARE_BAD = 0.8, 0.2
CHUNK = 1 << 20
SPACE, UPPER, LETTER, DIGIT, MARK, STOP, TAIL = (1 << i for i in range(7))
N_FEATURES = 14


def classes() -> np.ndarray:
    """Bit set of classes for each byte of UTF-8."""
    of = np.zeros(256, np.uint8)
    of[[32, *range(9, 14)]] |= SPACE
    of[ord("A") : ord("Z") + 1] |= UPPER | LETTER
    of[ord("a") : ord("z") + 1] |= LETTER
    of[ord("0") : ord("9") + 1] |= DIGIT
    of[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] |= MARK
    of[[ord(c) for c in ".,;:?'\"()-"]] |= STOP
    of[0x80:0xC0] |= TAIL
    of[0xC0:] |= LETTER
    return of


CLASS = classes()
RANDOM = np.random.default_rng(5)
BYTE, PLACE = RANDOM.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1), RANDOM.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lines of each text, length of each line in characters)."""
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(starts)
    kind = CLASS[raw]
    per_line = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    some = lambda bit: per_line((kind & bit) != 0)
    chars = np.maximum(per_line((kind & TAIL) == 0) - 1, 0)  # the line end itself
    upper = some(UPPER)
    upper[:] += per_line(np.append((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] < 0x9F), False))
    letters, digits, marks, stops = some(LETTER), some(DIGIT), some(MARK), some(STOP)
    inside = (kind & SPACE) == 0
    first = inside & np.concatenate([[True], ~inside[:-1]])
    at = np.flatnonzero(first)
    words = per_line(first)
    line_of_word = np.repeat(np.arange(n), words)
    if len(at):
        word_of = np.cumsum(first) - 1
        place = (np.arange(len(raw)) - at[np.maximum(word_of, 0)]) & 63
        value = np.where(inside, BYTE[raw] * PLACE[place], np.uint64(0))
        hashed = np.add.reduceat(value, at)
        size = np.add.reduceat(inside, at, dtype=np.int64)
        again = np.concatenate([[False], (hashed[1:] == hashed[:-1]) & (line_of_word[1:] == line_of_word[:-1])])
        _, one = np.unique(hashed ^ (line_of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        kinds = np.bincount(line_of_word[one], minlength=n)
        repeats, short = np.bincount(line_of_word, again, n), np.bincount(line_of_word, size <= 3, n)
        shape = np.zeros(n, np.uint64)
        np.add.at(shape, line_of_word, hashed * (np.arange(len(at), dtype=np.uint64) - np.repeat(np.cumsum(words) - words, words).astype(np.uint64) + np.uint64(3)))
    else:
        kinds = repeats = short = np.zeros(n)
        shape = np.zeros(n, np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    _, same, times = np.unique(shape ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_inverse=True, return_counts=True)
    last = raw[np.maximum(ends - 1, 0)]
    w, c, a = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(letters, 1)
    x = np.stack(
        [
            np.log1p(chars), np.log1p(words), np.minimum(upper / a, 1), marks / c, digits / c, stops / c, letters / c,
            np.minimum(letters / w, 20) / 10, repeats / w, kinds / w, short / w, (words == 0) * 1.0,
            ((last == 46) & (ends > starts)) * 1.0, ((times[same] > 1) & (words > 0)) * 1.0,
        ],
        1,
    )
    return x.astype(np.float32), counts, chars


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the previous and the next line of the text (else 0), and marks of the edges."""
    ends = np.cumsum(counts)
    starts = ends - counts
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts], after[ends - 1] = 0, 0
    edge = np.zeros((len(x), 3), x.dtype)
    edge[starts, 0], edge[ends - 1, 1], edge[:, 2] = 1, 1, 1
    return np.concatenate([x, before, after, edge], 1)


def chains(counts: np.ndarray) -> Iterator[np.ndarray]:
    """For each step, the rows of all chains that reach it, longest chain first."""
    order = np.argsort(-counts, kind="stable")
    starts, lengths = (np.cumsum(counts) - counts)[order], counts[order]
    for t in range(int(lengths[0]) if len(lengths) else 0):
        yield starts[: np.searchsorted(-lengths, -t, side="left")] + t


def log_add(x: np.ndarray) -> np.ndarray:
    top = x.max(-1)
    return top + np.log(np.exp(x - top[..., None]).sum(-1))


def forward_backward(emit: np.ndarray, counts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the states (rows x 2), expected moves (2 x 2) and the sum of log partitions."""
    steps = list(chains(counts))
    ahead, back = emit.copy(), np.zeros_like(emit)
    for prev, now in zip(steps, steps[1:], strict=False):
        ahead[now] += log_add(ahead[prev[: len(now)]][:, None, :] + move.T[None])
    for prev, now in zip(steps[-2::-1], steps[:0:-1], strict=True):
        back[prev[: len(now)]] = log_add((back[now] + emit[now])[:, None, :] + move[None])
    whole = log_add(ahead[np.cumsum(counts) - 1])
    z = np.repeat(whole, counts)
    marginal = np.exp(ahead + back - z[:, None])
    pair = np.zeros((2, 2))
    inner = np.ones(len(emit), bool)
    inner[np.cumsum(counts) - 1] = False
    i = np.flatnonzero(inner)
    if len(i):
        pair = np.exp(ahead[i][:, :, None] + move[None] + (emit[i + 1] + back[i + 1])[:, None, :] - z[i][:, None, None]).sum(0)
    return marginal, pair, float(whole.sum())


@dataclass
class LineCrf:
    """Weights of a two-state chain (0 bad, 1 good) on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    move: np.ndarray

    def emissions(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        good = with_neighbours((x - self.mean) / self.scale, counts).astype(np.float64) @ self.weight
        return np.stack([np.zeros_like(good), good], 1)

    def chunks(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(how likely each line is good, its weight, lines of each text) for runs of texts; lines without words weigh nothing."""
        texts, at = list(texts), 0
        while at < len(texts):
            to, size = at + 1, len(texts[at] or "")
            while to < len(texts) and size + len(texts[to] or "") < CHUNK:
                size += len(texts[to] or "")
                to += 1
            x, counts, chars = line_features([(t or "").encode("utf-8", "surrogatepass") for t in texts[at:to]])
            marginal, _, _ = forward_backward(self.emissions(x, counts), counts, self.move)
            yield marginal[:, 1], weights(x, chars), counts
            at = to

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """Quality of each text from 0 to 1; a text without words has 0."""
        out = [np.zeros(0)]
        for good, weight, counts in self.chunks(texts):
            starts = np.cumsum(counts) - counts
            out.append(np.add.reduceat(weight * good, starts) / np.maximum(np.add.reduceat(weight, starts), 1e-9))
        return np.round(np.clip(np.concatenate(out), 0.0, 1.0), 9)  # alike however texts are batched


def weights(x: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return np.where(x[:, 11] > 0, 0.0, chars.astype(float))


def within_share(emit: np.ndarray, counts: np.ndarray, move: np.ndarray, weight: np.ndarray, labels: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected moves of the closest distribution that keeps each document's share of good lines in its bound."""
    starts = np.cumsum(counts) - counts
    share = np.repeat(np.maximum(np.add.reduceat(weight, starts), 1e-9), counts)
    pull = weight / share * np.repeat(counts, counts)  # one on average
    sign = np.where(labels > 0, 1.0, -1.0)
    low, high = np.zeros(len(counts)), np.full(len(counts), 16.0)

    def at(multiplier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shifted = emit.copy()
        shifted[:, 1] += np.repeat(sign * multiplier, counts) * pull
        marginal, pair, _ = forward_backward(shifted, counts, move)
        return marginal, pair, np.add.reduceat(weight / share * marginal[:, 1], starts)

    kept = lambda good: np.where(labels > 0, good >= SHARE_GOOD, good <= SHARE_BAD)
    high[kept(at(low)[2])] = 0.0
    for _ in range(steps):
        middle = (low + high) / 2
        ok = kept(at(middle)[2])
        low, high = np.where(ok, low, middle), np.where(ok, middle, high)
    marginal, pair, _ = at(high)
    return marginal, pair


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, chars: np.ndarray | None = None, turns: int = 150, rounds: int = 3, rate: float = 0.1, ridge: float = 1e-3) -> LineCrf:
    """Adam on all chains at once, first on document labels, then on latent line labels; the same input gives the same weights."""
    if not len(labels):
        return LineCrf(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), np.zeros(3 * N_FEATURES + 3), np.zeros((2, 2)))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    full = with_neighbours((x - mean) / scale, counts).astype(np.float64)
    weight = weights(x, np.expm1(x[:, 0]) if chars is None else chars)  # the first feature is the log length
    y = np.repeat(labels.astype(float), counts)
    theta = np.zeros(full.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    told = np.zeros((2, 2))
    for k in (0, 1):
        told[k, k] = (counts[labels == k] - 1).sum()
    latent = [turns * (k + 1) // (rounds + 1) for k in range(rounds)]
    for turn in range(1, turns + 1):
        if turn in latent:
            good = full @ theta[:-4]
            closest, told = within_share(np.stack([np.zeros_like(good), good], 1), counts, theta[-4:].reshape(2, 2), weight, labels)
            y = closest[:, 1]
        good = full @ theta[:-4]
        marginal, pair, _ = forward_backward(np.stack([np.zeros_like(good), good], 1), counts, theta[-4:].reshape(2, 2))
        slope = np.concatenate([full.T @ (marginal[:, 1] - y), (pair - told).ravel()]) / len(y) + ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return LineCrf(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 3000, max_lines: int = 500) -> LineCrf:
    """Fit on labelled rows that aren't held out. Rows without id or label are passed over; of repeated labels the larger counts, of texts that share an id the smallest."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_docs)
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    texts = found.groupBy("id", "label").agg(F.min("text").alias("text"))  # a row per id, however often it repeats

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text, label in zip(frame["id"], frame["text"], frame["label"], strict=True):
                x, _, _ = line_features([(text or "").encode("utf-8", "surrogatepass")])
                start = int(key) * 7919 % max(1, len(x) - max_lines + 1)
                rows.append((key, label, x[start : start + max_lines].tobytes()))
            yield pd.DataFrame(rows, columns=["id", "label", "x"])

    found = sorted(tuple(r) for r in texts.mapInPandas(features, "id long, label int, x binary").collect())
    parts = [np.frombuffer(bytes(r[2]), np.float32).reshape(-1, N_FEATURES) for r in found]
    x = np.concatenate([np.zeros((0, N_FEATURES), np.float32), *parts])
    return fit(x, np.array([len(p) for p in parts], np.int64), np.array([int(r[1] > 0) for r in found], np.int64))


def score(df: DataFrame, model: LineCrf, text_col: str = "text") -> DataFrame:
    """All rows as struct ``row`` with ``score``. Null and empty texts have 0; repeated rows are each scored."""

    @F.pandas_udf(T.DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        give_back()
        return pd.Series(model.scores(texts))

    return df.select(F.struct("*").alias("row"), scores(F.col(text_col)).alias("score"))


def label_lines(df: DataFrame, model: LineCrf, text_col: str = "text") -> DataFrame:
    """All rows as struct ``row`` with ``lines``: per line of the text (split at line feeds) how likely it is good.

    A null text counts as empty and has one line; repeated rows are each labelled.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def lines(texts: pd.Series) -> pd.Series:
        out = []
        for good, _, counts in model.chunks(texts):
            out += np.split(np.round(good, 9), np.cumsum(counts)[:-1])
        return pd.Series(out)

    return df.select(F.struct("*").alias("row"), lines(F.col(text_col)).alias("lines"))
