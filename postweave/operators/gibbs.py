"""Topic model by Gibbs sampling, every pass one job over blocks of posts.

Given the word shares of the topics all posts are independent, and given the topics of
all words the shares follow from counts. A pass therefore draws the topics of every post
in parallel and merges topic counts of words once; no update is lost or delayed, as would
happen where tasks change shared counts. Draws are seeded by pass and block content, so a
task that runs again draws the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.operators.in_row import portions, word_places
from postweave.session import stage, unstage

# Prior weight of all topics of a post at the start, updated every pass, and of each
# word of a topic.
ALPHA_SUM, BETA = 5.0, 0.01
# Draws of a post's topics per pass, with the word shares held.
SWEEPS = 5
# Distinct words of posts in a block, and in the arrays of one draw.
BLOCK, PORTION = 1_000_000, 100_000
# Distinct words of posts whose shares are worked out at once: their arrays stay in the cache.
CACHED = 8_192
# Passes compared by the stop rule, and the least gain in log-likelihood per word.
WINDOW, GAIN = 5, 0.01
# Repeats of a word in a post up to which each is drawn alone.
FEW = 8
# No share is exactly zero, so every word can be drawn.
FLOOR = 1e-100
# Cells below zero of a block's sums: log-likelihood, the two sides of the prior's update.
FIT, WHOLE, PART = -1, -2, -3

STATE = "mark long, starts binary, terms binary, n binary, topics binary, cells array<long>, sums array<double>"


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive ``x``: shifted up, then its series."""
    x = np.asarray(x, float).copy()
    low = np.zeros_like(x)
    for _ in range(6):
        low -= np.where(x < 6, 1 / x, 0.0)
        x += x < 6
    r = 1 / (x * x)
    return low + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))


def post_words(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, terms, n): distinct known words of each post, one range per post."""
    rows, places = word_places(lists, terms)
    cells, n = np.unique(rows * len(terms) + places, return_counts=True)
    row, place = np.divmod(cells, len(terms))
    return np.searchsorted(row, np.arange(len(lists) + 1)), place, n


def blocks(train: DataFrame, terms: list[str], terms_col: str) -> DataFrame:
    """Posts with a known word as blocks of counts without topics yet."""
    shared = train.sparkSession.sparkContext.broadcast(pa.array(terms))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 0)):
            starts, place, n = post_words(batch.column(0), shared.value)
            starts = np.append(starts[:-1][np.diff(starts) > 0], starts[-1])
            at = 0
            while at < len(starts) - 1:
                # As many posts as fit; a longer one is a block of its own.
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK, "right")) - 1)
                a, b = starts[at], starts[to]
                parts = [
                    (starts[at:to + 1] - a).astype("<i8").tobytes(),
                    place[a:b].astype("<i4").tobytes(), n[a:b].astype("<i4").tobytes(),
                ]
                mark = zlib.crc32(b"".join(parts))
                yield _state([[mark], *[[p] for p in parts], [b""], [[]], [[]]])
                at = to

    return train.select(terms_col).mapInArrow(pack, STATE)


def _state(columns: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.float64())]
    names = [c.split()[0] for c in STATE.split(", ")]
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def draw(rng, topics, starts, term, n, shares, alpha, sweeps):
    """(topics, topic counts of words, log-likelihood) after ``sweeps`` draws of a block.

    Words that a post repeats often are drawn as counts, the others one by one by
    where a uniform number falls among the running sums of their topics.
    """
    posts, width = len(starts) - 1, len(alpha)
    words, drawn_in, drawn_n = np.zeros(len(shares) * width), [], []
    found = np.zeros((posts, width)) + topics
    places, fit = np.arange(width), 0.0
    sizes = np.diff(starts)
    by_topic = np.ascontiguousarray(shares.T)
    # Posts are independent of each other: a portion of them runs through all draws.
    for group in np.split(np.arange(posts), np.flatnonzero(np.diff(starts[1:] // PORTION)) + 1):
        if not len(group):
            continue
        here = slice(starts[group[0]], starts[group[-1] + 1])
        own, word, times = np.repeat(np.arange(len(group)), sizes[group]), term[here].astype(np.int64), n[here]
        given = [np.take(s, word, mode='clip') for s in by_topic]
        each = np.repeat(np.arange(len(times)), np.where(times <= FEW, times, 0))
        often = np.flatnonzero(times > FEW)
        at, often_at = own[each] * width, (own[often, None] * width + places).ravel()
        sums, moved = [np.empty(len(times)) for _ in range(width)], np.empty(len(times))
        held, above, z = np.empty(len(each)), np.empty(len(each), bool), np.empty(len(each), np.int16)
        for sweep in range(sweeps):
            theta = rng.standard_gamma(alpha + found[group])
            theta = np.maximum(theta / np.maximum(theta.sum(1, keepdims=True), FLOOR), FLOOR)
            for k in range(width):
                np.take(theta[:, k].copy(), own, out=moved, mode="clip")
                if k:
                    np.multiply(moved, given[k], out=moved)
                    np.add(sums[k - 1], moved, out=sums[k])
                else:
                    np.multiply(moved, given[k], out=sums[k])
            total = sums[-1]
            u = rng.random(len(each))
            u *= np.take(total, each, out=held, mode="clip")
            z[:] = 0
            for k in range(width - 1):
                np.take(sums[k], each, out=held, mode="clip")
                np.greater_equal(u, held, out=above)
                z += above
            p = np.diff([s[often] for s in sums], axis=0, prepend=0.0).T
            drawn = rng.multinomial(times[often], np.maximum(p, 0) / p.sum(1, keepdims=True)).ravel()
            n_cells = len(group) * width
            found[group] = (np.bincount(at + z, minlength=n_cells) + np.bincount(often_at, drawn, n_cells)).reshape(-1, width)
        if sweeps:
            fit += float(times @ np.log(total))
            drawn_in += [word[each] * width + z, (word[often, None] * width + places).ravel()]
            drawn_n += [np.ones(len(z)), drawn]
    # Counted once: the array is as long as the dictionary times the topics.
    if drawn_in:
        words = np.bincount(np.concatenate(drawn_in), np.concatenate(drawn_n), len(words))
    return found, words.reshape(-1, width), fit


def one_pass(state: DataFrame, shares: np.ndarray, alpha: np.ndarray, seed: int, number: int) -> DataFrame:
    """The blocks with newly drawn topics and with their part of the merged sums."""
    shared = state.sparkSession.sparkContext.broadcast((shares, alpha))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, alpha = shared.value
        last, totals, more = None, np.zeros(shares.size), np.zeros(2 + len(alpha))
        for batch in batches:
            # One block after another: only its own arrays are held.
            for i in range(batch.num_rows):
                mark, starts, term, n, topics = (c[i].as_py() for c in batch.columns)
                at = np.frombuffer(starts, "<i8")
                drawn = np.frombuffer(topics, "<i4").reshape(-1, len(alpha)) if topics else 0.0
                known = np.zeros((len(at) - 1, len(alpha))) + drawn
                rng = np.random.default_rng([seed, number, mark])
                found, words, fit = draw(
                    rng, known, at, np.frombuffer(term, "<i4"), np.frombuffer(n, "<i4"),
                    shares, alpha, SWEEPS if topics else 1,
                )
                totals += words.ravel()
                whole = (digamma(found.sum(1) + alpha.sum()) - digamma(alpha.sum())).sum()
                part = (digamma(found + alpha) - digamma(alpha)).sum(0)
                more += [fit, whole, *part]
                if last is not None:
                    yield _state([*last, [[]], [[]]])
                last = [[mark], [starts], [term], [n], [found.astype("<i4").tobytes()]]
        if last is not None:
            # The sums of all blocks of the task lie beside its last one.
            cells = np.flatnonzero(totals)
            marks = [FIT, WHOLE, *(PART - np.arange(len(alpha)))]
            yield _state([*last, [np.append(cells, marks)], [np.append(totals[cells], more)]])

    return state.select("mark", "starts", "terms", "n", "topics").mapInArrow(work, STATE)


def merged(state: DataFrame) -> DataFrame:
    """(cell, n): the sums over all blocks, cell = word x topics + topic. At most one
    row per word and topic, which the dictionary bounds."""
    each = state.select(F.explode(F.arrays_zip("cells", "sums")).alias("c"))
    return each.groupBy(F.col("c.cells").alias("cell")).agg(F.sum("c.sums").alias("n"))


def settled(fits: list[float], gain: float = GAIN) -> bool:
    """Whether the mean log-likelihood of the last passes beats that before by less than
    ``gain``."""
    if len(fits) < 2 * WINDOW:
        return False
    return np.mean(fits[-WINDOW:]) - np.mean(fits[-2 * WINDOW:-WINDOW]) < gain


def fit_counts(
    train: DataFrame, terms: list[str], topics: int, seed: int, terms_col: str,
    iterations: int | None = None, gain: float = GAIN,
) -> tuple[np.ndarray, np.ndarray, list[float], DataFrame]:
    """(counts by word and topic, prior of the topics, log-likelihood per word of each
    pass, stored blocks). Without ``iterations`` the passes go on until settled."""
    state = stage(blocks(train, terms, terms_col), "topic-blocks")
    alpha = np.full(topics, ALPHA_SUM / topics)
    shares = np.full((len(terms), topics), 1 / len(terms))
    rng = np.random.default_rng(seed)
    fits: list[float] = []
    while True:
        following = stage(one_pass(state, shares, alpha, seed, len(fits)), "topic-blocks")
        unstage(state)
        state = following
        sums = merged(state).toArrow()
        cell = sums.column("cell").to_numpy()
        value = sums.column("n").to_numpy()
        counts = np.zeros(len(terms) * topics)
        counts[cell[cell >= 0]] = value[cell >= 0]
        counts = counts.reshape(-1, topics)
        more = dict(zip(cell[cell < 0].tolist(), value[cell < 0].tolist()))
        fits.append(float(more.get(FIT, 0.0) / max(counts.sum(), 1.0)))
        if settled(fits, gain) if iterations is None else len(fits) >= iterations:
            return counts, alpha, fits, state
        part = np.array([more.get(PART - k, 0.0) for k in range(topics)])
        if more.get(WHOLE, 0.0) > 0:
            alpha = np.maximum(np.round(alpha * part / more[WHOLE], 9), 1e-6)
        drawn = np.maximum(rng.standard_gamma(counts + BETA), FLOOR)
        shares = np.maximum(drawn / drawn.sum(0), FLOOR)


def post_shares(
    starts: np.ndarray, term: np.ndarray, n: np.ndarray, shares: np.ndarray, alpha: np.ndarray
) -> np.ndarray:
    """Topic shares of posts given the topics: the fixed point of prior plus expected
    counts, each post until it moves by less than a millionth; zero without a word."""
    sizes, by_topic = np.diff(starts), np.ascontiguousarray(shares.T)
    result = np.zeros((len(sizes), len(alpha)))
    active = np.flatnonzero(sizes)
    # Posts of like size together, so that a portion is bounded and nothing is sampled.
    ends = np.cumsum(sizes[active])
    for group in np.split(active, np.flatnonzero(np.diff(ends // CACHED)) + 1):
        n_open = sizes[group]
        first = np.cumsum(n_open) - n_open
        at = np.repeat(starts[group] - first, n_open) + np.arange(int(n_open.sum()))
        where, given, times = np.repeat(np.arange(len(group)), n_open), by_topic[:, term[at]], n[at]
        theta = np.full((len(group), len(alpha)), 1 / len(alpha))
        while len(group):
            held = np.maximum(theta.T, FLOOR)
            # Topic by topic, so that every step runs over all words at once.
            share = times / sum(h[where] * g for h, g in zip(held, given))
            moved = np.stack([a + h * np.add.reduceat(g * share, first) for a, h, g in zip(alpha, held, given)], axis=1)
            moved /= moved.sum(1, keepdims=True)
            far = np.abs(moved - theta).max(1) >= 1e-6
            result[group] = theta = moved
            if not far.all():
                kept = far[where]
                group, theta, n_open = group[far], theta[far], n_open[far]
                given, times = given[:, kept], times[kept]
                first = np.cumsum(n_open) - n_open
                where = np.repeat(np.arange(len(group)), n_open)
    return result
