"""Language-model scores from a hierarchical Pitman-Yor model.

Each context, the word before, has a restaurant; all share one parent restaurant over words, whose base is
uniform over the vocabulary and one unknown word. A training word sits at a table of its context's restaurant;
each table is a customer of the parent. Gibbs sampling takes all customers of a cell up and seats them again. A word's
probability is the mean of its predictive probabilities over several sampled seatings.

Tokens are shuffled once, to partitions of the word they predict, so a word's tables in all contexts and its
seating in the parent are local. Words are named by 64-bit hashes, or by their rank among the ``RANKED`` most frequent ones.
Tables and customers per context are added up over partitions: for ranked contexts by slices, which all partitions get;
for others by ranges of hashes, and each partition gets the sums of its own contexts back. What all partitions
share has a fixed size: these ranks and their sums, a few totals, at most ``1 / HOT`` frequent words, whose tokens are spread
by context, and at most ``2 / HOT`` frequent pairs of words, of which a partition gets counts only: their tokens, spread by document, wait elsewhere. A
round samples seatings in each partition against the sums of the round before, then adds up new ones.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import WordHashes, drop_folder, mixed, named, stored_at  # noqa: F401 - tests take hashes from here
from runledger.session import temporary_conf

HOT = 1 / 2000
# Bytes of text in a run, tokens in a partition.
_RUN, _PART = 4_400_000, 1_200_000
_DOC_GROUP = 12
_END = np.uint64(0x6A09E667F3BCC909)
_LOW = np.uint64((1 << 32) - 1)
_START = np.uint64(0xBB67AE8584CAA73B)
ROUNDS, SAMPLES = 3, 3
# Frequent words that travel as their rank; others as their hash. Sums of so many contexts are known everywhere, by slices.
RANKED, _SLICE = 1 << 18, 1 << 12
_NONE = np.empty(0, np.uint64)
# Customers up to which ways to seat them are listed; beyond, integrals of this many places give them.
LISTED, _NODES = 1500, 96
STRENGTH = 1.0


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; equal bytes of neighbouring numbers stand together, so they compress."""
    planes = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes.append((a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def _unpack(data: bytes) -> list[np.ndarray]:
    return [
        np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, size).T.copy().view(kind).ravel()
        if size else np.empty(0, kind)
        for kind, size, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    ]


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in runs of about ``most`` bytes of ``text``; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        # A text without words still has an end.
        ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 6)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, done + most - size, side="right"))
            if stop <= start and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            stop = max(stop, start + 1)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - done)
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def _numbered(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the lower-cased words and of an end after each text, tokens per text, and the hash of each number.

    0 is the end, 1 what stands before a text.
    """
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts.combine_chunks().cast(pa.large_string()).fill_null("")))
    words = pc.ascii_split_whitespace(texts)
    sizes = pc.list_value_length(words).to_numpy().astype(np.int64)
    words, empty = words.flatten(), pc.binary_length(texts).to_numpy() == 0
    # An empty text is split into one empty word.
    words = words.filter(pa.array(~np.repeat(empty, sizes)))
    sizes[empty] = 0
    words = words.dictionary_encode()
    listed = words.dictionary
    cuts = np.frombuffer(listed.buffers()[1], np.int64)[listed.offset :][: len(listed) + 1].tolist() if len(listed) else [0]
    data = memoryview(listed.buffers()[2] or b"")
    hashes = np.empty(len(listed) + 2, np.uint64)
    hashes[:2] = _END, _START
    hashes[2:] = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(cuts, cuts[1:])), np.uint64, len(listed))
    out, inside = np.zeros(len(words) + len(sizes), np.int64), np.ones(len(words) + len(sizes), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    out[inside] = words.indices.to_numpy().astype(np.int64) + 2
    return out, sizes + 1, hashes


def _before(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The context of a word is the word before it."""
    out = np.append(1, numbers[:-1])
    out[np.cumsum(sizes) - sizes] = 1
    return out


def _kept(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Rows stored, and their folder; what was shuffled for them goes as soon as they are written."""
    with temporary_conf(rows.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        return stored_at(rows, name)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


def _counted(docs: DataFrame) -> DataFrame:
    """``word, before, n``: sums for ``docs(text, held_out)``.

    With a null ``before``: how often each word occurs in texts not held out. With a null ``word`` too: how many
    tokens there are. Else a pair, and how often it occurs in those runs of texts where it is over ``HOT / 2`` of all tokens.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 2 * _RUN):
            words, sizes, hashes = _numbered(run.column("text"))
            before = _before(words, sizes)
            train = np.repeat(~run.column("held_out").to_numpy(), sizes)
            times, own = np.bincount(words, minlength=len(hashes)), np.bincount(words[train], minlength=len(hashes))
            # Both words of a frequent pair are frequent, or it starts its text.
            often = times > HOT / 2 * len(words)
            likely = np.flatnonzero(often[words])
            pairs, found = np.unique((before[likely] << 32) | words[likely], return_counts=True)
            pairs, found = pairs[found > HOT / 2 * len(words)], found[found > HOT / 2 * len(words)]
            seen = np.flatnonzero(own)
            first, second = hashes[pairs >> 32], hashes[pairs & ((1 << 32) - 1)]
            # The last row counts all tokens; only pairs have a word before.
            size = len(seen) + len(pairs) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[hashes[seen], second, _END].view(np.int64), mask=np.arange(size) == size - 1),
                    pa.array(np.r_[np.zeros(len(seen), np.uint64), first, _END].view(np.int64),
                             mask=(np.arange(size) < len(seen)) | (np.arange(size) == size - 1)),
                    pa.array(np.r_[own[seen], found, len(words)].astype(np.int64)),
                ],
                ["word", "before", "n"],
            )

    return docs.mapInArrow(count, "word long, before long, n long").groupBy("word", "before").agg(F.sum("n").alias("n"))


def _among(listed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are listed; the list is in order."""
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values if len(listed) else np.zeros(len(values), bool)


def _pair_places(pairs: np.ndarray, before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each pair of words in ``pairs(before, word)``, which is in order; -1 for others."""
    out = np.full(len(words), -1, np.int64)
    if len(pairs):
        likely = np.flatnonzero(_among(np.unique(pairs[:, 0]), before) & _among(np.unique(pairs[:, 1]), words))
        places = {(int(b), int(w)): k for k, (b, w) in enumerate(pairs)}
        out[likely] = [places.get(x, -1) for x in zip(before[likely].tolist(), words[likely].tolist())]
    return out


def _most_frequent(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of at most ``RANKED`` words ``words(word, n)``, the most frequent first."""
    # Classes of like counts, of which there are at most 64 * 16; the last one that no longer fits stays out.
    kind = F.floor(F.log2("n") * 16).cast("long")
    least, size = None, 0
    for row in words.groupBy(kind.alias("kind")).count().orderBy(F.col("kind").desc()).collect():
        size += row["count"]
        if size > RANKED:
            break
        least = row["kind"]
    if least is None:
        return _NONE, np.empty(0, np.int64)
    top = words.where(kind >= least).select("word", "n").toArrow()
    hashes, times = top.column("word").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((hashes, -times))
    return hashes[order].view(np.uint64), times[order]


def _ranks(ranked: np.ndarray, order: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each hash stands in ``ranked``, which ``order`` sorts; its length for others."""
    if not len(ranked):
        return np.zeros(len(hashes), np.uint32)
    at = order[np.minimum(np.searchsorted(ranked, hashes, sorter=order), len(order) - 1)]
    return np.where(ranked[at] == hashes, at, len(ranked)).astype(np.uint32)


def _hashes_of(ranks: np.ndarray, others: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Hashes of ranks; those without come from ``others``, in order."""
    out, known = np.empty(len(ranks), np.uint64), ranks < len(ranked)
    out[known], out[~known] = ranked[ranks[known]], others
    return out


def _dealt(docs: DataFrame, hot: np.ndarray, pairs: np.ndarray, parts: int, ranked: np.ndarray = _NONE) -> DataFrame:
    """``part, data``: cells with training counts, and tokens as counts per cell and document, packed for the
    partition of the word they predict. Tokens of ``pairs`` are packed for partitions from ``parts`` on, by document.
    Words among ``ranked`` are named by their place there, others by their hash."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, pairs, ranked, np.argsort(ranked)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, _RUN):
            words, sizes, hashes = _numbered(run.column("text"))
            before, doc = _before(words, sizes), np.repeat(np.arange(len(sizes)), sizes)
            uids, train = run.column("uid").to_numpy(), ~run.column("held_out").to_numpy()
            hot, pairs, ranked, order = shared.value
            # One sort finds the cells of this run of texts, and how often each document has each.
            of_word, of_doc = len(hashes).bit_length(), len(sizes).bit_length()
            keys = np.sort((((words << of_word) | before) << of_doc) | doc)
            first = _starts(keys)
            times, keys = np.diff(first, append=len(keys)), keys[first]
            doc, keys = keys & ((1 << of_doc) - 1), keys >> of_doc
            first = _starts(keys)
            cell = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
            word, context = keys[first] >> of_word, keys[first] & ((1 << of_word) - 1)
            counts = np.add.reduceat(times * train[doc], first)
            rank = _ranks(ranked, order, hashes)
            salt = np.where(_among(hot, hashes)[word], mixed(hashes[context] + np.uint64(1)), np.uint64(0))
            part = (mixed(hashes[word] ^ salt) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            pair = _pair_places(pairs, hashes[context], hashes[word])
            numbers, blobs = [], []
            waiting = np.flatnonzero(pair[cell] >= 0)
            away = (mixed(uids[doc[waiting]].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            waiting, away = waiting[np.argsort(away, kind="stable")], np.sort(away)
            for at in np.split(waiting, np.flatnonzero(np.diff(away)) + 1) if len(waiting) else ():
                numbers.append(parts + int(mixed(uids[doc[at[:1]]].astype(np.uint64))[0] % np.uint64(parts)))
                blobs.append(_pack(uids[doc[at]], pair[cell[at]].astype(np.uint32), times[at].astype(np.uint32)))
            near = np.flatnonzero(pair[cell] < 0)
            near = near[np.argsort(part[cell[near]], kind="stable")]
            order = np.argsort(part, kind="stable")
            place = np.empty(len(word), np.int64)
            bounds = np.arange(parts + 1)
            ends, near_ends = np.searchsorted(part[order], bounds), np.searchsorted(part[cell[near]], bounds)
            for k in range(parts):
                own, at = order[ends[k] : ends[k + 1]], near[near_ends[k] : near_ends[k + 1]]
                if not len(own):
                    continue
                place[own] = np.arange(len(own))
                first = _starts(word[own])
                words_here, contexts_here = word[own[first]], context[own]
                docs_here, doc_here = np.unique(doc[at], return_inverse=True)
                numbers.append(k)
                blobs.append(_pack(
                    rank[words_here], np.diff(first, append=len(own)).astype(np.uint32),
                    hashes[words_here[rank[words_here] == len(ranked)]],
                    rank[contexts_here], hashes[contexts_here[rank[contexts_here] == len(ranked)]], counts[own].astype(np.uint32),
                    np.bincount(place[cell[at]], minlength=len(own)).astype(np.uint32),
                    doc_here.astype(np.uint32), times[at].astype(np.uint32), np.diff(uids[docs_here], prepend=0),
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["part", "data"])

    return docs.mapInArrow(deal, "part int, data binary")


def _gathered(dealt: DataFrame, parts: int, ranked: np.ndarray = _NONE) -> DataFrame:
    """One row per partition: its cells (word, context, training count), and its tokens by cell and document.

    Partitions from ``parts`` on have no model; their tokens name pairs in place of cells.
    """
    shared = dealt.sparkSession.sparkContext.broadcast(ranked)

    def gather(table: pa.Table) -> pa.Table:
        found = [_unpack(x.as_py()) for x in table.column("data")]
        part, model = table.column("part")[0].as_py(), None
        if part >= parts:
            tokens = _pack(*(np.concatenate([p[k] for p in found]) for k in (1, 2, 0)))
        else:
            ranked = shared.value
            word_ranks, in_word, others, ranks, hashes, counts, entries = (np.concatenate([p[k] for p in found]) for k in range(7))
            word_hashes = _hashes_of(word_ranks, others, ranked)
            words = np.unique(word_hashes)
            often, rare = ranks < len(ranked), np.unique(hashes)
            context_ranks = np.unique(ranks[often])
            context = np.empty(len(ranks), np.int64)
            context[often] = np.searchsorted(context_ranks, ranks[often])
            context[~often] = len(context_ranks) + np.searchsorted(rare, hashes)
            word = np.repeat(np.searchsorted(words, word_hashes), in_word)
            cells, inverse = np.unique((word.astype(np.uint64) << np.uint64(32)) | context.astype(np.uint64), return_inverse=True)
            counts = np.bincount(inverse, weights=counts, minlength=len(cells))
            model = _pack(
                words, np.diff(context_ranks, prepend=np.uint32(0)), rare,
                np.diff(cells, prepend=np.uint64(0)), counts.astype(np.uint64),
            )
            cell = np.repeat(inverse, entries)
            order = np.argsort(cell)
            uids = np.concatenate([np.cumsum(p[9])[p[7]] for p in found])
            tokens = _pack(
                np.bincount(cell, minlength=len(cells)).astype(np.uint32), np.concatenate([p[8] for p in found])[order], uids[order],
            )
        return pa.table({
            "part": pa.array([part], pa.int32()), "model": pa.array([model], pa.binary()), "tokens": pa.array([tokens], pa.binary()),
        })

    return dealt.groupBy("part").applyInArrow(gather, "part int, model binary, tokens binary")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function of positive numbers."""
    y = x + 8
    far = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return far - sum(np.log(x + k) for k in range(8))


class _Remembered:
    """The last two results of a function of one number. They stay here when it is sent to workers, with or without the package."""

    def __init__(self, function: Callable[[float], np.ndarray]) -> None:
        self.__wrapped__, self._last = function, {}

    def __reduce__(self) -> tuple:
        return _Remembered, (self.__wrapped__,)

    def __call__(self, number: float) -> np.ndarray:
        if number not in self._last:
            while len(self._last) > 1:
                del self._last[next(iter(self._last))]
            self._last[number] = self.__wrapped__(number)
        return self._last[number]


@_Remembered
def _ways(discount: float) -> np.ndarray:
    """Log of the generalized Stirling numbers of up to ``LISTED`` customers (row) at each number of tables (column)."""
    out = np.full((LISTED + 1, LISTED + 1), -np.inf)
    out[1, 1] = 0.0
    tables = np.arange(1, LISTED + 1)
    for n in range(1, LISTED):
        stay = np.where(tables <= n, np.log(np.maximum(n - discount * tables, 1e-300)), 0.0) + out[n, 1:]
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], stay)
    return out


def _log_ways(customers: np.ndarray, tables: np.ndarray, discount: float, rough: bool = False) -> np.ndarray:
    """Log of the generalized Stirling numbers, up to what depends on the customers alone.

    Tables of ``n`` customers weigh ``z^n`` in ``f = (1 - (1 - z)^d) / d``; the number is a coefficient of ``f^tables``. It is
    integrated with ``z = exp(-v)`` through the saddle point: along a parabola round the branch cut, or a line far from it.
    A ``rough`` number knows height and width at that point only.
    """
    c, t = customers.astype(float), tables.astype(float)

    def log_x(v: np.ndarray) -> np.ndarray:
        near = np.log(-np.expm1(-v))
        return np.where(v.real > 0.5, np.log1p(-np.exp(-np.where(v.real > 0.5, v, 1.0))), near)

    def slope(v: np.ndarray) -> np.ndarray:
        lx = log_x(v)
        return discount * np.exp((discount - 1) * lx - v) / -np.expm1(discount * lx)

    over = np.maximum(c - t, 1)
    low, high = np.log(5 / over), np.full(len(c), np.log(40.0))
    for _ in range(30):
        middle = (low + high) / 2
        right = t * slope(np.exp(middle)) > c
        low, high = np.where(right, middle, low), np.where(right, high, middle)
    mu = np.exp(high)
    bend = t * (slope(mu * (1 - 1e-4)) - slope(mu * (1 + 1e-4))) / (2e-4 * mu)
    spread = 1 / np.sqrt(np.maximum(bend, 1e-300))
    peak = c * mu + t * np.log(-np.expm1(discount * log_x(mu)))
    known = -_log_gamma(t + 1) - t * np.log(discount)
    if rough:
        return np.where(tables == customers, t * np.log(discount), peak + np.log(spread / np.sqrt(2 * np.pi))) + known
    bent = mu < 1.4
    # Places along the path: dense at the peak, up to where nothing is left.
    end = np.where(bent, np.sqrt(1 + 45 / (over * mu)), np.minimum(np.pi, 13 * spread))
    unit = np.where(bent, np.minimum(spread / (2 * mu), end), 50 * end)
    far = np.arcsinh(end / unit)
    steps = (np.arange(_NODES) + 0.5) / _NODES * far[:, None]
    at = unit[:, None] * np.sinh(steps)
    turn = 1 + 1j * at
    m = mu[:, None]
    v = np.where(bent[:, None], m * turn * turn, m + 1j * at)
    g = c[:, None] * v + t[:, None] * np.log(-np.expm1(discount * log_x(v))) - peak[:, None]
    paths = np.where(bent[:, None], 2 * m * turn, 1.0) * np.cosh(steps)
    sums = (np.exp(g) * paths).real.sum(1) * unit * far / _NODES / np.pi
    logs = np.log(np.maximum(sums, 1e-300)) + peak
    return np.where(tables == customers, t * np.log(discount), logs) + known


def _most_likely(log_weight: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """The place of the maximum of log-concave weights of 1 to ``most``."""
    low, high = np.ones(len(most), np.int64), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        rises = (middle > 1) & (log_weight(middle) >= log_weight(np.maximum(middle - 1, 1)))
        low, high = np.where(rises, middle, low), np.where(rises, high, np.maximum(middle - 1, low))
    return low


def _many(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells with any number of customers, by rejection: flat about the maximum, geometric on both sides."""
    def log_weight(tables: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return _log_ways(customers[rows], tables, discount) + tables * np.log(weight[rows])

    # Rough numbers find about where the maximum is, exact ones climb to it: weights are log-concave.
    mode = _most_likely(lambda tables: _log_ways(customers, tables, discount, rough=True) + tables * np.log(weight), customers)
    after, top, ahead = np.empty((3, len(customers)))
    rows = np.arange(len(customers))
    while len(rows):
        at, most = mode[rows], customers[rows]
        top[rows] = log_weight(at, rows)
        after[rows], ahead[rows] = log_weight(np.minimum(at + 1, most), rows), log_weight(np.maximum(at - 1, 1), rows)
        step = np.where(after[rows] > top[rows], 1, np.where(ahead[rows] > top[rows], -1, 0))
        mode[rows] += step
        rows = rows[step != 0]
    bend = 2 * top - after - ahead
    wide = np.maximum(1, 1 / np.sqrt(np.maximum(bend, 1e-12))).astype(np.int64)
    left, right = np.maximum(mode - wide, 1), np.minimum(mode + wide, customers)
    at_left, at_right = log_weight(left), log_weight(right)
    fall_left = np.minimum(log_weight(np.maximum(left - 1, 1)) - at_left, -1e-9)
    fall_right = np.minimum(log_weight(np.minimum(right + 1, customers)) - at_right, -1e-9)

    def tail(at: np.ndarray, fall: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, np.exp(at - top + fall) / -np.expm1(fall), 0.0)

    middle = right - left + 1.0
    below, above = tail(at_left, fall_left, left > 1), tail(at_right, fall_right, right < customers)
    out = np.zeros(len(customers), np.int64)
    while len(rows := np.flatnonzero(out == 0)):
        place = rng.random(len(rows)) * (middle + below + above)[rows]
        steps = np.log(1 - rng.random(len(rows)))
        down = np.minimum(1 + steps / fall_left[rows], 2.0**60).astype(np.int64)
        up = np.minimum(1 + steps / fall_right[rows], 2.0**60).astype(np.int64)
        inner, lower = place < middle[rows], place < (middle + below)[rows]
        tables = np.where(inner, left[rows] + place.astype(np.int64), np.where(lower, left[rows] - down, right[rows] + up))
        bound = np.where(
            inner, top[rows],
            np.where(lower, at_left[rows] + fall_left[rows] * down, at_right[rows] + fall_right[rows] * up),
        )
        there = np.flatnonzero((tables >= 1) & (tables <= customers[rows]))
        rows, tables, bound = rows[there], tables[there], bound[there]
        taken = np.log(1 - rng.random(len(rows))) <= log_weight(tables, rows) - bound
        out[rows[taken]] = tables[taken]
    return out


class Seating:
    """Tables of many cells; a cell's customers all eat one dish.

    A sweep takes up all customers of each cell and seats them again: the number of a cell's tables is drawn from its
    distribution given the weight of a table, ``weight ** tables`` times the generalized Stirling number, whatever was before.
    Neither tables nor customers are bounded. Cells stand in the order of their customers.
    """

    def __init__(self, customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator):
        """``weight``: of a new table, against an occupied one's customers less ``discount``."""
        self.order = np.argsort(customers, kind="stable")
        self.customers, self.discount, self.rng = customers[self.order], discount, rng
        self.reweigh(weight)
        self._tables = np.ones(len(customers), np.int64)

    def reweigh(self, weight: np.ndarray) -> None:
        self.weight = np.maximum(weight, 1e-12)[self.order]

    @property
    def tables(self) -> np.ndarray:
        """Tables per cell, in the order of the given cells."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = self._tables
        return out

    @property
    def first(self) -> np.ndarray:
        """Where the tables of each cell begin in ``sizes``."""
        return np.r_[0, np.cumsum(self._tables)]

    @property
    def sizes(self) -> np.ndarray:
        """Customers per table of one seating with these tables, cell by cell: predictions depend on no more."""
        out = np.ones(int(self._tables.sum()), np.int64)
        out[self.first[:-1]] += self.customers - self._tables
        return out

    def sweep(self, times: int = 1) -> None:
        """Seats all customers anew, ``times`` times."""
        for _ in range(times):
            upto = int(np.searchsorted(self.customers, LISTED, side="right"))
            start = 0
            while start < upto:
                n = int(self.customers[start])
                end = int(np.searchsorted(self.customers, n, side="right"))
                end = min(end, start + max(1, 2_000_000 // n))
                self._tables[start:end] = self._few(n, self.weight[start:end])
                start = end
            # Blocks bound what the integrals hold.
            for start in range(upto, len(self.customers), 4096):
                block = slice(start, start + 4096)
                self._tables[block] = _many(self.customers[block], self.weight[block], self.discount, self.rng)

    def _few(self, n: int, weight: np.ndarray) -> np.ndarray | int:
        if n == 1:
            return 1
        logs = _ways(self.discount)[n, 1 : n + 1] + np.log(weight)[:, None] * np.arange(1, n + 1)
        upto = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
        return 1 + (upto < (self.rng.random(len(weight)) * upto[:, -1])[:, None]).sum(1)


class _Shared:
    """What partitions know of each other: totals of the round before."""

    def __init__(self, vocabulary: int, hot: np.ndarray, hot_counts: np.ndarray, ranked: np.ndarray):
        self.vocabulary, self.hot, self.hot_counts, self.ranked = vocabulary, hot, hot_counts, ranked
        # Tables and customers of the contexts among frequent words.
        self.sums = np.zeros((2, len(ranked)), np.int64)
        self.discounts = (0.75, 0.5)
        self.parent_customers = self.parent_tables = 0.0
        self.hot_customers, self.hot_tables = np.zeros(len(hot)), np.zeros(len(hot), np.int64)


def _plain(shared: _Shared) -> SimpleNamespace:
    """A form that workers without this package can read: broadcast values name their class."""
    return SimpleNamespace(**vars(shared))


def _discount(ones: float, twos: float) -> float:
    return float(min(0.95, max(0.05, ones / (ones + 2 * twos)))) if ones + twos else 0.5


def _opened(model: bytes, ranked: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words, contexts, and per cell the places of its word and its context and its training count; then the ranks of
    those contexts that have one, which come first."""
    words, ranks, rare, steps, counts = _unpack(model)
    ranks, cells = np.cumsum(ranks, dtype=np.int64), np.cumsum(steps, dtype=np.uint64)
    return (
        words, np.concatenate([ranked[ranks], rare]), (cells >> np.uint64(32)).astype(np.int64),
        (cells & _LOW).astype(np.int64), counts.astype(np.int64), ranks,
    )


def _cells(model: bytes) -> tuple[np.ndarray, ...]:
    """``_opened`` without ranks, for a model whose words are all named by their hashes."""
    return _opened(model, _NONE)[:5]


def _context_sums(own: DataFrame, model: DataFrame) -> DataFrame:
    """``model`` with ``sums``: those of each partition's contexts over all partitions, in the order of its contexts.

    ``own(part, shard, data)`` has contexts of one partition and shard, and their values; a context is in one shard and
    has one entry per partition, however frequent it is.
    """
    def add(table: pa.Table) -> pa.Table:
        found = [_unpack(x.as_py()) for x in table.column("data")]
        unique, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        sums = [
            np.bincount(inverse, weights=np.concatenate([f[k] for f in found]), minlength=len(unique)).astype(np.int64)
            for k in range(1, len(found[0]))
        ]
        cuts = np.cumsum([0, *(len(f[0]) for f in found)])
        return pa.table({
            "part": table.column("part"),
            "data": pa.array([
                _pack(f[0], *(s[inverse[a:b]] for s in sums)) for f, a, b in zip(found, cuts, cuts[1:])
            ], pa.binary()),
        })

    def join(table: pa.Table) -> pa.Table:
        found = [_unpack(x.as_py()) for x in table.column("data")]
        order = np.argsort(np.concatenate([f[0] for f in found]))
        sums = _pack(*(np.concatenate([f[k] for f in found])[order] for k in range(1, len(found[0]))))
        return pa.table({"part": table.column("part")[:1], "sums": pa.array([sums], pa.binary())})

    sums = own.groupBy("shard").applyInArrow(add, "part int, data binary")
    sums = sums.groupBy("part").applyInArrow(join, "part int, sums binary")
    return model.join(sums, "part")


def _sampled(model: bytes, sums: bytes | None, shared: _Shared, part: int, turn: int, samples: int):
    """Yields, per sample, the cells with their tables and each word's parent probability."""
    rng = np.random.default_rng((part, turn))
    words, contexts, word, context, counts, ranks = _opened(model, shared.ranked)
    of_rare = _unpack(sums) if sums else [np.zeros(len(contexts) - len(ranks), np.int64)] * 2
    tables_of, customers_of = (np.concatenate([often[ranks], rare]) for often, rare in zip(shared.sums, of_rare))
    seen = np.flatnonzero(counts)
    own, place, customers = word[seen], context[seen], counts[seen].astype(np.int64)
    d1, d0 = shared.discounts
    hot_at = np.minimum(np.searchsorted(shared.hot, words), max(0, len(shared.hot) - 1))
    is_hot = shared.hot[hot_at] == words if len(shared.hot) else np.zeros(len(words), bool)
    base = 1.0 / (shared.vocabulary + 1)
    parent_weight = (STRENGTH + d0 * shared.parent_tables) * base

    def parent(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        eaten = np.bincount(own, weights=tables, minlength=len(words)).astype(np.int64)
        whole = eaten.copy()
        if is_hot.any():
            whole[is_hot] = np.maximum(shared.hot_customers[hot_at[is_hot]], eaten[is_hot]).astype(np.int64)
        above = np.zeros(len(words))
        if is_hot.any():
            # Seated once for all partitions, but in the first round.
            above[is_hot] = np.minimum(shared.hot_tables[hot_at[is_hot]], whole[is_hot])
        known = np.flatnonzero((whole > 0) & (above == 0))
        seats = Seating(whole[known], np.full(len(known), parent_weight), d0, rng)
        seats.sweep()
        above[known] = seats.tables
        total = max(shared.parent_customers, float(whole.sum()) if not shared.parent_customers else 0.0)
        probability = (
            np.maximum(whole - d0 * above, 0) + (STRENGTH + d0 * max(shared.parent_tables, float(shared.vocabulary > 0))) * base
        ) / (STRENGTH + total)
        return eaten, above, probability

    eaten, above, probability = parent(np.ones(len(own)))
    weight = (STRENGTH + d1 * tables_of[place]) * probability[own]
    seats = Seating(customers, weight, d1, rng)
    # A sweep draws from the exact distribution whatever was before: none is needed before the first one kept.
    for sample in range(samples):
        seats.sweep()
        eaten, above, probability = parent(seats.tables)
        yield (
            words, contexts, word, context, counts, ranks, seen, seats, eaten, above, probability, is_hot, hot_at,
            tables_of, customers_of,
        )
        if sample < samples - 1:
            seats.reweigh((STRENGTH + d1 * tables_of[place]) * probability[own])


def _round(model: DataFrame, shared: _Shared, turn: int, parts: int) -> tuple[DataFrame, _Shared, str]:
    """Samples seatings everywhere; the sums of each partition's contexts without a rank (for ``_context_sums``), the next
    totals, and the folder the former are in."""
    known = model.sparkSession.sparkContext.broadcast(_plain(shared))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, sums in zip(batch.column("part").to_pylist(), batch.column("model"), batch.column("sums")):
                for words, contexts, _, context, counts, ranks, seen, seats, eaten, above, _, is_hot, *_ in _sampled(
                    data.as_py(), sums.as_py(), known.value, part, turn, 1
                ):
                    pass
                tables = np.bincount(context[seen], weights=seats.tables, minlength=len(contexts))
                customers = np.bincount(context[seen], weights=counts[seen], minlength=len(contexts))
                kinds, keys, values, blobs = [], [], [], []
                tables, customers = tables.astype(np.int64), customers.astype(np.int64)
                for cut in np.split(np.arange(len(ranks)), _starts(ranks // _SLICE)[1:]):
                    if len(cut):
                        kinds.append("often"), keys.append(int(ranks[cut[0]]) // _SLICE), values.append(0.0)
                        blobs.append(_pack(ranks[cut] % _SLICE, tables[cut], customers[cut]))
                shard = mixed(contexts[len(ranks):]) % np.uint64(parts)
                order = np.argsort(shard, kind="stable")
                ends = np.searchsorted(shard[order], np.arange(parts + 1))
                for k in range(parts):
                    cut = order[ends[k] : ends[k + 1]] + len(ranks)
                    # A partition without such contexts still has one entry.
                    if len(cut) or not k:
                        kinds.append("shard"), keys.append(k), values.append(0.0)
                        blobs.append(_pack(contexts[cut], tables[cut], customers[cut]))
                totals = {
                    0: eaten.sum(), 1: above[~is_hot].sum(), 2: (counts == 1).sum(), 3: (counts == 2).sum(),
                    4: (eaten[~is_hot] == 1).sum(), 5: (eaten[~is_hot] == 2).sum(),
                }
                for k, v in totals.items():
                    kinds.append("total"), keys.append(k), values.append(float(v)), blobs.append(None)
                for k in np.flatnonzero(is_hot):
                    kinds.append("hot"), keys.append(int(words[k].view(np.int64))), values.append(float(eaten[k])), blobs.append(None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(kinds), pa.int32()), pa.array(kinds), pa.array(keys, pa.int64()),
                     pa.array(values, pa.float64()), pa.array(blobs, pa.binary())],
                    ["part", "kind", "key", "value", "data"])

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros((2, _SLICE), np.int64)
        for x in table.column("data"):
            place, *values = _unpack(x.as_py())
            sums[:, place] += values
        return pa.table({"key": table.column("key")[:1], "data": pa.array([_pack(*sums)], pa.binary())})

    out, folder = _kept(model.select("part", "model", "sums").mapInArrow(
        sample, "part int, kind string, key long, value double, data binary"), "py-totals")

    after = _Shared(shared.vocabulary, shared.hot, shared.hot_counts, shared.ranked)
    # At most RANKED / _SLICE slices.
    often = out.where("kind = 'often'").select("key", "data").groupBy("key").applyInArrow(add, "key long, data binary")
    for row in often.collect():
        here = after.sums[:, row["key"] * _SLICE : (row["key"] + 1) * _SLICE]
        here[:] = [x[: here.shape[1]] for x in _unpack(bytes(row["data"]))]
    own = out.where("kind = 'shard'").select("part", F.col("key").alias("shard"), "data")
    # At most six totals and the hot words.
    sums = {(r["kind"], r["key"]): r["value"] for r in out.where("kind IN ('total', 'hot')").groupBy("kind", "key").agg(F.sum("value").alias("value")).collect()}
    total = [sums.get(("total", k), 0.0) for k in range(6)]
    after.discounts = (_discount(total[2], total[3]), _discount(total[4], total[5]))
    after.hot_customers = np.array([sums.get(("hot", int(w)), 0.0) for w in shared.hot.view(np.int64)])
    after.parent_customers = total[0]
    hot_tables = 0.0
    if len(shared.hot):
        weight = np.full(len(shared.hot), (STRENGTH + after.discounts[1] * total[1]) / (shared.vocabulary + 1))
        seats = Seating(np.maximum(after.hot_customers, 1).astype(np.int64), weight, after.discounts[1], np.random.default_rng(turn))
        seats.sweep()
        after.hot_tables = seats.tables
        hot_tables = float(seats.tables.sum())
    after.parent_tables = total[1] + hot_tables
    return own, after, folder


def _summed(uids: np.ndarray, times: np.ndarray, values: tuple[np.ndarray, ...]) -> tuple[list[int], list[bytes]]:
    """Sums of values per document, packed by groups of documents."""
    unique, at = np.unique(uids, return_inverse=True)
    sums = [np.bincount(at, weights=times * v, minlength=len(unique)) for v in values]
    tokens = np.bincount(at, weights=times, minlength=len(unique)).astype(np.uint32)
    group = unique >> _DOC_GROUP
    # Nothing, where all tokens of a partition are those of frequent pairs.
    cuts = _starts(group)
    return group[cuts].tolist(), [
        _pack(unique[a:b] - (unique[a] >> _DOC_GROUP << _DOC_GROUP), sums[0][a:b], sums[1][a:b], sums[2][a:b].astype(np.uint32), tokens[a:b])
        for a, b in zip(cuts, np.r_[cuts[1:], len(unique)])
    ]


def _scores(model: DataFrame, waiting: DataFrame, pairs: np.ndarray, shared: _Shared) -> DataFrame:
    """``docs, data``: sums of each document's score, base, known words and tokens, packed by groups of documents."""
    known = model.sparkSession.sparkContext.broadcast((_plain(shared), pairs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs = known.value
        for batch in batches:
            for part, model_data, token_data, sums_data in zip(
                batch.column("part").to_pylist(), batch.column("model"), batch.column("tokens"), batch.column("sums")
            ):
                mean = 0.0
                for (
                    words, contexts, word, context, counts, _, seen, seats, _, _, probability, is_hot, hot_at, tables_of, customers_of
                ) in _sampled(model_data.as_py(), sums_data.as_py(), now, part, ROUNDS, SAMPLES):
                    d1 = now.discounts[0]
                    own = np.zeros(len(word))
                    own[seen] = np.maximum(counts[seen] - d1 * seats.tables, 0)
                    share = STRENGTH + d1 * tables_of[context]
                    mean = mean + (own + share * probability[word]) / (STRENGTH + customers_of[context]) / SAMPLES
                times = np.bincount(word, weights=counts, minlength=len(words))
                times[is_hot] = now.hot_counts[hot_at[is_hot]]
                values = np.log10(mean), np.log10(times + 0.1)[word], (times > 0)[word].astype(np.float64)
                in_cell, n, uids = _unpack(token_data.as_py())
                groups, blobs = _summed(uids, n, tuple(np.repeat(v, in_cell) for v in values))
                place = _pair_places(pairs, contexts[context], words[word])
                here = np.flatnonzero(place >= 0)
                if len(here):
                    groups.append(None)
                    blobs.append(_pack(place[here], *(v[here] for v in values)))
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(blobs, pa.binary())], ["docs", "data"])

    sums, _ = _kept(model.mapInArrow(score, "docs long, data binary"), "py-sums")
    if len(pairs):
        # At most 2 / HOT pairs, each in one partition.
        of_pairs = np.zeros((3, len(pairs)))
        for row in sums.where("docs IS NULL").collect():
            place, *values = _unpack(bytes(row["data"]))
            of_pairs[:, place] = values
        known_pairs = model.sparkSession.sparkContext.broadcast(of_pairs)

        def score_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("tokens"):
                    pair, n, uids = _unpack(data.as_py())
                    groups, blobs = _summed(uids, n, tuple(known_pairs.value[:, pair]))
                    yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(blobs, pa.binary())], ["docs", "data"])

        of_waiting, _ = _kept(waiting.mapInArrow(score_pairs, "docs long, data binary"), "py-sums")
        sums = sums.where("docs IS NOT NULL").union(of_waiting)
    return sums


def _by_document(sums: DataFrame) -> DataFrame:
    """``uid, score, base, n_known, n_tokens`` from sums of partitions."""
    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros((4, 1 << _DOC_GROUP))
        there = np.zeros(1 << _DOC_GROUP, bool)
        for x in table.column("data"):
            place, *values = _unpack(x.as_py())
            there[place] = True
            for k, v in enumerate(values):
                sums[k, place] += v
        found = np.flatnonzero(there)
        first = table.column("docs")[0].as_py() << _DOC_GROUP
        return pa.table({
            "uid": pa.array(found + first), "score": pa.array(sums[0, found]), "base": pa.array(sums[1, found]),
            "n_known": pa.array(sums[2, found].astype(np.int64)), "n_tokens": pa.array(sums[3, found].astype(np.int64)),
        })

    return sums.groupBy("docs").applyInArrow(
        add, "uid long, score double, base double, n_known long, n_tokens long"
    )


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text is divisible by ten; the empty text's for null."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the text, with ``held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from rows that are not held out. Tokens are lower-cased (A-Z) words and one end. ``base_score`` sums
    log10((c + 0.1) / (N + 0.1 (V + 1))); ``score`` is the model's log10 probability of the text. Null and empty texts
    are an end only. Rows with null ids are held out; repeated rows count each time. With nothing to learn from, every
    token has probability 1. Columns with the names of results are replaced; an empty table gives no rows.
    """
    results = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in results))
    carried = [c for c in docs.columns if c.lower() != text_column.lower()]
    rows, texts = _kept(
        docs.select(
            F.struct(*named(carried)).alias("doc"), F.monotonically_increasing_id().alias("uid"),
            held_out(F.col(id_column)).alias("held_out"), F.col(text_column).alias("text"),
        ),
        "py-docs",
    )
    spark = rows.sparkSession
    counted, folder = _kept(_counted(rows.select("text", "held_out")), "py-words")
    words = counted.where("word IS NOT NULL AND before IS NULL")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ranked, times = _most_frequent(words)
    frequent = times > HOT * n
    order = np.argsort(ranked[frequent])
    hot = ranked[frequent][order]
    shared = _Shared(v, hot, times[frequent][order].astype(np.float64), ranked)
    tokens = counted.where("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counted.where(F.col("before").isNotNull() & (F.col("n") >= HOT / 2 * tokens)).select("before", "word").collect()
    pairs = np.array(sorted(tuple(int(np.int64(x).view(np.uint64)) for x in r) for r in often), np.uint64).reshape(-1, 2)
    drop_folder(spark, folder)
    # Held-out rows add about a tenth to the training tokens.
    parts = max(1, math.ceil(1.15 * n / _PART))
    model, models = _kept(_gathered(_dealt(rows.select("uid", "text", "held_out"), hot, pairs, parts, ranked), parts, ranked), "py-model")
    # The copy of the texts is not needed any more.
    bare, _ = _kept(rows.select("uid", "doc", "held_out"), "py-rows")
    drop_folder(spark, texts)
    waiting, model = model.where("model IS NULL").select("tokens"), model.where("model IS NOT NULL")
    cells = model.select("part", "model")
    placed, before = cells.withColumn("sums", F.lit(None).cast("binary")), None
    for turn in range(ROUNDS - 1):
        own, shared, folder = _round(placed, shared, turn, parts)
        if before:
            drop_folder(spark, before)
        placed, before = _context_sums(own, cells if turn < ROUNDS - 2 else model), folder
    sums = _scores(placed, waiting, pairs, shared)
    for folder in (models, before):
        drop_folder(spark, folder)
    own = F.lit(math.log10(n + 0.1 * (v + 1)))
    return bare.join(_by_document(sums), "uid").select(
        "doc.*", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * own).alias("base_score"), "score",
    )
