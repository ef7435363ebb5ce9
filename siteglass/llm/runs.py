"""Periodic runs of words by longest common extensions on suffix trees.

A run is a stretch of words with smallest period q, at least four periods (and six words) long, that no neighbour extends. Every run holds a Lyndon
root: for the order of words or its reverse, the longest Lyndon word at some place of the run has the length of the period. Both kinds of longest
Lyndon words follow from the order of suffixes, the leaves of Ukkonen's tree. Each candidate is extended to the right by the tree of the
words and to the left by that of the reversed words: a common extension is the lowest common ancestor of two leaves, the least depth between
them on the Euler tour, which is looked up in constant time.

Trees are built over the words that can lie in a run: three words in a row of a run are found three times in it, so words outside of such
triples, counted again within each remaining stretch until none goes, belong to no run and end any that they stand beside.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import made, text_slices

LEAST_LENGTH, LEAST_PERIODS = 6, 4
BLOCK = 16
ODD = np.uint64(0x9E3779B97F4A7C15)


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches whose words may lie in runs; equal words have equal hashes, so none is missed."""
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    starts, ends = np.zeros(1, np.int64), np.array([len(words)])
    while True:
        long = ends - starts >= LEAST_LENGTH
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return []
        sizes = ends - starts - 2  # triples of each stretch
        part = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        with np.errstate(over="ignore"):
            keys = ((hashes[at] * ODD + hashes[at + 1]) * ODD + hashes[at + 2]) * ODD + part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(keys, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1], [True])))
        often = np.empty(len(keys), bool)
        often[order] = np.repeat(np.diff(edge) >= 3, np.diff(edge))
        covered = np.zeros(len(words) + 1, bool)
        for shift in range(3):
            covered[at[often] + shift] = True
        # A stretch that was cut stays cut: neighbours of different stretches are never adjacent.
        change = np.flatnonzero(np.diff(np.concatenate(([False], covered)).astype(np.int8)))
        found = change[0::2], change[1::2]
        if len(found[0]) == len(starts) and (found[0] == starts).all() and (found[1] == ends).all():
            return list(zip(starts.tolist(), ends.tolist()))
        starts, ends = found


class SuffixTree:
    """Ukkonen's tree of a list of integers whose last one is unique, with common extensions by the Euler tour."""

    def __init__(self, symbols: list[int]):
        n = len(symbols)
        start, end, link, parent = [0], [0], [0], [0]
        edges: dict[int, int] = {}
        node = size = 0  # active place: below ``node`` along the edge of symbols[place], ``size`` symbols deep
        first = 0  # first suffix that has no leaf yet
        for i, symbol in enumerate(symbols):
            waiting = 0  # inner node that still needs its suffix link
            while first <= i:
                place = i - size
                key = node << 32 | symbols[place]
                child = edges.get(key)
                if child is None:  # size is 0: a new leaf here
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    parent.append(node)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    length = end[child] - start[child]
                    if size >= length:
                        node = child
                        size -= length
                        continue
                    middle = start[child] + size
                    if symbols[middle] == symbol:
                        if waiting and node:
                            link[waiting] = node
                        size += 1
                        break
                    fork = len(start)
                    edges[key] = fork
                    start.append(start[child])
                    end.append(middle)
                    link.append(0)
                    parent.append(node)
                    start[child] = middle
                    parent[child] = fork
                    edges[fork << 32 | symbols[middle]] = child
                    edges[fork << 32 | symbol] = fork + 1
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    parent.append(fork)
                    if waiting:
                        link[waiting] = fork
                    waiting = fork
                first += 1
                if node:
                    node = link[node]
                elif size:
                    size -= 1
        del edges
        self._tour(np.array(symbols), np.array(start), np.array(end), np.array(parent))

    def _tour(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, parent: np.ndarray) -> None:
        """Walk the tree, children by symbol; note the depth at each step and where each leaf is met."""
        n, nodes = len(symbols), len(start)
        order = np.lexsort((symbols[start[1:]], parent[1:])) + 1
        begin = np.searchsorted(parent[order], np.arange(nodes + 1)).tolist()
        order, lengths, above, leaf = order.tolist(), (end - start).tolist(), parent.tolist(), (end == n).tolist()
        leaf[0] = False
        depths, met, ranked = [0], [0] * n, []
        walk, depth, node = begin[:-1], [0] * nodes, 0
        while True:
            at = walk[node]
            if at < begin[node + 1]:
                walk[node] = at + 1
                child = order[at]
                down = depth[node] + lengths[child]
                if leaf[child]:
                    met[n - down] = len(depths)
                    ranked.append(n - down)
                    depths.append(down)
                    depths.append(depth[node])
                else:
                    depth[child] = down
                    depths.append(down)
                    node = child
            elif node:
                node = above[node]
                depths.append(depth[node])
            else:
                break
        self.met, self.order = np.array(met), np.array(ranked)
        self.depths = LeastBetween(np.array(depths, np.int32))

    def ranks(self) -> np.ndarray:
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.arange(len(out))
        return out

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of symbols that agree from places ``a`` and ``b`` (different places) on."""
        left, right = self.met[a], self.met[b]
        return self.depths(np.minimum(left, right), np.maximum(left, right))


class LeastBetween:
    """Least value between two places (both included), in constant time: tables over blocks, prefixes and suffixes inside them."""

    def __init__(self, values: np.ndarray):
        size = -(-len(values) // BLOCK) * BLOCK
        self.values = np.full(size, np.iinfo(np.int32).max, np.int32)
        self.values[:len(values)] = values
        blocks = self.values.reshape(-1, BLOCK)
        self.upto = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [blocks.min(axis=1)]
        while 2 << len(self.levels) - 1 <= len(self.levels[0]):
            half, last = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = left // BLOCK, right // BLOCK
        out = np.minimum(self.onward[left], self.upto[right])
        apart = np.flatnonzero(b - a > 1)
        if len(apart):
            low, high = a[apart] + 1, b[apart] - 1
            level = np.frexp((high - low + 1).astype(float))[1] - 1
            for k in np.unique(level):
                of = level == k
                table = self.levels[k]
                out[apart[of]] = np.minimum(out[apart[of]], np.minimum(table[low[of]], table[high[of] - (1 << int(k)) + 1]))
        near = np.flatnonzero(a == b)
        if len(near):
            places = left[near, None] + np.arange(BLOCK)
            inside = np.where(places <= right[near, None], self.values[np.minimum(places, len(self.values) - 1)], np.iinfo(np.int32).max)
            out[near] = inside.min(axis=1)
        return out


def next_less(ranks: list[int]) -> list[int]:
    """For each place the next one with a lower rank; the number of places where there is none."""
    out, open_ = [len(ranks)] * len(ranks), []
    for i, rank in enumerate(ranks):
        while open_ and ranks[open_[-1]] > rank:
            out[open_.pop()] = i
        open_.append(i)
    return out


def runs_of(symbols: list[int], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of integers whose last one is unique, by start, then period."""
    n = len(symbols)
    tree = SuffixTree(symbols)
    ranks = tree.ranks()
    # Suffixes end in a unique symbol, so the reversed order of symbols reverses the order of suffixes.
    starts = np.concatenate([np.arange(n)] * 2)
    periods = np.concatenate([np.array(next_less(ranks.tolist())), np.array(next_less((-ranks).tolist()))]) - starts
    inside = starts + periods < n
    starts, periods = starts[inside], periods[inside]
    right = tree.extension(starts, starts + periods)
    del tree
    # A run has a root that starts in its first period, hence has all the other periods to its right.
    hopeful = right + periods > (least_periods - 1) * periods
    starts, periods, right = starts[hopeful], periods[hopeful], right[hopeful]
    if not len(starts):
        return []
    back = SuffixTree([*symbols[-2::-1], symbols[-1]])
    left = np.zeros(len(starts), np.int64)
    later = np.flatnonzero(starts > 0)
    mirror = n - 1 - starts[later]  # place of the word before the start, read backwards
    left[later] = back.extension(mirror, mirror - periods[later])
    length = right + left + periods
    good = length >= np.maximum(least_length, least_periods * periods)
    found = np.unique(np.stack([(starts - left)[good], periods[good], length[good]], axis=1), axis=0)
    return [(s, size, p) for s, p, size in found.tolist()]


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start, then period."""
    parts = stretches(words)
    if not parts:
        return []
    known: dict[bytes, int] = {}
    symbols, places, apart = [], [], len(words)
    for start, end in parts:
        symbols += [known.setdefault(w, len(known)) for w in words[start:end]]
        places += range(start, end)
        apart += 1
        symbols.append(apart)  # a symbol of its own ends each stretch
        places.append(end)
    return [(places[s], size, p) for s, size, p in runs_of(symbols)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the text without repeated periods).

    Words are what stands between blanks and U+0009 to U+000D; a null text has none, and its collapsed text is empty. Equal runs of different
    periods can't occur, as a run is listed under its smallest period. Repeated rows and null ids stay as they are; other columns are ignored. A task
    holds one text's trees at a time: some 600 bytes a word of those that can lie in runs.
    """

    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            counts, found, short = [], [], []
            for text in texts:
                words = text.encode("utf-8", "surrogatepass").split()
                runs = word_runs(words)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                short.append(collapsed(words, runs))
            yield made(batch, n_words=pa.array(counts, pa.int64()), runs=pa.array(found, run_type), collapsed=pa.array(short, pa.binary()).cast(pa.string()))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
