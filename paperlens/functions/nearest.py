"""The most similar papers of two blocks of papers, by the cosine of their tag weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast

#: Similarities are compared as multiples of UNIT; two roundings of a half may differ by SLACK of them.
UNIT, SLACK = 1e9, 1e-4
SCHEMA = "paper_id string, other_id string, dot double, n1 double, n2 double"


def _flat(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows in one: the tags, their weights, the row of each; the squared norm of each row."""

    tags, weights = table["tags"].combine_chunks(), table["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(table.num_rows), pc.list_value_length(tags).to_numpy(zero_copy_only=False))
    return tags.flatten(), weights, rows, np.bincount(rows, weights * weights, table.num_rows)


class _Others:
    """A block of papers in the order of their ids, by tag: the papers that have it, with its weight."""

    def __init__(self, tags: np.ndarray, weights: np.ndarray, rows: np.ndarray, norms: np.ndarray, n_tags: int, full: bool):
        known = tags >= 0
        order = np.flatnonzero(known)[np.argsort(tags[known], kind="stable")]
        self.n, self.norms, self.full = len(norms), norms, full
        self.rows, self.weights = rows[order], weights[order]
        self.squares = self.weights * self.weights
        self.at = np.concatenate([[0], np.cumsum(np.bincount(tags[known], minlength=n_tags))]).tolist()
        #: With other weights a paper may be more similar than its bound, or papers with one tag in common not equally so.
        self.plain = bool(np.all((weights > 0) & np.isfinite(weights)))
        self.columns: dict[int, np.ndarray] = {}
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.dot, self.shared = np.zeros(self.n), np.zeros(self.n)

    def column(self, tag: int) -> np.ndarray:
        """The weight of a popular tag in every paper."""

        if tag not in self.columns:
            s, e = self.at[tag], self.at[tag + 1]
            self.columns[tag] = np.zeros(self.n)
            self.columns[tag][self.rows[s:e]] = self.weights[s:e]
        return self.columns[tag]

    def ordered(self, tag: int) -> tuple[np.ndarray, np.ndarray]:
        """The papers of a popular tag by its share of their norm, the greatest first, and the shares with the sign changed."""

        if tag not in self.sorted:
            s, e = self.at[tag], self.at[tag + 1]
            share = -self.weights[s:e] / np.sqrt(self.norms[self.rows[s:e]])
            order = np.argsort(share, kind="stable")
            self.sorted[tag] = self.rows[s:e][order], share[order]
        return self.sorted[tag]

    def best(self, rows: np.ndarray, popular: list[tuple[int, float]], n1: float, me: int, k: int, least: float) -> tuple[tuple[np.ndarray, ...], float]:
        """Of some rows, in order, all that may be among the k best whichever way halves are rounded; the k-th best similarity, which is
        `least` at least."""

        dot, shared = self.dot[rows], self.shared[rows]
        for tag, w in popular:
            x = self.column(tag)[rows]
            dot += w * x
            shared += x * x
        n2 = self.norms[rows] if self.full else shared
        sim = dot / (np.sqrt(n1) * np.sqrt(n2)) * UNIT
        sim[np.isnan(sim)] = np.inf
        use = (sim > 0) & ~(n2 <= 0) & (rows != me)
        low, high = np.floor(sim + (0.5 - SLACK)), np.floor(sim + (0.5 + SLACK))
        low[~use] = high[~use] = -1
        if len(rows) > k:
            least = max(least, float(np.partition(low, len(low) - k)[len(low) - k]))
        keep = np.flatnonzero(use & (high >= least))
        if len(keep) > k:
            level = low[keep] == least
            ahead = np.count_nonzero(low[keep] > least) + np.cumsum(level) - level
            keep = keep[(high[keep] > least) | (ahead < k)]
        return (rows[keep], dot[keep], n2[keep]), least

    def alone(self, tag: int, cosine: float, me: int, k: int) -> np.ndarray:
        """Of the papers that share only this tag, all that may be among the k best. They are the more similar the greater its share of
        their norm, or all alike where that is taken over shared tags."""

        if not self.full:
            rows = self.rows[self.at[tag] : self.at[tag + 1]]
            return rows[np.flatnonzero((self.shared[rows] == 0) & (rows != me))[:k]]
        rows, share = self.ordered(tag)
        free = np.flatnonzero((self.shared[rows] == 0) & (rows != me))
        if len(free) > k:
            free = free[: np.searchsorted(share[free], share[free[k - 1]] + 3 / UNIT / cosine, "right")]
        return rows[free]

    def search(self, tags: list[int], weights: list[float], n1: float, me: int, k: int, least: float) -> tuple[tuple[np.ndarray, ...], float]:
        """The rows among which are the k papers most similar to one with these tags, their dot products and squared norms; the k-th best
        similarity so far. `least` is that of other blocks.

        Papers with one of its less common tags are looked at first. Those with popular tags only are left out where the bound of their
        similarity, the share of these tags in the norm, is below the k-th best.
        """

        popular = []
        for tag, w in zip(tags, weights, strict=True):
            s, e = (self.at[tag], self.at[tag + 1]) if tag >= 0 else (0, 0)
            if (e - s) * 8 > self.n:
                popular.append((tag, w))
            elif e > s:
                rows = self.rows[s:e]
                self.dot[rows] += w * self.weights[s:e]
                self.shared[rows] += self.squares[s:e]
        hits = np.flatnonzero(self.shared)
        found, least = self.best(hits, popular, n1, me, k, least)
        if popular:
            bound = float(np.sqrt(sum(w * w for _, w in popular) / n1))
            if not (self.plain and bound * UNIT + 2 < least):
                w = popular[0][1]
                if self.plain and len(popular) == 1 and w > 0 and (self.full or abs(bound * UNIT % 1 - 0.5) > 2 * SLACK):
                    rows = np.union1d(hits, self.alone(popular[0][0], bound, me, k))
                else:
                    rows = np.flatnonzero(sum((self.column(tag) != 0 for tag, _ in popular), self.shared != 0))
                found, least = self.best(rows, popular, n1, me, k, least)
        self.dot[hits] = self.shared[hits] = 0
        return found, least


def nearest(asked: pa.Table, others: pa.Table, k: int, full: bool, least: np.ndarray | None = None) -> pa.Table:
    """For each of `asked`(paper_id, tags, weights) the k best of `others` and those that tie with them; see `related`.

    `least` has the k-th best similarity of each in other blocks, as a multiple of UNIT, and is brought up to date: what is below isn't given out.
    """

    names = ["paper_id", "other_id", "dot", "n1", "n2"]
    kinds = [pa.string(), pa.string(), *[pa.float64()] * 3]
    if not asked.num_rows or not others.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names)
    others = others.combine_chunks()
    others = others.take(pc.sort_indices(others["paper_id"])).combine_chunks()
    own, their = _flat(asked), _flat(others)
    words = pa.chunked_array([their[0], own[0]]).combine_chunks().dictionary_encode()
    codes = words.indices.fill_null(-1).to_numpy().astype(np.int64)
    block = _Others(codes[: len(their[0])], *their[1:], len(words.dictionary), full)
    tags, weights = codes[len(their[0]) :].tolist(), own[1].tolist()
    at = np.concatenate([[0], np.cumsum(np.bincount(own[2], minlength=asked.num_rows))]).tolist()
    me = pc.index_in(asked["paper_id"], value_set=others["paper_id"].combine_chunks()).fill_null(-1).to_pylist()
    least = np.full(asked.num_rows, -1.0) if least is None else least
    found = []
    with np.errstate(all="ignore"):
        for i, n1 in enumerate(own[3].tolist()):
            if not n1 <= 0:
                best, least[i] = block.search(tags[at[i] : at[i + 1]], weights[at[i] : at[i + 1]], n1, me[i], k, float(least[i]))
                found.append((i, *best))
    mine = np.repeat(np.array([x[0] for x in found], int), [len(x[1]) for x in found])
    row, dot, n2 = (np.concatenate([x[j] for x in found] or [np.zeros(0)]) for j in (1, 2, 3))
    return pa.table([asked["paper_id"].combine_chunks().take(pa.array(mine)), others["paper_id"].combine_chunks().take(pa.array(row.astype(np.int64))), dot, own[3][mine], n2], names)


def packed(table: pa.Table) -> bytes:
    """A table as a stream of bytes."""

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """The rows in tables of `block` rows, the last of them with what remains."""

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, block - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == block:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def searcher(mine: Broadcast[bytes], k: int, full: bool, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that searches the asked papers of a broadcast, `packed`, in a partition of the others, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.ipc.open_stream(mine.value).read_all().combine_chunks()
        least = np.full(asked.num_rows, -1.0)
        for others in blocks(batches, block):
            yield from nearest(asked, others, k, full, least).to_batches()

    return run
