"""Replicates of weighted metrics, all replicates of a cell at once as one array.

Resampling n rows with replacement is one multinomial draw over the rows' cells.
It is made by splitting: the replicates' totals of a range of cells are divided
between its two halves by binomial draws, down to single cells.  The generator of
a split is keyed by the seed and the range, so any task can walk down to the cells
it holds, repeats itself after a failure, and learns on its way what falls before
them.  Nothing is rounded, at any count, and no cell is copied per replicate.

Metrics are formed block by block of ordered scores (running sums along the block
plus what lies before it) and merge by sums, minima and the first crossing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd

from ..functions.scalars import bayes_threshold
from .metrics import PRIORS

METRICS = ["eer_pct", "cllr", *[f"{kind}_dcf_{tag}" for tag in PRIORS for kind in ("min", "act")]]


def generator(seed: int, *place: int) -> np.random.Generator:
    """A stream of its own for every place; the same after every restart."""
    key = zlib.crc32(repr(place).encode()) << 32 | (seed & 0xFFFFFFFF)
    return np.random.Generator(np.random.Philox(key=[key, hash(place) & (2**64 - 1)]))


def split_range(total: np.ndarray, before: np.ndarray, ends: np.ndarray, want: int, seed: int, *place: int) -> tuple[np.ndarray, np.ndarray]:
    """Walk from the replicates' ``total`` over all ranges down to range ``want``.

    ``ends``: running sum of the ranges' counts.  Returns the draws of the range and
    ``before`` plus all draws of earlier ranges.
    """
    low, high = 0, len(ends)
    while high - low > 1:
        mid = (low + high) // 2
        base = int(ends[low - 1]) if low else 0
        left, both = int(ends[mid - 1]) - base, int(ends[high - 1]) - base
        first = generator(seed, *place, low, high).binomial(total, left / both) if both else np.zeros_like(total)
        if want < mid:
            total, high = first, mid
        else:
            total, before, low = total - first, before + first, mid
    return total, before


#: Mean count of a cell up to which rows are drawn one by one, which costs less than binomial draws per cell.
FEW = 4
#: Replicates whose running sums are formed together, few enough for a core's cache.
TOGETHER = 128


def split_cells(total: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Multinomial draws (cells x replicates) with the given totals: row by row where cells hold few
    rows, else by halving all ranges of a level together."""
    m, n_rows = len(counts), int(counts.sum())
    if 0 < n_rows <= FEW * m and total.sum() <= 2 * FEW * m * len(total):
        cell = np.repeat(np.arange(m) * len(total), counts)
        at = cell[rng.integers(0, n_rows, int(total.sum()), dtype=np.int32)]
        at += np.repeat(np.arange(len(total)), total)
        return np.bincount(at, minlength=m * len(total)).reshape(m, len(total))
    size = 1 << max(0, int(m - 1).bit_length())
    padded = np.zeros(size, np.int64)
    padded[:m] = counts
    levels = [padded]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(1))
    draws = total[None, :]
    for sums in reversed(levels[:-1]):
        left, both = sums[0::2], sums[0::2] + sums[1::2]
        share = np.divide(left, both, out=np.zeros(len(left)), where=both > 0)
        first = rng.binomial(draws, share[:, None])
        draws = np.stack([first, draws - first], 1).reshape(-1, total.shape[0])
    return draws[:m]


class Block:
    """Sums, minima and first crossings of replicates over blocks of descending scores."""

    def __init__(self, samples: int):
        self.sums = np.zeros((2 + 2 * len(PRIORS), samples))
        self.least = np.full((len(PRIORS), samples), np.inf)
        self.at = np.full(samples, np.iinfo(np.int64).max)
        self.eer = np.full(samples, np.nan)

    def add(self, at: int, score: np.ndarray, wt: np.ndarray, wn: np.ndarray, before: tuple, totals: tuple) -> tuple:
        """Cells of descending scores with weights (cells x replicates); returns the sums up to their end."""
        softplus = np.maximum(score, 0.0) + np.log1p(np.exp(-np.abs(score)))
        n_hits = [int(np.count_nonzero(score >= bayes_threshold(prior))) for prior in PRIORS.values()]  # scores descend, so these come first
        all_t, all_n = (np.asarray(x, float) for x in totals)
        after = np.empty((2, wt.shape[1]))
        for first in range(0, wt.shape[1], TOGETHER):
            some = slice(first, first + TOGETHER)
            ends = self._add(some, at, score, softplus, n_hits, wt[:, some].astype(float), wn[:, some].astype(float), (before[0][some], before[1][some]), all_t[some], all_n[some])
            after[:, some] = ends
        return after[0], after[1]

    def _add(self, some: slice, at: int, score, softplus, n_hits, wt, wn, before, all_t, all_n) -> tuple:
        self.sums[0, some] += (softplus - score) @ wt
        self.sums[1, some] += softplus @ wn
        run_t, run_n = np.cumsum(wt, axis=0, out=wt), np.cumsum(wn, axis=0, out=wn)
        end_t, end_n = run_t[-1].copy(), run_n[-1].copy()
        for k, n_hit in enumerate(n_hits):
            self.sums[2 + 2 * k, some] += end_t - (run_t[n_hit - 1] if n_hit else 0.0)
            self.sums[3 + 2 * k, some] += run_n[n_hit - 1] if n_hit else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            miss = np.subtract(all_t - before[0], run_t, out=run_t)
            miss /= all_t
            false = np.add(before[1], run_n, out=run_n)
            false /= all_n
            cost, part = np.empty_like(miss), np.empty_like(miss)
            for k, prior in enumerate(PRIORS.values()):
                np.multiply(miss, prior, out=cost)
                np.multiply(false, 1 - prior, out=part)
                cost += part
                self.least[k, some] = np.fmin(self.least[k, some], cost.min(axis=0) / min(prior, 1 - prior))
            # misses fall and false alarms rise along the block, so one that crosses has done so at its end
            found = (false[-1] >= miss[-1]) & (at < self.at[some])
            if found.any():
                row = (false >= miss).argmax(axis=0)
                col = np.arange(len(row))
                start_miss, start_false = (all_t - before[0]) / all_t, before[1] / all_n
                left_miss = np.where(row > 0, miss[row - 1, col], start_miss)
                left_false = np.where(row > 0, false[row - 1, col], start_false)
                right_miss, right_false = miss[row, col], false[row, col]
                left, gap = left_false - left_miss, (left_false - left_miss) - (right_false - right_miss)
                alpha = np.clip(np.where(gap == 0, 0.0, left / gap), 0.0, 1.0)
                self.eer[some][found] = (left_false + alpha * (right_false - left_false))[found]
                self.at[some][found] = at
        return before[0] + end_t, before[1] + end_n

    def merge(self, other: Block) -> None:
        self.sums += other.sums
        self.least = np.fmin(self.least, other.least)
        earlier = other.at < self.at
        self.eer[earlier], self.at[earlier] = other.eer[earlier], other.at[earlier]

    def pack(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.sums, self.least, self.at, self.eer))

    @classmethod
    def unpack(cls, blob: bytes, samples: int) -> Block:
        out, rows = cls(samples), np.frombuffer(blob, np.float64).reshape(-1, samples)
        n, m = len(out.sums), len(out.least)
        out.sums, out.least = rows[:n].copy(), rows[n : n + m].copy()
        out.at, out.eer = rows[n + m].view(np.int64).copy(), rows[n + m + 1].copy()
        return out

    def metrics(self, totals: tuple) -> pd.DataFrame:
        """One row per replicate; undefined (null) where a class has no weight."""
        all_t, all_n = totals
        with np.errstate(divide="ignore", invalid="ignore"):
            out = {"eer_pct": 100.0 * self.eer, "cllr": 0.5 / np.log(2.0) * (self.sums[0] / all_t + self.sums[1] / all_n)}
            for k, (tag, prior) in enumerate(PRIORS.items()):
                never = prior / min(prior, 1 - prior)
                out[f"min_dcf_{tag}"] = np.fmin(self.least[k], never)
                out[f"act_dcf_{tag}"] = (prior * self.sums[2 + 2 * k] / all_t + (1 - prior) * self.sums[3 + 2 * k] / all_n) / min(prior, 1 - prior)
        both = (all_t > 0) & (all_n > 0)
        return pd.DataFrame({m: np.where(both, out[m], np.nan) for m in METRICS})


class Walker:
    """A range of descending scores fed in pieces; rows of one score are one operating point."""

    def __init__(self, at: int, before: tuple, totals: Sequence[np.ndarray], samples: int):
        self.at, self.before, self.totals = at, before, tuple(totals)
        self.block, self.open = Block(samples), None

    def feed(self, score: np.ndarray, wt: np.ndarray, wn: np.ndarray) -> None:
        if self.open is not None:  # the last score may go on
            score, wt, wn = (np.concatenate([a, b]) for a, b in zip(self.open, (score, wt, wn)))
        starts = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        wt, wn, score = np.add.reduceat(wt, starts, axis=0), np.add.reduceat(wn, starts, axis=0), score[starts]
        self.open = (score[-1:], wt[-1:], wn[-1:])
        if len(score) > 1:
            self.before = self.block.add(self.at, score[:-1], wt[:-1], wn[:-1], self.before, self.totals)

    def finished(self) -> Block:
        self.block.add(self.at, *self.open, self.before, self.totals)
        return self.block


def runs(parts: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Pieces of sorted rows that share their keys, as they come."""
    keys = list(keys)
    for part in parts:
        if len(part):
            change = np.zeros(len(part), bool)
            for k in keys:
                c = part[k]
                change |= ~((c == c.shift()) | (c.isna() & c.shift().isna())).to_numpy()
            change[0] = True
            edges = [*np.flatnonzero(change).tolist(), len(part)]
            for a, b in zip(edges, edges[1:]):
                rows = part.iloc[a:b]
                yield tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in (rows[k].iloc[0] for k in keys)), rows


def whole_runs(parts: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """All rows of each key together, for groups of bounded size."""
    held, last = [], None
    for key, rows in runs(parts, keys):
        if held and key != last:
            yield last, pd.concat(held, ignore_index=True)
            held = []
        held.append(rows)
        last = key
    if held:
        yield last, pd.concat(held, ignore_index=True)


def partial_blocks(made: Callable[[Iterator[pd.DataFrame]], Iterator[tuple[tuple, Block]]], keys: Sequence[str]):
    """A function for mapInPandas: one packed block per group of a task."""
    keys = list(keys)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[tuple, Block] = {}
        for key, block in made(parts):
            if key in by:
                by[key].merge(block)
            else:
                by[key] = block
        if by:
            out = pd.DataFrame(list(by), columns=keys)
            out["block"] = [b.pack() for b in by.values()]
            yield out

    return rows


def merged_blocks(parts: Iterator[pd.DataFrame], keys: Sequence[str], samples: int, totals: Callable[[tuple], tuple]) -> Iterator[pd.DataFrame]:
    """Sorted packed blocks -> metrics of each group and replicate (from 1); one block is held."""

    def finished(key: tuple, block: Block) -> pd.DataFrame:
        out = block.metrics(totals(key))
        for k, v in reversed(list(zip(keys, key))):
            out.insert(0, k, v)
        out.insert(0, "replicate", np.arange(1, samples + 1))
        return out

    last, whole = None, None
    for key, rows in runs(parts, keys):
        if whole is not None and key != last:
            yield finished(last, whole)
            whole = None
        for blob in rows["block"]:
            some = Block.unpack(bytes(blob), samples)
            if whole is None:
                last, whole = key, some
            else:
                whole.merge(some)
    if whole is not None:
        yield finished(last, whole)
