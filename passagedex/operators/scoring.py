"""Scores of passages, summed inside each task from postings ordered by passage.

A task reads its postings once, whatever the number of queries. The scores of
some passages are summed at a time, as whole numbers. All of them are given
out, or only rows that can still be among the best k of their query are kept,
so what a task holds does not grow with the matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from passagedex.functions.bm25 import SCORE_UNIT

# Pairs of posting and query term that a task expands at a time.
PAIRS = 1_000_000

# Postings that a task takes up before it scores them.
ROWS = 100_000

# Sums are kept for every passage and query unless these are so many times the pairs.
SPARSE = 8


class QueryPart(NamedTuple):
    """Rows of query terms, as many as one broadcast holds.

    `floor` is a score the k-th best surely has. Terms that are not `needed` cannot
    lift a passage to it by themselves: passages count once their needed terms come to
    `bar`.
    """

    ids: pa.Array
    query: np.ndarray
    term: np.ndarray
    factor: np.ndarray
    needed: np.ndarray
    floor: np.ndarray
    bar: np.ndarray

    def highest(self) -> float:
        """Largest sum of a query's factors, whatever their sign."""
        return float(np.bincount(self.query, np.abs(self.factor)).max())


def query_parts(factors: pa.Table, terms: pa.Array, most_rows: int) -> Iterator[QueryPart]:
    """`factors` by query, in parts of at most so many rows or of one query.

    It has query_id, term, factor, needed, floor and bar; `terms` gives a term its number.
    """
    coded = factors["query_id"].combine_chunks().dictionary_encode("encode")
    query = coded.indices.to_numpy()
    order = np.argsort(query, kind="stable")
    query = query[order]
    term = pc.index_in(factors["term"], value_set=terms).to_numpy()[order]
    factor, needed, floor, bar = (
        factors[name].to_numpy()[order] for name in ("factor", "needed", "floor", "bar")
    )
    first = np.flatnonzero(np.diff(query, prepend=-1))
    stops = np.append(first[1:], len(query))
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(stops, first[at] + most_rows, "right")))
        rows, heads = slice(first[at], stops[end - 1]), first[at:end]
        yield QueryPart(
            coded.dictionary.slice(at, end - at),
            query[rows] - at,
            term[rows],
            factor[rows],
            needed[rows],
            floor[heads],
            bar[heads],
        )
        at = end


class _Terms:
    """Queries and factors of every term, one term after another."""

    def __init__(self, query: np.ndarray, term: np.ndarray, factor: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.query, self.factor = query[order], factor[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def counts(self, number: np.ndarray) -> np.ndarray:
        return self.starts[number + 1] - self.starts[number]

    def pairs(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posting and place here of every pair."""
        n = self.counts(number)
        posting = np.repeat(np.arange(len(number)), n)
        before = np.cumsum(n) - n
        return posting, np.arange(len(posting)) + (self.starts[number] - before)[posting]


class _Best:
    """Running k best passages of every query."""

    def __init__(self, parts: list[QueryPart], n_terms: int, k: int):
        self.k = k
        self.ids = pa.chunked_array([part.ids for part in parts]).combine_chunks()
        sizes = [len(part.ids) for part in parts]
        shifts = np.cumsum([0, *sizes[:-1]])
        query = np.concatenate([p.query + s for p, s in zip(parts, shifts, strict=True)])
        term, factor, needed, floor, self.bar = (
            np.concatenate([getattr(part, name) for part in parts])
            for name in ("term", "factor", "needed", "floor", "bar")
        )
        self.n = len(self.ids)
        self.needed = _Terms(query[needed], term[needed], factor[needed], n_terms)
        self.others = _Terms(query[~needed], term[~needed], factor[~needed], n_terms)
        # Lowest score that still counts; 0 never does. Among equals the key decides,
        # once there are k.
        self.worst = np.maximum(floor, 1)
        self.last = np.full(self.n, None, dtype=object)
        self.kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, dtype=object))
        self.fresh, self.n_fresh = [], 0

    def add(self, keys: np.ndarray, row: np.ndarray, number: np.ndarray, weight: np.ndarray):
        """Whole passages: their keys, and the passage, term and weight of every posting."""
        count = self.needed.counts(number) + self.others.counts(number)
        for at, stop, part in _pieces(row, count, len(keys)):
            self._add(keys[at:stop], row[part] - at, number[part], weight[part])

    def _add(self, keys, row, number, weight) -> None:
        cell, units = self._expanded(self.needed, row, number, weight)
        if len(keys) * self.n <= SPARSE * len(cell):
            sums = np.zeros(len(keys) * self.n, dtype=np.int64)
            np.add.at(sums, cell, units)
            cells = np.flatnonzero(sums)
            sums = sums[cells]
        else:
            cells, sums = _summed(cell, units)
        fit = sums >= self.bar[cells % self.n]
        cells, sums = cells[fit], sums[fit]
        if len(self.others.query) and len(cells):
            held = np.zeros(len(keys), dtype=bool)
            held[cells // self.n] = True
            more = held[row]
            cell, units = self._expanded(
                self.others, row[more], number[more], weight[more], cells
            )
            np.add.at(sums, np.searchsorted(cells, cell), units)
        query = cells % self.n
        fit = sums >= self.worst[query]
        query, sums, found = query[fit], sums[fit], keys[cells[fit] // self.n]
        equal = np.flatnonzero(sums == self.worst[query])
        last = self.last[query[equal]]
        full = np.array([key is not None for key in last], dtype=bool)
        late = equal[full][found[equal[full]] > last[full]] if full.any() else equal[:0]
        if len(late):
            query, sums, found = (np.delete(column, late) for column in (query, sums, found))
        if len(query):
            self._keep(query, sums, found)

    def _expanded(self, terms, row, number, weight, among=None):
        """Cell, the passage and query in one number, and score of every pair."""
        posting, place = terms.pairs(number)
        cell = row[posting] * self.n + terms.query[place]
        if among is not None:
            at = np.minimum(np.searchsorted(among, cell), len(among) - 1)
            fit = among[at] == cell
            posting, place, cell = posting[fit], place[fit], cell[fit]
        units = np.rint(terms.factor[place] * weight[posting] * SCORE_UNIT).astype(np.int64)
        return cell, units

    def _keep(self, query, units, keys) -> None:
        # By score alone first: keys are compared among the few that can matter.
        order = np.lexsort((-units, query))
        query, units, keys = query[order], units[order], keys[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        bound = np.zeros(self.n, dtype=np.int64)
        kth = place == self.k - 1
        bound[query[kth]] = units[kth]
        fit = units >= bound[query]
        self.fresh.append((query[fit], units[fit], keys[fit]))
        self.n_fresh += int(fit.sum())
        if self.n_fresh * 4 >= len(self.kept[0]):
            self._settle()

    def _settle(self) -> None:
        query, units, keys = map(np.concatenate, zip(self.kept, *self.fresh, strict=True))
        self.fresh, self.n_fresh = [], 0
        order = np.lexsort((keys, -units, query))
        query, units, keys = query[order], units[order], keys[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kth = place == self.k - 1
        self.worst[query[kth]] = units[kth]
        self.last[query[kth]] = keys[kth]
        best = place < self.k
        self.kept = (query[best], units[best], keys[best])

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        query, units, keys = self.kept
        if len(query):
            yield pa.RecordBatch.from_arrays(
                [self.ids.take(pa.array(query)), pa.array(keys, pa.string()), pa.array(units)],
                names=["query_id", "doc_key", "units"],
            )


def _pieces(row: np.ndarray, count: np.ndarray, n: int) -> Iterator[tuple[int, int, slice]]:
    """Passages with at most so many pairs as are expanded at a time, or one; and their rows."""
    passed = np.cumsum(np.bincount(row, weights=count, minlength=n))
    at = 0
    while at < n:
        limit = (passed[at - 1] if at else 0) + PAIRS
        stop = max(at + 1, int(np.searchsorted(passed, limit, "right")))
        yield at, stop, slice(*np.searchsorted(row, [at, stop]))
        at = stop


class _All:
    """Scores of every passage and query that share a term."""

    def __init__(self, parts: list[QueryPart], n_terms: int):
        self.ids = pa.chunked_array([part.ids for part in parts]).combine_chunks()
        shifts = np.cumsum([0, *(len(part.ids) for part in parts[:-1])])
        query = np.concatenate([p.query + s for p, s in zip(parts, shifts, strict=True)])
        term, factor = (
            np.concatenate([getattr(part, name) for part in parts]) for name in ("term", "factor")
        )
        self.n = len(self.ids)
        self.terms = _Terms(query, term, factor, n_terms)

    def rows(self, passages: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Of passages with their postings as lists."""
        keys, lists = passages["doc_key"], passages["numbers"]
        row = np.repeat(np.arange(len(keys)), pc.list_value_length(lists).to_numpy())
        number, weight = lists.flatten().to_numpy(), passages["weights"].flatten().to_numpy()
        for at, stop, part in _pieces(row, self.terms.counts(number), len(keys)):
            posting, place = self.terms.pairs(number[part])
            cell = (row[part] - at)[posting] * self.n + self.terms.query[place]
            units = self.terms.factor[place] * weight[part][posting] * SCORE_UNIT
            units = np.rint(units).astype(np.int64)
            cells = (stop - at) * self.n
            if cells <= SPARSE * len(cell):
                sums, there = np.zeros(cells, dtype=np.int64), np.zeros(cells, dtype=bool)
                np.add.at(sums, cell, units)
                there[cell] = True
                cell = np.flatnonzero(there)
                units = sums[cell]
            else:
                cell, units = _summed(cell, units)
            passage, query = np.divmod(cell, self.n)
            columns = [
                self.ids.take(pa.array(query)),
                keys.slice(at, stop - at).take(pa.array(passage)),
                pa.array(units),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _summed(cell: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cell, kind="stable")
    cell, units = cell[order], units[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    return cell[first], np.add.reduceat(units, first) if len(first) else units


def best_passages(
    postings: DataFrame, parts: list[Broadcast], n_terms: int, k: int, schema: T.StructType
) -> DataFrame:
    """(query_id, doc_key, units): the best k passages of every query in each task.

    `postings` has doc_key, number and weight, all of one passage one after another in
    one partition; doc_key is null but for the first of each.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, waiting, n_waiting = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            best = best or _Best([part.value for part in parts], n_terms, k)
            waiting.append(batch)
            n_waiting += batch.num_rows
            if n_waiting >= ROWS:
                rest = _take(best, waiting, False)
                waiting, n_waiting = [rest], rest.num_rows
        if best:
            _take(best, waiting, True)
            yield from best.rows()

    return postings.mapInArrow(scan, schema)


def all_passages(
    passages: DataFrame, parts: list[Broadcast], n_terms: int, schema: T.StructType
) -> DataFrame:
    """(query_id, doc_key, units): every passage that shares a term with a query.

    `passages` has doc_key, each once, and the numbers and weights of its postings.
    """
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = None
        for batch in batches:
            if batch.num_rows:
                every = every or _All([part.value for part in parts], n_terms)
                yield from every.rows(batch, names)

    return passages.mapInArrow(scan, schema)


def _take(best: _Best, batches: list[pa.RecordBatch], at_end: bool) -> pa.RecordBatch:
    """Score the passages that are there in full; the rows of one that may go on are left."""
    rows = pa.concat_batches(batches)
    firsts = np.flatnonzero(rows["doc_key"].is_valid().to_numpy(zero_copy_only=False))
    end = rows.num_rows if at_end else int(firsts[-1])
    firsts = firsts[firsts < end]
    if end:
        keys = np.array(rows["doc_key"].take(pa.array(firsts)).to_pylist(), dtype=object)
        started = np.zeros(end, dtype=np.int64)
        started[firsts] = 1
        number = rows["number"].to_numpy()[:end]
        best.add(keys, np.cumsum(started) - 1, number, rows["weight"].to_numpy()[:end])
    return rows.slice(end)
