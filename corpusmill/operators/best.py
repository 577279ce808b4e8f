"""The best rows of many queries, found inside tasks: scores are matrices of queries and rows, and only the best rows of each query leave a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.sinks import written

#: Scores of a matrix, numbers of the queries that go to the tasks as they are, rows of a group that meets a block of more queries than that.
CELLS, NUMBERS, GROUP = 1 << 20, 1 << 21, 65_536
#: Scores are ranked at six places, so rows may tie that are so far apart.
SLACK = 2e-6


class Best:
    """The k best rows of each of n queries among rows that come in blocks: by score at so many places (None: all), then by the first column of the rows."""

    def __init__(self, n: int, k: int, places: int | None = 6, ties: str = "ascending") -> None:
        self.n, self.k, self.places, self.ties = n, k, places, ties
        self.bound, self.parts, self.waiting = np.full(n, -np.inf), [], 0

    def add(self, scores: np.ndarray, rows: pa.RecordBatch, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """scores: (queries, rows), -inf where a row is no hit. exact: the scores of places (queries, rows), if these are rounded."""
        may = self._may(scores)
        if np.count_nonzero(may) > 2 * self.k * self.n and scores.shape[1] > self.k:
            self.bound = np.maximum(self.bound, np.partition(scores, -self.k, axis=1)[:, -self.k])
            may = self._may(scores)
        q, r = np.nonzero(may)
        if len(q):
            score = scores[q, r] if exact is None else exact(q, r)
            self.parts.append(pa.table({"_q": pa.array(q, pa.int64()), "_score": score} | {c: rows.column(c).take(pa.array(r)) for c in rows.schema.names}))
            self.waiting += len(q)
            if self.waiting > max(4 * self.k * self.n, 100_000):
                self._settle()

    def _may(self, scores: np.ndarray) -> np.ndarray:
        return (scores >= (self.bound - SLACK)[:, None]) & (scores > -np.inf)

    def _settle(self) -> None:
        rows = pa.concat_tables(self.parts)
        score = rows["_score"].to_numpy()
        rows = rows.append_column("_key", pa.array(score if self.places is None else np.round(score, self.places)))
        rows = rows.sort_by([("_q", "ascending"), ("_key", "descending"), (rows.schema.names[2], self.ties)]).drop_columns("_key")
        q = rows["_q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], rows["_score"].to_numpy()[last])
        self.parts, self.waiting = [rows.filter(pa.array(place < self.k))], 0

    def rows(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """The best rows, with the ids of their queries before them and their score after them."""
        if self.parts:
            self._settle()
            found = self.parts[0]
            score = found["_score"].to_numpy()
            columns = {"query_id": ids.take(found["_q"].combine_chunks())} | {c: found[c] for c in found.schema.names[2:]} | {"score": np.where(np.isposinf(score), np.nan, score)}
            yield from pa.table(columns).combine_chunks().to_batches()


def matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Lists of numbers as rows of doubles; those of another size or with a null are zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), size), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), size))
    if size and fits.any():
        values = pc.list_flatten(lists.filter(pa.array(fits)))
        gaps = pc.is_null(values).to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1)
        out[fits] = np.where(gaps[:, None], 0.0, pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed in order."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _unit(rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return np.divide(rows, norms[:, None], out=np.zeros_like(rows), where=norms[:, None] != 0)


class Nearest:
    """Rows (columns, and embedding) against a block of queries (query_id, embedding): the k best of each query by cosine, or by a score that grows with it."""

    def __init__(self, queries: pa.Table, k: int, score: Callable[[np.ndarray], np.ndarray], places: int | None, ties: str) -> None:
        self.score = score
        sizes = pc.fill_null(pc.list_value_length(queries["embedding"]), 0).to_numpy()
        self.groups = []
        for size in np.unique(sizes):
            own = queries.filter(pa.array(sizes == size))
            q = matrix(own["embedding"], int(size))
            norms = np.sqrt(_dots(q, q))
            self.groups.append((own["query_id"].combine_chunks(), q, norms, _unit(q, norms), Best(len(q), k, places, ties)))

    def add(self, rows: pa.RecordBatch) -> None:
        kept = rows.drop_columns("embedding")
        for _, q, qn, unit, best in self.groups:
            a = matrix(rows.column("embedding"), q.shape[1])
            an = np.sqrt(_dots(a, a))
            whole = np.isfinite(an).all() and np.isfinite(qn).all()
            ua = _unit(a, an)
            step = max(1, CELLS // max(len(q), 1))
            for k in range(0, len(a), step):
                own, n = a[k : k + step], an[k : k + step]

                def exact(i: np.ndarray, j: np.ndarray, own: np.ndarray = own, n: np.ndarray = n, q: np.ndarray = q, qn: np.ndarray = qn) -> np.ndarray:
                    norm = n[j] * qn[i]
                    cosine = np.divide(_dots(own[j], q[i]), norm, out=np.zeros(len(i)), where=norm != 0)
                    return self._clear(self.score(cosine))

                scores = self.score(unit @ ua[k : k + step].T)
                best.add(scores if whole else self._clear(scores), kept.slice(k, step), exact)

    @staticmethod
    def _clear(scores: np.ndarray) -> np.ndarray:
        """No number ranks first, as in Spark."""
        return np.where(np.isnan(scores), np.inf, scores)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for ids, *_, best in self.groups:
            yield from best.rows(ids)


def nearest(rows: DataFrame, queries: DataFrame, k: int, score: Callable[[np.ndarray], np.ndarray], most: int, places: int | None = 6, ties: str = "ascending") -> DataFrame:
    """(query_id, the columns of rows but embedding, score): the k best rows of each query (query_id, embedding) within each task or group, which hold the k best of all.
    rows: their first column breaks ties, and embedding.

    Up to most queries go to the tasks with the function, so rows are read once and stay where they are. More are dealt to blocks that meet groups of rows by a shuffle."""
    kept = [c for c in rows.columns if c != "embedding"]
    kinds = dict(rows.dtypes)
    asked = written(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "query-vectors")
    schema = f"query_id {dict(asked.dtypes)['query_id']}, {', '.join(f'{c} {kinds[c]}' for c in kept)}, score double"
    n, size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    most = max(1, min(most, NUMBERS // max(size, 1)))
    rows = rows.select(*kept, "embedding")
    if n <= most:
        told = asked.toArrow()  # at most `most` queries

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest(told, k, score, places, ties)
            for batch in batches:
                near.add(batch)
            yield from near.rows()

        return rows.mapInArrow(search, schema)
    blocks, salts = -(-n // most), max(1, -(-rows.count() // GROUP))
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"salt": F.pmod(F.xxhash64(*kept), F.lit(salts)).cast("int"), "block": deal(blocks)})
    right = asked.withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "salt": deal(salts)})

    def meet(own: pa.Table, block: pa.Table) -> pa.Table:
        near = Nearest(block.select(["query_id", "embedding"]), k, score, places, ties)
        for batch in own.select([*kept, "embedding"]).to_batches(max_chunksize=8192):
            near.add(batch)
        found = list(near.rows())
        return pa.Table.from_batches(found) if found else _none(own, block, kept)

    return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(meet, schema)


def _none(own: pa.Table, block: pa.Table, kept: list[str]) -> pa.Table:
    return pa.schema([block.schema.field("query_id"), *(own.schema.field(c) for c in kept), pa.field("score", pa.float64())]).empty_table()
