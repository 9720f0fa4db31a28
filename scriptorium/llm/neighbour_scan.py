"""Rounds of nearest entries and means over integer vectors, by lists of each entry's neighbours.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts, each with a book of entries. A round
assigns every part to its book's nearest entry and then replaces each entry by the exact floor of its parts' mean. The
search starts at the entry of the round before and reads that entry's neighbours in order of distance, up to a squared
radius that the method gives (sort_means, exponion): entries beyond it can't be as near. All distances are exact integers,
ties go to the smaller index, so results don't depend on where the search starts.

Each round is one pass: rows are written to the shared folder with their entries, and after its last row each task
writes its sums for each entry, so that a round is read once more only for those (columns of rows aren't read). Sums and
counts of entries, bounded by the size of the books, are all that reaches the driver.

Vectors of each length have books of their own. A squared distance must fit a long with some room: components whose
integers reach 2**26 (64 in a part) end the job with an ArithmeticError, and nothing wraps around.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import drop_path, settle

#: (squared distance from the start, squared distance from the start to its nearest neighbour) to a squared radius.
Reach = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Entries (k x width) of each part, by length of vector.
Books = dict[int, list[np.ndarray]]
#: Stands for the distance to a neighbour where there is none; four times any distance is below it.
FAR = 1 << 62


def finite(v: Column) -> Column:
    """Whether an array holds neither nulls nor non-finite numbers; false for a null array."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(rows: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of lists of one length."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows.flatten()) else np.zeros((len(rows), 0))
    found = np.floor(flat.astype(np.float64) * scale)
    if found.size and np.abs(found).max() >= 1 << 31:
        raise ArithmeticError("a component is too large for exact squared distances")
    return found.astype(np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


def nearest(points: np.ndarray, entries: np.ndarray, start: np.ndarray, reach: Reach) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry, the smaller index of equally near ones."""
    most = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    if 16 * points.shape[1] * most * most >= FAR:
        raise ArithmeticError("a component is too large for exact squared distances")
    gaps = _squared(entries[:, None], entries[None])
    own = _squared(points, entries[start])
    entry, least = start.copy(), own.copy()
    index = np.arange(len(entries))
    for a in np.unique(start).tolist():
        others = np.lexsort((index, gaps[a]))
        others = others[others != a]
        far = gaps[a][others]
        rows = np.flatnonzero(start == a)
        limit = reach(own[rows], np.full(len(rows), far[0] if len(far) else FAR))
        reads = np.searchsorted(far, limit, side="right")
        for place, j in enumerate(others[: int(reads.max(initial=0))].tolist()):
            some = rows[reads > place]
            found = _squared(points[some], entries[j])
            better = (found < least[some]) | ((found == least[some]) & (j < entry[some]))
            least[some[better]], entry[some[better]] = found[better], j
    return entry, least


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end."""
    edges = [dim * i // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def books_of(starts: list[list[float]], parts: int, scale: int) -> Books:
    """Books that start as the parts of given vectors, in their order."""
    by: dict[int, list] = {}
    for v in starts:
        by.setdefault(len(v), []).append(v)
    out: Books = {}
    for dim, rows in by.items():
        whole = integers(pa.array(rows, pa.list_(pa.float64())), scale)
        out[dim] = [whole[:, low:high] for low, high in bounds(dim, parts)]
    return out


def _by_length(batch: pa.RecordBatch):
    sizes = np.diff(batch.column("v").offsets.to_numpy())
    for size in np.unique(sizes).tolist():
        yield size, batch.take(pa.array(np.flatnonzero(sizes == size)))


_ROW = "id long, label string, v array<int>, entry array<int>, error long, dim int, part int, at int, sums array<long>"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _sums(totals: dict) -> pa.RecordBatch:
    flat = [(dim, part, at, row.tolist()) for (dim, part), rows in totals.items() for at, row in enumerate(rows) if row[-1]]
    columns = [[x[i] for x in flat] for i in range(4)]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
    empty = [pa.nulls(len(flat), t) for t in (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())]
    return pa.RecordBatch.from_arrays([*empty, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=_NAMES)


def assign(rows: DataFrame, books: Books, parts: int, reach: Reach, scale: int) -> DataFrame:
    """Rows (id, label, v) with their nearest entries, from the entries of the round before if there are any, and each
    task's sums after its last row: for an entry its components' sums, then the count."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    later = "entry" in rows.columns

    def run(batches):
        known, totals = shared.value, {}
        for batch in batches:
            for dim, own in _by_length(batch):
                whole = integers(own.column("v"), 1 if later else scale)
                before = np.array(own.column("entry").flatten().to_numpy(zero_copy_only=False)).reshape(-1, parts) if later else np.zeros((len(whole), parts), np.int64)
                entry, error = np.empty((len(whole), parts), np.int64), np.zeros(len(whole), np.int64)
                for p, (low, high) in enumerate(bounds(dim, parts)):
                    points, entries = whole[:, low:high], known[dim][p]
                    entry[:, p], least = nearest(points, entries, before[:, p].astype(np.int64), reach)
                    error += least
                    total = totals.setdefault((dim, p), np.zeros((len(entries), high - low + 1), np.int64))
                    np.add.at(total, entry[:, p], np.hstack([points, np.ones((len(points), 1), np.int64)]))
                n = len(whole)
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("label"), _lists(whole, pa.int32()), _lists(entry, pa.int32()), pa.array(error), pa.array(np.full(n, dim, np.int32)), *none], names=_NAMES)
        yield _sums(totals)

    return rows.mapInArrow(run, _ROW)


def means(written: DataFrame, books: Books) -> Books:
    """Books with each used entry replaced by the floor of its parts' mean."""
    each = written.where("sums is not null").select("dim", "part", "at", F.posexplode("sums").alias("place", "x"))
    total = each.groupBy("dim", "part", "at", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    found: dict[tuple, dict[int, int]] = {}
    for r in total.collect():
        found.setdefault((r["dim"], r["part"], r["at"]), {})[r["place"]] = int(r["x"])
    out = {dim: [e.copy() for e in entries] for dim, entries in books.items()}
    for (dim, part, at), sums in found.items():
        count = sums[len(sums) - 1]
        out[dim][part][at] = [sums[i] // count for i in range(len(sums) - 1)]
    return out


def rounds(rows: DataFrame, books: Books, parts: int, times: int, reach: Reach, scale: int) -> tuple[DataFrame, Books]:
    """(id, label, dim, entry array<int>, error) of rows (id, label, v) after `times` rounds and one more assignment, and the books."""
    before = None
    for _ in range(times):
        written, path = settle(assign(rows, books, parts, reach, scale), "entries")
        books = means(written, books)
        rows = written.where("sums is null").select("id", "label", "v", "entry")
        if before:
            drop_path(rows.sparkSession, before)
        before = path
    last, _ = settle(assign(rows, books, parts, reach, scale).where("sums is null").select("id", "label", "dim", "entry", "error"), "entries")
    if before:
        drop_path(rows.sparkSession, before)
    return last, books


def digest(entries: list[np.ndarray]) -> str:
    """Hex SHA-256 of all components as decimal integers, by part, entry and place, joined by commas."""
    return sha256(",".join(str(x) for part in entries for row in part.tolist() for x in row).encode()).hexdigest()
