"""Landed pages of sources as a table and as a stream.

A page is a file of JSON, {"results": [...]} or a line for each such answer. A landing folder holds a folder for each query, with
its pages named in the order of their cursors; names that begin with `_` or `.` aren't read. As a stream, the source's
offset is the last page taken of each query, so a batch is a range of pages that is read again alike after a failure.

A schema may name `_query`, `_page`, `_place` (of the row in its page, from 0) and `_error`, which the source fills. With `_error` a page
that can't be read gives one row that tells why; without it the page ends the job. Nothing is left out unsaid.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from scriptorium.session import settle
from scriptorium.sources.ledger import file_system
from scriptorium.streaming.flows import run_batches

_FITS = {"EqualTo": lambda a, b: a == b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThanOrEqual": lambda a, b: a <= b}
#: Name, row and error of a query's pages, as the source gives them.
ERRORS = "_query string, _page string, _error string"


class Page(InputPartition):
    def __init__(self, query: str, path: str):
        super().__init__(path)
        self.query, self.path = query, path


def landed(folder: str) -> dict[str, list[str]]:
    """Paths of the pages of each query in a landing folder, in order; pages that lie in the folder itself are of the query ``."""
    from pyarrow import fs

    system, root = file_system(folder)
    found: dict[str, list[str]] = {}
    for entry in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        below = entry.path[len(root) :].strip("/").split("/")
        if entry.type == fs.FileType.File and len(below) <= 2 and not any(b.startswith(("_", ".")) for b in below):
            found.setdefault(below[0] if len(below) == 2 else "", []).append(below[-1])
    inside = lambda q, name: "/".join(filter(None, (folder.rstrip("/"), q, name)))
    return {q: [inside(q, n) for n in sorted(names)] for q, names in sorted(found.items())}


def answers(path: str) -> Iterator[dict]:
    """The JSON documents of a landed file."""
    system, inner = file_system(path)
    with system.open_input_stream(inner) as file:
        text = file.read().decode()
    try:
        found = [json.loads(text)]
    except json.JSONDecodeError:
        found = [json.loads(line) for line in text.splitlines() if line.strip()]
    for answer in found:
        if not isinstance(answer, dict):
            raise ValueError("a page is no JSON object")
        yield answer


def rows_of(page: Page, names: list[str], tests: list[tuple[str, str, object]]) -> Iterator[tuple]:
    """Rows of a page that pass the tests."""
    own = {"_query": page.query, "_page": page.path.rpartition("/")[2], "_place": None, "_error": None}
    taken: list[dict] = []
    try:
        for answer in answers(page.path):
            taken += answer.get("results") or []
        if not all(isinstance(r, dict) for r in taken):
            raise ValueError("a result is no JSON object")
    except (ValueError, OSError, TypeError, AttributeError) as e:
        if "_error" not in names:
            raise
        taken, own = [{}], own | {"_error": f"{type(e).__name__}: {e}"[:500]}
    for place, row in enumerate(taken):
        full = row | own | {"_place": None if own["_error"] else place}
        if all(full.get(n) is not None and _FITS[op](full[n], v) for op, n, v in tests):
            yield tuple(full.get(n) for n in names)


class PagedReader(DataSourceReader):
    """A partition for each page; equalities and bounds on a field are tested while a page is read."""

    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.options, self.tests = [f.name for f in schema.fields], options, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)) and len(f.attribute) == 1:
                self.tests.append((type(f).__name__, f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        if "folder" in self.options:
            return [Page(q, p) for q, paths in landed(self.options["folder"]).items() for p in paths]
        return [Page("", p) for p in self.options["pages"].split(",") if p]

    def read(self, partition: Page):
        return rows_of(partition, self.names, self.tests)


class PagedStreamReader(DataSourceStreamReader):
    """Offsets are the last page taken of each query: a page that lands later must be named beyond it."""

    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.folder = [f.name for f in schema.fields], options["folder"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {q: paths[-1].rpartition("/")[2] for q, paths in landed(self.folder).items()}

    def partitions(self, start: dict, end: dict):
        name = lambda p: p.rpartition("/")[2]
        return [Page(q, p) for q, paths in landed(self.folder).items() for p in paths if q in end and start.get(q, "") < name(p) <= end[q]]

    def read(self, partition: Page):
        return rows_of(partition, self.names, [])

    def commit(self, end: dict) -> None:
        """Pages stay where they landed."""


class PagedSource(DataSource):
    """spark.read or spark.readStream.format("paged"), with options schema and either folder (a landing folder) or pages (paths, tables only).

    Use register() first; filters of a table are tested while its pages are read.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PagedStreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def first_kept(df: DataFrame, limit: int, query: str = "_query", page: str = "_page", place: str = "_place") -> DataFrame:
    """The first `limit` rows of each query in the order of its pages, of rows that have passed every filter.

    Pages are counted, a running sum over a query's pages tells what each may still give, and pages beyond the limit leave
    by the join; only the page that the limit falls in is ranked inside. No task gets more than a page's rows together. The rows
    are written down first, so that pages are read once.
    """
    df, _ = settle(df, "kept-rows")
    counts = df.groupBy(query, page).agg(F.count("*").alias("kept"))
    before = F.coalesce(F.sum("kept").over(Window.partitionBy(query).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    allowed = counts.withColumn("before", before).where(F.col("before") < limit).select(query, page, (F.lit(limit) - F.col("before")).alias("allowed"), "kept")
    met = df.join(allowed, [query, page])
    whole = met.where("kept <= allowed").select(*df.columns)
    cut = met.where("kept > allowed").withColumn("rank", F.row_number().over(Window.partitionBy(query, page).orderBy(place)))
    return whole.unionByName(cut.where("rank <= allowed").select(*df.columns))


def split_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream of pages over what has landed: rows to `path`/rows, pages that couldn't be read to `path`/errors, each
    micro-batch in a folder of its own, which the same batch replaces when it runs again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("_error is null").drop("_error").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        batch.where("_error is not null").select("_query", "_page", "_error").write.mode("overwrite").parquet(f"{path}/errors/batch={number}")

    run_batches(stream, write, checkpoint)
