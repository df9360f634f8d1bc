"""A streaming source of task logs whose offset is the id of the last log that was read.

The driver plans pages: it looks at the statistics of Parquet row groups and at ids alone, the next few pages'
worth of them. Executors read the pages, a few neighbours in a partition, as a row group is decoded as a whole for
each partition that needs it; rows don't pass through the driver. A new query
starts after the cursor that it is given, whatever the table holds by then; one with a checkpoint goes on after
the last id that it planned, and reads a batch that wasn't committed again by the same ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.tasks import PAGE_LOGS, TASK_LOGS

#: Pages of a batch, and the partitions that they are dealt to.
PAGES_PER_BATCH = 64
BATCH_PARTITIONS = 4


def cursor(after_id: int | str | None = None, last_event_id: str | None = None) -> int:
    """Where a reader starts: after the id that a client saw last, if it names one, else after after_id. Negative ones are 0, as is none; text that is no integer is a ValueError."""
    given = after_id if last_event_id is None else last_event_id
    return max(0, int(given)) if given is not None else 0


class LogPages(DataSource):
    """Format "task_logs": a folder of Parquet files (id bigint, task_id string, level string, message string, created_at timestamp), to which files are added.

    Options: path (a URI that pyarrow reads), task_id (none: all tasks), startingOffset (an id, read after
    it), pageRows (500), pagesPerBatch (64). Rows come in ascending order of id within a page; pages follow
    each other. Files whose ids are below what was read already are not seen, as by a reader that asks for ids
    after its last one. Null ids: never read. Extra columns are ignored.
    """

    @classmethod
    def name(cls) -> str:
        return "task_logs"

    def schema(self) -> str:
        return TASK_LOGS

    def streamReader(self, schema: StructType) -> LogPageReader:  # noqa: N802  the name that Spark calls
        return LogPageReader(self.options)


class Page(InputPartition):
    """Logs with low < id <= high, one page or several that follow each other."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class LogPageReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.task_id = options["path"], options.get("task_id")
        self.start = cursor(options.get("startingOffset"))
        self.rows, self.pages = int(options.get("pageRows", PAGE_LOGS)), int(options.get("pagesPerBatch", PAGES_PER_BATCH))
        if self.rows < 1 or self.pages < 1:
            raise ValueError("pageRows and pagesPerBatch must be positive")
        self.planned: int | None = None
        self.tops: dict[str, int] = {}  # the greatest id of each file that was looked at; files don't change
        self.parts: dict[str, list[tuple]] = {}  # row groups with their ranges of ids, of files that aren't read to their end
        self.last: tuple[int, np.ndarray] | None = None  # the ids that were planned last, and after which

    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last id of the next batch, which has pages * rows rows at most (more only if an id repeats)."""
        if self.planned is None:
            self.planned = self.start
        ids = self._next_ids(self.planned, self.rows * self.pages)
        if len(ids):
            self.last = self.planned, ids
            self.planned = int(ids[-1])
        return {"id": self.planned}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        """The pages of a batch. After a restart the last batch is asked for first, and says where to go on."""
        if self.planned is None:
            self.planned = end["id"]
        low, pages = start["id"], []
        while low < end["id"]:
            if self.last is not None and self.last[0] == low and self.last[1][-1] == end["id"]:
                ids = self.last[1]
            else:
                ids = self._next_ids(low, self.rows * self.pages, end["id"])
            if not len(ids):
                break
            ends = list(dict.fromkeys([*ids[self.rows - 1 :: self.rows].tolist(), int(ids[-1])]))
            for some in batched(ends, -(-len(ends) // BATCH_PARTITIONS), strict=False):
                pages.append(Page(low, some[-1]))
                low = some[-1]
        return pages

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        found = self._dataset().to_table(columns=_COLUMNS.names, filter=self._where(partition.low, partition.high)).sort_by("id")
        yield from found.cast(_COLUMNS).to_batches()

    def _dataset(self) -> ds.Dataset:
        return ds.dataset(self.path, _COLUMNS, format=ds.ParquetFileFormat(read_options=ds.ParquetReadOptions(coerce_int96_timestamp_unit="us")))

    _groups_of = staticmethod(ds.ParquetFileFragment.split_by_row_group)

    def _where(self, low: int, high: int | None = None) -> pc.Expression:
        where = ds.field("id") > low
        if high is not None:
            where &= ds.field("id") <= high
        return where if self.task_id is None else where & (ds.field("task_id") == self.task_id)

    def _next_ids(self, low: int, many: int, high: int | None = None) -> np.ndarray:
        """The `many` smallest ids after low, up to high. Row groups are read in the order of their least id, until none can hold a smaller one."""
        where, groups = self._where(low, high), []
        for fragment in self._dataset().get_fragments():
            path = fragment.path
            if self.tops.get(path, low + 1) <= low:
                self.parts.pop(path, None)
                continue
            if path not in self.parts:
                self.parts[path] = [(_ids_of(p), p) for p in self._groups_of(fragment)]
                if all(found for found, _ in self.parts[path]):
                    self.tops[path] = max((found[1] for found, _ in self.parts[path]), default=low)
            for found, part in self.parts[path]:
                least, most = found or (low, low + 1)
                if most > low:
                    groups.append((least, len(groups), part))
        heapq.heapify(groups)
        ids = np.zeros(0, np.int64)
        while groups and not (len(ids) == many and groups[0][0] > ids[-1]):
            *_, part = heapq.heappop(groups)
            ids = np.sort(np.concatenate([ids, part.to_table(schema=_COLUMNS, columns=["id"], filter=where)["id"].to_numpy()]))[:many]
        return ids


def _ids_of(part: ds.ParquetFileFragment) -> tuple[int, int] | None:
    """The least and greatest id of a fragment of one row group, if it has statistics."""
    group = part.metadata.row_group(part.row_groups[0].id)
    for k in range(group.num_columns):
        column = group.column(k)
        if column.path_in_schema == "id" and column.statistics is not None and column.statistics.has_min_max:
            return column.statistics.min, column.statistics.max
    return None


_COLUMNS = pa.schema([("id", pa.int64()), ("task_id", pa.string()), ("level", pa.string()), ("message", pa.string()), ("created_at", pa.timestamp("us", "UTC"))])
