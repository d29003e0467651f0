"""Pages of an ordered table, with the totals and page numbers that go with them.

A page of any table is one pass: the top rows, and the total observed on the way. A table whose pages
are read often, or far down, is stored in ranges of its order with a directory of their sizes; there every
page, the first or the millionth, opens the one or two ranges it lies in.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pantryline.session import work_dir

DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
#: Rows that a task of a top-k may hold; a page that ends further down is read from ranges.
TOP_ROWS = 1_000_000
#: Rows of a stored range.
RANGE_ROWS = 100_000
#: Rows that a task sorts and writes, in as many ranges as they make.
TASK_ROWS = 50_000
# Rows of a partition are numbered in these bits of `monotonically_increasing_id`.
_WITHIN = (1 << 33) - 1


def next_page(page: Column, size: Column, total: Column) -> Column:
    """The next page number, null on the last page and past the end."""
    return F.when((page - 1) * size + size < total, page + 1)


def previous_page(page: Column) -> Column:
    """The previous page number, null on page 1; past the end it still counts back."""
    return F.when(page > 1, page - 1)


def check_page(page: int, page_size: int, max_size: int = MAX_PAGE_SIZE) -> None:
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= page_size <= max_size:
        raise ValueError(f"page_size must lie between 1 and {max_size}")


@dataclass(frozen=True)
class Page:
    """One page: `rows` in order, and `info`, a single row of totals and page numbers."""

    rows: DataFrame
    info: DataFrame

    def flat(self) -> DataFrame:
        """The page rows with the envelope as columns; of an empty page one row, with the envelope only."""
        info = self.info.select(F.struct("*")).scalar()
        rows = self.rows.withColumn("__info", info).select(
            *self.rows.columns, *[F.col("__info")[c].alias(c) for c in self.info.columns]
        )
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.rows.schema.fields]
        found = self.rows.agg(F.count(F.lit(1)).alias("n")).scalar()
        return rows.unionByName(self.info.filter(found == 0).select(*none, *self.info.columns))


def _ranged(df: DataFrame, order: list[str], ranges: int) -> DataFrame:
    """Rows dealt into ranges of the order, with `__range` and, from 0, their place `__at` within."""
    return (
        df.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))})
    )


def _directory(rows: DataFrame) -> DataFrame:
    """(range, start, n): the rows before each range, and its own. One row a range that has any."""
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col("__range").alias("range")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")


def number_rows(
    df: DataFrame, order: str | list[str], name: str = "position", ranges: int | None = None
) -> DataFrame:
    """Add the 1-based place of every row in the whole order, without a single-task window.

    Rows are split into ranges of `order`, as many as shuffle partitions unless told, and sorted and
    counted within; each range starts after the sizes of those before it. `order` must
    be unique: equal values are numbered in no particular order. Runs a job when called: the split is
    written to the shared folder, so that it stays the same however often it is read.
    """
    spark = df.sparkSession
    order = [order] if isinstance(order, str) else order
    path = work_dir(spark, "numbered")
    split = _ranged(df, order, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    split.write.parquet(path)
    split = spark.read.schema(split.schema).parquet(path)
    starts = F.broadcast(_directory(split).withColumnRenamed("range", "__range"))  # one row a range
    return split.join(starts, "__range").select(*df.columns, (F.col("start") + F.col("__at") + 1).alias(name))


def _envelope(count: int, page: int, page_size: int) -> tuple[int, int | None, int | None]:
    """(count, next, previous) as `next_page` and `previous_page` give them."""
    return count, page + 1 if page * page_size < count else None, page - 1 if page > 1 else None


def _page(df: DataFrame, rows: list, count: int, page: int, page_size: int) -> Page:
    """A page's few rows and its envelope."""
    spark = df.sparkSession
    info = spark.createDataFrame([_envelope(count, page, page_size)], "count long, next long, previous long")
    return Page(spark.createDataFrame(rows, df.schema), info)


def top_rows(df: DataFrame, order: str, offset: int, n: int, seen: Observation) -> DataFrame:
    """The n rows after `offset` in the order; `seen` observes how many rows there are, as `n`."""
    return df.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(order).offset(offset).limit(n)


def _top(df: DataFrame, order: str, offset: int, n: int) -> tuple[list, int]:
    """Those rows and their number, in one pass."""
    seen = Observation()
    rows = top_rows(df, order, offset, n, seen).collect()
    return rows, seen.get.get("n", 0)


def page_of(df: DataFrame, order: str, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> Page:
    """Page by offset. Runs a single pass when called, a top-k whose total is observed on the way.

    A task of a top-k holds all rows up to the page's end, so pages far down are read from ranges,
    as `numbered_page` does. `page_after` is cheaper when the last code of the previous page is known,
    `read_page` when the table is stored for paging.
    """
    check_page(page, page_size)
    if page * page_size > TOP_ROWS:
        return numbered_page(df, order, page, page_size)
    return _page(df, *_top(df, order, (page - 1) * page_size, page_size), page, page_size)


def store_pages(df: DataFrame, order: str, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Write a table below `path` for `read_page`: a folder a range of its order, and their directory.

    Reads `df` twice, to count and to sort it. Rows equal in `order` keep the places they get here. A task
    writes many ranges when these are short, and a range's bloom filter has the size for
    its rows; without their number it would be a megabyte.
    """
    tasks = max(1, -(-df.count() // max(range_rows, TASK_ROWS)))
    at = F.col("__at") % range_rows
    (
        _ranged(df, [order], tasks)
        # A range is named by the id of its first row.
        .withColumns({"__range": F.monotonically_increasing_id() - at, "__at": at})
        .write.partitionBy("__range")
        .option(f"parquet.bloom.filter.enabled#{order}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{order}", str(range_rows))
        .parquet(f"{path}/rows")
    )
    spark = df.sparkSession
    schema = StructType([*df.schema.fields, StructField("__at", LongType()), StructField("__range", LongType())])
    _directory(spark.read.schema(schema).parquet(f"{path}/rows")).coalesce(1).write.parquet(f"{path}/directory")
    spark.createDataFrame([(schema.json(), order)], _STORED).coalesce(1).write.json(f"{path}/layout")


_STORED = "schema string, sorted_by string"


def read_page(spark: SparkSession, path: str, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> Page:
    """A page of a stored table: its ranges are found in the directory, and only these are opened.

    Total and page numbers come from the directory.
    """
    check_page(page, page_size)
    offset = (page - 1) * page_size
    layout = spark.read.schema(_STORED).json(f"{path}/layout").first()
    directory = spark.read.parquet(f"{path}/directory")
    overlap = (F.col("start") < offset + page_size) & (F.col("start") + F.col("n") > offset)
    # A page is shorter than a range, or else as many ranges as it has rows overlap it.
    found = directory.agg(
        F.sum("n").alias("count"), F.collect_list(F.when(overlap, F.struct("range", "start"))).alias("ranges")
    ).first()
    # Only these folders are listed, of however many there are.
    folders = [f"{path}/rows/__range={r['range']}" for r in found["ranges"]]
    reader = spark.read.schema(StructType.fromJson(json.loads(layout["schema"]))).option("basePath", f"{path}/rows")
    named = reader.parquet(*folders or [f"{path}/rows"])
    start = reduce(lambda c, r: c.when(F.col("__range") == r["range"], r["start"]), found["ranges"], F.when(F.lit(False), 0))
    rows = named.withColumn("__place", start + F.col("__at")).filter((F.col("__place") >= offset) & (F.col("__place") < offset + page_size))
    page_rows = rows.orderBy("__place").drop("__place", "__at", "__range")
    return _page(page_rows, page_rows.collect(), found["count"] or 0, page, page_size)


def numbered_page(
    df: DataFrame, order: str, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE, range_rows: int = RANGE_ROWS
) -> Page:
    """The same page by way of `store_pages`, into the shared folder: no task holds more rows for a later page."""
    check_page(page, page_size)
    path = work_dir(df.sparkSession, "pages")
    store_pages(df, order, path, range_rows)
    return read_page(df.sparkSession, path, page, page_size)


def page_after(df: DataFrame, order: str, last: str | None, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The page following the row whose order value is `last`; the filter reaches the scan."""
    check_page(1, page_size)
    rest = df if last is None else df.filter(F.col(order) > F.lit(last))
    return rest.orderBy(order).limit(page_size)


def capped_hits(df: DataFrame, order: str, n: int, max_size: int, total: str) -> Page:
    """The first `n` hits by `order`, and the number of all hits in `info.<total>`, in one pass when called."""
    check_page(1, n, max_size)
    rows, count = _top(df, order, 0, n)
    spark = df.sparkSession
    return Page(spark.createDataFrame(rows, df.schema), spark.createDataFrame([(count,)], f"{total} long"))
