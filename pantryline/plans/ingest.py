"""Classification XML -> eight checked tables, counts and metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pantryline.functions.text import sorted_csv
from pantryline.functions.versions import UNKNOWN, version_from_path
from pantryline.operators.skew import join_parent
from pantryline.plans.taxonomy import Taxonomy
from pantryline.schemas import TAXONOMY_TABLES
from pantryline.sources.tables import folder_of, new_run, publish, read_checked, read_table, write_checked, write_tables
from pantryline.sources.taxonomy_xml import read_document_date, read_segments

# Fixed value: the Food/Beverage segment.
FOOD_SEGMENTS = ("50000000",)

# level table -> repeated element, from the outermost level inwards
_ELEMENTS = {
    "families": "family",
    "classes": "class",
    "bricks": "brick",
    "attribute_types": "attType",
    "attribute_values": "attValue",
}
LEVEL_TABLES = ("segments", *_ELEMENTS)

# Bits of an order that count the visits of a task; the file's number is above them.
_PLACE_BITS = 33

# junction table -> level whose visits it records, each with its parent
JUNCTION_TABLES = {
    "brick_attribute_types": "attribute_types",
    "attribute_type_values": "attribute_values",
}
#: The kind of the first junction table in `summed_visits`; levels come before.
JUNCTIONS = len(LEVEL_TABLES)


def keep_segments(docs: DataFrame, codes: tuple[str, ...] | None = FOOD_SEGMENTS) -> DataFrame:
    """Only the listed segments (all for None); placed before any unnesting."""
    if codes is None:
        return docs
    return docs.filter(F.col("_code").isin(list(codes)))


def visits(docs: DataFrame, tables: tuple[str, ...] = LEVEL_TABLES) -> DataFrame:
    """(table_name, parent_code, code, text, ord): every element of the asked-for levels, in one pass.

    Documents are unnested once, no deeper than asked for, down to single paths. A path
    also stands for the elements above it when it is the first path below each of them,
    so every element is reported exactly once and documents are not read per table.
    `ord` compares document order within a table: the place of the document, then the
    position at each level.
    """
    names = F.array(*[F.lit(name) for name in LEVEL_TABLES])
    seen = _visits_by_depth(docs, tables)
    return seen.select(F.get(names, F.col("depth")).alias("table_name"), "parent_code", "code", "text", "ord")


def _visits_by_depth(docs: DataFrame, tables: tuple[str, ...] = LEVEL_TABLES) -> DataFrame:
    """The same with `depth`, the place in LEVEL_TABLES; rows of a document follow each other in its order."""
    elements = list(_ELEMENTS.values())
    deepest = max(LEVEL_TABLES.index(name) for name in tables)
    # `depth` is how far down the path goes, `top` the highest element it is first below.
    rows = docs.select(
        "ord",
        F.array("_code").alias("codes"),
        F.array("_text").alias("texts"),
        F.array(F.lit(None).cast("int")).alias("places"),
        F.lit(0).alias("depth"),
        F.when(F.col("lead"), 0).otherwise(1).alias("top"),
        F.col("family").alias("below"),
    )
    for depth in range(1, deepest + 1):
        found = F.col("node").isNotNull()
        below = [F.col("node")[elements[depth]].alias("below")] if depth < deepest else []
        rows = rows.select("*", F.posexplode_outer("below").alias("at", "node")).select(
            "ord",
            F.concat("codes", F.array("node._code")).alias("codes"),
            F.concat("texts", F.array("node._text")).alias("texts"),
            F.concat("places", F.array("at")).alias("places"),
            F.when(found, depth).otherwise(F.col("depth")).alias("depth"),
            F.when(F.col("at") > 0, depth).otherwise(F.col("top")).alias("top"),
            *below,
        )
    seen = rows.filter(F.col("top") <= F.col("depth")).select(
        "ord", "codes", "texts", "places", F.explode(F.sequence("top", "depth")).alias("depth")
    )
    return seen.select(
        "depth",
        F.get(F.col("codes"), F.col("depth") - 1).alias("parent_code"),
        F.get(F.col("codes"), F.col("depth")).alias("code"),
        F.get(F.col("texts"), F.col("depth")).alias("text"),
        F.struct("ord", F.slice("places", 1, F.col("depth") + 1).alias("places")).alias("ord"),
    ).filter(F.col("depth").isin([LEVEL_TABLES.index(name) for name in tables]))


def summed_visits(docs: DataFrame) -> DataFrame:
    """(kind, parent_code, code, text, ord, visits): the visits of documents from files, summed where they are read.

    A kind below JUNCTIONS is the place of a level in LEVEL_TABLES, with a row for each text and, where the table
    has a parent, each parent of a code; JUNCTIONS and beyond are the JUNCTION_TABLES, with a row for each parent
    and child. `ord` is that of the first visit of a level, null for a junction, whose rows have no order. All that is
    aggregated has a fixed width, so visits are hashed, not sorted, and a task sends on what differs. `docs` come straight from `read_segments`: a file is read in one
    task from its start to its end, so the file's number and the row's place in the task are document order.
    """
    seen = _visits_by_depth(docs)
    place = F.monotonically_increasing_id().bitwiseAND((1 << _PLACE_BITS) - 1)
    seen = seen.withColumn("ord", F.shiftleft(F.col("ord.ord.file").cast("bigint"), _PLACE_BITS) + place)
    levels = list(JUNCTION_TABLES.values())
    kinds = F.expr(
        "CASE depth "
        + " ".join(
            f"WHEN {LEVEL_TABLES.index(level)} THEN array({LEVEL_TABLES.index(level)}, {JUNCTIONS + i})"
            for i, level in enumerate(levels)
        )
        + " ELSE array(depth) END"
    )
    with_parent = [LEVEL_TABLES.index(name) for name in LEVEL_TABLES if TAXONOMY_TABLES[name][2]]
    with_parent += range(JUNCTIONS, JUNCTIONS + len(levels))
    return (
        seen.withColumn("kind", F.explode(kinds))
        .withColumns(
            {
                "parent_code": F.when(F.col("kind").isin(with_parent), F.col("parent_code")),
                "text": F.when(F.col("kind") < JUNCTIONS, F.col("text")),
            }
        )
        .groupBy("kind", "parent_code", "code", "text")
        .agg(F.min(F.when(F.col("kind") < JUNCTIONS, F.col("ord"))).alias("ord"), F.count(F.lit(1)).alias("visits"))
    )


def first_visits(seen: DataFrame) -> DataFrame:
    """(table_name, code, parent_code, text, visits, unsound): the first sound visit of every code.

    A visit is sound when it has a code, and a parent where its level needs one; a later sound visit
    counts before an earlier one that isn't. `unsound` is the number of those that aren't. A code
    without a sound visit keeps its first one. One shuffle serves all levels; visits of a code are
    combined before it. Rows of `seen` may stand for several `visits`.
    """
    needs_parent = [name for name in LEVEL_TABLES if TAXONOMY_TABLES[name][2]]
    sound = F.col("code").isNotNull() & (
        ~F.col("table_name").isin(needs_parent) | F.col("parent_code").isNotNull()
    )
    row = F.struct("parent_code", "text")
    first = F.coalesce(F.min_by(row, F.when(sound, F.col("ord"))), F.min_by(row, "ord"))
    n = F.col("visits") if "visits" in seen.columns else F.lit(1).cast("bigint")
    return (
        seen.groupBy("table_name", "code")
        .agg(first.alias("first"), F.sum(n).alias("visits"), F.sum(F.when(sound, 0).otherwise(n)).alias("unsound"))
        .select("table_name", "code", "first.parent_code", "first.text", "visits", "unsound")
    )


def skipped_visits(first: DataFrame) -> DataFrame:
    """(table_name, code, visits) of codes in `first_visits` that are stored although some visits weren't sound."""
    return first.filter((F.col("unsound") > 0) & (F.col("unsound") < F.col("visits"))).select(
        "table_name", "code", F.col("unsound").alias("visits")
    )


def visited_pairs(seen: DataFrame) -> DataFrame:
    """(table_name, parent_code, code, visits): every distinct parent and child, per level."""
    return seen.groupBy("table_name", "parent_code", "code").agg(F.count(F.lit(1)).alias("visits"))


def level_table(first: DataFrame, name: str) -> DataFrame:
    """One of the six level tables from `first_visits`, with its own column names."""
    columns = TAXONOMY_TABLES[name][0]
    rows = first.filter(F.col("table_name") == name)
    return rows.select(*[F.col(c).alias(n) for n, c in zip(columns, ["code", "text", "parent_code"])])


def junction_table(pairs: DataFrame, name: str) -> DataFrame:
    """One of the two junction tables from `visited_pairs`."""
    parent, child = TAXONOMY_TABLES[name][0]
    rows = pairs.filter(F.col("table_name") == JUNCTION_TABLES[name])
    return rows.select(F.col("parent_code").alias(parent), F.col("code").alias(child))


def tables_of(seen: DataFrame) -> dict[str, DataFrame]:
    """The eight tables, first occurrence in document order winning; no checks yet."""
    levels = {
        name: level_table(first_visits(seen.filter(F.col("table_name") == name)), name)
        for name in LEVEL_TABLES
    }
    junctions = {
        name: junction_table(visited_pairs(seen.filter(F.col("table_name") == level)), name)
        for name, level in JUNCTION_TABLES.items()
    }
    return {name: {**levels, **junctions}[name] for name in TAXONOMY_TABLES}


def import_counts(seen: DataFrame) -> DataFrame:
    """(table_name, occurrences, unique_rows) per table, and their totals as `total`.

    Occurrences count every visit, duplicates included; unique rows are what is left
    after de-duplication. Counted in one pass, first by pair, then by code, then by table.
    """
    per_code = (
        visited_pairs(seen)
        .groupBy("table_name", "code")
        .agg(F.sum("visits").alias("visits"), F.count(F.lit(1)).alias("pairs"))
    )
    per_level = per_code.groupBy("table_name").agg(
        F.sum("visits").alias("occurrences"),
        F.count(F.lit(1)).alias("codes"),
        F.sum("pairs").alias("pairs"),
    )
    return _reported(per_level)


def _reported(per_level: DataFrame) -> DataFrame:
    """`import_counts` from (table_name, occurrences, codes, pairs), a row for each level that was visited."""
    # A level counts for itself by code, and for its junction table by pair. Levels
    # without any visit still report 0.
    names = [(name, name, False) for name in LEVEL_TABLES]
    names += [(name, level, True) for name, level in JUNCTION_TABLES.items()]
    reported = per_level.sparkSession.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("reported"), F.lit(lv).alias("table_name"), F.lit(j).alias("by_pair"))
                    for n, lv, j in names
                ]
            )
        )
    )
    unique = F.when(F.col("by_pair"), F.col("pairs")).otherwise(F.col("codes"))
    return (
        reported.join(per_level, "table_name", "left")
        .rollup("reported")
        .agg(
            F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"),
            F.coalesce(F.sum(unique), F.lit(0)).alias("unique_rows"),
        )
        .select(F.coalesce("reported", F.lit("total")).alias("table_name"), "occurrences", "unique_rows")
    )


@dataclass(frozen=True)
class Checked:
    """Tables whose keys and references hold, and the rows that broke them."""

    tables: dict[str, DataFrame]
    rejects: DataFrame


def with_reason(
    name: str, rows: DataFrame, good: dict[str, DataFrame], rejected: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Add `reason`: null for a sound row, `null` for a missing key or parent, else the broken reference.

    A reference is broken when `good` lacks it, or, if given, when `rejected` has it.
    """
    columns, keys, parents = TAXONOMY_TABLES[name]
    missing = F.lit(False)
    for column in dict.fromkeys([*keys, *parents]):
        missing = missing | F.col(column).isNull()
    reason = F.when(missing, "null")
    for column, (parent, parent_key) in parents.items():
        if rejected is not None and parent not in rejected:
            continue
        # Parents are unique by key, so a left join keeps the rows as they are.
        known = good if rejected is None else rejected
        found = known[parent].select(F.col(parent_key).alias(column), F.lit(True).alias(f"has_{column}"))
        rows = join_parent(rows, found, column)
        has = F.col(f"has_{column}")
        reason = reason.when(has.isNull() if rejected is None else has.isNotNull(), f"orphan {column}")
    return rows.select(*columns, reason.alias("reason"))


def _reject_rows(name: str, bad: DataFrame) -> DataFrame:
    """(table_name, reason, key) of rejected rows; a null part of the key shows as empty."""
    parts = [F.coalesce(F.col(k), F.lit("")) for k in TAXONOMY_TABLES[name][1]]
    return bad.select(F.lit(name).alias("table_name"), "reason", F.concat_ws("|", *parts).alias("key"))


def check_tables(
    tables: dict[str, DataFrame], store: Callable[[str, DataFrame], DataFrame] | None = None, closed: bool = False
) -> Checked:
    """Set aside rows with a null key or parent, or a reference to an absent row.

    Levels are checked top down, so the children of a rejected row are rejected too.
    `store` may write a table with its `reason` column and return it read back, so that
    nothing is computed twice. `rejects` has (table_name, reason, key). `closed` says that a row's parent
    always has a row itself, as is so for tables made of visits: the element above was visited too. Then
    only rejected rows can be missing, so rows meet these, and nothing where none is; to know that is
    a job for each table.
    """
    good: dict[str, DataFrame] = {}
    rejected: dict[str, DataFrame] | None = {} if closed else None
    bad: list[DataFrame] = []
    for name, (columns, _, _) in TAXONOMY_TABLES.items():
        checked = with_reason(name, tables[name], good, rejected)
        if store:
            checked = store(name, checked)
        sound = F.col("ok") if "ok" in checked.columns else F.col("reason").isNull()
        good[name] = checked.filter(sound).select(*columns)
        bad.append(_reject_rows(name, checked.filter(~sound)))
        if closed and not checked.filter(~sound).isEmpty():
            rejected[name] = checked.filter(~sound)
    return Checked(good, reduce(DataFrame.unionByName, bad))


def ingest_metadata(
    dates: DataFrame, source: str, segments: tuple[str, ...] | None, imported_at: Column | None = None
) -> DataFrame:
    """The five metadata rows of an import; `dates` has the `xml_date` of each file."""
    stamp = imported_at if imported_at is not None else F.current_timestamp()
    # Several files make one import: the first by name dates it.
    one = dates.agg(F.coalesce(F.min_by("xml_date", "xml_source"), F.lit(UNKNOWN)).alias("xml_date"))
    pairs = {
        "xml_date": F.col("xml_date"),
        "xml_source": F.lit(source),
        "food_segments": sorted_csv(F.array(*[F.lit(s) for s in segments])) if segments else F.lit("all"),
        "gpc_version": version_from_path(F.lit(source), F.col("xml_date")),
        "import_timestamp": F.date_format(
            F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"
        ),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return one.select(F.explode(entries).alias("e")).select("e.*")


def ingest_taxonomy(
    spark: SparkSession,
    xml: str,
    out: str,
    version: str,
    segments: tuple[str, ...] | None = FOOD_SEGMENTS,
    on_violation: str = "fail",
) -> DataFrame:
    """Full refresh: read XML, write the eight tables, counts and metadata, publish.

    The XML is parsed and unnested a single time, into visits summed in the task that reads them and stored
    by level; the first visits of all levels are taken from them at once, and
    tables and counts read these two. A broken reference
    stops the import, or with `on_violation='quarantine'` is set aside (`read_rejects`),
    as rows with a null key or parent are in either case. Every import writes into a folder
    of its own, published last, so a failed one changes nothing that can be read. Returns the
    counts.
    """
    if on_violation not in ("fail", "quarantine"):
        raise ValueError("on_violation is 'fail' or 'quarantine'")
    kept = keep_segments(read_segments(spark, xml), segments)
    summed = summed_visits(kept)
    folder = new_run(version)
    write_tables({"_visits": summed}, out, folder, partition_by="kind")
    stored = read_table(spark, out, "_visits", schema=summed.schema, folder=folder)
    names = F.array(*[F.lit(name) for name in [*LEVEL_TABLES, *JUNCTION_TABLES.values()]])
    seen = stored.withColumn("table_name", F.get(names, F.col("kind")))
    firsts = first_visits(seen.filter(F.col("kind") < JUNCTIONS))
    write_tables({"_first": firsts}, out, folder, partition_by="table_name")
    first = read_table(spark, out, "_first", schema=firsts.schema, folder=folder)
    pairs = seen.filter(F.col("kind") >= JUNCTIONS)
    found = {name: level_table(first, name) for name in LEVEL_TABLES}
    for i, name in enumerate(JUNCTION_TABLES):
        found[name] = junction_table(pairs.filter(F.col("kind") == JUNCTIONS + i), name)

    def store(name: str, rows: DataFrame) -> DataFrame:
        write_checked(name, rows, out, folder)
        return read_checked(spark, name, out, folder=folder)

    checked = check_tables(found, store, closed=True)
    if on_violation == "fail":
        broken = checked.rejects.filter(F.col("reason") != "null").limit(5).collect()
        if broken:
            raise ValueError(f"broken references, for example {[tuple(r) for r in broken]}")
    metadata = ingest_metadata(read_document_date(spark, xml), xml, segments)
    per_level = first.groupBy("table_name").agg(F.sum("visits").alias("occurrences"), F.count(F.lit(1)).alias("codes"))
    per_pair = pairs.groupBy("table_name").agg(F.count(F.lit(1)).alias("pairs"))
    results = {
        "gpc_metadata": metadata,
        "import_counts": _reported(per_level.join(per_pair, "table_name", "left")),
        "skipped_visits": skipped_visits(first),
    }
    write_tables(results, out, folder)
    publish(spark, out, version, folder)
    return read_table(spark, out, "import_counts", folder=folder)


def read_rejects(spark: SparkSession, out: str, version: str) -> DataFrame:
    """(table_name, reason, key) of the rows an import set aside.

    Visits that a sound one of the same code replaced are in the table `skipped_visits`.
    """
    folder = folder_of(spark, out, version)
    rows = []
    for name in TAXONOMY_TABLES:
        bad = read_checked(spark, name, out, folder=folder).filter(~F.col("ok"))
        rows.append(_reject_rows(name, bad))
    return reduce(DataFrame.unionByName, rows)


def as_taxonomy(tables: dict[str, DataFrame]) -> Taxonomy:
    return Taxonomy(**{name: tables[name] for name in TAXONOMY_TABLES})
