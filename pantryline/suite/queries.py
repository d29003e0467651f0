"""The registered queries: every operator over whole test tables, with scalar output columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pantryline.functions.nutrients import FDC_NUTRIENTS, off_nutrient_map, off_nutrient_struct
from pantryline.functions.text import fallback_label, sorted_csv, tag_label, title_case
from pantryline.functions.versions import file_stem, strip_v, version_from_path, version_status
from pantryline.operators.dedup import first_wins
from pantryline.operators.integrity import null_keys, orphans
from pantryline.operators.paging import next_page, number_rows, numbered_page, previous_page, read_page, store_pages
from pantryline.operators.trigrams import read_candidates
from pantryline.plans import ingest, products, refresh, search, taxonomy as tx
from pantryline.plans.categories import map_categories
from pantryline.plans.reconcile import reconcile, reconcile_stored, store_sources
from pantryline.session import work_dir
from pantryline.sources import metadata
from pantryline.sources.products import read_fdc, read_off
from pantryline.sources.tables import read_table
from pantryline.sources.taxonomy_xml import write_segments
from pantryline.streaming.enrich import read_enriched, store_canonical, write_stream
from pantryline.suite import standins as s

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def pairs_text(items: Column, code: str, description: str) -> Column:
    """An ordered list of (code, text) entries as one text."""
    return F.array_join(
        F.transform(items, lambda x: F.concat(x[code], F.lit("="), F.coalesce(x[description], F.lit("")))),
        ",",
    )


# ---- browsing -------------------------------------------------------------------


@query
def brick_path(spark: SparkSession, sf: str) -> DataFrame:
    return tx.brick_path(s.taxonomy(spark, sf)).withColumn(
        "path_parts", F.array_join("path_parts", "|")
    )


@query
def list_segments(spark: SparkSession, sf: str) -> DataFrame:
    return tx.list_level(s.taxonomy(spark, sf), "segment", "SUPPLIER#0", page=2, page_size=15).flat()


@query
def list_families(spark: SparkSession, sf: str) -> DataFrame:
    return tx.list_level(s.taxonomy(spark, sf), "family", "r%g", parent="3").flat()


@query
def list_classes(spark: SparkSession, sf: str) -> DataFrame:
    return tx.list_level(s.taxonomy(spark, sf), "class", page=3, page_size=100).flat()


@query
def list_bricks(spark: SparkSession, sf: str) -> DataFrame:
    return tx.list_level(s.taxonomy(spark, sf), "brick", "urgent", page=2, page_size=50).flat()


@query
def list_bricks_of_class(spark: SparkSession, sf: str) -> DataFrame:
    return tx.list_level(s.taxonomy(spark, sf), "brick", parent="17").flat()


@query
def list_bricks_after(spark: SparkSession, sf: str) -> DataFrame:
    return tx.list_level_after(s.taxonomy(spark, sf), "brick", last="5", search="_-NOT%spec", page_size=100)


@query
def list_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The page of 20 on which each brick of the whole list appears."""
    t = s.taxonomy(spark, sf)
    numbered = number_rows(tx.matching(t, "brick"), "brick_code")
    return numbered.withColumn("page", F.ceil(F.col("position") / 20))


@query
def list_count(spark: SparkSession, sf: str) -> DataFrame:
    t = s.taxonomy(spark, sf)
    counts = [
        tx.matching(t, name, "1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), "n")
        for name in tx.LEVELS
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def page_info(spark: SparkSession, sf: str) -> DataFrame:
    """Page numbers around four pages of every class's brick list."""
    total = F.col("total")
    size = F.lit(5).cast("bigint")
    last = F.greatest(F.ceil(total / size), F.lit(1))
    pages = F.array_distinct(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"), last, last + 1))
    return (
        s.taxonomy(spark, sf)
        .bricks.groupBy("class_code")
        .agg(F.count(F.lit(1)).alias("total"))
        .select("class_code", "total", F.explode(pages).alias("page"))
        .select(
            "*",
            ((F.col("page") - 1) * size).alias("offset"),
            next_page(F.col("page"), size, total).alias("next"),
            previous_page(F.col("page")).alias("previous"),
        )
    )


@query
def list_past_the_end(spark: SparkSession, sf: str) -> DataFrame:
    """Only the envelope: no row is there."""
    return tx.list_level(s.taxonomy(spark, sf), "segment", page=90_000, page_size=100).flat()


@query
def list_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """A page from rows numbered in parallel."""
    bricks = tx.matching(s.taxonomy(spark, sf), "brick", "1")
    return numbered_page(bricks, "brick_code", page=4, page_size=100).flat()


@query
def list_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A page of all bricks, stored for paging."""
    path = work_dir(spark, "bricks")
    store_pages(tx.matching(s.taxonomy(spark, sf), "brick"), "brick_code", path, range_rows=500)
    return read_page(spark, path, page=13, page_size=90).flat()


@query
def segment_detail(spark: SparkSession, sf: str) -> DataFrame:
    return tx.child_rows(s.taxonomy(spark, sf), "segment")


@query
def family_detail(spark: SparkSession, sf: str) -> DataFrame:
    rows = tx.child_rows(s.taxonomy(spark, sf), "family")
    details = F.col("segment_code_details.segment_description").alias("segment_description")
    return rows.select(*[c for c in rows.columns if c != "segment_code_details"], details)


@query
def class_detail(spark: SparkSession, sf: str) -> DataFrame:
    rows = tx.child_rows(s.taxonomy(spark, sf), "class")
    return rows.select(
        *[c for c in rows.columns if c not in ("family_code_details", "family_code")],
        F.col("family_code_details.family_code").alias("family_code"),
        F.col("family_code_details.description").alias("family_description"),
        F.col("family_code_details.segment_code").alias("segment_code"),
        F.col("family_code_details.segment_description").alias("segment_description"),
    )


_CLASS_REF = ["class_code", "description", "family_code", "family_description", "segment_code", "segment_description"]


def _class_ref() -> list[Column]:
    return [
        F.col(f"class_code_details.{c}").alias("class_description" if c == "description" else c) for c in _CLASS_REF
    ]


@query
def brick_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """All bricks with their attribute types; `type_values` has the values, once per type."""
    return tx.brick_attributes(s.taxonomy(spark, sf)).select(
        "brick_code", "description", *_class_ref(), "full_path", "position", "n_types", "att_type_code", "att_type_text",
        "n_values",
    )


@query
def type_values(spark: SparkSession, sf: str) -> DataFrame:
    return tx.type_values(s.taxonomy(spark, sf))


@query
def brick_detail(spark: SparkSession, sf: str) -> DataFrame:
    """The bricks of the families' first classes, nested: types, each with its values."""
    t = s.taxonomy(spark, sf)
    classes = t.classes.groupBy("family_code").agg(F.min("class_code").alias("class_code"))
    bricks = t.bricks.join(classes, "class_code", "left_semi").select("brick_code")
    entry = lambda x: F.concat(
        x["att_type_code"], F.lit("="), x["att_type_text"], F.lit("("),
        pairs_text(x["values"], "att_value_code", "att_value_text"), F.lit(")"),
    )
    return tx.brick_detail(t, bricks).select(
        "brick_code",
        "description",
        *_class_ref(),
        "full_path",
        F.size("attributes").alias("n_types"),
        F.array_join(F.transform("attributes", entry), ";").alias("attributes"),
    )


@query
def lookup_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments by a table of codes, some of which aren't there, with their families nested."""
    codes = s.table(spark, sf, "orders").select(s.text("o_custkey"))
    return tx.segment_detail(s.taxonomy(spark, sf), codes).select(
        "segment_code", "description", pairs_text(F.col("families"), "family_code", "description").alias("families")
    )


@query
def lookup_families(spark: SparkSession, sf: str) -> DataFrame:
    codes = s.table(spark, sf, "lineitem").select(s.text("l_suppkey"))
    return tx.family_detail(s.taxonomy(spark, sf), codes).select(
        "family_code", "full_path", pairs_text(F.col("classes"), "class_code", "description").alias("classes")
    )


@query
def lookup_classes(spark: SparkSession, sf: str) -> DataFrame:
    codes = s.table(spark, sf, "part").select(s.text("p_partkey"))
    return tx.class_detail(s.taxonomy(spark, sf), codes).select(
        "class_code", "full_path", pairs_text(F.col("bricks"), "brick_code", "description").alias("bricks")
    )


@query
def lookup_bricks(spark: SparkSession, sf: str) -> DataFrame:
    codes = s.table(spark, sf, "customer").select(s.text("c_custkey"))
    return tx.brick_path(s.taxonomy(spark, sf), codes).select("brick_code", "class_code", "full_path")


@query
def missing_codes(spark: SparkSession, sf: str) -> DataFrame:
    t = s.taxonomy(spark, sf)
    return tx.missing_codes(t, "class", t.brick_attribute_types.select("att_type_code"))


@query
def search_all(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_taxonomy(s.taxonomy(spark, sf), "17")


@query
def search_category(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_taxonomy(s.taxonomy(spark, sf), "Low", "bricks")


@query
def search_all_indexed(spark: SparkSession, sf: str) -> DataFrame:
    t, path = s.taxonomy(spark, sf), work_dir(spark, "search")
    search.index_taxonomy(t, path)
    return search.search_taxonomy(search.narrowed_taxonomy(t, spark, path, "17"), "17")


# ---- ingest ---------------------------------------------------------------------


@query
def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """First line of every part, in document order."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return first_wins(
        s.table(spark, sf, "lineitem"), ["l_partkey"], order, ["l_orderkey", "l_suppkey", "l_returnflag"]
    )


@query
def ingest_segment_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = ingest.keep_segments(s.documents(spark, sf), ("1", "3", "7"))
    return ingest.visits(docs).groupBy("table_name", "parent_code").agg(F.count(F.lit(1)).alias("visits"))


@query
def ingest_flatten_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    levels = ("segments", "families", "classes", "bricks")
    return ingest.first_visits(ingest.visits(s.documents(spark, sf, attributes=False), levels)).drop("unsound")


@query
def ingest_first_sound(spark: SparkSession, sf: str) -> DataFrame:
    """Families whose first visits, in the segments' own documents, have lost their parent."""
    seen = ingest.visits(s.documents(spark, sf, attributes=False), ("families",))
    lost = F.when(F.col("ord.ord.kind") > 0, F.col("parent_code"))
    return ingest.first_visits(seen.withColumn("parent_code", lost)).drop("table_name")


@query
def ingest_flatten_attributes(spark: SparkSession, sf: str) -> DataFrame:
    seen = ingest.visits(s.documents(spark, sf), ("attribute_types", "attribute_values"))
    return ingest.first_visits(seen).select("table_name", "code", "text", "visits")


@query
def ingest_junctions(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.visited_pairs(ingest.visits(s.documents(spark, sf), ("attribute_types", "attribute_values")))


@query
def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.import_counts(ingest.visits(s.documents(spark, sf)))


def _tables_union(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """Tables of different columns as (table_name, c1, c2, c3)."""
    shaped = []
    for name in names:
        columns = [F.col(c) for c in tables[name].columns] + [F.lit(None).cast("string")] * 2
        shaped.append(
            tables[name].select(
                F.lit(name).alias("table_name"), *[c.alias(f"c{i}") for i, c in enumerate(columns[:3], 1)]
            )
        )
    return reduce(DataFrame.unionByName, shaped)


@query
def ingest_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Written as XML, ingested from it into published tables, read back, with metadata and counts."""
    base = work_dir(spark, "roundtrip")
    xml = f"{base}/en-v20251127.xml"
    write_segments(s.documents(spark, sf, varied=False), xml, "11/27/2025", compression="gzip")
    counts = ingest.ingest_taxonomy(spark, xml, f"{base}/out", "20251127", segments=None)
    t = tx.Taxonomy.read(spark, f"{base}/out")
    # The source without its folder, and no time stamp: both differ from run to run.
    value = F.when(F.col("key") == "xml_source", F.substring_index("value", "/", -1)).otherwise(F.col("value"))
    stored = read_table(spark, f"{base}/out", "gpc_metadata").filter("key <> 'import_timestamp'")
    stored = stored.select("key", value.alias("value"))
    counted = counts.select("table_name", *[F.col(c).cast("string") for c in ("occurrences", "unique_rows")])
    extra = {"gpc_metadata": stored, "import_counts": counted}
    return _tables_union({**t.tables(), **extra}, [*t.tables(), *extra])


@query
def integrity_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a label, lines whose part key is no customer, products without a name."""
    documents = s.table(spark, sf, "documents").select(s.text("doc_id").alias("key"))
    labels = s.table(spark, sf, "labels").select(s.text("doc_id").alias("key"))
    lines = s.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
        F.col("l_partkey").alias("ref"),
    )
    customers = s.table(spark, sf, "customer")
    nulls = null_keys(s.off_raw(spark, sf), ["code", "product_name"]).select(F.col("code").alias("key"))
    return reduce(
        DataFrame.unionByName,
        [
            orphans(documents, labels, "key", "key").select(F.lit("label").alias("reason"), "key"),
            orphans(lines, customers, "ref", "c_custkey").select(F.lit("customer").alias("reason"), "key"),
            nulls.select(F.lit("null").alias("reason"), "key"),
        ],
    )


# ---- versions and metadata ------------------------------------------------------

PATHS = """
CASE o_orderkey % 6
  WHEN 0 THEN concat('/data/imports/en-v', date_format(o_orderdate, 'yyyyMMdd'), '.xml')
  WHEN 1 THEN concat('gpc-', date_format(o_orderdate, 'yyyyMMdd'), '.xml')
  WHEN 2 THEN concat('data/gpc_', o_orderkey, '.xml')
  WHEN 3 THEN concat('data/gpc-vegan-', o_orderkey, '.tar.xml')
  WHEN 4 THEN concat('food-x', o_orderkey, '.xml')
  ELSE concat('/a-b/v', o_orderkey) END
"""
DATES = """
CASE o_orderpriority
  WHEN '1-URGENT' THEN 'unknown'
  WHEN '2-HIGH' THEN concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate))
  WHEN '3-MEDIUM' THEN concat(' ', date_format(o_orderdate, 'MM/dd/yyyy'), ' ')
  WHEN '4-NOT SPECIFIED' THEN concat(day(o_orderdate), '/13/', year(o_orderdate))
  ELSE NULL END
"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return s.table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderdate",
        F.expr(PATHS).alias("xml_source"),
        F.expr(DATES).alias("xml_date"),
    )


@query
def version_from_path_query(spark: SparkSession, sf: str) -> DataFrame:
    return _versions(spark, sf).select(
        "o_orderkey",
        file_stem(F.col("xml_source")).alias("stem"),
        version_from_path(F.col("xml_source"), F.col("xml_date")).alias("version"),
    )


def _datasets(spark: SparkSession, sf: str) -> DataFrame:
    """One dataset per order: stored version, candidate, text of the last check."""
    return s.table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr(
            "CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'unknown' WHEN '5-LOW' THEN ''"
            " ELSE concat('v', date_format(o_orderdate, 'yyyyMMdd')) END"
        ).alias("stored"),
        F.expr(
            "CASE o_orderstatus WHEN 'F' THEN concat('vv', 19990000 + o_custkey)"
            " WHEN 'O' THEN '19980101' WHEN 'P' THEN CASE WHEN o_custkey < 50 THEN '' END END"
        ).alias("candidate"),
        F.expr(
            "CASE WHEN o_totalprice < 100000 THEN '2024-01-30T11:59:59.500000+00:00'"
            " WHEN o_totalprice < 150000 THEN '2024-01-31T01:00:00+01:00' ELSE NULL END"
        ).alias("last_check"),
    )


NOW = "timestamp'2024-01-31 12:00:00+00:00'"


@query
def version_gate(spark: SparkSession, sf: str) -> DataFrame:
    plan = refresh.refresh_plan(_datasets(spark, sf), F.expr(NOW))
    return plan.select(
        "o_orderkey",
        strip_v(F.col("stored")).alias("stored"),
        strip_v(F.col("candidate")).alias("candidate"),
        version_status(F.col("stored"), F.col("candidate")).alias("version_status"),
        "status",
    )


@query
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.expr(
        "CASE event_type WHEN 'error' THEN concat('bad ', event_id) WHEN 'view' THEN "
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 'signup' THEN CASE WHEN user_id < 50 THEN '' END "
        "WHEN 'click' THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'\") "
        "ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END"
    )
    checks = s.table(spark, sf, "events").select("event_id", stamp.alias("last_check"))
    out = refresh.staleness(checks, "last_check", F.expr("timestamp'2024-01-30 12:00:00+00:00'"))
    return out.select("event_id", F.floor("elapsed_minutes").alias("elapsed_minutes"), "stale")


@query
def metadata_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Later writes replace earlier ones of the same key; the halves share most keys, not their values."""
    rows = s.metadata_rows(spark, sf)
    old, new = rows.filter(F.col("seq") % 2 == 0), rows.filter(F.col("seq") % 2 == 1)
    return metadata.upsert(old, new, "seq")


@query
def metadata_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Without numbers the new side wins, whatever the values."""
    rows = s.metadata_rows(spark, sf)
    newest = metadata.upsert(rows.filter(F.col("seq") % 3 == 0), rows.limit(0), "seq")
    return metadata.upsert(rows.groupBy("key").agg(F.max("value").alias("value")), newest)


@query
def metadata_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = s.metadata_rows(spark, sf)
    stored = metadata.upsert(rows, rows, "seq")
    return metadata.lookup(stored, "signup/1")


@query
def catalog_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summary with the latest version and date that the orders' import log holds."""
    seen = _versions(spark, sf).select(
        "o_orderkey",
        F.explode(
            F.create_map(
                F.lit("gpc_version"),
                version_from_path(F.col("xml_source"), F.col("xml_date")),
                F.lit("xml_date"),
                F.coalesce("xml_date", F.lit("unknown")),
                F.lit("xml_source"),
                F.col("xml_source"),
            )
        ),
    )
    stored = metadata.upsert(seen, seen, "o_orderkey")
    return refresh.catalog_summary(s.taxonomy(spark, sf), stored)


# ---- text rules -----------------------------------------------------------------


@query
def tag_label_query(spark: SparkSession, sf: str) -> DataFrame:
    tags = s.off_raw(spark, sf).select("code", F.posexplode("categories_tags").alias("pos", "tag"))
    return tags.select(
        "code", "pos", tag_label(F.col("tag")).alias("label"), fallback_label(F.col("tag")).alias("fallback")
    )


@query
def title_case_query(spark: SparkSession, sf: str) -> DataFrame:
    return s.table(spark, sf, "documents").select("doc_id", F.md5(title_case(F.col("text"))).alias("digest"))


# ---- products -------------------------------------------------------------------


@query
def off_nutrients(spark: SparkSession, sf: str) -> DataFrame:
    raw = s.off_raw(spark, sf).select("code", off_nutrient_struct(F.col("nutriments")).alias("n"))
    return raw.select("code", "n.*", F.size(off_nutrient_map(F.col("n"))).alias("n_known"))


def _csv(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


@query
def off_product(spark: SparkSession, sf: str) -> DataFrame:
    gtins = s.table(spark, sf, "lineitem").select(s.text("l_suppkey"))
    wanted = gtins.union(s.table(spark, sf, "orders").select(s.text("o_orderkey")))
    dump = work_dir(spark, "off")
    s.off_dump(spark, sf, dump)
    return products.off_products(read_off(spark, dump), wanted).select(
        "barcode",
        "product_name",
        "brands",
        "image_url",
        "ingredients_text",
        "quantity",
        "serving_size",
        _csv("categories"),
        _csv("allergens"),
        _csv("labels"),
        sorted_csv(F.map_keys("nutrients_per_100g")).alias("nutrients"),
    )


@query
def off_search(spark: SparkSession, sf: str) -> DataFrame:
    shaped = products.with_nutrient_map(products.shape_off(s.off_raw(spark, sf)))
    hits = search.search_products(shaped, "RING").flat()
    return hits.select("barcode", "product_name", "brands", "total", F.size("nutrients_per_100g").alias("n_nutrients"))


@query
def usda_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_foods(s.fdc_foods(spark, sf), "owner 1_3", 200).flat()


@query
def off_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "search")
    search.index_products(products.with_nutrient_map(products.shape_off(s.off_raw(spark, sf))), path)
    hits = search.search_products(read_candidates(spark, path, "barcode", "RING"), "RING").flat()
    return hits.select("barcode", "product_name", "brands", "total", F.size("nutrients_per_100g").alias("n_nutrients"))


@query
def usda_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "search")
    search.index_foods(s.fdc_foods(spark, sf), path)
    return search.search_foods(read_candidates(spark, path, "fdc_id", "owner 1_3"), "owner 1_3", 200).flat()


@query
def usda_food(spark: SparkSession, sf: str) -> DataFrame:
    """Full records from a dump, with their nutrient map; of repeated names the last one stays."""
    dump = work_dir(spark, "fdc")
    s.fdc_dump(spark, sf, dump)
    foods = products.fdc_foods(read_fdc(spark, dump))
    units = F.transform_values("nutrients", lambda k, v: v["unit"])
    return foods.select(
        *[c for c in foods.columns if c != "nutrients"],
        sorted_csv(F.map_keys("nutrients")).alias("names"),
        F.try_element_at(units, F.lit("Energy")).alias("energy_unit"),
        *[
            F.try_element_at("nutrients", F.lit(name))["amount"].alias(field)
            for field, name in FDC_NUTRIENTS.items()
        ],
    )


@query
def usda_nutrients(spark: SparkSession, sf: str) -> DataFrame:
    return products.nutrient_rows(s.fdc_nutrients(spark, sf), "seq")


def _wide_foods(spark: SparkSession, sf: str) -> DataFrame:
    """First branded food per barcode with its canonical amounts."""
    picked = products.fdc_by_gtin(s.fdc_foods(spark, sf))
    return picked.join(products.nutrients_wide(s.fdc_nutrients(spark, sf), "seq"), "fdc_id", "left")


@query
def usda_by_upc(spark: SparkSession, sf: str) -> DataFrame:
    gtins = s.table(spark, sf, "part").select(s.text("p_partkey"))
    return products.fdc_by_gtin(s.fdc_foods(spark, sf), gtins)


@query
def category_map(spark: SparkSession, sf: str) -> DataFrame:
    shaped = products.shape_off(s.off_raw(spark, sf))
    mapped = map_categories(shaped, s.part_taxonomy(spark, sf)).filter("mapped")
    return mapped.select("barcode", "brick_code", "matched_label", F.array_join("category_hierarchy", " > ").alias("path"))


@query
def category_fallback(spark: SparkSession, sf: str) -> DataFrame:
    shaped = products.shape_off(s.off_raw(spark, sf))
    unmapped = map_categories(shaped, s.part_taxonomy(spark, sf)).filter("not mapped")
    return unmapped.select(
        "barcode",
        F.size("category_hierarchy").alias("n_labels"),
        F.array_join("category_hierarchy", "|").alias("labels"),
    )


def _sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, tx.Taxonomy]:
    off = products.named_only(products.shape_off(s.off_raw(spark, sf)))
    return off, _wide_foods(spark, sf), s.part_taxonomy(spark, sf)


def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile(*_sources(spark, sf))


def _flat_product(df: DataFrame) -> list[Column]:
    return [
        F.col("product_name"),
        F.col("brand"),
        F.array_join("category_hierarchy", " > ").alias("category"),
        F.col("calories_kcal"),
        F.col("image_url"),
        F.col("ingredients_text"),
        _csv("allergens"),
        _csv("labels"),
        _csv("data_sources"),
    ]


@query
def reconcile_query(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical products of every order key used as a barcode, from stored sources; most have no source."""
    path = work_dir(spark, "sources")
    store_sources(*_sources(spark, sf), path, buckets=8)
    df = reconcile_stored(spark, path, s.table(spark, sf, "orders").select(s.text("o_orderkey")))
    return df.select("gtin", *_flat_product(df))


@query
def reconcile_nutrients(spark: SparkSession, sf: str) -> DataFrame:
    """Nutrients of the whole catalogue."""
    nutrients = ["protein", "fat", "carbohydrates", "fiber", "sugars", "sodium"]
    return _canonical(spark, sf).select(
        "gtin",
        "calories_kcal",
        *[F.col(f"{n}.{part}").alias(f"{n}_{part}") for n in nutrients for part in ("value", "unit")],
    )


@query
def stream_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream, each event looking up its user's key as a barcode."""
    base = work_dir(spark, "stream")
    store_canonical(_canonical(spark, sf), f"{base}/canonical", buckets=16)
    events = (
        spark.readStream.schema(s.table(spark, sf, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .select("event_id", s.text("user_id").alias("gtin"))
    )
    write_stream(events, f"{base}/canonical", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = read_enriched(spark, f"{base}/out")
    return out.select("event_id", "gtin", *_flat_product(out))


_NAMES = {
    "version_from_path_query": "version_from_path",
    "tag_label_query": "tag_label",
    "title_case_query": "title_case",
    "reconcile_query": "reconcile",
}
for _old, _new in _NAMES.items():
    QUERIES[_new] = QUERIES.pop(_old)
