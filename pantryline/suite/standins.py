"""The library's inputs, derived from the test tables.

All levels grow with the scale factor: suppliers are segments, parts families,
customers classes, orders bricks. The integer divisions below follow the fixed ratios
between these tables (20 parts per supplier, 4 parts per 3 customers), so every
reference holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pantryline.functions.nutrients import FDC_NUTRIENTS
from pantryline.plans.taxonomy import Taxonomy, class_path
from pantryline.schemas import BRICK

# So many order keys share the documents of a segment; those of the next ones continue in further documents.
DOCUMENT_KEYS = 16384
# Lines or bricks that a task puts into documents.
DOCUMENT_ROWS = 250_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(name: str) -> Column:
    return F.col(name).cast("string")


def taxonomy(spark: SparkSession, sf: str) -> Taxonomy:
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    lineitem = table(spark, sf, "lineitem")
    return Taxonomy(
        segments=supplier.select(
            text("s_suppkey").alias("segment_code"), F.col("s_name").alias("description")
        ),
        families=part.select(
            text("p_partkey").alias("family_code"),
            F.col("p_name").alias("description"),
            F.expr("cast(p_partkey div 20 as string)").alias("segment_code"),
        ),
        classes=table(spark, sf, "customer").select(
            text("c_custkey").alias("class_code"),
            F.col("c_name").alias("description"),
            F.expr("cast(c_custkey div 3 as string)").alias("family_code"),
        ),
        bricks=table(spark, sf, "orders").select(
            text("o_orderkey").alias("brick_code"),
            F.col("o_orderpriority").alias("description"),
            text("o_custkey").alias("class_code"),
        ),
        attribute_types=part.select(
            text("p_partkey").alias("att_type_code"), F.col("p_name").alias("att_type_text")
        ),
        attribute_values=supplier.select(
            text("s_suppkey").alias("att_value_code"), F.col("s_name").alias("att_value_text")
        ),
        brick_attribute_types=lineitem.select(
            text("l_orderkey").alias("brick_code"), text("l_partkey").alias("att_type_code")
        ).distinct(),
        attribute_type_values=lineitem.select(
            text("l_partkey").alias("att_type_code"), text("l_suppkey").alias("att_value_code")
        ).distinct(),
    )


def part_taxonomy(spark: SparkSession, sf: str) -> Taxonomy:
    """The same upper levels with parts as bricks, whose names make useful search texts.

    Part keys beyond the customers have no class, so their paths are shorter.
    """
    t = taxonomy(spark, sf)
    bricks = table(spark, sf, "part").select(
        text("p_partkey").alias("brick_code"),
        F.col("p_name").alias("description"),
        text("p_partkey").alias("class_code"),
    )
    return Taxonomy(**{**t.tables(), "bricks": bricks})


# ---- documents to ingest --------------------------------------------------------


def _collected(rows: DataFrame, keys: list[str], order: str, element: Column, name: str) -> DataFrame:
    """The elements of each group of keys, in order, as an array."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("at"), element.alias("x"))))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda e: e["x"]).alias(name))


def documents(
    spark: SparkSession, sf: str, varied: bool = True, attributes: bool = True
) -> DataFrame:
    """`segment` documents as the XML reader gives them, with siblings at every level.

    One document per segment with all its families and classes; then documents with bricks: several
    families, classes, bricks, types and values below each other, for DOCUMENT_KEYS order keys, so a
    large class continues in the next document. Each value is followed by one of the same code and
    another text, which never comes first. With `varied`, the texts of a type or value differ
    between lines; without `attributes`, bricks have no types.
    """
    t = taxonomy(spark, sf)
    lines = table(spark, sf, "lineitem")
    # The rows of a task are bounded, whatever the tables' size; the files' footers give the counts.
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        *[-(-rows.count() // DOCUMENT_ROWS) for rows in (lines, t.bricks)],
    )
    flags = ["l_returnflag", "l_linestatus"] if varied else []
    ending = lambda e, flag: [F.lit(" "), e[flag]] if varied else []

    def value(e: Column, *end: Column) -> Column:
        code = e["l_suppkey"].cast("string")
        return F.struct(code.alias("_code"), F.concat(F.lit("Supplier "), code, *end).alias("_text"))

    def att_type(e: Column) -> Column:
        code = e["l_partkey"].cast("string")
        return F.struct(
            code.alias("_code"),
            F.concat(F.lit("Part "), code, *ending(e, "l_returnflag")).alias("_text"),
            F.array(value(e, *ending(e, "l_linestatus")), value(e, F.lit(" again"))).alias("attValue"),
        )

    upper = class_path(t).drop("full_path").filter(F.col("segment_description").isNotNull())
    bricks = (
        t.bricks.withColumnRenamed("description", "brick_text")
        .repartition(parts, "class_code")
        .join(upper.hint("merge"), "class_code")
    )
    number = F.col("brick_code").cast("bigint")
    if attributes:
        # Met by the order's number: rows of numbers alone take the least space in the exchange.
        of_brick = (
            lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *flags)
            .repartition(parts, "l_orderkey")
            .groupBy("l_orderkey")
            .agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", *flags)).alias("lines"))
        )
        bricks = bricks.repartition(parts, number).join(of_brick, number == F.col("l_orderkey"), "left")
        bricks = bricks.withColumn("lines", F.array_sort("lines"))
        # In order now, and from here a list of each column.
        listed = ["l_partkey", "l_suppkey", *flags]
        bricks = bricks.withColumns({c: F.col("lines")[c] for c in listed}).drop("l_orderkey", "lines")
        types = F.transform(F.arrays_zip(*listed), att_type)
    else:
        types = F.lit(None).cast(BRICK["attType"].dataType)

    brick = F.struct(F.col("brick_code").alias("_code"), F.col("brick_text").alias("_text"), "attType")
    segment = ["segment_code", "segment_description", "chunk"]
    family, cls = ["family_code", "family_description"], ["class_code", "description"]
    # Dealt by document once; every grouping below stays in place. Lines travel as numbers until here: the
    # nested texts made of them are several times as long.
    bricks = bricks.withColumn("chunk", F.expr(f"cast(brick_code as bigint) div {DOCUMENT_KEYS}"))
    bricks = bricks.repartition(parts, "segment_code", "chunk").withColumn("attType", types)
    per_class = _collected(bricks, [*segment, *family, *cls], "brick_code", brick, "brick")
    no_brick = F.lit(None).cast(per_class.schema["brick"].dataType)

    def nested(classes: DataFrame, kind: int, parents: list[str]) -> DataFrame:
        """Classes with their bricks as documents; a class or family code of null stands for none."""
        one = F.when(
            F.col("class_code").isNotNull(),
            F.struct(F.col("class_code").alias("_code"), F.col("description").alias("_text"), "brick"),
        )
        families = _collected(classes, [*parents, *family], "class_code", one, "class").withColumn(
            "class", F.filter("class", lambda c: c.isNotNull())
        )
        whole = F.when(
            F.col("family_code").isNotNull(),
            F.struct(F.col("family_code").alias("_code"), F.col("family_description").alias("_text"), "class"),
        )
        docs = _collected(families, parents, "family_code", whole, "family")
        return docs.select(
            F.struct(
                F.lit(kind).alias("kind"), F.col("segment_code").cast("bigint").alias("key"), F.col("chunk").alias("part")
            ).alias("ord"),
            F.lit(True).alias("lead"),
            F.col("segment_code").alias("_code"),
            F.col("segment_description").alias("_text"),
            F.filter("family", lambda f: f.isNotNull()).alias("family"),
        )

    # By the fixed ratios a segment has 20 families, and these few classes each.
    skeleton = (
        t.segments.withColumnRenamed("description", "segment_description")
        .join(t.families.withColumnRenamed("description", "family_description"), "segment_code", "left")
        .repartition(parts, "family_code")
        .join(t.classes, "family_code", "left")
        .withColumns({"chunk": F.lit(-1).cast("bigint"), "brick": no_brick})
        .repartition(parts, "segment_code", "chunk")
    )
    return nested(skeleton, 0, segment).unionByName(nested(per_class, 1, segment))


# ---- products -------------------------------------------------------------------

NUTRIMENTS = """
concat('{"energy-kcal_100g": ', p_retailprice, ', "proteins_100g": "', p_size, '", "fat_100g": "',
       CASE WHEN p_type = 'SMALL' THEN 'n/a' ELSE cast(p_size AS string) END,
       '", "fiber_100g": ', CASE WHEN p_type = 'LARGE' THEN 'null' ELSE '0' END,
       ', "salt_100g": ', p_size, ', "k": 1}')
"""

TAGS = """
CASE p_brand
  WHEN 'Brand#1' THEN array('en:')
  WHEN 'Brand#2' THEN array('en:aa', 'en:bb', 'en:cc', concat('en:', replace(p_name, ' ', '-')), 'en:x-y', 'en:z')
  WHEN 'Brand#3' THEN array()
  WHEN 'Brand#4' THEN cast(null AS array<string>)
  WHEN 'Brand#5' THEN array(p_type, upper(p_name))
  WHEN 'Brand#6' THEN array(concat('fr:x:', replace(p_name, ' ', '-')), 'en:ring')
  WHEN 'Brand#7' THEN array('en:none', 'en:r_d-r')
  WHEN 'Brand#8' THEN array('en:100%-none', 'en:o%-%g')
  WHEN 'Brand#9' THEN array('en:none', 'en:o''brien-3rd', 'plain-tag')
  ELSE array(concat('en:', lower(p_type)), concat('en:', replace(p_name, ' ', '-'), 's'),
             concat('en:', substring_index(p_name, ' ', -1)))
END
"""


def off_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Crowdsourced products from parts: some without a name, tags of every kind."""
    return table(spark, sf, "part").select(
        text("p_partkey").alias("code"),
        F.expr(
            "CASE WHEN p_type = 'PROMO' THEN '' WHEN p_type = 'STANDARD' AND p_size > 25 THEN NULL ELSE p_name END"
        ).alias("product_name"),
        F.expr("CASE WHEN p_size < 10 THEN '' ELSE p_brand END").alias("brands"),
        F.concat(F.lit("images/"), text("p_partkey"), F.lit(".jpg")).alias("image_url"),
        F.expr(
            "CASE WHEN p_size < 20 THEN '' WHEN p_size > 40 THEN NULL ELSE concat('contains ', p_name) END"
        ).alias("ingredients_text"),
        F.concat(text("p_size"), F.lit(" g")).alias("quantity"),
        F.lit(None).cast("string").alias("serving_size"),
        F.expr(TAGS).alias("categories_tags"),
        F.expr("CASE WHEN p_size > 30 THEN array(concat('en:', lower(p_type))) END").alias("allergens_tags"),
        F.expr("CASE WHEN p_size > 45 THEN array('en:organic', p_brand) END").alias("labels_tags"),
        F.from_json(F.expr(NUTRIMENTS), "map<string,string>").alias("nutriments"),
    )


def fdc_foods(spark: SparkSession, sf: str) -> DataFrame:
    """Laboratory foods from orders; a customer's key is the barcode of several foods."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("fdc_id"),
        F.expr(
            "CASE o_orderpriority WHEN '5-LOW' THEN '' WHEN '3-MEDIUM' THEN NULL"
            " ELSE concat('Food ', o_orderpriority, ' ', o_orderkey) END"
        ).alias("description"),
        F.expr(
            "CASE o_orderstatus WHEN 'F' THEN 'Branded' WHEN 'O' THEN 'Foundation' ELSE 'SR Legacy' END"
        ).alias("data_type"),
        F.expr(
            "CASE o_orderpriority WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN NULL"
            " ELSE concat('Owner ', o_custkey) END"
        ).alias("brand_owner"),
        F.expr("CASE WHEN o_orderpriority <> '2-HIGH' THEN concat('Brand ', o_custkey) ELSE '' END").alias(
            "brand_name"
        ),
        F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE concat('made of ', o_orderkey) END").alias(
            "ingredients"
        ),
        F.col("o_totalprice").alias("serving_size"),
        F.lit("g").alias("serving_size_unit"),
        text("o_custkey").alias("gtin"),
    )


def fdc_nutrients(spark: SparkSession, sf: str) -> DataFrame:
    """(fdc_id, seq, name, amount, unit_name): one row per order line, names repeating."""
    names = F.array(*[F.lit(n) for n in FDC_NUTRIENTS.values()])
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("fdc_id"),
        F.struct("l_partkey", "l_suppkey").alias("seq"),
        F.element_at(names, F.col("l_linenumber")).alias("name"),
        F.expr("CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL ELSE l_quantity END").alias("amount"),
        F.expr(
            "CASE WHEN l_linenumber = 1 THEN CASE WHEN l_returnflag = 'A' THEN 'kJ' ELSE 'KCAL' END"
            " WHEN l_linenumber = 7 THEN 'MG' ELSE 'G' END"
        ).alias("unit_name"),
    )


def off_dump(spark: SparkSession, sf: str, path: str) -> None:
    """The crowdsourced products as a JSON dump."""
    off_raw(spark, sf).write.json(path)


def fdc_dump(spark: SparkSession, sf: str, path: str) -> None:
    """The laboratory foods with their nutrient lists, repeated names left in, as a JSON dump.

    An order has few lines, so its list is short.
    """
    entry = F.struct("seq", "name", "amount", "unit_name")
    listed = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e: F.struct(e["name"].alias("name"), e["amount"].alias("amount"), e["unit_name"].alias("unit_name")),
    )
    lists = fdc_nutrients(spark, sf).groupBy("fdc_id").agg(listed.alias("nutrients"))
    fdc_foods(spark, sf).join(lists, "fdc_id", "left").write.json(path)


def metadata_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(key, value, seq): metadata writes, one per event."""
    return table(spark, sf, "events").select(
        F.concat(F.col("event_type"), F.lit("/"), text("user_id")).alias("key"),
        F.concat(F.lit("v"), text("event_id")).alias("value"),
        F.col("event_id").alias("seq"),
    )
