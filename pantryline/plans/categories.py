"""Mapping informal product tags to classification paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pantryline.functions.text import fallback_label, tag_label
from pantryline.operators.containment import first_containing
from pantryline.operators.skew import join_parent
from pantryline.plans.taxonomy import Taxonomy, with_brick_path
from pantryline.session import staged

MAPPED_TAGS = 3
FALLBACK_TAGS = 5


def label_paths(labels: DataFrame, t: Taxonomy) -> DataFrame:
    """(label, brick_code, path_parts) of the first brick whose description contains the label.

    A label whose first brick has an empty path counts as not found. Runs jobs when called; the labels
    found are written to the shared folder, and only their bricks get a path.
    """
    texts = t.bricks.select(F.col("brick_code").alias("code"), F.col("description").alias("text"))
    found = staged(first_containing(labels, texts).withColumnRenamed("code", "brick_code"), "found")
    paths = with_brick_path(found.join(t.bricks, "brick_code"), t)
    return paths.select("label", "brick_code", "path_parts").filter(F.size("path_parts") > 0)


def map_tag_lists(tags: DataFrame, t: Taxonomy) -> DataFrame:
    """(head, brick_code, path_parts, matched_label) for every distinct leading tag list that maps.

    `tags` has `head`, the first tags of a product. The first tag, in order, with a
    brick decides. The distinct lists are staged: they are used several times below, and the
    products should be read for them only once.
    """
    heads = staged(tags.select("head").filter(F.col("head").isNotNull()).distinct(), "heads")
    placed = heads.select("head", F.posexplode("head").alias("at", "tag")).select(
        "head", "at", tag_label(F.col("tag")).alias("label")
    )
    paths = label_paths(placed.select("label").distinct(), t)
    hit = placed.join(paths, "label").groupBy("head").agg(
        F.min_by(F.struct("brick_code", "path_parts", F.col("label").alias("matched_label")), "at").alias("hit")
    )
    return hit.select("head", "hit.*")


def map_categories(products: DataFrame, t: Taxonomy, tags: str = "categories") -> DataFrame:
    """Add `brick_code`, `matched_label`, `category_hierarchy` and `mapped` to products with tags.

    Tag lists repeat across products, so the distinct ones are mapped and joined back.
    Without a mapping the first five tags stand in as labels. An empty `matched_label`
    comes from a tag such as `en:`, which every description contains. Products without
    tags meet nothing, and popular tag lists are spread. Runs jobs when called: the distinct
    tag lists and labels are written to the shared folder.
    """
    head = F.when(F.size(tags) > 0, F.slice(F.col(tags), 1, MAPPED_TAGS))
    mapped = map_tag_lists(products.select(head.alias("head")), t)
    fallback = F.transform(F.slice(F.col(tags), 1, FALLBACK_TAGS), fallback_label)
    return (
        join_parent(products.withColumn("head", head), mapped, "head")
        .withColumn("mapped", F.col("path_parts").isNotNull())
        .withColumn("category_hierarchy", F.coalesce(F.col("path_parts"), fallback, F.array()))
        .drop("head", "path_parts")
    )
