"""For each registered query, the same result as SQL over the test tables."""

from __future__ import annotations

from pantryline.functions.nutrients import FDC_NUTRIENTS

HIERARCHY = """
segments AS (SELECT cast(s_suppkey AS varchar) AS segment_code, s_name AS description FROM supplier),
families AS (SELECT cast(p_partkey AS varchar) AS family_code, p_name AS description,
                    cast(p_partkey // 20 AS varchar) AS segment_code FROM part),
classes AS (SELECT cast(c_custkey AS varchar) AS class_code, c_name AS description,
                   cast(c_custkey // 3 AS varchar) AS family_code FROM customer),
bricks AS (SELECT cast(o_orderkey AS varchar) AS brick_code, o_orderpriority AS description,
                  cast(o_custkey AS varchar) AS class_code FROM orders),
attribute_types AS (SELECT cast(p_partkey AS varchar) AS att_type_code, p_name AS att_type_text FROM part),
attribute_values AS (SELECT cast(s_suppkey AS varchar) AS att_value_code, s_name AS att_value_text FROM supplier),
brick_attribute_types AS (SELECT DISTINCT cast(l_orderkey AS varchar) AS brick_code,
                                 cast(l_partkey AS varchar) AS att_type_code FROM lineitem),
attribute_type_values AS (SELECT DISTINCT cast(l_partkey AS varchar) AS att_type_code,
                                 cast(l_suppkey AS varchar) AS att_value_code FROM lineitem)
"""

PATHS = f"""{HIERARCHY},
class_path AS (
  SELECT c.class_code, c.description, c.family_code, f.description AS family_description,
         f.segment_code, s.description AS segment_description,
         concat_ws(' > ', nullif(s.description, ''), nullif(f.description, ''), nullif(c.description, '')) AS full_path
  FROM classes c LEFT JOIN families f USING (family_code) LEFT JOIN segments s ON f.segment_code = s.segment_code),
brick_path AS (
  SELECT b.brick_code, b.description, b.class_code, c.description AS class_description, c.family_code,
         c.family_description, c.segment_code, c.segment_description,
         concat_ws(' > ', nullif(c.segment_description, ''), nullif(c.family_description, ''),
                   nullif(c.description, ''), nullif(b.description, '')) AS full_path
  FROM bricks b LEFT JOIN class_path c USING (class_code))
"""


def _page(table: str, code: str, where: str, page: int, size: int) -> str:
    """A page with its envelope, which an empty page has as well."""
    previous = str(page - 1) if page > 1 else "cast(NULL AS bigint)"
    return f"""WITH {HIERARCHY}, hits AS (SELECT {code}, description FROM {table} WHERE {where}),
total AS (SELECT count(*) AS n FROM hits),
page AS (SELECT * FROM hits ORDER BY {code} LIMIT {size} OFFSET {(page - 1) * size})
SELECT {code}, description, n AS "count",
       CASE WHEN {(page - 1) * size} + {size} < n THEN {page + 1} END AS "next", {previous} AS "previous"
FROM total LEFT JOIN page ON true"""


def _children(child: str, child_code: str, parent_code: str) -> str:
    return f"""kids AS (SELECT {parent_code}, {child_code}, description AS child_description,
   row_number() OVER (PARTITION BY {parent_code} ORDER BY {child_code}) AS position,
   count(*) OVER (PARTITION BY {parent_code}) AS n FROM {child})"""


def _list(child: str, child_code: str, parent_code: str) -> str:
    return f"""lists AS (SELECT {parent_code},
   string_agg({child_code} || '=' || coalesce(description, ''), ',' ORDER BY {child_code}) AS items
   FROM {child} GROUP BY {parent_code})"""


# ---- documents to ingest

VISITS = f"""{HIERARCHY},
lines AS (SELECT cast(l_orderkey AS varchar) AS brick_code, cast(l_partkey AS varchar) AS att_type_code,
                 cast(l_suppkey AS varchar) AS att_value_code, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 l_returnflag, l_linestatus FROM lineitem),
chain AS (SELECT b.brick_code, b.description AS brick_text, c.class_code, c.description AS class_text,
                 f.family_code, f.description AS family_text, s.segment_code, s.description AS segment_text
          FROM bricks b JOIN classes c USING (class_code) JOIN families f USING (family_code)
               JOIN segments s ON f.segment_code = s.segment_code),
docs AS (SELECT *, cast(brick_code AS bigint) // 16384 AS chunk FROM chain),
segment_visits AS (SELECT segment_code FROM segments
                   UNION ALL SELECT segment_code FROM (SELECT DISTINCT segment_code, chunk FROM docs)),
family_visits AS (SELECT family_code, segment_code FROM families JOIN segments USING (segment_code)
                  UNION ALL SELECT family_code, segment_code FROM (
                    SELECT DISTINCT family_code, segment_code, chunk FROM docs)),
class_visits AS (SELECT class_code, family_code FROM classes JOIN families USING (family_code)
                   JOIN segments USING (segment_code)
                 UNION ALL SELECT class_code, family_code FROM (
                   SELECT DISTINCT class_code, family_code, chunk FROM docs)),
placed AS (SELECT lines.*, cast(segment_code AS bigint) AS sk, chunk, cast(family_code AS bigint) AS fk,
                  cast(class_code AS bigint) AS ck FROM lines JOIN docs USING (brick_code))
"""

# ---- products

OFF_RAW = """off_raw AS (
SELECT cast(p_partkey AS varchar) AS code,
  CASE WHEN p_type = 'PROMO' THEN '' WHEN p_type = 'STANDARD' AND p_size > 25 THEN NULL ELSE p_name END AS product_name,
  CASE WHEN p_size < 10 THEN '' ELSE p_brand END AS brands,
  'images/' || p_partkey || '.jpg' AS image_url,
  CASE WHEN p_size < 20 THEN '' WHEN p_size > 40 THEN NULL ELSE 'contains ' || p_name END AS ingredients_text,
  p_size || ' g' AS quantity, cast(NULL AS varchar) AS serving_size,
  CASE p_brand
    WHEN 'Brand#1' THEN ['en:']
    WHEN 'Brand#2' THEN ['en:aa', 'en:bb', 'en:cc', 'en:' || replace(p_name, ' ', '-'), 'en:x-y', 'en:z']
    WHEN 'Brand#3' THEN cast([] AS varchar[])
    WHEN 'Brand#4' THEN cast([] AS varchar[])
    WHEN 'Brand#5' THEN [p_type, upper(p_name)]
    WHEN 'Brand#6' THEN ['fr:x:' || replace(p_name, ' ', '-'), 'en:ring']
    WHEN 'Brand#7' THEN ['en:none', 'en:r_d-r']
    WHEN 'Brand#8' THEN ['en:100%-none', 'en:o%-%g']
    WHEN 'Brand#9' THEN ['en:none', 'en:o''brien-3rd', 'plain-tag']
    ELSE ['en:' || lower(p_type), 'en:' || replace(p_name, ' ', '-') || 's', 'en:' || split_part(p_name, ' ', -1)]
  END AS tags,
  CASE WHEN p_size > 30 THEN 'en:' || lower(p_type) ELSE '' END AS allergens,
  CASE WHEN p_size > 45 THEN 'en:organic,' || p_brand ELSE '' END AS labels,
  '{"energy-kcal_100g": ' || p_retailprice || ', "proteins_100g": "' || p_size || '", "fat_100g": "'
   || CASE WHEN p_type = 'SMALL' THEN 'n/a' ELSE cast(p_size AS varchar) END
   || '", "fiber_100g": ' || CASE WHEN p_type = 'LARGE' THEN 'null' ELSE '0' END
   || ', "salt_100g": ' || p_size || ', "k": 1}' AS nutriments
FROM part),
off_shaped AS (SELECT *,
  try_cast(json_extract_string(nutriments, '$."energy-kcal_100g"') AS double) AS calories_kcal,
  try_cast(json_extract_string(nutriments, '$."proteins_100g"') AS double) AS protein_g,
  try_cast(json_extract_string(nutriments, '$."fat_100g"') AS double) AS fat_g,
  try_cast(json_extract_string(nutriments, '$."carbohydrates_100g"') AS double) AS carbohydrates_g,
  try_cast(json_extract_string(nutriments, '$."fiber_100g"') AS double) AS fiber_g,
  try_cast(json_extract_string(nutriments, '$."sugars_100g"') AS double) AS sugars_g,
  try_cast(json_extract_string(nutriments, '$."sodium_100g"') AS double) AS sodium_g,
  try_cast(json_extract_string(nutriments, '$."salt_100g"') AS double) AS salt_g
  FROM off_raw)"""

FDC_RAW = """foods AS (
SELECT o_orderkey AS fdc_id,
  CASE o_orderpriority WHEN '5-LOW' THEN '' WHEN '3-MEDIUM' THEN NULL
    ELSE 'Food ' || o_orderpriority || ' ' || o_orderkey END AS description,
  CASE o_orderstatus WHEN 'F' THEN 'Branded' WHEN 'O' THEN 'Foundation' ELSE 'SR Legacy' END AS data_type,
  CASE o_orderpriority WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN NULL ELSE 'Owner ' || o_custkey END AS brand_owner,
  CASE WHEN o_orderpriority <> '2-HIGH' THEN 'Brand ' || o_custkey ELSE '' END AS brand_name,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'made of ' || o_orderkey END AS ingredients,
  o_totalprice AS serving_size, 'g' AS serving_size_unit, cast(o_custkey AS varchar) AS gtin
FROM orders)"""

_NAME_LIST = ", ".join("'" + n + "'" for n in FDC_NUTRIENTS.values())

NUTRIENT_ROWS = f"""nutrient_rows AS (
SELECT fdc_id, name, amount, unit_name FROM (
  SELECT l_orderkey AS fdc_id, [{_NAME_LIST}][l_linenumber] AS name,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL ELSE l_quantity END AS amount,
    CASE WHEN l_linenumber = 1 THEN CASE WHEN l_returnflag = 'A' THEN 'kJ' ELSE 'KCAL' END
         WHEN l_linenumber = 7 THEN 'MG' ELSE 'G' END AS unit_name,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) AS rn
  FROM lineitem) WHERE rn = 1),
wide AS (SELECT fdc_id, {", ".join(f"max(CASE WHEN name = '{n}' THEN amount END) AS {f}" for f, n in FDC_NUTRIENTS.items())}
  FROM nutrient_rows GROUP BY fdc_id)"""


def _label(tag: str) -> str:
    """Text after the last colon with blanks for dashes."""
    return f"CASE WHEN contains({tag}, ':') THEN replace(split_part({tag}, ':', -1), '-', ' ') ELSE {tag} END"


def _title(text: str) -> str:
    return (
        f"coalesce(list_aggregate(list_transform(regexp_extract_all({text}, '[\\p{{L}}]+|[^\\p{{L}}]+'),"
        " lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), 'string_agg', ''), '')"
    )


def _fallback(tag: str) -> str:
    return f"CASE WHEN contains({tag}, ':') THEN {_title(f'({_label(tag)})')} ELSE {tag} END"


PART_PATHS = f"""{HIERARCHY},
part_bricks AS (SELECT cast(p_partkey AS varchar) AS brick_code, p_name AS description,
                       cast(p_partkey AS varchar) AS class_code FROM part),
part_path AS (
  SELECT b.brick_code, b.description,
         concat_ws(' > ', nullif(s.description, ''), nullif(f.description, ''), nullif(c.description, ''),
                   nullif(b.description, '')) AS path
  FROM part_bricks b LEFT JOIN classes c USING (class_code) LEFT JOIN families f ON c.family_code = f.family_code
       LEFT JOIN segments s ON f.segment_code = s.segment_code)"""

CATEGORIES = f"""{PART_PATHS}, {OFF_RAW},
tags AS (SELECT code, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM off_raw),
labelled AS (SELECT code, pos, {_label("tag")} AS label FROM tags WHERE pos <= 3),
label_brick AS (SELECT label, min(brick_code) AS brick_code FROM (SELECT DISTINCT label FROM labelled)
  JOIN part_path ON description ILIKE '%' || label || '%' GROUP BY label),
mapped AS (SELECT code, brick_code, path, label AS matched_label FROM (
  SELECT code, brick_code, path, label, row_number() OVER (PARTITION BY code ORDER BY pos) AS rn
  FROM labelled JOIN label_brick USING (label) JOIN part_path USING (brick_code) WHERE path <> '') WHERE rn = 1),
fallback AS (SELECT code, count(*) AS n, string_agg({_fallback("tag")}, '{{sep}}' ORDER BY pos) AS labels
  FROM tags WHERE pos <= 5 GROUP BY code)"""

CATALOGUE = f"""{CATEGORIES.replace("{sep}", " > ")}, {FDC_RAW}, {NUTRIENT_ROWS},
u AS (SELECT f.*, w.* EXCLUDE (fdc_id) FROM (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY gtin ORDER BY fdc_id) AS rn FROM foods WHERE data_type = 'Branded')
      WHERE rn = 1) f LEFT JOIN wide w USING (fdc_id)),
o AS (SELECT s.*, m.path, fb.labels AS tag_labels FROM off_shaped s LEFT JOIN mapped m USING (code)
      LEFT JOIN fallback fb USING (code) WHERE nullif(product_name, '') IS NOT NULL),
canonical AS (
  SELECT coalesce(o.code, u.gtin) AS gtin,
    coalesce(nullif(u.description, ''), nullif(o.product_name, ''), 'Unknown') AS product_name,
    coalesce(nullif(u.brand_owner, ''), nullif(u.brand_name, ''), nullif(o.brands, '')) AS brand,
    coalesce(o.path, o.tag_labels, '') AS category,
    coalesce(u.energy, o.calories_kcal) AS calories_kcal, o.image_url,
    coalesce(nullif(o.ingredients_text, ''), nullif(u.ingredients, ''), o.ingredients_text) AS ingredients_text,
    coalesce(o.allergens, '') AS allergens, coalesce(o.labels, '') AS labels,
    concat_ws(',', CASE WHEN o.code IS NOT NULL THEN 'OpenFoodFacts' END,
      CASE WHEN u.gtin IS NOT NULL THEN 'USDA_FDC' END, CASE WHEN o.path IS NOT NULL THEN 'GS1_GPC' END) AS data_sources,
    {", ".join(
        f"coalesce(u.{n}, o.{n2}) AS {n}_value,"
        f" CASE WHEN coalesce(u.{n}, o.{n2}) IS NOT NULL THEN 'g' END AS {n}_unit"
        for n, n2 in [("protein", "protein_g"), ("fat", "fat_g"), ("carbohydrates", "carbohydrates_g"),
                      ("fiber", "fiber_g"), ("sugars", "sugars_g")]
    )},
    coalesce(u.sodium, o.sodium_g) AS sodium_value,
    CASE WHEN u.sodium IS NOT NULL THEN 'mg' WHEN o.sodium_g IS NOT NULL THEN 'g' END AS sodium_unit
  FROM o FULL JOIN u ON o.code = u.gtin)"""

_PRODUCT = (
    "product_name, brand, category, calories_kcal, image_url, ingredients_text, allergens, labels, data_sources"
)

_STEM = "regexp_replace(regexp_replace(xml_source, '^.*/', ''), '^(.+)\\.[^.]+$', '\\1')"

VERSIONS = f"""paths AS (SELECT o_orderkey, o_orderstatus,
  CASE o_orderkey % 6
    WHEN 0 THEN '/data/imports/en-v' || strftime(o_orderdate, '%Y%m%d') || '.xml'
    WHEN 1 THEN 'gpc-' || strftime(o_orderdate, '%Y%m%d') || '.xml'
    WHEN 2 THEN 'data/gpc_' || o_orderkey || '.xml'
    WHEN 3 THEN 'data/gpc-vegan-' || o_orderkey || '.tar.xml'
    WHEN 4 THEN 'food-x' || o_orderkey || '.xml'
    ELSE '/a-b/v' || o_orderkey END AS xml_source,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'unknown'
    WHEN '2-HIGH' THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate)
    WHEN '3-MEDIUM' THEN ' ' || strftime(o_orderdate, '%m/%d/%Y') || ' '
    WHEN '4-NOT SPECIFIED' THEN day(o_orderdate) || '/13/' || year(o_orderdate) ELSE NULL END AS xml_date
  FROM orders),
stems AS (SELECT *, {_STEM} AS stem FROM paths),
versions AS (SELECT *, CASE WHEN contains(stem, '-v') THEN regexp_extract(stem, '^.*?-v(.*)$', 1)
    WHEN regexp_matches(stem, '^[^-]*-[0-9]+$') THEN regexp_extract(stem, '^[^-]*-(.*)$', 1)
    ELSE coalesce(strftime(try_strptime(trim(xml_date), '%m/%d/%Y'), '%Y%m%d'), 'unknown') END AS version FROM stems)"""

_ORPHANS = """
SELECT 'label' AS reason, cast(doc_id AS varchar) AS key FROM documents d
 WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL
SELECT 'customer', l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey FROM lineitem
 WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = l_partkey)
UNION ALL
SELECT 'null', cast(p_partkey AS varchar) FROM part WHERE p_type = 'STANDARD' AND p_size > 25"""

_FIRST_TEXT = """SELECT '{table}' AS table_name, {code} AS code, {text} AS text, visits FROM (
  SELECT *, row_number() OVER (
      PARTITION BY {code} ORDER BY sk, chunk, fk, ck, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn,
    {times} * count(*) OVER (PARTITION BY {code}) AS visits FROM placed) WHERE rn = 1"""

_HIERARCHY_ROWS = """
SELECT 'segments' AS table_name, segment_code AS c1, description AS c2, cast(NULL AS varchar) AS c3 FROM segments
UNION ALL SELECT 'families', family_code, description, segment_code FROM families
UNION ALL SELECT 'classes', class_code, description, family_code FROM classes
UNION ALL SELECT 'bricks', brick_code, description, class_code FROM bricks"""

_JUNCTION_ROWS = """
SELECT 'brick_attribute_types' AS table_name, brick_code AS c1, att_type_code AS c2, cast(NULL AS varchar) AS c3
FROM brick_attribute_types
UNION ALL SELECT 'attribute_type_values', att_type_code, att_value_code, NULL FROM attribute_type_values"""

# Occurrences and unique rows per table.
_COUNTS = """counted AS (
SELECT 'segments' AS table_name, count(*) AS occurrences, count(DISTINCT segment_code) AS unique_rows FROM segment_visits
UNION ALL SELECT 'families', count(*), count(DISTINCT family_code) FROM family_visits
UNION ALL SELECT 'classes', count(*), count(DISTINCT class_code) FROM class_visits
UNION ALL SELECT 'bricks', count(*), count(DISTINCT brick_code) FROM chain
UNION ALL SELECT 'attribute_types', count(*), count(DISTINCT att_type_code) FROM lines
UNION ALL SELECT 'attribute_values', 2 * count(*), count(DISTINCT att_value_code) FROM lines
UNION ALL SELECT 'brick_attribute_types', count(*), count(DISTINCT (brick_code, att_type_code)) FROM lines
UNION ALL SELECT 'attribute_type_values', 2 * count(*), count(DISTINCT (att_type_code, att_value_code)) FROM lines),
counts AS (SELECT * FROM counted
  UNION ALL SELECT 'total', cast(sum(occurrences) AS bigint), cast(sum(unique_rows) AS bigint) FROM counted)"""


def _search(table: str, code: str, pattern: str) -> str:
    return (
        f"SELECT '{table}' AS entity, {code} AS code, description FROM {table}"
        f" WHERE {code} ILIKE '{pattern}' OR description ILIKE '{pattern}'"
    )


_LEVELS = {
    "segments": "segment_code", "families": "family_code", "classes": "class_code", "bricks": "brick_code",
}

_EPOCH = "(epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts))"

ORACLES: dict[str, str] = {
    "brick_path": f"""WITH {PATHS} SELECT *,
  concat_ws('|', nullif(segment_description, ''), nullif(family_description, ''), nullif(class_description, ''),
            nullif(description, '')) AS path_parts FROM brick_path""",
    "list_segments": _page(
        "segments", "segment_code", "segment_code ILIKE '%SUPPLIER#0%' OR description ILIKE '%SUPPLIER#0%'", 2, 15
    ),
    "list_families": _page(
        "families",
        "family_code",
        "(family_code ILIKE '%r%g%' OR description ILIKE '%r%g%') AND segment_code = '3'",
        1,
        20,
    ),
    "list_classes": _page("classes", "class_code", "true", 3, 100),
    "list_bricks": _page(
        "bricks", "brick_code", "brick_code ILIKE '%urgent%' OR description ILIKE '%urgent%'", 2, 50
    ),
    "list_bricks_of_class": _page("bricks", "brick_code", "class_code = '17'", 1, 20),
    "list_bricks_after": f"""WITH {HIERARCHY} SELECT brick_code, description FROM bricks
  WHERE (brick_code ILIKE '%_-NOT%spec%' OR description ILIKE '%_-NOT%spec%') AND brick_code > '5'
  ORDER BY brick_code LIMIT 100""",
    "list_positions": f"""WITH {HIERARCHY}, numbered AS (
  SELECT brick_code, description, row_number() OVER (ORDER BY brick_code) AS position FROM bricks)
SELECT *, (position + 19) // 20 AS page FROM numbered""",
    "list_count": f"WITH {HIERARCHY} "
    + " UNION ALL ".join(
        f"SELECT '{level}' AS level, count(*) AS n FROM {table}"
        f" WHERE {code} ILIKE '%1%' OR description ILIKE '%1%'"
        for level, (table, code) in zip(["segment", "family", "class", "brick"], _LEVELS.items())
    ),
    "page_info": f"""WITH {HIERARCHY},
totals AS (SELECT class_code, count(*) AS total FROM bricks GROUP BY class_code),
pages AS (SELECT DISTINCT class_code, total, unnest([1, 2, (total + 4) // 5, (total + 4) // 5 + 1]) AS page FROM totals)
SELECT class_code, total, page, (page - 1) * 5 AS "offset",
  CASE WHEN (page - 1) * 5 + 5 < total THEN page + 1 END AS "next",
  CASE WHEN page > 1 THEN page - 1 END AS "previous" FROM pages""",
    "list_past_the_end": _page("segments", "segment_code", "true", 90_000, 100),
    "list_numbered": _page("bricks", "brick_code", "brick_code ILIKE '%1%' OR description ILIKE '%1%'", 4, 100),
    "list_stored": _page("bricks", "brick_code", "true", 13, 90),
    "segment_detail": f"""WITH {HIERARCHY}, {_children("families", "family_code", "segment_code")}
SELECT segment_code, description, position, coalesce(n, 0) AS n_families, family_code, child_description
FROM segments LEFT JOIN kids USING (segment_code)""",
    "family_detail": f"""WITH {HIERARCHY}, {_children("classes", "class_code", "family_code")}
SELECT f.family_code, f.description, f.segment_code, s.description AS segment_description,
  concat_ws(' > ', nullif(s.description, ''), nullif(f.description, '')) AS full_path,
  position, coalesce(n, 0) AS n_classes, class_code, child_description
FROM families f LEFT JOIN segments s USING (segment_code) LEFT JOIN kids USING (family_code)""",
    "class_detail": f"""WITH {PATHS}, {_children("bricks", "brick_code", "class_code")}
SELECT c.*, position, coalesce(n, 0) AS n_bricks, brick_code, child_description
FROM class_path c LEFT JOIN kids USING (class_code)""",
    "brick_attributes": f"""WITH {PATHS},
n_values AS (SELECT att_type_code, count(*) AS n FROM attribute_type_values JOIN attribute_values USING (att_value_code)
  GROUP BY att_type_code),
kids AS (SELECT brick_code, att_type_code, att_type_text, coalesce(n, 0) AS n_values,
    row_number() OVER (PARTITION BY brick_code ORDER BY att_type_code) AS position,
    count(*) OVER (PARTITION BY brick_code) AS n_types
  FROM brick_attribute_types JOIN attribute_types USING (att_type_code) LEFT JOIN n_values USING (att_type_code))
SELECT p.*, position, coalesce(n_types, 0) AS n_types, att_type_code, att_type_text, n_values
FROM brick_path p LEFT JOIN kids USING (brick_code)""",
    "type_values": f"""WITH {HIERARCHY}
SELECT att_type_code, att_value_code, att_value_text,
  row_number() OVER (PARTITION BY att_type_code ORDER BY att_value_code) AS position,
  count(*) OVER (PARTITION BY att_type_code) AS n_values
FROM attribute_type_values JOIN attribute_values USING (att_value_code)""",
    "brick_detail": f"""WITH {PATHS},
wanted AS (SELECT min(class_code) AS class_code FROM classes GROUP BY family_code),
value_lists AS (SELECT att_type_code,
    string_agg(att_value_code || '=' || coalesce(att_value_text, ''), ',' ORDER BY att_value_code) AS vals
  FROM attribute_type_values JOIN attribute_values USING (att_value_code) GROUP BY att_type_code),
lists AS (SELECT brick_code, count(*) AS n_types,
    string_agg(att_type_code || '=' || att_type_text || '(' || coalesce(vals, '') || ')', ';' ORDER BY att_type_code)
      AS attributes
  FROM brick_attribute_types JOIN attribute_types USING (att_type_code) LEFT JOIN value_lists USING (att_type_code)
  GROUP BY brick_code)
SELECT p.*, coalesce(n_types, 0) AS n_types, coalesce(attributes, '') AS attributes
FROM brick_path p LEFT JOIN lists USING (brick_code) WHERE class_code IN (SELECT class_code FROM wanted)""",
    "lookup_segments": f"""WITH {HIERARCHY}, {_list("families", "family_code", "segment_code")}
SELECT segment_code, description, coalesce(items, '') AS families FROM segments LEFT JOIN lists USING (segment_code)
WHERE segment_code IN (SELECT cast(o_custkey AS varchar) FROM orders)""",
    "lookup_families": f"""WITH {HIERARCHY}, {_list("classes", "class_code", "family_code")}
SELECT f.family_code, concat_ws(' > ', nullif(s.description, ''), nullif(f.description, '')) AS full_path,
  coalesce(items, '') AS classes
FROM families f LEFT JOIN segments s USING (segment_code) LEFT JOIN lists USING (family_code)
WHERE f.family_code IN (SELECT cast(l_suppkey AS varchar) FROM lineitem)""",
    "lookup_classes": f"""WITH {PATHS}, {_list("bricks", "brick_code", "class_code")}
SELECT class_code, full_path, coalesce(items, '') AS bricks FROM class_path LEFT JOIN lists USING (class_code)
WHERE class_code IN (SELECT cast(p_partkey AS varchar) FROM part)""",
    "lookup_bricks": f"""WITH {PATHS} SELECT brick_code, class_code, full_path FROM brick_path
WHERE brick_code IN (SELECT cast(c_custkey AS varchar) FROM customer)""",
    "missing_codes": f"""WITH {HIERARCHY} SELECT DISTINCT att_type_code AS class_code FROM brick_attribute_types b
WHERE NOT EXISTS (SELECT 1 FROM classes c WHERE c.class_code = b.att_type_code)""",
    "search_all": f"WITH {HIERARCHY} "
    + " UNION ALL ".join(_search(t, c, "%17%") for t, c in _LEVELS.items()),
    "search_category": f"WITH {HIERARCHY} " + _search("bricks", "brick_code", "%Low%"),
    "dedup_first_wins": """SELECT l_partkey, l_orderkey, l_suppkey, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn
  FROM lineitem) WHERE rn = 1""",
    "ingest_segment_filter": f"""WITH {VISITS},
kept_chain AS (SELECT * FROM chain WHERE segment_code IN ('1', '3', '7')),
kept_lines AS (SELECT lines.*, brick_code FROM lines JOIN kept_chain USING (brick_code))
SELECT 'segments' AS table_name, cast(NULL AS varchar) AS parent_code, count(*) AS visits FROM segment_visits
  WHERE segment_code IN ('1', '3', '7')
UNION ALL SELECT 'families', segment_code, count(*) FROM family_visits WHERE segment_code IN ('1', '3', '7') GROUP BY 2
UNION ALL SELECT 'classes', family_code, count(*) FROM class_visits WHERE family_code IN (
  SELECT family_code FROM families WHERE segment_code IN ('1', '3', '7')) GROUP BY 2
UNION ALL SELECT 'bricks', class_code, count(*) FROM kept_chain GROUP BY 2
UNION ALL SELECT 'attribute_types', brick_code, count(*) FROM kept_lines GROUP BY 2
UNION ALL SELECT 'attribute_values', att_type_code, 2 * count(*) FROM kept_lines GROUP BY 2""",
    "ingest_flatten_hierarchy": f"""WITH {VISITS}, counts AS (
  SELECT 'segments' AS table_name, segment_code AS c1, count(*) AS visits FROM segment_visits GROUP BY ALL
  UNION ALL SELECT 'families', family_code, count(*) FROM family_visits GROUP BY ALL
  UNION ALL SELECT 'classes', class_code, count(*) FROM class_visits GROUP BY ALL
  UNION ALL SELECT 'bricks', brick_code, count(*) FROM chain GROUP BY ALL)
SELECT table_name, c1 AS code, c2 AS text, c3 AS parent_code, visits FROM ({_HIERARCHY_ROWS}) JOIN counts USING (table_name, c1)""",
    "ingest_flatten_attributes": f"WITH {VISITS} "
    + _FIRST_TEXT.format(
        table="attribute_types", code="att_type_code", text="'Part ' || att_type_code || ' ' || l_returnflag", times=1
    )
    + " UNION ALL "
    + _FIRST_TEXT.format(
        table="attribute_values", code="att_value_code", text="'Supplier ' || att_value_code || ' ' || l_linestatus", times=2
    ),
    "ingest_junctions": f"""WITH {VISITS}
SELECT 'attribute_types' AS table_name, brick_code AS parent_code, att_type_code AS code, count(*) AS visits
FROM lines GROUP BY ALL
UNION ALL SELECT 'attribute_values', att_type_code, att_value_code, 2 * count(*) FROM lines GROUP BY ALL""",
    "ingest_first_sound": f"""WITH {VISITS}
SELECT family_code AS code, CASE WHEN count(*) > 1 THEN any_value(segment_code) END AS parent_code,
  any_value(description) AS text, count(*) AS visits, 1 AS unsound
FROM family_visits JOIN (SELECT family_code, description FROM families) USING (family_code) GROUP BY family_code""",
    "ingest_counts": f"""WITH {VISITS}, {_COUNTS}
SELECT * FROM counts""",
    "ingest_roundtrip": f"""WITH {VISITS}, {_COUNTS} {_HIERARCHY_ROWS}
UNION ALL SELECT 'import_counts', table_name, cast(occurrences AS varchar), cast(unique_rows AS varchar) FROM counts
UNION ALL SELECT 'gpc_metadata', key, value, NULL FROM (VALUES ('xml_date', '11/27/2025'),
  ('xml_source', 'en-v20251127.xml'), ('food_segments', 'all'), ('gpc_version', '20251127')) AS m(key, value)
UNION ALL SELECT 'attribute_types', att_type_code, 'Part ' || att_type_code, NULL FROM brick_attribute_types GROUP BY ALL
UNION ALL SELECT 'attribute_values', att_value_code, 'Supplier ' || att_value_code, NULL FROM attribute_type_values GROUP BY ALL
UNION ALL {_JUNCTION_ROWS}""",
    "integrity_orphans": _ORPHANS,
    "version_from_path": f"WITH {VERSIONS} SELECT o_orderkey, stem, version FROM versions",
    "version_gate": """WITH d AS (SELECT o_orderkey,
  CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'unknown' WHEN '5-LOW' THEN ''
    ELSE 'v' || strftime(o_orderdate, '%Y%m%d') END AS stored,
  CASE o_orderstatus WHEN 'F' THEN 'vv' || (19990000 + o_custkey) WHEN 'O' THEN '19980101'
    WHEN 'P' THEN CASE WHEN o_custkey < 50 THEN '' END END AS candidate,
  CASE WHEN o_totalprice < 100000 THEN TIMESTAMP '2024-01-30 11:59:59.5'
       WHEN o_totalprice < 150000 THEN TIMESTAMP '2024-01-31 00:00:00' END AS last_check FROM orders),
v AS (SELECT o_orderkey, ltrim(stored, 'v') AS stored, ltrim(candidate, 'v') AS candidate,
  CASE WHEN coalesce(stored, '') = '' THEN 'build' WHEN coalesce(candidate, '') = '' THEN 'keep'
       WHEN ltrim(candidate, 'v') <= ltrim(stored, 'v') THEN 'current' ELSE 'refresh' END AS version_status,
  last_check FROM d)
SELECT o_orderkey, stored, candidate, version_status,
  CASE WHEN version_status = 'build' THEN 'build'
       WHEN epoch(TIMESTAMP '2024-01-31 12:00:00') - epoch(last_check) < 86400 THEN 'recent'
       ELSE version_status END AS status FROM v""",
    "staleness": f"""WITH e AS (SELECT event_id,
  CASE event_type WHEN 'click' THEN {_EPOCH}
    WHEN 'purchase' THEN epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(date_trunc('second', ts)) END AS us
  FROM events)
SELECT event_id, cast(floor(us / 60000000) AS bigint) AS elapsed_minutes, coalesce(us >= 86400000000, true) AS stale FROM e""",
    "metadata_upsert": """SELECT event_type || '/' || user_id AS key, 'v' || max(event_id) AS value
FROM events GROUP BY 1""",
    "metadata_replace": """SELECT event_type || '/' || user_id AS key,
  coalesce('v' || max(CASE WHEN event_id % 3 = 0 THEN event_id END), max('v' || event_id)) AS value
FROM events GROUP BY 1""",
    "metadata_lookup": """SELECT 'v' || max(event_id) AS value FROM events
WHERE event_type = 'signup' AND user_id = 1 HAVING count(*) > 0""",
    "catalog_summary": f"""WITH {VERSIONS}, last AS (SELECT * FROM versions ORDER BY o_orderkey DESC LIMIT 1)
SELECT (SELECT count(*) FROM supplier) AS segments, version, coalesce(xml_date, 'unknown') AS xml_date,
  cast(NULL AS varchar) AS import_timestamp FROM last""",
    "tag_label": f"""WITH {OFF_RAW}, tags AS (SELECT code, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos
  FROM off_raw)
SELECT code, pos, {_label("tag")} AS label, {_fallback("tag")} AS fallback FROM tags""",
    "title_case": f"SELECT doc_id, md5({_title('text')}) AS digest FROM documents",
    "off_nutrients": f"""WITH {OFF_RAW} SELECT code, calories_kcal, protein_g, fat_g, carbohydrates_g, fiber_g, sugars_g,
  sodium_g, salt_g, len(list_filter([calories_kcal, protein_g, fat_g, carbohydrates_g, fiber_g, sugars_g, sodium_g,
  salt_g], lambda x: x IS NOT NULL)) AS n_known FROM off_shaped""",
    "off_product": f"""WITH {OFF_RAW} SELECT code AS barcode, product_name, brands, image_url, ingredients_text, quantity,
  serving_size, array_to_string(tags, ',') AS categories, allergens, labels,
  concat_ws(',', CASE WHEN calories_kcal IS NOT NULL THEN 'calories_kcal' END, CASE WHEN fat_g IS NOT NULL THEN 'fat_g' END,
    CASE WHEN fiber_g IS NOT NULL THEN 'fiber_g' END, CASE WHEN protein_g IS NOT NULL THEN 'protein_g' END,
    CASE WHEN salt_g IS NOT NULL THEN 'salt_g' END) AS nutrients
FROM off_shaped WHERE nullif(product_name, '') IS NOT NULL AND code IN (
  SELECT cast(l_suppkey AS varchar) FROM lineitem UNION SELECT cast(o_orderkey AS varchar) FROM orders)""",
    "off_search": f"""WITH {OFF_RAW}, hits AS (SELECT * FROM off_shaped WHERE product_name ILIKE '%RING%' OR brands ILIKE '%RING%')
SELECT code AS barcode, product_name, brands, (SELECT count(*) FROM hits) AS total,
  3 + (fat_g IS NOT NULL)::int + (fiber_g IS NOT NULL)::int AS n_nutrients FROM hits ORDER BY code LIMIT 25""",
    "usda_search": f"""WITH {FDC_RAW}, hits AS (SELECT fdc_id, description, data_type, brand_owner, brand_name FROM foods
  WHERE description ILIKE '%owner 1_3%' OR brand_owner ILIKE '%owner 1_3%' OR brand_name ILIKE '%owner 1_3%')
SELECT *, (SELECT count(*) FROM hits) AS total_hits FROM hits ORDER BY fdc_id LIMIT 200""",
    "usda_food": f"""WITH {FDC_RAW}, {NUTRIENT_ROWS},
names AS (SELECT fdc_id, string_agg(name, ',' ORDER BY name) AS names,
  max(CASE WHEN name = 'Energy' THEN unit_name END) AS energy_unit FROM nutrient_rows GROUP BY fdc_id)
SELECT f.* EXCLUDE (gtin), coalesce(names, '') AS names, energy_unit, w.* EXCLUDE (fdc_id)
FROM foods f LEFT JOIN names USING (fdc_id) LEFT JOIN wide w USING (fdc_id)""",
    "usda_nutrients": f"WITH {NUTRIENT_ROWS} SELECT * FROM nutrient_rows",
    "usda_by_upc": f"""WITH {FDC_RAW} SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY gtin ORDER BY fdc_id) AS rn FROM foods
  WHERE data_type = 'Branded' AND gtin IN (SELECT cast(p_partkey AS varchar) FROM part)) WHERE rn = 1""",
    "category_map": f"WITH {CATEGORIES} SELECT code AS barcode, brick_code, matched_label, path FROM mapped",
    "category_fallback": f"""WITH {CATEGORIES.replace("{sep}", "|")}
SELECT code AS barcode, coalesce(n, 0) AS n_labels, coalesce(labels, '') AS labels
FROM (SELECT code FROM off_raw) LEFT JOIN fallback USING (code) WHERE code NOT IN (SELECT code FROM mapped)""",
    "reconcile": f"""WITH {CATALOGUE} SELECT gtin, {_PRODUCT} FROM canonical
WHERE gtin IN (SELECT cast(o_orderkey AS varchar) FROM orders)""",
    "reconcile_nutrients": f"""WITH {CATALOGUE} SELECT gtin, calories_kcal, COLUMNS('.*_(value|unit)$') FROM canonical""",
    "stream_enrich": f"""WITH {CATALOGUE} SELECT event_id, gtin, {_PRODUCT}
FROM events JOIN canonical ON gtin = cast(user_id AS varchar)""",
}
# The same results through stored indexes.
ORACLES |= {f"{name}_indexed": ORACLES[name] for name in ("search_all", "off_search", "usda_search")}
