"""Tables that stand in for sources: the registry, rows and cells that the queries start from.

Each is given twice, as a DataFrame and as SQL of the same rows. Values are
sums of whole cents and counts, so both engines hold the same floats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import COLON_VENDORS, ENTITIES, ORGANISATIONS, SUFFIXES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micro_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6"


# Measures of suppliers and parts, missing where their condition finds no line.
MEASURES = {
    "m_price": "sum(cents) / (100.0 * count(*))",
    "m_quantity": "sum(quantity) / count(*)",
    "m_discount": "sum(discount) / (1.0 * count(*))",
    "m_returned": "sum(CASE WHEN flag = 'R' AND quantity >= 40 THEN cents END) / (100.0 * nullif(count(CASE WHEN flag = 'R' AND quantity >= 40 THEN 1 END), 0))",
    "m_bulk": "nullif(count(CASE WHEN quantity >= 48 AND flag = 'A' THEN 1 END), 0) * 1.0",
    "m_open": "100.0 * count(CASE WHEN status = 'O' THEN 1 END) / count(*)",
}


def measures(spark: SparkSession, sf_dir: str, key: str, mark: str) -> DataFrame:
    """(entity, one column for each measure) by a key of lineitem."""
    line = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(mark), F.lpad(F.col(key).cast("string"), 7, "0")).alias("entity"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        "l_quantity", F.round(F.col("l_discount") * 100).cast("long").alias("discount"), "l_returnflag", "l_linestatus",
    )
    n = F.count("*")
    returned = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40)
    return line.groupBy("entity").agg(
        (F.sum("cents").cast("double") / (F.lit(100.0) * n)).alias("m_price"),
        (F.sum("l_quantity") / n).alias("m_quantity"),
        (F.sum("discount").cast("double") / (F.lit(1.0) * n)).alias("m_discount"),
        (F.sum(F.when(returned, F.col("cents"))).cast("double") / (F.lit(100.0) * F.nullif(F.count_if(returned), F.lit(0)))).alias("m_returned"),
        (F.nullif(F.count_if((F.col("l_quantity") >= 48) & (F.col("l_returnflag") == "A")), F.lit(0)) * F.lit(1.0)).alias("m_bulk"),
        (F.lit(100.0) * F.count_if(F.col("l_linestatus") == "O") / n).alias("m_open"),
    )


def measures_sql(key: str, mark: str, name: str = "w") -> str:
    columns = ", ".join(f"({x})::DOUBLE AS {m}" for m, x in MEASURES.items())
    return f"""{name} AS (
        SELECT '{mark}' || lpad(CAST(k AS VARCHAR), 7, '0') AS entity, {columns}
        FROM (SELECT {key} AS k, round(l_extendedprice * 100)::BIGINT AS cents, l_quantity AS quantity, round(l_discount * 100)::BIGINT AS discount, l_returnflag AS flag, l_linestatus AS status FROM lineitem)
        GROUP BY k)"""


def percent(df: DataFrame) -> DataFrame:
    """Measures on a scale of 0 to 100, missing ones kept, for queries that need scores and no population."""
    return df.select(
        "entity",
        (F.col("m_quantity") * 2).alias("a"),
        F.when(F.col("m_discount") < 5.2, F.col("m_discount") * 10).alias("b"),
        F.when(F.col("m_returned").isNotNull(), F.lit(80.0) - F.col("m_open") / 2).alias("c"),
        F.when(F.col("m_bulk").isNotNull(), F.least(F.col("m_bulk") * 25, F.lit(100.0))).alias("d"),
    )


PERCENT_SQL = """p AS (
        SELECT entity, m_quantity * 2 AS a, CASE WHEN m_discount < 5.2e0 THEN m_discount * 10 END AS b,
               CASE WHEN m_returned IS NOT NULL THEN 80.0e0 - m_open / 2 END AS c,
               CASE WHEN m_bulk IS NOT NULL THEN least(m_bulk * 25, 100.0e0) END AS d
        FROM w)"""


def average_sql(weights: dict[str, float], threshold: float = 0.70, width: float = 0.20) -> tuple[str, str, str]:
    """(value, shrunk, present weight) of a missing-safe average, as SQL."""
    keys = sorted(weights)
    whole = " + ".join(f"{weights[k]}e0" for k in keys)
    present = " + ".join(f"CASE WHEN {k} IS NOT NULL THEN {weights[k]}e0 ELSE 0.0e0 END" for k in keys)
    summed = " + ".join(f"coalesce({weights[k]}e0 * {k}, 0.0e0)" for k in keys)
    c = f"(({present}) / ({whole}))"
    m = f"(({summed}) / nullif({present}, 0))"
    t = f"least(greatest(({c} - {threshold - width / 2}e0) / {width}e0, 0.0e0), 1.0e0)"
    u = f"({t} * {t} * (3.0e0 - 2.0e0 * {t}))"
    s = f"({m} * {c} + 50.0e0 * (1.0e0 - {c}))"
    value = f"CASE WHEN ({present}) = 0 THEN 50.0e0 ELSE least(greatest({s} * (1.0e0 - {u}) + {m} * {u}, 0.0e0), 100.0e0) END"
    return value, f"(({present}) = 0 OR {c} < {min(max(threshold + width / 2, 0), 1)}e0)", present


def parts_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and part names as vendors and entities, in the order of their names."""
    p = table(spark, sf_dir, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("vendor"), "p_name").distinct()
    e = p.withColumn("display", F.replace("p_name", F.lit(" "), F.lit("-"))).withColumn("entity", F.concat_ws("/", "vendor", "display"))
    return e.select("entity", "vendor", "display", F.array(F.concat_ws(" ", "vendor", "p_name")).alias("aliases"), F.col("entity").alias("ord"))


REGISTRY_SQL = """g AS (
        SELECT vendor || '/' || replace(p_name, ' ', '-') AS entity, vendor, replace(p_name, ' ', '-') AS display, vendor || ' ' || p_name AS alias,
               row_number() OVER (ORDER BY vendor || '/' || replace(p_name, ' ', '-')) AS ord
        FROM (SELECT DISTINCT lower(replace(p_brand, '#', '')) AS vendor, p_name FROM part))"""

#: How the names of rows differ from the registry, by type of part.
SPELLINGS = {
    "ECONOMY": "{name} (High)",
    "PROMO": "{name}-Preview",
    "MEDIUM": "{name} medium thinking",
    "STANDARD": "The {name}s of old",
    "LARGE": "odd {key}",
}


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three sources that name parts in their own ways: (source_id, seq, model_name, vendor_hint, fields, synthesized_from)."""
    p = table(spark, sf_dir, "part")
    name = F.upper("p_name")
    for kind, pattern in SPELLINGS.items():
        before, _, after = pattern.replace("{key}", "{name}").partition("{name}")
        what = (F.col("p_partkey") % 50).cast("string") if "{key}" in pattern else F.col("p_name")
        name = F.when(F.col("p_type") == kind, F.concat(F.lit(before), what, F.lit(after))).otherwise(name)
    hint = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_brand", F.lit("#"), F.lit(""))).when(F.col("p_partkey") % 5 == 0, "")
    return p.select(
        F.element_at(F.array(*map(F.lit, ("alpha", "mid", "zeta"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("source_id"),
        F.col("p_partkey").alias("seq"),
        name.alias("model_name"),
        hint.alias("vendor_hint"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.col("p_retailprice").cast("string"), F.lit("kind"), F.col("p_type")).alias("fields"),
        F.lit(None).cast("string").alias("synthesized_from"),
    )


def part_rows_sql() -> str:
    cases = "".join(f" WHEN '{k}' THEN " + " || ".join(("p_name" if "{name}" in v else "CAST(p_partkey % 50 AS VARCHAR)") if x == "@" else f"'{x}'" for x in v.replace("{name}", "|@|").replace("{key}", "|@|").split("|") if x) for k, v in SPELLINGS.items())
    return f"""r AS (
        SELECT ['alpha', 'mid', 'zeta'][p_partkey % 3 + 1] AS source_id, p_partkey AS seq, CASE p_type{cases} ELSE upper(p_name) END AS model_name,
               CASE WHEN p_partkey % 2 = 0 THEN replace(p_brand, '#', '') WHEN p_partkey % 5 = 0 THEN '' END AS vendor_hint,
               p_size, p_retailprice, p_type
        FROM part)"""


def unescape_sql(x: str) -> str:
    """html_unescape() in DuckDB."""
    names = "".join(f" WHEN starts_with(p, '{n};') THEN '{c.replace(chr(39), chr(39) * 2)}' || p[{len(n) + 2}:]" for n, c in (("amp", "&"), *ENTITIES))
    rest = "substr(p, strpos(p, ';') + 1)"
    valid = "({0} < 55296 OR {0} BETWEEN 57344 AND 1114111)"
    decimal, hexed = "TRY_CAST(regexp_extract(p, '^#[+]?0*([0-9]+);', 1) AS INT)", "TRY_CAST('0x' || regexp_extract(p, '^#[xX][+]?0*([0-9a-fA-F]+);', 1) AS INT)"
    numbered = "".join(f" WHEN {valid.format(n)} THEN chr({n}) || {rest}" for n in (decimal, hexed))
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p{names}{numbered} ELSE '&' || p END), '')"


def normal_sql(x: str) -> str:
    """normalize_name() in DuckDB, whose regular expressions can't look around."""
    for name, char in ENTITIES:
        x = f"replace({x}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    x = f"trim(lower(replace({x}, '&amp;', '&')))"
    for v in COLON_VENDORS:
        x = f"replace({x}, '{v}:', '{v} ')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([0-9])[.]([0-9])', '\\1' || chr(1) || '\\2', 'g')"
    x = f"replace(replace({x}, '.', ' '), chr(1), '.')"
    x = f"trim(regexp_replace({x}, '[^a-z0-9.]+', ' ', 'g'))"
    for spelling, short in ORGANISATIONS:
        x = f"replace({x}, '{spelling}', '{short}')"
    return x


def compact_sql(normal: str) -> str:
    return f"regexp_replace({normal}, '[^a-z0-9]', '', 'g')"


def strip_sql(normal: str) -> str:
    """The name without one ending, NULL if it has none."""
    ending = "|".join(sorted(SUFFIXES, key=len, reverse=True))
    listed = ", ".join(f"'{s}'" for s in SUFFIXES)
    return f"CASE WHEN {normal} NOT IN ({listed}) THEN nullif(regexp_extract({normal}, '^(.+?) (?:{ending})$', 1), '') END"


def effort_sql(normal: str) -> str:
    from plumbline.operators.effort import DECIDES

    out = "".join(" WHEN " + " OR ".join(f"contains(' ' || {normal} || ' ', ' {p} ')" for p in phrases) + f" THEN '{name}'" for name, phrases in DECIDES)
    return f"CASE{out} ELSE 'default' END"


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of sources A, N and R for parts, with effort markers of orders' priorities; R plays the hand-set source."""
    # dealt by order, which serves the grouping and the join alike
    line = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_quantity").alias("qty"), F.max("l_discount").alias("disc"))
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    x = line.join(order, "l_orderkey")
    part = F.concat(F.lit("p"), F.lpad(F.col("pk").cast("string"), 7, "0"))
    fields = F.map_filter(F.create_map(F.lit("qty"), F.col("qty").cast("string"), F.lit("disc"), F.when(F.col("qty") > 25, F.col("disc").cast("string")), F.lit("note"), F.col("o_orderpriority")), lambda _, v: v.isNotNull())
    return x.select(
        F.col("l_returnflag").alias("source_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        part.alias("model_name"),
        F.lit(None).cast("string").alias("vendor_hint"),
        fields.alias("fields"),
        F.lit(None).cast("string").alias("synthesized_from"),
        F.when(F.col("pk") % 7 != 0, part).alias("entity"),
    )


def line_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    return table(spark, sf_dir, "part").select(part.alias("entity"), F.col("p_partkey").cast("int").alias("ord"), F.lower("p_brand").alias("vendor"), F.upper(part).alias("display"), F.array().cast("array<string>").alias("aliases"))


LINE_SQL = """l AS (
        SELECT l_returnflag AS source_id, l_orderkey * 8 + l_linenumber AS seq, pk, qty, CASE WHEN qty > 25 THEN disc END AS disc, o_orderpriority AS note,
               CASE WHEN pk % 7 <> 0 THEN 'p' || lpad(CAST(pk AS VARCHAR), 7, '0') END AS entity,
               CASE o_orderpriority WHEN '2-HIGH' THEN 5 WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 4 ELSE 0 END AS effort
        FROM (SELECT l_returnflag, l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_quantity) AS qty, max(l_discount) AS disc FROM lineitem GROUP BY ALL)
        JOIN orders ON l_orderkey = o_orderkey)"""


def brand_pairs(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    """Part k borrows from part k - step if both bear one brand; pairs are declared in the order of k."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    code = lambda c: F.concat(F.lit("p"), F.lpad(c.cast("string"), 7, "0"))
    q = p.select((F.col("p_partkey") + step).alias("p_partkey"), F.col("p_brand").alias("b"))
    return p.join(q, "p_partkey").filter(F.col("p_brand") == F.col("b")).select(F.col("p_partkey").alias("pair_idx"), code(F.col("p_partkey")).alias("target"), code(F.col("p_partkey") - step).alias("donor"))


PAIRS_SQL = """q AS (
        SELECT a.p_partkey AS pair_idx, 'p' || lpad(CAST(a.p_partkey AS VARCHAR), 7, '0') AS target, 'p' || lpad(CAST(b.p_partkey AS VARCHAR), 7, '0') AS donor
        FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1 AND a.p_brand = b.p_brand)"""
