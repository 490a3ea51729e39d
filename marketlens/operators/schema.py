"""Schema and contract operators. Column lists are driver metadata; value overlaps are Spark jobs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions.scalar import ratio


class MissingColumns(ValueError):
    """A required column is absent; no substitute is ever invented."""


class ColumnCollision(ValueError):
    """Two columns would end under one name, or one column under two."""


def require_columns(df: DataFrame, columns: Sequence[str], context: str = "dataset") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{context}: missing column(s) {missing}")
    return df


def resolve_mapping(df: DataFrame, pairs: Sequence[tuple[str, str]], required: Sequence[str] = ()) -> DataFrame:
    """Renames and keeps the mapped columns; ambiguous mappings and missing required sources are errors."""
    present: dict[str, str] = {}
    for source, target in pairs:
        if not source:
            continue
        if source not in df.columns:
            if source in required:
                raise MissingColumns(f"required column {source} is absent")
            continue
        if present.get(source, target) != target:
            raise ColumnCollision(f"{source} has two targets: {present[source]} and {target}")
        if any(t == target and s != source for s, t in present.items()):
            raise ColumnCollision(f"{target} has two sources")
        present[source] = target
    missing = [c for c in required if c not in present]
    if missing:
        raise MissingColumns(f"required column(s) {missing} are not mapped")
    return df.select(*present).withColumnsRenamed(present)


def type_family(type_name: str) -> str:
    """Canonical name of a type, so that aliases compare equal."""
    name = type_name.lower()
    for family, aliases in {
        "integer": ("int", "integer", "bigint", "smallint", "tinyint", "long", "int64", "int32", "int4", "int8"),
        "numeric": ("double", "float", "numeric", "decimal", "real", "double precision", "float64"),
        "text": ("string", "text", "varchar", "char", "character varying", "object"),
        "boolean": ("bool", "boolean"),
        "timestamptz": ("timestamp", "timestamptz", "timestamp with time zone", "timestamp_ltz"),
        "date": ("date",),
    }.items():
        if name.split("(")[0] in aliases:
            return family
    return name


def column_inventory(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per table and column: type, nullability, key membership."""
    rows = [(name, f.name, f.dataType.simpleString(), type_family(f.dataType.simpleString()), f.nullable,
             f.name in (keys or {}).get(name, ())) for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, family string, nullable boolean, is_key boolean")


def inspect_schema(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Inventory plus the number of rows of each table and one sample value per column."""
    stats = None
    for name, df in tables.items():
        part = (df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.min(F.col(c).cast("string")).alias(c) for c in df.columns])
                .unpivot("n_rows", [F.col(c) for c in df.columns], "column_name", "sample_value")
                .withColumn("table_name", F.lit(name)))
        stats = part if stats is None else stats.unionByName(part)
    return stats.join(F.broadcast(column_inventory(spark, tables, keys)), ["table_name", "column_name"])


def role_scores(inventory: DataFrame, roles: DataFrame) -> DataFrame:
    """Best role of each column: pattern weight, +10 for the wished type, -40 / -20 for a wrong one.

    `roles`: role, pattern, weight, wished (numeric, date, text or NULL).
    """
    numeric = F.col("family").isin("integer", "numeric")
    date = F.col("family").isin("date", "timestamptz")
    score = (F.col("weight")
             + F.when((F.col("wished") == "numeric") & numeric, 10).when((F.col("wished") == "date") & date, 10).otherwise(0)
             - F.when((F.col("wished") == "numeric") & ~numeric, 40).otherwise(0)
             - F.when((F.col("wished") != "date") & date, 20).otherwise(0))
    matched = (inventory.join(F.broadcast(roles), F.expr("lower(column_name) rlike pattern"))
               .withColumn("score", score).filter("score > 0"))
    best = Window.partitionBy("table_name", "role").orderBy(F.desc("score"), "column_name")
    return (matched.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1")
            .select("table_name", "role", "column_name", "score"))


def long_values(df: DataFrame, columns: Sequence[str], name: str = "attribute", value: str = "value") -> DataFrame:
    """Distinct non-null (column, value) pairs, values as text."""
    return (df.select([F.col(c).cast("string").alias(c) for c in columns])
            .unpivot([], [F.col(c) for c in columns], name, value)
            .filter(F.col(value).isNotNull()).distinct())


def best_join_column(fact: DataFrame, fact_key: str, dim: DataFrame, candidates: Sequence[str] | None = None,
                     min_overlap: float = 0.9) -> DataFrame:
    """Dimension column covering the distinct fact keys best (ties by name); no row under the threshold."""
    columns = list(candidates or dim.columns)
    keys = fact.select(F.col(fact_key).cast("string").alias("value")).filter("value is not null").distinct()
    total = keys.agg(F.count(F.lit(1))).scalar()
    hits = (long_values(dim, columns).join(keys, "value", "left_semi")
            .groupBy("attribute").agg(F.count(F.lit(1)).alias("n_hits")))
    rate = hits.withColumn("overlap", ratio(F.col("n_hits"), total)).filter(F.col("overlap") >= min_overlap)
    return rate.orderBy(F.desc("overlap"), "attribute").limit(1).select("attribute", "n_hits", "overlap")


def resolve_scopes(promotions: DataFrame, products: DataFrame, attributes: Sequence[str], min_overlap: float = 0.5,
                   scope: str = "portee", target: str = "cible") -> DataFrame:
    """For each promotion scope the product attribute covering its own targets best.

    Scopes that name a single product only accept an attribute that is unique in the dimension.
    """
    single = F.lower(scope).isin("product", "produit", "sku", "article")
    targets = promotions.select(F.col(scope).alias("scope"), single.alias("_single"), F.col(target).cast("string").alias("value")) \
        .filter("scope is not null and value is not null").distinct()
    sizes = targets.groupBy("scope").agg(F.count(F.lit(1)).alias("n_targets"))
    unique = (products.agg(*[(F.count(c) == F.count_distinct(c)).cast("int").alias(c) for c in attributes])
              .unpivot([], [F.col(c) for c in attributes], "attribute", "is_unique"))
    hits = (long_values(products, attributes).join(targets, "value")
            .groupBy("scope", "_single", "attribute").agg(F.count(F.lit(1)).alias("n_hits")))
    rated = (hits.join(unique, "attribute").join(sizes, "scope")
             .filter(~F.col("_single") | (F.col("is_unique") == 1))
             .withColumn("overlap", ratio("n_hits", "n_targets")).filter(F.col("overlap") >= min_overlap))
    best = Window.partitionBy("scope").orderBy(F.desc("overlap"), "attribute")
    return (rated.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1")
            .select("scope", "attribute", "n_targets", "overlap"))


def infer_relations(inventory: DataFrame) -> DataFrame:
    """Presumed foreign keys: a column named like the single key of another table."""
    single = (inventory.filter("is_key").groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.min("column_name").alias("column_name"))
              .filter("n = 1").select(F.col("table_name").alias("target_table"), "column_name"))
    return (inventory.join(single, "column_name").filter("table_name <> target_table")
            .select("table_name", "column_name", "target_table"))


def compare_schemas(before: DataFrame, after: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Changes between two inventories; a declared rename is one change, not a drop and an add.

    `renames` maps 'table.old' to the new column name.
    """
    renames = renames or {}
    full = F.concat_ws(".", "table_name", "column_name")
    new_name = F.col("column_name")
    for old, new in renames.items():
        new_name = F.when(full == old, F.lit(new)).otherwise(new_name)
    b = before.select("table_name", new_name.alias("column_name"), F.col("column_name").alias("old_name"),
                      F.col("family").alias("b_family"), F.col("nullable").alias("b_null"), F.col("is_key").alias("b_key"))
    a = after.select("table_name", "column_name", F.col("family").alias("a_family"), F.col("nullable").alias("a_null"),
                     F.col("is_key").alias("a_key"))
    both = b.join(a, ["table_name", "column_name"], "full_outer")
    kinds = F.filter(F.array(
        F.when(F.col("b_family").isNull(), "added"), F.when(F.col("a_family").isNull(), "dropped"),
        F.when(F.col("a_family").isNotNull() & (F.col("old_name") != F.col("column_name")), "renamed"),
        F.when(F.col("a_family") != F.col("b_family"), "type_changed"),
        F.when(F.col("a_null") != F.col("b_null"), "nullability_changed"),
        F.when(F.col("a_key") != F.col("b_key"), "key_changed")), lambda k: k.isNotNull())
    return both.select("table_name", "column_name", F.explode(kinds).alias("change"))


def grain_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables whose declared grain text differs (`table_name`, `grain`)."""
    return (before.withColumnRenamed("grain", "b").join(after.withColumnRenamed("grain", "a"), "table_name")
            .filter("a <> b").select("table_name", F.lit("*").alias("column_name"), F.lit("grain_changed").alias("change")))


def blocking_changes(changes: DataFrame) -> DataFrame:
    """Changes after which old and new results may not be compared."""
    return changes.filter(F.col("change").isin("grain_changed", "key_changed", "dropped", "renamed"))


def detect_validity_start(df: DataFrame, names: Sequence[str] = ("valid_from", "validity_start", "date_debut_validite",
                                                                 "start_date", "effective_from", "launch_date")) -> str | None:
    """First column with a validity-start name and a date type."""
    for f in df.schema.fields:
        if f.name.lower() in names and f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
            return f.name
    return None


def infer_frequency(df: DataFrame, day: str = "ds") -> DataFrame:
    """Modal gap between distinct days and the frequency it stands for.

    Days are distinct values of a calendar, so the ordered window sees a calendar, not the rows.
    """
    days = df.select(day).distinct()
    gaps = days.select(F.datediff(day, F.lag(day).over(Window.orderBy(day))).alias("gap")).filter("gap is not null")
    stats = gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    one = stats.agg(F.min_by("gap", F.struct(-F.col("n"), "gap")).alias("modal_gap"),
                    (F.sum(F.when(F.col("gap") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("daily_share"))
    return one.withColumn("frequency", F.when((F.col("modal_gap") == 1) & (F.col("daily_share") > 0.8), "D")
                          .when(F.col("modal_gap") == 7, "W").when(F.col("modal_gap").between(28, 31), "MS").otherwise("irregular"))


# fixed values: (column, availability, allowed, family) of the pricing feature matrix and its forbidden roots
FEATURE_RULES = [
    ("produit_key", "known_before", True, "identity"), ("categorie", "known_before", True, "identity"),
    ("marque", "known_before", True, "identity"), ("remise_pct", "decision", True, "price"),
    ("prix_base_xof", "known_before", True, "price"), ("cout_xof", "known_before", True, "price"),
    ("dow", "calendar", True, "calendar"), ("month", "calendar", True, "calendar"),
    ("quantite", "outcome", False, "target"), ("ca", "outcome", False, "target"),
    ("marge_totale", "outcome", False, "target"), ("n_lignes", "outcome", False, "target"),
    ("prix_realise", "outcome", False, "target"),
]
FORBIDDEN_ROOTS = ("n_lignes", "n_transactions", "ca_jour", "marge_totale", "quantite", "target", "future")


class ForbiddenFeature(ValueError):
    """A feature that would carry information from the target day."""


def validate_no_forbidden_columns(columns: Sequence[str], roots: Sequence[str] = FORBIDDEN_ROOTS) -> None:
    bad = sorted({c for c in columns for root in roots if root in c.lower()})
    if bad:
        raise ForbiddenFeature(f"forbidden column(s): {bad}")


def validate_matrix(columns: Sequence[str], rules=FEATURE_RULES) -> None:
    """Refuses forbidden, unknown and repeated feature columns."""
    allowed = {name for name, _, ok, _ in rules if ok}
    refused = {name for name, _, ok, _ in rules if not ok}
    if len(set(columns)) != len(columns):
        raise ForbiddenFeature("a feature is listed twice")
    bad = [c for c in columns if c in refused]
    if bad:
        raise ForbiddenFeature(f"forbidden feature(s): {bad}")
    unknown = [c for c in columns if c not in allowed]
    if unknown:
        raise ForbiddenFeature(f"unregistered feature(s): {unknown}")
    validate_no_forbidden_columns(columns)
