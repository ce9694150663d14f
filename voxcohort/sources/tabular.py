"""Sources of metadata: CSV and TSV with or without a byte-order mark, JSON documents, JSON-lines logs, geometry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """All cells as text; empty cells are null. With `columns` no header is inferred from the data."""
    reader = spark.read.option("header", True).option("sep", sep).option("enforceSchema", False).option("multiLine", True)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns cast where they can be; what cannot be is null."""
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a file; unreadable files give nulls."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def log(spark: SparkSession, path: str, schema: str, keys: list[str], version: str, version_column: str = "geometry_version") -> DataFrame:
    """An append-only log: blank lines and failures are skipped, of the current version the last record of a key wins.

    Records of one file are in the order of their lines; files in that of their names.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("__file"), F.monotonically_increasing_id().alias("__line")).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema).alias("r"), "__file", "__line").select("r.*", "__file", "__line")
    good = rows.where(F.col(version_column) == version)
    if "error" in rows.columns:
        good = good.where(F.col("error").isNull())
    rest = [c for c in rows.columns if c not in (*keys, "__file", "__line")]
    last = good.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__file", "__line")).alias("r"))
    return last.select(*keys, *[f"r.{c}" for c in rest])


def geometry(spark: SparkSession, path: str) -> DataFrame:
    """The geometry table, keyed by (patient_id, phase): spacings as an array in x, y, z order, the flip as a flag (absent
    means no), and the fallback mask's path, which is below the table's own folder unless it is absolute. A second row
    for a key raises."""
    rows = table(spark, path)
    have = lambda c, kind: F.col(c).try_cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    file = F.nullif(F.trim(have("totalsegmentator_liver_native_file", "string")), F.lit(""))
    absolute = file.startswith("/") | file.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    out = rows.select(
        "patient_id", "phase", F.array(*[have(f"spacing_{a}_mm", "double") for a in "xyz"]).alias("spacing_mm"), (F.coalesce(have("k_axis_flip", "int"), F.lit(0)) != 0).alias("k_axis_flip"),
        *[F.coalesce(have(c, "string"), F.lit("")).alias(c) for c in ("orientation_source", "orientation_evidence")], *[have(c, "string").alias(c) for c in ("spacing_z_source", "spacing_z_confidence", "spacing_z_snap", "geometry_version")],
        *[have(c, "double").alias(c) for c in ("spacing_z_continuous_mm", "liver_z_extent_mm")], F.coalesce(have("vertebra_pairs", "int"), F.lit(0)).alias("vertebra_pairs"),
        F.when(absolute, file).otherwise(F.concat(F.lit(f"{path.rpartition('/')[0]}/"), file)).alias("liver_fallback_file"),
    )
    if twice := out.groupBy("patient_id", "phase").count().where("count > 1").limit(5).collect():
        raise ValueError(f"more than one row for {[tuple(r)[:2] for r in twice]}")
    return out


def portable(file: Column, folder: str) -> Column:
    """A path relative to `folder` if it lies below it, else by its name in the folder for fallback masks; '' for none."""
    below = F.concat(F.lit(folder.rstrip("/")), F.lit("/"))
    name = F.concat(F.lit("plc_geometry/liver_fallback/"), F.element_at(F.split(file, "/"), -1))
    return F.when(F.coalesce(file, F.lit("")) == "", "").when(file.startswith(below), F.replace(file, below, F.lit(""))).otherwise(name)


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
