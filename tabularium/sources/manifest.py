"""Manifest tables: listing, reading, normalising, writing."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabularium.functions import scalars as S
from tabularium.sources.files import stored

# Accepted column aliases and image suffixes.
PATH_ALIASES = ("path", "filepath", "file_path", "image_path", "img_path")
CLASS_ALIASES = ("class", "label", "kelas", "category", "target")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "class", "filename", "suffix")])


def list_items(paths: DataFrame, path: str, suffixes: Sequence[str]) -> DataFrame:
    """Audit frame of the paths with an allowed suffix, class = parent folder."""
    p = S.posix(F.col(path))
    return (
        paths.select(p.alias("path"), S.parent_name(p).alias("class"), S.basename(p).alias("filename"), S.suffix(p).alias("suffix"))
        .where(F.col("suffix").isin(*suffixes))
    )


def scan_folder(spark: SparkSession, root: str, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Files exactly two levels below ``root``; contents are never read. An empty folder gives no rows."""
    root = root.rstrip("/")
    depth = len(re.sub("^[a-z0-9]+:/+", "/", root).split("/")) + 2
    files = stored(spark, f"{root}/*/*", kind="binaryFile")
    if files is None:
        return spark.createDataFrame([], MANIFEST)
    files = files.select("path")
    # the pattern also lists below a matching folder
    files = files.where(F.size(F.split(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "/")) == depth)
    return list_items(files, "path", suffixes)


def scan_recursive(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    files = stored(spark, root, kind="binaryFile", recursiveFileLookup="true", pathGlobFilter=pattern)
    if files is None:
        return spark.createDataFrame([], MANIFEST)
    return list_items(files.select("path"), "path", (pattern.lstrip("*").lower(),))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Manifest by file type; any other type is an error. CSV columns stay text unless a schema is given."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "txt"):
        reader = spark.read.option("header", "true")
        return (reader.schema(schema) if schema else reader).csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported manifest type: {path}")


def _alias(df: DataFrame, names: Sequence[str], role: str) -> Column:
    """First column, in table order, whose lower-cased name is an accepted alias."""
    for column in df.columns:
        if column.lower() == names[0]:
            return F.col(column)
    for column in df.columns:
        if column.lower() in names:
            return F.col(column)
    raise ValueError(f"no {role} column among {df.columns}")


def normalize(df: DataFrame) -> DataFrame:
    """path, class, filename, source_id and original_path, whatever the aliases were; a given source id stays."""
    lower = {c.lower(): c for c in df.columns}
    path = _alias(df, PATH_ALIASES, "path").cast("string")
    cls = _alias(df, CLASS_ALIASES, "class").cast("string")

    def own(name: str, otherwise: Column) -> Column:
        return F.col(lower[name]).cast("string") if name in lower else otherwise

    taken = {*PATH_ALIASES, *CLASS_ALIASES, "filename", "source_id", "source_image_id", "original_path"}
    extra = [F.col(c) for c in df.columns if c.lower() not in taken]
    return df.select(
        path.alias("path"), cls.alias("class"),
        own("filename", S.basename(path)).alias("filename"),
        own("source_id", own("source_image_id", S.stable_id(S.posix(path), 16))).alias("source_id"),
        own("original_path", path).alias("original_path"),
        *extra,
    )


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def load_final(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Checked manifest in class, filename, path order; a path absent from the listing is an error."""
    require_columns(manifest, ("path", "class", "filename"))
    absent = missing_paths(manifest, listing).limit(5).collect()
    if absent:
        raise ValueError(f"paths not found: {[r['path'] for r in absent]}")
    return manifest.orderBy("class", "filename", "path")


def load_final_manifest(spark: SparkSession, path: str, fallback_dir: str, listing: DataFrame | None = None) -> DataFrame:
    """The final manifest if it is stored, checked against ``listing`` (by default the files it names); else, with a warning, every PNG
    below ``fallback_dir``. An error if there is neither."""
    kind = "csv" if path.rsplit(".", 1)[-1].lower() in ("csv", "txt") else "parquet"
    manifest = stored(spark, path, kind=kind, **({"header": "true"} if kind == "csv" else {}))
    if manifest is not None:
        return load_final(manifest, scan_recursive(spark, fallback_dir) if listing is None else listing)
    found = scan_recursive(spark, fallback_dir).select("path", "class", "filename")
    if not found.take(1):
        raise ValueError(f"no manifest at {path} and no PNG below {fallback_dir}")
    warnings.warn(f"no manifest at {path}: listing {fallback_dir}", stacklevel=2)
    return found.orderBy("class", "filename", "path")


# Columns of a feature file that are no features.
FEATURE_METADATA = ("path", "class", "filename", "original_path")


def load_final_feature_set(spark: SparkSession, first: str, second: str, manifest: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The feature table at ``first``, or at ``second`` if there is none, and its numeric features, of which there must be one.

    A row count other than the manifest's is a warning.
    """
    read = lambda p: stored(spark, p, kind="csv", header="true", inferSchema="true") if p.endswith(".csv") else stored(spark, p)
    features = read(first)
    features = read(second) if features is None else features
    if features is None:
        raise FileNotFoundError(f"no feature set at {first} or {second}")
    require_columns(features, ("path", "class"))
    if manifest is not None:
        have, want = features.count(), manifest.count()
        if have != want:
            warnings.warn(f"{have} rows of features for {want} of the manifest", stacklevel=2)
    names = numeric_columns(features, FEATURE_METADATA)
    if not names:
        raise ValueError("no numeric feature")
    return features, names


def missing_paths(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    return manifest.join(listing.select("path"), "path", "left_anti").select("path")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def save(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("header", "true").csv(path) if kind == "csv" else writer.parquet(path)


def read_jdbc(spark: SparkSession, url: str, query: str, partition: dict[str, str] | None = None) -> DataFrame:
    """Optional database source; give ``partition`` to split the read over executors."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) AS q")
    return reader.options(**(partition or {})).load()


def select_unit(df: DataFrame, **filters) -> DataFrame:
    """Filter on whichever of the given partition columns exist."""
    for name, value in filters.items():
        if value is not None and name in df.columns:
            df = df.where(F.col(name) == F.lit(value))
    return df


def natural_manifest(spark: SparkSession, root: str, stage_id: int, repeat_id: int = 0, fold_id: int = 0, subset: str = "train") -> DataFrame:
    """One unit's subset before balancing: its own folder if the subsets were exported, else the rows of the assignment table."""
    own = stored(spark, subset_path(f"{root}/subsets", stage_id, repeat_id, fold_id, subset))
    if own is not None:
        return own
    assigned = stored(spark, f"{root}/assignments")
    if assigned is None:
        raise FileNotFoundError(f"neither subsets nor assignments below {root}")
    return select_unit(assigned, stage_id=stage_id, repeat_id=repeat_id, fold_id=fold_id, subset=subset).drop("stage_id", "repeat_id", "fold_id", "subset")


def subset_path(root: str, stage_id, repeat_id, fold_id, subset: str) -> str:
    return f"{root}/stage_id={stage_id}/repeat_id={repeat_id}/fold_id={fold_id}/subset={subset}"


def union_all(spark: SparkSession, frames: Sequence[DataFrame], schema: T.StructType) -> DataFrame:
    """Union of per-stage frames by name; no frames give an empty one."""
    out = spark.createDataFrame([], schema)
    for frame in frames:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def encode_class(df: DataFrame, cls: str, names: Sequence[str], out: str = "class_index") -> DataFrame:
    """Index of the class in a fixed ordered list; null where the class is unknown."""
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(cls))
    return df.withColumn(out, F.when(position > 0, position - 1).cast("bigint"))


def require_known(df: DataFrame, column: str, label: str) -> DataFrame:
    """Make an unknown class an error when the row is read."""
    return df.withColumn(
        column,
        F.coalesce(F.col(column), F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col(label), F.lit("null")))).cast("bigint")),
    )


def pending(manifest: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to be processed: manifest keys without a result."""
    return manifest.join(done.select(key), key, "left_anti")


def prune_results(done: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Results whose key is still in the manifest, one per key."""
    return done.join(manifest.select(key), key, "left_semi").dropDuplicates([key])


def extract_incrementally(manifest: DataFrame, results_path: str, key: str, job, force: bool = False) -> DataFrame:
    """Run ``job`` on the missing keys only, append, and check that every manifest key has a result."""
    spark = manifest.sparkSession
    done = None if force else stored(spark, results_path)
    todo = manifest if done is None else pending(manifest, done, key)
    job(todo).write.mode("overwrite" if done is None else "append").parquet(results_path)
    result = prune_results(spark.read.parquet(results_path), manifest, key)
    have, want = result.count(), manifest.select(key).distinct().count()
    if have != want:
        raise ValueError(f"{have} results for {want} manifest keys")
    return result


def split_errors(df: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(status) == "ok"), df.where(F.col(status) == "error")
