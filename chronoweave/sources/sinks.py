"""Changes of tables as new tables, which a writer then puts in the place of the old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it doesn't have."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*new.columns))


def upsert_replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` and the rows of ``old`` whose key it doesn't have."""
    return new.unionByName(old.join(new.select(key), key, "left_anti").select(*old.columns))


def upsert_column(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``old`` with ``column`` taken from ``new(key, column)`` where that has the key, and its other keys added."""
    fresh = new.select(key, F.col(column).alias("fresh"), F.lit(True).alias("is_new"))
    joined = old.join(fresh, key, "full_outer")
    return joined.select(*[F.when(F.col("is_new"), F.col("fresh")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in old.columns])


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Columns changed in rows where the condition is true; null is not true."""
    return df.withColumns({name: F.when(condition, value).otherwise(F.col(name)) for name, value in changes.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where the condition isn't true; null is not true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path`` and move it there, so that readers see the old table or the new one."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh, gone = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old"))
    files = target.getFileSystem(conf)
    files.delete(fresh, True)
    files.delete(gone, True)
    df.write.parquet(path + ".new")
    if files.exists(target):
        files.rename(target, gone)
    files.rename(fresh, target)
    files.delete(gone, True)


def export_document(sections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(section, position, row): all rows as JSON, numbered in the order of the section's columns.

    The document stays a table, so that no row or driver has to hold a whole section.
    """
    from pyspark.sql import Window

    out = None
    for name, (df, order) in sections.items():
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))
        part = df.select(F.lit(name).alias("section"), place.alias("position"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def cleared(tables: dict[str, DataFrame], scopes: list[str]) -> dict[str, DataFrame]:
    """What is left of ``tables`` when ``scopes`` are cleared, with the clusters of the facts that stay.

    ``events`` takes sessions and the facts that were distilled from events along; ``all`` is every table but
    facts, which only ``memory`` empties. Clusters without facts go; centroids and counts are those of what stays.
    """
    from chronoweave.functions.vector import mean_vector

    wanted = {*scopes, *(("events", "screenshots", "conversations") if "all" in scopes else ())}
    gone = wanted | ({"sessions"} if "events" in wanted else set()) | ({"facts"} if "memory" in wanted else set())
    left = {name: df.where(F.lit(False)) if name in gone else df for name, df in tables.items()}
    if "facts" in left:
        if "events" in wanted:
            left["facts"] = left["facts"].where("source is distinct from 'distiller'")
        left["clusters"] = mean_vector(left["facts"], "cluster_id", "embedding")
    return left
