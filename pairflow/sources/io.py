"""Readers for the input tables and writers for the results, over Spark's own file sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairflow import schemas
from pairflow.functions.expr import clean_key, day_key, named
from pairflow.operators.joins import lookup
from pairflow.session import delete, fits, materialize

# Names in the stored tables, and where an attribute file lies under its catchment's folder.
INDEX_COLUMN = "Unnamed: 0"
UNUSED_FORCING = "LQFRAC"
ATTRIBUTE_FILE = "config/cfe_noahowp_attributes.csv"
MAX_PUSHED_IDS = 1000
"""Ids up to which a list goes into the scan as a filter instead of a join; the rows are the same."""


# --- sources ---------------------------------------------------------------------------------


def tidy_series(df: DataFrame) -> DataFrame:
    """A stored table in its working form: saved index as ``time``, unused forcing dropped."""
    if INDEX_COLUMN in df.columns and "time" not in df.columns:
        df = df.withColumnRenamed(INDEX_COLUMN, "time")
    df = df.drop(UNUSED_FORCING)
    if "time" in df.columns and not isinstance(df.schema["time"].dataType, T.TimestampNTZType):
        df = df.withColumn("time", F.col("time").cast("timestamp_ntz"))
    return df


def stack(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name; an absent column is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_series(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Read all files of an assembled table, whatever their column sets, in one scan.

    Row order is that of ``time``, not of files. CSV columns are read by the given schema. Of a table
    in day folders only those from ``start`` to ``end`` are read; the folder's name is not a column.
    """
    return within_days(_stored_series(spark, path, fmt, schema), start, end).drop(DAY_FOLDER)


def _stored_series(spark: SparkSession, path: str | list[str], fmt: str, schema: T.StructType | None) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "parquet":
        reader = spark.read.option("mergeSchema", True)
        if schema is not None:
            reader = reader.schema(schema)
        return tidy_series(reader.parquet(*paths))
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs its schema")
        return tidy_series(spark.read.schema(schema).option("header", True).csv(paths))
    raise ValueError(f"unknown format {fmt}")


def read_sites(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The site list with ``pos`` stored: all of it, or with ``limit`` the first so many positions.

    ``path`` is a parquet table that has ``pos``, or a CSV (of several files in order of name) whose
    rows are in list order; it is numbered once here and stored with ``pos``.
    """
    if path.endswith(".csv"):
        lines = spark.read.option("header", True).csv(path)
        known = [f for f in schemas.SITE_FILE.fields if f.name in lines.columns]
        typed = spark.read.option("header", True).option("enforceSchema", False)
        rows = typed.schema(T.StructType([next(f for f in known if f.name == c) for c in lines.columns]))
        # A block of a file is read by one task in order; blocks stand by the file's name and their place in it.
        block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        tagged = rows.csv(path).select("*", block.alias("__block"), F.monotonically_increasing_id().alias("__at"))
        sites = _numbered(tagged, "__at", "__block")
    else:
        sites = spark.read.parquet(path)
    return sites if limit is None else sites.where(F.col("pos") < limit)


def _numbered(df: DataFrame, order: str, block: str) -> DataFrame:
    """``pos``: all rows of earlier blocks, and those before within the own block."""
    from pairflow.operators import ordering

    kept = [c for c in df.columns if c not in (order, block)]
    out = ordering.row_index(df, [], [order], F.col(block), "pos")
    return out.select("pos", *kept)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The site list's places as ``lat, lon``."""
    return read_sites(spark, path, limit=None).select(F.col("y").alias("lat"), F.col("x").alias("lon"))


def parse_pair_map(objects: DataFrame, column: str = "value") -> DataFrame:
    """``(entry, key, value)`` of a JSON object per row, in the order written.

    A key written twice counts once: in its first place, with its last value.
    """
    written = F.map_entries(F.from_json(F.col(column), schemas.PAIR_MAP))

    def once(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
        last = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1))
        return F.when(F.size(keys) == F.size(pairs), pairs).otherwise(last)

    entries = F.transform(F.array(written), once)[0]
    rest = [c for c in objects.columns if c != column]
    # Outer, then without the empty ones: a plain explode would parse twice more to look for them.
    return (
        objects.select(*rest, F.posexplode_outer(entries).alias("entry", "e"))
        .where(F.col("entry").isNotNull())
        .select(*rest, F.col("entry").cast("bigint").alias("entry"), "e.key", "e.value")
    )


def read_pair_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The pair map file: one JSON object ``{"<id>": <id>, ...}``, or with ``lines`` an object per line.

    Lines are read by many tasks: files in order of name, lines in order within. A key written twice keeps its first
    place and its last value in either form.
    """
    if not lines:
        return parse_pair_map(spark.read.text(path, wholetext=True))
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    text = spark.read.text(path).select("value", block.alias("__block"), F.monotonically_increasing_id().alias("__line"))
    # A task numbers its lines upwards, but blocks stand by file and place.
    at = F.struct(F.col("__block"), F.col("__line"), F.col("entry"))
    once = parse_pair_map(text).groupBy("key").agg(F.min(at).alias("__at"), F.max_by("value", at).alias("value"))
    placed = materialize(once.select("key", "value", "__at", F.col("__at.__block").alias("__block")))
    return _numbered(placed, "__at", "__block").withColumnRenamed("pos", "entry")


def pair_map_ids(pairs: DataFrame) -> DataFrame:
    """Interleaved ids key, value, key, value, ... with their place ``pos``; repeated ids are kept."""
    rest = [c for c in pairs.columns if c not in ("entry", "key", "value")]
    both = F.array(F.col("key").cast("bigint"), F.col("value").cast("bigint"))
    return pairs.select(*rest, "entry", F.posexplode(both).alias("__side", "feature_id")).select(
        *rest, (F.col("entry") * 2 + F.col("__side")).cast("bigint").alias("pos"), "feature_id"
    )


def read_flow(
    spark: SparkSession, path: str, features: list[int] | None = None, grouped: bool = False
) -> DataFrame:
    """A flow store; of one clustered by feature only the folders of the listed ``features`` are read.

    ``grouped`` keeps the folder's number ``feature_group``, by which ``select_flow`` leaves out folders
    for a table of ids too.
    """
    flow = spark.read.parquet(path)
    if FEATURE_FOLDER not in flow.columns:
        return flow if features is None else flow.where(F.col("feature_id").isin(features))
    if features is not None:
        groups = sorted({f // FEATURES_PER_FOLDER for f in features})
        flow = flow.where(F.col(FEATURE_FOLDER).isin(groups) & F.col("feature_id").isin(features))
    return flow if grouped else flow.drop(FEATURE_FOLDER)


def in_days(time: Column, start: str | None, end: str | None) -> Column:
    """``start`` to ``end`` given as days; the whole end day is included."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (time >= F.lit(start).cast("date").cast("timestamp_ntz"))
    if end is not None:
        cond = cond & (time < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return cond


DAY_FOLDER = "day_key"


def within_days(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows of the days ``start`` to ``end``; where the table lies in day folders only theirs are read."""
    out = df.where(in_days(F.col("time"), start, end))
    if DAY_FOLDER in df.columns:
        folder = F.col(DAY_FOLDER).cast("string")
        if start is not None:
            out = out.where(folder >= _folder(start))
        if end is not None:
            out = out.where(folder <= _folder(end))
    return out


def _folder(day: str) -> str:
    """Name of a day's folder: its file key without separators (keys of four-digit years sort by time)."""
    return f"{day[:4]}{day[:4]}{day[5:7]}{day[8:10]}"


def select_flow(
    flow: DataFrame,
    ids: DataFrame | list[int] | None = None,
    start: str | None = None,
    end: str | None = None,
    variable: str = "streamflow",
    repeat: bool = False,
    order: str | None = None,
) -> DataFrame:
    """Flow of the listed features in a span of days: only key, time and one variable are read.

    A short list of ids is pushed into the scan; a table of ids is joined (``repeat`` keeps the
    repeats of the list, otherwise each id counts once). Of a store clustered by feature and read with
    its folder numbers (``read_flow(..., grouped=True)``) only the folders of wanted ids are opened,
    however many ids there are, and of their files only the row groups between the least and the
    greatest id.
    """
    kept = ["time", "feature_id", variable, *([order] if order else [])]
    out = within_days(flow, start, end)
    if ids is None:
        return out.select(*kept)
    clustered = FEATURE_FOLDER in flow.columns
    if isinstance(ids, list) and len(set(ids)) <= MAX_PUSHED_IDS and not repeat:
        listed = sorted(set(ids))
        if clustered:
            out = out.where(F.col(FEATURE_FOLDER).isin(sorted({i // FEATURES_PER_FOLDER for i in listed})))
        return out.select(*kept).where(F.col("feature_id").isin(listed))
    if isinstance(ids, list):
        ids = flow.sparkSession.createDataFrame([(i,) for i in ids], "feature_id bigint")
    wanted = materialize(ids.select("feature_id") if repeat else ids.select("feature_id").distinct())
    out = (_in_folders(out, wanted) if clustered else out).select(*kept)
    return lookup(out, wanted, ["feature_id"], "inner" if repeat else "left_semi", spread=["time"]).select(*kept)


def _in_folders(flow: DataFrame, wanted: DataFrame) -> DataFrame:
    """Flow in the folders that hold a wanted id: their numbers are joined, so the scan skips the rest at run time."""
    folders = materialize(wanted.select(folder_of(F.col("feature_id")).alias(FEATURE_FOLDER)).distinct())
    ends = wanted.agg(F.min("feature_id").alias("low"), F.max("feature_id").alias("high")).first()
    if ends["low"] is None:
        return flow.where(F.lit(False))
    flow = flow.where(F.col("feature_id").between(ends["low"], ends["high"]))
    # A number per folder of the store at most, as many as the driver lists; still checked.
    if not fits(folders):
        return flow
    # The filter holds for all of them; Spark prunes at run time only by a side that is filtered.
    least, most = (v // FEATURES_PER_FOLDER for v in (ends["low"], ends["high"]))
    return flow.join(F.broadcast(folders.where(F.col(FEATURE_FOLDER).between(least, most))), FEATURE_FOLDER, "left_semi")


def select_forcing(
    forcing: DataFrame, variables: list[str] = schemas.FORCINGS, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Grid cells of a span of days, with the wanted variables only."""
    return within_days(forcing, start, end).select("time", "iy", "ix", *variables)


def forcing_times(forcing: DataFrame) -> DataFrame:
    return forcing.select("time").distinct()


def read_attributes(
    spark: SparkSession, path: str, schema: T.StructType | None = None, file: str = ATTRIBUTE_FILE
) -> DataFrame:
    """All per-catchment attribute files as one table, with ``ds_catid`` from the path.

    ``path`` is the folder that holds ``<ds_catid>/<file>`` (or ``ds_catid=<ds_catid>/<file>``, as Spark
    writes folders; ``file`` may be a pattern). ``idx`` is the row's place in its file. Every file
    starts with the same header.
    """
    files = f"{path.rstrip('/')}/*/{file}"
    folder = "([^/=]+)" + "/[^/]+" * (file.count("/") + 1) + "$"
    reader = spark.read.option("header", True)
    # Types from one pass over the files; give the schema where there are many.
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    rows = reader.csv(files)
    columns = rows.columns
    tagged = rows.select(
        F.regexp_extract(F.col("_metadata.file_path"), folder, 1).alias("ds_catid"),
        *[named(c) for c in columns],
        F.monotonically_increasing_id().alias("__at"),
    )
    return _file_index(tagged, columns)


def _file_index(tagged: DataFrame, columns: list[str]) -> DataFrame:
    from pairflow.operators import ordering

    out = ordering.row_index(
        tagged, ["ds_catid"], ["__at"], F.floor(F.col("__at") / 100_000).cast("bigint"), "idx"
    )
    return out.select("ds_catid", "idx", *[named(c) for c in columns])


def _rings(schema: T.StructType, holes: bool) -> T.StructType:
    return T.StructType([*schema.fields, schemas.HOLE]) if holes else schema


def read_polygons(
    spark: SparkSession, path: str, project: bool = False, fmt: str = "parquet", holes: bool = False
) -> DataFrame:
    """Catchment rings by ``divide_id``, a row per part; ``project`` turns lon/lat into the forcing grid's metres.

    With ``holes`` rows also tell whether their ring is a hole of the polygon.
    """
    from pairflow.operators.spatial import ring_to_lcc

    rows = spark.read.schema(_rings(schemas.POLYGONS, holes)).format(fmt).load(path)
    return ring_to_lcc(rows) if project else rows


def read_boundary(spark: SparkSession, path: str, fmt: str = "parquet", holes: bool = False) -> DataFrame:
    return spark.read.schema(_rings(schemas.BOUNDARY, holes)).format(fmt).load(path)


def day_keys(times: DataFrame, steps_per_day: int = 24) -> DataFrame:
    """``(month, day, key)``: the file key of each day of a month.

    As many days from the first of the month on as there are time steps / ``steps_per_day``,
    rounded down; a month's steps are counted as distinct times.
    """
    steps = times.select("time").distinct()
    months = steps.groupBy(F.trunc(F.to_date("time"), "month").alias("month")).agg(
        F.floor(F.count(F.lit(1)) / steps_per_day).cast("int").alias("n")
    )
    return (
        months.where(F.col("n") > 0)
        .select("month", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("d"))
        .select("month", F.date_add("month", F.col("d") - 1).alias("day"))
        .select("month", "day", day_key(F.col("day")).alias("key"))
    )


# --- sinks -----------------------------------------------------------------------------------


def write_series(df: DataFrame, path: str, by: str | None = None, fmt: str = "parquet") -> None:
    """Append assembled rows, or with ``by='day'`` one folder per day, replaced when written again."""
    if by is None:
        writer = df.write.mode("append")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
        return
    if by != "day":
        raise ValueError("by is None or 'day'")
    _write_days(df, path, fmt)


def _write_days(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    keyed = df.withColumn(DAY_FOLDER, clean_key(day_key(F.col("time"))))
    # Spark sizes the tasks by the rows of a day, however many there are, and splits a crowded one.
    writer = (
        keyed.hint("rebalance", DAY_FOLDER)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY_FOLDER)
    )
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def replace_days(df: DataFrame, path: str, days: list[str], held: list[str] | None = None) -> None:
    """Write by day; of ``days`` (folder names) those that ``df`` has no row for lose what they held.

    ``held`` are the days that ``df`` has rows for; where it is not given they are found by another pass.
    """
    spark = df.sparkSession
    _write_days(df, path)
    if held is None:
        names = df.select(clean_key(day_key(F.col("time"))).alias("k")).distinct()
        held = [r["k"] for r in names.collect()]
    for gone in set(days) - set(held):
        delete(spark, f"{path}/{DAY_FOLDER}={gone}")


FEATURES_PER_FOLDER = 1000
FEATURE_FOLDER = "feature_group"


def folder_of(feature: Column) -> Column:
    """Number of a feature's folder, exact for all whole numbers."""
    return F.call_function("div", feature - F.pmod(feature, F.lit(FEATURES_PER_FOLDER)), F.lit(FEATURES_PER_FOLDER))


def write_flow(flow: DataFrame, path: str, by: str = "feature", batches: DataFrame | None = None) -> None:
    """Flow clustered by feature, or one folder per batch of ids (``batches`` has ``feature_id, batch_start``).

    By feature: folders of ``FEATURES_PER_FOLDER`` consecutive ids, in each of which files hold ranges of
    features in order of time, so that a reader of one feature opens few files and a store of millions of
    features has few. Rows of a batch folder are spread by month over several tasks.
    """
    if by == "feature":
        keyed = flow.withColumn(FEATURE_FOLDER, folder_of(F.col("feature_id")))
        ordered = keyed.repartitionByRange("feature_id", "time").sortWithinPartitions(FEATURE_FOLDER, "feature_id", "time")
        ordered.write.mode("overwrite").partitionBy(FEATURE_FOLDER).parquet(path)
        return
    if by == "batch":
        keyed, folder = lookup(flow, materialize(batches), ["feature_id"], spread=["time"]), "batch_start"
    else:
        raise ValueError("by is 'feature' or 'batch'")
    keyed.repartition(folder, F.trunc(F.to_date("time"), "month")).write.mode("overwrite").partitionBy(
        folder
    ).parquet(path)


def narrowed(df: DataFrame) -> DataFrame:
    """Doubles as floats, for storage only."""
    narrow = lambda f: named(f.name).cast("float").alias(f.name)
    return df.select(
        *[narrow(f) if isinstance(f.dataType, T.DoubleType) else named(f.name) for f in df.schema.fields]
    )


def write_cache(flow: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store the selected flow as floats, clustered by feature and time.

    The commit protocol publishes files only when the job succeeds, so none are left half-written.
    """
    keys = ["feature_id", "time"]
    out = narrowed(flow)
    ranged = out.repartitionByRange(partitions, *keys) if partitions else out.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Metric summary rows (``metric, values, average``) as one CSV with the header Metric,Values,Average."""
    summary.select(
        F.col("metric").alias("Metric"), F.col("values").alias("Values"), F.col("average").alias("Average")
    ).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
