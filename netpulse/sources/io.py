"""Scans and sinks: tables, ARFF flow files, packet dumps, ping logs, manifests, reports.

Headers are found by the tasks that read the files; the driver sees the distinct ones. Row order inside a
file, where a format needs it, comes from one materialized scan (file path, block start and
the id within the task), never from collecting lines.
"""

from __future__ import annotations

import csv
import re
import uuid
from collections import Counter
from collections.abc import Mapping, Sequence
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netpulse.functions.exprs import require_columns, trim_all
from netpulse.operators.windows import sensor_feature_frame
from netpulse.plans.ordering import narrow_row_index
from netpulse.session import checkpoint_dir, materialize, small

# ARFF attribute declaration and the two ping line shapes
# (an optional "[epoch] " prefix, replies with seq and time, timeouts with seq).
ARFF_ATTRIBUTE = r"(?i)^@attribute\s+('.*?'|\".*?\"|[^\s]+)\s+.+"
PING_REPLY = r"^(?:\[([0-9]+\.[0-9]+)\]\s+)?.*icmp_seq=(\d+).*time=([0-9.]+)\s*ms"
PING_TIMEOUT = r"^(?:\[([0-9]+\.[0-9]+)\]\s+)?no answer yet for icmp_seq=(\d+)"


# Fixed value: CSV timestamps keep microseconds and the zone offset.
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _suffix(path: str) -> str:
    return PurePath(path.rstrip("/")).suffix


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV (header row) or Parquet by suffix; anything else raises ``ValueError``."""
    suffix = _suffix(path)
    if suffix == ".csv":
        reader = spark.read.option("header", True).option("timestampFormat", CSV_TIMESTAMP_FORMAT)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    if suffix == ".parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    raise ValueError(f"a table is .csv or .parquet, not {suffix or 'without suffix'}")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write CSV (with header) or Parquet by suffix (a directory of part files)."""
    suffix = _suffix(path)
    if suffix == ".csv":
        df.write.mode(mode).option("header", True).option("timestampFormat", CSV_TIMESTAMP_FORMAT).csv(path)
    elif suffix == ".parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"a table is .csv or .parquet, not {suffix or 'without suffix'}")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def file_stem(path_col: Column) -> Column:
    """File name without directory and last extension."""
    name = F.regexp_extract(path_col, r"([^/]+)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def source_name(path_col: Column, files: Sequence[str]) -> Column:
    """A file's stem, with as many parent folders before it as tell all ``files`` apart."""
    parts = [PurePath(f).with_suffix("").parts for f in files]
    k = 1
    while len({p[-k:] for p in parts}) < len(set(parts)):
        k += 1
    tail = F.regexp_extract(path_col, rf"((?:[^/]+/){{0,{k - 1}}}[^/]+)$", 1)
    return F.regexp_replace(tail, r"\.[^./]*$", "")


def with_file_order(df: DataFrame) -> DataFrame:
    """Scan-time order key of each line/row: (file path, block start, id within the task).

    Must be applied directly on a file scan (and its filters), before any shuffle.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mono"),
    )


def number_rows(tagged: DataFrame, name: str, group: str = "_file") -> DataFrame:
    """0-based position of each row in its file (or in all files of a ``group``, by path), from the tags of ``with_file_order``.

    The tagged rows are materialized, so positions and offsets come from one and the same scan: ids are
    consecutive within a block, and a table with one row per block gives the rows before it.
    """
    rows = materialize(tagged)
    blocks = rows.groupBy(group, *([] if group == "_file" else ["_file"]), "_block").agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = blocks.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = rows.join(shift, ["_file", "_block"])  # one row per block: the planner measures that side
    return out.withColumn(name, (F.col("_mono") + F.col("_shift")).cast("bigint")).drop("_block", "_mono", "_shift")


def _header_names(line: str) -> list[str]:
    """Column names of a CSV header line: empty ones by place, repeated ones with their place after them."""
    names = next(csv.reader([line]))
    lower = Counter(n.lower() for n in names)
    return [f"_c{i}" if not n else f"{n}{i}" if lower[n.lower()] > 1 else n for i, n in enumerate(names)]


def _by_layout(lines: DataFrame, text: Column, layout: str, names: Sequence[Sequence[str]], keep: Sequence[str], options: dict) -> DataFrame:
    """Parse CSV text once for all files: column ``layout`` says which list of ``names`` a line's fields follow. Columns are united by name."""
    width = max(map(len, names))
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    parsed = lines.select(F.from_csv(text, schema.simpleString(), options).alias("_r"), F.col(layout).alias("_layout"), *keep)
    places: dict[str, list[Column]] = {}
    for k, own in enumerate(names):
        for i, name in enumerate(own):
            field = F.col(f"_r._c{i}")
            places.setdefault(name, []).append(field if len(names) == 1 else F.when(F.col("_layout") == k, field))
    return parsed.select(*[F.coalesce(*found).alias(name) for name, found in places.items()], *keep)


def _numbered(found: DataFrame, column: str) -> tuple[DataFrame, list]:
    """``found`` (one row a file) with the number of its value of ``column`` as ``_layout``, and the distinct values by number.
    Files differ little in their headers: the driver sees the distinct ones only."""
    distinct = found.groupBy(column).agg(F.min("_file").alias("_f")).orderBy("_f").collect()
    values = [r[column] for r in distinct]
    numbers = found.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], T.StructType([found.schema[column], T.StructField("_layout", T.IntegerType())]))
    return small(found.join(F.broadcast(numbers), column)), values


def read_csv_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV files with header rows, every column as text, plus ``_file`` and ``_row`` (0-based row position in its file).

    One scan: lines are numbered as they are read, a file's first line is its header, wherever the file is read, and each line is
    parsed by its own file's header; columns are united by name. Blank lines are skipped; records end with their line; a quote within
    quotes is doubled. A file without any line gives no rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = with_file_order(spark.read.text(paths).where(F.length(trim_all(F.col("value"))) > 0))
    lines = number_rows(lines, "_line")
    heads = lines.where(F.col("_line") == 0).select("_file", trim_all(F.col("value")).alias("_head"))
    heads, headers = _numbered(heads, "_head")
    if not headers:
        raise ValueError("none of the flow files has a header row")
    data = lines.where(F.col("_line") > 0).join(heads.select("_file", "_layout"), "_file").withColumn("_row", F.col("_line") - 1)
    return _by_layout(data, F.col("value"), "_layout", [_header_names(h) for h in headers], ["_file", "_row"], {"escape": '"'})


def read_flow_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``read_csv_rows`` with ``source`` (file stem, with parent folders where stems repeat) in place of the file."""
    rows = read_csv_rows(spark, paths)
    files = sorted(spark.read.text([paths] if isinstance(paths, str) else list(paths)).inputFiles())
    return rows.withColumn("source", source_name(F.col("_file"), files)).drop("_file")


# ------------------------------------------------------------------ ARFF


def read_arff(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """ARFF files -> one string column per attribute plus ``source`` (file stem, with parent folders where
    stems repeat) and ``_row`` (0-based data-row position in the file).

    Rows are the lines after ``@data``, whatever they begin with, but for comments (``%``) and blank
    lines, parsed as CSV with ``'`` quotes. Headers are read by the tasks that read the files: a file's attributes are the
    declarations above its ``@data`` line. Files with different attribute lists are parsed by their own and
    united by name; a file without ``@data`` gives no rows, one without attributes is left out.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths)
    files = sorted(raw.inputFiles())
    lines = number_rows(with_file_order(raw), "_line").withColumn("_text", trim_all(F.col("value")))
    lower = F.lower("_text")
    skip = lines.where(lower.startswith("@data")).groupBy("_file").agg((F.min("_line") + 1).alias("_skip"))
    declared = lines.where(lower.startswith("@attribute")).join(small(skip), "_file").where(F.col("_line") < F.col("_skip"))
    name = F.regexp_extract("_text", ARFF_ATTRIBUTE, 1)
    if not (bad := declared.where(~F.col("_text").rlike(ARFF_ATTRIBUTE)).limit(1)).isEmpty():
        raise ValueError(f"{bad.first()['_file']} declares an attribute without a name or type")
    # a header's lines only, however many rows follow it
    heads = declared.groupBy("_file", "_skip").agg(F.sort_array(F.collect_list(F.struct("_line", name.alias("name")))).alias("_names"))
    heads, schemas = _numbered(heads.select("_file", "_skip", F.transform("_names", lambda x: x["name"]).alias("_names")), "_names")
    if not schemas:
        raise ValueError("none of the files declares an attribute above its data")
    data = lines.join(heads.select("_file", "_skip", "_layout"), "_file").where(
        (F.col("_line") >= F.col("_skip")) & (F.length("_text") > 0) & ~F.col("_text").startswith("%"))
    data = narrow_row_index(data.select("_text", "_file", "_line", "_layout"), ["_line"], keys=["_file"], name="_row")
    names = [[n.strip("\"'") for n in own] for own in schemas]
    out = _by_layout(data, F.col("_text"), "_layout", names, ["_file", "_row"], {"quote": "'", "ignoreLeadingWhiteSpace": "true"})
    return out.withColumn("source", source_name(F.col("_file"), files)).drop("_file")


def plain_path(path: Column) -> Column:
    """A path without its scheme's empty authority and escapes, as listings, scans and users spell it differently."""
    return _decoded(F.regexp_replace(path, r"^([a-z0-9]+):/+", "$1:/"))


def _decoded(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


# ------------------------------------------------------------------ packet dumps and ping logs


def read_packet_dump(spark: SparkSession, paths: str | Sequence[str], by_folder: bool = False) -> DataFrame:
    """Text dumps (``epoch rest...`` per line) -> trace_id (file stem, with parent folders where stems
    repeat), packet_index, epoch.

    Lines whose first token is not a number are skipped; the index counts the valid lines of a file
    from 0 in file order. With ``by_folder`` all files of a folder are one trace, in the order of their names,
    which the folder names.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths)
    first = F.split(trim_all(F.col("value")), r"\s+", 2).getItem(0)
    valid = raw.select(first.try_cast("double").alias("epoch"), "_metadata").where(F.col("epoch").isNotNull())
    tagged = with_file_order(valid).select("epoch", "_file", "_block", "_mono")
    if by_folder:
        folder = F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1)
        return number_rows(tagged.withColumn("trace_id", folder), "packet_index", "trace_id").select("trace_id", "packet_index", "epoch")
    rows = number_rows(tagged, "packet_index")
    return rows.select(source_name(F.col("_file"), sorted(raw.inputFiles())).alias("trace_id"), "packet_index", "epoch")


def parse_ping_log(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Ping output lines -> probe events; replies: lost 0 and RTT; timeouts: lost 1, RTT 0.
    Other lines are dropped; ``epoch`` is NULL where the line has no ``[epoch]`` prefix."""
    line = trim_all(F.col(text_col))
    is_reply = line.rlike(PING_REPLY)
    is_timeout = ~is_reply & line.rlike(PING_TIMEOUT)
    epoch = F.when(is_reply, F.regexp_extract(line, PING_REPLY, 1)).otherwise(F.regexp_extract(line, PING_TIMEOUT, 1))
    seq = F.when(is_reply, F.regexp_extract(line, PING_REPLY, 2)).otherwise(F.regexp_extract(line, PING_TIMEOUT, 2))
    out = lines.where(is_reply | is_timeout).select(
        *[c for c in lines.columns if c != text_col],
        F.when(is_reply, F.lit("reply")).otherwise(F.lit("timeout")).alias("event_type"),
        F.when(epoch == "", F.lit(None)).otherwise(epoch).try_cast("double").alias("epoch"),
        seq.try_cast("bigint").alias("icmp_seq"),
        F.lit(1).cast("bigint").alias("packets_sent"),
        F.when(is_reply, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("packets_lost"),
        F.when(is_reply, F.regexp_extract(line, PING_REPLY, 3).try_cast("double")).otherwise(F.lit(0.0)).alias("rtt_ms"),
        F.lit(0).cast("bigint").alias("retransmissions"),
        F.lit(0).cast("bigint").alias("resets"),
    )
    return out


def read_ping_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_ping_log(spark.read.text(paths if isinstance(paths, str) else list(paths)))


# ------------------------------------------------------------------ manifests

PHASE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("start_offset_seconds", T.DoubleType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("label", T.LongType()),
    T.StructField("impairment_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("netem", T.MapType(T.StringType(), T.DoubleType())),
])
MANIFEST_SCHEMA = T.StructType([
    T.StructField("schema_version", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("application", T.StringType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("window_seconds", T.LongType()),
    T.StructField("files", T.StructType([T.StructField("raw_metrics", T.StringType())])),
    T.StructField("phases", T.ArrayType(PHASE_SCHEMA)),
])


def read_manifests(spark: SparkSession, paths: str | Sequence[str], validate: bool = True,
                   multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """JSON manifests -> (runs: one row per run, phases: one row per (run, phase) with position).

    One manifest document per file by default; ``multi_line=False`` reads JSON lines.

    Validation (raises on any reject): start >= 0, duration > 0, label >= 0,
    severity in the four known values (missing -> none).
    """
    from netpulse.operators.joins import SEVERITIES, validate_phases

    m = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", multi_line).option("mode", "FAILFAST" if validate else "PERMISSIVE").json(paths)
    m = m.select("*", F.col("_metadata.file_path").alias("manifest_path"))
    runs = m.select("run_id", "manifest_path", "domain", "application", "scenario",
                    F.coalesce("window_seconds", F.lit(5)).alias("window_seconds"),
                    F.coalesce("files.raw_metrics", F.lit("sensor_metrics_raw.csv")).alias("raw_metrics"),
                    F.col("created_at").try_cast("timestamp").alias("created_at"))
    p = m.select("run_id", F.posexplode("phases").alias("pos", "p"))
    phases = p.select(
        "run_id", F.col("pos").cast("int").alias("pos"),
        F.col("p.name").alias("phase_name"),
        F.col("p.start_offset_seconds").alias("start_offset_seconds"),
        (F.col("p.start_offset_seconds") + F.col("p.duration_seconds")).alias("end_offset_seconds"),
        F.col("p.label").cast("int").alias("label"),
        F.col("p.impairment_type").alias("impairment_type"),
        F.coalesce(F.col("p.severity"), F.lit(SEVERITIES[0])).alias("severity"),
    )
    if validate:
        bad = validate_phases(phases).limit(5).collect()  # at most 5 rows
        if bad:
            raise ValueError(f"phases break the manifest rules: {[r.asDict() for r in bad]}")
    return runs, phases


def read_run_folders(spark: SparkSession, root: str, manifests: str = "*/manifest.json", multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run folders under ``root`` -> (raw rows of all runs with their ``run_id``, phases, runs).

    Each run's manifest names its raw CSV file, or a folder of such files, relative to the folder that the manifest lies in. Just these are read, all
    in one scan, and a row's run comes from the path it was read from; runs may differ in their columns. A raw file that is not
    there is an error, and so are two manifests with the same run or the same raw file. Columns are text.
    """
    runs, phases = read_manifests(spark, f"{root.rstrip('/')}/{manifests}", multi_line=multi_line)
    runs = materialize(runs.withColumn("_raw", F.concat(F.regexp_replace("manifest_path", r"/[^/]*$", "/"), F.regexp_replace("raw_metrics", r"^(\./)+|/+$", ""))))
    again = runs.groupBy("run_id").count().where("count > 1").select(F.col("run_id").alias("twice"))
    again = again.unionByName(runs.groupBy(F.col("_raw").alias("twice")).count().where("count > 1").select("twice")).limit(3).collect()
    if again:
        raise ValueError(f"more than one manifest for {[r.twice for r in again]}")
    # one path a run: what the driver lists for the scan anyway
    paths = [r["path"] for r in runs.select(F.concat(F.regexp_replace(_decoded(F.col("manifest_path")), r"/[^/]*$", "/"), F.col("raw_metrics")).alias("path")).collect()]
    if not paths:
        raise ValueError(f"no manifest found at {root}/{manifests}")
    rows = read_csv_rows(spark, paths)
    known = small(runs.select(plain_path(F.col("_raw")).alias("_raw"), "run_id"))
    path = plain_path(F.col("_file"))
    keyed = rows.drop("run_id").withColumns({"_path": path, "_folder": F.regexp_replace(path, r"/[^/]*$", "")})
    files = known.select(F.col("_raw").alias("_path"), F.col("run_id").alias("_by_file"))
    folders = known.select(F.col("_raw").alias("_folder"), F.col("run_id").alias("_by_folder"))
    keyed = keyed.join(files, "_path", "left").join(folders, "_folder", "left")
    raw = keyed.withColumn("run_id", F.coalesce("_by_file", "_by_folder")).drop("_path", "_folder", "_by_file", "_by_folder", "_file", "_row")
    return raw, phases, runs.drop("_raw")


# ------------------------------------------------------------------ reports and domains


def report_json(report: DataFrame) -> DataFrame:
    """One JSON document per report row, keys sorted."""
    return report.select(F.to_json(F.struct(*[F.col(c) for c in sorted(report.columns)])).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    """Write the report rows as sorted-key JSON lines (a directory of part files)."""
    report_json(report).write.mode("overwrite").text(path)


def domain_features(raw: DataFrame, window_seconds: int = 5) -> DataFrame:
    """Raw sensor rows with a ``domain`` column -> one feature frame with ``domain::session`` ids."""
    require_columns(raw, ["session_id", "domain"], "sensor")
    tagged = raw.withColumn("session_id", F.concat("domain", F.lit("::"), F.col("session_id").cast("string")))
    return sensor_feature_frame(tagged, window_seconds, extra_keys=("domain",))


def tag_domains(frames: Mapping[str, DataFrame], window_seconds: int = 5) -> DataFrame:
    """Raw sensor frames per domain -> one feature frame with ``domain`` and ``domain::session`` ids."""
    if not frames:
        raise ValueError("no domain is given")
    parts = []
    for name, raw in frames.items():
        require_columns(raw, ["session_id"], "sensor")
        parts.append(raw.withColumn("domain", F.lit(str(name))))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    return domain_features(union, window_seconds)


def read_domain_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows of all tables in a folder in one scan, with ``domain``: the name of the file or folder just below it that a row comes
    from, without its suffix (and without ``domain=``). Parquet tables; a domain that is added later is read without a change."""
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(folder)
    top = F.regexp_extract(plain_path(F.col("_metadata.file_path")), re.escape(PurePath(folder.rstrip("/")).name) + r"/([^/]+)", 1)
    name = F.regexp_replace(F.regexp_replace(top, r"\.[^.]*$", ""), "^domain=", "")
    return rows.select("*", name.alias("_domain")).drop("domain").withColumnRenamed("_domain", "domain")


def load_domains(spark: SparkSession, paths: str | Sequence[str] | Mapping[str, str], window_seconds: int = 5,
                 domain_names: Sequence[str] | None = None) -> DataFrame:
    """Feature frames of several sources with a domain column; names default to file stems. A single path is a folder
    that holds a table for each domain, read in one scan."""
    if isinstance(paths, str):
        return domain_features(read_domain_folder(spark, paths), window_seconds)
    if isinstance(paths, Mapping):
        named = dict(paths)
    else:
        paths = list(paths)
        if not paths:
            raise ValueError("no domain is given")
        names = list(domain_names) if domain_names is not None else [PurePath(p).stem for p in paths]
        if len(names) != len(paths):
            raise ValueError(f"{len(names)} domain names for {len(paths)} paths")
        named = dict(zip(names, paths))
    return tag_domains({n: read_table(spark, p) for n, p in named.items()}, window_seconds)
