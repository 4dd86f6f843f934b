"""Session tracks: every message once as `full` and once as `clean`.

Stored below one folder, partitioned by track and a hash bucket of the session, never by the session
itself: sessions are many and small, and one of them may be huge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietlog.functions.rules import DEFAULT_ON, MAX_TEXT_BYTES, Rules
from quietlog.functions.redact import redact
from quietlog.functions.payload import vget, vkind
from quietlog.functions.text import is_blank, let
from quietlog.operators.ranks import last_n
from quietlog.schemas import TRACK
from quietlog.session import staged

TRACKS = ("full", "clean")
BUCKETS = 256
TRIM_BYTES = 8 * 1024 * 1024
MAX_ENTRIES = 2000


def bucket_of(session: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def valid(messages: DataFrame, redact_flag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable, refused) messages: role must not be blank, full text must be there, clean text and placeholder
    exclude each other, and where redaction is asked for, full text must be within its size limit."""
    ok = ~is_blank(F.col("role")) & F.col("full_text").isNotNull()
    if redact_flag is not None:
        ok = ok & ~(F.coalesce(F.col(redact_flag), F.lit(False)) & (F.octet_length("full_text") > MAX_TEXT_BYTES))
    ok = ok & ~(F.col("clean_text").isNotNull() & (F.coalesce("placeholder", F.lit("")) != ""))
    return messages.filter(ok), messages.filter(~ok)


def metadata_strings(metadata: Column) -> Column:
    """JSON object -> map<string,string>, values as text; anything else gives an empty map."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def text(x):
        return F.when(vkind(x) == "STRING", vget(x, "$", "string")).when(vkind(x) == "VOID", "<nil>").otherwise(F.to_json(x))

    fields = let(F.try_parse_json(metadata), lambda v: F.when(vkind(v) == "OBJECT", vget(v, "$", "map<string,variant>")))
    return F.coalesce(F.transform_values(fields, lambda k, x: text(x)), empty)


def ingest(messages: DataFrame, options=DEFAULT_ON, rules: Rules = Rules(), redact_flag: str | None = None) -> DataFrame:
    """Valid messages with final clean text; `redact_flag` names a boolean column that asks for redaction.

    Redacted text fills clean_text only where neither clean text nor placeholder was given.  Rows that are too long to
    be redacted are refused by `valid`; here they would be an error rather than go into the clean track as they are.
    """
    placeholder = F.when(F.col("placeholder") != "", F.col("placeholder"))
    given = F.coalesce("clean_text", placeholder)
    if redact_flag is None:
        clean = F.coalesce(given, "full_text")
    else:
        wanted = F.coalesce(F.col(redact_flag), F.lit(False)) & given.isNull()
        auto = redact(F.when(wanted, F.col("full_text")), options, rules)
        refuse = F.raise_error(F.lit("text above the redaction limit: refuse it with valid(..., redact_flag)")).cast("string")
        clean = F.when(wanted, F.coalesce(auto["text"], refuse)).otherwise(F.coalesce(given, "full_text"))
    return messages.withColumn("clean_text", clean).withColumn("metadata", metadata_strings(F.col("metadata")))


def dual_rows(entries: DataFrame) -> DataFrame:
    """Two rows per entry: track `full` and track `clean`."""
    pair = F.array(
        F.struct(F.lit("full").alias("track"), F.col("full_text").alias("content")),
        F.struct(F.lit("clean").alias("track"), F.coalesce("clean_text", "full_text").alias("content")),
    )
    return entries.withColumn("_t", F.explode(pair)).select(
        "role", "_t.content", "timestamp_ms", "metadata", "session_id", F.col("seq").cast("long").alias("seq"), "_t.track"
    )


def append_tracks(entries: DataFrame, path: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    """Append entries to both tracks; `buckets` is a property of the table.  Rebalancing merges small pieces and splits a heavy bucket."""
    (
        dual_rows(entries)
        .withColumn("bucket", bucket_of(F.col("session_id"), buckets))
        .hint("rebalance", "track", "bucket")
        .write.mode(mode)
        .partitionBy("track", "bucket")
        .json(path)
    )


def read_track(spark: SparkSession, path: str, track: str = "clean", session: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One track; malformed lines are skipped.  A session reads only its bucket.

    `path` may hold one folder per streaming batch (`batch=<n>`).
    """
    if track not in TRACKS:
        raise ValueError("track must be 'full' or 'clean'")
    df = (
        spark.read.schema(TRACK + ", track string, bucket int")
        .option("mode", "DROPMALFORMED")
        .option("basePath", path)
        .json(path)
        .filter(F.col("track") == track)
    )
    if session is not None:
        df = df.filter((F.col("bucket") == bucket_of(F.lit(session), buckets)) & (F.col("session_id") == session))
    return df.drop("bucket", "batch")


def load_session(
    spark: SparkSession, path: str, session: str, track: str | None = None, limit: int = 0, buckets: int = BUCKETS
) -> DataFrame:
    """A session in order, optionally only its last `limit` messages; track defaults to clean."""
    df = read_track(spark, path, (track or "").strip() or "clean", session, buckets)
    if limit > 0:
        df = df.orderBy(F.desc("seq")).limit(limit)
    return df.orderBy("seq").select("session_id", "track", "seq", "role", "content", "timestamp_ms", "metadata")


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session names over both tracks."""
    names = [read_track(spark, path, t).select("session_id") for t in TRACKS]
    return names[0].unionByName(names[1]).distinct().orderBy("session_id")


def trim(
    tracks: DataFrame, max_entries: int = MAX_ENTRIES, min_bytes: int = TRIM_BYTES, line_bytes: Column | None = None
) -> DataFrame:
    """Keep the last `max_entries` rows of every (track, session) larger than `min_bytes`.

    `line_bytes`: size of a row; by default that of its JSON line.
    """
    keys = ["track", "session_id"]
    json_line = F.octet_length(F.to_json(F.struct("role", "content", "timestamp_ms", "metadata"))) + 1
    line = json_line if line_bytes is None else line_bytes
    sizes = tracks.groupBy(*keys).agg(F.sum(line).alias("bytes"), F.count("*").alias("rows"))
    large = sizes.filter((F.col("bytes") > min_bytes) & (F.col("rows") > max_entries)).select(*keys)
    small_part = tracks.join(large, keys, "left_anti")
    return small_part.unionByName(last_n(tracks.join(large, keys, "left_semi"), keys, "seq", max_entries))


LAYOUTS = {
    # layout: (glob below the folder, session in the path, track in the path)
    "files": ("*/*.jsonl", r"([^/]*)\.jsonl$", r"([^/]*)/[^/]*$"),
    "folders": ("*/session_id=*/*", r"session_id=([^/]*)/", r"([^/]*)/session_id="),
}
_LINE = "role string, content string, timestamp_ms long, metadata map<string,string>, _bad string"


def import_track_files(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    """Read JSONL tracks; `seq` is the position among the usable lines of a session file.

    layout 'files': `<path>/<track>/<session>.jsonl`; 'folders': `<path>/<track>/session_id=<session>/<one file>`.
    Lines are numbered inside each file block and shifted by the number of lines in earlier blocks,
    so a huge file is read by many tasks.  The numbers are written down once, as two readers must agree on them.
    """
    glob, session, track = LAYOUTS[layout]
    lines = (
        spark.read.text(f"{path}/{glob}")
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("block", F.col("_metadata.file_block_start"))
        .withColumn("r", F.from_json("value", _LINE, {"columnNameOfCorruptRecord": "_bad"}))
        .filter(~is_blank(F.col("value")) & F.col("r._bad").isNull())
        .withColumn("line", F.monotonically_increasing_id())
        .select("file", "block", "line", "r")
    )
    lines = staged(lines, "lines")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    # a running sum over the blocks of one file: a file of 1 TB has some thousands
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    starts = blocks.select("file", "block", (shift - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "block"]).select(
        "r.role",
        "r.content",
        "r.timestamp_ms",
        "r.metadata",
        F.regexp_extract("file", session, 1).alias("session_id"),
        (F.col("line") + F.col("shift")).alias("seq"),
        F.regexp_extract("file", track, 1).alias("track"),
    )
