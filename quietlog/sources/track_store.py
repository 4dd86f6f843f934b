"""Session tracks as sorted Parquet with a list of what is valid.

Below one folder: `data/<version>/track=<t>/bucket=<b>/`, rows sorted by session and place, so that a session is one range of row
groups of its bucket's files; `names/<version>/`, a row per track and session with its rows, bytes and last place, so that
neither listing nor measuring reads a text; and `snapshots/<number>.json`, the lists of data and name folders that
make the store.  The one with the highest number is the store.  Writers add files first and a list last, by a rename that fails if another
writer took the number; readers go on with the list they have read, until `vacuum` removes what no recent list has.

`seq` tells the rows of a session and track apart.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.operators.ranks import numbered
from quietlog.sources.tracks import BUCKETS, MAX_ENTRIES, TRACKS, TRIM_BYTES, bucket_of, dual_rows

COLUMNS = ["session_id", "seq", "role", "content", "timestamp_ms", "metadata"]
ROW = "session_id string, seq long, role string, content string, timestamp_ms long, metadata map<string,string>, bytes long, track string, bucket int"
NAME = "track string, bucket int, session_id string, rows long, bytes long, last_seq long"


class Conflict(RuntimeError):
    """Another writer has published first; what was written is not part of the store."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    #: folders of one track and bucket each, and of names, below the store
    parts: tuple[str, ...] = ()
    names: tuple[str, ...] = ()


def line_bytes() -> Column:
    """Bytes of a row's JSON line."""
    return F.octet_length(F.to_json(F.struct("role", "content", "timestamp_ms", "metadata"))) + 1


class TrackStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, size: Column | None = None):
        """`size`: bytes of a row that `trim` counts, by default those of its JSON line."""
        self.spark, self.path, self.buckets, self.size = spark, path.rstrip("/"), buckets, size
        self._java = spark._jvm.org.apache.hadoop.fs
        self._files = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *below: str):
        return self._java.Path("/".join((self.path, *below)))

    def _listed(self, *below: str) -> list[str]:
        folder = self._path(*below)
        return [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []

    # --- lists

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The store as it is, or was."""
        if number is None:
            number = max((int(n[:-5]) for n in self._listed("snapshots") if n.endswith(".json") and n[:-5].isdigit()), default=0)
        if not number:
            return Snapshot(0)
        stream = self._files.open(self._path("snapshots", f"{number}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Snapshot(number, tuple(found["parts"]), tuple(found["names"]))

    def _publish(self, base: Snapshot, parts: list[str], names: list[str]) -> Snapshot:
        new = Snapshot(base.number + 1, tuple(parts), tuple(names))
        draft, final = self._path("snapshots", f"_{uuid.uuid4().hex}"), self._path("snapshots", f"{new.number}.json")
        stream = self._files.create(draft)
        stream.write(bytearray(json.dumps({"parts": parts, "names": names}).encode()))
        stream.close()
        context = self._java.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, self.spark._sc._gateway.new_array(self._java.Options.Rename, 0))
        except Py4JJavaError as e:
            self._files.delete(draft, False)
            raise Conflict(f"snapshot {new.number} exists") from e
        return new

    # --- rows

    def _write(self, rows: DataFrame) -> tuple[list[str], list[str]]:
        """Rows (with track and bucket) as a new version: its data and name folders."""
        version = uuid.uuid4().hex
        sized = rows.select(*COLUMNS, F.coalesce("bytes", line_bytes() if self.size is None else self.size).cast("long").alias("bytes"), "track", "bucket")
        # a hot session is cut by seq, so its rows are ranges of several files
        placed = sized.repartitionByRange("track", "bucket", "session_id", "seq").sortWithinPartitions("track", "bucket", "session_id", "seq")
        placed.write.partitionBy("track", "bucket").parquet(f"{self.path}/data/{version}")
        parts = [f"data/{version}/{t}/{b}" for t in self._listed("data", version) if t.startswith("track=") for b in self._listed("data", version, t) if b.startswith("bucket=")]
        if not parts:
            return [], []
        named = self._rows(parts).groupBy("track", "bucket", "session_id").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"), F.max("seq").alias("last_seq"))
        named.write.parquet(f"{self.path}/names/{version}")
        return parts, [f"names/{version}"]

    def _rows(self, parts: list[str] | tuple[str, ...]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], ROW)
        # one base for all versions: a folder's own version stands above its partition values
        folders = {}
        for p in parts:
            folders.setdefault(p.split("/")[1], []).append(f"{self.path}/{p}")
        out = None
        for version, own in folders.items():
            rows = self.spark.read.schema(ROW).option("basePath", f"{self.path}/data/{version}").parquet(*own)
            out = rows if out is None else out.unionByName(rows)
        return out

    def append(self, entries: DataFrame) -> Snapshot:
        """Add entries, as `tracks.ingest` gives them, to both tracks."""
        base = self.snapshot()
        rows = dual_rows(entries).withColumns({"bucket": bucket_of(F.col("session_id"), self.buckets), "bytes": F.lit(None).cast("long")})
        parts, names = self._write(rows)
        return self._publish(base, [*base.parts, *parts], [*base.names, *names])

    def _of(self, at: Snapshot, track: str, bucket: int | None = None) -> list[str]:
        end = f"/track={track}/" if bucket is None else f"/track={track}/bucket={bucket}"
        return [p for p in at.parts if (end in p if bucket is None else p.endswith(end))]

    def read(self, track: str = "clean", at: Snapshot | None = None) -> DataFrame:
        if track not in TRACKS:
            raise ValueError("track must be 'full' or 'clean'")
        return self._rows(self._of(at or self.snapshot(), track)).select("track", *COLUMNS)

    def session(self, session: str, track: str | None = None, limit: int = 0, at: Snapshot | None = None) -> DataFrame:
        """A session in order, or its last `limit` rows: the files of its bucket, and in them the row groups that hold it."""
        track = (track or "").strip() or "clean"
        if track not in TRACKS:
            raise ValueError("track must be 'full' or 'clean'")
        bucket = self.spark.range(1).select(bucket_of(F.lit(session), self.buckets)).first()[0]
        rows = self._rows(self._of(at or self.snapshot(), track, bucket)).where(F.col("session_id") == session)
        if limit > 0:
            rows = rows.orderBy(F.desc("seq")).limit(limit)
        return rows.orderBy("seq").select("session_id", "track", "seq", "role", "content", "timestamp_ms", "metadata")

    def names(self, at: Snapshot | None = None) -> DataFrame:
        """track, session_id, rows, bytes, last_seq of every session; no text is read."""
        at = at or self.snapshot()
        rows = self.spark.read.schema(NAME).parquet(*(f"{self.path}/{n}" for n in at.names)) if at.names else self.spark.createDataFrame([], NAME)
        return rows.groupBy("track", "bucket", "session_id").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.max("last_seq").alias("last_seq"))

    def sessions(self, at: Snapshot | None = None) -> DataFrame:
        return self.names(at).select("session_id").distinct().orderBy("session_id")

    # --- upkeep

    def _rewritten(self, base: Snapshot, touched: list[str], rows: DataFrame) -> Snapshot:
        """A list in which `rows` stand for the folders of the touched tracks and buckets."""
        old = [p for p in base.parts if p.split("/", 2)[2] in touched]
        kept = [p for p in base.parts if p.split("/", 2)[2] not in touched]
        parts, _ = self._write(rows) if old else ([], [])
        # names of what stays, measured without its texts, and of what is new
        version = uuid.uuid4().hex
        everything = self._rows([*kept, *parts]).groupBy("track", "bucket", "session_id").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"), F.max("seq").alias("last_seq"))
        everything.write.parquet(f"{self.path}/names/{version}")
        return self._publish(base, [*kept, *parts], [f"names/{version}"])

    def trim(self, max_entries: int = MAX_ENTRIES, min_bytes: int = TRIM_BYTES) -> Snapshot:
        """Keep the last `max_entries` rows of every track of a session larger than `min_bytes`; other buckets' files stay."""
        base = self.snapshot()
        large = self.names(base).where((F.col("bytes") > min_bytes) & (F.col("rows") > max_entries)).select("track", "bucket", "session_id", F.col("rows").alias("n"))
        touched = [f"track={r.track}/bucket={r.bucket}" for r in large.select("track", "bucket").distinct().collect()]  # no more than the store has buckets
        if not touched:
            return base
        rows = self._rows([p for p in base.parts if p.split("/", 2)[2] in touched])
        keys = ["track", "session_id"]
        places = numbered(rows.select(*keys, "seq").join(large.drop("bucket"), keys), keys, ["seq"])
        cut = places.where(F.col("place") == F.col("n") - max_entries + 1).select(*keys, F.col("seq").alias("from_seq"))
        kept = rows.join(cut, keys, "left").where("from_seq is null or seq >= from_seq").drop("from_seq")
        return self._rewritten(base, touched, kept)

    def compact(self, most: int = 1) -> Snapshot:
        """One folder for every track and bucket that has more than `most`."""
        base = self.snapshot()
        count: dict[str, int] = {}
        for p in base.parts:
            count[p.split("/", 2)[2]] = count.get(p.split("/", 2)[2], 0) + 1
        touched = [k for k, n in count.items() if n > most]
        return self._rewritten(base, touched, self._rows([p for p in base.parts if p.split("/", 2)[2] in touched])) if touched else base

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove the lists before the last `keep`, and the folders that only they have."""
        numbers = sorted(int(n[:-5]) for n in self._listed("snapshots") if n.endswith(".json"))
        used = [self.snapshot(n) for n in numbers[-keep:]]
        live = {p for s in used for p in (*s.parts, *s.names)}
        dead = [self.snapshot(n) for n in numbers[:-keep]]
        gone = sorted({p for s in dead for p in (*s.parts, *s.names)} - live)
        for p in [*gone, *(f"snapshots/{s.number}.json" for s in dead)]:
            self._files.delete(self._path(p), True)
        return gone
