"""The status table of items as pure functions: each takes the table and facts and gives the next table.

items: export_id, kind, source_id, status, retry_count, url, output_path, checksum, bytes, last_error, updated_at.
``now`` is an argument, so that a run can be repeated to the byte. A row that a rule leaves alone keeps its stamp.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import expr as x
from heronry.sources.named_files import content_digest, filesystem

KEY = ["export_id", "kind", "source_id"]
COLUMNS = [*KEY, "status", "retry_count", "url", "output_path", "checksum", "bytes", "last_error", "updated_at"]
SCHEMA = "export_id string, kind string, source_id string, status string, retry_count int, url string, output_path string, checksum string, bytes long, last_error string, updated_at long"
RETRY_CAP = 3
#: Notes that the rules leave on rows.
EXCLUDED_NOTE = "this build writes no output for this item"
RETIRED_NOTE = "the export no longer holds a source for this item"
RESUME_NOTES = {
    "incomplete": "it was recorded as finished without a checksum",
    "vanished": "its output file is gone",
    "unreadable": "its output file could not be read",
    "changed": "its output file does not match its checksum",
}

_NULL = {"output_path": "string", "checksum": "string", "bytes": "long", "last_error": "string", "url": "string"}


def _null(column: str) -> Column:
    return F.lit(None).cast(_NULL[column])


def _joined(items: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """items with the columns of facts under ``f``; f is null without a fact."""
    rest = [c for c in facts.columns if c not in KEY]
    f = facts.select(*KEY, F.struct(F.lit(True).alias("_"), *rest).alias("f"))
    return items.join(f, KEY, how)


def _update(items: DataFrame, facts: DataFrame, changes: dict[str, Column], now: int, unless: Column | None = None) -> DataFrame:
    """items with changes on the rows that have a fact; rows for which ``unless`` holds keep everything."""
    joined = _joined(items, facts)
    hit = F.col("f").isNotNull() if unless is None else F.col("f").isNotNull() & ~F.coalesce(unless, F.lit(False))
    changes = changes | {"updated_at": F.lit(now).cast("long")}
    return joined.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in COLUMNS))


def unknown_keys(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts about items that the table does not hold; a run checks that this is empty."""
    return facts.join(items, KEY, "left_anti").select(*KEY)


def require_known(items: DataFrame, facts: DataFrame) -> None:
    """Raise if a fact is about no item."""
    if unknown_keys(items, facts).take(1):
        raise KeyError("facts name items that the status table does not hold")


def enroll(items: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """New items are pending; known ones only take a new url, if there is one."""
    new = found.select(*KEY, F.col("url").alias("new_url"), F.lit(True).alias("seen"))
    both = items.withColumn("old", F.lit(True)).join(new, KEY, "full")
    fresh = F.col("old").isNull()
    other = ~fresh & F.col("new_url").isNotNull() & ~F.col("url").eqNullSafe(F.col("new_url"))
    return both.select(
        *KEY, F.when(fresh, "pending").otherwise(F.col("status")).alias("status"), F.when(fresh, 0).otherwise(F.col("retry_count")).cast("int").alias("retry_count"),
        F.coalesce("new_url", "url").alias("url"), "output_path", "checksum", "bytes", "last_error", F.when(fresh | other, F.lit(now).cast("long")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def mark_done(items: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """done: key, output_path, checksum, bytes. Sets the record and clears the error."""
    return _update(items, done, {"status": F.lit("done"), "output_path": F.col("f.output_path"), "checksum": F.col("f.checksum"), "bytes": F.col("f.bytes"), "last_error": _null("last_error")}, now)


def relative_paths(done: DataFrame) -> DataFrame:
    """Finished rows whose path is not absolute; a run checks that this is empty."""
    return done.filter(~F.coalesce(F.col("output_path").startswith("/"), F.lit(False)))


def _cleared() -> dict[str, Column]:
    return {c: _null(c) for c in ("output_path", "checksum", "bytes")}


def mark_failed(items: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """failed: key, note. One more try is counted, the record goes, the note stays without what could tell secrets."""
    note = x.redact_note(F.col("f.note"), F.col("url"))
    return _update(items, failed, {"status": F.lit("failed"), "retry_count": F.col("retry_count") + 1, **_cleared(), "last_error": note}, now)


def mark_source_missing(items: DataFrame, missing: DataFrame, now: int) -> DataFrame:
    """missing: key, note. The record stays; a row that says so already is not touched."""
    note = x.redact_note(F.col("f.note"), F.col("url"))
    same = (F.col("status") == "source_missing") & F.col("last_error").eqNullSafe(note)
    return _update(items, missing, {"status": F.lit("source_missing"), "last_error": note}, now, same)


def exclude(items: DataFrame, excluded: DataFrame, now: int) -> DataFrame:
    """excluded: key. The record stays; a row that is excluded already is not touched."""
    same = (F.col("status") == "excluded") & F.col("last_error").eqNullSafe(F.lit(EXCLUDED_NOTE))
    return _update(items, excluded, {"status": F.lit("excluded"), "last_error": F.lit(EXCLUDED_NOTE)}, now, same)


def reset(items: DataFrame, back: DataFrame, now: int) -> DataFrame:
    """back: key. Pending again, with no tries, record or note; the url stays."""
    return _update(items, back, {"status": F.lit("pending"), "retry_count": F.lit(0), **_cleared(), "last_error": _null("last_error")}, now)


def retire_absent(items: DataFrame, named: DataFrame, scan_gaps: DataFrame, kind: str, now: int) -> DataFrame:
    """Retire items of a kind that named (export_id, source_id) does not hold; their record stays.

    Exports with a folder that could not be read are left alone, and so are claims, done and retired rows.
    """
    gaps = scan_gaps.select("export_id").distinct()
    open_ = items.filter((F.col("kind") == kind) & ~F.col("status").isin("claimed", "done", "retired"))
    gone = open_.join(named.select("export_id", "source_id").distinct(), ["export_id", "source_id"], "left_anti").join(gaps, "export_id", "left_anti")
    return _update(items, gone.select(*KEY), {"status": F.lit("retired"), "last_error": F.lit(RETIRED_NOTE)}, now)


def enroll_reconciliation(items: DataFrame, found: DataFrame, scan_gaps: DataFrame, kind: str, now: int) -> DataFrame:
    """Take in what a reconciliation found. found: export_id, source_id, url, and reason, null for items with a source.

    New ones are enrolled, those without a source marked missing, parked ones whose source is back are reset, and
    those that nothing names any more retired. Whether an item was parked is read before anything is marked.
    """
    facts = found.withColumn("kind", F.lit(kind))
    parked = items.filter(F.col("status").isin("source_missing", "retired")).select(*KEY)
    back = facts.filter("reason is null").join(parked, KEY, "left_semi").select(*KEY)
    out = enroll(items, facts, now)
    out = mark_source_missing(out, facts.filter("reason is not null").select(*KEY, F.col("reason").alias("note")), now)
    return retire_absent(reset(out, back, now), found, scan_gaps, kind, now)


def work_list(items: DataFrame, cap: int = RETRY_CAP) -> DataFrame:
    """Items to be worked on: pending or failed with tries left. Order by source_id where it is shown."""
    return items.filter(F.col("status").isin("pending", "failed") & (F.col("retry_count") < cap))


def enumerate_items(items: DataFrame) -> DataFrame:
    """All rows but claims."""
    return items.filter(F.col("status") != "claimed")


def status_counts(items: DataFrame) -> DataFrame:
    """A row for each export and kind with a count for each status."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in x.ITEM_STATUSES]
    return items.groupBy("export_id", "kind").agg(*counts, F.count(F.lit(1)).alias("total"))


def resume(items: DataFrame, files: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Check finished items against their files: path, checksum and bytes; a null checksum is a file that can't be read.

    Those that fail go back to pending with the reason as their note. Gives the table and (key, verdict) of all
    items that were done.
    """
    done = items.filter("status = 'done'").select(*KEY, "output_path", "checksum", "bytes")
    seen = files.select(F.col("path").alias("output_path"), F.struct(F.col("checksum").alias("c"), F.col("bytes").alias("b")).alias("file"))
    checked = done.join(seen, "output_path", "left")
    verdict = (
        F.when(F.col("output_path").isNull() | F.col("checksum").isNull() | F.col("bytes").isNull(), "incomplete")
        .when(F.col("file").isNull(), "vanished").when(F.col("file.c").isNull(), "unreadable")
        .when((F.col("file.c") != F.col("checksum")) | (F.col("file.b") != F.col("bytes")), "changed").otherwise("verified")
    )
    verdicts = checked.select(*KEY, verdict.alias("verdict"))
    note = F.create_map(*(F.lit(v) for pair in RESUME_NOTES.items() for v in pair))[F.col("f.verdict")]
    bad = verdicts.filter("verdict <> 'verified'")
    return _update(items, bad, {"status": F.lit("pending"), **_cleared(), "last_error": note}, now), verdicts


def resume_report(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counts of a resumed table by export and kind: verified, sent back, and what waits or is parked."""
    key = ["export_id", "kind"]
    checked = verdicts.groupBy(*key).agg(F.count_if(F.col("verdict") == "verified").alias("verified"), F.count_if(F.col("verdict") != "verified").alias("sent_back"))
    names = ("pending", "failed", "source_missing", "retired", "excluded")
    rest = enumerate_items(items).groupBy(*key).agg(*(F.count_if(F.col("status") == s).alias(s) for s in names))
    return rest.join(checked, key, "left").fillna(0, ["verified", "sent_back"])


def file_digests(spark: SparkSession, root: str, whole: int = 1 << 30) -> DataFrame:
    """path, SHA-256 and length of all files under root. Files of up to ``whole`` bytes are values of Spark's; larger ones
    are read in pieces by tasks, which need a file system that pyarrow knows. A null digest is a file that can't be read.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                try:
                    store, inner = filesystem(path)
                    out.append(content_digest(store, inner))
                except (OSError, ValueError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string()), batch.column("bytes")], names=["path", "checksum", "bytes"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = files.filter(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("checksum"), F.col("length").alias("bytes"))
    large = files.filter(F.col("length") > whole).select("path", F.col("length").alias("bytes")).mapInArrow(digest, "path string, checksum string, bytes long")
    return small.unionByName(large).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))


def claim_directories(items: DataFrame, claims: DataFrame, now: int) -> DataFrame:
    """claims: export_id, source_id (conversation), directory. An unchanged claim keeps its stamp."""
    facts = claims.withColumn("kind", F.lit("history_export"))
    new = facts.join(items, KEY, "left_anti").select(*KEY, F.lit("claimed").alias("status"), F.lit(0).alias("retry_count"), _null("url").alias("url"), F.col("directory").alias("output_path"), _null("checksum").alias("checksum"), _null("bytes").alias("bytes"), _null("last_error").alias("last_error"), F.lit(now).cast("long").alias("updated_at"))
    same = (F.col("status") == "claimed") & F.col("output_path").eqNullSafe(F.col("f.directory"))
    changes = {"status": F.lit("claimed"), "retry_count": F.lit(0), "output_path": F.col("f.directory"), "checksum": _null("checksum"), "bytes": _null("bytes"), "last_error": _null("last_error")}
    return _update(items, facts, changes, now, same).unionByName(new)


def claims(items: DataFrame) -> DataFrame:
    """Claimed directories; rows without one are skipped."""
    held = items.filter((F.col("status") == "claimed") & F.col("output_path").isNotNull())
    return held.select("export_id", "kind", "source_id", F.col("output_path").alias("directory"))


def write_snapshot(items: DataFrame, path: str, version: int) -> None:
    """The table under path, in a folder for the version and one for each kind, and then its meta rows (version and
    export_id), so that a snapshot without meta rows is one that was not finished. An older version is never touched."""
    items.write.partitionBy("kind").mode("error").parquet(f"{path}/version={version}/items")
    items.select(F.lit(version).alias("version"), "export_id").distinct().write.mode("error").parquet(f"{path}/version={version}/meta")


def _claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file that no one else has created; False if it is there. Atomic on file systems that create
    exclusively, as local ones and HDFS do."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        store.create(target, False).close()
    except Exception as e:
        if store.exists(target):
            return False
        raise e
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_published(spark: SparkSession, path: str, version: int) -> bool:
    return _exists(spark, f"{path}/version={version}/_PUBLISHED")


def latest(spark: SparkSession, path: str) -> int:
    """The highest version that is published; 0 for none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_PUBLISHED")) if store.exists(root) else []
    return max((int(f.getPath().getParent().getName().removeprefix("version=")) for f in found), default=0)


def publish(items: DataFrame, path: str, version: int, owner: str | None = None) -> None:
    """The table as a version under path, which readers see when all of it is there.

    Versions follow one another: the one before must be the latest (0 for none). A version has one writer, the first to
    claim it; another one fails and writes nothing. The claim holds the owner's name (by default one of its own), so a
    writer that failed half way may come again under its owner's name and write anew. The mark that readers go by is made
    last.
    """
    spark = items.sparkSession
    if (now := latest(spark, path)) != version - 1:
        raise ValueError(f"version {version} does not follow the latest one, {now}")
    owner = owner or uuid.uuid4().hex
    at = f"{path}/version={version}"
    if not _claim(spark, f"{at}/_CLAIM") and not _exists(spark, f"{at}/_CLAIM.{owner}"):
        raise ValueError(f"version {version} has another writer")
    _claim(spark, f"{at}/_CLAIM.{owner}")
    items.select(*COLUMNS).write.partitionBy("kind").mode("overwrite").parquet(f"{at}/items")
    _claim(spark, f"{at}/_PUBLISHED")


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest published version of a table, or a stated one; without any, an empty table (as version 0 is)."""
    version = latest(spark, path) if version is None else version
    if version == 0:
        return spark.createDataFrame([], SCHEMA)
    if not is_published(spark, path, version):
        raise ValueError(f"version {version} is not published")
    return spark.read.schema(SCHEMA).parquet(f"{path}/version={version}/items").select(*COLUMNS)


def read_snapshot(spark, path: str, version: int, export_id: str | None = None) -> DataFrame:
    """The table of a finished snapshot. With an export_id the snapshot must hold that export alone."""
    meta = spark.read.parquet(f"{path}/version={version}/meta")
    if export_id is not None:
        check_snapshot(meta, version, export_id)
    return spark.read.parquet(f"{path}/version={version}/items").select(*COLUMNS)


def check_snapshot(meta: DataFrame, version: int, export_id: str) -> None:
    """Raise unless a snapshot's meta row (version, export_id) is of this version and export."""
    rows = meta.select("version", "export_id").distinct().limit(2).collect()
    if [tuple(r) for r in rows] != [(version, export_id)]:
        raise ValueError("the snapshot is of another version or export")


def record_violations(items: DataFrame) -> DataFrame:
    """Rows against the rule of records: set on done rows (parked ones may keep theirs), null on pending and failed."""
    full = F.col("output_path").isNotNull() & F.col("checksum").isNotNull() & F.col("bytes").isNotNull()
    none = F.col("output_path").isNull() & F.col("checksum").isNull() & F.col("bytes").isNull()
    parked = F.col("status").isin("source_missing", "retired", "excluded")
    fine = F.when(F.col("status") == "done", full).when(F.col("status").isin("pending", "failed"), none).when(parked, full | none).otherwise(F.lit(True))
    return items.filter(~fine)


def elsewhere(items: DataFrame, root: str) -> DataFrame:
    """Finished rows whose output lies outside root."""
    base = x.normalize_path(F.lit(root))
    path = x.normalize_path(F.col("output_path"))
    return items.filter((F.col("status") == "done") & F.col("output_path").isNotNull() & ~F.startswith(path, F.concat(base, F.lit("/"))))


def apply_outcomes(items: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """outcomes: key, event (done or failed), output_path, checksum, bytes, note; one for each item."""
    done = mark_done(items, outcomes.filter("event = 'done'").select(*KEY, "output_path", "checksum", "bytes"), now)
    return mark_failed(done, outcomes.filter("event = 'failed'").select(*KEY, "note"), now)


def run_plan(items: DataFrame, excluded: DataFrame, files: DataFrame, outcomes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Exclude, check finished items, and apply the outcomes of those that were due. Gives the table and a report."""
    require_known(items, excluded)
    ready, _ = resume(exclude(items, excluded, now), files, now)
    due = work_list(ready)
    after = apply_outcomes(ready, outcomes.join(due, KEY, "left_semi"), now)
    done = outcomes.join(due, KEY, "left_semi")
    report = done.groupBy("export_id", "kind").agg(F.count_if(F.col("event") == "done").alias("fixed"), F.count_if(F.col("event") == "failed").alias("failed"))
    return after, report


def fold_outcomes(events: DataFrame, cap: int = RETRY_CAP) -> DataFrame:
    """The status that each item reaches by its events in order of seq, the batch twin of the stream.

    events: key, seq, event (done, failed, reset or missing). Only what follows the last reset counts: retries
    are the failures since then, and the status is that of the last event.
    """
    g = events.withColumn("e", F.struct("seq", "event")).groupBy(*KEY).agg(F.max("e").alias("last"), F.max(F.when(F.col("event") == "reset", F.col("seq"))).alias("reset_at"), F.count(F.lit(1)).alias("n_events"))
    since = events.join(g.select(*KEY, "reset_at"), KEY).filter(F.col("reset_at").isNull() | (F.col("seq") > F.col("reset_at")))
    retries = since.groupBy(*KEY).agg(F.count_if(F.col("event") == "failed").alias("retry_count"))
    status = F.create_map(*(F.lit(v) for v in ("done", "done", "failed", "failed", "reset", "pending", "missing", "source_missing")))[F.col("last.event")]
    out = g.join(retries, KEY, "left").select(*KEY, status.alias("status"), F.coalesce("retry_count", F.lit(0)).cast("long").alias("retry_count"), "n_events")
    return out.withColumn("due", F.col("status").isin("pending", "failed") & (F.col("retry_count") < cap))
