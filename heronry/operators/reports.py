"""Counts that a run shows: what was read, matched, planned and written, by export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions import expr as x
from heronry.operators.redact import redact_filename


def reconcile_report(items: DataFrame, media: DataFrame, orphans: DataFrame | None = None, dups: DataFrame | None = None, unparsed: DataFrame | None = None) -> DataFrame:
    """A row for each export: entries by outcome, media files, those that no entry took, and the side lists' sizes.

    items: export_id, entry_index, uuid, confidence, reason. files is always paired plus unclaimed.
    """
    n = lambda c: F.count_if(c)
    reason = F.col("reason")
    counts = items.groupBy("export_id").agg(
        F.count(F.lit(1)).alias("entries"), n(F.col("confidence") == "exact").alias("exact"), n(F.col("confidence") == "ambiguous").alias("ambiguous"),
        n(reason == "no_media").alias("no_media"), n(reason == "no_date").alias("no_date"), n(reason == "scan_incomplete").alias("scan_incomplete"), F.count("uuid").alias("paired"),
    )
    out = counts.join(media.groupBy("export_id").agg(F.count(F.lit(1)).alias("files")), "export_id", "full")
    for name, side in (("orphans", orphans), ("duplicates", dups), ("unparsed", unparsed)):
        if side is not None:
            out = out.join(side.groupBy("export_id").agg(F.count(F.lit(1)).alias(name)), "export_id", "left")
    out = out.fillna(0)
    return out.withColumn("unclaimed", F.col("files") - F.col("paired"))


def plan_counts(plan: DataFrame, sections: DataFrame, named: DataFrame) -> DataFrame:
    """Planned, deferred and excluded rows by export, what came of the history (absent, joined_nothing, joined), and
    whether the run is partial, that is, defers something."""
    counts = plan.groupBy("export_id").agg(*(F.count_if(F.col("disposition") == d).alias(d) for d in ("planned", "deferred", "excluded")))
    state = sections.filter("file = 'chat_history.json'").select("export_id", "state")
    joined = named.filter("outcome = 'named'").groupBy("export_id").agg(F.count(F.lit(1)).alias("named"))
    out = counts.join(state, "export_id", "left").join(joined, "export_id", "left").fillna(0, ["named"])
    history = F.when(F.coalesce("state", F.lit("absent")) == "absent", "absent").when(F.col("named") == 0, "joined_nothing").otherwise("joined")
    return out.select("export_id", "planned", "deferred", "excluded", "named", history.alias("history"), (F.col("deferred") > 0).alias("partial"))


def overview(sections: DataFrame, entries: DataFrame, messages: DataFrame, friends: DataFrame) -> DataFrame:
    """A row for each export: counts of entries, messages and friends (null unless the file is loaded) with the
    files' states, and the span of years."""
    states = sections.groupBy("export_id").agg(*(F.max(F.when(F.col("file") == f, F.col("state"))).alias(s) for f, s in (("memories_history.json", "entries_state"), ("chat_history.json", "messages_state"), ("friends.json", "friends_state"))))
    count = lambda t, n: t.groupBy("export_id").agg(F.count(F.lit(1)).alias(n))
    years = entries.select("export_id", F.col("date.year").alias("y")).unionByName(messages.select("export_id", x.resolved_created(F.col("created"), F.col("created_epoch_ms"))["year"].alias("y")))
    out = states.join(count(entries, "entries"), "export_id", "left").join(count(messages, "messages"), "export_id", "left").join(count(friends, "friends"), "export_id", "left")
    for c in ("entries", "messages", "friends"):
        out = out.withColumn(c, F.when(F.col(f"{c}_state") == "loaded", F.coalesce(c, F.lit(0))))
    return out.join(years.groupBy("export_id").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year")), "export_id", "left")


def year_span(rows: DataFrame, key: str, moment: str) -> DataFrame:
    """The first and last year of each key's moments."""
    return rows.groupBy(key).agg(F.min(F.year(moment)).alias("first_year"), F.max(F.year(moment)).alias("last_year"), F.count(F.lit(1)).alias("n"))


def section_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """export_id, section and number of rows of each table; tables: name to rows with export_id."""
    parts = [t.groupBy("export_id").agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit(name)) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("export_id", "section", "n")


def story_totals(stories: DataFrame) -> DataFrame:
    """Views and replies by export, as decimals that stop at the largest unsigned 64-bit number."""
    top = F.lit("18446744073709551615").cast("decimal(38,0)")
    total = lambda c: F.least(F.coalesce(F.sum(F.col(c).cast("decimal(28,0)")), F.lit(0)), top).alias(c)
    return stories.groupBy("export_id").agg(F.count(F.lit(1)).alias("stories"), total("story_views"), total("story_replies"))


def _seen() -> Column:
    return F.array_sort(F.array_union("zips", "folders"))


def _missing(seen: Column) -> Column:
    return F.array_except(F.sequence(F.lit(1).cast("long"), F.array_max(seen)), seen)


def missing_parts(parts: DataFrame) -> DataFrame:
    """id, the numbers seen in any form, and those from 1 to the largest that are not. parts: id, zips, folders."""
    return parts.select("id", _seen().alias("seen"), _missing(_seen()).alias("missing"))


def source_state(parts: DataFrame, exports: DataFrame) -> DataFrame:
    """For each export none, or one with its counts of archives and folders and its missing parts."""
    have = parts.select(F.col("id").alias("export_id"), F.size("zips").alias("zips"), F.size("folders").alias("unpacked"), _missing(_seen()).alias("missing"))
    out = exports.join(have, "export_id", "left")
    return out.withColumn("state", F.when(F.col("zips").isNull(), "none").otherwise("one"))


def mask_name(c):
    """A file name's pattern: letters as a, digits as 9, runs of twelve at most."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{L}", "a"), r"[0-9]", "9"), "a{12,}", "a" * 12), "9{12,}", "9" * 12)


def pattern_census(names: DataFrame, examples: int = 3, name_col: str = "name", seconds: int = 0) -> DataFrame:
    """pattern, count, and examples: the first names by order, at most that many for each pattern, rendered so that no
    part of a name but known words and endings survives (see redact.redact_filename)."""
    rows = names.select(F.col(name_col).alias("name"), mask_name(F.col(name_col)).alias("pattern")).filter("name is not null")
    counts = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    few = rows.distinct().withColumn("k", F.row_number().over(Window.partitionBy("pattern").orderBy("name"))).filter(F.col("k") <= examples)
    shown = few.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("k", redact_filename(F.col("name"), seconds).alias("name")))).alias("e"))
    return counts.join(shown.select("pattern", F.col("e.name").alias("examples")), "pattern")


def top_patterns(census: DataFrame, k: int) -> DataFrame:
    """The k most frequent patterns, ties by pattern."""
    return census.orderBy(F.desc("n"), "pattern").limit(k)


def run_report(plan: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """By export: fixed and failed in this run, skipped (done before), deferred and excluded rows of the plan."""
    key = ["export_id", "source_id"]
    both = plan.join(before.select(*key, F.col("status").alias("was")), key, "left").join(after.select(*key, F.col("status").alias("now"), "retry_count"), key, "left")
    planned = F.col("disposition") == "planned"
    return both.groupBy("export_id").agg(
        F.count_if(planned & (F.col("now") == "done") & ~F.col("was").eqNullSafe(F.lit("done"))).alias("fixed"), F.count_if(planned & (F.col("now") == "failed")).alias("failed"),
        F.count_if(planned & (F.col("was") == "done") & (F.col("now") == "done")).alias("skipped"), F.count_if(F.col("disposition") == "deferred").alias("deferred"), F.count_if(F.col("disposition") == "excluded").alias("excluded"),
    )


def history_report(documents: DataFrame, with_links: bool) -> DataFrame:
    """By export: conversations, documents, html documents, and how html media were linked. documents: export_id, conversation, format."""
    return documents.groupBy("export_id").agg(F.countDistinct("conversation").alias("conversations"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("format") == "html").alias("html"), F.lit("manifest" if with_links else "no_manifest").alias("links"))


def known_files(sections: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known files that a delivery lacks, and files present that are not known. present: export_id, file."""
    known = sections.select("export_id", "file").distinct()
    here = present.select("export_id", "file").distinct()
    return known.subtract(here), here.subtract(known)
