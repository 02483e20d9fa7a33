"""Message histories merged into one ordered timeline for each conversation, and written as transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions import expr as x
from heronry.operators.places import MOST, numbered
from heronry.sources.named_files import write_named

FORMATS = {"json": "json", "csv": "csv", "text": "txt", "html": "html"}
CSV_HEADER = "kind,from,is_sender,media_type,created,content,media_ids,conversation_title"


def _stamp(df: DataFrame) -> Column:
    return x.resolved_created(F.col("created"), F.col("created_epoch_ms"))


def _order() -> list[Column]:
    """Resolved time with unknown last, raw epoch with unknown first, chats before snaps, place in the history."""
    return [F.col("resolved").asc_nulls_last(), F.col("created_epoch_ms").asc_nulls_first(), F.col("source"), F.col("pos")]


def merge_timeline(chat: DataFrame, snap: DataFrame, most: int = MOST) -> DataFrame:
    """Both histories with ``resolved`` (the stated time, else the epoch's) and ``seq``, from 1 in each conversation.

    Either history may lack a conversation. A conversation of up to ``most`` messages is one window; longer ones are
    numbered by ranges of their order, no task holding more than some ``most`` messages.
    """
    rows = chat.unionByName(snap, allowMissingColumns=True)
    rows = rows.withColumn("resolved", _stamp(rows))
    return numbered(rows, ["export_id", "conversation"], _order(), "seq", most)


def ordered_timeline(chat: DataFrame, snap: DataFrame) -> DataFrame:
    """The merged rows without numbers, conversations together and in order within partitions, for bulk output."""
    rows = chat.unionByName(snap, allowMissingColumns=True)
    rows = rows.withColumn("resolved", _stamp(rows))
    return rows.repartition("export_id", "conversation").sortWithinPartitions("export_id", "conversation", *_order())


def conversation_title(timeline: DataFrame) -> DataFrame:
    """The first title in the order of each timeline; null if none is stated."""
    return timeline.groupBy("export_id", "conversation").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("title"))


def picker(timeline: DataFrame) -> DataFrame:
    """Conversations in the order of a list for people, with their ``place`` in their export's list: title, else key,
    without regard to case; ties by key."""
    titled = conversation_title(timeline).withColumn("label", F.coalesce("title", "conversation"))
    order = [F.lower("label"), F.col("conversation")]
    return titled.withColumn("place", F.row_number().over(Window.partitionBy("export_id").orderBy(*order))).orderBy("export_id", "place")


def resolve_links(timeline: DataFrame, items: DataFrame) -> DataFrame:
    """timeline with ``links``: for each media token in order the file name of its finished item, or null.

    A token that has no canonical form looks for its own spelling.
    """
    key = ["export_id", "conversation", "seq"]
    tokens = timeline.select(*key, F.posexplode(x.media_tokens(F.col("media_ids"))).alias("i", "t")).withColumn("source_id", F.coalesce(x.history_token(F.col("t")), F.col("t")))
    done = items.filter((F.col("kind") == "chat_media") & (F.col("status") == "done") & F.col("output_path").isNotNull()).select("export_id", "source_id", x.base_name(F.col("output_path")).alias("file"))
    found = tokens.join(done, ["export_id", "source_id"], "left").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "file"))), lambda s: s["file"]).alias("links"))
    return timeline.join(found, key, "left")


def _created() -> Column:
    return x.stamp_text(F.col("resolved"))


def csv_row() -> Column:
    """A timeline row as a line of CSV without its end."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    fields = [F.col("source"), empty(F.col("sender")), F.col("is_sender").cast("string"), F.col("media_type"), empty(_created()), empty(F.col("content")), empty(F.col("media_ids")), empty(F.col("title"))]
    return F.concat_ws(",", *(x.csv_field(f) for f in fields))


def _lines_of(c: Column) -> Column:
    """Lines as text tools count them: an end of line closes a line and opens none, and a CR before it goes."""
    return F.transform(F.split(F.regexp_replace(c, r"\n\z", ""), "\n"), lambda s: F.regexp_replace(s, r"\r\z", ""))


def text_block() -> Column:
    """A timeline row as a head line and quoted lines, each with its end."""
    head = F.concat(F.lit("["), F.coalesce(_created(), F.lit("no date")), F.lit("] "), F.coalesce("sender", F.lit("unknown")), F.lit(" ("), F.col("source"), F.lit(" "), F.col("media_type"), F.when(F.col("is_sender"), ", sent)\n").otherwise(", received)\n"))
    body = F.array_join(F.transform(_lines_of(F.col("content")), lambda s: F.concat(F.lit("> "), s, F.lit("\n"))), "")
    return F.concat(head, F.coalesce(F.when(F.col("content") != "", body), F.lit("")))


def json_record() -> Column:
    """A timeline row as a struct whose null fields JSON leaves out."""
    return F.struct(F.col("source").alias("kind"), F.col("sender").alias("from"), "is_sender", "media_type", _created().alias("created"), "content", "media_ids", F.col("title").alias("conversation_title"))


def html_block(with_links: bool) -> Column:
    """A timeline row as an article. with_links: the row has ``links`` from resolve_links; else all media are named only."""
    e = x.html_escape
    none = e(F.col("media_type"))
    placeholder = F.concat(F.lit('<span class="media-placeholder">'), none, F.lit("</span>"))
    file = lambda f: F.when(f.isNotNull(), F.concat(F.lit('<a href="'), e(f), F.lit('">'), e(f), F.lit("</a>"))).otherwise(placeholder)
    tokens = F.transform(F.col("links"), file) if with_links else F.transform(x.media_tokens(F.col("media_ids")), lambda t: placeholder)
    media = F.array_join(tokens, "")
    wrapped = lambda before, c, after: F.coalesce(F.when(c != "", F.concat(F.lit(before), c, F.lit(after))), F.lit(""))
    return F.concat(
        F.lit('<article><p><span class="time">'), F.coalesce(e(_created()), F.lit("")), F.lit("</span> "), F.coalesce(e(F.col("sender")), F.lit("")), F.lit(' (<span class="kind">'), e(F.col("source")),
        F.lit('</span> <span class="media-type">'), none, F.lit("</span>, "), F.when(F.col("is_sender"), "sent").otherwise("received"), F.lit(")</p>"),
        wrapped('<p class="body" style="white-space: pre-wrap">', e(F.col("content")), "</p>"), wrapped('<p class="media">', media, "</p>"), F.lit("</article>"),
    )


HTML_HEAD = '<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>'
HTML_BODY, HTML_TAIL = "</title>\n</head>\n<body>\n", "\n</body>\n</html>\n"


def _rendered(fmt: str, with_links: bool) -> Column:
    return {"json": json_record, "csv": csv_row, "text": text_block, "html": lambda: html_block(with_links)}[fmt]()


def documents(timeline: DataFrame, fmt: str, with_links: bool = False) -> DataFrame:
    """export_id, conversation and the document's text in a format of FORMATS, one for each conversation.

    A document is one value and so must fit a row; write_transcripts has no such bound.
    """
    titled = F.when(F.col("title").isNotNull(), F.struct("seq", "title"))
    rows = timeline.select("export_id", "conversation", F.struct("seq", _rendered(fmt, with_links).alias("row")).alias("r"), titled.alias("t"))
    grouped = rows.groupBy("export_id", "conversation").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]).alias("rows"), F.min("t")["title"].alias("title"))
    if fmt == "json":
        body = F.to_json(F.struct("conversation", F.col("rows").alias("records")))
    elif fmt == "csv":
        body = F.concat(F.lit(CSV_HEADER + "\n"), F.array_join("rows", "\n"), F.lit("\n"))
    elif fmt == "text":
        body = F.array_join("rows", "\n")
    else:
        title = x.html_escape(F.coalesce("title", "conversation"))
        body = F.concat(F.lit(HTML_HEAD), title, F.lit(HTML_BODY), F.array_join("rows", ""), F.lit(HTML_TAIL))
    return grouped.select("export_id", "conversation", body.alias("document"))


def document_lines(timeline: DataFrame, fmt: str, with_links: bool = False) -> DataFrame:
    """export_id, conversation, place and piece: what stands in each conversation's document, a row for each message
    and for head and foot, each without the line end that closes it.

    Put together in order of place with line ends, they are the document; json and html have line ends between records.
    """
    key = ["export_id", "conversation"]
    ends = timeline.groupBy(*key).agg(F.max("seq").alias("last"), F.min(F.when(F.col("title").isNotNull(), F.struct("seq", "title")))["title"].alias("title"))
    closed = lambda c: F.regexp_replace(c, r"\n\z", "")
    if fmt == "json":
        rows = timeline.withColumn("piece", F.to_json(json_record())).join(ends.drop("title"), key)
        rows = rows.withColumn("piece", F.concat("piece", F.when(F.col("seq") < F.col("last"), ",").otherwise("")))
        name = F.regexp_replace(F.to_json(F.array("conversation")), r"^\[|\]$", "")
        head, foot = F.concat(F.lit('{"conversation":'), name, F.lit(',"records":[')), F.lit("]}")
    elif fmt == "csv":
        rows, head, foot = timeline.withColumn("piece", csv_row()), F.lit(CSV_HEADER), F.lit(None).cast("string")
    elif fmt == "text":
        rows = timeline.withColumn("piece", F.concat(F.when(F.col("seq") > 1, "\n").otherwise(""), closed(text_block())))
        head = foot = F.lit(None).cast("string")
    else:
        rows = timeline.withColumn("piece", html_block(with_links))
        head = closed(F.concat(F.lit(HTML_HEAD), x.html_escape(F.coalesce("title", "conversation")), F.lit(HTML_BODY)))
        foot = F.lit(HTML_TAIL.strip("\n"))
    frame = ends.select(*key, F.explode(F.array(F.struct(F.lit(0).cast("long").alias("place"), head.alias("piece")), F.struct((F.col("last") + 1).cast("long").alias("place"), foot.alias("piece")))).alias("f"))
    return rows.select(*key, F.col("seq").cast("long").alias("place"), "piece").unionByName(frame.select(*key, "f.*").filter("piece is not null"))


def write_transcripts(timeline: DataFrame, path: str, fmt: str, with_links: bool = False, dirs: DataFrame | None = None, record: str | None = None) -> None:
    """Each conversation's document at ``path/<export>/<dir>/history.<ext>``, where plan.document_names has it.

    dirs: export_id, conversation, dir as plan.allocate_dirs gives them; without them a folder is named by the
    conversation's key, and keys that give one name are an error. Messages are written one by one in order, so a
    conversation of any length passes through a task's memory. Documents appear when all are written; those of other
    conversations and of earlier runs stay, and one that has not changed is not touched. record: a folder to which the
    documents' paths are added, for read_landed, as in write_named.
    """
    rows = document_lines(timeline, fmt, with_links)
    if dirs is None:
        folder = x.dir_name(F.col("conversation"))
        named = timeline.select("export_id", "conversation").distinct().groupBy("export_id", folder.alias("dir")).count().filter("count > 1").limit(1).collect()
        if named:
            raise ValueError("two conversations would share a folder: allocate their directories first")
        rows = rows.withColumn("dir", folder)
    else:
        rows = rows.join(dirs.select("export_id", "conversation", "dir"), ["export_id", "conversation"])
    file = F.concat_ws("/", "export_id", "dir", F.lit(f"history.{FORMATS[fmt]}"))
    write_named(rows.select(file.alias("path"), "place", "piece"), path, record)
