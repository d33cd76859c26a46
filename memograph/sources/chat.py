"""Channel exports: users, mentions, thread documents and day documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph.plans.ranking import with_running_total

SECTION_BYTES = 1 << 20
# How the export marks a user in a text.
MENTION = r"<@(U[A-Z0-9]+)>"


def stamp(ts: Column) -> Column:
    """Epoch text with fraction to a timestamp; unreadable text gives null."""
    return F.timestamp_micros((ts.try_cast("decimal(20,6)") * 1_000_000).cast("long"))


def user_names(users: DataFrame) -> DataFrame:
    """Display name, else real name, else login, else id; blanks do not count."""
    name = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("display_name", "real_name", "name", "user_id")])
    return users.select("user_id", name.alias("shown"))


def in_scope(messages: DataFrame, as_of: Column, channels: Sequence[str] | None = None, lookback_days: int | None = 30) -> DataFrame:
    """Messages of the wanted channels (by id or name) inside the lookback."""
    out = messages
    if channels:
        out = out.filter(F.col("channel_id").isin(list(channels)) | F.col("channel_name").isin(list(channels)))
    if lookback_days:
        oldest = F.timestamp_micros(F.unix_micros(as_of) - lookback_days * 86_400_000_000)
        out = out.filter(stamp(F.col("ts")) >= oldest)
    return out


def resolve(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Adds the author's shown name and the text with user marks rewritten to @names."""
    names = user_names(users)
    author = F.coalesce(F.nullif("user", F.lit("")), F.nullif("bot_id", F.lit("")), F.lit("System"))
    marked = messages.withColumn("_author", author).join(
        names.select(F.col("user_id").alias("_author"), "shown"), "_author", "left"
    ).withColumn("user_name", F.coalesce("shown", "_author")).drop("shown", "_author")

    key = ["channel_id", "ts"]
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(MENTION), F.lit(1)))
    used = marked.select(*key, F.explode(ids).alias("user_id")).join(names, "user_id", "left")
    replacements = used.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("user_id", F.coalesce("shown", "user_id").alias("shown")))).alias("_names"))
    rewritten = F.aggregate(
        F.col("_names"), F.coalesce("text", F.lit("")),
        lambda t, n: F.replace(t, F.concat(F.lit("<@"), n["user_id"], F.lit(">")), F.concat(F.lit("@"), n["shown"])))
    return marked.join(replacements, key, "left").withColumn(
        "clean_text", F.coalesce(rewritten, "text", F.lit(""))).drop("_names")


def route(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages of threads whose parent is in the export, and messages outside threads.

    Replies without a parent in the export belong to neither.
    """
    parents = messages.filter(F.col("reply_count") > 0).select("channel_id", F.col("ts").alias("thread_key")).distinct()
    thread_key = F.when(F.col("reply_count") > 0, F.col("ts")).when(
        F.col("thread_ts").isNotNull() & (F.col("thread_ts") != F.col("ts")), F.col("thread_ts"))
    keyed = messages.withColumn("thread_key", thread_key)
    threads = keyed.join(parents, ["channel_id", "thread_key"], "left_semi")
    loose = keyed.filter(F.col("thread_key").isNull()).drop("thread_key")
    return threads, loose


def _assemble(messages: DataFrame, keys: Sequence[str], section_bytes: int) -> DataFrame:
    """Sections of each group with their lines in time order, and what holds for the whole group.

    Prefix sums of the lines' bytes cut a group where a section has `section_bytes`, so no
    list is longer than that and one line, however busy the group. Groups below the bound
    are one section.
    """
    when = stamp(F.col("ts"))
    line = F.concat("user_name", F.lit(" ["), F.date_format(when, "HH:mm:ss"), F.lit("]: "), "clean_text")
    group = [*keys, "channel_name"]
    lines = messages.select(*group, when.alias("at"), "ts", "user", "user_name", line.alias("line"))
    # Lines that are alike in all of these are interchangeable.
    placed = with_running_total(lines, group, [F.col("at"), F.col("ts"), F.col("line")], F.octet_length("line") + 1)
    sections = placed.groupBy(*group, F.floor(F.col("before") / section_bytes).alias("section")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ts", "line"))), lambda m: m["line"]), "\n").alias("body"),
        F.min("at").alias("created_time"), F.max("at").alias("last_edited_time"))
    # A long line may leave numbers out: sections are counted as they are.
    numbered = Window.partitionBy(*group).orderBy("section")
    sections = sections.withColumn("section", F.row_number().over(numbered) - 1)
    whole = lines.groupBy(*group).agg(
        F.array_sort(F.collect_set("user_name")).alias("participants"), F.count(F.lit(1)).alias("n"),
        F.min_by(F.when(F.col("user").isNull(), "System").otherwise(F.col("user_name")), F.struct("at", "ts")).alias("starter"))
    same = reduce(and_, [sections[c].eqNullSafe(whole[c]) for c in group])
    return sections.join(whole, same).select(*[sections[c] for c in sections.columns], "participants", "n", "starter")


def _part(section: Column) -> Column:
    return F.when(section > 0, F.concat(F.lit("#"), section + 1)).otherwise("")


def thread_documents(threads: DataFrame, section_bytes: int = SECTION_BYTES) -> DataFrame:
    """One document per thread, and one more for each further section of a thread beyond the bound."""
    t = _assemble(threads, ["channel_id", "thread_key"], section_bytes)
    # Id, path and title formats.
    return t.select(
        F.concat(F.lit("slack_thread_"), "channel_id", F.lit("_"), "thread_key", _part(F.col("section"))).alias("id"), F.lit("slack").alias("source"),
        F.concat("channel_id", F.lit(":"), "thread_key").alias("source_id"), F.col("channel_id").alias("parent_id"),
        F.concat(F.lit("/Slack/"), "channel_name", F.lit("/Thread_"), "thread_key").alias("path"),
        F.concat(F.lit("Slack Thread: "), "starter", F.lit(" in #"), "channel_name").alias("title"),
        F.col("body").alias("content"), "created_time", "last_edited_time",
        F.array(F.lit("slack"), F.lit("thread"), F.col("channel_name")).alias("tags"),
        F.to_json(F.struct("channel_id", "channel_name", F.col("thread_key").alias("thread_ts"), "participants",
                           (F.col("n") - 1).alias("reply_count"))).alias("metadata"),
        "participants", (F.col("n") - 1).alias("reply_count"), "channel_name",
    )


def day_documents(loose: DataFrame, section_bytes: int = SECTION_BYTES) -> DataFrame:
    """One document per channel and day of messages outside threads, and one more for each further section."""
    dated = loose.withColumn("day", F.date_format(stamp(F.col("ts")), "yyyy-MM-dd"))
    d = _assemble(dated, ["channel_id", "day"], section_bytes)
    # Id, path, title and header formats.
    return d.select(
        F.concat(F.lit("slack_chat_"), "channel_id", F.lit("_"), "day", _part(F.col("section"))).alias("id"), F.lit("slack").alias("source"),
        F.concat("channel_id", F.lit(":"), "day").alias("source_id"), F.col("channel_id").alias("parent_id"),
        F.concat(F.lit("/Slack/"), "channel_name", F.lit("/"), "day").alias("path"),
        F.concat(F.lit("Slack Chat: #"), "channel_name", F.lit(" ("), "day", F.lit(")")).alias("title"),
        F.concat(F.lit("Slack messages in #"), "channel_name", F.lit(" on "), "day", F.lit(":\n\n"), "body").alias("content"),
        "created_time", "last_edited_time",
        F.array(F.lit("slack"), F.lit("chat"), F.col("channel_name")).alias("tags"),
        F.to_json(F.struct("channel_id", "channel_name", F.col("day").alias("date"), "participants",
                           F.col("n").alias("message_count"))).alias("metadata"),
        "participants", F.col("n").alias("message_count"), "channel_name",
    )


def documents(messages: DataFrame, users: DataFrame, section_bytes: int = SECTION_BYTES) -> DataFrame:
    """Thread and day documents of an export."""
    threads, loose = route(resolve(messages, users))
    return thread_documents(threads, section_bytes).drop("reply_count").unionByName(day_documents(loose, section_bytes).drop("message_count"))
