"""URL filters as a temporal join: list entries become validity intervals (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_by_size

#: Parts into which the time that the captures span is cut; an interval is copied to each part that it meets.
PARTS = 64
#: Lookups of one key within a part of the time that one task gets, unless they are less than a 10,000th of all.
LOOKUPS = 10_000

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"


def host(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and last dot; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", ""), F.lit(""))


def suffixes(host_: Column) -> Column:
    """The host and its parent domains, longest first (``a.b.c``: ``a.b.c, b.c, c``); none for an empty host."""
    parts = F.split(host_, r"\.")
    return F.when(host_ == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """``key, action, since, until`` from dated ``key, action, listed``: each entry holds until the key's next one.

    Of entries with the same key and date the last by action holds; action
    ``remove`` ends the one before and holds nothing itself. ``until`` is null
    for the latest. Rows without key, date or action are passed over.
    """
    days = entries.filter("key IS NOT NULL AND listed IS NOT NULL AND action IS NOT NULL").groupBy("key", "listed").agg(F.max("action").alias("action"))
    ends = days.withColumn("until", F.lead("listed").over(W.partitionBy("key").orderBy("listed")))
    return ends.filter("action != 'remove'").select("key", "action", F.col("listed").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, host, fetched, matched, action, since, blocked`` for every capture.

    ``captures``: ``id, url, fetched`` (whole time units, also negative); ``entries``:
    ``key, action, listed``, action ``block``, ``allow`` or ``remove``. A capture meets
    the entries for its host and parent domains that are active when it was
    fetched; the most specific decides, so a host's ``allow`` lifts a block of
    its domain. Without an active entry (or with a null or hostless URL or no
    fetch time) ``matched``, ``action`` and ``since`` are null and nothing is
    blocked. Rows that repeat, with another URL or wholly, are evaluated each
    time; an empty table of captures gives no rows, one of entries blocks nothing.
    Other columns are not read. Hosts may have any number of labels, URLs any length.

    Keys of captures are first reduced to distinct (host, time) pairs, so a host
    with a third of all captures is looked up once a time unit. The time from the
    first to the last capture is cut into PARTS, and intervals are dealt to the
    parts that they meet: a key with a long history meets only what was active near
    a capture. Lookups of a key with many hosts are dealt to several tasks, each
    with that key's intervals. The answer goes back to captures by host and time.
    """
    rows = captures.select("id", host(F.col("url")).alias("host"), F.col("fetched").cast("long").alias("fetched"))
    asked = rows.filter("host != '' AND fetched IS NOT NULL").groupBy("host", "fetched").agg(F.count(F.lit(1)).alias("captures"))
    first, last = asked.agg(F.min("fetched"), F.max("fetched")).first()
    first, last = first or 0, last or 0
    width = (last - first) // PARTS + 1
    part = lambda time: F.floor((time - F.lit(first)) / F.lit(width)).cast("int")
    keys = asked.select("host", "fetched", F.explode(suffixes(F.col("host"))).alias("key"), part(F.col("fetched")).alias("part"))
    spans = intervals(entries).withColumn("to", F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last))).filter((F.col("since") <= F.col("to")) & (F.col("to") >= first))
    spans = spans.withColumn("part", F.explode(F.sequence(part(F.greatest("since", F.lit(first))), part(F.col("to"))))).drop("to")
    asks = keys.groupBy("key", "part").agg(F.count(F.lit(1)).alias("asks"))
    most = max(LOOKUPS, keys.count() // 10_000)
    hot = F.broadcast(asks.filter(F.col("asks") > most).select("key", "part", F.ceil(F.col("asks") / most).cast("int").alias("lots")))  # 10,000 at most
    lots = F.coalesce("lots", F.lit(1))
    dealt = keys.join(hot, ["key", "part"], "left").withColumn("lot", F.pmod(F.xxhash64("host", "fetched"), lots).cast("int")).drop("lots")
    copied = spans.join(hot, ["key", "part"], "left").withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("lots")
    active = dealt.join(copied, ["key", "part", "lot"]).filter("since <= fetched AND (until IS NULL OR fetched < until)")
    found = active.groupBy("host", "fetched").agg(F.max(F.struct(F.length("key").alias("size"), "key", "action", "since")).alias("best"))
    answers = asked.join(found, ["host", "fetched"], "left")
    alone = rows.filter("host = '' OR fetched IS NULL").withColumn("best", F.lit(None).cast(found.schema["best"].dataType))
    joined = join_by_size(rows.filter("host != ''"), answers, ["host", "fetched"], "captures").select("id", "host", "fetched", "best").unionByName(alone.select("id", "host", "fetched", "best"))
    return joined.select("id", "host", "fetched", F.col("best.key").alias("matched"), F.col("best.action").alias("action"), F.col("best.since").alias("since"),
                         F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"))
