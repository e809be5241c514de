"""Release-note segmentation (X11): split notes into items and keep the items
that the app's previous version did not list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.plans import ordered as O


def note_items(notes: DataFrame) -> DataFrame:
    """One row per non-empty line (bullet marker and surrounding space removed)."""
    lines = notes.select("app_id", "version", F.posexplode(F.split("notes", "\n")).alias("pos", "line"))
    item = F.regexp_replace(F.regexp_replace("line", r"^\s*[-*•]\s*", ""), r"^\s+|\s+$", "")
    return (lines.select("app_id", "version", "pos", item.alias("item"))
                 .where(F.col("item") != "")
                 .withColumn("item_key", F.lower("item")))


def new_items(notes: DataFrame) -> DataFrame:
    """Items of each version absent from the previous version of the same app
    (first versions: every item).  Items are matched with an anti join on
    (app, previous version, item key)."""
    items = note_items(notes)
    versions = notes.select("app_id", "version").distinct()
    # predecessor per app via the segmented scan: an app with very many versions
    # is split into version ranges instead of one window partition
    prev = O.with_prev(versions, ["app_id"], "version", ["version"], ["version"]) \
        .select("app_id", "version", F.col("prev.version").alias("prev_version"))
    cur = items.join(prev, ["app_id", "version"])
    old = items.select("app_id", F.col("version").alias("prev_version"), "item_key")
    return cur.join(old, ["app_id", "prev_version", "item_key"], "left_anti") \
              .select("app_id", "version", "pos", "item")
