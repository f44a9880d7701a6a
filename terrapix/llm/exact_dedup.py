"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, prepare, release, stored

#: ASCII white space, every run of which counts as one space.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def exact_dedup(df: DataFrame) -> DataFrame:
    """Every document with the one that stays for its text.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when identical after each run of ASCII
    white space became one space; null counts as empty, so null, "" and no other text form one group. Rows of a group
    that differ from the kept row in spite of equal hashes form groups of their own, by their bytes. An empty table
    gives an empty result; other columns are ignored. A row that repeats a doc_id is a row of its text's group like any
    other; rows that repeat both id and text can't be told apart, so they are kept or not together. Rows without doc_id
    are left out.
    """
    prepare(df.sparkSession)
    texts = documents(df).withColumn("th", F.xxhash64("text"))
    norm = texts.select("doc_id", "th", normalised(F.col("text")).alias("norm"))
    hashed = stored(norm.select("doc_id", "th", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "op8-hashes")
    groups = hashed.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size")).where("size > 1")
    groups = stored(groups, "op8-groups")  # so the joins below see how large each side is, and can split hot groups
    rows = hashed.drop("th").join(groups, "h", "left").withColumn("size", F.coalesce("size", F.lit(1))).withColumn("keep_id", F.coalesce("keep_id", "doc_id"))
    sha = F.lower(F.hex("sha")).alias("text_sha256")

    # Bytes are compared along a star, each copy with the row that its group keeps. Just the texts of groups are kept.
    members = stored(hashed.join(groups, "h").select("doc_id", "th", "h", "keep_id"), "op8-members")
    own = texts.join(members.distinct().hint("merge"), ["doc_id", "th"])  # alike at every size
    own = stored(own.select("doc_id", "h", "keep_id", normalised(F.col("text")).alias("norm")), "op8-texts")
    kept = own.where("doc_id = keep_id").dropDuplicates(["h"]).select("h", F.col("norm").alias("kept_norm"))
    odd = stored(own.where("doc_id <> keep_id").join(stored(kept, "op8-kept"), "h").where("norm <> kept_norm").drop("kept_norm"), "op8-collisions")
    release(members, own)
    if odd.isEmpty():
        return rows.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("doc_id") == F.col("keep_id")).alias("kept"), sha)
    fewer = odd.groupBy("h").agg(F.count("*").alias("away"))
    other = odd.groupBy("h", "norm").agg(F.min("doc_id").alias("own_keep"), F.count("*").alias("own_size"))
    other = odd.join(other, ["h", "norm"]).select("doc_id", "h", "own_keep", "own_size").distinct()
    rows = rows.join(fewer, "h", "left").join(other, ["doc_id", "h"], "left")
    keep = F.coalesce("own_keep", "keep_id")
    size = F.coalesce("own_size", F.col("size") - F.coalesce("away", F.lit(0)))
    return rows.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), (F.col("doc_id") == keep).alias("kept"), sha)
