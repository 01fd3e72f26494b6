"""Exact dedup by distributed MSD radix partitioning of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import binary, cut, restrict

#: Byte offsets between which the rounds compare; later rounds go on from the last by this factor.
CUTS = (0, 24, 256, 2048)
FACTOR = 8
#: From this round on, documents still in a group carry the rest of their text along, and the corpus isn't read again.
CARRY = 2
#: What a row is known by between rounds: its id, whether that is null, and, for rows that repeat an id, a hash.
_ROW = ["i", "z", "h"]
#: Bytes of the longest value there is.
LONGEST = (1 << 31) - 1


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = binary(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("i"), F.col(id_col).isNull().alias("z"), F.xxhash64(t).alias("h"), t.alias("t"))


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of equal texts with more than one row: (i, z, h, keep_id, group_size, same), one row for each id and text.

    i is the id (0 if null), z whether it is null, h a hash of the text, same the number of rows with that id and text.

    Documents are split by successive bytes, most significant first. A round takes the next run of
    bytes of every document still in a group, splits each group by them, and lets go of documents
    that are alone. A group whose texts end within the run holds equal texts: no digest decides, and
    each group has a number of its own. A round costs one aggregation (counted before its shuffle, so
    that a hot group is one row for each task) and one join back, which may be split where it is
    skewed. Runs grow by a factor, so that each byte is compared once and the number of rounds is the
    logarithm of the longest text. After the first rounds, few documents but copies are left; they
    take the rest of their text along.

    A null text counts as empty, a null id as the smallest. An empty table gives no rows. Other columns
    are not read.
    """
    rows = _rows(docs, id_col, text_col).withColumn("at", F.lit(0))
    found, start, stop, number, on = [], CUTS[0], CUTS[1], 0, None
    while True:
        here = F.lit(start) - F.col("at")
        runs = rows if on is None else restrict(rows.where(F.octet_length("t") > here), on, _ROW, "inner")
        if on is None:
            runs = runs.withColumn("g", F.lit(0).cast("long"))
        if number == CARRY:
            rows = cut(runs.withColumns({"t": F.substring("t", start + 1, LONGEST), "at": F.lit(start)}).drop("g"))
            runs, here = restrict(rows, on, _ROW, "inner"), F.lit(0)
        run = F.substring("t", here + 1, F.lit(stop - start))
        cand = cut(runs.select("doc_id", *_ROW, "g", run.alias("run"), (F.octet_length("t") <= here + (stop - start)).alias("ended")))
        # Cut off, so that the join has a shuffle of its own on either side, which may be split where a group is hot.
        split = cand.groupBy("g", "run", "ended").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).where("n > 1")
        split = cut(split.withColumn("number", F.monotonically_increasing_id()))
        kept = cand.join(split, ["g", "run", "ended"]).groupBy(*_ROW, "number", "ended", "n", "top").agg(F.count("*").alias("same"))
        kept = cut(kept)
        found.append(kept.where("ended").select(*_ROW, F.col("top").alias("keep_id"), F.col("n").alias("group_size"), "same"))
        on = cut(kept.where("not ended").select(*_ROW, F.col("number").alias("g")))
        if on.isEmpty():
            break
        number += 1
        start, stop = stop, CUTS[number + 1] if number + 1 < len(CUTS) else stop * FACTOR
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return cut(out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. The digest is output only; it decides nothing.
    Null text: empty. Null id: smaller than any other; texts without any id have a null keep_id. Rows
    that repeat an id and a text each count in the size of their group, and have the same answer.
    """
    groups = radix_groups(docs, id_col, text_col)
    base = _rows(docs, id_col, text_col).select("doc_id", *_ROW, F.sha2("t", 256).alias("text_sha256"))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return restrict(base, groups, _ROW, "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class of equal texts, that with the largest id (null: smallest); all columns stay.

    Of rows that repeat an id and a text any one stays, whatever their other columns hold.
    """
    groups = radix_groups(docs, id_col, text_col)
    # The caller's row is one struct, so that no name of its columns can meet one of those used here.
    i = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    named = docs.select(F.struct("*").alias("row"), i.alias("i"), F.col(id_col).isNull().alias("z"), F.xxhash64(binary(text_col)).alias("h"))
    top = F.when(F.col("z"), F.col("keep_id").isNull()).otherwise(F.col("keep_id") == F.col("i"))
    rest = restrict(named, cut(groups.where(~top).select(*_ROW)), _ROW, "left_anti")
    twins = cut(groups.where(top & (F.col("same") > 1)).select(*_ROW))
    if not twins.isEmpty():
        once = restrict(rest, twins, _ROW, "left_semi").dropDuplicates(_ROW)
        rest = restrict(rest, twins, _ROW, "left_anti").unionByName(once)
    return rest.select("row.*")
