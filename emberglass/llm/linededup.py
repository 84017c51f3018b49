"""Line dedup over overlapping three-line windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberglass.storage import Scratch

WINDOW = 3


def _windows(lines: Column) -> Column:
    """(pos, h1, h2) for each run of WINDOW lines that are not all blank; 128 bits of hash tell runs apart."""

    def at(i: Column) -> Column:
        run = [F.get(lines, i + k) for k in range(WINDOW)]
        blank = F.trim(F.concat(*run)) == ""
        return F.struct(i.cast("int").alias("pos"), F.xxhash64(*run).alias("h1"), F.xxhash64(F.lit("line"), *run).alias("h2"), blank.alias("blank"))

    n = F.size(lines)
    each = F.transform(F.sequence(F.lit(0), n - WINDOW), at)
    return F.filter(F.when(n >= WINDOW, each), lambda x: ~x["blank"])


def dedup_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col less repeated lines, and the added columns n_lines and removed_lines (long).

    Lines end at a line feed and are compared exactly. A window of three consecutive lines that occurs before, by
    ascending (id, text's hash, position) with null ids first, is a repeat; the positions that repeats cover are merged
    and their lines removed. The first occurrence of every line stays somewhere: what removes a line stands earlier.
    Windows of blank lines only are no repeats. Texts of fewer than three lines, empty and null ones stay as they are
    (a null has 0 lines). Rows with the same id and text are one occurrence: they all stay, alike. Other columns are
    kept; columns named n_lines or removed_lines are replaced. A window that very many documents share is counted by
    partial aggregates, and its join can be split.
    """
    rows = docs.drop("n_lines", "removed_lines")
    lines = F.split(F.col(text_col), "\n", -1)
    doc = [F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th")]
    # split once, in a projection of its own: an expression within a lambda is computed anew for every line
    split = rows.select(*doc, lines.alias("_lines"))
    windows = split.select("_id", "_th", F.explode(_windows(F.col("_lines"))).alias("w")).select("_id", "_th", "w.pos", "w.h1", "w.h2")
    windows = scratch.save(windows, "windows")
    place = F.struct("_id", "_th", "pos")
    repeats = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    later = windows.join(repeats.select("h1", "h2", "first"), ["h1", "h2"]).filter(place > F.col("first"))
    covered = later.groupBy("_id", "_th").agg(F.collect_set("pos").alias("at"))
    runs = F.flatten(F.transform("at", lambda p: F.array(*[p + k for k in range(WINDOW)])))
    covered = covered.select(F.col("_id").alias("_cid"), F.col("_th").alias("_cth"), F.array_distinct(runs).alias("_gone"))
    whole = rows.select(F.struct("*").alias("row"), *doc)  # no name of docs can clash
    joined = whole.join(covered, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_th") == F.col("_cth")), "left")
    old = F.col(f"row.`{text_col}`")
    joined = joined.withColumn("_lines", F.split(old, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), old).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    n = F.when(old.isNull(), 0).otherwise(F.size("_lines")).cast("long")
    out = [(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in rows.columns]
    return joined.select(*out, n.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("removed_lines"))
