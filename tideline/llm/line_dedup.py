"""Line dedup: windows of three consecutive lines, found again anywhere later, lose their lines.

A text's lines are what stands between line feeds. Every three consecutive lines form a window, hashed to 128
bits (two 64-bit hashes). A window's first occurrence, by (doc_id, row, line), stays; every later one covers its
three lines, and the covered lines of a text are removed after overlapping windows are merged. Windows of blank
lines only don't count.

Counting is a partial aggregation per hash, so a window that many documents share is summed where it is read. The
repeated windows are then joined with the occurrences: by broadcast for windows with very many places, by hash else.

Cases: null, empty and short texts (under three lines) have no window and stay as they are; repeated rows (same id
and text) count as one text and get the same result; rows with one id and several texts are told apart by the
text's hash; a null id sorts first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import HOT_ROWS, cut, small

SIZE = 3


def windows(documents: DataFrame) -> DataFrame:
    """(doc_id, row, line, h1, h2) of all windows that aren't blank; a repeated row gives its windows again."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("row"), F.split("text", "\n").alias("l")).where(F.size("l") >= SIZE)
    at = lambda i, j: F.get(F.col("l"), i + j)
    window = lambda x, i: F.struct(
        F.xxhash64(x, at(i, 1), at(i, 2)).alias("h1"), F.xxhash64(F.lit(SIZE), at(i, 2), x, at(i, 1)).alias("h2"),
        (F.length(F.trim(F.concat(x, at(i, 1), at(i, 2)))) > 0).alias("filled"),
    )
    hashed = rows.select("doc_id", "row", F.transform("l", window).alias("w"))
    return hashed.select("doc_id", "row", F.posexplode_outer("w").alias("line", "w")).where("w.filled").select("doc_id", "row", "line", "w.h1", "w.h2")


def covered(documents: DataFrame) -> DataFrame:
    """(doc_id, row, starts): the start lines of the windows that stand earlier somewhere else."""
    w = windows(documents)
    where = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), "row", "line")
    firsts = cut(w.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("h1", "h2", "first", "n"))
    # windows with very many places are told by broadcast; their rows then go by keys of their own, not to one task
    often = small(firsts.where(F.col("n") > HOT_ROWS).select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("often")))
    rows = w.join(often, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")), "left")
    rows = rows.withColumn("h2", F.when(F.col("often").isNull(), F.col("h2")).otherwise(F.xxhash64("doc_id", "row", "line")))
    rows = rows.join(firsts.where(F.col("n") <= HOT_ROWS).select("h1", "h2", "first"), ["h1", "h2"], "left")
    later = rows.where(where > F.coalesce("often", "first"))
    return later.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line")).alias("starts"))


def _strip(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, starts in parts:
        out = []
        for text, begins in zip(texts, starts, strict=True):
            if text is None or begins is None or len(begins) == 0:
                out.append((text, 0, 0 if text is None else text.count("\n") + 1))
                continue
            lines, kept, end, spans = text.split("\n"), [], 0, []
            for b in begins:  # sorted: merge what overlaps or touches
                if spans and b <= spans[-1][1]:
                    spans[-1][1] = b + SIZE
                else:
                    spans.append([b, b + SIZE])
            for b, e in spans:
                kept += lines[end:b]
                end = e
            kept += lines[end:]
            out.append(("\n".join(kept), len(lines) - len(kept), len(lines)))
        yield pd.DataFrame(out, columns=["text", "removed", "lines"])


def dedup_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every document, its text without the covered lines."""
    strip = F.pandas_udf(_strip, "text string, removed long, lines long")
    c = covered(documents).select(F.col("doc_id").alias("c_doc"), F.col("row").alias("c_row"), "starts")
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("row"))
    joined = rows.join(c, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("row") == F.col("c_row")), "left")
    return joined.select("doc_id", strip("text", "starts").alias("s")).select("doc_id", "s.text", F.col("s.lines").alias("n_lines"), F.col("s.removed").alias("n_removed"))
