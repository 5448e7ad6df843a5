"""Records of large JSON envelopes, read in splits."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.shared import lookup_join, materialize
from varve.sources.splits import SPLIT, along_splits, cut

# Depths: of the objects that hold "result" and "records", and of what stands in the list of records.
LIST_DEPTH = 3
OUTER, INNER = "result", "records"
OPEN, CLOSE = "{[", "}]"


def record_texts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The text of each element of ``result.records`` as ``file, start, row, value``, in that order.

    Every file holds one envelope, however large, on any number of lines. Files are cut
    after each closing brace. Whether a piece begins in a string, and how deep, follows from the
    quotes and brackets before it: each split adds them up for itself, once for a begin outside
    of strings and once inside; the sums of the splits before it tell which holds and how deep it
    begins. Pieces between two begins at the depth of the list make up a record.

    What stands around the records of a file is put together and must be one JSON object with one
    list ``records`` in ``result``, and no string or bracket may stay open; else the job fails.
    Elements of the list must be objects. The surroundings, other than records, are few: one task
    takes those of a file.
    """
    text = F.regexp_replace("value", r"(?s)\\.", "")
    parts = F.split(text, '"')
    pieces = cut(spark, path, "}").withColumns({"flips": F.size(parts) - 1, "_parts": parts})
    outer, inner = (F.filter("_parts", taken) for taken in (lambda _, at: at % 2 == 0, lambda _, at: at % 2 == 1))
    for begun, parts in enumerate((outer, inner)):
        brackets = F.regexp_replace(F.array_join(parts, ""), r"[^\[\]{}]", "")
        ends_outside = ((F.col("flips") + begun) % 2 == 0).cast("int")
        walked = F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), _step)
        pieces = pieces.withColumn("_walked", walked)
        pieces = pieces.withColumns({f"change{begun}": F.col("_walked.at") - ends_outside, f"low{begun}": F.least("_walked.low", F.col("_walked.at") - ends_outside)})
    # The names of the changes say how a piece begins: outside (0) or inside (1) of a string.
    changes = ["change0", "change1"]
    placed = materialize(_placed(materialize(along_splits(pieces.drop("_parts", "_walked"), changes))))
    return _records(placed, materialize(_lists(placed)))


def _step(state: Column, sign: Column) -> Column:
    """The depth after a bracket, and the lowest so far; the cut has taken away all closing braces."""
    at = state["at"] + F.when(sign == "]", -1).when(sign == "", 0).otherwise(1)
    return F.struct(at.alias("at"), F.least(state["low"], at).alias("low"))


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces ``file, start, row, value`` with the depth and whether in a string, at their begins and ends."""
    flipped = F.col("flips") % 2 == 1
    ended = lambda begun: F.max_by(F.col(f"depth{begun}") + F.when(F.col("inside") == F.lit(bool(begun)), F.col("change0")).otherwise(F.col("change1")), "row")
    totals = pieces.groupBy(*SPLIT, "size").agg(
        F.sum(flipped.cast("int")).alias("quotes"),
        ended(0).alias("sum0"),
        ended(1).alias("sum1"),
        F.max("row").alias("last_row"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
    )
    file = Window.partitionBy("file")
    before = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    begun = totals.withColumn("turned", F.coalesce(F.sum("quotes").over(before), none) % 2 == 1)
    change = F.when(F.col("turned"), F.col("sum1")).otherwise(F.col("sum0"))
    splits = begun.select(
        *SPLIT, "turned", F.coalesce(F.sum(change).over(before), none).alias("base"),
        F.when(F.col("start") == F.max("start").over(file), F.col("last_row")).alias("last_row"),
        (F.sum("bytes").over(file) - F.col("size")).alias("over"),
    )
    # A row for each split, or file, goes to the pieces: these are not shuffled to meet it.
    joined = lookup_join(pieces, materialize(splits), SPLIT)
    inside = F.col("inside") != F.col("turned")
    depth = F.col("base") + F.when(F.col("turned"), F.col("depth1")).otherwise(F.col("depth0"))
    change = F.when(inside, F.col("change1")).otherwise(F.col("change0"))
    low = depth + F.when(inside, F.col("low1")).otherwise(F.col("low0"))
    last = F.col("row").eqNullSafe(F.col("last_row"))
    # Only the last piece of a file may lack the closing brace that the cut takes away: then the
    # pieces are one byte longer than the file. Of compressed files that is not known; blanks do.
    blank = F.col("value").rlike(r"^\s*$")
    bare = last & F.when(F.col("over").between(0, 1), F.col("over") == 1).otherwise(blank)
    return joined.select(
        *SPLIT, "row", "value", inside.alias("inside"), (inside != flipped).alias("ends_inside"), depth.alias("depth"),
        (depth + change).alias("end_depth"), low.alias("low"), bare.alias("bare"), last.alias("last"),
    )


def _element() -> Column:
    """Whether a piece is a further element of a list at the depth of records, or lies within one."""
    further = ~F.col("inside") & (F.col("depth") == LIST_DEPTH) & F.col("value").rlike(r"^\s*,\s*\{")
    return (further | (F.col("depth") > LIST_DEPTH)) & (F.col("low") >= LIST_DEPTH)


def _lists(placed: DataFrame) -> DataFrame:
    """Per file where its list of records opens (piece, and place in it) and the piece that closes it."""
    around = placed.filter(~_element() | F.col("last"))
    listed = around.groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("start", "row", "value", "depth", "inside", "bare", "ends_inside", "end_depth"))).alias("p")
    )
    found = listed.select("file", "p", _around("p.value", "p.depth", "p.inside", "p.bare").alias("found"))
    failed = F.raise_error(F.concat(F.col("found.error"), F.lit(" in "), F.col("file"))).cast("int")
    place = lambda at: F.struct(F.get("p.start", at).alias("start"), F.get("p.row", at).alias("row"))
    opens = F.when(F.col("found.error").isNotNull(), failed).otherwise(F.col("found.opens"))
    return found.select(
        "file", place(opens).alias("opens"), F.col("found.at").alias("at"), place(F.col("found.closes")).alias("closes")
    )


@F.pandas_udf(
    T.StructType()
    .add("error", T.StringType())
    .add("opens", T.IntegerType())
    .add("at", T.IntegerType())
    .add("closes", T.IntegerType())
)
def _around(value: pd.Series, depth: pd.Series, inside: pd.Series, bare: pd.Series) -> pd.DataFrame:
    rows = [_scan(*one) for one in zip(value, depth, inside, bare)]
    return pd.DataFrame(rows, columns=["error", "opens", "at", "closes"], dtype=object)


def _scan(values, depths, insides, bares):
    """Follow the pieces around the records; elements at the depth of records become empty ones."""
    skeleton, keys, text, lists, opened = [], {}, None, [], None
    depth, inside = 0, False
    for at, (value, starts, begins_inside, bare) in enumerate(zip(values, depths, insides, bares)):
        if starts != depth or begins_inside != inside:
            # Between two of these pieces there are only elements of a list, or parts of one.
            if depth < LIST_DEPTH:
                return ("brackets that do not match", None, None, None)
            depth, inside, text = int(starts), bool(begins_inside), None
        escaped = False
        for place, sign in enumerate(value + ("" if bare else "}")):
            if inside:
                text = text + sign if text is not None else None
                inside = escaped or sign != '"'
                escaped = sign == "\\" and not escaped
                kept = depth <= LIST_DEPTH
            else:
                kept = depth <= LIST_DEPTH
                if sign == '"':
                    inside, text = True, ""
                elif sign == ":" and text is not None:
                    keys[depth] = text[:-1]
                elif sign in OPEN:
                    depth += 1
                    keys.pop(depth, None)
                    if depth > LIST_DEPTH:
                        skeleton += ["{}" if sign == "{" else "[]"] if kept else []
                        kept = False
                    elif sign == "[" and depth == LIST_DEPTH and keys.get(1) == OUTER and keys.get(2) == INNER:
                        opened = (at, place + 1)
                elif sign in CLOSE:
                    if depth == LIST_DEPTH and opened:
                        lists.append((*opened, at))
                        opened = None
                    depth -= 1
                    kept = kept and depth < LIST_DEPTH
            if kept:
                skeleton.append(sign)
    try:
        envelope = json.loads("".join(skeleton))
        records = envelope[OUTER][INNER]
    except (ValueError, KeyError, TypeError) as error:
        return (f"no envelope of records ({error!r})", None, None, None)
    if inside or depth or len(lists) != 1 or not all(isinstance(one, dict) for one in records):
        return ("no envelope with one list of records that are all objects", None, None, None)
    return (None, *lists[0])


def _records(placed: DataFrame, lists: DataFrame) -> DataFrame:
    where = F.struct("start", "row")
    pieces = lookup_join(placed, lists, ["file"]).filter((where >= F.col("opens")) & (where < F.col("closes")))
    first = where == F.col("opens")
    begins = first | (~F.col("inside") & (F.col("depth") == LIST_DEPTH))
    begins = begins & F.when(first, F.lit(True)).otherwise(F.col("value").rlike(r"^\s*,\s*\{"))
    kept = F.when(first, F.expr("substr(value, at + 1)")).otherwise(F.col("value"))
    ends = ~F.col("ends_inside") & (F.col("end_depth") == LIST_DEPTH)
    marked = pieces.select(*SPLIT, "row", kept.alias("value"), begins.alias("begins"), ends.alias("ends"))
    text = lambda value: F.concat(F.regexp_replace(value, r"^\s*,?\s*", ""), F.lit("}"))
    alone = marked.filter("begins AND ends").select(*SPLIT, "row", text(F.col("value")).alias("value"))
    # Only records of several pieces are shuffled: first to find where each began, then to join it.
    several = marked.filter("NOT (begins AND ends)")
    split = Window.partitionBy(*SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    begun = materialize(several.withColumn("record", F.max(F.when(F.col("begins"), F.col("row"))).over(split)))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    lasts = begun.groupBy(*SPLIT).agg(F.max(F.struct("start", "record")).alias("last"))
    carried = F.when(F.col("last.record").isNotNull(), F.col("last"))
    lasts = lasts.select(*SPLIT, F.last(carried, ignorenulls=True).over(before).alias("earlier"))
    own = F.when(F.col("record").isNotNull(), F.struct("start", "record"))
    parts = F.sort_array(F.collect_list(F.struct("start", "row", "value")))
    joined = (
        lookup_join(begun, materialize(lasts), SPLIT)
        .groupBy("file", F.coalesce(own, "earlier").alias("one"))
        .agg(F.array_join(F.transform(parts, lambda part: part["value"]), "}").alias("value"))
        .select("file", F.col("one.start").alias("start"), F.col("one.record").alias("row"), text(F.col("value")).alias("value"))
    )
    return alone.unionByName(joined)
