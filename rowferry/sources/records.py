"""CSV records that may cross line ends, from files that stay split over tasks.

A line takes the reader from one quote state (outside or inside a quoted field)
to another. What a line does to each of the two states is known from the line
alone; what a file block does is the composition of its lines, and a prefix over
one row a block fixes the state in which each block, and so each line, begins.
Lines that begin and end outside are records by themselves; only the lines of
records that cross a line end are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowferry.errors import SourceError

#: Bytes of the longest record; beyond it a quote is taken for one that was never closed.
MOST_RECORD_BYTES = 256 << 20

# A field that begins outside quotes: quoted (what follows the closing quote belongs to it), or bare.
_INNER = r'(?:[^"]++|"")*+'
_FIELD = rf'(?:"{_INNER}"(?!")[^,]*+|(?!")[^,]*+)'
_OPENS = rf'^(?:{_FIELD},)*+"{_INNER}$'
_STAYS = rf"^{_INNER}$"
_REOPENS = rf'^{_INNER}"(?!")[^,]*+,(?:{_FIELD},)*+"{_INNER}$'
_QUOTED = rf'(?<=^|,)"{_INNER}(?:"(?!")|$)'
_UP_TO_CLOSE = rf'^{_INNER}(?:"(?!")|$)'

OPTIONS = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with place and effect: after0 and after1 are the states behind a line that begins outside or inside."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )
    line = F.col("value")
    quoted = F.contains(line, F.lit('"'))
    return lines.select(
        "*",
        (quoted & line.rlike(_OPENS)).alias("after0"),
        (~quoted | line.rlike(_STAYS) | line.rlike(_REOPENS)).alias("after1"),
        ((line != "") & (line != "\r")).alias("filled"),
    )


def _with_states(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add before0 and before1: the states before each row if its group (keys, in order) begins outside or inside.

    Rows that set the state, whatever it was, cut off what stands before them;
    since the last of them only the number of rows that swap the states counts.
    """
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = (F.col("after0") & ~F.col("after1")).cast("long")
    counted = df.withColumn("__swaps", F.coalesce(F.sum(swaps).over(earlier), F.lit(0)))
    sets = F.when(
        F.col("after0") == F.col("after1"),
        F.struct(F.col("after0").alias("state"), (F.col("__swaps") + swaps).alias("swaps")),
    )
    found = counted.withColumn("__set", F.last(sets, ignorenulls=True).over(earlier))
    fixed = F.col("__set").isNotNull()
    odd = (F.col("__swaps") - F.coalesce(F.col("__set.swaps"), F.lit(0))) % 2 == 1
    return found.withColumns({
        "before0": F.when(fixed, F.col("__set.state") != odd).otherwise(odd),
        "before1": F.when(fixed, F.col("__set.state") != odd).otherwise(~odd),
    }).drop("__swaps", "__set")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the number of their record in the file (1 is the first), whether they begin and end inside quotes.

    Empty lines outside quotes are left out. ``file_no`` counts files by path from
    0, ``file_base`` the records of all files before.
    """
    # By ranges, so that rows keep the files' order; the windows need no other exchange.
    lines = _with_states(_lines(spark, path).repartitionByRange("file", "block"), ["file", "block"], "pos")
    upto = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for s in ("0", "1"):
        starts = (F.col("filled") & ~F.col(f"before{s}")).cast("long")
        lines = lines.withColumn(f"n{s}", F.sum(starts).over(upto))
    last = F.struct(
        *[F.when(F.col(f"before{s}"), F.col("after1")).otherwise(F.col("after0")).alias(f"after{s}") for s in "01"],
        F.col("n0"), F.col("n1"),
    )
    blocks = lines.groupBy("file", "block").agg(F.max_by(last, "pos").alias("x")).select("file", "block", "x.*")
    # One row for each file block from here on.
    begun = _with_states(blocks, ["file"], "block").select(
        "file", "block", F.col("before0").alias("inside"),
        F.when(F.col("before0"), F.col("n1")).otherwise(F.col("n0")).alias("n"),
    )
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    same_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = begun.select(
        "file", "block", "inside", F.coalesce(F.sum("n").over(same_file), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("all_base"),
    ).withColumns({
        "file_base": F.col("all_base") - F.col("base"),
        "file_no": F.dense_rank().over(Window.orderBy("file")) - 1,
    }).drop("all_base")
    joined = lines.join(F.broadcast(based), ["file", "block"])

    def chosen(a: str, b: str) -> Column:
        return F.when(F.col("inside"), F.col(a)).otherwise(F.col(b))

    begins = chosen("before1", "before0")
    return joined.select(
        "file", "block", "pos", F.col("value"), "file_no", "file_base",
        (F.col("base") + chosen("n1", "n0")).alias("record"),
        begins.alias("begins_inside"),
        F.when(begins, F.col("after1")).otherwise(F.col("after0")).alias("ends_inside"),
        "filled",
    ).where(F.col("filled") | F.col("begins_inside"))


def _commas(line: Column, inside: Column) -> Column:
    """Commas outside quotes of a line that begins inside or outside."""
    bare = F.when(inside, F.regexp_replace(line, _UP_TO_CLOSE, "")).otherwise(line)
    bare = F.regexp_replace(bare, _QUOTED, "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))


def survey(placed: DataFrame) -> tuple[int, int]:
    """Cells of the widest record, and bytes of the longest that crosses a line end; no text is shuffled for it."""
    measured = placed.select(
        "file", "record", _commas(F.col("value"), F.col("begins_inside")).alias("commas"),
        F.octet_length("value").cast("long").alias("bytes"), (F.col("begins_inside") | F.col("ends_inside")).alias("crosses"),
    )
    alone = measured.where(~F.col("crosses")).agg(F.max("commas").alias("commas"), F.lit(0).cast("long").alias("bytes"))
    crossing = measured.where("crosses").groupBy("file", "record").agg(F.sum("commas").alias("commas"), F.sum("bytes").alias("bytes"))
    both = alone.unionAll(crossing.agg(F.max("commas"), F.max("bytes")))
    row = both.agg(F.max("commas").alias("commas"), F.max("bytes").alias("bytes")).first()
    return (row["commas"] if row["commas"] is not None else -1) + 1, row["bytes"] or 0


def records(placed: DataFrame, encoding: str | None) -> DataFrame:
    """``(file_no, file_base, record, text)``: every record whole, without its line end.

    Records of one line come in the files' order, those that cross line ends after them.
    """
    crosses = F.col("begins_inside") | F.col("ends_inside")
    whole = placed.where(~crosses).select("file", "file_no", "file_base", "record", F.col("value").cast("binary").alias("data"))
    parts = F.sort_array(F.collect_list(F.struct("block", "pos", F.col("value").cast("binary").alias("data"))))
    joined = F.aggregate(
        parts, F.lit(None).cast("binary"),
        lambda a, p: F.coalesce(F.concat(a, F.lit(b"\n"), p["data"]), p["data"]),
    )
    gathered = placed.where(crosses).groupBy("file", "file_no", "file_base", "record").agg(joined.alias("data"))
    data = F.col("data")
    # The line end may have been two characters.
    data = F.when(F.substring(data, -1, 1) == F.lit(b"\r"), F.substring(data, F.lit(1), F.octet_length(data) - 1)).otherwise(data)
    text = F.decode(data, F.lit(encoding)) if encoding else data.cast("string")
    return whole.unionAll(gathered).select("file_no", "file_base", "record", text.alias("text"))


def check_length(longest: int, path: str) -> None:
    if longest > MOST_RECORD_BYTES:
        raise SourceError(f"{path}: a quoted field goes on for {longest} bytes over line ends; a quote may not be closed")
