"""Collections and base strings from tables, FASTA and plain text files.

Files are read as lines; the place of a line is its file, the start of the input
split it was read from and its number inside the split, so that large files are
read in parallel and no file passes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import base_index as bi
from ..operators.base_index import base_symbols, concat_base
from ..operators import pieces as pc
from ..operators.heads import ordered_index
from ..operators.pieces import in_pieces, reblocked
from ..session import Scratch

LINE_ORDER = ["file", "split", "line_no"]
# The byte that opens a header line, the bytes trimmed once from the
# end of a base string, then once more the marker that may close it, and the
# whitespace trimmed from the collection path.
HEADER = ">"
TRIMMED_TAIL = ("\n", "\r", "\x00")
END_MARKER = ("$",)
PATH_SPACE = " \n\r\t"


def from_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, text`` of a table whose BIGINT ``key`` (an SQL expression) is unique
    and gives the order; a missing text is an empty document."""
    docs = df.select(F.expr(key).cast("long").alias("doc"), F.expr(text).alias("text"))
    return docs.withColumn("text", F.coalesce("text", F.lit("").cast(docs.schema["text"].dataType)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, file_bytes, split, line_no, line``; only line feeds end a line."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_bytes"),
                    F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
            .withColumn("line_no", F.monotonically_increasing_id()))


def _without_unterminated(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Drop the last line of a file that lacks its line feed."""
    lines = scratch.save(lines, "lines")
    files = lines.groupBy("file").agg(
        F.sum(F.octet_length("line") + 1).alias("full"), F.max("file_bytes").alias("size"),
        F.max(F.struct("split", "line_no")).alias("end"))
    cut = files.filter("full <> size").select("file", F.col("end.split").alias("split"), F.col("end.line_no").alias("line_no"))
    return lines.join(cut, LINE_ORDER, "left_anti")


def lines_to_documents(lines: DataFrame, scratch: Scratch, keep_leading_empty: bool = True) -> DataFrame:
    """``doc, text``: a header line or an empty line closes the document before it,
    other lines are joined.  What follows the last break is a document only if it
    has content; an empty document before a leading header is kept by default."""
    broken = lines.withColumn("is_break", (F.col("line").startswith(HEADER) | (F.col("line") == "")).cast("long"))
    # breaks before a line = the document it belongs to; a break closes that document.
    # Lines are counted inside their split, which is bounded, and splits among each other.
    splits = broken.groupBy("file", "split").agg(F.sum("is_break").alias("breaks"))
    starts = ordered_index(splits, ["file", "split"], "first_doc", scratch, splits.count(), weight="breaks")
    before = Window.partitionBy("file", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = (broken.withColumn("breaks_before", F.coalesce(F.sum("is_break").over(before), F.lit(0)))
              .join(F.broadcast(starts.select("file", "split", "first_doc")), ["file", "split"])
              .withColumn("doc", F.col("first_doc") + F.col("breaks_before")))
    docs = placed.groupBy("doc").agg(
        F.max("is_break").alias("closed"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.when(F.col("is_break") == 0, F.struct(*LINE_ORDER, "line")))),
            lambda r: r["line"]), "").alias("text"))
    docs = docs.filter((F.col("closed") == 1) | (F.col("text") != "")).select("doc", "text")
    return docs if keep_leading_empty else docs.filter((F.col("doc") > 0) | (F.col("text") != ""))


def lines_to_pieces(lines: DataFrame, scratch: Scratch, keep_leading_empty: bool = True, binary: bool = False,
                    size: int | None = None) -> DataFrame:
    """The documents of ``lines_to_documents`` as ``doc, start, text``, in pieces of ``size`` symbols (by default ``PIECE``).

    Lines are placed inside their split by running sums.  A document that goes on from the split
    before starts there by what one summary row per split tells; so no task sees more of a
    document than a split of lines or a piece."""
    is_break = F.col("line").startswith(HEADER) | (F.col("line") == "")
    text = F.when(is_break, "").otherwise(F.col("line"))
    text = text.cast("binary") if binary else text
    sized = lines.select("file", "split", "line_no", is_break.cast("long").alias("is_break"), text.alias("text")).withColumn(
        "size", F.length("text").cast("long"))
    before = Window.partitionBy("file", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = scratch.save(
        sized.withColumns({"breaks_before": F.coalesce(F.sum("is_break").over(before), F.lit(0)),
                           "size_before": F.coalesce(F.sum("size").over(before), F.lit(0))})
        .withColumn("broken_at", F.max(F.when(F.col("is_break") == 1, F.col("size_before"))).over(before)), "lines-in-splits")
    splits = inside.groupBy("file", "split").agg(
        F.sum("is_break").alias("breaks"), F.sum("size").alias("size"),
        F.max(F.when(F.col("is_break") == 1, F.col("size_before"))).alias("broken_at"))
    n = splits.count()
    order = ["file", "split"]
    counted = ordered_index(ordered_index(splits, order, "first_doc", scratch, n, weight="breaks"), order, "symbols_before",
                            scratch, n, weight="size")
    counted = scratch.save(counted, "splits")
    # where the last document that a split opens starts, for the splits that it goes on in
    opened = counted.filter("breaks > 0").select((F.col("first_doc") + F.col("breaks")).alias("first_doc"),
                                                 (F.col("symbols_before") + F.col("broken_at")).alias("opened_at"))
    carried = counted.join(opened, "first_doc", "left").select(
        *order, "first_doc", (F.col("symbols_before") - F.coalesce("opened_at", F.lit(0))).alias("carry"))
    placed = inside.join(F.broadcast(carried), order).select(  # one row per split
        (F.col("first_doc") + F.col("breaks_before")).alias("doc"),
        F.coalesce(F.col("size_before") - F.col("broken_at"), F.col("carry") + F.col("size_before")).alias("start"), "text")
    # a break is an empty text of the document that it closes, which keeps the empty ones
    size = size or pc.PIECE
    docs = reblocked(placed, size, empty=True).select("doc", (F.col("block") * size).alias("start"), "text")
    return docs if keep_leading_empty else docs.filter((F.col("doc") > 0) | (F.length("text") > 0))


def read_collection(spark: SparkSession, path: str, drop_unterminated: bool = False,
                    keep_leading_empty: bool = True, binary: bool = False, pieces: bool | None = False,
                    size: int | None = None) -> DataFrame:
    """Documents of a FASTA or plain text file; with ``binary`` their symbols are bytes,
    which need not be UTF-8.

    ``pieces``: whether they come as ``doc, start, text`` instead of one cell each, so that a document may
    be longer than a cell or a split; None: if one of them is longer than a piece.  ``size``: symbols of a piece."""
    scratch = Scratch(spark)
    lines = read_lines(spark, path)
    if drop_unterminated:
        lines = _without_unterminated(lines, scratch)
    if pieces is not False:
        docs = scratch.save(lines_to_pieces(lines, scratch, keep_leading_empty, binary, size), "pieces")
        return docs if pieces or docs.filter("start > 0").head(1) else docs.drop("start")
    docs = lines_to_documents(lines, scratch, keep_leading_empty)
    return scratch.save(docs.withColumn("text", F.col("text").cast("binary")) if binary else docs, "documents")


def lines_to_base(lines: DataFrame, binary: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """``block, text`` of ``line`` rows in LINE_ORDER.  If the first line is a header, headers
    and empty lines are dropped and the records joined; otherwise the text is taken as it
    is.  One trailing line end and one marker are cut."""
    scratch = scratch or Scratch(lines.sparkSession)
    lines = scratch.save(lines, "base-lines")
    first = lines.orderBy(*LINE_ORDER).limit(1).collect()
    if first and first[0].line.startswith(HEADER):
        taken = lines.filter(~F.col("line").startswith(HEADER) & (F.col("line") != "")).select(*LINE_ORDER, "line")
    else:  # only the last line of a file may lack its line end
        ends = lines.groupBy("file").agg(
            F.sum(F.octet_length("line") + 1).alias("full"), F.max("file_bytes").alias("size"),
            F.max(F.struct("split", "line_no")).alias("end"))
        open_end = ends.filter("full <> size").select("file", F.col("end.split").alias("split"), F.col("end.line_no").alias("line_no"),
                                                       F.lit(True).alias("unterminated"))
        taken = lines.join(open_end, LINE_ORDER, "left").select(
            *LINE_ORDER, F.concat("line", F.when(F.col("unterminated"), "").otherwise("\n")).alias("line"))
    numbered = ordered_index(taken, LINE_ORDER, "doc", scratch, taken.count())
    text = F.col("line").cast("binary") if binary else F.col("line")
    return _trimmed(concat_base(numbered.select("doc", text.alias("text")), scratch))


def _trimmed(blocks: DataFrame) -> DataFrame:
    """The blocks without the line end and the marker that may end the last ones."""
    last = (blocks.orderBy(F.col("block").desc()).limit(2)
            .select(F.substring("text", -2, 2).cast("string").alias("end"), F.length("text").alias("n")).collect())
    tail, cut = "".join(r.end for r in reversed(last))[-2:], 0
    for ends in (TRIMMED_TAIL, END_MARKER):
        if tail and tail[-1] in ends:
            tail, cut = tail[:-1], cut + 1
    if not cut:
        return blocks
    size = base_symbols(blocks) - cut
    start = F.col("block") * F.lit(bi.BLOCK)
    return blocks.filter(start < size).withColumn(
        "text", F.when(start + F.length("text") > size, F.expr(f"substring(text, 1, cast({size} - block * {bi.BLOCK} as int))"))
        .otherwise(F.col("text")))


def read_base(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """The base string of a FASTA or plain text file, in blocks."""
    return lines_to_base(read_lines(spark, path), binary)


def read_manifest(spark: SparkSession, path: str) -> tuple[str, str]:
    """Base path and collection path: the two lines of a manifest."""
    rows = [r.line for r in read_lines(spark, path).orderBy(*LINE_ORDER).limit(2).collect()]
    if not rows or not rows[0]:
        raise ValueError(f"{path}: first line is empty")
    second = rows[1].rstrip(PATH_SPACE) if len(rows) > 1 else ""
    if not second:
        raise ValueError(f"{path}: second line is empty")
    return rows[0], second


def prefix_limit(collection: DataFrame, prefix: int, scratch: Scratch | None = None) -> DataFrame:
    """The first ``prefix`` symbols of the collection, whole or in pieces, one separator per document
    counted; the document at the cut is shortened so that its separator fits, and left
    out if nothing but the separator is left of it."""
    scratch = scratch or Scratch(collection.sparkSession)
    sizes = collection.groupBy("doc").agg((F.sum(F.length("text").cast("long")) + 1).alias("size"))
    starts = ordered_index(sizes, ["doc"], "start", scratch, collection.count(), weight="size")
    # a document that would be cut to nothing does not count, an empty one does
    fits = (F.col("start") < prefix - 1) | ((F.col("start") == prefix - 1) & (F.col("size") == 1))
    cut = starts.filter(fits).agg(
        F.max("doc").alias("doc"), F.max_by("start", "doc").alias("start")).first()
    if cut.doc is None:
        return pc.relation(collection).filter(F.lit(False))
    # only the last kept document is shortened, and no text is shuffled
    room = max(prefix - 1 - cut.start, 0)
    last, at = F.col("doc") == cut.doc, F.col("start") if in_pieces(collection) else F.lit(0)
    left = F.least(F.lit(room) - at, F.lit((1 << 31) - 1)).cast("int")
    kept = (F.col("doc") < cut.doc) | (last & ((at == 0) | (at < room)))
    return collection.filter(kept).select(
        *pc.key_columns(collection), F.when(last, F.substring(F.col("text"), F.lit(1), left)).otherwise(F.col("text")).alias("text"))
