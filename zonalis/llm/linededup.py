"""Line dedup on range-partitioned hashes with a secondary sort, in DataFrame operations only.

Lines travel as 128-bit hashes with their document and place, never as text. Hashes of (line, slice of
documents) are uniform, so their range is cut arithmetically, without a sampling pass; ranges are dealt
out, sorted by document and place, and streamed: the first row of a run is the first occurrence. The
slice splits a line that a third of all documents hold into ``SLICES`` runs, whose summaries (one row
each) are added up. What goes back to a document is a bitmap of kept lines, run-length coded; documents
that lose nothing are not moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, ascii_lower, checkpoint, let, packed, partitions, split_touched, unpacked

SLICES = 64
#: Ranges of hashes a partition, about.
RANGES = 16
MIN_DOCS = 10
#: Lines of more words than this are passages, which the pipeline keeps in one document only.
LONG_WORDS, LONG_DOCS = 50, 2


#: A run: range, both hashes of the line, slice.
RUN = ["_r", "_a", "_b", "_s"]


def _lines():
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _identity(docs: DataFrame) -> list:
    return [F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t")]


def line_runs(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """A row for each line of ``min_words`` words or more: range _r, hash (_a, _b), slice _s, document (_d, _t),
    place _p, and whether it is its document's first line of that hash (_first); dealt by range and sorted."""
    key = ascii_lower(F.btrim(F.col("_line"), F.lit(WS)))
    rows = docs.select(*_identity(docs), F.posexplode(_lines()).alias("_p", "_line")).withColumn("_key", key).where("_key <> ''")
    if min_words > 1:
        rows = rows.where(F.rlike("_key", F.lit(f"^(?:[^{WS}]++[{WS}]++){{{min_words - 1}}}[^{WS}]")))
    rows = rows.select(F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit("line"), F.col("_key")).alias("_b"), F.pmod(F.xxhash64("_d", "_t"), F.lit(SLICES)).cast("int").alias("_s"), "_d", "_t", "_p")
    n = partitions(docs.sparkSession)
    cut = F.shiftright(F.shiftrightunsigned(F.xxhash64("_a", "_b", "_s"), 33) * F.lit(n * RANGES).cast("bigint"), 31).cast("int")
    run = Window.partitionBy(*RUN).orderBy("_d", "_t", "_p")
    ranged = rows.withColumn("_r", cut).repartition(n, "_r").sortWithinPartitions(*RUN, "_d", "_t", "_p")
    before = F.lag(F.struct("_d", "_t")).over(run)
    return ranged.withColumn("_first", before.isNull() | ~before.eqNullSafe(F.struct("_d", "_t")))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, min_words: int = 1) -> DataFrame:
    """For each document that loses lines: (_d, _t), the sorted places it loses (_gone).

    A line goes if its key is found in ``min_docs`` documents or more; with ``keep_first`` its first
    occurrence by document and place stays. Lines of fewer than ``min_words`` words stay.
    """
    runs = checkpoint(line_runs(docs, min_words))
    here = runs.where("_first").groupBy(*RUN).agg(F.count("*").alias("_n"), F.min(F.struct("_d", "_t", "_p")).alias("_at"))
    common = here.groupBy("_a", "_b").agg(F.sum("_n").alias("_docs"), F.min("_at").alias("_start")).where(F.col("_docs") >= min_docs).drop("_docs")
    marks = here.select(*RUN).join(common, ["_a", "_b"])
    gone = runs.join(marks, RUN)
    if keep_first:
        gone = gone.where(~F.struct("_d", "_t", "_p").eqNullSafe(F.col("_start")))
    return gone.groupBy("_d", "_t").agg(F.array_sort(F.collect_set("_p")).alias("_gone")).withColumn("_bits", F.expr(KEEP_RUNS))


#: From the lost places: kept runs between them as (start, length); the last is open-ended.
KEEP_RUNS = let(
    "q_",
    "concat(array(-1), _gone)",
    "filter(transform(q_, (x_, i_) -> named_struct('start', x_ + 1, 'len', coalesce(get(q_, i_ + 1), 2147483647) - x_ - 1)), r_ -> r_.len > 0)",
)


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, min_words: int = 1) -> DataFrame:
    """Add n_lines, n_dropped, kept_text and keep_bits (array of kept runs; null: all kept) to each row.

    A null or empty text is one empty line, which always stays, as do lines of white space. A
    document is a doc_id with its text: rows that repeat one count once and are treated alike, and
    rows with a null doc_id are told apart by their text. An empty table gives an empty table; other
    columns stay, but for those of the new names. Whole texts of any length are split.
    """
    bitmaps = checkpoint(keep_bitmaps(docs, min_docs, keep_first, min_words))
    own = packed(docs, text=F.coalesce(F.col("text"), F.lit("")), d=F.col("doc_id"), t=F.xxhash64("text"))
    hit, rest = split_touched(own, "t", bitmaps, "_t")
    joined = hit.join(bitmaps, own.d.eqNullSafe(bitmaps._d) & (own.t == bitmaps._t), "left").select("row", "text", "_gone", "_bits")
    none = [F.lit(None).cast(bitmaps.schema[c].dataType).alias(c) for c in ("_gone", "_bits")]
    both = joined.unionByName(rest.select("row", "text", *none))
    kept = F.expr("case when _gone is null then text else " + let("l_", "split(text, '\\n', -1)", "array_join(flatten(transform(_bits, r_ -> slice(l_, r_.start + 1, r_.len))), '\\n')") + " end")
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    return unpacked(both, docs.columns, n_lines=n_lines, n_dropped=F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint"), kept_text=kept, keep_bits=F.col("_bits"))


def dedup_documents(docs: DataFrame, min_docs: int = MIN_DOCS, min_words: int = 1) -> DataFrame:
    """Documents without the later occurrences of lines found in ``min_docs`` documents or more; the
    first occurrence stays, so that no passage is lost from the corpus. Columns as they came."""
    own = packed(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    out = line_dedup(own, min_docs, keep_first=True, min_words=min_words)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return unpacked(out, docs.columns, **{c: new[c] for c in new if c in docs.columns})


def dedup_passages(docs: DataFrame) -> DataFrame:
    """Documents without the later occurrences of lines of over ``LONG_WORDS`` words found in
    ``LONG_DOCS`` documents or more. For documents without copies: between whole copies, lines that
    go would hide the likeness of the rest."""
    return dedup_documents(docs, LONG_DOCS, LONG_WORDS + 1)
