"""What the operators share: table reading, lineage cuts, and the white space of the contracts."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: A word of the contracts.
WORD = rf"[^{SPACE}]+"
#: The same characters one by one, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stage outputs, which all hosts share: spark.checkpoint.dir of the session.

    Where nothing names one a temporary folder is set, but only if all runs in this one process, as in
    tests; on a cluster, a folder of one machine would be lost with it, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith(("local[", "local*")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in shared_folder()."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Rows (row, and the columns named in more): all columns of docs in one struct, whose names cannot clash with others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def rows_that_stay(docs: DataFrame, stays: DataFrame, row_id: Column, sha: Column) -> DataFrame:
    """The rows of docs whose id and digest of the text are in stays (_id, _sha), with all their columns: one row for each.

    stays has no row twice. Only its rows are looked for, and only where several have one id and digest
    do they meet: the one with the least hash of its columns stays, after each task has kept one of
    its own. As a struct, a null id is a value like others.
    """
    hashed = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    key = F.struct(row_id.alias("id"), sha.alias("sha"))
    counts = docs.select(key.alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    stay = F.struct(F.col("_id").alias("id"), F.col("_sha").alias("sha"))
    wanted = counts.join(stays.select(stay.alias("_stay")), F.col("_key") == F.col("_stay"), "left_semi")
    fresh = F.concat("_key.sha", F.substring("_key.sha", 1, 0))  # as dealt_anew() does for numbers
    wanted = wanted.select(F.struct(F.col("_key.id").alias("id"), fresh.alias("sha")).alias("_stay"), "_n")
    rows = packed(docs, _key=key, _h=F.xxhash64(*hashed)).join(wanted, F.col("_key") == F.col("_stay"))
    again = rows.filter("_n > 1").groupBy("_key").agg(F.min_by("row", "_h").alias("row"))
    return rows.filter("_n = 1").select("row.*").union(again.select("row.*"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def one_space(text: Column) -> Column:
    """Each run of white space as one space: plain replacements first, the regular expression only where runs remain."""
    for c in "\n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def dealt_anew(column: Column) -> Column:
    """The same 64-bit value as a fresh expression.

    A table that was aggregated by a key is already partitioned by it, and a join on that key
    would then skip the exchange that adaptive execution needs to split a hot key.
    """
    return column.bitwiseXOR(F.lit(0).cast("long"))


def packed_text(text: str) -> bytes:
    """A text compressed, for texts that have to move."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(text.encode("utf-8")) if text else b""


def unpacked_text(packed: str | bytes | None) -> str:
    """What packed_text() packed; a text that is not packed as it stands, and a null as an empty one."""
    if isinstance(packed, bytes) and packed:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8")
    return packed if packed and isinstance(packed, str) else ""


def in_lots(column, chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts of an Arrow column, packed or not (null: empty), in lots of about so many characters, at least one text each."""
    lot, size = [], 0
    for x in column:
        text = unpacked_text(x.as_py())
        lot.append(text)
        size += len(text)
        if size >= chars:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def give_back() -> None:
    """Hands the memory that this Python process has free back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # as glibc has it
        trim(0)


def sparing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, with give_back() at the end of each task.

    A Python worker lives on beside the tasks of later stages, and what it holds counts as its executor's memory.
    """

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return lean
