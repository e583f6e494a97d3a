"""Exact deduplication by distributed MSD radix partitioning.

Texts are strings of bytes behind their length: the first digit is the byte
length with the first ``WIDTHS[0]`` bytes, each later digit is the next run
of bytes. A level splits every open group by its next digit; a group of one
row is settled as unique, a group whose bytes have ended is settled as
copies, the others go on with the bytes that remain. Bytes are compared
themselves; no digest decides anything.

A level is a grouped count (combined in each task before the shuffle, so a
huge group of copies costs one row a task) and a join of the rows with the
groups of more than one row. That join is salted, so the rows of one huge
group spread over ``SALTS`` tasks. Each level is written to the shared
checkpoint folder and only rows of open groups go on, without the bytes
already compared. Levels grow by a factor of 16, so their number
follows the logarithm of the longest text.

Defined results: null text equals the empty text; of equal texts the largest
id stays (null ids are smallest, and of repeated rows exactly one stays); an
empty table gives no rows; extra columns can be carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, text_or_empty, written

WIDTHS = (64, 1024)  # bytes of the first digits; each later digit is 16 times as wide
SALTS = 16


def _width(level: int) -> int:
    return WIDTHS[level] if level < len(WIDTHS) else WIDTHS[-1] << (4 * (level - len(WIDTHS) + 1))


def _salted_left(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Left join of rows with one-row-a-key groups; a hot key's rows spread over SALTS tasks."""
    spread = groups.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
            .join(spread, [*on, "_salt"], "left").drop("_salt"))


def _groups(rows: DataFrame, on: list[str]) -> DataFrame:
    """Groups of two or more rows: number, first row (the group's name) and the row that stays."""
    return (rows.groupBy(*on)
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_name"),
                 F.max(F.struct("_id", "_row")).alias("_stay"))
            .where("_n > 1"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id (id of the row that
    stays), group_size, kept, text_sha256, and the ``carry`` columns."""
    kind = docs.schema[id_col].dataType
    text = text_or_empty(text_col)
    raw = F.encode(text, "UTF-8")
    first = _width(0)
    inside = text_col in carry  # a carried text is read from there, not stored twice
    payload = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry \
        else F.lit(None).cast("int")
    rows = docs.select(
        F.col(id_col).alias("_id"), F.sha2(raw, 256).alias("_sha"), payload.alias("_carry"),
        F.octet_length(text).alias("_len"), F.substring(raw, 1, first).alias("_digit"),
        (F.lit(None).cast("binary") if inside else raw).alias("_raw"))
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), "*")
    base, base_path = written(numbered)
    used = [base_path]

    def bytes_from(done: int, compared: int, width: int | None = None) -> Column:
        """The next bytes of a row of which ``done`` are compared (``compared`` of those it still holds)."""
        if inside:
            held = F.encode(F.coalesce(F.col(f"_carry.c{carry.index(text_col)}").cast("string"),
                                       F.lit("")), "UTF-8")
            compared = done
        else:
            held = F.col("_raw")
        return F.substring(held, compared + 1, width or (1 << 31) - 1)

    def settle(level_rows: DataFrame, groups: DataFrame, on: list[str], done_at: int, rest: Column):
        """Rows of one level, written: settled ones, and open ones with the bytes that remain."""
        joined = _salted_left(level_rows, groups, on)
        shared = F.col("_n").isNotNull()
        ended = shared & (F.col("_len") <= done_at)
        return written(joined.select(
            "_row", "_id", "_sha", "_carry", "_len",
            (shared & ~ended).alias("_open"),
            F.when(ended, F.col("_stay")).otherwise(F.struct("_id", "_row")).alias("_stay"),
            F.when(ended, F.col("_n")).otherwise(F.lit(1)).alias("_n"),
            F.when(shared & ~ended, F.col("_name")).alias("_group"),
            (F.lit(None).cast("binary") if inside
             else F.when(shared & ~ended, rest)).alias("_raw")))

    on = ["_len", "_digit"]
    table, path = settle(base, _groups(base.select(*on, "_row", "_id"), on), on, first,
                         bytes_from(first, first))
    drop(docs, *used)
    settled, done, level = [table.where("NOT _open")], first, 1
    while True:
        longest = table.where("_open").agg(F.max("_len")).first()[0]
        if longest is None:
            break
        width = _width(level)
        rows = table.where("_open").select(
            "_row", "_id", "_sha", "_carry", "_len", "_group",
            bytes_from(done, 0, width).alias("_digit"),
            (F.lit(None).cast("binary") if inside
             else bytes_from(done + width, width)).alias("_raw"))
        on = ["_group", "_digit"]
        done += width
        table, path = settle(rows, _groups(rows.select(*on, "_row", "_id"), on), on, done,
                             F.col("_raw"))
        settled.append(table.where("NOT _open"))
        level += 1

    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(
        F.col("_id").cast(kind).alias(id_col), F.col("_stay._id").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        (F.col("_stay._row") == F.col("_row")).alias("kept"), F.col("_sha").alias("text_sha256"),
        *[F.col(f"_carry.c{i}").alias(c) for i, c in enumerate(carry)])


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: n for c, n in zip(docs.columns, names)}
    kept = exact_groups(plain.withColumn("_key", F.col(at[id_col])), "_key", at[text_col],
                        carry=tuple(names))
    return kept.where("kept").select(*names).toDF(*docs.columns)
