"""SpotSigs fingerprints, by DataFrame functions alone.

A spot signature is a common word (the anchor) and the next ``2`` words that
are no anchors; a text's fingerprint is the set of its signatures' 32-bit
hashes. One regular-expression pass marks the chain of every anchor in place
and a second one takes the marked chains out. A text without a complete
chain falls back to every three words in a row, or to its words as one chain.

``compare_with_next`` sets each text against its edited form and against the
next document; ``similar_pairs`` is the general search: fingerprints are
partitioned by length, only lengths that can reach the least similarity meet,
and within those only fingerprints that share one of their rarest signatures.

Defined results: null text is empty; the empty fingerprint is like the empty
one (1) and unlike any other (0); ids are ordered descending, null ids last,
rows of one id by text; repeated rows follow one another; with one
document its next is itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

# --- Fixed values: anchors (common words of the four languages) ------------------
ANCHORS = (
    "the", "and", "of", "to", "in", "is", "that", "for", "was", "with",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein",
    "le", "la", "les", "de", "et", "des", "un", "une", "que", "dans",
    "el", "los", "en", "con", "por", "y", "se", "del", "las", "para",
)
MOST_BOUNDARIES = 512


def _anchor_pattern() -> str:
    """The anchors by first letter, so that a word is tried against few of them."""
    by: dict[str, list[str]] = {}
    for w in ANCHORS:
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


_A = _anchor_pattern()
_CHAIN = rf"(?<= )({_A}) (?=(?:{_A} )*+([^ ]++) (?:{_A} )*+([^ ]++) )"


def normal_words(text: Column) -> Column:
    """Lower-cased words with one space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")),
                    F.lit(" "))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that is computed once a row, however
    often later expressions use it (a plain projection would be copied into each of them)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_signatures(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the sorted distinct signature hashes of a text column."""
    df = once(df, "_words", normal_words(F.col(text_col)))
    df = once(df, "_spots", F.regexp_extract_all(
        F.regexp_replace("_words", _CHAIN, "\u0001$1 $2 $3\u0002"),
        F.lit("\u0001([^\u0002]*)\u0002"), F.lit(1)))
    plain = F.trim("_words")
    single = F.split(plain, " ")
    triples = F.transform(F.sequence(F.lit(0), F.size(single) - 3),
                          lambda i: F.concat_ws(" ", F.slice(single, i + 1, F.lit(3))))
    chains = (F.when(F.size("_spots") > 0, F.col("_spots"))
              .when(plain == "", F.array().cast("array<string>"))
              .when(F.size(single) < 3, F.array(plain))
              .otherwise(triples))
    hashes = F.sort_array(F.array_distinct(F.transform(chains, lambda c: F.hash(c))))
    return once(df, name, hashes).drop("_words", "_spots")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def printed(sigs: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits per signature, in order."""
    return F.concat_ws("", F.transform(sigs, lambda s: F.right(
        F.concat(F.lit("0000000"), F.hex(F.pmod(s.cast("long"), F.lit(1 << 32)))), F.lit(8))))


def _range_number(id_col: str, bounds: list[float], parts: int) -> Column:
    """Number of the id's range, ascending: a balanced tree of comparisons over
    at most MOST_BOUNDARIES + 1 leaves, each divided evenly ``parts`` times."""
    def leaf(i: int) -> Column:
        base = F.lit(i * parts)
        if parts == 1 or not 0 < i < len(bounds):
            return base
        lo, hi = bounds[i - 1], bounds[i]
        inner = F.floor((F.col(id_col) - lo) / ((hi - lo) / parts)).cast("int")
        return base + F.greatest(F.lit(0), F.least(F.lit(parts - 1), inner))

    def tree(a: int, b: int) -> Column:
        if a == b:
            return leaf(a)
        m = (a + b + 1) // 2
        return F.when(F.col(id_col) >= bounds[m - 1], tree(m, b)).otherwise(tree(a, m - 1))

    return F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(tree(0, len(bounds)))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next: one row per document.

    Rows move once: into ranges of ids, in each of which a window reads the
    next row. The first row of the range below is added to each range as its
    last row, so no window spans ranges.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("long").alias("_id"),
                       text_or_empty(text_col).alias("_text"))
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = min(ranges, MOST_BOUNDARIES)
    found = rows.approxQuantile("_id", [i / cuts for i in range(1, cuts)], 0.25 / cuts)
    rows = rows.withColumn("_range", _range_number("_id", sorted(set(found)), ceil(ranges / cuts)))

    # the first row of each range (largest id, then text): as many as there are ranges
    tops = sorted(rows.groupBy("_range").agg(F.max("_id").alias("top")).collect(),
                  key=lambda r: -r["_range"])
    below = [(r["_range"], r.top, tops[i - 1]["_range"]) for i, r in enumerate(tops)]
    heads = spark.createDataFrame(below, "_range int, top long, _above int")
    ends = (rows.join(F.broadcast(heads), "_range").where(F.col("_id").eqNullSafe(F.col("top")))
            .groupBy("_above").agg(F.min("_text").alias("_text"))
            .select(F.lit(None).cast("long").alias("_id"), "_text",
                    F.col("_above").alias("_range")))
    ready = with_signatures(rows.withColumn("_end", F.lit(0))
                            .unionByName(ends.withColumn("_end", F.lit(1))), "_text", "_sigs")
    order = Window.partitionBy("_range").orderBy("_end", F.col("_id").desc_nulls_last(), "_text")
    n = F.length("_text")
    paired = (ready.withColumns({"_next": F.lead("_text").over(order),
                                 "_next_sigs": F.lead("_sigs").over(order)})
              .where("_end = 0")
              .withColumn("n_chars", n.cast("long"))
              .withColumn("_cut", F.floor(n / 3).cast("int")))
    paired = once(paired, "_edited", F.concat(
        F.expr("substring(_text, 1, int(n_chars) - _cut)"), F.expr("substring(_next, 1, _cut)")))
    paired = with_signatures(paired.drop("_text", "_next"), "_edited", "_edited_sigs")
    return paired.select(
        F.col("_id").cast(kind).alias(id_col), "n_chars",
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        printed(F.col("_sigs")).alias("fingerprint"),
        printed(F.col("_edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("_sigs"), F.col("_edited_sigs")).alias("near_edited"),
        likeness(F.col("_sigs"), F.col("_next_sigs")).alias("near_next"))


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least: float = 0.8) -> DataFrame:
    """(left_id, right_id, likeness) of all pairs of different fingerprints that reach ``least``.

    Documents of one fingerprint meet as one. Fingerprints are partitioned by
    length (ratio ``1 / least`` per class) and by signature: two sets of
    similarity ``least`` share one of their ``size - ceil(least * size) + 1``
    rarest signatures and lie in the same class or in neighbouring ones.
    Pairs whose lengths cannot reach ``least`` are pruned before the sets are compared.
    """
    rows = with_signatures(docs.select(F.col(id_col).alias("_id"),
                                       text_or_empty(text_col).alias("_text")), "_text", "_sigs")
    sets, _ = written(rows.where(F.size("_sigs") > 0).groupBy("_sigs").agg(F.min("_id").alias("_id"))
                      .withColumn("_n", F.size("_sigs"))
                      .withColumn("_row", F.monotonically_increasing_id()))
    known = sets.select("_row", "_n", F.explode("_sigs").alias("_sig"))
    often = known.groupBy("_sig").agg(F.count("*").alias("_often"))
    # rarest first; the order must be the same for all sets
    ranked = (known.join(often, "_sig").groupBy("_row", "_n")
              .agg(F.sort_array(F.collect_list(F.struct("_often", "_sig"))).alias("_all")))
    keep = F.col("_n") - F.ceil(F.lit(least) * F.col("_n") - 1e-9).cast("int") + 1
    rare = ranked.select("_row", "_n", F.explode(F.slice("_all", F.lit(1), keep)).alias("_x"))
    size_class = F.floor(F.log(F.col("_n").cast("double")) / F.log(F.lit(1.0 / least)) + 1e-9)
    rare = rare.select("_row", "_n", F.col("_x._sig").alias("_sig"), size_class.alias("_class"))
    # the shorter of a pair looks in its own class and the next
    left = rare.select(F.col("_row").alias("_a"), F.col("_n").alias("_na"), "_sig",
                       F.explode(F.array("_class", F.col("_class") + 1)).alias("_class"))
    right = rare.select(F.col("_row").alias("_b"), F.col("_n").alias("_nb"), "_sig", "_class")
    pairs = (left.join(right, ["_sig", "_class"])
             .where((F.col("_na") < F.col("_nb")) | ((F.col("_na") == F.col("_nb"))
                                                     & (F.col("_a") < F.col("_b"))))
             .where(F.col("_na") >= F.col("_nb") * F.lit(least) - 1e-9)
             .select("_a", "_b").distinct())
    a = sets.select(F.col("_row").alias("_a"), F.col("_id").alias("left_id"), F.col("_sigs").alias("_sa"))
    b = sets.select(F.col("_row").alias("_b"), F.col("_id").alias("right_id"), F.col("_sigs").alias("_sb"))
    return (pairs.join(a, "_a").join(b, "_b")
            .select("left_id", "right_id", likeness(F.col("_sa"), F.col("_sb")).alias("likeness"))
            .where(F.col("likeness") >= least))
