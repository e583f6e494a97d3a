"""URL filter: host and path rules, else a character language-model ratio.

URLs that a rule decides are the training data: one smoothed variable-order
Markov model for accepted and one for rejected URLs. A character's
probability after its ``ORDER`` last characters is interpolated down to the
uniform one; a context that a model has never seen leaves the shorter one unchanged.
A URL is judged by the difference of its two log-likelihoods per character
against a threshold calibrated on ruled URLs kept out of the counts.

The models read the whole URL (scheme, host, path, query, fragment), rules host and path.

Everything is DataFrame functions. Counting is one grouped count over
(order + 1)-grams; shorter contexts are sums of those. Characters are folded
to an alphabet of ``len(ALPHABET)`` symbols, so the tables are bounded by its
powers: the two shorter orders are broadcast under that bound, the gram
table only if its counted size allows, else it is joined by shuffle with
hot grams salted.

Defined results: a null URL or one without ``://`` has empty host and path,
no rule, and is judged by the models like any other, by its whole text (null: empty); null page ids are kept;
repeated rows are judged each; an empty table gives no rows; without ruled
URLs of both kinds the threshold is 0 and a tie is allowed; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# --- Fixed values: rules (host and path, verdict) -------------------------------
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
         ("org/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END, OTHER = "^", "$", "*"
MARKS = "./:?#&=%+_-"
ALPHABET = LOWER + "0" + MARKS + OTHER + START + END  # digits are folded to 0
ORDER = 3
STRENGTH = 2.0  # pseudo-counts that a longer context gives to the shorter one
MOST_BROADCAST = 200_000  # rows of the gram table
SALTS = 16


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    known = F.instr(F.col(url), "://") > 0
    rest = F.substring_index(F.col(url), "://", 1)
    rest = F.substring(F.col(url), F.length(rest) + F.lit(4), F.length(F.col(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.when(known, host).otherwise(empty), F.when(known, path).otherwise(empty)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule (null: none) and its verdict; the longest rule that fits wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def folded(url: Column) -> Column:
    """The whole URL over the model's alphabet, between start and end symbols."""
    text = F.lower(F.coalesce(url, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, r"[0-9]", "0"), f"[^a-z0{MARKS}]", OTHER)
    return F.concat(F.lit(START * ORDER), text, F.lit(END))


def _grams(text: str) -> Column:
    """All (ORDER + 1)-grams: one per character and the end symbol."""
    return F.expr(f"transform(sequence(1, length({text}) - {ORDER}), "
                  f"i -> substring({text}, i, {ORDER + 1}))")


def gram_scores(rows: DataFrame) -> DataFrame:
    """(gram, delta): log P(last | rest) of the accepted less the rejected model.

    ``rows`` has _text and _class (1 accepted, 0 rejected, null: only needs scores).
    """
    n = ORDER + 1
    grams = (rows.select(F.explode(_grams("_text")).alias("gram"), "_class")
             .groupBy("gram").agg(F.count_if(F.col("_class") == 1).alias("n1"),
                                  F.count_if(F.col("_class") == 0).alias("n0")))
    grams, _ = written(grams)
    table = grams.withColumn("p1", F.lit(1.0 / len(ALPHABET))).withColumn("p0", F.col("p1"))
    for k in range(1, n + 1):
        # counts of the last k symbols, and of the k - 1 before the last one
        tail = F.expr(f"substring(gram, {n - k + 1}, {k})")
        before = F.expr(f"substring(gram, {n - k + 1}, {k - 1})")
        context = grams.groupBy(before.alias("context")).agg(F.sum("n1").alias("c1"),
                                                             F.sum("n0").alias("c0"))
        table = table.withColumns({"tail": tail, "context": before})
        if k < n:
            seen = grams.groupBy(tail.alias("tail")).agg(F.sum("n1").alias("g1"),
                                                         F.sum("n0").alias("g0"))
            table = table.join(F.broadcast(seen), "tail")  # at most len(ALPHABET) ** ORDER rows
        else:
            table = table.withColumns({"g1": F.col("n1"), "g0": F.col("n0")})
        table = table.join(F.broadcast(context), "context")  # the same bound
        table = table.withColumns({
            f"p{c}": (F.col(f"g{c}") + STRENGTH * F.col(f"p{c}")) / (F.col(f"c{c}") + STRENGTH)
            for c in "10"}).drop("tail", "context", "g1", "g0", "c1", "c0")
    return table.select("gram", (F.log("p1") - F.log("p0")).alias("delta"))


def _summed(rows: DataFrame, scores: DataFrame, keep: list[str]) -> DataFrame:
    """Mean delta over the grams of each row."""
    spread = rows.select(*keep, F.explode(_grams("_text")).alias("gram"))
    if scores.count() <= MOST_BROADCAST:
        joined = spread.join(F.broadcast(scores), "gram")
    else:  # a gram that most URLs hold is spread over SALTS tasks
        salted = scores.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = (spread.withColumn("_salt", (F.col("_row") % SALTS).cast("int"))
                  .join(salted, ["gram", "_salt"]))
    return joined.groupBy(*keep).agg(F.avg("delta").alias("ratio"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules=RULES) -> DataFrame:
    """``id_col``, host, path, rule, verdict, ratio (log-likelihood difference
    per character) and threshold, one row per page."""
    host, path = host_and_path("_url")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = (pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
            .select("_id", host.alias("host"), path.alias("path"), folded(F.col("_url")).alias("_text"))
            .select("*", rule.alias("rule"), verdict.alias("ruling"))
            .withColumn("_row", F.monotonically_increasing_id()))
    accepted = F.when(F.col("ruling") == "allow", 1).when(F.col("ruling") == "block", 0)
    aside = F.crc32(F.col("_text").cast("binary")) % 5 == 0
    scores, _ = written(gram_scores(rows.select(
        "_text", F.when(~aside, accepted).alias("_class"))))
    judged = _summed(rows, scores, ["_row", "_id", "host", "path", "rule", "ruling", "_text"])
    judged, _ = written(judged)

    # where both classes are equally many standard deviations away
    stats = {r.ruling: r for r in judged.where(F.col("ruling").isNotNull() & aside)
             .groupBy("ruling").agg(F.avg("ratio").alias("mean"),
                                    F.coalesce(F.stddev_pop("ratio"), F.lit(0.0)).alias("sd"))
             .collect()}
    threshold = 0.0
    if len(stats) == 2:
        a, b = stats["allow"], stats["block"]
        sa, sb = a["sd"] + 1e-9, b["sd"] + 1e-9
        threshold = (a["mean"] * sb + b["mean"] * sa) / (sa + sb)
    return judged.select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruling", F.when(F.col("ratio") >= threshold, "allow").otherwise("block"))
        .alias("verdict"), "ratio", F.lit(threshold).alias("threshold"))
