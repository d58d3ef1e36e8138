"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

A text's five-word shingles are hashed once. A hash's low bits name its bin, the rest is its
value; a bin keeps its smallest value. One sentinel a bin joins the hashes before they are
sorted, so that the first entry of every bin, in order, is its minimum or shows that it is
empty. Optimal densification fills an empty bin from a non-empty one that a hash of the
two bins' numbers selects, which all texts agree on. The low byte of each bin is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, WORDS = 128, 8, 5
_VALUE_BITS = 55
_EMPTY = (1 << _VALUE_BITS) - 1
#: Rows of a bucket that neighbours in order of their ids share, and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 2048, 20_000


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = WORDS, bins: int = BINS) -> DataFrame:
    """``df`` with ``name``: an array of ``bins`` bytes (0-255), empty for a text without words or null.

    Words stand between white space, in lower case. Fewer than ``words`` words are one shingle.
    ``bins`` is a power of two up to 128. Equal texts have equal arrays.
    """
    if bins & (bins - 1) or not 2 <= bins <= 128:
        raise ValueError("bins must be a power of two up to 128")
    w, h, m, d = (f"_{name}_{x}" for x in "whmd")
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(w, F.filter(F.split(lowered, r"\s+"), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    at = lambda i, k: F.get(F.col(h), i + k)
    many = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[at(i, k) for k in range(words)]))
    few = F.array(F.xxhash64(F.array_join(w, " ")))
    shingles = F.when(F.size(h) >= words, many).when(F.size(h) > 0, few).otherwise(F.array().cast("array<bigint>"))
    coded = F.transform(shingles, lambda x: F.shiftleft(x.bitwiseAND(F.lit(bins - 1).cast("long")), _VALUE_BITS).bitwiseOR(F.shiftrightunsigned(x, 64 - _VALUE_BITS)))
    sentinels = F.array(*[F.lit((b << _VALUE_BITS) | _EMPTY).cast("long") for b in range(bins)])
    df = df.withColumn(m, F.sort_array(F.concat(coded, sentinels)))
    bin_of = lambda x: F.shiftright(x, _VALUE_BITS)
    first = F.filter(F.col(m), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(m), i - 1))))
    df = df.withColumn(d, F.transform(first, lambda x: x.bitwiseAND(F.lit(_EMPTY))))
    full = f"_{name}_f"
    numbers = F.sequence(F.lit(0), F.lit(bins - 1))
    df = df.withColumn(full, F.filter(numbers, lambda b: F.get(F.col(d), b) != _EMPTY))
    order = lambda i, j: F.xxhash64(i, j).bitwiseAND(F.lit(~(bins - 1)).cast("long")).bitwiseOR(j.cast("long"))
    donor = lambda i: F.array_min(F.transform(F.col(full), lambda j: order(i, j))).bitwiseAND(F.lit(bins - 1).cast("long")).cast("int")
    filled = F.transform(F.col(d), lambda x, i: F.when(x != _EMPTY, x).otherwise(F.get(F.col(d), donor(i))))
    low = F.transform(filled, lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("short"))
    df = df.withColumn(name, F.when(F.size(full) > 0, low).otherwise(F.array().cast("array<smallint>")))
    return df.drop(w, h, m, d, full)


def packed(fingerprint: Column) -> Column:
    """The fingerprint's bytes as lower-case hexadecimal digits; empty for one of no words."""
    byte = lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))
    return F.array_join(F.transform(fingerprint, byte), "")


def likeness(a: Column, b: Column) -> Column:
    """The similarity (0 to 1) of the sets behind two fingerprints, corrected for equal low bits by chance.

    Two of no words are alike, one of no words is like no other. Null where one is null.
    """
    chance = 2.0**-BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    some = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(both > 0, some)


def with_next(docs: DataFrame, key: str, columns: dict[str, str], ties: list[str]) -> DataFrame:
    """``docs`` with the values of the next row in order of ``key`` (after the last: of the first).

    ``columns`` maps new names to those whose next value they get. Null keys come first, equal
    keys are ordered by ``ties``. Rows go to buckets between quantiles of the key; the first
    row of each bucket is also sent to the one before, so that no order over all rows is
    needed. The driver holds one key a bucket. Fails where more rows than a bucket should hold
    share one key only in being slower: they stand in one bucket.
    """
    spark = docs.sparkSession
    ordered = docs.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
    rows = ordered.count()
    n = min(MOST_BUCKETS, max(1, rows // BUCKET_ROWS))
    bounds = sorted(set(map(int, ordered.approxQuantile("_key", [i / n for i in range(1, n)], 0.25 / n)))) if n > 1 else []
    found = F.lit(0)
    if bounds:
        array = F.array(*[F.lit(b).cast("long") for b in bounds])
        steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
        found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= F.col("_key"), at + step).otherwise(at))
    ordered = ordered.withColumn("_bucket", found)
    firsts = sorted(ordered.groupBy("_bucket").agg(F.min("_key")).collect())  # a row a bucket
    before = [(b, k, firsts[i - 1][0], i == 0) for i, (b, k) in enumerate(firsts)] or [(0, 0, 0, True)]
    edges = spark.createDataFrame(before, "_bucket int, _first long, _before int, _wraps boolean")
    own = F.struct(F.col("_bucket"), F.lit(False).alias("copy"), F.lit(False).alias("wraps"))
    copy = F.struct(F.col("_before").alias("_bucket"), F.lit(True).alias("copy"), F.col("_wraps").alias("wraps"))
    sent = ordered.join(F.broadcast(edges), "_bucket")
    sent = sent.withColumn("_to", F.explode(F.when(F.col("_key") == F.col("_first"), F.array(own, copy)).otherwise(F.array(own))))
    sent = sent.select(*docs.columns, "_key", F.col("_to._bucket").alias("_bucket"), F.col("_to.copy").alias("_copy"), F.col("_to.wraps").alias("_wraps"))
    in_order = Window.partitionBy("_bucket").orderBy("_wraps", "_key", "_copy", *ties)
    for new, old in columns.items():
        sent = sent.withColumn(new, F.lead(old).over(in_order))
    return sent.where(~F.col("_copy")).drop("_key", "_bucket", "_copy", "_wraps")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as much of the beginning of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and their likeness and the next document's.

    A null text is empty. Repeated rows are documents of their own.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_fingerprint(rows, "text", "print")
    rows = with_next(rows, "doc_id", {"next_text": "text", "next_print": "print"}, ["text"])
    rows = rows.select("doc_id", "print", "next_print", F.length("text").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_print")
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("print")).alias("fingerprint"),
        packed(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
