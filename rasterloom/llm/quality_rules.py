"""Quality rules in Spark's own functions: counts per text, and a likelihood ratio of n-grams.

The ratio compares two multinomials over hashed uni- and bigrams of tokens (runs of letters,
of digits, of signs): one of a trusted target, one of the whole raw corpus. A text's score is
its mean log ratio per n-gram, so length doesn't matter; every text meets the same threshold.
Counts cover the whole corpus. Only the table of `buckets` numbers, a parameter, goes back to
all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and the signs that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Tokens of the likelihood ratio.
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column, size: int) -> Column:
    """Words in windows of so many words that are found twice or more in one text.

    Only texts in which a window of half the size recurs can have any; others end there.
    """
    zero = F.lit(0).cast("long")

    def windows(h: Column, k: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))

    def places(s: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
        return F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))

    def covered(p: Column) -> Column:
        start = F.struct(zero.alias("n"), F.lit(-size).alias("last"))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(size), x - a["last"])).alias("n"), x.alias("last"))
        return F.aggregate(p, start, step, lambda a: a["n"])

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(pairs, lambda s: F.sort_array(F.transform(places(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), covered(found)).otherwise(zero)

    def of(h: Column) -> Column:
        n = F.size(h)
        recurs = let(windows(h, size // 2), lambda g: F.size(F.array_distinct(g)) < n)
        whole = F.slice(windows(h, size), F.lit(1), F.greatest(n - size + 1, F.lit(0)))
        return F.when((n > size) & recurs, let(whole, count)).otherwise(zero)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def with_statistics(docs: DataFrame, text: str, window: int = 8) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"__words": words_of(F.col(text)), "__lines": lines})
    return out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words"), window),
        }
    ).drop("__words", "__lines")


def _bucket(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _tokens(docs: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """kept, and a row (a, b) for each token of a text and the one after it, empty at the end; nulls for no token."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    out = docs.select(*kept, found.alias("__a"))
    after = F.concat(F.slice("__a", 2, 2**31 - 1), F.array(F.lit("")))
    return out.select(*kept, F.inline_outer(F.when(F.size("__a") > 0, F.arrays_zip("__a", after.alias("__b")))).alias("a", "b"))


def _perhaps_in(keys: DataFrame, key: str, bits: int) -> Callable[[Column], Column]:
    """A test that every key of keys passes, and few others: a bit for each key hash, in a table of so many bits at most.

    It only spares work before an exact join, the less so the more keys there are for its size.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = place(F.col(key))
    parts = keys.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    table = parts.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("t")).scalar()

    def test(c: Column) -> Column:
        bit = F.bitmap_bit_position(place(c))
        byte = F.conv(F.hex(F.substring(F.element_at(table, F.bitmap_bucket_number(place(c))), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))

    return test


def log_ratios(docs: DataFrame, target: DataFrame, *, text: str, key: str, buckets: int, smoothing: float, filter_bits: int = 1 << 25) -> DataFrame:
    """One row, ratios: array<double> by bucket, log of target's over raw corpus's probability.

    target: (key) of trusted rows; keys that are null or not in docs don't matter.
    """

    def grams(docs: DataFrame, raw: int, trusted: int) -> DataFrame:
        tokens = _tokens(docs, "__t", []).filter("a IS NOT NULL")
        counted = tokens.select(F.explode(F.array(_bucket(buckets, "a"), _bucket(buckets, "a", "b"))).alias("bucket"))
        return counted.select("bucket", F.lit(raw).cast("long").alias("raw"), F.lit(trusted).cast("long").alias("target"))

    trusted = target.select(F.col(key).cast(docs.schema[key].dataType).alias("__key")).filter("__key IS NOT NULL").distinct()
    every = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t"))
    # the whole corpus is counted where it lies; the same join at every size of the target, so costs grow as the input does
    some = every.filter(_perhaps_in(trusted, "__key", filter_bits)(F.col("__k"))).join(trusted.hint("merge"), F.col("__k") == F.col("__key"), "left_semi")
    counts = grams(every, 1, 0).unionByName(grams(some, 0, 1)).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    total = counts.agg(F.collect_list(F.struct("bucket", "raw", "target")).alias("c"), F.coalesce(F.sum("raw"), F.lit(0)).alias("n_raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("n_target"))
    room = smoothing * buckets
    share = lambda n, total: F.log((F.coalesce(n, F.lit(0)) + smoothing) / (total + room))
    # a dense array by bucket: those never met are added with nulls, and sorting puts all in place
    unmet = F.array_except(F.sequence(F.lit(0), F.lit(buckets - 1)), F.transform("c", lambda x: x["bucket"]))
    none = F.lit(None).cast("long")
    every = F.sort_array(F.concat("c", F.transform(unmet, lambda b: F.struct(b.alias("bucket"), none.alias("raw"), none.alias("target")))))
    return total.select(F.transform(every, lambda x: share(x["target"], F.col("n_target")) - share(x["raw"], F.col("n_raw"))).alias("ratios"))


def quality_rules(docs: DataFrame, target: DataFrame, *, text: str = "text", key: str = "doc_id", buckets: int = 16384, smoothing: float = 1.0, threshold: float = -0.1, filter_bits: int = 1 << 25, min_words: int = 20, repeat_percent: int = 30, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns but the text, if None) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    score: the mean log ratio of a text's n-grams, 0 for a text without any; kept: not
    base_failed, and a score of at least threshold. A null text is one without words, so it fails
    the base rules; a null key is never in the target. Repeated rows are scored each, and counted
    each in the corpus. A very long text is one row of tokens after another, but its words are
    held at once. filter_bits: size of the table that spares most texts outside the target the
    way to the target's join, which is exact. If the target is empty, all ratios are those of smoothing alone. An empty
    table gives an empty result. Columns named as a result are replaced; kept ones can't be maps.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in new]
    table = log_ratios(docs, target, text=text, key=key, buckets=buckets, smoothing=smoothing, filter_bits=filter_bits).scalar()
    counted = with_statistics(docs.select(*keep, F.col(text).alias("__text")), "__text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    counted = counted.withColumns({"base_failed": failed, "__row": F.monotonically_increasing_id()})
    own = ["__row", *keep, *new[:6]]
    # a text's tokens stay in its task, so what is dealt is one sum for each text
    sums = _tokens(counted, "__text", own).groupBy(*own).agg(F.sum(F.get(table, _bucket(buckets, "a")) + F.get(table, _bucket(buckets, "a", "b"))).alias("s"), F.count("a").alias("n"))
    score = F.when(F.col("n") > 0, F.col("s") / (2 * F.col("n"))).otherwise(F.lit(0.0))
    return sums.select(*keep, *new[:6], score.alias("score")).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
