"""Quality rules: plain text counts and a hashed n-gram log-likelihood ratio.

A word's n-grams are the word, its last ``ENDING`` characters, and the pair with the word that follows. Two multinomials over
their hashes are counted in one pass over all documents: the raw corpus, and the trusted target (all documents labelled
good). The target is interpolated with the raw one, so a document's score is the mean over its n-grams of
``ln(MIX * p_target(bucket) / p_raw(bucket) + 1 - MIX)``. An n-gram that no trusted document has costs ``ln(1 - MIX)``,
however often it is repeated and whatever the size of the corpus. Equal texts that hold over ``HOT_SHARE`` of all rows, so at most
its inverse of them, weigh as much as one of them: a text does not become worse by being copied.

The threshold follows the corpus: every trusted document is scored with its own counts taken out of the target, as if
it were not trusted, and a document goes if it scores over ``SPREAD`` standard deviations below their mean. Everything is built-in expressions: the counts are one partial aggregation, the weights
reach the scan as a scalar subquery, and scoring moves no text between executors. Buckets grow as the cube root of
the corpus, from 2^15 up: 2^22 of them, 32 MB, at 100 TB.

Defined results: null and empty texts have no words, fail the base rule and score 0; a repeated row is judged
like the first; labels that are missing, null or of unknown documents are ignored; without any trusted document all
ratios are 0; with fewer than two that have words there is no threshold; the base rule decides alone then. An empty
table gives no rows. Other columns of ``docs``, whatever their names, are not read; :func:`filter_documents` returns them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.common import SPACE, SPACE_CLASS, cut, few, let, table

#: Buckets of n-gram hashes, at least (a power of two), and how many there are for each cube root of a byte of text.
BUCKETS = 1 << 15
GROWTH = 48
#: Characters of a word's ending.
ENDING = 3
#: Share of the target in its interpolation with the raw corpus.
MIX = 0.8
#: How many standard deviations below the mean of the trusted documents' scores the threshold lies.
SPREAD = 3.5
#: Share of all rows over which equal texts count as one; beneath it their weight hardly moves the raw multinomial.
HOT_SHARE = 1 / 1000
#: Trusted documents that are broadcast, at most; more are joined, with the same result.
MAX_BROADCAST = 1_000_000
MIN_WORDS = 50
#: Repeated windows of a text that are searched one by one.
FEW = 16
SYMBOL_CLASS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Words of a text, split at ASCII white space; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS + "+")))


def _neighbours(hashes: Column) -> Column:
    """A hash of each two neighbouring hashes."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.transform(F.slice(hashes, 1, n), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))


def repeat_words(pairs: Column, few: int = FEW) -> Column:
    """Words, given by the hashes of each two neighbours, that lie in 3-word windows found twice or more in the text.

    Windows are compared by 64-bit hash. Texts in which all windows differ stop after one hash-set pass. In the others the
    repeated hashes are found by sorting, and their places by a search among them or, of over ``few``, by sorting places
    with their hashes, so the cost stays n log n for any length.
    """

    def searched(hashes: Column, repeated: Column) -> Column:
        return F.array_compact(F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)))

    def sorted_(hashes: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)

    def covered(hashes: Column) -> Column:
        repeated = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, j: x == F.get(s, j - 1))))
        return F.aggregate(
            let(repeated, lambda r: F.when(F.size(r) <= few, searched(hashes, r)).otherwise(sorted_(hashes))),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    return let(_neighbours(pairs), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def _ending(word: Column) -> Column:
    return F.xxhash64(F.lit(ENDING), F.substring(word, -ENDING, ENDING))


def gram_hashes(text: Column) -> Column:
    """Hashes of the n-grams of a text: its words, their endings, and the pairs of neighbours."""
    return let(words_of(text), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(h, F.transform(w, _ending), _neighbours(h))))


def _n_grams(words: Column) -> Column:
    """How many n-grams a text of these words has."""
    return F.greatest(3 * F.size(words) - 1, F.lit(0))


def _grams(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, h): each of the :func:`gram_hashes` of ``rows`` (columns, words) in a row of its own. Generators are compiled, where
    functions of arrays are interpreted for each word. They take an expression: of a bare column Spark would infer a filter, which
    counts the n-grams once more, and before any join."""
    following = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    words = rows.select(*columns, F.explode(F.arrays_zip(F.col("words").alias("word"), following.alias("next"))).alias("_w")).select(*columns, "_w.word", "_w.next")
    pair = F.when(F.col("next").isNotNull(), F.xxhash64(F.xxhash64("word"), F.xxhash64("next")))
    return words.select(*columns, F.explode(F.array(F.xxhash64("word"), _ending(F.col("word")), pair)).alias("h")).where("h is not null")


def text_groups(docs: DataFrame) -> DataFrame:
    """(text, n, size): a hash of each distinct text with the rows that hold it and its bytes."""
    return docs.select(F.xxhash64("text").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).groupBy("text").agg(F.count("*").alias("n"), F.max("size").cast("long").alias("size"))


def corpus_buckets(groups: DataFrame) -> int:
    """How many buckets the n-grams of the distinct texts are counted in."""
    size = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return max(BUCKETS, 1 << math.ceil(math.log2(GROWTH * max(1, size) ** (1 / 3))))


def weighted(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, text, weight) of each row: texts with many copies weigh 1 together."""
    total = groups.agg(F.sum("n")).scalar()
    hot = groups.where((F.col("n") > 1) & (F.col("n") > HOT_SHARE * total)).select(F.col("text").alias("_text"), (1 / F.col("n")).alias("_weight"))
    rows = docs.select("doc_id", "text").join(F.broadcast(hot), F.xxhash64("text") == F.col("_text"), "left")
    return rows.select("doc_id", "text", F.coalesce("_weight", F.lit(1.0)).alias("weight"))


def _marks(trusted: DataFrame, max_broadcast: int) -> DataFrame:
    """(doc_id) of the trusted documents, marked for a broadcast if they are not too many."""
    return few(trusted.select("doc_id").where("doc_id is not null").distinct(), max_broadcast)


def gram_counts(rows: DataFrame, trusted: DataFrame, buckets: int, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(bucket, raw, target): weighted occurrences in all ``rows`` (doc_id, text, weight) and in the ``trusted`` ones (doc_id)."""
    marked = _marks(trusted.select("doc_id"), max_broadcast).withColumn("trusted", F.lit(True))
    grams = _grams(rows.join(marked, "doc_id", "left").select("trusted", "weight", words_of(F.col("text")).alias("words")), "trusted", "weight")
    target = F.sum(F.when(F.col("trusted"), F.col("weight")).otherwise(0.0))
    return grams.groupBy(_bucket(F.col("h"), buckets).cast("int").alias("bucket")).agg(F.sum("weight").alias("raw"), target.alias("target"))


def _bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1).cast("long"))


def _ratio(target: Column, n_target: Column, raw: Column, n_raw: Column) -> Column:
    share = (target / n_target) / (raw / n_raw)
    return F.when((n_target > 0) & (raw > 0), F.log(MIX * share + (1 - MIX))).otherwise(0.0)


def likelihood_ratios(counts: DataFrame, buckets: int) -> DataFrame:
    """One row with ``ratios``, the log-likelihood ratio of each bucket."""
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    seen = F.transform("c", lambda x: F.struct(x["bucket"].alias("b"), _ratio(x["target"], F.col("n_target"), x["raw"], F.col("n_raw")).alias("r")))
    missing = F.array_except(F.sequence(F.lit(0), F.lit(buckets - 1)), F.transform("c", lambda x: x["bucket"]))
    every = F.concat(seen, F.transform(missing, lambda b: F.struct(b.alias("b"), F.lit(0.0).alias("r"))))
    return listed.select(F.transform(F.array_sort(every), lambda x: x["r"]).alias("ratios"))


def trusted_scores(rows: DataFrame, counts: DataFrame, trusted: DataFrame, buckets: int, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, llr) of the ``trusted`` documents that have words, each without its own counts in the target; the rows of a
    repeated doc_id are counted together. Their texts are dealt by doc_id once, and n-grams are counted where they are."""
    own = rows.join(_marks(trusted, max_broadcast), "doc_id").select("doc_id", "weight", "text")
    repeated = cut(rows.select("doc_id").join(_marks(trusted, max_broadcast), "doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    size = lambda words: F.col("weight") * _n_grams(words)
    summed = own.join(few(repeated, max_broadcast), "doc_id").groupBy("doc_id").agg(F.sum(size(words_of(F.col("text")))).alias("_all"))
    dealt = own.repartition("doc_id").select("doc_id", "weight", words_of(F.col("text")).alias("words"))
    dealt = dealt.select("doc_id", "weight", size("words").alias("all"), "words").join(few(cut(summed), max_broadcast), "doc_id", "left")
    grams = _grams(dealt.select("doc_id", "weight", F.coalesce("_all", "all").alias("all"), "words"), "doc_id", "weight", "all")
    each = grams.groupBy("doc_id", _bucket(F.col("h"), buckets).cast("int").alias("bucket")).agg(F.count("*").alias("c"), F.sum("weight").alias("own"), F.max("all").alias("all"))
    total = cut(counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    rest = total.select("target").scalar() - F.col("all")
    ratio = _ratio(F.greatest(F.col("target") - F.col("own"), F.lit(0.0)), rest, F.col("raw"), total.select("raw").scalar())
    known = each.join(F.broadcast(counts), "bucket")  # as many rows as buckets
    return known.where(rest > 1e-6).groupBy("doc_id").agg((F.sum(F.col("c") * ratio) / F.sum("c")).alias("llr"))


def learned_threshold(rows: DataFrame, counts: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """One row: the mean of all trusted documents' scores less ``SPREAD`` standard deviations, null for fewer than two."""
    return trusted_scores(rows, counts, trusted, buckets).agg((F.avg("llr") - SPREAD * F.stddev("llr") - 1e-9).alias("threshold"))


def score_documents(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, buckets: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """Counts, log-likelihood ratio and verdict for each row of ``docs``; ``threshold``: learned unless given; ``carry``: its
    columns to return (doc_id)."""
    carry = carry or ["doc_id"]
    groups = cut(text_groups(docs))
    buckets = buckets or corpus_buckets(groups)
    rows = weighted(docs, groups)
    counts = cut(gram_counts(rows, trusted, buckets))
    ratios = likelihood_ratios(counts, buckets)
    least = F.lit(threshold) if threshold is not None else cut(learned_threshold(rows, counts, trusted, buckets)).scalar()
    text = F.coalesce(F.col("text"), F.lit(""))

    def measured(w: Column, r: Column) -> Column:
        def counted(h: Column, pairs: Column) -> Column:
            def total(values: Column, key) -> Column:
                return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.get(r, _bucket(key(x), buckets)))

            grams = 2 * F.size(h) + F.size(pairs)
            llr = F.when(grams > 0, (total(h, lambda x: x) + total(w, _ending) + total(pairs, lambda x: x)) / grams).otherwise(0.0)
            return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(pairs).cast("long").alias("n_repeat_words"), llr.alias("llr"))

        hashed = F.transform(w, lambda x: F.xxhash64(x))
        return let(let(hashed, lambda h: let(_neighbours(h), lambda p: counted(h, p))), judged)

    def judged(m: Column) -> Column:
        # The verdict is part of the same value, so a filter on it evaluates the whole once.
        failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)
        fields = [m[c].alias(c) for c in ("n_words", "n_repeat_words", "llr")]
        passed = F.coalesce(m["llr"] >= F.col("_least"), F.lit(True))
        return F.struct(*fields, failed.alias("base_failed"), (~failed & passed).alias("kept"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select(*carry, "text", ratios.scalar().alias("_ratios"), least.alias("_least"))
        .select(
            *carry,
            # Named once, the ratios are put here by the optimizer; as a column all of them would be copied for each row.
            let(F.col("_ratios"), lambda r: let(words_of(text), lambda w: measured(w, r))).alias("_m"),
            F.length(F.regexp_replace(text, SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOL_CLASS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )
        .select(*carry, "_m.n_words", "word_chars", "n_symbols", "n_dup_lines", "_m.n_repeat_words", "_m.llr", "_m.base_failed", "_m.kept")
    )


def trusted_documents(labels: DataFrame) -> DataFrame:
    """doc_ids labelled good, all of them."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns, that the rules keep."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")  # columns may have the names of the counts
    return score_documents(rows, trusted_documents(labels), threshold, carry=["_row"]).where("kept").select("_row.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), trusted_documents(table(spark, sf_dir, "labels")))
