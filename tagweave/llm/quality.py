"""Operator 6: quality rules with thresholds learned per language and source.

DataFrame functions only.  Each document is measured in its row.  The distribution of every
measure within a language and source, over the documents that pass the base rules, is kept as a
mergeable quantile sketch: counts of logarithmic buckets (relative error about 1 %), so sketches
of tasks, of sources and of languages merge by adding counts, in any order, with the same
result.  Every fence follows from the sketches of its group: a high quantile plus a multiple of
the spread below it, and for a share no lower than what a few hits are in a document of the
group's median size.  A group too small to speak for itself uses the merged sketch of its
language, or of everything.  The fences are then joined to the measured documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.session import cut_lineage

BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"

#: Width of a sketch bucket: values within it differ by this factor at most.
GAMMA = 1.02
ZERO_BUCKET = -1_000_000
#: Documents below which a group's own sketch is not used.
MIN_GROUP = 200
#: Groups (about 100 bytes each) whose fences are broadcast at most.
BROADCAST_GROUPS = 50_000
#: Measure -> (quantile level of the body, its widths up to a fence, whether low values are out
#: too, for a share the count that it is taken of and the hits (symbols, equal lines, repeated
#: words) in a document of median size that are never out: so few can be chance where most of a
#: group has none).  The body runs from quantile 1 - level to level.
#: Junk by symbols or word length may be up to a quarter of a group; of equal lines and
#: repeats the base rules have taken the worst, so that their far tail can speak.
MEASURES = {
    "mean_word": (0.75, 5.0, True, None, 0),
    "symbol_share": (0.75, 5.0, False, "word_chars", 9),
    "dup_line_share": (0.99, 2.0, False, "n_lines", 3),
    "repeat_share": (0.99, 2.0, False, "n_words", 9),
}
#: Counts whose median gives the size of a group's documents.
SIZES = sorted({size for *_, size, _ in MEASURES.values() if size})
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns (none may start with ``__``), the counts, ``n_lines``, ``base_failed`` and the measures.

    Null text: no words, so every count is 0 and every share is null.  Arrays of a document
    stay in its row; each stage refers to the one before more than once, so that Catalyst keeps
    it as a column of its own instead of evaluating it once per element.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.col(c) for c in keep]
    names = list(keep)
    a = docs.select(*kept, text.alias("__t"))
    a = a.select(*names, F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                 F.expr(r"filter(split(__t, '[\\x20\\x09-\\x0D]+'), x -> x <> '')").alias("__w"),
                 F.expr(r"filter(split(__t, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("__l"))
    names.append("n_symbols")
    a = a.select(*names, F.size("__w").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
                 F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
                 # Windows of three words with their place, sorted: equal windows stand together.
                 # Words hold no space, so three spaces end the words exactly.
                 F.expr("""array_sort(transform(if(size(__w) < 3, array(), sequence(0, size(__w) - 3)),
                        i -> concat(__w[i], ' ', __w[i + 1], ' ', __w[i + 2], ' ', cast(1000000000 + i as string))))""").alias("__g"))
    names += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    a = a.select(*names, F.expr("transform(__g, x -> substring(x, 1, length(x) - 10))").alias("__k"), "__g")
    a = a.select(*names, F.expr("""array_sort(transform(filter(
            if(size(__k) = 0, array(), sequence(0, size(__k) - 1)),
            j -> (j > 0 and __k[j] = get(__k, j - 1)) or __k[j] = get(__k, j + 1)),
            j -> cast(right(__g[j], 10) as int) - 1000000000))""").alias("__r"))
    # A window covers three words; overlapping windows cover some of them twice.
    a = a.select(*names, F.expr("""aggregate(__r, named_struct('last', -3, 'n', 0L),
            (s, p) -> named_struct('last', p, 'n', s.n + least(3, p - s.last)), s -> s.n)""").alias("n_repeat_words"))
    words = F.col("n_words")
    some = lambda x: F.when(words > 0, x)
    return a.select(
        *keep, *COUNTS, "n_lines",
        ((words < 50) | (100 * F.col("n_repeat_words") > 50 * words)).alias("base_failed"),
        some(F.col("word_chars") / words).alias("mean_word"),
        some(F.col("n_symbols") / F.col("word_chars")).alias("symbol_share"),
        F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).alias("dup_line_share"),
        some(F.col("n_repeat_words") / words).alias("repeat_share"))


def bucket_of(value: Column) -> Column:
    """Sketch bucket of a value of 0 or more."""
    return F.when(value > 0, F.ceil(F.log(value) / F.log(F.lit(GAMMA)))).otherwise(F.lit(ZERO_BUCKET)).cast("int")


def value_of(bucket: Column) -> Column:
    """The value that stands for a bucket."""
    return F.when(bucket == ZERO_BUCKET, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), bucket) / (GAMMA + 1))


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: mergeable quantile sketches by adding ``n``.

    Of the documents that pass the base rules, every measure and the sizes behind the shares.
    Tasks pre-aggregate, so a hot source reaches the shuffle as its few buckets per task.
    """
    # A filter on ``base_failed`` would be pushed into the measures and repeat their expressions.
    value = lambda m: F.when(~F.col("base_failed"), F.col(m).cast("double")).alias("value")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), value(m)) for m in (*MEASURES, *SIZES)]))
    return measured.select("lang", "source", each.alias("m")).filter("m.value is not null") \
        .select("lang", "source", "m.measure", bucket_of(F.col("m.value")).alias("bucket")) \
        .groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(sketched: DataFrame) -> DataFrame:
    """``lang, source`` and ``<measure>_lo`` / ``_hi`` for every pair in the sketches, nulls included.

    A pair with fewer than ``MIN_GROUP`` documents takes the merged sketch of its language, and
    that of all documents where the language has too few as well.
    """
    sketched = cut_lineage(sketched)  # a few buckets per group
    at = sorted({0.5, *[q for level, *_ in MEASURES.values() for q in (level, round(1 - level, 9))]})
    pairs = sketched.select("lang", "source", "measure").distinct()
    levels = None
    for level, by in enumerate((["lang", "source"], ["lang"], [])):
        merged = sketched.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "measure")
        ranked = merged.withColumn("total", F.sum("n").over(w)) \
            .withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        quantile = [F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket"))).alias(_name(q)) for q in at]
        found = ranked.groupBy(*by, "measure").agg(F.first("total").alias("total"), *quantile)
        p, f = pairs.alias("p"), found.alias("f")
        same = F.col("p.measure") == F.col("f.measure")
        for c in by:
            same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}"))
        of_pair = p.join(f, same).filter((F.col("f.total") >= MIN_GROUP) | F.lit(not by)) \
            .select("p.lang", "p.source", "p.measure", F.lit(level).alias("level"),
                    *[value_of(F.col(_name(q))).alias(_name(q)) for q in at])
        levels = of_pair if levels is None else levels.unionByName(of_pair)
    chosen = levels.groupBy("lang", "source", "measure").agg(F.min_by(F.struct(*map(_name, at)), "level").alias("q"))
    wide = chosen.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("q"))).alias(m) for m in (*MEASURES, *SIZES)])
    out = []
    for m, (level, widths, both, size, hits) in MEASURES.items():
        low, high = F.col(m)[_name(round(1 - level, 9))], F.col(m)[_name(level)]
        # One bucket more than the quantile: what a sketch cannot tell apart is not outside.
        fence = high * GAMMA + widths * (high - low)
        out.append((fence if size is None else F.greatest(fence, hits / F.col(size)[_name(0.5)])).alias(f"{m}_hi"))
        if both:
            out.append((low / GAMMA - widths * (high - low)).alias(f"{m}_lo"))
    return cut_lineage(wide.select("lang", "source", *out))  # a row per group


def _name(quantile: float) -> str:
    return f"q{round(100 * quantile)}"


def judge(measured: DataFrame, learned: DataFrame) -> DataFrame:
    """``measured`` plus ``kept``: not ``base_failed`` and inside every fence of its group.

    Up to ``BROADCAST_GROUPS`` groups travel to the documents; beyond that the documents are
    shuffled by group, and Spark splits the hot ones.
    """
    if learned.count() <= BROADCAST_GROUPS:
        learned = F.broadcast(learned)
    f = learned.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = measured.join(f, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    inside = F.lit(True)
    for m, (_, _, both, *_) in MEASURES.items():
        inside = inside & F.coalesce(F.col(m) <= F.col(f"{m}_hi"), F.lit(True))
        if both:
            inside = inside & F.coalesce(F.col(m) >= F.col(f"{m}_lo"), F.lit(True))
    return joined.select(*measured.columns, (~F.col("base_failed") & inside).alias("kept"))


def assess(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    One row per input row.  Null text: no words, ``base_failed``.  Null languages and sources
    are groups of their own.  Empty input: empty.
    """
    measured = cut_lineage(measure(docs, ["doc_id", "lang", "source"]))  # narrow rows
    return judge(measured, fences(sketches(measured))).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, that ``assess`` keeps; texts are not shuffled by id."""
    learned = fences(sketches(measure(docs, ["lang", "source"])))
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "lang", "source", "text")
    # The row number keeps the filter above the measures: pushed below them, it would repeat
    # their expressions inside one another.
    measured = measure(whole, ["__row", "lang", "source"]).withColumn("__at", F.monotonically_increasing_id())
    return judge(measured, learned).filter("kept and __at >= 0").select("__row.*")
