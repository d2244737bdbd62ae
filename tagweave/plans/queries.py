"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver's parquet tables (or frames Spark derives from
them) and runs over whole tables.  Every computed column is aliased so the
names equal the DuckDB oracle's (``oracles.py``); doubles are rounded to 6
places on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.escapes import ENTITY_SAMPLE, ESCAPE_SAMPLE, decode_entities, repair_escapes
from ..operators import longform as L
from ..operators import sampling as S
from ..operators import evaluate as V
from ..operators import search as R
from ..operators import tagging as T
from ..operators import weightings as W
from ..functions import naming as NM
from ..session import cut_lineage, ensure_checkpoint_dir, shared_folder
from ..sources import sinks
from ..sources.tables import labelled_documents, table
from . import corpus as K

GROUPS = K.DEFAULT_GROUPS
WEIGHTS = K.DEFAULT_WEIGHTS
N_DELETE = 5000
TOP_K = 20


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# shared frames
# ---------------------------------------------------------------------------

def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain corpus with all its columns, for queries that read it once."""
    return K.build_corpus(spark, sf_dir, GROUPS)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain corpus (doc order, 70/10/20 split, default groups): ids,
    labels, splits and terms, cleaned and tagged once and written to the
    shared folder, as every feature query reads it several times."""
    return cut_lineage(K.build_corpus(spark, sf_dir, GROUPS).select("doc_id", "label", "split", "terms"))


def train_values(spark, sf_dir, weights=None):
    docs = prepared(spark, sf_dir)
    values = L.pos_weighted(docs.where(F.col("split") == "train"), weights or WEIGHTS)
    sizes = L.class_sizes(docs)
    return docs, values, sizes


# ---------------------------------------------------------------------------
# cleaning, one rule each (H1-H12) and the chain
# ---------------------------------------------------------------------------

def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _per_doc(fn):
    def q(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", fn(F.col("text")).alias("text_out"))
    return q


def q_strip_quotes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", C.strip_quotes("text").alias("text_out"))


def q_entity_decode(spark, sf_dir):
    """H2, the full decoder, on the pages with named, decimal and hex
    references put between their words."""
    html = F.replace("html", F.lit(" the "), F.lit(ENTITY_SAMPLE[0]))
    return table(spark, sf_dir, "pages").select("page_id", decode_entities(html).alias("text_out"))


def q_clean_url(spark, sf_dir):
    """H6 on the page URLs."""
    return table(spark, sf_dir, "pages").select("page_id", C.replace_url(F.col("url")).alias("text_out"))


def q_clean_text(spark, sf_dir):
    """The full chain on every document."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", C.clean_text(C.strip_quotes("text")).alias("clean"))


# ---------------------------------------------------------------------------
# the minimum slice: top OCFS terms
# ---------------------------------------------------------------------------

def q_top_ocfs_terms(spark, sf_dir):
    """docs x labels -> clean -> tag -> pre-process -> POS-weighted L1 ->
    OCFS -> the 20 highest-scoring (word, group) features."""
    docs, values, sizes = train_values(spark, sf_dir)
    scores = L.ocfs_scores(values, sizes)
    return (scores.select("word", "grp", r6(F.col("score")).alias("score"))
            .orderBy(F.desc("score"), "word", "grp").limit(TOP_K))


# ---------------------------------------------------------------------------
# corpus, sampling, splitting
# ---------------------------------------------------------------------------

def _filtered(spark, sf_dir):
    return K.filtered_corpus(labelled_documents(spark, sf_dir))


def q_class_distribution(spark, sf_dir):
    """D1 + D2: documents per class and their share in percent (1 decimal)."""
    from pyspark.sql import Window
    c = labelled_documents(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    # a window over the three-row aggregate, not over the data
    return c.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def q_dedupe_first(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return S.dedupe_first(d, F.md5("text"), "doc_id").select("doc_id", "lang", "source", "n_chars")


def q_drop_broken(spark, sf_dir):
    return S.drop_broken(_docs(spark, sf_dir)).select("doc_id", "n_chars")


def q_balance_classes(spark, sf_dir):
    return S.balance_classes(_filtered(spark, sf_dir).select("doc_id", "label"), "label", "doc_id", 42)


def q_shuffle_index(spark, sf_dir):
    return S.shuffled(_filtered(spark, sf_dir).select("doc_id", "label"), "doc_id", 42, "row_index")


def q_split_by_position(spark, sf_dir):
    return S.split_by_position(_filtered(spark, sf_dir).select("doc_id", "label"), "doc_id")


def q_row_range(spark, sf_dir):
    """B3 over the labelled corpus: positions [10%, 90%) in document order."""
    d = _filtered(spark, sf_dir).select("doc_id", "label")
    n = d.count()
    return S.row_range(d, "doc_id", n // 10, (9 * n) // 10)


def q_union_sources(spark, sf_dir):
    """G1: the text sources as one bag of rows."""
    parts = [("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id")]
    out = None
    for name, key in parts:
        t = table(spark, sf_dir, name).select(F.lit(name).alias("src"), F.col(key).alias("id"),
                                              F.length("text").cast("long").alias("n_chars"))
        out = t if out is None else out.unionByName(t)
    return out


# ---------------------------------------------------------------------------
# tagging and pre-processing
# ---------------------------------------------------------------------------

def q_tag_tokens(spark, sf_dir):
    d = corpus(spark, sf_dir)
    return d.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                    F.array_join(F.transform("tokens", lambda t: t["tag"]), " ").alias("tags"))


def q_tag_stats_by_label(spark, sf_dir):
    return T.tag_statistics(corpus(spark, sf_dir), "tokens", "label")


def q_stopword_filter(spark, sf_dir):
    d = corpus(spark, sf_dir)
    kept = T.remove_stopwords(F.col("words"))
    return d.select("doc_id", F.size("words").cast("long").alias("n_words"),
                    F.size(kept).cast("long").alias("n_kept"), F.array_join(kept, " ").alias("kept"))


GROUP_WEIGHTS = {"A+R": 4, "N": 1, "V": 2, "E+!": 3}


def q_group_tags(spark, sf_dir):
    """C3 + H16: tags mapped to the groups named by weight keys ("A+R")."""
    groups = NM.groups_from_weights(GROUP_WEIGHTS)
    d = corpus(spark, sf_dir)
    return d.select("doc_id", F.array_join(F.transform("tokens", lambda t: T.group_of(t["tag"], groups)), " ")
                    .alias("groups"))


def q_preprocess_docs(spark, sf_dir):
    d = prepared(spark, sf_dir)
    return d.select("doc_id", "label", "split", F.size("terms").cast("long").alias("n_terms"),
                    F.array_join(F.transform("terms", lambda t: F.concat(t["word"], F.lit("/"), t["grp"])), " ")
                    .alias("terms"))


# ---------------------------------------------------------------------------
# features in long form
# ---------------------------------------------------------------------------

def q_vocabulary(spark, sf_dir):
    return L.vocabulary(prepared(spark, sf_dir))


def q_term_counts(spark, sf_dir):
    return L.term_counts(prepared(spark, sf_dir)).select("doc_id", "word", "grp", "cnt")


def q_binary_bow(spark, sf_dir):
    """I2 on the baseline's input: raw words, stopwords kept, no groups."""
    d = corpus(spark, sf_dir).select("doc_id", F.transform("words", lambda w: F.struct(
        w.alias("word"), F.lit("").alias("grp"))).alias("raw"))
    return L.binary_bow(d, "raw").select("doc_id", "word", "value")


def q_idf(spark, sf_dir):
    return L.idf(prepared(spark, sf_dir)).select("word", "grp", "df", r6(F.col("idf")).alias("idf"))


def q_tfidf(spark, sf_dir):
    d = prepared(spark, sf_dir)
    return L.tfidf(d, L.idf(d)).select("doc_id", "word", "grp", r6(F.col("value")).alias("value"))


def q_pos_weighted_l1(spark, sf_dir):
    return L.pos_weighted(prepared(spark, sf_dir), WEIGHTS).select(
        "doc_id", "word", "grp", r6(F.col("value")).alias("value"))


def q_oov_transform(spark, sf_dir):
    """B5 + C5: test documents' terms against the training vocabulary."""
    d = prepared(spark, sf_dir)
    vocab = L.vocabulary(d)
    test = L.term_counts(d.where(F.col("split") == "test"))
    known = L.in_vocabulary(test, vocab).groupBy("doc_id").agg(F.count("*").alias("n_known"))
    return (test.groupBy("doc_id").agg(F.count("*").alias("n_terms"))
            .join(known, "doc_id", "left").select("doc_id", "n_terms", F.coalesce("n_known", F.lit(0)).alias("n_known")))


def q_centroids(spark, sf_dir):
    docs, values, sizes = train_values(spark, sf_dir)
    return L.centroids(values, sizes).select("word", "grp", "label", r6(F.col("class_mean")).alias("class_mean"),
                                             r6(F.col("mean_all")).alias("mean_all"))


def q_ocfs_scores(spark, sf_dir):
    docs, values, sizes = train_values(spark, sf_dir)
    return L.ocfs_scores(values, sizes).select("word", "grp", r6(F.col("score")).alias("score"))


def q_ocfs_keep(spark, sf_dir):
    docs, values, sizes = train_values(spark, sf_dir)
    scores = L.ocfs_scores(values, sizes).persist()
    return L.ocfs_keep(scores, N_DELETE).select("word", "grp", r6(F.col("score")).alias("score"), "kept")


SEARCH_SCALE = 5              # weights 1..5, the scale of the reference's published searches
GRID5 = R.weight_grid(GROUPS, SEARCH_SCALE)
GRID = R.weight_grid(GROUPS, 2)


def _best_terms(spark, sf_dir, combos):
    docs = prepared(spark, sf_dir)
    parts = [w.top_terms(TOP_K).withColumn("combo_id", F.col("combo_id") + at)
             for at, w in W.in_passes(docs, combos, list(GROUPS), L.class_sizes(docs))]
    return reduce(DataFrame.unionByName, parts)


def q_ocfs_grid(spark, sf_dir):
    """OCFS under every canonical weighting of the grid in shared passes;
    the 20 best features of each weighting."""
    return _best_terms(spark, sf_dir, GRID)


BLOCKS = {"bow": 0.3, "pos": 0.6, "tfidf": 0.1}


def q_block_union(spark, sf_dir):
    """Weighted union of the BoW, TF-IDF and OCFS-pruned POS blocks."""
    docs, values, sizes = train_values(spark, sf_dir)
    train = docs.where(F.col("split") == "train")
    keep = L.ocfs_keep(L.ocfs_scores(values, sizes).persist(), N_DELETE).where("kept")
    pos = L.in_vocabulary(values, keep)
    u = L.union_blocks({"bow": (L.binary_bow(train), BLOCKS["bow"]),
                        "pos": (pos, BLOCKS["pos"]),
                        "tfidf": (L.tfidf(train, L.idf(docs)), BLOCKS["tfidf"])})
    return u.select("doc_id", "block", "word", "grp", r6(F.col("value")).alias("value"))


# ---------------------------------------------------------------------------
# predictions (deterministic nearest-centroid model) and metrics
# ---------------------------------------------------------------------------

def centroid_runs(spark, sf_dir, combos, deletes):
    """Predictions (narrow rows, written once) per feature-cut setting: the
    corpus is built and its features are scored once for all settings."""
    docs = prepared(spark, sf_dir)
    sizes = L.class_sizes(docs)
    values = V.grid_values(docs, combos)
    scored = cut_lineage(V.centroid_scores(values, sizes))
    return {n: cut_lineage(V.centroid_predict(values, docs, V.centroid_cut(scored, sizes, n), sorted(sizes), len(combos)))
            for n in deletes}


def predictions(spark, sf_dir):
    """Predictions of the default weighting (one combo)."""
    return centroid_runs(spark, sf_dir, [WEIGHTS], [N_DELETE])[N_DELETE].drop("combo_id")


def _test(p):
    return p.where(F.col("split") == "test")


def q_confusion(spark, sf_dir):
    return V.confusion(_test(predictions(spark, sf_dir)))


def q_accuracy(spark, sf_dir):
    return V.accuracy(predictions(spark, sf_dir), ["split"]).select("split", r6(F.col("accuracy")).alias("accuracy"))


def q_per_class_prf(spark, sf_dir):
    pc = V.per_class(_test(predictions(spark, sf_dir)))
    return pc.select("class", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def q_macro_f1(spark, sf_dir):
    return V.macro_f1(_test(predictions(spark, sf_dir))).select(r6(F.col("macro_f1")).alias("macro_f1"))


def q_classification_report(spark, sf_dir):
    rep = V.classification_report(_test(predictions(spark, sf_dir)))
    return rep.select("class", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def q_wrong_predictions(spark, sf_dir):
    return V.wrong_predictions(_test(predictions(spark, sf_dir)), 5).select(
        "label", F.col("rank").cast("long").alias("rank"), "doc_id", "prediction")


# ---------------------------------------------------------------------------
# search runs over the weight grid (nearest-centroid scorer)
# ---------------------------------------------------------------------------

SEARCH_DELETES = [0, N_DELETE]
SEARCH_BLOCKS = {"pos": 1.0}


def search_runs(spark, sf_dir, combos=None, scale=2):
    """Every canonical weighting, for every feature-cut setting: one run row
    each (train accuracy, test accuracy, test macro F1) with its names.  All
    weightings are scored together, over rows written once."""
    combos = combos or GRID
    docs = prepared(spark, sf_dir)
    runs = W.grid_runs(docs, combos, list(GROUPS), L.class_sizes(docs), SEARCH_DELETES)
    groups_col = F.create_map(*sum([[F.lit(k), F.array(*[F.lit(t) for t in v])] for k, v in GROUPS.items()], []))
    blocks_col = F.create_map(*sum([[F.lit(k), F.lit(float(v))] for k, v in SEARCH_BLOCKS.items()], []))
    return runs.select("combo_id", _weights_of(combos, F.col("combo_id")).alias("weights"), r6(F.col("train_acc")).alias("train_acc"),
                       r6(F.col("test_acc")).alias("test_acc"), r6(F.col("macro_f1")).alias("macro_f1"), "n_delete",
                       NM.run_name_col(groups_col, F.lit(scale), F.col("n_delete").cast("int"), blocks_col, F.lit(0.7),
                                       F.lit(0.2)).alias("run_name"))


def _weights_of(combos, combo_id):
    """A weighting's text by its number."""
    return F.element_at(F.array(*[F.lit(R.weights_label(w)) for w in combos]), combo_id.cast("int") + 1)


def search_runs_scale5(spark, sf_dir):
    """All 607 canonical weightings of the published search scale (1..5, four groups)."""
    return search_runs(spark, sf_dir, GRID5, SEARCH_SCALE)


def q_top_runs_scale5(spark, sf_dir):
    return R.top_runs(search_runs_scale5(spark, sf_dir), 20).select(
        "run_name", "metric", "rank", "combo_id", "weights", "train_acc", "test_acc", "macro_f1")


def q_leaderboard_scale5(spark, sf_dir):
    best = cut_lineage(R.best_per_run(R.top_runs(search_runs_scale5(spark, sf_dir), 20)))
    return R.leaderboard(best, "accuracy", 10).unionByName(R.leaderboard(best, "f1", 10)).select(
        "metric", "run_name", "combo_id", "weights", "train_acc", "test_acc", "macro_f1")


def _feature_counts(spark, sf_dir, combos):
    docs = prepared(spark, sf_dir)
    parts = [w.feature_counts(w.cuts(N_DELETE)).withColumn("combo_id", F.col("combo_id") + at)
             for at, w in W.in_passes(docs, combos, list(GROUPS), L.class_sizes(docs))]
    return reduce(DataFrame.unionByName, parts).withColumn("weights", _weights_of(combos, F.col("combo_id")))


def q_weight_grid_scale5(spark, sf_dir):
    """H17 at scale 5: training features of every canonical weighting, and how many it keeps."""
    return _feature_counts(spark, sf_dir, GRID5)


def q_ocfs_grid_scale5(spark, sf_dir):
    """C6 at scale 5: the 20 best features of every canonical weighting."""
    return _best_terms(spark, sf_dir, GRID5)


def q_weight_grid(spark, sf_dir):
    """The canonical weightings evaluated, with the number of training
    features each one scores and keeps."""
    return _feature_counts(spark, sf_dir, GRID)


def q_search_runs(spark, sf_dir):
    return search_runs(spark, sf_dir)


def q_run_names(spark, sf_dir):
    """The search configurations run, with their run counts."""
    return search_runs(spark, sf_dir).groupBy("run_name").agg(F.count("*").alias("n_runs"))


def q_model_names(spark, sf_dir):
    """The persistence name of every evaluated weighting."""
    runs = search_runs(spark, sf_dir)
    wmaps = []
    for i, w in enumerate(GRID):
        wmaps += [F.lit(i), F.create_map(*sum([[F.lit(k), F.lit(v)] for k, v in w.items()], []))]
    wcol = F.try_element_at(F.create_map(*wmaps), F.col("combo_id"))
    blocks_col = F.create_map(*sum([[F.lit(k), F.lit(float(v))] for k, v in SEARCH_BLOCKS.items()], []))
    return runs.select("run_name", "combo_id",
                       NM.model_name_col(wcol, F.col("n_delete"), blocks_col, F.lit(0.7)).alias("model_name"))


def q_beats_threshold(spark, sf_dir):
    return R.beats_threshold(search_runs(spark, sf_dir), 0.5, 0.5)


def _saved_lists(spark, sf_dir):
    """The two best-20 lists of each search."""
    return R.top_runs(search_runs(spark, sf_dir), 20)


def q_top_runs(spark, sf_dir):
    return _saved_lists(spark, sf_dir).select("run_name", "metric", "rank", "combo_id", "weights",
                                              "train_acc", "test_acc", "macro_f1")


def q_best_per_run(spark, sf_dir):
    return (R.best_per_run(_saved_lists(spark, sf_dir))
            .select("run_name", "metric", "combo_id", "weights", "train_acc", "test_acc", "macro_f1"))


def q_leaderboard(spark, sf_dir):
    best = R.best_per_run(_saved_lists(spark, sf_dir))
    acc = R.leaderboard(best, "accuracy", 10)
    f1 = R.leaderboard(best, "f1", 10)
    return acc.unionByName(f1).select("metric", "run_name", "combo_id", "weights", "train_acc", "test_acc", "macro_f1")


# ---------------------------------------------------------------------------
# MaxEnt models (rows-only: no SQL form of an L-BFGS fit)
# ---------------------------------------------------------------------------

FUSED_BLOCKS = {"bow": 0.5, "pos": 0.5}


def _splits(spark, sf_dir, column="terms"):
    """Train and test frames over the corpus, made once and written to the shared folder: ids, labels,
    splits and the terms (or words) that a model reads."""
    d = K.build_corpus(spark, sf_dir, GROUPS).select("doc_id", "label", "split", column)
    path = shared_folder(spark, "corpus")
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


def q_maxent_predict(spark, sf_dir):
    """Fused BoW .5 + POS .5 model, test-set predictions."""
    from ..operators import models as M
    train, test = _splits(spark, sf_dir)
    return M.predict(M.fit_fused(train, WEIGHTS, N_DELETE, FUSED_BLOCKS, as_table=True), test)


def q_maxent_table_predict(spark, sf_dir):
    """The model of ``maxent_predict`` fitted and applied as a table of term weights."""
    from ..operators import term_model as T
    train, test = _splits(spark, sf_dir)
    return T.predict(T.fit(train, WEIGHTS, N_DELETE, FUSED_BLOCKS), test)


def _baseline_report(kind):
    def q(spark, sf_dir):
        from ..operators import models as M
        train, test = _splits(spark, sf_dir, "words")
        return V.classification_report(M.predict(M.baseline(train, kind, as_table=True), test))
    return q


def q_grid_search(spark, sf_dir):
    """MaxEnt over every weighting 1..5 of the four default groups (625
    points, 607 fits), BoW .7 + POS .3, fitted in shared passes; multiples
    of a weighting share its fit."""
    from ..operators.grid_fit import grid_search
    train, test = _splits(spark, sf_dir)
    rows = grid_search(train, test, GROUPS, SEARCH_SCALE, N_DELETE, {"bow": 0.7, "pos": 0.3})
    return spark.createDataFrame(rows, "combo_id long, weights string, train_acc double, test_acc double, "
                                       "macro_f1 double")


def q_fit_or_load(spark, sf_dir):
    """Persisted model reused (fit and saved on first use)."""
    from ..operators import models as M
    train, test = _splits(spark, sf_dir)
    model = M.fit_or_load(spark, train, WEIGHTS, N_DELETE, FUSED_BLOCKS, f"{ensure_checkpoint_dir(spark)}/models",
                          0.7, GROUPS, "plain", "train", as_table=True)
    return V.confusion(M.predict(model, test))


VARIANTS = {"plain": {}, "reshuffled": {"shuffle": True}, "equal_classes_reshuffled": {"balance": True}}


def _presets(variant, split="train"):
    """The test documents scored by every preset model of a corpus variant."""
    def q(spark, sf_dir):
        from ..operators import models as M
        docs = K.build_corpus(spark, sf_dir, GROUPS, **VARIANTS[variant]).select("doc_id", "label", "split", "tokens")
        path = shared_folder(spark, "corpus")
        docs.write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        models = M.preset_models(spark, docs, M.PRESETS[variant], f"{ensure_checkpoint_dir(spark)}/models", variant, split, as_table=True)
        return M.score_presets(docs.where(F.col("split") == "test"), models)
    return q


def q_saved_runs(spark, sf_dir):
    """A9 + A10: the search's result lists saved by dataset, experiment and
    metric, saved once more, and read back: one copy."""
    path = shared_folder(spark, "runs")
    lists = R.top_runs(search_runs(spark, sf_dir), 20).withColumn("dataset", F.lit("plain")) \
        .withColumnRenamed("run_name", "experiment")
    lists = cut_lineage(lists)
    for _ in range(2):
        sinks.save_runs(lists, path)
    return sinks.read_runs(spark, path).select("dataset", "experiment", "metric", "rank", "combo_id", "weights",
                                               "train_acc", "test_acc", "macro_f1")


def q_tag_tokens_lexicon(spark, sf_dir):
    """N1 with a lexicon made from the corpus: words that are capitalised in at
    least nine of ten places, of five or more, are proper nouns (``^``)."""
    seen = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    capital = F.sum(F.col("w").rlike("^[A-Z][a-z]").cast("long"))
    lexicon = seen.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), capital.alias("c")) \
        .where("n >= 5 and 10 * c >= 9 * n").select("word", F.lit("^").alias("tag"))
    d = K.build_corpus(spark, sf_dir, GROUPS, lexicon=lexicon)
    return (d.select("doc_id", F.posexplode("tokens").alias("pos", "t"))
            .select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("t.word").alias("word"), F.col("t.tag").alias("tag")))


def q_unicode_repair(spark, sf_dir):
    """H13 on the conversation texts with escapes of every kind put between
    their words."""
    text = F.replace("text", F.lit(" the "), F.lit(ESCAPE_SAMPLE[0]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", repair_escapes(text).alias("text_out"))


QUERIES = {
    # cleaning (H1-H12)
    "strip_quotes": q_strip_quotes,
    "spaced_commas": _per_doc(C.spaced_commas),
    "clean_number_grouped": _per_doc(C.replace_grouped_number),
    "clean_email": _per_doc(C.replace_email),
    "clean_mention": _per_doc(C.replace_mention),
    "clean_url": q_clean_url,
    "clean_number": _per_doc(C.replace_number),
    "clean_lone_punct": _per_doc(C.drop_lone_punct),
    "reduce_lengthening": _per_doc(lambda c: C.reduce_lengthening(C.normalise_whitespace(c))),
    "strip_backslash": _per_doc(lambda c: C.strip_backslash(C.normalise_whitespace(c))),
    "entity_decode": q_entity_decode,
    "clean_text": q_clean_text,
    # corpus and sampling
    "class_distribution": q_class_distribution,
    "dedupe_first": q_dedupe_first,
    "drop_broken": q_drop_broken,
    "balance_classes": q_balance_classes,
    "shuffle_index": q_shuffle_index,
    "split_by_position": q_split_by_position,
    "row_range": q_row_range,
    "union_sources": q_union_sources,
    # tagging
    "tag_tokens": q_tag_tokens,
    "tag_tokens_lexicon": q_tag_tokens_lexicon,
    "tag_stats_by_label": q_tag_stats_by_label,
    "stopword_filter": q_stopword_filter,
    "group_tags": q_group_tags,
    "preprocess_docs": q_preprocess_docs,
    # features
    "vocabulary": q_vocabulary,
    "term_counts": q_term_counts,
    "binary_bow": q_binary_bow,
    "idf": q_idf,
    "tfidf": q_tfidf,
    "pos_weighted_l1": q_pos_weighted_l1,
    "oov_transform": q_oov_transform,
    "centroids": q_centroids,
    "ocfs_scores": q_ocfs_scores,
    "ocfs_keep": q_ocfs_keep,
    "top_ocfs_terms": q_top_ocfs_terms,
    "ocfs_grid": q_ocfs_grid,
    "block_union": q_block_union,
    # evaluation
    "confusion": q_confusion,
    "accuracy": q_accuracy,
    "per_class_prf": q_per_class_prf,
    "macro_f1": q_macro_f1,
    "classification_report": q_classification_report,
    "wrong_predictions": q_wrong_predictions,
    # search
    "weight_grid": q_weight_grid,
    "search_runs": q_search_runs,
    "run_names": q_run_names,
    "model_names": q_model_names,
    "beats_threshold": q_beats_threshold,
    "top_runs": q_top_runs,
    "best_per_run": q_best_per_run,
    "leaderboard": q_leaderboard,
    "ocfs_grid_scale5": q_ocfs_grid_scale5,
    "weight_grid_scale5": q_weight_grid_scale5,
    "search_runs_scale5": search_runs_scale5,
    "top_runs_scale5": q_top_runs_scale5,
    "leaderboard_scale5": q_leaderboard_scale5,
    "saved_runs": q_saved_runs,
    # rows-only
    "maxent_predict": q_maxent_predict,
    "maxent_table_predict": q_maxent_table_predict,
    "baseline_bow": _baseline_report("bow"),
    "baseline_tfidf": _baseline_report("tfidf"),
    "grid_search": q_grid_search,
    "fit_or_load": q_fit_or_load,
    "preset_predictions": _presets("plain"),
    "preset_predictions_reshuffled": _presets("reshuffled"),
    "preset_predictions_balanced": _presets("equal_classes_reshuffled"),
    "preset_predictions_dev": _presets("plain", "dev"),
    "unicode_repair": q_unicode_repair,
}
