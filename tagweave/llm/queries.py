"""Registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm.oracles import ORACLES  # noqa: F401 - read by the entry point


def tokenizer_path(name: str) -> str:
    """Place of an installed public tokenizer file (never copied into the repository)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    from tagweave.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 4096, 1)


#: Fixed rules of the URL query.
URL_RULES = ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by rule or learned template.

    In these tables a page's path ends with the number of the document it shows; the labels of
    that document (bad: toxic or of low quality) are the page's.
    """
    from pyspark.sql import functions as F

    from tagweave.llm.url_filter import Rule, judge_urls, path_of
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.html)?/?$", 1)
    labels = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    labels = labels.join(bad, "doc_id").groupBy("page_id").agg(F.max("bad").alias("bad"))
    return judge_urls(pages, [Rule.parse(r) for r in URL_RULES], labels)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and bytes of every document."""
    from tagweave.llm.token_count import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    from tagweave.llm.license_scan import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    from tagweave.llm.language_id import identify
    return identify(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document by fences per language and source."""
    from tagweave.llm.quality import assess
    return assess(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document, of its edited text, likeness to that and the next document, and
    its class of equal fingerprints; for ids divisible by 20 also how many other fingerprints and
    documents lie within twelve bits."""
    from tagweave.llm.fingerprint import SEARCH_RADIUS, compare_and_search
    return compare_and_search(table(spark, sf_dir, "documents"), radius=SEARCH_RADIUS, every=20)


def op7_near_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class of equal fingerprints within twelve bits of that of an id divisible by 20."""
    from tagweave.llm.fingerprint import SEARCH_RADIUS, near_hits
    return near_hits(table(spark, sf_dir, "documents"), radius=SEARCH_RADIUS, every=20)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    from tagweave.llm.secret_scan import scan_digests
    return scan_digests(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four-word shingles, similarity 0.8 or more."""
    from tagweave.llm.near_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 80, 100)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every document through byte-level BPE."""
    from tagweave.llm.bpe_codec import round_trip_digests
    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 64-bit SimHash, three or fewer differing bits."""
    from tagweave.llm.pivot_dedup import pivot_duplicates
    return pivot_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 16 clusters after three rounds."""
    from tagweave.llm.centroids import cluster_vectors
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64, salt="1:")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its leading terms."""
    from tagweave.llm.divergence import audit_sources
    return audit_sources(table(spark, sf_dir, "documents"), min_docs=30, ranks=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_url_filter, op3_token_counts, op4_license_scan, op5_language_id, op6_quality_rules,
                                   op7_fingerprints, op7_near_hits, op8_secret_scan, op9_near_dedup, op10_bpe_codec,
                                   op11_pivot_dedup, op12_centroid_clusters, op13_source_divergence, pipeline)}

