"""The cleaning chain and tagging are stateless: same code on a stream."""

from pyspark.sql import functions as F

from tagweave.functions import cleaning as C
from tagweave.streaming.clean_stream import cleaned_stream


def test_cleaning_on_a_stream(spark, tmp_path):
    from tests.conftest import SF_SMALL
    src = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(50)
    inp = tmp_path / "in"
    src.write.parquet(str(inp))
    stream = spark.readStream.schema(src.schema).parquet(str(inp))
    q = (cleaned_stream(stream).writeStream.format("memory").queryName("cleaned_docs")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["doc_id"]: r["clean"] for r in spark.sql("SELECT doc_id, clean FROM cleaned_docs").collect()}
    want = {r["doc_id"]: r["clean"] for r in src.select("doc_id", C.clean_text(C.strip_quotes("text")).alias("clean")).collect()}
    assert got == want and len(got) == 50


def test_scoring_on_a_stream(spark, tmp_path):
    from tagweave.operators import models as M
    from tagweave.plans import corpus as K
    from tagweave.streaming.clean_stream import scored_stream, tagged_stream
    from tests.conftest import SF_SMALL
    train = K.build_corpus(spark, SF_SMALL).where("split = 'train'")
    model = M.fit_fused(train, {"A": 2, "N": 1}, 100, {"bow": 0.5, "pos": 0.5}, max_iter=5)
    src = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(30)
    inp = tmp_path / "in"
    src.write.parquet(str(inp))
    stream = spark.readStream.schema(src.schema).parquet(str(inp))
    q = (scored_stream(stream, model, K.DEFAULT_GROUPS).writeStream.format("memory").queryName("scored_docs")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["doc_id"]: r["prediction"] for r in spark.sql("SELECT * FROM scored_docs").collect()}
    want = {r["doc_id"]: r["predicted"] for r in model.transform(tagged_stream(src, K.DEFAULT_GROUPS)).collect()}
    assert got == want and len(got) == 30
