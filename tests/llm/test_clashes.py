"""Tables with columns named like every result, repeated rows, and packing by a column of lengths."""

from pyspark.sql import functions as F

import pytest

from riskloom.llm import embedding, language, media, packing, pieces, pipeline, simhash, token_shards, toxicity, url_filter

NAMES = ["start", "n_tokens", "ids_crc32", "ids", "round_trip", "p", "seg", "piece", "bin_id", "capacity", "offset", "lang_pred", "score", "margin", "accepted", "predicted", "held_out",
         "fingerprint", "component_id", "fp", "k", "t", "g", "n", "node", "codec", "feature", "n_bytes", "host", "path", "rule", "verdict", "n_links", "kept", "rep", "v", "h", "y", "words", "f"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i % 12, None if i % 12 == 3 else "" if i % 12 == 4 else f"some plain words of text number {i % 6} and more of them", "en") for i in range(24)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit("x").alias(c) for c in NAMES])


def test_results_of_crowded_tables(spark, docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int").withColumn("score", F.lit(1))
    bpe, sp = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
    for made in (token_shards.token_shards(docs, bpe), pieces.encode(docs, sp, digest=True), pieces.encode(docs, sp), language.language_id(docs), toxicity.toxicity(docs, labels),
                 simhash.near_duplicates(docs), simhash.similar_documents(docs), media.text_media(docs), packing.pack(docs)):
        got = made.collect()
        assert len(got) == 24, made.columns
        # rows of one key and text have equal results, but for their places
        rest = [c for c in made.columns if c not in ("start", "bin_id", "offset", "capacity")]
        assert len({tuple(str(r[c]) for c in rest) for r in got}) == 12
    vectors = spark.createDataFrame([(i % 4, [1.0, float(i % 2)]) for i in range(8)], "vec_id long, embedding array<float>").select("*", *[F.lit("x").alias(c) for c in NAMES])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding.near_duplicates(vectors).collect()) == [(i, 3, i % 2) for i in range(4) for _ in range(2)]
    pages = spark.createDataFrame([(1, "http://a.com/x")] * 2, "page_id long, url string").select("*", *[F.lit("x").alias(c) for c in NAMES])
    assert [r.path for r in url_filter.url_filter(pages).collect()] == ["/x", "/x"]
    for stage in (pipeline.drop_unknown, pipeline.drop_copies):
        assert stage(spark, docs, "").columns == docs.columns


def test_packing_by_a_column(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a b c", 700), (3, None, 0), (3, None, -5), (None, "x", 5000)], "doc_id long, text string, size long")
    got = packing.pack(df, length=F.col("size")).collect()
    assert sorted((r.doc_id or 0, r.piece, r.n_tokens) for r in got) == [(0, 0, 5000), (1, 0, 1), (2, 0, 700), (3, 0, 1), (3, 0, 1)]
    assert packing.pack(df.limit(0), length=F.col("size")).count() == 0
