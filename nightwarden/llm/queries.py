"""The operators as named queries over the test tables, each on the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, cut_lineage
from . import jaccard, negatives, neighbours, packing, quality, rans, repeats, suffix_tree, topk, whitening, word_bpe
from .pieces import read_spec
from .ranges import with_next
from .sharding import uniform_shards
from .sketch import as_text, containment, likeness, with_sketch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 16
VOCABULARY = "byte_bpe_50k.json"


def query(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def vocabulary() -> bytes:
    import public_tokenizers

    return read_spec(public_tokenizers.path(VOCABULARY))


@query
def op1_suffix_tree(spark, sf_dir):
    """Log probabilities of all documents under a suffix tree that learned from the documents outside a fold."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return suffix_tree.score(documents(spark, sf_dir), ~held_out)


@query
def op2_word_bpe(spark, sf_dir):
    """Ids of all documents by a distinct-word table, and the texts that they decode to."""
    spec = vocabulary()
    rows = word_bpe.decode(word_bpe.encode(documents(spark, sf_dir), spec), spec, out="decoded")
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_topk(spark, sf_dir):
    """The 5 best rows for every 50th embedding, by integer inner product."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = vectors.select("vec_id", topk.whole_numbers(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, 5, F.col("vec_id") % 50 == 0)


ORACLES["op3_topk"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op4_quality(spark, sf_dir):
    """Quality of all documents by trees that learned from the labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = quality.train(docs, labels, learn=~held_out)
    return quality.with_score(docs, forest).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query
def op5_packing(spark, sf_dir):
    """All documents as token pieces, packed into sequences of at most 1024 tokens."""
    docs = documents(spark, sf_dir)
    pieces = packing.token_pieces(docs, vocabulary(), limit=1024, end=2)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.best_fit(pieces, limit=1024, groups=packing.groups_for(docs, limit=1024))


@query
def op6_rans(spark, sf_dir):
    """Ids of all documents written to compressed containers in doc_id order, and read back."""
    containers = cut_lineage(rans.to_containers(documents(spark, sf_dir), vocabulary(), end=0))
    return rans.from_containers(containers).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op7_sharding(spark, sf_dir):
    """Uniform shuffle of all documents into 16 shards of equal counts."""
    text = F.coalesce("text", F.lit(""))
    return uniform_shards(documents(spark, sf_dir), SHARDS, ["doc_id"], seed=7).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_jaccard(spark, sf_dir):
    """Classes of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard.classes_of(documents(spark, sf_dir), n=3, num=90, den=100)


@query
def op9_repeats(spark, sf_dir):
    """All documents without the words of passages of 35 words or more that occur more than once."""
    docs = documents(spark, sf_dir)
    texts = repeats.without_repeats(docs, window=35)
    texts = texts.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")
    return repeats.attach(docs, texts).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op10_fingerprints(spark, sf_dir):
    """Sketches of all documents and of their edited texts, and how alike they and the next document are."""
    docs = documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_next(with_sketch(docs), "doc_id", ["text", "sketch"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = with_sketch(rows, "edited", "edited_sketch")
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), containment(a, b).alias("inside_edited"))


@query
def op11_neighbours(spark, sf_dir):
    """The 10 nearest rows found for every 100th embedding, by a hierarchical k-means tree."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours.nearest(vectors, 10, F.col("vec_id") % 100 == 0, vector="embedding")


@query
def op12_whitening(spark, sf_dir):
    """All embeddings, as whole numbers, projected on their first 32 principal axes and scaled to unit variance."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whitening.whiten(vectors, 32, vector="embedding")


@query
def op13_negatives(spark, sf_dir):
    """For every 100th embedding and each of its 5 positives, the 10 best rows of other labels in the score window."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", topk.whole_numbers(F.col("embedding")).alias("vector"), label.alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLES["op13_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
