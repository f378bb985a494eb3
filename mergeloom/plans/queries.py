"""Named queries over the standard tables; `oracles` has their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mergeloom.functions.columns import Tokenizer
from mergeloom.operators.chunks import chunk_tokens, truncate_tokens
from mergeloom.operators.incremental import append_counts, prepend_counts
from mergeloom.operators.intervals import count_range
from mergeloom.operators.vocabulary import batch_totals, decode_by_join, next_match, occurrences, token_frequency, with_token_bytes, with_token_ids
from mergeloom.session import spread
from mergeloom.sources.ranks import DEFAULT_RANKS, load_vocabulary, scan_rank_file, vocabulary_frame

QUERIES: dict = {}
LIMIT = 256


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer(spark: SparkSession, pattern: str | None = "cl") -> Tokenizer:
    return Tokenizer.load(spark, DEFAULT_RANKS, pattern)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts: every nation's and region's name."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return nation.union(table(spark, sf_dir, "region").select(F.col("r_regionkey") + 100, "r_name"))


# -- vocabulary ------------------------------------------------------------


@query
def vocab_lengths(spark, sf_dir):
    """Tokens by length in bytes."""
    return scan_rank_file(spark).groupBy("n_bytes").agg(F.count("*").alias("n_tokens"), F.min("id").alias("first_id"))


@query
def vocab_next_prefix(spark, sf_dir):
    """Longest proper prefix of each token that is a token."""
    return vocabulary_frame(spark, load_vocabulary(spark)).select("id", "n_bytes", "next_prefix")


@query
def vocab_splits(spark, sf_dir):
    """The pair each token was merged from."""
    return vocabulary_frame(spark, load_vocabulary(spark)).select("id", "left", "right")


@query
def vocab_self_check(spark, sf_dir):
    """Whether each token's bytes encode to the token alone."""
    tok = tokenizer(spark, None)
    vocab = scan_rank_file(spark).repartition(spark.sparkContext.defaultParallelism)
    return vocab.select("id", (tok.raw("bytes") == F.array("id")).alias("ok"))


@query
def vocab_lookup(spark, sf_dir):
    """Token id, if any, of each distinct piece of the conversations."""
    pieces = table(spark, sf_dir, "conversations").select(F.explode(tokenizer(spark).split("text")).alias("piece")).distinct()
    return with_token_ids(pieces, scan_rank_file(spark), "piece")


@query
def vocab_token_bytes(spark, sf_dir):
    """Length and hex of the tokens with the ids that nations' keys are."""
    keys = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 1000).alias("token"))
    return with_token_bytes(keys, scan_rank_file(spark), "token").select("token", "n_bytes", F.hex("bytes").alias("hex"))


@query
def vocab_next_match(spark, sf_dir):
    """Longest token that each part's name starts with."""
    vocab = load_vocabulary(spark)
    return next_match(table(spark, sf_dir, "part").select("p_partkey", "p_name"), scan_rank_file(spark), "p_name", vocab.max_len).select("p_partkey", "id")


@query
def vocab_occurrences(spark, sf_dir):
    """All tokens at all places of nations' and regions' names."""
    return occurrences(_names(spark, sf_dir), scan_rank_file(spark), "name", load_vocabulary(spark).max_len).select("k", "start", "id")


@query
def vocab_valid_pairs(spark, sf_dir):
    """Whether tokens that occur in nations' names may follow one another."""
    found = occurrences(table(spark, sf_dir, "nation").select("n_name"), scan_rank_file(spark), "n_name", load_vocabulary(spark).max_len).select("id").distinct()
    pairs = found.select(F.col("id").alias("a")).crossJoin(found.select(F.col("id").alias("b")))
    return pairs.select("a", "b", tokenizer(spark).valid_pair(F.col("a"), F.col("b")).alias("ok"))


# -- splitting -------------------------------------------------------------


@query
def split_pieces_cl(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokenizer(spark, "cl").split("text")).alias("pos", "piece"))


@query
def split_pieces_o2(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokenizer(spark, "o2").split("text")).alias("pos", "piece"))


@query
def piece_frequency(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(tokenizer(spark).split("text")).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


@query
def pieces_by_lang(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select("lang", F.size(tokenizer(spark).split("text")).alias("n"))
    return sized.groupBy("lang").agg(F.sum("n").alias("n_pieces"))


@query
def split_custom_pattern(spark, sf_dir):
    """A pattern of one's own: runs of letters, and single other characters."""
    tok = Tokenizer(spark, load_vocabulary(spark), r"\p{L}+|[^\p{L}]")
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(tok.split("text")).alias("n_pieces"), tok.count("text").alias("n_tokens"))


# -- encoding and counting -------------------------------------------------


@query
def encode_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokenizer(spark).encode("text").alias("tokens"))


@query
def encode_documents_o2(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokenizer(spark, "o2").encode("text").alias("tokens"))


@query
def encode_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tokenizer(spark).encode("text").alias("tokens"))


@query
def encode_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tokenizer(spark).encode("html").alias("tokens"))


@query
def count_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokenizer(spark).count("text").alias("n_tokens"))


@query
def count_by_lang(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").select("lang", tokenizer(spark).count("text").alias("n"))
    return counted.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


@query
def count_till_limit(spark, sf_dir):
    """Counts of at most `LIMIT` tokens, else null."""
    return table(spark, sf_dir, "documents").select("doc_id", tokenizer(spark).count_till_limit("text", LIMIT).alias("n_tokens"))


@query
def encode_batch_totals(spark, sf_dir):
    """Texts and tokens of the conversations by role, and in all."""
    encoded = table(spark, sf_dir, "conversations").select(tokenizer(spark).encode("text").alias("tokens"))
    return batch_totals(encoded, "tokens")


@query
def token_top_k(spark, sf_dir):
    """The 100 most frequent tokens, ties by id."""
    encoded = table(spark, sf_dir, "documents").select(tokenizer(spark).encode("text").alias("tokens"))
    return token_frequency(encoded, "tokens").orderBy(F.desc("n"), "token").limit(100)


@query
def tokens_by_quality(spark, sf_dir):
    """Tokens of labelled documents by label."""
    counted = table(spark, sf_dir, "documents").select("doc_id", tokenizer(spark).count("text").alias("n"))
    return counted.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


@query
def running_tokens(spark, sf_dir):
    """Tokens of each conversation's turns so far, counted turn by turn."""
    counted = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokenizer(spark).count("text").alias("n"))
    upto = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counted.select("conv_id", "turn", F.sum("n").over(upto).alias("n_tokens"))


# -- decoding --------------------------------------------------------------


@query
def decode_roundtrip(spark, sf_dir):
    tok = tokenizer(spark)
    return table(spark, sf_dir, "documents").select("doc_id", tok.decode(tok.encode("text")).eqNullSafe(F.col("text")).alias("same"))


@query
def decode_join(spark, sf_dir):
    """The benchmark's texts, encoded and decoded by joins."""
    encoded = table(spark, sf_dir, "benchmark").select("item_id", tokenizer(spark).encode("text").alias("tokens"))
    return decode_by_join(encoded, scan_rank_file(spark), "item_id", "tokens").select("item_id", F.col("data").cast("string").alias("text"))


@query
def decode_invalid(spark, sf_dir):
    """Single ids decoded to text: null for unknown ids and for bytes that aren't UTF-8."""
    ids = table(spark, sf_dir, "orders").select("o_orderkey", F.array((F.col("o_orderkey") % 60000).cast("int")).alias("ids"))
    return ids.select("o_orderkey", tokenizer(spark).decode("ids").alias("text"))


# -- raw bytes and other encoders ------------------------------------------


@query
def encode_raw(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tokenizer(spark, None).raw("text").alias("tokens"))


@query
def encode_heap(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tokenizer(spark, None).raw("text", "heap").alias("tokens"))


@query
def encode_table(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tokenizer(spark, None).raw("text", "table").alias("tokens"))


@query
def count_raw(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tokenizer(spark, None).count_raw("text").alias("n_tokens"))


@query
def count_raw_till_limit(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tokenizer(spark, None).count_raw("text", 100).alias("n_tokens"))


@query
def encode_greedy(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tokenizer(spark, None).raw("text", "greedy").alias("tokens"))


@query
def encode_minimal(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tokenizer(spark, None).raw("text", "minimal").alias("tokens"))


@query
def prefix_tokens(spark, sf_dir):
    """Last token of the encoding of every prefix of nations' and regions' names."""
    return _names(spark, sf_dir).select("k", F.posexplode(tokenizer(spark, None).raw("name", "prefixes")).alias("pos", "token")).select("k", (F.col("pos") + 1).alias("end"), "token")


# -- growing texts, ranges, cuts -------------------------------------------


@query
def interval_counts(spark, sf_dir):
    """Tokens of every byte range of nations' and regions' names."""
    names = _names(spark, sf_dir)
    size = F.octet_length("name")
    ranges = names.withColumn("start", F.explode(F.sequence(F.lit(0), size))).withColumn("end", F.explode(F.sequence("start", size)))
    return ranges.select("k", "start", "end", count_range(tokenizer(spark, None), "name", F.col("start"), F.col("end")).alias("n_tokens"))


@query
def append_nations(spark, sf_dir):
    """Tokens of each region's nations' names, appended in order of key."""
    return append_counts(tokenizer(spark, None), table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name")


@query
def prepend_nations(spark, sf_dir):
    return prepend_counts(tokenizer(spark, None), table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name")


@query
def append_turns(spark, sf_dir):
    """Raw token counts of whole conversations as they grow."""
    return append_counts(tokenizer(spark, None), table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query
def truncate_documents(spark, sf_dir):
    tok = tokenizer(spark)
    return table(spark, sf_dir, "documents").select("doc_id", truncate_tokens(tok, "text", LIMIT).alias("text"))


@query
def chunk_documents(spark, sf_dir):
    tok = tokenizer(spark)
    chunks = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(chunk_tokens(tok, "text", LIMIT, 16)).alias("pos", "c"))
    return chunks.select("doc_id", "pos", F.col("c.start").alias("start"), F.col("c.n_tokens").alias("n_tokens"), F.substring("text", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("chunk"))
