"""The registered queries of this folder: thin digests over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embeddings, fm_index, minhash, mixing, packing, quality, runs, sharding, suffix_array, token_counts, token_files, toxicity
from .common import WORD, let, new_path, table, words_of


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token over a line's end goes to the line with most of it."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), rule="largest")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learnt from three quarters of the ids only."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    model, thresholds = toxicity.fit(toxicity.labelled(docs, labels))
    s = toxicity.scored(docs, model, ["doc_id", "lang"])
    own = F.lit(0.3)
    for lang, t in thresholds.items():
        own = F.when(F.coalesce("lang", F.lit("")) == lang, F.lit(t)).otherwise(own)
    return s.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), (F.col("score") >= own).cast("int").alias("flagged_by_language"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its length bucket and batch, in tokens of the tokenizer of 1."""
    return packing.packed(packing.encoded(table(spark, sf_dir, "documents").select("doc_id", "text")), length_col="n_tokens")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that 20-word windows with an earlier start cover."""
    return fm_index.digests(table(spark, sf_dir, "documents"), length=20)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, with the verdicts of the base rules and of policy v1."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base = ~quality.verdict(quality.BASE)
    kept = quality.verdict(quality.V1)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"), "fail_bits", "n_lines", "n_upper")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 85 % of their three-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, bands=16, rows=4)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the Pfair mix of its sources."""
    m = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return m.select("doc_id", "source", "block", "mix_slot", "position", "target_weight", "in_target")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards, and in one of 25."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * 24, [1.0] * 25)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 50-byte strings of documents with a smaller id cover."""
    return suffix_array.digests(table(spark, sf_dir, "documents"), length=50)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors linked by a cosine of 0.95 or more."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the files of token ids, end id 2 after each text."""
    path = new_path(spark)
    token_files.write_ids(table(spark, sf_dir, "documents"), path, end_id=2)
    return token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def tail_repeated(doc_id: Column, text: Column) -> Column:
    """The text, of which a tenth of the documents repeat words from some word on: crc32 of the id says which, where and how."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(w: Column) -> Column:
        n = F.size(w).cast("long")
        return let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(w[(a + (i - a) % p).cast("int")])), " ")))

    return F.when((h % 10 == 0) & text.rlike(WORD), let(words_of(text), changed)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least six words and four periods in every document, the longest one, and digests of all and of what is left without the repetitions."""
    d = table(spark, sf_dir, "documents").select("doc_id", tail_repeated(F.col("doc_id"), F.col("text")).alias("text"))
    r = runs.periodic_runs(d, min_length=6, min_periods=4)
    top = F.array_max(F.transform("runs", lambda x: F.struct(x.length.alias("length"), (-x.start).alias("before"), (-x.period).alias("shorter"), x.start.alias("start"), x.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x.start.cast("string"), F.lit(","), x.length.cast("string"), F.lit(","), x.period.cast("string"), F.lit("\n"))), "")
    r = r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli")
    return r.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli, "runs_sha256", "collapsed_sha256")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two public tokenizers in every document."""
    return alignment.alignments(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_toxicity, op3_packing, op4_substring_dedup, op5_quality_rules, op6_minhash, op7_mixing, op8_sharding, op9_suffix_array, op10_embeddings, op11_token_output, op12_periodic_runs, op13_tokenizer_alignment)
}
