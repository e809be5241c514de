"""The registered queries of the numbered operators and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from storelens.llm import (fingerprint, html_extract, mixing, ngram_join, packing, pii, prefix_trie, projected_search,
                           quality_rules, sharding, spelling, toxicity, url_filter)
from storelens.llm.common import shared_dir, table
from storelens.llm.oracle import SQL  # noqa: F401 - read by __spark_entry__

N_SHARDS = 16


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary that packing counts in."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_ngram_jaccard(spark, sf_dir):
    """Components of documents whose five-word shingle sets overlap by 0.8."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_string_kernel(spark, sf_dir):
    """Toxicity scores of every document, learnt from the labels whose id's crc32 isn't divisible by 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold != 0)
    model = toxicity.train(*toxicity.sample(docs, labels))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_poisson_mixing(spark, sf_dir):
    """All copies of all documents, mixed to shares ~ bytes^0.5 and shuffled globally."""
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op4_host_reputation(spark, sf_dir):
    """Rules, then host reputation; a page's label is that of the document whose number its path ends in."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(url_filter.path_of(F.col("url")), "/([0-9]{1,18})(?:/|\\.html)?$", 1)
    ids = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).cast("long").alias("bad"))
    outcomes = ids.where("doc_id is not null").join(labels, "doc_id").select("page_id", "bad")
    return url_filter.judge(pages, outcomes)


def op5_block_crf(spark, sf_dir):
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_virtual_slots(spark, sf_dir):
    """All documents in shards 0 to 15 under a slot map balanced by bytes, stored with its versions in the shared folder."""
    name = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16]  # one map a table
    rows = sharding.reshard(table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/slots-{name}", N_SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op7_min_bin_slack(spark, sf_dir):
    """All documents packed into sequences of at most 1024 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_winnowing(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op9_semi_markov(spark, sf_dir):
    """Personal data in every document: the fixed patterns' counts and digest, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents"))

    def listed(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))))
        return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op10_threshold_rules(spark, sf_dir):
    """The counts of every document and the verdict of the threshold table."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_projected_kd(spark, sf_dir):
    """The 20 nearest vectors found for each row whose id 20 divides."""
    return projected_search.nearest(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark, sf_dir):
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark, sf_dir):
    """Every counted word of the documents with its near words, form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_string_kernel, op3_poisson_mixing, op4_host_reputation, op5_block_crf, op6_virtual_slots, op7_min_bin_slack, op8_winnowing,
    op9_semi_markov, op10_threshold_rules, op11_projected_kd, op12_prefix_trie, op13_spelling_variants)}
