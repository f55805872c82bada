"""A corpus pipeline of four stages over the training-data operators; each stage works on what the one before it kept.

1. quality classifier: documents that it predicts as 0 go;
2. n-gram Jaccard join: of each group of near copies the row with the smallest doc_id stays (of equal rows, one); blank
   documents are no copies of each other and all stay;
3. substring dedup: words that a repeated window of 35 words covers leave the text (kept words are joined by one space,
   n_chars follows); texts without repeats stay as they are;
4. packing: pieces of all texts in windows of 1024 tokens.

Null doc_ids, texts and other columns pass through as the operators define them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import debruijn, jaccard, packing, quality
from sluice.llm.common import doc_texts, free_names, materialise, scratch_dir, table
from sluice.llm.queries import tokenizer_file


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a score of at least 0.5; the model learns from labels of rows that are not held out."""
    weights = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, weights)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a similarity of 0.8): the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that a repeated window of 35 words covers.

    A text that loses words is its kept words joined by one space, and n_chars, if the table has it, follows; all else
    stays. Columns named like the operator's results (n_words, n_removed, kept) are the caller's own and stay too.
    """
    clash = [c for c in docs.columns if c in ("n_words", "n_removed", "kept")]
    saved = dict(zip(clash, free_names(docs.columns, *clash), strict=True))
    done = debruijn.strip_repeats(docs.withColumnsRenamed(saved))
    lost = F.col("n_removed") > 0
    new = {"text": F.when(lost, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*(new.get(c, F.col(f"`{saved.get(c, c)}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, a null one being empty, in sequences of at most 1024 tokens."""
    return packing.pack_documents(doc_texts(docs), tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", drop_near_copies), ("substring dedup", drop_repeats), ("packing", pack)]

#: The classifier and the packer have no SQL form; tests hold every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet in the shared folder and reread."""
    folder = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), folder, f"stage{i}")
    return docs
