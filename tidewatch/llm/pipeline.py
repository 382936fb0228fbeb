"""The stages of ``corpus_pipeline``, each one of the operators applied to all that the stage before kept.

Defined results, for every stage: columns other than doc_id, text, lang and
source are kept as they are, whatever their names; an empty table gives an
empty one. Nulls: a null text has no language and goes in the first stage; a
null lang, source or doc_id keeps its row (the mix has a source of its own for
null; token shards put null identifiers first). Repeated rows are one group to
the near-duplicate stage, which keeps one of them; a leak removes every row
that has the text; the mix and the shards take repeated rows one by one. The
mix writes its rows in the order of training, file after file; the last stage
orders them by doc_id, as its file format asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chosenpath, curriculum, langid, latent
from .common import table
from .sstable import read_shards, write_shards


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1, language ID: documents in which no language can be told (no letter, or no text) go."""
    model = langid.learn(docs, F.coalesce(langid.remainder("doc_id", 4) != 2, F.lit(False)))
    return langid.predict(docs, model, keep=docs.columns).where("lang_pred <> 'und'").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2, n-gram Jaccard join: the least identifier of each group stays."""
    return chosenpath.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3, benchmark decontamination: documents into which an item leaked go."""
    return latent.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4, mixing: a row for each occurrence that the mix takes, in the order of training."""
    return curriculum.training_order(curriculum.assign(docs)).select("row.*")


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5, token-ID output: the occurrences' token ids as sorted shards, read back."""
    import public_tokenizers

    return read_shards(write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), 2))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_shards", token_shards)]
