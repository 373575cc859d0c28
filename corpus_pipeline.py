"""A corpus from raw documents to token ids: five stages, each over all that the one before kept.

Toxic documents go; of exact copies and of near copies one stays; a mixture
brings the sources to their weights; what is left is encoded. Each stage takes
(spark, docs, sf_dir) and returns a DataFrame, and all but the last return the
columns of documents. The stages have no SQL form (a trained classifier,
fingerprints, an encoder); the tests hold them against brute force.

Cases, for every stage: a null text is an empty one, is not toxic, and equals and
resembles other texts without words, so one such document stays; a null id, lang
or source is a value of its own, and of copies a row with an id stays; texts of
any length are read whole; rows repeated in full count as copies of each other;
further columns, whatever their names, pass through all stages but the last; an
empty table gives an empty one, and without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import ship
from plumbline.llm.bpe import encode
from plumbline.llm.common import store, table
from plumbline.llm.exact_dedup import drop_copies
from plumbline.llm.mixing import take
from plumbline.llm.queries import source_domain, token_digests
from plumbline.llm.simhash import drop_near_duplicates
from plumbline.llm.toxicity import drop_toxic

#: Equal weights at every level over nine tenths of the tokens: what goes comes from the sources that have more than their share.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {}, "lang": {}, "source": {}}


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return take(docs, source_domain(), WEIGHTS, F.floor(F.col("total") * 9 / 10), max_epochs=1)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_digests(encode(docs, decoded=True), keep_ids=True)


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("simhash", without_near_copies), ("mixing", mixed), ("bpe", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is stored for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
