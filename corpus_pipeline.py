"""The corpus pipeline: five of the numbered operators, each on what the one before it kept.

Each stage carries a document's own columns, whatever their names, as one struct past the operator's. Null and empty
texts, repeated rows and empty tables are treated as the operators say; a stage returns no row for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granum.llm.common import held, maybe_broadcast, read, saved, written
from granum.llm.minhash_dedup import near_duplicates
from granum.llm.piece_codec import encode
from granum.llm.quality_rules import judge_quality
from granum.llm.queries import tokenizer_file
from granum.llm.site_quality import judge_sites
from granum.llm.soft_mixing import mix_softly, take_copies

#: No domain is asked for more than so many times what the stages before have left of it: they take out most of the
#: toxic and low documents, and the rest would be repeated without end.
MOST_REPEATS = 4.0
BROADCAST_IDS = 2_000_000


def _bound(docs: DataFrame) -> DataFrame:
    """The columns that operators read beside `document`, a struct of all."""
    return docs.select("doc_id", "text", "source", "lang", held(docs.columns, "document"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of low quality is at most a half; the classifier is fitted on `labels`. A null or empty text is judged like any other."""
    return judge_sites(_bound(docs), read(spark, sf_dir, "labels"), carry=["document"], twice=True).where("kept").select("document.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected. Null and empty texts fail."""
    return judge_quality(_bound(docs), carry=["document"]).where("kept").select("document.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one whose id names the group. Of rows that repeat its id the least stays, by text and then by all columns; rows with a null id stay.

    Only ids are shuffled while there are few to take out, else texts once.
    """
    found = saved(near_duplicates(docs).select("doc_id", "kept"))
    gone = saved(found.where("not kept").select("doc_id").distinct())
    left = docs.join(maybe_broadcast(gone, BROADCAST_IDS), "doc_id", "left_anti").select(docs.columns)
    again = saved(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    again = maybe_broadcast(again, BROADCAST_IDS)
    order = F.struct("text", F.to_json(F.struct(*docs.columns)))
    once = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(held(docs.columns, "document"), order).alias("document"))
    return left.join(again, "doc_id", "left_anti").select(docs.columns).union(once.select("document.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, for the domains' target weights. Texts without words get a rate like others and weigh nothing."""
    return take_copies(mix_softly(_bound(docs), read(spark, sf_dir, "labels"), carry=["document"], most_repeats=MOST_REPEATS), ["document"]).select("document.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its piece ids, how many they are, how many stand for bytes, and the CRC-32 of what they decode to. Null and empty texts have none."""
    path = tokenizer_file("piece_bpe_32k.model")
    return encode(docs, path, decoded="decoded").select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "n_byte_pieces", F.crc32("decoded").alias("decoded_crc32"))


STAGES = [("quality classifier", classify), ("quality rules", rules), ("MinHash near-dedup", dedup), ("mixing to target weights", mix), ("SentencePiece codec", pieces)]

#: Fitted classifiers and Viterbi paths are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row on the table `documents`; what each keeps is written as Parquet and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
