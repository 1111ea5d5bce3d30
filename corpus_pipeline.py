"""From raw documents to token ids: language, exact copies, near copies, mixing, pieces.

Each stage is one of the operators in podia.llm with its production
parameters, and works on all rows that the stage before it kept. A stage
first deletes the intermediate tables that no DataFrame of the session needs
any more, so disk holds about those of one stage at a time.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podia.llm import exact_dedup, langid, mixing, simhash, unigram
from podia.llm.common import load, materialise, sweep
from podia.llm.queries import PIECES

#: SQL can't express the language model, the fingerprints' components or the draws.
ORACLE_SQL = None

#: The least share that the likelihood of a document's language has among all.
LEAST_SCORE = 0.5
#: What near copies are: texts whose sets of so many words in a row have at least this Jaccard similarity.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model has learned, told with a score of LEAST_SCORE or more; null texts and those without a letter go."""
    sweep(spark)
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.accept(docs, model, least=LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest doc_id."""
    sweep(spark)
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are alike to 0.8 or more (Jaccard), the document with the smallest doc_id."""
    sweep(spark)
    return simhash.drop_near_copies(docs, shingle=NEAR_SHINGLE, similarity=NEAR_SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix draws, by document."""
    sweep(spark)
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of each whole text, their number, and whether they decode to it."""
    sweep(spark)
    coded = unigram.encode(docs.select("doc_id", "source", "text"), PIECES, decoded_col="decoded", zipf=True)
    return coded.select("doc_id", "source", "ids", F.size("ids").alias("n_pieces"), (F.col("decoded") == F.col("text")).alias("same"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources", mix),
    ("SentencePiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again before the next."""
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs
