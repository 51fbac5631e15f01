"""From documents to token ids: toxicity, line dedup, near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from lodeseam.llm.common import materialised, table
from lodeseam.llm.decontamination import drop_contaminated
from lodeseam.llm.line_dedup import line_dedup
from lodeseam.llm.neardup import drop_near_duplicates
from lodeseam.llm.pieces import encode_and_check
from lodeseam.llm.token_files import public_path
from lodeseam.llm.toxicity import drop_toxic, fit_examples

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark, docs, sf_dir):
    """Documents that nearest labelled examples call toxic go."""
    return drop_toxic(docs, fit_examples(docs, table(spark, sf_dir, "labels"))).select(COLUMNS)


def lines(spark, docs, sf_dir):
    """Boilerplate lines of a source go; each document stays."""
    return line_dedup(docs).select(COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays: five words, similarity 0.8."""
    return drop_near_duplicates(docs).select(COLUMNS)


def decontamination(spark, docs, sf_dir):
    """Documents with a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pieces(spark, docs, sf_dir):
    """Ids of the SentencePiece model, and whether they decode to the text."""
    return encode_and_check(docs, public_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", pieces),
]

#: SQL can't express nearest neighbours, Hamming distances or merges; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialised(docs, f"pipeline-{i}")
    return docs
