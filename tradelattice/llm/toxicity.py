"""Toxicity of documents by subword-bag embeddings under a linear softmax.

Misspelt and inflected forms share the character n-gram vectors of the forms that were learnt. Windows of words are
pooled by their maximum (:mod:`tradelattice.llm.subwords`), so a few insults in a long text are not averaged away.

Defined results: a null or empty text gets the model's bias alone; without labels of both classes every text gets the
same score, the smoothed share of label 1 among the learnt rows (0.5 without any); repeated rows are scored each;
labels that are null or repeated do not change the number of rows; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelattice.llm import subwords
from tradelattice.llm.common import free_name, text_of

SETTINGS = subwords.Settings(pooling="max", window=16, epochs=8)
FOLDS = 5
THRESHOLD = 0.5


def score(df: DataFrame, documents: DataFrame, labels: DataFrame, settings: subwords.Settings = SETTINGS,
          folds: int = FOLDS, name: str = "score") -> DataFrame:
    """``df`` with the probability that its ``text`` is toxic, learnt from ``documents`` with ``labels.toxic`` outside fold 0."""
    model = subwords.learn(documents, labels, "toxic", folds, settings)
    return df.withColumn(name, subwords.scorer(df, model, text_of()))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with their columns unchanged."""
    name = free_name("_toxicity", docs)
    return score(docs, docs, labels, name=name).where(F.col(name) < threshold).select(*docs.columns)
