"""Quality of documents by supervised subword embeddings averaged over the document.

Learned vectors of hashed words and character n-grams, their mean per document and a softmax, trained in numpy by
stochastic gradient descent (:mod:`tradelattice.llm.subwords`).

Defined results: a null or empty text gets the model's bias alone; without labels of both classes every text gets the
smoothed share of label 1; repeated rows are scored each; null or repeated labels do not change the rows; extra
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelattice.llm import subwords
from tradelattice.llm.common import free_name, text_of

SETTINGS = subwords.Settings(pooling="mean", epochs=4)
FOLDS = 5
THRESHOLD = 0.3


def score(df: DataFrame, documents: DataFrame, labels: DataFrame, settings: subwords.Settings = SETTINGS,
          folds: int = FOLDS, name: str = "score") -> DataFrame:
    """``df`` with the probability that its ``text`` is of quality, learnt from ``labels.quality`` outside fold 0."""
    model = subwords.learn(documents, labels, "quality", folds, settings)
    return df.withColumn(name, subwords.scorer(df, model, text_of()))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with their columns unchanged."""
    name = free_name("_quality", docs)
    return score(docs, docs, labels, name=name).where(F.col(name) >= threshold).select(*docs.columns)
