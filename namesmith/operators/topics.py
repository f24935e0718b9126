"""Topics, by Spark ML."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topics(docs: DataFrame, key: str, tokens: str, k: int = 50, top: int = 10, vocabulary: int = 1 << 18, iterations: int = 20, least: float = 2.0, seed: int = 1) -> DataFrame:
    """(key, topics): a document's strongest topic numbers as strings, by an LDA model over non-stop-words.

    Words of fewer than ``least`` documents (a share of all below 1) are left
    out; ``vocabulary`` bounds the model that every task holds.
    """
    plain = StopWordsRemover(inputCol=tokens, outputCol="_words").transform(docs.where(F.size(tokens) > 0))
    counted = CountVectorizer(inputCol="_words", outputCol="features", vocabSize=vocabulary, minDF=least).fit(plain).transform(plain)
    model = LDA(k=k, maxIter=iterations, docConcentration=[50.0 / k] * k, optimizer="online", seed=seed).fit(counted)
    shares = F.transform(vector_to_array("topicDistribution"), lambda p, i: F.struct((-p).alias("p"), i.alias("i")))
    strongest = F.transform(F.slice(F.sort_array(shares), F.lit(1), F.lit(top)), lambda s: s["i"].cast("string"))
    return model.transform(counted).select(key, strongest.alias("topics"))

