"""A trainable text scorer (stands in for a downloaded classifier, R10).

``RegexTokenizer -> HashingTF -> LogisticRegression`` fitted on labelled
documents with Spark ML; scoring is a JVM-side ``transform`` (no Python
worker).  The hashed feature space has a fixed width, so model size does not
grow with the data.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefline.functions.text import WORD_PATTERN
from prefline.operators.scorers import output_entry
from prefline.sources.tables import spread


class LinearTextScorer:
    """Outputs ``[{label_1, p}, {label_0, 1 - p}]`` like a two-label classifier."""

    name = "linear-text"

    def __init__(self, num_features: int = 1 << 18, max_iter: int = 20, reg: float = 0.01,
                 labels: tuple[str, str] = ("human", "machine")):
        self.num_features = num_features
        self.max_iter = max_iter
        self.reg = reg
        self.labels = labels
        self.model: PipelineModel | None = None

    def fit(self, train: DataFrame, text: str = "text", label: str = "label") -> "LinearTextScorer":
        """Tokenise and hash once, cache only (features, label), then iterate on that.

        The optimiser passes over the data once per iteration; caching the
        hashed vectors (fixed width) instead of the text keeps those passes
        cheap and leaves the text uncached.
        """
        tok = RegexTokenizer(inputCol=text, outputCol="_toks", pattern=WORD_PATTERN, gaps=False,
                             toLowercase=True)
        tf = HashingTF(inputCol="_toks", outputCol="_features", numFeatures=self.num_features)
        lr = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=self.max_iter,
                                regParam=self.reg, probabilityCol="_prob", rawPredictionCol="_raw",
                                predictionCol="_pred")
        data = train.select(F.col(text).alias(text), F.col(label).cast("double").alias("_label")) \
            .where(F.col(text).isNotNull() & F.col("_label").isNotNull())
        feats = tf.transform(tok.transform(data)).select("_features", "_label").persist()
        try:
            lr_model = lr.fit(feats)
        finally:
            feats.unpersist()
        self.model = PipelineModel(stages=[tok, tf, lr_model])
        self.text = text
        return self

    def probability(self, df: DataFrame, text: str, out: str = "score") -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit the scorer first")
        src = spread(df)
        src = src.withColumnRenamed(text, self.text) if text != self.text else src
        scored = self.model.transform(src)
        scored = scored.withColumn(out, vector_to_array(F.col("_prob"))[1])
        if text != self.text:
            scored = scored.withColumnRenamed(self.text, text)
        return scored.drop("_toks", "_features", "_prob", "_raw", "_pred")

    def score_frame(self, df: DataFrame, text: str, out: str) -> DataFrame:
        df = self.probability(df, text, f"__p_{out}")
        p: Column = F.col(f"__p_{out}")
        return df.withColumn(out, F.array(output_entry(self.labels[0], p),
                                          output_entry(self.labels[1], F.lit(1.0) - p)))
