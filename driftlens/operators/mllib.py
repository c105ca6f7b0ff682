"""MLlib text classifier: tokenizer -> hashed term frequencies -> IDF ->
logistic regression, with the label indexed and mapped back."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TOKEN_PATTERN
from ..session import write_scratch


def fit_lr(train: DataFrame, label: str = "gold", text: str = "text", num_features: int = 1 << 16,
           max_iter: int = 10, reg: float = 1e-3) -> PipelineModel:
    """Fit on ``train``. The texts are read once: the label index and the hashed term
    counts are written to the checkpoint folder, and the inverse document frequencies and
    every optimiser iteration read those sparse vectors."""
    src = train.select(label, F.coalesce(F.col(text), F.lit("")).alias(text))
    hashed = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)]).fit(src)
    vectors = write_scratch(hashed.transform(src).select(label, "_tf"))
    rest = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"),
        IDF(inputCol="_tf", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=max_iter, regParam=reg, family="multinomial"),
    ]).fit(vectors)
    index, idf, regression = rest.stages
    return PipelineModel(stages=[index, *hashed.stages, idf, regression])


def score_lr(model: PipelineModel, docs: DataFrame, text: str = "text", keep=(),
             label_col: str = "pred_label", conf_col: str = "pred_confidence") -> DataFrame:
    # The label indexer is a training-time stage: scored rows may carry
    # labels never seen in training (or none), so only the feature and
    # classifier stages run here.
    indexer = model.stages[0]
    src = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    pred = PipelineModel(stages=model.stages[1:]).transform(src)
    back = IndexToString(inputCol="prediction", outputCol=label_col, labels=indexer.labels)
    out = back.transform(pred)
    return out.select(*keep, label_col,
                      F.array_max(vector_to_array("probability")).alias(conf_col))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
