"""Classifier of event issues: hashed words, inverse document frequency, logistic regression. Trained by Spark's MLlib;
a linear model, not a transformer, with the same columns of results."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import delete, kept, shared_dir, unique


def stratified(rows: DataFrame, label: str, key: str, share: float = 0.2) -> DataFrame:
    """rows with `test`: the first share of each label's rows, rounded, in an order by hash of the key, which is unique.

    The last row of the share is found by selection: counts of the hashes' first 16 bits tell the range it lies in, and
    only rows of that range are put in order. What is found is a row for each label, sent to where the rows lie, so no
    label's rows meet, and none is moved with its text.
    """
    hashed = rows.select(F.col(label).alias("l"), F.xxhash64(key).alias("h"), F.col(key).alias("k")).withColumn("top", F.shiftright("h", 48))
    ranges = hashed.groupBy("l", "top").agg(F.count("*").alias("n"))
    label_window = Window.partitionBy("l")  # 2^16 ranges at most
    most = F.floor(F.sum("n").over(label_window) * share + 0.5)
    upto = ranges.withColumn("most", most).withColumn("upto", F.sum("n").over(label_window.orderBy("top")))
    edge = upto.where((F.col("upto") >= F.col("most")) & (F.col("upto") - F.col("n") < F.col("most"))).select("l", "top", (F.col("most") - F.col("upto") + F.col("n")).alias("place"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    near = hashed.join(F.broadcast(edge.withColumnsRenamed({"l": "el", "top": "et"})), same("l", "el") & (F.col("top") == F.col("et")))
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h", "k"))
    last = near.withColumn("nth", nth).where("nth = place").select(F.col("l").alias("last_label"), F.struct("h", "k").alias("last_row"))
    own = F.struct(F.xxhash64(key).alias("h"), F.col(key).alias("k"))
    joined = rows.join(F.broadcast(last), F.col(label).eqNullSafe(F.col("last_label")), "left")
    return joined.withColumn("test", F.coalesce(own <= F.col("last_row"), F.lit(False))).drop("last_label", "last_row")


def fitted(rows: DataFrame, features: int = 1 << 12) -> PipelineModel:
    """A model of rows (text, label). Texts are cut and counted once; all passes of the fit read the counts that are kept."""
    cut = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\W+")
    count = HashingTF(inputCol="words", outputCol="tf", numFeatures=features)
    counted = kept(count.transform(cut.transform(rows)).select("label", "tf"), "counted-words")
    learned = Pipeline(stages=[
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), IDF(inputCol="tf", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01, maxIter=60),
    ]).fit(counted)
    labels, weights, model = learned.stages
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/model-{unique()}"
    model.save(path)  # read back without the summary of its training, which holds the session and can't go to tasks
    model = LogisticRegressionModel.load(path)
    delete(spark, path)
    return PipelineModel([labels, cut, count, weights, model])


def classified(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with `predicted`, its score to four places, and the scores of all labels in their order."""
    names = model.stages[0].labels
    y = next(s for s in model.stages if s.hasParam("probabilityCol"))
    out = rows.withColumn("label", F.lit(names[0])) if "label" not in rows.columns else rows
    for stage in model.stages[1:]:
        out = stage.transform(out)
    named = IndexToString(inputCol=y.getPredictionCol(), outputCol="predicted", labels=names).transform(out)
    scores = F.transform(vector_to_array("probability"), lambda p: F.bround(p, 4))
    return named.select(*rows.columns, "predicted", F.array_max(scores).alias("score"), scores.alias("scores"))
