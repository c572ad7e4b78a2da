"""Spark ML analogues of boosted trees, forests and logistic regression; not the same solvers as those they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.operators.tables import written


def predict(rows: DataFrame, kind: str) -> DataFrame:
    """rows: doc_id, role, label, features (array). doc_id, label, predicted of the test rows.

    Classes weigh alike; for xgb only label 1 is weighted, by the ratio of label-0 to label-1 rows."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    own = rows.select("doc_id", "role", "label", array_to_vector("features").alias("features"))
    train = own.filter("role = 'train'")
    share = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ratio = share.get(0, 0) / max(1, share.get(1, 0))
    alike = F.when(F.col("label") == 1, 1.0 / max(1, share.get(1, 1))).otherwise(1.0 / max(1, share.get(0, 1))) * sum(share.values()) / 2
    train = train.withColumn("weight", F.when(F.col("label") == 1, ratio).otherwise(1.0) if kind == "xgb" else alike)
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    model = {"gbt": lambda: GBTClassifier(maxIter=20, maxDepth=3, seed=42, **common), "xgb": lambda: GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.1, minInstancesPerNode=3, subsamplingRate=0.8, seed=42, **common), "forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=5, seed=42, **common), "logistic": lambda: LogisticRegression(maxIter=20, regParam=0.01, **common)}[kind]()
    return model.fit(train).transform(own.filter("role = 'test'")).select("doc_id", "label", F.col("prediction").cast("int").alias("predicted"))


def leaf_neighbourhood(rows: DataFrame, trees: int = 50, depth: int = 5) -> DataFrame:
    """doc_id, tree, leaf, label1, label0, leaf_label: of each label-1 test row that a random forest misses, the
    training rows that share its leaf, tree by tree; a tied leaf has label 0."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = rows.select("doc_id", "role", "label", array_to_vector("features").alias("features"))
    train = own.filter("role = 'train'")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42, featuresCol="features", labelCol="label", leafCol="leaves").fit(train)
    at = model.transform(own).select("doc_id", "role", "label", "prediction", F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
    leaves = at.filter("role = 'train'").groupBy("tree", "leaf").agg(F.count_if(F.col("label") == 1).alias("label1"), F.count_if(F.col("label") == 0).alias("label0"))
    missed = at.filter("role = 'test' AND label = 1 AND prediction = 0").select("doc_id", "tree", F.col("leaf").cast("int").alias("leaf"))
    found = missed.join(leaves.withColumn("leaf", F.col("leaf").cast("int")), ["tree", "leaf"], "left").na.fill(0, ["label1", "label0"])
    return found.select("doc_id", "tree", "leaf", "label1", "label0", F.when(F.col("label1") > F.col("label0"), 1).otherwise(0).alias("leaf_label"))


def document_vectors(toks: DataFrame, size: int = 100, window: int = 5, least: int = 2, rounds: int = 1, parts: int = 1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(vec_id, label, embedding: the mean of a document's word vectors; word, vector) of toks: doc_id, label, toks.

    Word vectors are skip-grams learned over all documents by Spark ML, in `parts` partitions that are averaged; words
    of fewer than `least` places have none. A document without such words has the zero vector. The tokens are written
    once, as vocabulary, training and means each read them.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    toks = written(toks.select("doc_id", "label", "toks"))
    learned = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, numPartitions=parts, seed=seed, inputCol="toks", outputCol="v").fit(toks)
    found = learned.transform(toks).select(F.col("doc_id").alias("vec_id"), "label", vector_to_array("v").alias("embedding"))
    return found, learned.getVectors().select("word", vector_to_array("vector").alias("vector"))
