"""Zero-shot classification: prompts, class vectors, scores, predictions and their accuracy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..sources.tables import exists, stage_table
from .kmeans import cluster_sums
from .similarity import over_rows, query_blocks, with_largest


def expand_prompts(classes: DataFrame, templates: DataFrame) -> DataFrame:
    """(class_id, class_name, template_id, prompt): every class name in every template, at `{c}`. Templates are a short list."""
    return classes.crossJoin(F.broadcast(templates)).select("class_id", "class_name", "template_id", F.replace("template", F.lit("{c}"), F.col("class_name")).alias("prompt"))


def class_subset(classes: DataFrame, allowed: DataFrame) -> DataFrame:
    """The allowed classes with `sub_id`, their number from 0 in class order. Classes are a bounded table."""
    kept = classes.join(allowed.select("class_id").distinct(), "class_id", "left_semi")
    return kept.withColumn("sub_id", F.row_number().over(Window.orderBy("class_id")) - 1)


def class_prototypes(prompts: DataFrame) -> DataFrame:
    """(class_id, embedding): the normalised mean of a class's normalised prompt vectors, added up as `cluster_sums` does.

    Prompts without a vector, with a zero one or without a class take no part; a mean of zero gives null. Class ids are 32-bit.
    """
    unit = prompts.select(F.col("class_id").alias("cluster"), l2_normalize(F.col("embedding")).alias("embedding"))
    return cluster_sums(unit).select(F.col("cluster").cast(prompts.schema["class_id"].dataType).alias("class_id"), l2_normalize(F.col("sums")).alias("embedding"))


def logits(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, logits): inner products with all classes, by class id; null for a row without a vector. No classes give no rows."""

    def fold(own, x, before, ids, c):
        found = x @ c.T
        if before is not None and len(x):
            found = np.hstack((before[0].flatten().to_numpy().reshape(len(x), -1), found))
        return [pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))]

    found = over_rows(rows.select("id", "embedding"), "embedding", query_blocks(classes, "class_id"), "logits array<double>", fold)
    return rows.sparkSession.createDataFrame([], "id long, logits array<double>") if found is None else found


def predict(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, pred, logit): the class of the largest inner product, ties to the lowest class id; repeated ids stay rows of their own.

    A row without a vector has nulls. No classes give no rows.
    """
    found = with_largest(rows.select("id", "embedding"), query_blocks(classes, "class_id"), "logit double, pred bigint")
    return rows.sparkSession.createDataFrame([], "id long, pred long, logit double") if found is None else found.select("id", "pred", "logit")


def masked_predict(rows: DataFrame, classes: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, pred): the best of the allowed classes, in their own numbering; null for a row without a vector."""
    part = class_subset(classes, allowed)
    best = predict(rows, part)
    return best.join(part.select(F.col("class_id").alias("pred"), "sub_id"), "pred", "left").select("id", F.col("sub_id").alias("pred"))


def accuracy(predictions: DataFrame, *keys: str) -> DataFrame:
    """(keys, accuracy): the share of rows whose `pred` is their `label`."""
    return predictions.groupBy(*keys).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def missing_epochs(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` whose epoch is not among the saved ones."""
    return new.join(saved.select("epoch").distinct(), "epoch", "left_anti")


def accuracy_resume(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Saved results and those of epochs that are not in them; order by epoch, newest first, when reading."""
    return saved.unionByName(missing_epochs(saved, new))


def append_accuracies(new: DataFrame, path: str) -> DataFrame:
    """The table (epoch, dataset, accuracy) in the folder `path` after what it lacks of `new` has been added to it.

    An epoch that the table has is left as it is, whatever `new` says; a folder that is not there is made. One writer at a
    time. A row without an epoch is an error.
    """
    spark = new.sparkSession
    checked = new.withColumn("epoch", F.coalesce("epoch", F.raise_error(F.lit("an accuracy without an epoch"))))
    checked = checked.select(*(F.col(f.name).cast(f.dataType) for f in new.schema))
    if exists(spark, path):
        checked = missing_epochs(spark.read.schema(new.schema).parquet(path), checked)
    # Written aside first: Spark must not read the folder that it adds to.
    stage_table(checked, "accuracies").write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path)
