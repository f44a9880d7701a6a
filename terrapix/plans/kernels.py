"""Queries of the radial classifier and of the search over settings; no SQL has these fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as fo
from ..operators import kernels as ke
from ..sources.shared import stored
from .extras import B, labelled
from .registry import query


@query("svm_radial")
def svm_radial(spark, d):
    """Class and probabilities of every pixel by radial support vectors, fitted on two rows of three."""
    rows = labelled(spark, d)
    model = ke.train_radial(rows.where("row % 3 <> 0"), B, "cls", features=64)
    return ke.predict_radial(model, rows).select("row", "col", "cls", "pred", F.transform("proba", lambda p: F.round(p, 6)).alias("proba"))


GRID = {"numTrees": [2, 4, 8, 12], "maxDepth": [2, 4, 6, 8]}


def _found(spark, d):
    """Ten settings of the grid on three folds of segments, here blocks of pixels."""
    rows = labelled(spark, d).withColumn("segment_id", F.floor(F.col("row") / 4) * 100 + F.floor(F.col("col") / 5))
    folds = fo.balanced_group_folds(rows, "segment_id", "cls", 3)
    return ke.search(stored(rows.join(folds, "segment_id"), "folded"), B, "cls", "segment_id", "fold", GRID)


@query("random_search")
def random_search(spark, d):
    return _found(spark, d)


@query("best_settings")
def best_settings(spark, d):
    return ke.best_settings(_found(spark, d), list(GRID))
