"""A fitted model whose whole state is a small JSON text, so it saves and loads like any Spark ML stage."""

from __future__ import annotations

import json
import math

from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

VALUES_A_TASK = 4_000_000  # multiplications a pass that make a task of an iterative fit worth its while


def rows_for_tasks(rows: DataFrame, work: int, spread: bool = False) -> DataFrame:
    """The rows in no more partitions than their number times the ``work`` of one asks for: an iterative fit runs
    thousands of jobs over them, and tasks of a few hundred rows cost more than they compute. With
    ``spread`` fewer partitions than the work asks for become more, up to the cores there are."""
    wanted = max(1, math.ceil(rows.count() * work / VALUES_A_TASK))
    most = min(wanted, rows.sparkSession.sparkContext.defaultParallelism)
    if spread and rows.rdd.getNumPartitions() < most:
        return rows.repartition(most)
    return rows.coalesce(wanted)


class StateModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted values as JSON", TypeConverters.toString)

    def __init__(self, **values):
        super().__init__()
        self._setDefault(state="{}")
        if values:
            self._set(state=json.dumps(values))

    @property
    def values(self) -> dict:
        return json.loads(self.getOrDefault(self.state))
