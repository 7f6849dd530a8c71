import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.functions.draws import choice_log, choice_log_column, generator, share_of
from undula.operators.base import check_n_jobs


def test_small_numbers_are_favoured(spark):
    drawn = choice_log(5, 40_000, generator(0))
    column = [r.c for r in spark.range(20_000).select(choice_log_column(5, "id").alias("c")).collect()]
    for i in range(5):
        assert (drawn == i).mean() == pytest.approx(share_of(i, 5), abs=0.01)
        assert np.mean([c == i for c in column]) == pytest.approx(share_of(i, 5), abs=0.015)
    assert choice_log(1, 3, generator(0)).tolist() == [0, 0, 0]
    assert spark.range(2).select(choice_log_column(1, F.col("id")).alias("c")).distinct().count() == 1
    assert (choice_log(9, 50, generator(4)) == choice_log(9, 50, generator(4))).all()


def test_number_of_jobs():
    assert [check_n_jobs(n) for n in (None, 0, 3, -1, -1000)] == [1, 1, 3, os.cpu_count(), 1]
    with pytest.raises(ValueError, match="n_jobs"):
        check_n_jobs("all")
