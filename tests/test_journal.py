"""A chain of migrations that fails on its way."""

import pytest
from pyspark.sql import functions as F

from postmill.operators import migrate as MG
from postmill.plans.migrate import chain, legacy


def test_a_failed_step_is_resumed(spark, sf, tmp_path):
    journal = MG.Journal(spark, str(tmp_path / "j"))
    assert journal.version() == 0 and journal.keep(legacy(spark, sf).where("length(id) < 5"), 1) and not journal.keep(legacy(spark, sf), 1)
    steps = chain()
    broken = [*steps[:2], (4, lambda df: df.withColumn("body", F.raise_error(F.lit("stopped")))), *steps[3:]]
    with pytest.raises(Exception, match="stopped"):
        journal.run(broken)
    assert journal.version() == 3 and "reposts" in journal.table().columns
    ran = []
    watched = [(v, lambda df, v=v, step=step: (ran.append(v), step(df))[1]) for v, step in steps]
    assert journal.run(watched) == [4, 5] == ran and journal.run(watched) == []
    assert journal.version() == 5 and journal.table().where("a = 'media/url' AND tx = 2").count() > 0
