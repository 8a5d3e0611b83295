import os

import pytest

from tallyforge import session


def test_checkpoints_are_removed_when_released(spark):
    kept = session.checkpointed(spark.range(100).selectExpr("id", "id % 7 as k"))
    assert kept.groupBy("k").count().count() == 7
    at = kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(at)
    session.release(kept)
    assert not os.path.exists(at)


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session._folder_of_tests("spark://host:7077")
