"""The shared folder: read from the session, refused where it would be a machine's own on a cluster, left empty."""

import os

import pytest

from clausemill import session


class Conf:
    def get(self, *_):
        return None


class OnCluster:
    conf = Conf()

    class sparkContext:
        master = "spark://head:7077"

        @staticmethod
        def getConf():
            return Conf()


def test_unset_folder_on_a_cluster_raises():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(OnCluster)


def test_set_folder_is_used_and_cleared(spark):
    root = session.shared_dir(spark)
    assert root == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = session.materialize(spark.range(5), "five")
    assert df.count() == 5
    mine = f"{root[7:]}/clausemill/{spark.sparkContext.applicationId}"
    assert os.listdir(mine)
    session.clear(spark)
    assert not os.path.exists(mine)
