"""The shared folder of a session that runs on a cluster."""

import pytest
from pyspark.sql import functions as F

from procurelake import session


class _Cluster:
    """The test session with the master of a cluster and a checkpoint folder; ``lost`` rows of a trial don't arrive."""

    def __init__(self, spark, folder, lost=0):
        self._spark, self._set, self._lost = spark, {"spark.master": "spark://host:7077", "spark.checkpoint.dir": folder}, lost
        self.conf, self.trials = self, 0

    def get(self, key, default=None):
        return self._set[key] if key in self._set else self._spark.conf.get(key, default)

    def range(self, start, end, step, tasks):
        self.trials += 1
        return self._spark.range(start, end - self._lost, step, tasks)

    def __getattr__(self, name):
        return getattr(self._spark, name)


def test_a_mount_of_all_machines_is_taken_after_one_trial(spark, tmp_path):
    for folder in (f"file://{tmp_path}/mount/", f"{tmp_path}/plain"):
        cluster = _Cluster(spark, folder)
        paths = [session.scratch_path(cluster, "rows") for _ in range(2)]
        assert cluster.trials == 1 and paths[0] != paths[1] and paths[0].startswith(folder.rstrip("/") + "/rows-")
        spark.range(5).select(F.col("id")).write.mode("overwrite").parquet(paths[0])
        assert spark.read.parquet(paths[0]).count() == 5
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "mount").iterdir() if not p.name.startswith(".")) == ["rows", "rows"]


def test_a_folder_of_each_machine_is_refused(spark, tmp_path):
    cluster = _Cluster(spark, f"file://{tmp_path}/own", lost=1)
    for _ in range(2):
        with pytest.raises(RuntimeError, match="shared"):
            session.shared_folder(cluster)
    assert cluster.trials == 2
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(_Cluster(spark, ""))
