import pytest

from dealerscope.sources import durable


def test_tables_go_to_the_folder_the_session_names(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    kept = durable.materialise(spark.range(5).withColumnRenamed("id", "n"))
    assert [f.name for f in kept.schema] == ["n"] and kept.count() == 5
    folder = f"{root}/dealerscope-{spark.sparkContext.applicationId}/"
    assert all(folder in path for path in kept.inputFiles())
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, conf=None, folder=None):
        self.sparkContext, self.settings, self.conf = _Context(master, folder), conf or {}, self

    def get(self, key, default):
        return self.settings.get(key, default)


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.scratch_root(_Session("yarn"))
    assert durable.scratch_root(_Session("yarn", {"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
    assert durable.scratch_root(_Session("yarn", folder="hdfs:///y")) == "hdfs:///y"


def test_a_local_session_gets_one_folder_of_its_own():
    session = _Session("local[2]")
    first = durable.scratch_root(session)
    assert first and durable.scratch_root(session) == first
