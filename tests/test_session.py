"""Checkpoint-folder rules: a cluster session never gets a machine-local folder."""

import pytest

from tillroll.plans.session import ensure_checkpoint_dir


class _Opt:
    def __init__(self, value=None):
        self.value = value

    def isDefined(self):
        return self.value is not None

    def get(self):
        return self.value


class _FakeSession:
    """Just enough of a SparkSession for ensure_checkpoint_dir."""

    def __init__(self, master, configured=None):
        outer = self
        self.set_dir = None

        class Conf:
            def get(self, key, default=None):
                return configured if key == "spark.checkpoint.dir" else default

            def set(self, key, value):
                pass

        class SC:
            def __init__(self):
                self.master = master

            def getConf(self):
                return Conf()

            def setCheckpointDir(self, path):
                outer.set_dir = path

            class _jsc:
                @staticmethod
                def sc():
                    class S:
                        @staticmethod
                        def getCheckpointDir():
                            return _Opt(outer.set_dir)
                    return S()

        self.sparkContext = SC()
        self.conf = Conf()


def test_cluster_without_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_FakeSession("spark://cluster:7077"))


def test_cluster_uses_the_configured_shared_folder():
    s = _FakeSession("yarn", configured="hdfs://shared/ckpt")
    assert ensure_checkpoint_dir(s) == "hdfs://shared/ckpt"
    assert s.set_dir == "hdfs://shared/ckpt"


def test_local_session_gets_a_scratch_folder():
    s = _FakeSession("local[2]")
    path = ensure_checkpoint_dir(s)
    assert path.startswith("/tmp") or "tillroll-ckpt-" in path
