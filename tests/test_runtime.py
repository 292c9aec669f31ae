"""Lineage cuts go to the folder the session names, or to one of their own in local tests."""

from tracewright.runtime import checkpointed, shared_folder


class Session:
    """Just enough of a session to see which folder is taken."""

    def __init__(self, folder, master="yarn"):
        outer = self
        self.set_to = None

        class Empty:
            def isEmpty(self):
                return True

        class Context:
            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": staticmethod(Empty)})

            def setCheckpointDir(self, x):
                outer.set_to = x

        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = Context()
        self.sparkContext.master = master


def test_the_sessions_folder():
    s = Session("hdfs://x/shared")
    assert shared_folder(s) == "hdfs://x/shared" and s.set_to == "hdfs://x/shared"


def test_a_cluster_must_name_one():
    import pytest

    with pytest.raises(RuntimeError):
        shared_folder(Session(None))


def test_local(spark):
    assert shared_folder(spark)
    assert sorted(r.id for r in checkpointed(spark.range(3)).collect()) == [0, 1, 2]


def test_package_is_shipped_once(spark):
    from tracewright.runtime import ship

    ship(spark)
    before = list(spark.sparkContext._python_includes)
    ship(spark)
    assert "tracewright.zip" in before and spark.sparkContext._python_includes == before
