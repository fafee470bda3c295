from eventspark.operators import checkpoints


class Context:
    def __init__(self, master, current=None):
        self.master, self.current = master, current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


class Session:
    def __init__(self, master, conf, current=None):
        self.sparkContext = Context(master, current)
        self.conf = conf


def test_the_shared_folder_is_used(tmp_path):
    s = Session("yarn", {"spark.checkpoint.dir": str(tmp_path)})
    checkpoints.ensure_checkpoint_dir(s)
    assert s.sparkContext.current == str(tmp_path)


def test_an_existing_setting_is_kept(tmp_path):
    s = Session("yarn", {"spark.checkpoint.dir": "other"}, current=str(tmp_path))
    checkpoints.ensure_checkpoint_dir(s)
    assert s.sparkContext.current == str(tmp_path)


def test_a_cluster_without_a_folder_is_refused():
    import pytest

    with pytest.raises(RuntimeError):
        checkpoints.ensure_checkpoint_dir(Session("yarn", {}))
