"""Where intermediate tables go."""

import pytest

from fieldsheet.plans import scratch


class _Session:
    """A session as far as the folder is asked for, on a cluster or not."""

    def __init__(self, master, settings):
        self.conf = self
        self.sparkContext = self
        self.master, self.settings = master, dict(settings)

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value

    def getConf(self):
        return self


def test_the_setting_is_used_as_it_is():
    assert scratch.shared_folder(_Session("yarn", {scratch.SETTING: "hdfs://x/y"})) == "hdfs://x/y"


def test_a_local_warehouse_will_do_on_one_machine_only():
    local = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}
    assert scratch.shared_folder(_Session("local[4]", local)) == "file:/tmp/warehouse/_intermediate"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(_Session("spark://host:7077", local))
    assert scratch.shared_folder(_Session("yarn", {"spark.sql.warehouse.dir": "hdfs://x/w"})) == "hdfs://x/w/_intermediate"
