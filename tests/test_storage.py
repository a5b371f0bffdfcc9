import pytest

from paperloom import storage


def test_a_cluster_must_name_a_shared_folder():
    assert storage.runs_on_one_machine("local") and storage.runs_on_one_machine("local[8]")
    assert not storage.runs_on_one_machine("local-cluster[3,2,1024]") and not storage.runs_on_one_machine("spark://host:7077")

    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session)


def test_text_batches_end_with_the_block(spark):
    before = spark.conf.get(storage.BATCH_CONF)
    try:
        for own, inside in (("10000", "1000"), ("0", "1000"), ("64", "64")):
            spark.conf.set(storage.BATCH_CONF, own)
            with pytest.raises(ZeroDivisionError), storage.text_batches(spark):
                assert spark.conf.get(storage.BATCH_CONF) == inside
                raise ZeroDivisionError
            assert spark.conf.get(storage.BATCH_CONF) == own
    finally:
        spark.conf.set(storage.BATCH_CONF, before)
