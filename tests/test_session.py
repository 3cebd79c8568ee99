"""Scratch tables and when they go."""

import os
import threading

from photarium.session import releasing, scratch_path, settle


def test_blocks_of_two_threads_keep_their_own_tables(spark):
    opened, ended, seen = threading.Event(), threading.Event(), {}

    def other():
        with releasing(spark):
            seen["other"] = scratch_path(spark, "other")
            settle(spark.range(3), "other", seen["other"])
            opened.set()
            assert ended.wait(60)
            seen["still there"] = os.path.exists(seen["other"])

    thread = threading.Thread(target=other)
    with releasing(spark):
        thread.start()
        assert opened.wait(60)
        own = scratch_path(spark, "own")
        settle(spark.range(3), "own", own)
    assert not os.path.exists(own)
    ended.set()
    thread.join()
    assert seen["still there"] and not os.path.exists(seen["other"])


def test_nested_blocks_and_none(spark):
    free = scratch_path(spark, "free")
    settle(spark.range(1), "free", free)
    with releasing(spark):
        outer = scratch_path(spark, "outer")
        settle(spark.range(1), "outer", outer)
        with releasing(spark):
            inner = scratch_path(spark, "inner")
            settle(spark.range(1), "inner", inner)
        assert os.path.exists(outer) and not os.path.exists(inner)
    assert os.path.exists(free) and not os.path.exists(outer)
