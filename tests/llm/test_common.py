"""What the operators share."""

import time

from tidegrid.llm import common


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def heap(spark):
    return spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage().getCommitted() >> 20


def test_saving_gives_the_drivers_memory_back(spark, monkeypatch):
    scratch = common.Scratch(spark)
    garbage = [spark._jvm.java.nio.ByteBuffer.allocate(100 << 20) for _ in range(8)]
    held, before = heap(spark), full_collections(spark)
    del garbage
    monkeypatch.setattr(common, "_relieved", time.monotonic() - common.RELIEVE_S - 1, raising=False)
    assert scratch.save(spark.range(3)).count() == 3
    assert full_collections(spark) > before
    common.relieve(spark)
    assert heap(spark) < held - 300


def test_not_at_every_table(spark, monkeypatch):
    monkeypatch.setattr(common, "_relieved", time.monotonic())
    before = full_collections(spark)
    common.relieve(spark, 3600)
    assert full_collections(spark) == before
