import os

import pytest

from stratus.llm.common import _KEPT, drop_kept, fresh, join_uneven, keep


def test_kept_tables_can_be_dropped(spark):
    table = keep(spark.range(5), "test")
    paths = list(_KEPT)
    assert table.count() == 5 and os.path.isdir(paths[-1].removeprefix("file://"))
    assert drop_kept(spark) == len(paths) and drop_kept(spark) == 0
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)


@pytest.mark.parametrize("columns, want", [([], "_x"), (["_X"], "_x_"), (["_x", "a", "_X_"], "_x__")])
def test_fresh_names(columns, want):
    assert fresh("_x", columns) == want


def test_uneven_join_equals_a_join(spark):
    rows = spark.createDataFrame([(k % 7 if k < 3000 else 100 + k, k) for k in range(5000)], "key long, v long")
    sizes = rows.groupBy("key").count().withColumnRenamed("count", "n")
    out = join_uneven(rows, sizes, ["key"], "n")
    assert sorted(map(tuple, out.select("key", "v", "n").collect())) == sorted(map(tuple, rows.join(sizes, "key").select("key", "v", "n").collect()))
    assert join_uneven(rows.limit(0), sizes.limit(0), ["key"], "n").count() == 0
