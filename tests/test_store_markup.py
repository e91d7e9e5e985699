import pytest
from pyspark.sql import functions as F

from paperloom.functions.markup import blocks
from paperloom.sources import store


def test_blocks():
    text = "# Judul *x*\nsatu\ndua\n\n- a\n- **b**\n1. c\n> kutip <i>\n\n| k | v |\n|---|---|\n| 1 | `2` |"
    assert blocks(text) == ("<h1>Judul <em>x</em></h1><p>satu<br>dua</p><ul><li>a</li><li><strong>b</strong></li></ul><ol><li>c</li></ol><blockquote>kutip &lt;i&gt;</blockquote>"
                            "<table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td><code class=\"ic\">2</code></td></tr></table>")
    assert blocks(None) is None and blocks("") == ""


def test_store(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.range(10).select("id", F.when(F.col("id") < 5, "a").otherwise("b").alias("collection"))
    store.rebuild(df, at)
    store.replace_collections(spark.createDataFrame([(99, "b")], "id long, collection string"), at)
    assert sorted(r.id for r in store.read(spark, at).collect()) == [0, 1, 2, 3, 4, 99]
    plan = store.read(spark, at, ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "collection" in plan.split("PartitionFilters: [")[1].split("]")[0]
    store.rebuild(df.where("id = 1"), at)
    assert store.read(spark, at).count() == 1
    with pytest.raises(ValueError):
        store.check_aligned(3, 2)
