"""Tables of the shared folder go when nothing needs them any more."""

import pytest

from shopfloor.llm.scratch import materialize, working


def there(df):
    return [f for f in df.inputFiles()]


def exists(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_working_tables_go_and_lasting_ones_stay(spark):
    with working(spark):
        outer = there(materialize(spark.range(3)))
        with working(spark):
            inner = there(materialize(spark.range(4)))
            lasting = materialize(spark.range(5), lasting=True)
        assert all(exists(spark, f) for f in outer) and not any(exists(spark, f) for f in inner)
    assert not any(exists(spark, f) for f in outer)
    assert lasting.count() == 5 and materialize(spark.range(2)).count() == 2


def test_working_tables_go_after_an_error(spark):
    with pytest.raises(ValueError):
        with working(spark):
            files = there(materialize(spark.range(3)))
            raise ValueError
    assert files and not any(exists(spark, f) for f in files)
