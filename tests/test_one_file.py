"""One file is not made in one task."""
from weftlink.sources import sinks


def test_one_file_of_many_tasks(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        made.add(1)
        yield from batches

    sinks.write_tsv(spark.range(0, 1000, 1, 6).mapInArrow(run, "id long"), str(tmp_path / "t"))
    assert made.value == 6 and len(list((tmp_path / "t").glob("part-*"))) == 1
