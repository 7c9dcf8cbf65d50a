import os
import random

import pytest

from kinlink.operators import progress, similarity
from kinlink.sources import tsv

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(folder, name, ids, parts):
    os.makedirs(folder / name)
    cut = sorted(random.Random(len(ids)).sample(range(len(ids)), parts - 1))
    for p, (a, b) in enumerate(zip([0, *cut], [*cut, len(ids)], strict=True)):
        (folder / name / f"part-{p:03d}.tsv").write_text(HEAD + "".join(f"{i}\tname of {i}\taddress\t{'A' if int(i[3:]) % 3 else 'B'}\n" for i in ids[a:b]))


def test_rows_are_numbered_in_the_order_of_the_files(spark, tmp_path, small_blocks):
    r = random.Random(1)
    s2, s3 = ([f"S{s}-{i}" for i in r.sample(range(5000), 700)] for s in (2, 3))
    write(tmp_path, "s2", s2, 7)
    write(tmp_path, "s3", s3, 4)
    rows = tsv.read_in_order(spark, [f"{tmp_path}/s2", f"{tmp_path}/s3"])
    assert rows.rdd.getNumPartitions() > 11
    assert [(x.row, x.entity_id) for x in rows.orderBy("row").collect()] == list(enumerate(s2 + s3))
    first = [x.entity_id for x in tsv.read_entities(spark, f"{tmp_path}/s2", "A", 5).collect()]
    assert first == [i for i in s2 if int(i[3:]) % 3][:5]
    truth = spark.createDataFrame([("S1-1", s3[-1]), ("S1-2", s2[3])], "source1_entity_id string, candidate_entity_id string")
    pool = similarity.candidate_pool(rows, truth, 20)
    want = {s3[-1], s2[3]}
    for rest in (0, 1):
        want |= set([i for i in s2 + s3 if bool(int(i[3:]) % 3) == bool(rest) and i not in (s3[-1], s2[3])][:20])
    assert {x.entity_id for x in pool.collect()} == want


def test_a_checkpoint_is_one_write(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "country string, source1_entity_id string"
    rows = [(c, f"S1-{i}") for i, c in enumerate(["A b/c", None, "", "é+%", "A b/c", "x=1"])]
    pairs = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    path = f"{tmp_path}/pairs"
    assert sorted(map(str, tsv.checkpoint(pairs, path).collect())) == sorted(map(str, spark.createDataFrame(rows, schema).collect())) and seen.value == 6
    more = spark.createDataFrame([*rows, ("new", "S1-9"), ("x=1", "S1-10")], schema)
    assert {x.source1_entity_id for x in tsv.checkpoint(more, path).collect()} == {f"S1-{i}" for i in (*range(6), 9)}
    assert not [p for p in os.listdir(path) if p.startswith("_")]


def test_progress_is_monotone(spark):
    df = spark.range(0, 4000, 1, 8)
    watch, seen = progress.Watch(df, 4000), []

    def slow(batches):
        import time

        for b in batches:
            time.sleep(0.4)
            yield b

    assert watch.run(lambda rows: rows.mapInArrow(slow, rows.schema).count(), seen.append, 0.2) == 4000
    assert len(seen) > 2 and [p.rows for p in seen] == sorted(p.rows for p in seen) and [p.tasks for p in seen] == sorted(p.tasks for p in seen)
    assert any(0 < p.rows < 4000 for p in seen) and any(p.remaining_seconds for p in seen)
    last = seen[-1]
    assert last.rows == 4000 and last.share == 1 and last.remaining_seconds == 0 and last.rows_per_second > 0 and last.tasks == last.known_tasks >= 8
    with pytest.raises(ValueError, match="no"):
        progress.Watch(df).run(lambda rows: (_ for _ in ()).throw(ValueError("no")), seen.append)
    assert progress.Progress(0, 0, 0, 0.0).remaining_seconds is None and progress.Progress(5, 1, 4, 2.0).share == 0.25
