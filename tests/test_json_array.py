"""Large JSON arrays read in byte ranges, against the whole read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from demandlens.sources import feed
from demandlens.sources.json_array import read_json_array


@pytest.fixture
def ranges(spark):
    """Ranges of a few dozen bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "48")
    spark.conf.set(names[1], "48")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, 12, -1.5])
    if kind < 5:
        return "".join(rng.choice('ab,,[]{}"\\ \n\t:é日🎉') for _ in range(rng.randint(0, 12)))
    if kind == 5:
        return {"".join(rng.choice('k,"]') for _ in range(3)): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]


def shown(df):
    return sorted((r.path.rsplit("/", 1)[1], r.pos, json.dumps(json.loads(r.e), sort_keys=True)) for r in df.select("path", "pos", F.expr("to_json(element)").alias("e")).collect())


def test_same_rows_as_the_whole_read(spark, tmp_path, ranges):
    rng = random.Random(6)
    for i in range(12):
        body = [value(rng) for _ in range([0, 1, 2, 40][i % 4])]
        (tmp_path / f"f{i}.json").write_text(json.dumps(body, indent=rng.choice([None, 2]), ensure_ascii=i % 2 == 0) + rng.choice(["", "\n\n"]), encoding="utf-8")
    (tmp_path / "empty.json").write_text("  [ \n ] ")
    split, whole = read_json_array(spark, str(tmp_path)), feed.read_feed(spark, str(tmp_path))
    assert shown(split) == shown(whole)
    assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 40


@pytest.mark.parametrize("body", [" ", '{"a": [1, 2]}', "1, 2", "[1, 2", "[1, 2]]", "[1], [2]", '["a, b]', "[1] 2", '[1, "x]', "[1],", "]1,2["])
def test_what_is_no_array_is_fatal(spark, tmp_path, ranges, body):
    (tmp_path / "good.json").write_text("[1, 2]")
    (tmp_path / "bad.json").write_text(body)
    with pytest.raises(ValueError, match="bad.json"):
        read_json_array(spark, str(tmp_path))


@pytest.mark.parametrize("body", ["[1, ,2]", "[1, 2,]", "[{]}, 1]", "[1 2]", "[nope]", "[,]"])
def test_elements_that_are_no_json_are_fatal(spark, tmp_path, ranges, body):
    (tmp_path / "bad.json").write_text(body)
    with pytest.raises(Exception, match="no JSON|not a JSON array"):
        read_json_array(spark, str(tmp_path)).collect()


def test_one_large_file_in_many_tasks(spark, tmp_path):
    rows = [{"id": i, "text": 'x, "quoted" [' + "y" * (i % 300), "at": [i, {"deep": [1, 2, 3]}]} for i in range(60_000)]
    (tmp_path / "large.json").write_text(json.dumps(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = read_json_array(spark, str(tmp_path))
        ids = got.select("pos", F.expr("variant_get(element, '$.id', 'int')").alias("id"), F.expr("variant_get(element, '$.at[1].deep[2]', 'int')").alias("deep"))
        assert ids.where("pos = id AND deep = 3").count() == got.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
