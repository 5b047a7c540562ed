"""Large JSON arrays against the json library, also where blocks end within strings, escapes and numbers."""

import json
import random

from quirefold.sources import files


def split(spark, path):
    good, bad = files.array_items(spark, str(path))
    rows = sorted((r.item, r.value) for r in good.collect())
    assert [i for i, _ in rows] == list(range(len(rows)))
    return [v for _, v in rows], bad.count()


def value(r, depth=0):
    kind = r.randint(0, 9 if depth < 3 else 6)
    text = lambda: "".join(r.choice('ab,[]{}"\\\n\té😀 :') for _ in range(r.randint(0, 9)))
    if kind > 8:
        return {text(): value(r, depth + 1) for _ in range(r.randint(0, 3))}
    if kind > 6:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return [r.randint(-5, 999), r.random(), None, True, text(), text(), text()][kind]


def test_values_are_those_of_the_library(spark, tmp_path):
    r = random.Random(9)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for n, size in ((0, "64"), (1, "64"), (200, "97"), (1500, "4096")):
            values = [value(r) for _ in range(n)]
            (tmp_path / f"{n}.json").write_text(json.dumps(values, ensure_ascii=n % 3 == 0, indent=n % 2 or None), encoding="utf-8")
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", size)
            found, bad = split(spark, tmp_path / f"{n}.json")
            assert [json.loads(x) for x in found] == values and bad == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_what_is_no_array_is_refused_whole(spark, tmp_path):
    for i, text in enumerate(('{"a": [1, 2]}', "1, 2", "[1, 2", "[1], [2]", '["a, b]', "[1, 2] 3", "[1,, 2]", "[1, 2,]", "[1]]")):
        (tmp_path / f"bad{i}.json").write_text(text)
        assert split(spark, tmp_path / f"bad{i}.json") == ([], 1), text
    (tmp_path / "ok.json").write_text('\n [ {"id": "a,]"} , {"id": 2}, 7 ]\n')
    good, bad = files.read_dataset(spark, str(tmp_path / "ok.json"), "id string")
    assert sorted(r.id for r in good.collect()) == ["2", "a,]"] and [r.value for r in bad.collect()] == ["7"]
