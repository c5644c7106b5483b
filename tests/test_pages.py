"""Pages in order of their links, whatever their file names."""

import json
import random

import pytest

from tallyforge.sources import manifest, pages


def write(folder, name, url, after, data):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps({"url": url, "next_page": after, "data": data}))


@pytest.mark.parametrize("seed", [0, 1])
def test_file_names_do_not_matter(spark, tmp_path, seed):
    rng = random.Random(seed)
    plain = {}
    for s, n in enumerate((9, 4)):
        names = rng.sample(range(100), n)
        for i in range(n):
            data = [{"name": f"card {rng.randrange(12)}", "cmc": float(1000 * s + 10 * i + j), "colors": ["R"]} for j in range(3)]
            plain |= {c["name"]: c["cmc"] for c in data}
            write(tmp_path / f"set{s}", names[i], f"u{(i * 5) % n if s == 0 else i}", None if i == n - 1 else f"u{((i + 1) * 5) % n if s == 0 else i + 1}", data)
    got = pages.cards(pages.read_pages(spark, [str(tmp_path / "set0"), str(tmp_path / "set1")]))
    assert {r["name"]: r["cmc"] for r in got.collect()} == plain and "mana_cost" in got.columns


@pytest.mark.parametrize("links", [[("a", "b"), ("b", "a")], [("a", "x")], [("a", "c"), ("b", "c"), ("c", None)], [("a", None), ("a", None)], [("z", None), ("a", "b"), ("b", "c"), ("c", "a")], [(None, None)]])
def test_no_chains(spark, links):
    rows = spark.createDataFrame([(0, u, n, []) for u, n in links], "set int, url string, next_page string, data array<struct<name:string>>")
    with pytest.raises(manifest.CheckFailed):
        pages.placed(rows)


def test_none_and_single(spark):
    schema = "set int, url string, next_page string, data array<struct<name:string>>"
    assert pages.cards(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(0, "a", None, [("x",), (None,), ("x",)])], schema)
    assert sorted(str(r["name"]) for r in pages.cards(one).collect()) == ["None", "x"]
