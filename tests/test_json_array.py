"""Large JSON arrays against the json module, with splits far smaller than a record."""

import json
import random
import re

import pytest

from sentinela.sources import json_array


@pytest.fixture
def split(spark):
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)

    yield cut
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def made(n, seed):
    rng = random.Random(seed)
    odd = ['"', "\\", "}", "{", "]", "[", "\\\"}", "é", "\n", "data", ':[{', "a b"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))
    return [{"n": i, "t": text(), "data": [{"x": text()}] if rng.random() < 0.4 else None, "o": {"p": {"q": text()}, "r": []}, text() + "k": "y" * rng.choice([0, 5, 3000 if i % 37 == 0 else 1])} for i in range(n)]


def read(spark, path):
    got = json_array.records(spark, path).orderBy("_ord").collect()
    return [json.loads(r.text) for r in got]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [61, 1000, 1 << 27])
def test_one_file_in_many_tasks(spark, split, tmp_path, indent, size):
    rows = made(120 if size > 100 else 40, size)
    path = str(tmp_path / "a.json")
    (tmp_path / "a.json").write_text(json.dumps({"meta": [{"n": -1}], "more": {"data": [{"n": -2}]}, "data": rows, "after": [{"n": -3}], "z": {"a": {"n": -4}}}, indent=indent, ensure_ascii=False), "utf8")
    split(size)
    tasks = json_array.segments(spark, path).rdd.getNumPartitions()
    assert tasks == 1 if size > 1 << 20 else tasks > 10
    assert read(spark, path) == rows
    (tmp_path / "b.json").write_text("\ufeff \n" + json.dumps(rows, indent=indent), "utf8")
    assert read(spark, str(tmp_path / "b.json")) == rows


def test_files_without_records(spark, split, tmp_path):
    split(20)
    for i, t in enumerate(["[]", "{}", '{"data": []}', '{"data": null, "x": [{"a": 1}]}', "", '{"x": "data\\":[{"}', "[1, null, [{}]]"]):
        (tmp_path / f"{i}.json").write_text(t)
    assert read(spark, str(tmp_path / "*.json")) == []
    (tmp_path / "8.json").write_text('[{}, null, {"a": "}"}]')
    (tmp_path / "9.json").write_text('{"data": [{"b": 2}]}\n')
    assert sorted(map(str, read(spark, str(tmp_path / "*.json")))) == ["{'a': '}'}", "{'b': 2}", "{}"]


def test_tokens_are_those_of_the_text_cut_at_quotes():
    """Brackets, parities and keys of lists against the plain way: every part between two quotes looked at by itself."""
    def plain(segment):
        parts = re.sub(r"(?s)\\.", "  ", segment).split('"')
        out, at = [], 0
        for i, p in enumerate(parts):
            for k, c in enumerate(p):
                if c in "[]{}":
                    named = c == "[" and i > 0 and re.fullmatch(r"\s*:\s*", p[:k])
                    out.append((i & 1, c, at + k, parts[i - 1] if named else ""))
            at += len(p) + 1
        last = (len(parts) - 1) & 1
        return [*out, (last, "}", len(segment), "")], last

    random.seed(3)
    for _ in range(20_000):
        segment = "".join(random.choice('"":[[]{ab\\ \n,é') for _ in range(random.randrange(25)))
        assert json_array.tokens(segment) == plain(segment), segment


def test_tokens_scan_a_segment_once(monkeypatch):
    """However many strings it holds: one search for brackets, not one for each part between two quotes."""
    scans, bracket = [], json_array._BRACKET

    class Counted:
        @staticmethod
        def finditer(text):
            scans.append(text)
            return bracket.finditer(text)

    monkeypatch.setattr(json_array, "_BRACKET", Counted)
    found, _ = json_array.tokens('{"a":"1","x":[' + ",".join(f'"value {i}"' for i in range(100)))
    assert [x[1] for x in found] == ["{", "[", "}"] and found[1][3] == "x" and len(scans) == 1
