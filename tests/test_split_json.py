"""Records of one large JSON document, in several splits."""

import json
import random

import pytest

from tests.test_split_csv import small_splits  # noqa: F401  (a fixture)
from veil.sources import io, json_split


def examples(seed, n):
    rng = random.Random(seed)
    bits = ["plain", "}", "{", "]", "[", '"', "\\", '\\"', "\n", "ü}", "a}{b", '"}],[{"', "\\\\", "tab\t"]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 6)))
    return [{"tripleset": [[text(), text(), text()] for _ in range(rng.randint(0, 3))],
             "annotations": [{"text": text()} for _ in range(rng.randint(0, 3))], "example_id": k} for k in range(n)]


def rows_of(df):
    return sorted(((r.example_id, [list(t) for t in r.tripleset], [a.text for a in r.annotations]) for r in df.collect()))


def plain(rows):
    return sorted((e["example_id"], e["tripleset"], [a["text"] for a in e["annotations"]]) for e in rows)


@pytest.mark.parametrize("indent", [None, 1])
def test_one_array_in_many_splits(spark, tmp_path, small_splits, indent):  # noqa: F811
    rows = examples(1, 300)
    path = str(tmp_path / "dart.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=indent, ensure_ascii=False)
    assert json_split._pieces(spark, [path]).select("blk").distinct().count() > 8
    assert rows_of(io.read_dart(spark, path)) == plain(rows)
    records = {r.record_no: json.loads(r.record) for r in json_split.json_records(spark, [path]).collect()}
    assert [records[k + 1] for k in range(300)] == rows


def test_entries_of_an_object(spark, tmp_path, small_splits):  # noqa: F811
    entries = [{str(k + 1): {"lexicalisations": [{"comment": "good", "lex": f'l}} {k} [{{"'}],
                             "modifiedtripleset": [{"subject": "s", "property": "{", "object": "]"}], "eid": 100 + k}} for k in range(200)]
    for name, indent in (("a", 2), ("b", None)):
        with open(tmp_path / f"{name}.json", "w", encoding="utf-8") as f:
            json.dump({"version": 3, "note": "[{", "entries": entries}, f, indent=indent)
        got = io.read_webnlg(spark, str(tmp_path / f"{name}.json")).collect()
        assert sorted((r.entry_id, r.eid, r.lexicalisations[0].lex) for r in got) == [
            (k + 1, 100 + k, f'l}} {k} [{{"') for k in range(200)]


def test_empty_objects_documents_and_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{}, {"example_id": 1},{}]\n[ {"example_id": 2} ]\n[]\n')
    (tmp_path / "y.json").write_text("[]")
    (tmp_path / "z.json").write_text("")
    got = json_split.json_records(spark, [str(tmp_path / n) for n in ("x.json", "y.json", "z.json")]).collect()
    assert [json.loads(r.record) for r in sorted(got, key=lambda r: r.record_no)] == [{}, {"example_id": 1}, {}, {"example_id": 2}]
