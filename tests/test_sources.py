import json

import numpy as np
import pytest

from ledgerloom.operators.evidence import auto_numbers
from ledgerloom.sinks import canonical
from ledgerloom.sources import grids, manifests, ocr, strict_json

HEADER = "\t".join(ocr.WORD_COLUMNS)


def word(page, block, line, n, conf, text, level=5):
    return "\t".join(map(str, (level, page, block, 1, line, n, 0, 0, 1, 1, conf, text)))


def test_word_table(spark, tmp_path):
    path = tmp_path / "w.tsv"
    rows = [word(1, 1, 1, 2, 90, "weight"), word(1, 1, 1, 1, 80, "Net"), word(1, 2, 1, 1, 95.5, '"a ""b"""'), word(1, 1, 1, 0, -1, "", 4), word(2, 1, 1, 1, 70, "x"), word(2, 1, 1, 2, 60, " ")]
    path.write_text("\n".join([HEADER, *rows]) + "\n")
    got = sorted(tuple(r) for r in ocr.read_ocr(spark, str(path), "words").drop("file").collect())
    assert [r[:3] for r in got] == [(1, 1, "Net weight"), (1, 2, 'a "b"'), (2, 1, "x")] and got[0][3] == 0.85
    path.write_text("\n".join([HEADER, rows[0], rows[0]]))
    with pytest.raises(ValueError, match="twice"):
        ocr.read_words(spark, str(path))
    path.write_text("level\ttext\n5\tx\n")
    with pytest.raises(ValueError, match="missing"):
        ocr.read_words(spark, str(path))


def test_page_text(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_bytes("a\r\n\r\n b\f\fc d\n".encode())
    got = sorted(tuple(r) for r in ocr.read_pages(spark, str(path), 0.5).drop("file").collect())
    assert got == [(1, 1, "a", 0.5), (1, 2, " b", 0.5), (3, 1, "c d", 0.5)]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "j.json"
    path.write_text(json.dumps({"pages": [{"page": 3, "lines": [{"text": "a"}, {"line": 5, "text": "b", "confidence": 80}, {"text": "c"}]}]}))
    rows = ocr.read_json_lines(spark, str(path), "percent", 0.1)
    assert [tuple(r) for r in rows.drop("file").orderBy("line").collect()] == [(3, 1, "a", 0.1), (3, 5, "b", 0.8), (3, 6, "c", 0.1)]
    path.write_text(json.dumps([{"text": "a"}, {"page": 2, "text": "b"}]))
    assert [tuple(r)[:3] for r in ocr.read_json_lines(spark, str(path)).drop("file").orderBy("page").collect()] == [(1, 1, "a"), (2, 1, "b")]
    bundle = ocr.to_bundle(ocr.read_json_lines(spark, str(path)), "d", "memo", "en").first()
    assert bundle.pages[1].lines[0].text == "b"
    path.write_text(json.dumps({"pages": [{"page": 1, "lines": [{"page": 2, "text": "a"}]}]}))
    with pytest.raises(ValueError, match="contradicts"):
        ocr.read_json_lines(spark, str(path))
    with pytest.raises(ValueError, match="unknown format"):
        ocr.read_ocr(spark, str(path), "png")


def test_folders_of_files_keep_apart(spark, tmp_path):
    """Pages, lines and running numbers belong to a file."""
    for name, text in (("a.txt", "one\ntwo\fthree"), ("b.txt", "four")):
        (tmp_path / name).write_text(text)
    rows = ocr.read_ocr(spark, str(tmp_path), "pages")
    got = sorted((r.file.rsplit("/", 1)[1], r.page, r.line, r.text) for r in rows.collect())
    assert got == [("a.txt", 1, 1, "one"), ("a.txt", 1, 2, "two"), ("a.txt", 2, 1, "three"), ("b.txt", 1, 1, "four")]
    bundles = {r.document_id: [len(p.lines) for p in r.pages] for r in ocr.to_bundles(rows, "memo", "en").collect()}
    assert bundles == {"a.txt": [2, 1], "b.txt": [1]}
    with pytest.raises(ValueError, match="several files"):
        ocr.to_bundle(rows, "d", "memo", "en")
    folder = tmp_path / "json"
    folder.mkdir()
    for name in "xy":
        (folder / f"{name}.json").write_text(json.dumps([{"text": "a"}, {"line": 7, "text": "b"}, {"text": "c"}]))
    got = sorted((r.file.rsplit("/", 1)[1], r.line) for r in ocr.read_ocr(spark, str(folder), "json").collect())
    assert got == [(f"{n}.json", k) for n in "xy" for k in (1, 7, 8)]
    words = tmp_path / "words"
    words.mkdir()
    for name in "xy":
        (words / f"{name}.tsv").write_text("\n".join([HEADER, word(1, 1, 1, 1, 80, f"Net{name}")]) + "\n")
    assert sorted((r.page, r.line, r.text) for r in ocr.read_ocr(spark, str(words), "words").collect()) == [(1, 1, "Netx"), (1, 1, "Nety")]


def test_running_numbers_agree_with_the_sequential_rule(spark):
    import random

    rng = random.Random(1)
    rows = [(p, i, rng.choice([None, None, rng.randint(1, 9)])) for p in range(30) for i in range(12)]
    got = {(r.p, r.i): r.state for r in auto_numbers(spark.createDataFrame(rows, "p int, i int, n int"), ["p"], ["i"], "n").collect()}
    for p in range(30):
        state = 0
        for q, i, n in rows:
            if q == p:
                state = state + 1 if n is None else max(state, n)
                assert got[p, i] == state


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}', '{"a":1} x', "", '{"a":Infinity}'])
def test_strict_json_refuses(spark, tmp_path, text):
    with pytest.raises(ValueError):
        strict_json.loads(text)
    (tmp_path / "x.json").write_text(text or " ")
    row = strict_json.read_strict(spark, str(tmp_path / "x.json"), "a double").first()
    assert row.error and row.value is None


def test_strict_json_reads(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1.5, "b": [true]}')
    row = strict_json.read_strict(spark, str(tmp_path / "x.json"), "a double, b array<boolean>").first()
    assert row.error is None and (row.value.a, row.value.b) == (1.5, [True])


def test_grid_and_arrays(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("row,col,red\n0,0,0.5\n0,1,\n0,x,0.1\n0,0,0.25\n")
    good, bad = grids.read_grid(spark, str(path), {"row": "int", "col": "int", "red": "decimal(10,6)"})
    assert good.count() == 2 and sorted(r.reasons[0] for r in bad.collect()) == ["blank:red", "type:col"]
    assert [tuple(r) for r in grids.duplicate_cells(good).collect()] == [(0, 0)]
    with pytest.raises(ValueError, match="header"):
        grids.read_grid(spark, str(path), {"row": "int", "column": "int", "red": "double"})
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    row = grids.read_arrays(spark, str(tmp_path / "a.npy")).first()
    assert (row["shape"], row.kind, row.finite, row["values"]) == ([2, 3], "<f4", True, [0, 1, 2, 3, 4, 5])


def test_manifest_and_containment(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    row = manifests.byte_manifest(spark, [str(tmp_path / "f")]).first()
    assert row.bytes == 3 and row.sha256.startswith("ba7816bf")
    assert manifests.contained(tmp_path, "f") == (tmp_path / "f").resolve()
    for bad in ("../f", "/etc/passwd"):
        with pytest.raises(ValueError):
            manifests.contained(tmp_path, bad)


def test_byte_stable_outputs(spark, tmp_path):
    df = spark.createDataFrame([(2, "b<"), (1, "가")], "k int, v string")
    first, second = (canonical.write_json(d, tmp_path / "o.json", ["k"]) for d in (df, df.repartition(3)))
    assert first == second and "가" in (tmp_path / "o.json").read_text()
    assert canonical.compact({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}' and len(canonical.digest({})) == 64
    assert "b&lt;" in canonical.html_table(df, ["k"], "t")
    cells = spark.createDataFrame([(0, 1, "red")], "row int, col int, fill string")
    assert 'x="12" y="0"' in canonical.svg_grid(cells)
    features = spark.createDataFrame([(1, '{"type":"Feature"}')], "k int, feature string")
    assert json.loads(canonical.feature_collection(features, ["k"]))["features"] == [{"type": "Feature"}]
