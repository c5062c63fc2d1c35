import json

import pytest
from pyspark.sql import functions as F

from lorestream.functions import questions
from lorestream.sources import loader, office


def test_dispatch_over_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("\n".join(map(str, range(120))))
    (tmp_path / "latin.md").write_bytes("# café".encode("latin-1"))
    (tmp_path / "t.csv").write_text("x,y\n" + "\n".join(f'{i},"a,{i}"' for i in range(51)))
    (tmp_path / "ragged.csv").write_text("x\n1,2\n")
    (tmp_path / "sub" / "o.json").write_text(json.dumps({"k": list(range(150))}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "p.html").write_text("<title>t</title><p>one<p>two<script>x</script>")
    (tmp_path / "w.docx").write_bytes(office.write("docx", ["para"]))
    (tmp_path / "e.docx").write_bytes(office.write("docx", []))
    (tmp_path / "x.exe").write_bytes(b"\0")
    out = {}
    for r in loader.load(spark, str(tmp_path)).orderBy("page_number").collect():
        out.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert {k: [(r.status, r.n_lines) for r in v] for k, v in out.items()} == {
        "a.txt": [("ok", 50), ("ok", 50), ("ok", 20)], "latin.md": [("ok", 1)], "t.csv": [("ok", 52), ("ok", 3)], "ragged.csv": [("corrupt", None)], "o.json": [("ok", 100), ("ok", 54)],
        "bad.json": [("corrupt", None)], "p.html": [("ok", 3)], "w.docx": [("ok", 1)], "e.docx": [("empty", 0)], "x.exe": [("unsupported", None)],
    }
    assert out["latin.md"][0].text == "# café" and out["t.csv"][1].text == "Columns: x, y\n\nRow 51: x: 50 | y: a,50"
    assert loader.load(spark, str(tmp_path), "*.md").count() == 1


@pytest.mark.parametrize(("value", "want"), [({"a": 1, "b": {"c": [1, {"d": None}]}}, "a: 1\nb:\n  c:\n    - 1\n    [1]:\n      d: None"), ([[], 2], "[0]:\n- 2"), ("x", "x"), ({}, "")])
def test_outline(value, want):
    assert "\n".join(loader.outline(value)) == want


def test_questions(spark):
    cases = {"Hello!": "greeting", "whats up": "greeting", "What's up": "greeting", "how are you": None, "hiya": "greeting", "OK": "acknowledgment", "thank you!!": "acknowledgment", "hi, tell me": None, "x": "meaningless", "...": "meaningless", "testing": "meaningless", "": None, "hello there": None}
    got = spark.createDataFrame([(q,) for q in cases], "q string").select("q", questions.small_talk(F.col("q"))).collect()
    assert dict(map(tuple, got)) == cases
    long = "Fees are due. Would you like to know more? " + "They are paid at once by all the members of the club who joined before the summer of last year. " * 2
    row = spark.createDataFrame([(long, "Feel free to ask " * 12, None)], "a string, b string, c string").select(*(questions.summary(F.col(c)).alias(c) for c in "abc")).first()
    assert row.a.startswith("Fees are due. They are paid") and row.a.endswith("last year.") and row.b.endswith("ask.") and row.c == ""
