from importlib import resources

import duckdb
import pyarrow as pa
from lorestream.llm import license_scan as L


def rows():
    mit, isc = L.KNOWN[0][1], L.KNOWN[1][1]
    return [
        (1, "Copyright (c) 2019 Someone\n\n" + mit),
        (2, mit.upper().replace(",", " ;").replace("sublicense", "sub-licence")),
        (3, isc.replace("License", "Licence") + "\n© 2020 me\n"),
        (4, mit + " and more"),
        (5, "Some prose.\nReleased under the MIT Licence.\nlicensed under cc by-nc 4.0\nReleased under the MIT License"),
        (6, None),
        (7, ""),
        (8, "…!?"),
        (9, "Released under the MIT license"),
        (9, "Released under the MIT license"),
        (None, "Licensed under CC BY 4.0."),
    ]


def test_scan(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows()], "doc_id long, text string, licence string")
    got = {r.doc_id: (r.licence, r.n_notices, r.notices) for r in L.scan(df).collect()}
    assert got == {
        1: ("MIT", 1, "MIT"), 2: ("MIT", 1, "MIT"), 3: ("ISC", 1, "ISC"), 4: (None, 0, ""), 5: (None, 3, "CC-BY-NC-4.0,MIT"), 6: (None, 0, ""),
        7: (None, 0, ""), 8: (None, 0, ""), 9: ("MIT", 2, "MIT"), None: ("CC-BY-4.0", 0, ""),
    }
    assert L.scan(df.limit(0)).count() == 0
    plan = L.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_oracle(spark):
    data = [(i, t) for i, t in rows() if i not in (9, None)]
    data += [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in data], "text": [t for _, t in data]}))
    want = sorted(con.sql(L.oracle_sql()).fetchall())
    got = sorted(tuple(r) for r in L.scan(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == want


def test_whole_texts_with_and_without_title(spark):
    mit, bsd = L.KNOWN[0][1], L.KNOWN[4][1]
    read = lambda name: (resources.files("lorestream.llm") / "licences" / f"{name}.txt").read_text()
    apache, gpl = read("Apache-2.0"), read("GPL-3.0")
    texts = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit),
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n" + mit),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + bsd),
        ("BSD-3-Clause", bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
        ("Apache-2.0", apache),
        ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 Someone")),
        ("Apache-2.0", apache[: apache.index("APPENDIX")]),
        ("Apache-2.0", apache[apache.index("TERMS AND") :]),
        ("GPL-3.0", gpl[gpl.index("Everyone") : gpl.index("How to Apply These Terms to")]),
        (None, apache.replace("perpetual", "temporary")),
    ]
    names = ["CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "GFDL-1.2", "GFDL-1.3", "Artistic-1.0-Perl", "Unlicense", "BSL-1.0", "Zlib", "Unicode-3.0"]
    texts += [(name, read(name)) for name in names]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in L.scan(df).collect()} == {i: name for i, (name, _) in enumerate(texts)}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": [t for _, t in texts]}))
    assert sorted(con.sql(L.oracle_sql()).fetchall()) == sorted(tuple(r) for r in L.scan(df).collect())
