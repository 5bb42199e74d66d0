"""Spellings, copyright lines and rows of all kinds."""

from tabloom.llm.license_scan import known_digests, scan_licenses
from tabloom.llm.license_texts import FOLDER, TEXTS

MIT = dict(TEXTS)["MIT"]


def scan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, digest string")
    out = scan_licenses(df, known_digests(spark))
    return [(r["doc_id"], r["text_license"], r["line_licenses"], r["n_license_lines"]) for r in out.collect()]


def test_whole_texts_and_lines(spark):
    wrapped = "Copyright (c) 2019 A. Person\n\n" + MIT.upper().replace(". ", ".\n  ").replace("SUBLICENSE", "sub" + "licence")
    near = MIT.replace("free of charge", "for a fee")
    rows = [
        (1, MIT), (2, wrapped), (3, near), (4, "  released under the mit LICENCE!!"),
        (5, "Some text.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (6, "Copyright notice and nothing else"), (7, "© 2020 X\nThis work is licensed under the GNU General Public Licence, version 3."),
        (8, None), (9, ""), (None, "SPDX-License-Identifier: ISC"), (10, "MIT " * 20000), (4, "  released under the mit LICENCE!!"),
    ]
    got = scan(spark, [(*r, "x", "y") for r in rows])
    assert len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert by[1][0] == "MIT" and by[2][0] == "MIT" and by[3][0] is None
    assert by[4] == ("MIT", "MIT", 1) and sum(r[0] == 4 for r in got) == 2
    assert by[5] == (None, "Apache-2.0,MIT", 3)
    assert by[6] == by[8] == by[9] == by[10] == (None, None, 0)
    assert by[7] == ("GPL-3.0-only", "GPL-3.0-only", 1)
    assert by[None] == ("ISC", "ISC", 1)


def test_empty_table(spark):
    assert scan(spark, []) == []


def test_whole_license_files(spark):
    files = {p.stem: p.read_text("utf-8") for p in FOLDER.glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(files)
    wrapped = {k: "Copyright (c) 2020 A. Person\n" + "\n  ".join(t.upper().splitlines()) for k, t in files.items()}
    cases = [*files.items(), *wrapped.items()]
    cases += [("GPL-3.0-only", files["GPL-3.0-only"].split("29 June 2007")[1])]
    cases += [("Apache-2.0", files["Apache-2.0"].split("APPENDIX:")[0])]
    cases += [("MIT", f"{t}\n\nCopyright (c) 2019 A. Person\n\n{MIT}") for t in ("MIT License", "The MIT License (MIT)")]
    cases += [(None, files["GPL-3.0-only"].replace("freedom", "servitude"))]
    got = scan(spark, [(i, t, "x", "y") for i, (_, t) in enumerate(cases)])
    assert {r[0]: r[1] for r in got} == {i: k for i, (k, _) in enumerate(cases)}
