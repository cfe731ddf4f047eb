"""Header blocks, tags and licence files."""

from pyspark.sql import functions as F

from meshfold.llm import license_scan


def test_headers_and_licence_files(spark):
    full = dict(license_scan._FULL)
    prose = "the quick fox walks over the green hill and sleeps near an old river while the rain falls on the roof of a small house"
    wrapped = "# Permission is hereby granted, free of\n# charge, to any person obtaining a\n# copy of this software, under the\n# MIT License.\nx = 1\n"
    rows = [(1, "a/x.py", "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;"), (2, "b/x.py", "# SPDX-License-Identifier: MIT\n" + prose), (3, "c/x.py", wrapped), (4, "d/x.py", f"{prose} licensed under the Apache License, Version 2.0. {prose}"), (5, "none/x.py", prose), (6, "none/y.py", "# SPDX-License-Identifier: Zlib\n" + prose), (7, "none/z.py", f"{prose}\nwithout a license {prose}")]
    rows += [(10 + i, f"{k}/LICENSE", f"Copyright (c) 2020 Some One\n\n{t}") for i, (k, t) in enumerate(sorted(full.items()))] + [(20 + i, f"{k}/src/x.py", prose) for i, k in enumerate(sorted(full))]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", F.col("path")).collect()}
    assert [(got[i].license, got[i].origin) for i in (1, 2, 3, 4)] == [("GPL-3.0", "own"), ("MIT", "own"), ("MIT", "own"), ("Apache-2.0", "own")]
    assert [(got[i].license, got[i].origin) for i in (5, 6, 7)] == [(None, "none")] * 3
    for i, k in enumerate(sorted(full)):
        assert (got[10 + i].license, got[10 + i].origin) == (k, "own")
        assert (got[20 + i].license, got[20 + i].origin, got[20 + i].from_dir) == (k, "inherited", k)


def test_repeated_rows_count_once(spark):
    """One licence line of 22 % of a text makes no licence file, however often the row stands in the table."""
    line = "Released under the MIT License."
    text = line + "\n" + "x" * (len(line) * 100 // 22 - len(line) - 1)
    other = "plain words here"
    for times in (1, 2, 5):
        rows = [(1, "a/x", text, "clash")] * times + [(2, "a/y", other, "clash"), (1, "a/x", other, "clash")]
        got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string, license string"), "doc_id", F.col("path")).collect()
        assert sorted((r.doc_id, r.license, r.origin) for r in got if r.license) == [(1, "MIT", "own")] * times
        assert sorted((r.doc_id, r.origin) for r in got if not r.license) == [(1, "none"), (2, "none")]
