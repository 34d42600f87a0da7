"""Licence files in their usual forms."""

import os
import textwrap

import pytest
from pyspark.sql import functions as F

from gradeflow.llm.licenses import DIGESTS, LICENSES, canonical, license_scan

TEXT = dict(LICENSES)
FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3",
         "MPL-2.0": "MPL-2.0"}
FOLDER = "/usr/share/common-licenses"


def wrapped(text, width=72):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n"))


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.license for r in license_scan(rows).orderBy("doc_id").collect()]


def test_usual_files(spark):
    isc = wrapped(TEXT["ISC"]).replace("above copyright", "above\ncopyright")
    assert "\ncopyright notice" in isc
    files = [
        ("MIT", "MIT License\n\nCopyright (c) 2024 Some One\n\n" + wrapped(TEXT["MIT"]) + "\n"),
        ("MIT", "The MIT License (MIT)\n\nCopyright © 2011-2015 Some One <a@b.c>\nCopyright 2016 Others\n\n" + wrapped(TEXT["MIT"], 60)),
        ("MIT", "Copyright (c) 2020 X. All rights reserved.\r\n\r\nAll rights reserved.\n" + TEXT["MIT"].replace('"', "“")),
        ("MIT", "Copyright <YEAR> <COPYRIGHT HOLDER>\n" + TEXT["MIT"].upper()),
        ("ISC", "ISC License\n\nCopyright (c) [year] [fullname]\n\n" + isc),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2017, Some One\nAll rights reserved.\n\n" + wrapped(TEXT["BSD-3-Clause"], 79)),
        ("BSD-2-Clause", "Copyright 2017 Some One\n\n" + TEXT["BSD-2-Clause"].replace("COPYRIGHT HOLDER", "COPYRIGHT OWNER")),
        ("Unlicense", wrapped(TEXT["Unlicense"]).replace("https:", "http:") + "\n"),
        (None, "MIT License\n\n" + TEXT["MIT"].replace("free of charge", "for a charge")),
        (None, "Copyright notice and this permission notice appear in all copies."),
        (None, "MIT License\n"), (None, ""), (None, None),
    ]
    assert found(spark, [t for _, t in files]) == [name for name, _ in files]


def test_a_line_that_says_copyright_is_no_notice(spark):
    rows = spark.createDataFrame([("the\ncopyright notice stays\nCopyright 1999 goes\n(c) goes\ncopyright\n",)], "t string")
    assert rows.select(canonical(F.col("t"))).first()[0] == "the copyright notice stays copyright"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence files on this machine")
def test_official_files(spark):
    texts = [open(f"{FOLDER}/{f}", encoding="utf-8").read() for f in FILES.values()]
    assert set(FILES) <= {name for name, _ in DIGESTS}
    assert found(spark, texts) == list(FILES)
    assert found(spark, ["\n  " + t.upper().replace("\n", "\r\n   ") + "\n\n" for t in texts]) == list(FILES)
    assert found(spark, [t + "\nand more" for t in texts]) == [None] * len(texts)
