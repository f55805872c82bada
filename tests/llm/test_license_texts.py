"""Licence files, wrapped notices and SPDX tags."""

import pytest

from sluice.llm import licenses

NOTICE = """\
/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
"""
CODE = "".join(f"value_{i} = compute(alpha{i}, beta{i % 7})\n" for i in range(60))


@pytest.fixture(scope="module")
def model():
    return licenses.Model({"the": 900, "of": 900, "is": 800, "to": 850, "and": 900, "license": 30, "under": 500, "this": 700, "or": 600}, 1000, 0.7, licenses.all_templates())


def test_whole_texts_are_licence_files(model):
    texts = licenses.all_templates()
    for name in licenses.TEXTS:
        got = model.scan(texts[f"{name}#text"])
        assert got[0] == name and got[1] > 0.99 and got[2]
    mit = texts["MIT#text"].replace("<year> <copyright holders>", "2020 Ann Example and others")
    assert model.scan(mit)[0] == "MIT" and model.scan(mit)[2]


def test_wrapped_notices_and_headings(model):
    for text, want in ((NOTICE + CODE, "GPL-3.0"), (NOTICE.replace("version 3", "version 2").replace(" * ", "# ") + CODE, "GPL-2.0"), (CODE + "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n" + CODE, "GPL-3.0"),
                       ("# This work is licensed under a Creative Commons Attribution 4.0\n# International License.\n" + CODE, "CC-BY-4.0"), ("# " + licenses.all_templates()["MIT#text"].replace("\n", "\n# ") + "\n" + CODE, "MIT")):
        assert model.scan(text)[0] == want and not model.scan(text)[2]
    assert model.scan(CODE) == (None, None, False)


def test_spdx_tags(model):
    for text, want in (("// SPDX-License-Identifier: MIT\n" + CODE, "MIT"), ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"), ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\n", "(MIT OR Apache-2.0)"), ("# SPDX-License-Identifier: Zlib", "Zlib")):
        assert model.scan(text) == (want, 1.0, False)


def test_a_real_licence_file_covers_its_directory(spark):
    mit = licenses.all_templates()["MIT#text"].replace("<year> <copyright holders>", "2021 Bo Example")
    files = [(1, "a/LICENSE", mit), (2, "a/b/x.py", CODE), (3, "c/LICENSE.txt", "SPDX-License-Identifier: ISC"), (4, "c/y.py", CODE), (5, "d/z.py", CODE), (6, "a/b/w.c", NOTICE + CODE)]
    got = {r.doc_id: (r.license, r.inherited_from, r.is_license_file) for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", None, True), 2: ("MIT", "a", False), 3: ("ISC", None, True), 4: ("ISC", "c", False), 5: (None, None, False), 6: ("GPL-3.0", None, False)}
