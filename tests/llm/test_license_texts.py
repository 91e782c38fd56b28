"""Licence texts and notices that are not made of the operator's own tables: one right answer each."""

import os

import pytest

from millrace.llm import licenses

SYSTEM = "/usr/share/common-licenses"
WHOLE = {
    "BSD": "BSD-3-Clause", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
    "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0",
}
BSD = """Copyright (c) 2019, Example Networks, Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

  * Redistributions of source code must retain the above copyright notice,
    this list of conditions and the following disclaimer.

  * Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution.

  * Neither the name of {0} nor the names of its
    contributors may be used to endorse or promote products derived from
    this software without specific prior written permission.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."


def found(spark, texts):
    rows = licenses.decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    return [r.licenses for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.skipif(not os.path.isdir(SYSTEM), reason="no licence texts on this machine")
def test_whole_licences_of_the_system(spark):
    there = [n for n in WHOLE if os.path.exists(f"{SYSTEM}/{n}")]
    texts = [open(f"{SYSTEM}/{n}", encoding="utf-8", errors="replace").read() for n in there]
    assert dict(zip(there, found(spark, texts))) == {n: WHOLE[n] for n in there}


def test_holders_of_any_name(spark):
    names = ["Example Networks, Inc.", "the University", "the copyright holder", "Example", "the Foo Project"]
    assert found(spark, [BSD.format(n) for n in names]) == ["BSD-3-Clause"] * len(names)
    assert found(spark, [BSD.split("  * Neither")[0]]) == ["BSD-2-Clause"]


def test_notices(spark):
    mit = "Copyright 2020 X. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    isc = "Permission to use, copy, modify, and distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies.\n"
    texts = [MPL, f"/*\n{MPL}\n*/", mit, isc, f"{mit}\n\n{isc}", "All rights reserved.", "Contract v. 2 of the parties.", "The rights reserved by all."]
    assert found(spark, texts) == ["MPL-2.0", "MPL-2.0", "MIT", "ISC", "MIT,ISC", "Proprietary", "", ""]
