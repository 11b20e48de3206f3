"""Notices as they stand in files: wrapped, in comments, within a line."""

from sparkloom.llm import licenses

PROSE = " ".join(f"word{i}" for i in range(120))


def wrapped(text, mark="# ", width=9):
    ws = text.split()
    return "\n".join(mark + " ".join(ws[i : i + width]) for i in range(0, len(ws), width))


def test_wrapped_and_inner_notices(spark):
    mit = f"{licenses.MIT_GRANT} {licenses.MIT_REST}"
    bsd2, bsd3 = f"{licenses.BSD_GRANT} {licenses.BSD_REST}", f"{licenses.BSD_GRANT} {licenses.BSD_NAMES} {licenses.BSD_REST}"
    gpl = {n: f"{licenses.GNU} {licenses.GNU_REST}".format(kind="", n=n) for n in (2, 3)}
    cases = [
        ("Copyright 2020 Jane Doe. Released under the MIT License.", "MIT"),
        (f"{PROSE} released under the MIT License. {PROSE}", "MIT"),
        (f"Copyright 2019 Acme. Licensed under the Apache License, Version 2.0. {PROSE}", "Apache-2.0"),
        (f"MIT License\n\nCopyright (c) 2020 Jane Doe\n\n{wrapped(mit, '')}\n", "MIT"),
        (f"{wrapped(licenses.MIT_GRANT, ' * ', 12)}\n{PROSE}", "MIT"),
        (f"{PROSE}\n{wrapped(bsd2, '// ')}\n{PROSE}", "BSD-2-Clause"),
        (f"{PROSE}\n{wrapped(bsd3)}\n{PROSE}", "BSD-3-Clause"),
        (f"{wrapped(gpl[3])}\n{PROSE}", "GPL-3.0"),
        (f"{wrapped(gpl[2], ' * ', 11)}\n{PROSE}", "GPL-2.0"),
        (f"{wrapped(licenses.APACHE)}\n{PROSE}", "Apache-2.0"),
        (f"{PROSE} you should have received a copy of the GNU General Public License {PROSE}", "GPL-3.0"),
        (PROSE, None),
        ("we asked whether the software is free and what a license may permit", None),
    ]
    rows = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(cases)], "path string, text string")
    got = {int(r["path"]): (r["own_license"], r["n_notices"]) for r in licenses.scanned(rows).collect()}
    assert [got[i][0] for i in range(len(cases))] == [x for _, x in cases]
    assert all((got[i][1] == 1) == (x is not None) for i, (_, x) in enumerate(cases))


def test_every_text_is_found_in_prose(spark):
    rows = [(str(i), f"{PROSE}\n{wrapped(t, ' * ')}\n{PROSE}") for i, (_, t) in enumerate(licenses.TEXTS)]
    got = {int(r["path"]): r["own_license"] for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {i: got[i] for i in got if got[i] != licenses.TEXTS[i][0]} == {}


def altered(text, k):
    """A header as a project has it: another spelling of a word, a name or a year put in, a word left out."""
    ws = text.split()
    if len(ws) > 12:
        ws[len(ws) // 2] = ("program", "file", "package")[k % 3]
        ws.insert(len(ws) // 3, ("Acme", "2021", "et")[k % 3])
    return " ".join(ws)


def test_planted_headers_are_recalled(spark):
    marks = ["# ", "// ", " * ", "; ", "-- "]
    planted, k = [], 0
    for name, text in licenses.TEXTS:
        for mark in marks:
            k += 1
            planted.append((name, f"{PROSE}\n{wrapped(altered(text, k), mark, 7 + k % 6)}\n{PROSE}"))
    clean = [" ".join(f"word{(i * 7 + j) % 911}" for j in range(200)) + " the license of this software file is free to use" for i in range(50)]
    rows = [(str(i), t) for i, (_, t) in enumerate(planted)] + [(f"c{i}", t) for i, t in enumerate(clean)]
    got = {r["path"]: r["own_license"] for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    found = sum(got[str(i)] is not None for i in range(len(planted))) / len(planted)
    right = sum(got[str(i)] == n for i, (n, _) in enumerate(planted)) / len(planted)
    print("recall", found, "right", right)
    assert len(planted) >= 250 and found >= 0.95 and right >= 0.9
    assert not any(got[f"c{i}"] for i in range(50))


def test_tags_of_unknown_licences_are_not_taken_for_known_ones(spark):
    rows = [("a", f"// SPDX-License-Identifier: Apache-2.0\n{PROSE}"), ("b", f"# SPDX-License-Identifier: Sleepycat\n{PROSE}"), ("c", f"SPDX-License-Identifier: GPL-2.0-or-later\n{PROSE}")]
    got = {r["path"]: r["own_license"] for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a": "Apache-2.0", "b": None, "c": "GPL-2.0"}


#: Notices as projects have them, none of which is a template.
HELD_OUT = [
    ("MIT", "Copyright (c) Example, Inc. and its affiliates. All rights reserved. This source code is licensed under the MIT license found in the LICENSE file in the root directory of this project."),
    ("MIT", "This code is released under the MIT License, see the LICENSE file."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this library and associated documentation files (the Library), to deal in the Library without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of it"),
    ("MIT", "Licensed under the MIT License. See License.txt in the project root for license information."),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "This file is licensed to you under the Apache License, Version 2.0 (the License); you may not use it except in compliance with the License. You may obtain a copy at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Copyright 2012 The Example Authors. All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file in the root of the source tree."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met"),
    ("GPL-3.0", "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This file is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-2.1", "This toolkit is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Bar is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("MPL-2.0", "This source code is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with it, you can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the author be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to these restrictions"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE or copy at http://www.boost.org/LICENSE_1_0.txt"),
    ("EPL-2.0", "This program and its accompanying materials are made available under the terms of the Eclipse Public License v2.0 which is available at https://www.eclipse.org/org/documents/epl-2.0/"),
    ("CC-BY-4.0", "This document is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Content is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software, released into the public domain by its author."),
    ("OFL-1.1", "This font is licensed under the SIL Open Font License, Version 1.1, which is available with a FAQ at http://scripts.sil.org/OFL"),
    ("MIT", "SPDX-License-Identifier: MIT"),
]


def test_recall_on_wordings_that_are_no_templates(spark):
    assert not {t for _, t in HELD_OUT[:-1]} & {t for _, t in licenses.TEXTS}
    rows = [(str(i), f"{PROSE}\n{wrapped(t, ' * ', 8 + i % 4)}\n{PROSE}") for i, (_, t) in enumerate(HELD_OUT)]
    got = {int(r["path"]): r["own_license"] for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    found = [i for i in got if got[i] is not None]
    right = [i for i in got if got[i] == HELD_OUT[i][0]]
    missed = {i: (got[i], HELD_OUT[i]) for i in got if i not in right}
    assert len(found) >= 0.95 * len(HELD_OUT) and len(right) >= 0.9 * len(HELD_OUT), missed


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([("a/LICENSE", f"Released under the MIT License. {PROSE}", "d", "l", 1, 2.0, True, "p"), ("a/b/x", "none", "e", "m", 2, 3.0, False, "q")], "path string, text string, dir string, license string, n_notices int, own_score double, is_license_file boolean, row string")
    got = {r["path"]: r for r in licenses.inherited(licenses.scanned(df)).collect()}
    assert got["a/b/x"]["license"] == "MIT" and got["a/b/x"]["origin"] == "inherited" and got["a/b/x"]["row"].asDict() == {"dir": "e", "license": "m", "n_notices": 2, "own_score": 3.0, "is_license_file": False, "row": "q"}
