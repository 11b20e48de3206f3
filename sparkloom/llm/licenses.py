"""License scans with DataFrame functions alone: TF-IDF cosine of notices to templates, then inheritance.

Templates are notices, headers, licence texts and SPDX tags; the collection that idf counts over is theirs, so a
template's weights do not change with the files that are scanned, and words that no template has weigh most. A text
is its words in order, whatever lines and comment marks they stand in. A template is looked for only if the
text has words that could reach the threshold at all. It is then laid on each of its anchors in the text, so that
the anchor stands where the template first has it, and the words under it, as many as the template has, are
compared by cosine over sparse TF-IDF weights. Anchors are chosen so that no words without one can reach the
threshold; all of this is per row, without a shuffle. Of overlapping matches a template that is part of another
gives way to it; matches that overlap are one notice. A file is a licence file if its name says so or half of its
words stand in matches. Files without a notice of their own take the licence of the nearest directory upwards that
has a licence file: directories, not files, are joined with their ancestors.

Defined results: null and empty texts have no notice; null paths lie in the root; of equally good templates
and licence files the first by name counts (so of an SPDX expression of several licences the best, or first, is given);
repeated rows get equal results; an empty table gives an empty table; what columns files have besides path and
text, whatever their names, come back in a struct, row.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .winnowing import let

THRESHOLD = 0.75
LICENSE_FILE = "(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"
#: Words that are in any prose, taken as anchors last.
COMMON = set("a an and any are as at be by can for found free from has in into is it may met not of on or see that the this to use with you work 1 2 3 4".split())
#: The usual short notices, and the telling sentence of licence files, by SPDX name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License along with this program, version 3. Free software under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:"""
MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public
License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."""
GNU_ONLY = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General
Public License version {n} as published by the Free Software Foundation."""
GNU_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You
should have received a copy of the GNU {kind}General Public License along with this program. If not, see
https://www.gnu.org/licenses/."""
GNU_HEAD = """GNU {kind}GENERAL PUBLIC LICENSE Version {n}, {day} Copyright (C) {year} Free Software Foundation, Inc. Everyone is
permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
GNU_KINDS = [("GPL-3.0", "", "3", "29 June 2007"), ("GPL-2.0", "", "2", "June 1991"), ("LGPL-3.0", "Lesser ", "3", "29 June 2007"), ("LGPL-2.1", "Lesser ", "2.1", "February 1999"), ("AGPL-3.0", "Affero ", "3", "19 November 2007")]
#: The short notices, and the headers and whole texts that files carry.
TEXTS = [
    *TEMPLATES,
    ("MIT", MIT_GRANT),
    ("MIT", f"{MIT_GRANT} {MIT_REST}"),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_REST}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_NAMES} {BSD_REST}"),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    *((name, text.format(kind=kind, n=n, day=day, year=day[-4:])) for name, kind, n, day in GNU_KINDS for text in (GNU, GNU_ONLY, f"{GNU} {GNU_REST}", GNU_HEAD)),
    *((name, f"You should have received a copy of the GNU {kind}General Public License") for name, kind, n, _ in GNU_KINDS if n == "3"),
]
ROOT_FILE = "license found in the LICENSE file in the root directory of this source tree."
X11_REST = """Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to
promote the sale, use or other dealings in this Software without prior written authorization."""
#: Texts, notices and headers of further licences.
TEXTS += [
    ("MIT", f"This source code is licensed under the MIT {ROOT_FILE}"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", f"This source code is licensed under the Apache 2.0 {ROOT_FILE}"),
    ("Apache-2.0", "This project is licensed under the terms of the Apache License 2.0."),
    ("BSD-3-Clause", f"This source code is licensed under the BSD-style {ROOT_FILE}"),
    ("BSD-3-Clause", "Distributed under the terms of the Modified BSD License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("X11", f"{MIT_GRANT} {MIT_REST} {X11_REST}"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or
organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
permit third-parties to whom the Software is furnished to do so"""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", 'Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.'),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence)"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at https://scripts.sil.org/OFL"),
    ("Artistic-2.0", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License (2.0)."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("PostgreSQL", """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and
without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two
paragraphs appear in all copies."""),
    ("NCSA", f"{MIT_GRANT} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers. Neither the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("Python-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2 1. This LICENSE AGREEMENT is between the Python Software Foundation (PSF), and the Individual or Organization (Licensee) accessing and otherwise using this software (Python) in source or binary form and its associated documentation."),
    ("Ruby", "You can redistribute it and/or modify it under the same terms as Ruby."),
    ("AGPL-3.0", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("LGPL-2.1", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("OFL-1.1", "licensed under the SIL Open Font License, Version 1.1"),
    ("Artistic-1.0-Perl", "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself."),
]
TEXTS += [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in TEXTS)]


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


class Templates:
    """Weights of a set of templates: bounded by their own words, however large the corpus."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.names = [n for n, _ in templates]
        counts = [Counter(words_of(t)) for _, t in templates]
        df = Counter(w for c in counts for w in c)
        self.unseen = math.log(1 + len(templates)) + 1
        self.idf = {w: math.log((1 + len(templates)) / (1 + n)) + 1 for w, n in df.items()}
        norms = [math.sqrt(sum(((1 + math.log(n)) * self.idf[w]) ** 2 for w, n in c.items())) for c in counts]
        self.weights = {w: [(1 + math.log(c[w])) * self.idf[w] / norm if c[w] else 0.0 for c, norm in zip(counts, norms)] for w in self.idf}
        self.words = [words_of(text) for _, text in templates]
        held = [" ".join(["", *ws, ""]) for ws in self.words]
        self.wholes = [[j for j, other in enumerate(held) if len(other) > len(x) and x in other] for x in held]
        self.own_anchors: list[list[str]] = []
        # the most telling words of a template are anchors until the others alone stay below the threshold
        anchors: set[str] = set()
        for i, c in enumerate(counts):
            left = {w: self.weights[w][i] ** 2 for w in c if w not in anchors}
            for w in sorted(left, key=lambda w: (w in COMMON, -left[w], w)):
                if math.sqrt(sum(x for v, x in left.items() if v not in anchors)) < threshold - 0.01:
                    break
                anchors.add(w)
            left, own = {w: self.weights[w][i] ** 2 for w in c}, []
            for w in sorted(left, key=lambda w: (w in COMMON, -left[w], w)):
                if math.sqrt(sum(x for v, x in left.items() if v not in own)) < threshold - 0.01:
                    break
                own.append(w)
            self.own_anchors.append(own)
        self.anchors = sorted(anchors)


def _fixed(value, kind: str) -> Column:
    """A constant of a nested type, told to Spark in one piece and worked out once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def words_in(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def notices(text: Column, t: Templates, threshold: float = THRESHOLD) -> Column:
    """array<struct<license, score, template, start, end>>: where a template laid on its anchors reaches the threshold."""
    n = len(t.names)
    idf = _fixed(t.idf, "map<string,double>")
    weights = _fixed(t.weights, "map<string,array<double>>")
    squares = _fixed({w: [x * x for x in xs] for w, xs in t.weights.items()}, "map<string,array<double>>")
    vocabulary = _fixed(list(t.idf), "array<string>")
    names, sizes = _fixed(t.names, "array<string>"), _fixed([len(ws) for ws in t.words], "array<int>")
    anchors = _fixed(t.own_anchors, "array<array<string>>")
    places = _fixed([[ws.index(w) for w in own] for ws, own in zip(t.words, t.own_anchors)], "array<array<int>>")
    pattern = "(?i)(?<![a-z0-9])(?:" + "|".join(t.anchors) + ")(?![a-z0-9])"

    def possible(words: Column) -> Column:
        # a cosine is at most the root of the squared weights of the words that are there
        sums = F.aggregate(F.array_intersect(words, vocabulary), F.array_repeat(F.lit(0.0), n), lambda acc, w: F.zip_with(acc, F.element_at(squares, w), lambda a, b: a + b))
        return F.filter(F.transform(sums, lambda x, i: F.when(x >= threshold**2 - 1e-6, i)), lambda i: i.isNotNull())

    def scored(window: Column, i: Column, start: Column) -> Column:
        def add(acc: Column, w: Column) -> Column:
            size = (1 + F.log(F.size(window) - F.size(F.array_remove(window, w)))) * F.coalesce(F.try_element_at(idf, w), F.lit(t.unseen))
            return let(size, lambda x: F.struct((acc["dot"] + x * F.coalesce(F.get(F.try_element_at(weights, w), i), F.lit(0.0))).alias("dot"), (acc["square"] + x * x).alias("square")))

        total = F.aggregate(F.array_distinct(window), F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("square")), add)
        return let(total, lambda x: F.struct(F.get(names, i).alias("license"), F.round(x["dot"] / F.sqrt(x["square"]), 9).alias("score"), i.alias("template"), start.alias("start"), (start + F.size(window)).alias("end")))

    def laid(words: Column, i: Column) -> Column:
        own = lambda w: F.array_position(F.get(anchors, i), w).cast("int")
        starts = F.array_distinct(F.filter(F.transform(words, lambda w, p: F.when(own(w) > 0, p - F.get(F.get(places, i), own(w) - 1))), lambda x: x.isNotNull()))
        return F.transform(starts, lambda at: let(F.slice(words, F.greatest(at, F.lit(0)) + 1, F.get(sizes, i) + F.least(at, F.lit(0))), lambda window: scored(window, i, F.greatest(at, F.lit(0)))))

    found = let(words_in(text), lambda words: F.flatten(F.transform(possible(words), lambda i: F.filter(laid(words, i), lambda x: x["score"] >= threshold))))
    none = F.array().cast("array<struct<license:string,score:double,template:int,start:int,end:int>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def covered(found: Column) -> Column:
    """struct<reach, words, n>: words that stand in matches, and runs of overlapping matches."""
    def add(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["reach"], x["end"]).alias("reach"), (acc["words"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["reach"]))).alias("words"), (acc["n"] + (x["start"] >= acc["reach"]).cast("int")).alias("n"))

    return F.aggregate(F.array_sort(F.transform(found, lambda x: F.struct(x["start"], x["end"]))), F.struct(*[F.lit(0).alias(c) for c in ("reach", "words", "n")]), add)


def scanned(files: DataFrame, templates: Templates | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(row, path, n_notices, is_license_file, dir, own_license, own_score) of files (path, text, ...); row has the other columns."""
    t = templates or Templates(TEXTS, threshold)
    text = F.coalesce("text", F.lit(""))
    path = F.coalesce("path", F.lit(""))
    wholes = _fixed(t.wholes, "array<array<int>>")
    others = [F.col(f"`{c}`") for c in files.columns if c not in ("path", "text")]
    files = files.select(F.struct(*others).alias("row") if others else F.lit(None).cast("struct<>").alias("row"), "path", "text")
    held = files.withColumn("_found", notices(text, t, threshold)).withColumn("_covered", covered(F.col("_found")))
    part = lambda x: F.exists("_found", lambda y: F.array_contains(F.get(wholes, x["template"]), y["template"]) & (y["start"] < x["end"]) & (x["start"] < y["end"]))
    # the best score, then the first name
    best = F.array_min(F.transform(F.filter("_found", lambda x: ~part(x)), lambda x: F.struct((-x["score"]).alias("less"), x["license"].alias("license"))))
    n_words = F.when(F.size("_found") > 0, F.size(words_in(text)))
    named = F.element_at(F.split(path, "/"), -1).rlike(LICENSE_FILE)
    is_file = (F.size("_found") > 0) & (named | (F.col("_covered.words") * 2 >= n_words))
    out = held.select(*[c for c in files.columns if c != "text"], best.alias("_best"), F.col("_covered.n").alias("n_notices"), is_file.alias("is_license_file"), F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("").alias("dir"))
    return out.select(*[c for c in out.columns if c != "_best"], F.col("_best.license").alias("own_license"), (-F.col("_best.less")).alias("own_score"))


def ancestors(path: Column) -> Column:
    """The directory and all above it up to the root, nearest first."""
    parts = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))
    return let(parts, lambda p: F.transform(F.sequence(F.size(p), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/")))


def inherited(found: DataFrame) -> DataFrame:
    """Rows of scanned() with license, origin (own, inherited or none) and licensed_dir."""
    rows = store.saved(found, "license-scan")
    held = rows.where("is_license_file").groupBy(F.col("dir").alias("licensed_dir")).agg(F.min(F.struct(-F.col("own_score"), "own_license")).alias("best"))
    held = store.saved(held.select("licensed_dir", F.col("best.own_license").alias("dir_license")), "license-dirs")
    up = rows.select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("steps", "licensed_dir"))
    nearest = up.join(held, "licensed_dir").groupBy("dir").agg(F.min(F.struct("steps", "licensed_dir", "dir_license")).alias("n"))
    nearest = store.saved(nearest.select("dir", "n.licensed_dir", "n.dir_license"), "license-nearest")
    out = rows.join(nearest, "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        *[c for c in rows.columns],
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(own, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("licensed_dir")).alias("licensed_dir"),
    )
