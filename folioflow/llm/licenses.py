"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

What is compared with the templates: every line that holds a licence cue; every block of
lines that holds one, blocks ending at blank lines, at lines of a comment mark alone, and
between comment and code, so a header wrapped over many lines is one; and whole licence
files.  Comment marks and line ends are no tokens, so wrapping changes nothing.  Each distinct
line, block or file is scored once however many files hold it, and is known by a 128-bit
hash while its tokens move.  The vocabulary is that of the templates, so document
frequencies, counted over all these candidates, are a table of fixed size; words outside it
lengthen a candidate's vector, each with the weight of a word never seen.  A whole licence
file near a whole-text template decides over its parts.  A file without a licence of its own
takes that of the licence file in the nearest directory above it, found by a join
on directory paths, each distinct directory asked once.

Native DataFrame operations only.  No text leaves the scan but cue lines, their blocks and
licence files.

Defined results
    null or empty text     no licence of its own; may inherit
    null path              no directory: never inherits nor gives
    null file id           a file like others, told apart by its path
    repeated rows          one result row each
    ties                   the higher similarity, then the later name
    very long texts        read whole; a licence file or block costs what it has tokens
    empty table            empty result
    clashing columns       ignored; only the named columns are read
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Parts that the files of one line are dealt to.
SALTS = 16

# Wording of licences.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GNU = """is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software
Foundation, either version {} of the License, or (at your option) any later version."""
_GNU_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {}
along with this program. If not, see http://www.gnu.org/licenses/."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""


def _gnu(name: str, title: str, version: str, dated: str) -> tuple[tuple[str, str], ...]:
    """What marks a licence of this family: a notice, its parts, and the title of the licence file."""
    notice, rest = _GNU.format(title, version), _GNU_REST.format(title, title)
    short = f"licensed under the GNU {title}, version {version}"
    return ((name, f"This program {notice}"), (name, f"{notice} {rest}"), (name, short), (name, f"This work is {short}"), (name, f"GNU {title} Version {version}, {dated}"))


#: Licence name and the wording that marks it.  Several templates may name one licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", _MIT),
    ("MIT", f"The MIT License Copyright (c) {_MIT} {_AS_IS}"),
    ("ISC", _ISC),
    ("ISC", f"ISC License Copyright (c) {_ISC} {_ISC_AS_IS}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"Copyright {_APACHE} {_APACHE_REST}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    *_gnu("GPL-2.0", "General Public License", "2", "June 1991"),
    *_gnu("GPL-3.0", "General Public License", "3", "29 June 2007"),
    *_gnu("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"),
    *_gnu("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"),
    *_gnu("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
    ("BSD-2-Clause", f"Copyright (c) All rights reserved. {_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", _BSD_NAME),
    ("BSD-3-Clause", f"Copyright (c) All rights reserved. {_BSD} {_BSD_NAME} {_BSD_AS_IS}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0 Creative Commons Attribution NonCommercial"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("Proprietary", "All rights reserved"),
)
#: A whole licence file at least this near to a template is judged as a whole.
WHOLE = 0.8

#: What a line or block must hold to be compared.
CUE = r"(?i)licen[sc]e|copyright|spdx|public domain|rights reserved|permission is hereby|permission to use|redistribution and use|redistribute it"
_MARK = r"(?://+|/\*+|#+|\*+/?|--+|;+|%+|<!--)"
#: What ends a block: a blank line, or one of a comment mark alone.
_BLANK, _BARE = r"\n[ \t\r]*\n", rf"\n[ \t\r]*{_MARK}?[ \t\r]*\n"
_COMMENT = rf"^[ \t]*{_MARK}"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)([-._][^/]*)?$"
_TOKEN = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"


def template_tokens(text: str) -> Counter:
    """As ``tokens`` counts a line; templates are plain ASCII."""
    return Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower()))


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(_TOKEN), F.lit(0))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, the root being ''."""
    parts = F.split(folder, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), up))


def inverse_frequency(lines: int, holding: int) -> float:
    return math.log((1 + lines) / (1 + holding)) + 1


def score_lines(lines: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``lines``: distinct ``line``, its ``key`` and its count ``n``.  Returns ``key``, ``license`` and ``similarity`` of the closest template."""
    spark = lines.sparkSession
    bags = [template_tokens(text) for _, text in templates]
    vocabulary = sorted(set().union(*bags))
    tf = lines.select("key", "n", F.explode(tokens(F.col("line"))).alias("token")).groupBy("key", "token").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    counted = tf.join(F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "token string")), "token").groupBy("token").agg(F.sum("n").alias("df")).collect()  # at most the vocabulary
    total = lines.agg(F.sum("n")).first()[0] or 0
    df = {r.token: r.df for r in counted}
    idf = {t: inverse_frequency(total, df.get(t, 0)) for t in vocabulary}
    norms = [math.sqrt(sum((c * idf[t]) ** 2 for t, c in bag.items())) for bag in bags]
    rows = [(t, idf[t], [bag[t] * idf[t] / norm for bag, norm in zip(bags, norms, strict=True)]) for t in vocabulary]
    weights = spark.createDataFrame(rows, "token string, idf double, w array<double>")
    unseen = F.lit(inverse_frequency(total, 0))
    weighed = tf.join(F.broadcast(weights), "token", "left").withColumn("x", F.col("tf") * F.coalesce("idf", unseen))
    sums = [F.sum(F.col("x") * F.coalesce(F.get("w", F.lit(i)), F.lit(0.0))).alias(f"d{i}") for i in range(len(bags))]
    scored = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *sums)
    best = F.array_max(F.array(*(F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 4).alias("similarity"), F.lit(name).alias("license")) for i, (name, _) in enumerate(templates))))
    return scored.select("key", best.alias("best")).select("key", "best.license", "best.similarity")


def _blocks(text: Column) -> Column:
    """Blocks of a text that hold a cue, and of those that mix comment and code the comment alone."""
    cut = F.array_distinct(F.concat(F.split(text, _BLANK), F.split(text, _BARE)))
    held = F.filter(cut, lambda x: x.contains("\n") & x.rlike(CUE))
    notes = F.transform(held, lambda x: F.array_join(F.filter(F.split(x, "\n"), lambda y: y.rlike(_COMMENT)), "\n"))
    return F.concat(held, F.filter(notes, lambda x: x.rlike(CUE)))


def scan_licenses(
    files: DataFrame, threshold: float = 0.6, id_col: str = "file_id", path_col: str = "path", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES
) -> DataFrame:
    """``id_col``, ``path``, ``license`` (null: none), ``via`` (``header``, ``directory`` or ``none``), ``similarity`` and ``from_dir``."""
    cues = F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))
    is_file = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    parts = F.when(F.col("text").rlike(CUE), F.concat(cues, _blocks(F.col("text")))).otherwise(F.array().cast("array<string>"))
    whole = F.when(is_file & (F.col("text") != ""), F.array("text")).otherwise(F.array().cast("array<string>"))
    found = F.when(F.col("text").rlike(CUE) | is_file, F.filter(F.array_distinct(F.concat(whole, parts)), lambda x: x != ""))
    # Texts are read once: what the scan leaves of a file is its path and its few lines with a cue.
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    rows = checkpointed(rows.select("id", "path", found.alias("lines"), is_file.alias("is_file")))
    # The whole of a licence file is its first candidate.
    held = rows.select("id", "path", F.posexplode("lines").alias("at", "line"), "is_file").withColumns({"key": F.unhex(F.md5("line")), "whole": F.col("is_file") & (F.col("at") == 0)})
    lines = held.groupBy("key").agg(F.count("*").alias("n"), F.first("line").alias("line"))
    scored = score_lines(lines, templates).where(F.col("similarity") >= threshold)
    # One line may stand in a great share of the files: both sides carry a salt, so its files meet it in many tasks.
    salted = held.select("id", "path", "key", "whole", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = scored.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    decides = F.col("whole") & (F.col("similarity") >= WHOLE)
    own = salted.join(copies, ["key", "salt"]).groupBy("id", "path").agg(F.max(F.struct(decides.alias("decides"), "similarity", "license")).alias("own"))
    named = rows.select("id", "path").withColumn("dir", directory(F.col("path")))
    given = own.where(F.col("path").rlike(LICENSE_FILE)).groupBy(directory(F.col("path")).alias("up")).agg(F.max("own").alias("gift"))
    folders = named.where("dir is not null").select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("depth", "up"))
    nearest = folders.join(given, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "gift")).alias("near"))
    out = named.alias("f").join(own.alias("o"), F.col("f.id").eqNullSafe(F.col("o.id")) & F.col("f.path").eqNullSafe(F.col("o.path")), "left").select("f.id", "f.path", "f.dir", "o.own")
    # So may one directory: it is asked once, and its answer meets its files under every salt.
    out = out.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    out = out.join(nearest.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["dir", "salt"], "left")
    take = F.coalesce(F.col("own"), F.col("near.gift"))
    return out.select(
        F.col("id").alias(id_col),
        "path",
        take["license"].alias("license"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("near").isNotNull(), "directory").otherwise("none").alias("via"),
        take["similarity"].alias("similarity"),
        F.when(F.col("own").isNull(), F.col("near.up")).alias("from_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """A tree for a ``documents`` table, which has no paths: short texts with a cue are the licence files of their directory."""
    short = (F.length("text") < 300) & F.col("text").rlike(CUE)
    name = F.when(short, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("f"), F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.concat(F.lit("m"), F.pmod(F.col("doc_id"), F.lit(7))), F.concat(F.lit("s"), F.pmod(F.col("doc_id"), F.lit(3))), name)
    return docs.select("doc_id", path.alias("path"), "text")
