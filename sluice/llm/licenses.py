"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor inheritance.

Units of a file are its headers, that is each line and each run of up to 32 joined lines (lines without terms, such as
empty comment lines, are passed over), and its whole text (licence files). Terms are lower-case runs of letters, digits
and . + -, so comment marks fall away; term weights are (1 + ln tf) * idf with idf = ln((files + 1) / (df + 1)) + 1, where
df counts the files of the whole table that hold the term; terms outside the templates weigh as unseen. Templates are
short statements, customary notices and whole licence texts; headers are compared with all but the long texts. A unit
matches the template of the highest cosine if that is at least `threshold`. A file is searched only for templates whose
terms that it holds weigh enough to reach the threshold (by the Cauchy-Schwarz inequality), and only around lines with a
key term: the other terms of a template, together, are too light to reach the threshold, so no match is lost.

An SPDX tag is read as it stands and declares its licence with cosine 1; identifiers without a template keep their text.
Otherwise a file whose whole text matches a licence text declares that licence, any other file that of its best unit.
A file whose whole text matches, or that is named like a licence file and declares a licence, is a licence file and covers
its directory. A file that declares nothing takes the licence of its nearest ancestor directory that is covered, by an
equi-join of its ancestor paths with the covered directories.

Defined cases: null texts are empty and declare nothing; a null path is a file at the root; ties in cosine go to the first
template name, ties in a directory to the higher cosine, then to the name; repeated rows give one row each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_dir

#: Short public licence statements.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
GNU = "This {0} is free software{4} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
GNU_REST = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General Public License along with this {0}. If not, see {3}."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
#: Customary notices: (licence, text).
NOTICES = [
    ("Apache-2.0", APACHE),
    ("Apache-2.0", APACHE + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Distributed under the MIT software license, see the accompanying file COPYING or http://www.opensource.org/licenses/mit-license.php."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *((f"CC-{k}-4.0", f"This work is licensed under {a} Creative Commons {w} 4.0 International License.") for k, w in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for a in ("a", "the")),
    *((name, GNU.format(what, kind, version, "", ":") + rest.format(what, kind, version, "http://www.gnu.org/licenses/")) for name, kind, version, what in (("GPL-2.0", "", "2", "program"), ("GPL-3.0", "", "3", "program"), ("LGPL-2.1", "Lesser ", "2.1", "library"), ("LGPL-3.0", "Lesser ", "3", "program"), ("AGPL-3.0", "Affero ", "3", "program")) for rest in ("", GNU_REST)),
    *((name, f"GNU {kind}GENERAL PUBLIC LICENSE Version {version}, {date}") for name, kind, version, date in (("GPL-2.0", "", "2", "June 1991"), ("GPL-3.0", "", "3", "29 June 2007"), ("LGPL-2.1", "LESSER ", "2.1", "February 1999"), ("LGPL-3.0", "LESSER ", "3", "29 June 2007"), ("AGPL-3.0", "AFFERO ", "3", "19 November 2007"))),
]
#: Licences with a whole text in license_texts.
TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
LONG = 400  # terms; longer texts are no headers
JOINED = 32  # lines
SPDX = re.compile(r"spdx-license-identifier:[ \t]*(\(*[a-z0-9][a-z0-9.+-]*\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9][a-z0-9.+-]*\)*)*)", re.I)
TERM = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def all_templates() -> dict[str, str]:
    """Statements, notices and whole texts by label: the licence, then '#' and a number, or '#text'."""
    out = {f"{name}#0": text for name, text in TEMPLATES.items()} | {f"{name}#{i}": text for i, (name, text) in enumerate(NOTICES, 1)}
    return out | {f"{name}#text": pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in TEXTS}


def spdx(low: str, text: str, known: dict[str, str]) -> str | None:
    """The licence expression of the first SPDX tag."""
    at = SPDX.search(text) if "spdx-license-identifier:" in low else None
    if not at:
        return None
    words = []
    for w in at[1].split():
        bare = re.sub(r"(-only|-or-later|\+)$", "", w.strip("()").lower())
        words.append(w.upper() if w.lower() in ("and", "or", "with") else w.replace(w.strip("()"), known.get(bare, w.strip("()"))))
    return " ".join(words).strip("()") if len(words) == 1 else " ".join(words)


class Model:
    """Template vectors over idf weights; its size is that of the templates."""

    def __init__(self, df: dict[str, int], files: int, threshold: float, templates: dict[str, str] = TEMPLATES):
        self.idf, self.unseen, self.threshold = {}, log(files + 1) + 1, threshold
        self.vectors: dict[str, dict[str, float]] = {}
        heavy: list[set[str]] = []
        for name, text in sorted(templates.items()):
            tf = Counter(terms(text))
            for t in tf:
                self.idf[t] = log((files + 1) / (df.get(t, 0) + 1)) + 1
            v = {t: (1 + log(n)) * self.idf[t] for t, n in tf.items()}
            norm = sqrt(sum(x * x for x in v.values()))
            self.vectors[name] = {t: x / norm for t, x in v.items()}
            light, keys = 0.0, set()
            for t, x in sorted(self.vectors[name].items(), key=lambda p: (p[1], p[0])):
                light += x * x
                if sqrt(light) >= threshold - 1e-9:
                    keys.add(t)
            heavy.append(keys)
        self.heavy, self.names = heavy, list(self.vectors)
        self.key = re.compile("|".join(map(re.escape, sorted(set().union(*heavy), key=len, reverse=True))) or r"(?!)")
        self.place = {t: i for i, t in enumerate(self.idf)}
        self.terms = frozenset(self.place)
        self.mass = np.zeros((len(self.place), len(self.names)))  # squared weights
        for k, v in enumerate(self.vectors.values()):
            for t, x in v.items():
                self.mass[self.place[t], k] = x * x
        self.header = [sum(Counter(terms(text)).values()) <= LONG for _, text in sorted(templates.items())]
        self.known = {n.split("#")[0].lower(): n.split("#")[0] for n in self.names}

    def match(self, text: str) -> tuple[float, str] | None:
        tf = Counter(terms(text))
        if not tf:
            return None
        v = {t: (1 + log(n)) * self.idf.get(t, self.unseen) for t, n in tf.items()}
        norm = sqrt(sum(x * x for x in v.values()))
        cosine, name = min((-sum(v[t] * x for t, x in w.items() if t in v) / norm, name) for name, w in self.vectors.items())
        return (-cosine, name) if -cosine >= self.threshold else None

    def headers(self, low: str, tf: Counter, names: list[int]) -> list[tuple[float, str]]:
        """Matches of lines and joined lines with the given templates."""
        lines = [x for line in low.split("\n") if (x := terms(line))]
        keys = frozenset().union(*(self.heavy[k] for k in names))
        anchors = np.array([not keys.isdisjoint(x) for x in lines])
        # the weight of a unit can't pass that of a template's terms in the whole file, over the threshold
        most = max(sum(((1 + log(tf[t])) * self.idf[t]) ** 2 for t in self.vectors[self.names[k]] if t in tf) for k in names) / self.threshold**2 * (1 + 1e-9)
        some = [(k, self.vectors[self.names[k]]) for k in names]
        best: dict[int, float] = {}
        after = np.concatenate([[0], np.cumsum(anchors)])
        for start in range(len(lines)):
            if after[min(start + JOINED, len(lines))] == after[start]:
                continue
            count: dict[str, int] = {}
            norm, dot, anchored = 0.0, [0.0] * len(some), False
            for at in range(start, min(start + JOINED, len(lines))):
                for t in lines[at]:
                    n = count[t] = count.get(t, 0) + 1
                    idf = self.idf.get(t, self.unseen)
                    new, old = 1 + log(n), 1 + log(n - 1) if n > 1 else 0.0
                    norm += idf * idf * (new * new - old * old)
                    if t in self.terms:
                        for i, (_, w) in enumerate(some):
                            if t in w:
                                dot[i] += w[t] * idf * (new - old)
                if norm > most:
                    break
                anchored = anchored or anchors[at]
                if anchored:
                    for i, (k, _) in enumerate(some):
                        if dot[i] > best.get(k, 0.0) * sqrt(norm):
                            best[k] = dot[i] / sqrt(norm)
        return [(round(c, 12), self.names[k].split("#")[0]) for k, c in best.items() if c >= self.threshold - 1e-12]

    def scan(self, text: str) -> tuple[str | None, float | None, bool]:
        """(licence declared, its cosine, whether the whole text is a licence)."""
        low = text.lower()
        words = terms(low)
        held = [self.place[t] for t in self.terms.intersection(words)]
        tag = spdx(low, text, self.known)
        if not held:
            return (tag, 1.0, False) if tag else (None, None, False)
        names = np.flatnonzero(self.mass[held].sum(axis=0) >= self.threshold**2 - 1e-9).tolist()
        if not names:
            return (tag, 1.0, False) if tag else (None, None, False)
        tf = Counter(words)
        norm = sqrt(sum(((1 + log(n)) * self.idf.get(t, self.unseen)) ** 2 for t, n in tf.items()))
        cosine = lambda k: round(sum((1 + log(tf[t])) * self.idf[t] * x for t, x in self.vectors[self.names[k]].items() if t in tf) / norm, 12)
        whole = [(c, self.names[k]) for k in names if (c := cosine(k)) >= self.threshold]
        texts = [(c, n.split("#")[0]) for c, n in whole if n.endswith("#text")]
        if tag:
            return tag, 1.0, bool(whole)
        heads = [k for k in names if self.header[k]]
        got = texts or [(c, n.split("#")[0]) for c, n in whole] + (self.headers(low, tf, heads) if heads else [])
        if not got:
            return None, None, False
        c, name = min(got, key=lambda m: (-m[0], m[1]))
        return name, c, bool(whole)


def document_frequency(files: DataFrame) -> dict[str, int]:
    """Files that hold each template term; at most as many rows as the templates have terms."""
    vocabulary = frozenset(t for text in all_templates().values() for t in terms(text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                total.update(vocabulary.intersection(terms(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "df"])

    rows = files.select("text").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}


def scan_licenses(files: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, path, declared, cosine, is_license_file, license, inherited_from) of files(doc_id, path, text)."""
    clean = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    model = Model(document_frequency(clean), clean.count(), threshold, all_templates())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.scan(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "path", "declared", "cosine", "whole"])

    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    name = F.regexp_extract("path", "[^/]*$", 0)
    found = clean.mapInArrow(scan, "doc_id long, path string, declared string, cosine double, whole boolean")
    scratch = scratch_dir(files.sparkSession)
    found = materialise(found, scratch, "found")  # read three times below
    found = found.withColumn("is_license_file", F.col("whole") | (F.col("declared").isNotNull() & name.rlike(LICENSE_NAME))).withColumn("dir", folder).drop("whole")
    covered = found.where("is_license_file").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "declared")).alias("best")).select("dir", F.col("best.declared").alias("inherited"))
    # the ancestors of each directory once: 'a/b' is below 'a/b', 'a' and ''
    dirs = found.where(F.col("declared").isNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("up")))).alias("a"))
    nearest = above.select("dir", "a.depth", F.col("a.up").alias("up")).join(covered.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "inherited")).alias("n")).select("dir", F.col("n.up").alias("inherited_from"), F.col("n.inherited").alias("inherited"))
    # written first, so that both sides of the join are plain exchanges and the files of a hot directory can be split
    out = found.join(materialise(nearest, scratch, "nearest"), "dir", "left")
    own = F.col("declared").isNotNull()
    return out.select("doc_id", "path", "declared", "cosine", "is_license_file", F.coalesce("declared", "inherited").alias("license"), F.when(~own, F.col("inherited_from")).alias("inherited_from"))
