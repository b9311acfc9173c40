"""License scans: sparse TF-IDF cosine of passages to templates, then inheritance from the nearest ancestor directory.

Passages are the lines, the paragraphs (lines with words in a row, so that any form of blank line and comment marks part them),
windows of some lengths and the whole of a text. So one-line and wrapped headers, notices inside longer passages and licence
files all meet their template. Document frequencies are counted over all documents, those of template words each by
itself and all others by SLOTS hash slots, which bounds what is gathered. A file whose licence passages
make up ``file_share`` of its words is a licence file, and speaks for its directory and all below that
have no nearer one. Directories are resolved as directories, by joins on paths, before any document is joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from wavemill.llm import _text
from wavemill.llm._store import materialise

#: Public licence notices, openings and, of short licences, whole texts, by SPDX id. read_templates() takes others.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
THRESHOLD, FILE_SHARE = 0.7, 0.1
#: Lengths of windows of words, each moved on by half of it; slots of document frequencies; directories that may be broadcast.
WINDOWS, SLOTS, BROADCAST_DIRS = (16, 64, 256), 1 << 20, 20_000
#: Words are runs of letters, digits, inner dots and hyphens' parts: all bytes but blanks and most marks part nothing.
PARTS = _text.BLANK.copy()
PARTS[[ord(c) for c in "!\"#$%&'()*+,-/:;<=>?@[\\]^`{|}~"]] = True


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start) of words; dots at a word's end are no part of it."""
    s, e, row = _text.words(buf, offsets, PARTS)
    while len(e) and (dot := (buf[e - 1] == 46) & (e > s)).any():
        e = e - dot
        keep = e > s
        s, e, row = s[keep], e[keep], row[keep]
    return _text.spans(_text.prefix(buf), s, e), row, s


class Index:
    """Template vocabulary: sorted word hashes, and a term-frequency matrix (words, templates)."""

    def __init__(self, templates):
        raw = [t.encode() for _, t in templates]
        buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        h, row, _ = _words(buf, offsets)
        self.names = [n for n, _ in templates]
        self.words, at = np.unique(h, return_inverse=True)
        self.tf = np.zeros((len(self.words), len(templates)))
        np.add.at(self.tf, (at, row), 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, index: Index) -> tuple[np.ndarray, np.ndarray, int]:
    """For each template word, and for each slot of the other words, the number of (row, word) of docs (text); and the number of rows."""
    own = len(index.words)

    def run(batches):
        total = np.zeros(own + SLOTS + 1, np.int64)
        for batch in batches:
            for lo, hi, buf, offsets in _text.chunks(batch.column(0)):
                h, row, _ = _words(buf, offsets)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                h = h[np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))] if len(h) else h
                at = index.find(h)
                total += np.bincount(np.where(at >= 0, at, own + _slot(h)), minlength=len(total))
                total[-1] += hi - lo
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    sums = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows and few more, at most
    out = np.zeros(own + SLOTS + 1, np.int64)
    out[sums.column("word").to_numpy()] = sums.column("n").to_numpy()
    return out[:own], out[own:-1], int(out[-1])


def read_templates(spark, path: str) -> list[tuple[str, str]]:
    """(name, text) of the files of a folder, each named by its licence; a bounded set that the caller chooses."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1).alias("name"), "value").collect()
    return sorted((r["name"], r["value"]) for r in rows)


def _best(index: Index, idf: np.ndarray, others: np.ndarray, h: np.ndarray, segment: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(template, cosine) of the template nearest to each of n segments; -1 where no word is shared."""
    order = np.lexsort((h, segment))
    hs, ss = h[order], segment[order]
    fresh = np.flatnonzero(np.append(True, (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1]))) if len(hs) else np.zeros(0, np.int64)
    tf, at, seg = np.diff(np.append(fresh, len(hs))), index.find(hs[fresh]), ss[fresh]
    weight = tf * np.where(at >= 0, idf[at], others[_slot(hs[fresh])])
    norm = np.sqrt(np.bincount(seg, weight * weight, n))
    side = index.tf * idf[:, None]
    side = side / np.sqrt((side * side).sum(0))
    on = at >= 0
    cos = np.stack([np.bincount(seg[on], weight[on] * side[at[on], t], n) for t in range(side.shape[1])], 1) / np.maximum(norm, 1e-12)[:, None]
    top = cos.argmax(1)
    best = cos[np.arange(n), top]
    return np.where(best > 0, top, -1), best


def own_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, license, similarity, share) of docs (id, path, text): the best passage's licence at ``threshold`` or more, and the share of words in such passages."""
    index = Index(templates)
    df, rest, total = document_frequencies(docs, index)
    weigh = lambda n: np.maximum(np.log((1 + total) / (1 + n)), 0) + 0.1
    idf, shared = weigh(df), docs.sparkSession.sparkContext.broadcast(weigh(rest).astype(np.float32))  # SLOTS numbers

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in _text.chunks(batch.column("text"), 2 << 20):
                n = hi - lo
                h, row, start = _words(buf, offsets)
                count = np.bincount(row, minlength=n)
                best, which, covered = np.zeros(n), np.full(n, -1), np.zeros(n)
                line = np.cumsum(buf == 10)[start] if len(start) else np.zeros(0, np.int64)
                place = np.arange(len(row)) - (np.cumsum(count) - count)[row] if len(row) else line
                apart = np.append(0, np.cumsum(line[1:] - line[:-1] > 1)) if len(line) else line  # a line without words lies between
                cuts = [(line, 0), (apart, 0), (np.zeros(len(start), np.int64), 0)]
                cuts += [(np.where(place >= skip, (place - skip) // size + 1, 0), size) for size in WINDOWS for skip in (0, size // 2)]
                for piece, size in cuts:
                    if size and not (count > size).any():
                        continue  # as the whole
                    _, segment = np.unique(row * (len(buf) + 2) + piece, return_inverse=True)
                    m = int(segment.max(initial=-1)) + 1
                    home = np.zeros(m, np.int64)
                    home[segment] = row
                    t, cos = _best(index, idf, shared.value, h, segment, m)
                    good = np.flatnonzero(cos >= threshold)
                    for g in good[np.lexsort((t[good], -cos[good]))].tolist():  # the passages that are licences
                        if cos[g] > best[home[g]] + 1e-12:
                            best[home[g]], which[home[g]] = cos[g], t[g]
                    words = np.bincount(segment, minlength=m)
                    covered = np.maximum(covered, np.bincount(home[good], words[good], n))
                names = [index.names[w] if w >= 0 else None for w in which.tolist()]
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("path"), pa.array(names, pa.string()), pa.array(best), pa.array(covered / np.maximum(count, 1))], ["id", "path", "license", "similarity", "share"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "path", "text").mapInArrow(run, f"id {kind}, path string, license string, similarity double, share double")


def scan(docs: DataFrame, doc_id: str = "doc_id", path: str = "path", text: str = "text", *, templates=TEMPLATES, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """(id, path, own_license, similarity, is_license_file, license, inherited_from) for each row of docs.

    A file's licence is its own, or else that of the nearest ancestor directory with a licence file;
    among several there, the most similar one counts, then the licence's name. Paths are parted by
    slashes; a file's directory is what stands before the last. Null and empty texts have none of
    their own; a null path lies in the root. Repeated rows give a row each; other columns are ignored.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(text).alias("text"))
    own = materialise(own_licenses(base, templates, threshold).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")).withColumn("is_license_file", F.col("license").isNotNull() & (F.col("share") >= file_share)), "licenses")
    ranked = own.where("is_license_file").groupBy("dir").agg(F.min(F.struct((-F.round("similarity", 9)).alias("s"), "license")).alias("best")).select("dir", F.col("best.license").alias("license"))
    dirs = own.select("dir").distinct()
    depth = F.size(F.split("dir", "/"))
    above = dirs.withColumn("ancestor", F.explode(F.concat(F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/")), F.array(F.lit("")))))
    near = Window.partitionBy("dir").orderBy(F.length("ancestor").desc())
    resolved = above.distinct().join(ranked.withColumnRenamed("dir", "ancestor"), "ancestor").withColumn("rank", F.row_number().over(near)).where("rank = 1").select("dir", F.col("license").alias("up"), F.col("ancestor").alias("from"))
    resolved = materialise(resolved, "directories")
    small = resolved.count() <= BROADCAST_DIRS  # else a join by shuffle
    out = own.join(F.broadcast(resolved) if small else resolved, "dir", "left")
    return out.select(
        "id", "path", F.col("license").alias("own_license"), F.round("similarity", 6).alias("similarity"), "is_license_file",
        F.coalesce("license", "up").alias("license"), F.when(F.col("license").isNull(), F.col("from")).alias("inherited_from"),
    )
