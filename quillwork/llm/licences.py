"""Licence notices in texts, by Dice coefficient over word bigrams.

Every line, every paragraph (between two line ends in a row) and the whole text
of a document is a passage that may be a notice. A passage is normalised to
lower-case words without marks, and its set of word bigrams is compared with
those of the templates. Two sets of a and b bigrams can reach a coefficient t only
if t / (2 - t) <= a / b <= (2 - t) / t: a passage is given up as soon as it has more
bigrams than the largest template allows, and meets only templates whose size fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import slices, sql_type

THRESHOLD = 0.8

# Wording of licences and their usual notices.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def bigrams(text: str, most: float = float("inf")) -> set[tuple[str, str]] | None:
    """Word bigrams of the normalised text, a single word paired with nothing; null once there are more than ``most``."""
    out: set[tuple[str, str]] = set()
    last, found = None, _WORD.finditer(text.lower())
    while words := [m.group() for m in islice(found, 512)]:
        out.update(zip([last, *words] if last is not None else words, words if last is not None else words[1:]))
        if len(out) > most:
            return None
        last = words[-1]
    return out or ({(last, "")} if last is not None else out)


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def passages(text: str) -> list[tuple[int, int]]:
    """``(start, stop)`` of every line, every paragraph and the whole text, each stretch once."""
    spans = {(0, len(text))}
    for mark in ("\n", "\n\n"):
        at = 0
        for part in text.split(mark):
            spans.add((at, at + len(part)))
            at += len(part) + len(mark)
    return sorted(spans)


class Templates:
    def __init__(self, named: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.sets = [(name, bigrams(t)) for name, texts in named.items() for t in texts]
        sizes = [len(s) for _, s in self.sets]
        self.low, self.high = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold

    def best(self, text: str) -> tuple[str, float] | None:
        """Licence and coefficient of the closest template at or above the threshold; ties go to the smaller name."""
        own = bigrams(text, self.high)
        if own is None or len(own) < self.low:
            return None
        n, t = len(own), self.threshold
        found = [(-dice(own, other), name) for name, other in self.sets
                 if t * len(other) <= (2 - t) * n and t * n <= (2 - t) * len(other)]
        score, name = min(found, default=(0.0, ""))
        return (name, -score) if -score >= t else None


def _task(named: dict[str, list[str]], threshold: float):
    hit = pa.list_(pa.struct([("licence", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(named, threshold)
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                found = []
                for start, stop in passages(text) if text else ():
                    best = templates.best(text[start:stop])
                    if best:
                        found.append({"licence": best[0], "score": best[1], "start": start, "stop": stop})
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, hit)], ["id", "hits"])
    return run


def find_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                  templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Per row of ``docs``: ``id_col`` and ``hits``, the passages at or above ``threshold`` in order of their place, each
    with its closest licence, score and character range.

    Null and blank texts have no hits. Repeated rows each come back. Other columns are not looked at. An empty table
    gives an empty result. There is no shuffle; the templates travel with the task.
    """
    kind = sql_type(docs, id_col)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        _task(templates or TEMPLATES, threshold),
        f"id {kind}, hits array<struct<licence: string, score: double, start: bigint, stop: bigint>>").withColumnRenamed("id", id_col)
