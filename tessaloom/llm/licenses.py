"""License scans by conditional compression.

Templates are licenses: their usual notices, and for most the whole text (folder templates).
Words are runs of letters and digits, so line breaks, comment marks and punctuation don't matter.

1. Every notice names words that must all stand in it (its mark); the first is its anchor.
   Around the anchors in a text, candidate blocks of up to 2 * REACH + JOIN words are cut. Blocks
   overlap so that whatever a notice may match around an anchor lies in one of them whole.
2. A block that holds some notice's mark is compressed alone and with each template as zstandard
   raw dictionary. Templates are ranked by the bytes saved; those that save MIN_SAVED are winners.
3. Winners are confirmed, in that order, by exact wording: around an anchor, the notice's words
   must occur in order, at most a quarter of them missing, the mark among them, within twice the
   notice's length, and no word that makes another license of it. What is missing and what is
   added is reported.
4. Of confirmed stretches that overlap, the one with most words (less differences) stays; ties go
   to the greater saving, then by name.

Result, one row per row: doc_id, n_licenses (distinct), licenses (ids, sorted, comma-joined),
spans (id:start:end of the wordings in code points, by start), n_differences, and differences
(per span, in the same order, joined by ";": "-" and missing words, "+" and added words, in
order). Null and empty texts have none; an empty table gives no rows. Rows are independent:
repeated ids, null ids and repeated rows each give their row; other columns aren't read. Texts of
any length are scanned whole, in memory that follows the text. Nothing is shuffled.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .runtime import arrow_map

MIN_SAVED = 4
MIN_WORDS_SHARE = 0.75
LONGEST = 64
REACH = LONGEST + LONGEST // 2
JOIN = 32
LEVEL = 6

#: Usual notices of well-known licenses and, after the bar, their marks.
NOTICES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.|affero gnu 3",
        "Licensed under the GNU Affero General Public License, version 3.|affero gnu 3",
        "SPDX-License-Identifier: AGPL-3.0-only|spdx agpl 3",
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.|apache 2 0 compliance',
        "Licensed under the Apache License, Version 2.0.|apache 2 0",
        "Apache License Version 2.0, January 2004|apache 2 0 2004",
        "SPDX-License-Identifier: Apache-2.0|spdx apache 2",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.|bsd 2 clause", "SPDX-License-Identifier: BSD-2-Clause|spdx bsd 2"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:|redistribution binary forms",
        "Released under the BSD 3-Clause License.|bsd 3 clause",
        "SPDX-License-Identifier: BSD-3-Clause|spdx bsd 3",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.|cc by 4", "This work is licensed under a Creative Commons Attribution 4.0 International License.|commons attribution 4 international", "SPDX-License-Identifier: CC-BY-4.0|spdx cc by 4"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.|cc by nc 4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.|commons noncommercial 4 international"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.|cc by sa 4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.|commons sharealike 4 international"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.|cc0 1", "SPDX-License-Identifier: CC0-1.0|spdx cc0"],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.|gnu general 2",
        "This work is licensed under the GNU General Public License, version 2.|gnu general 2",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991|gnu general 2 1991",
        "SPDX-License-Identifier: GPL-2.0-only|spdx gpl 2",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.|gnu general 3",
        "This work is licensed under the GNU General Public License, version 3.|gnu general 3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007|gnu general 3 2007",
        "SPDX-License-Identifier: GPL-3.0-only|spdx gpl 3",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted|permission fee granted", "Released under the ISC License.|license isc", "SPDX-License-Identifier: ISC|spdx isc"],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.|lesser gnu 2 1",
        "Licensed under the GNU Lesser General Public License, version 2.1.|lesser gnu 2 1",
        "SPDX-License-Identifier: LGPL-2.1-only|spdx lgpl 2",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.|lesser gnu 3",
        "This work is licensed under the GNU Lesser General Public License, version 3.|lesser gnu 3",
        "SPDX-License-Identifier: LGPL-3.0-only|spdx lgpl 3",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.|permission granted charge software",
        "Released under the MIT License.|license mit",
        "SPDX-License-Identifier: MIT|spdx mit",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.|mozilla public 2", "Mozilla Public License Version 2.0|mozilla public 2", "SPDX-License-Identifier: MPL-2.0|spdx mpl 2"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.|unencumbered software domain"],
}
#: Words that make another license of the notice they stand in.
CONTRARY = {"CC-BY-4.0": {"nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives"}, "CC-BY-NC-4.0": {"sa", "nd", "sharealike", "noderivatives"}, "CC-BY-SA-4.0": {"nc", "noncommercial"}, "GPL-3.0": {"lesser", "affero", "library"}, "GPL-2.0": {"lesser", "affero"}, "Apache-2.0": {"llvm"}}
_WORD = re.compile(r"[^\W_]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Notice:
    def __init__(self, name: str, text: str):
        wording, _, mark = text.partition("|")
        self.name, self.words, marks = name, _words(wording), mark.split()
        self.anchor, self.mark = marks[0], frozenset(marks)
        self.before = self.words.index(self.anchor)  # words before the anchor
        assert self.mark <= set(self.words) and len(self.words) <= LONGEST

    def around(self, at: int) -> tuple[int, int]:
        """What may hold the notice if its anchor is word ``at``."""
        more = len(self.words) // 2
        return max(0, at - self.before - more), at - self.before + len(self.words) + more

    def confirm(self, words: list[str], at: int) -> tuple[int, int, list[str], list[str]] | None:
        """First and last word (exclusive) of the wording around the anchor, what it misses and
        what it adds."""
        lo, hi = self.around(at)
        have = words[lo:hi]
        if not self.mark <= set(have):
            return None
        blocks = [m for m in SequenceMatcher(None, self.words, have, autojunk=False).get_matching_blocks() if m.size]
        found = sum(m.size for m in blocks)
        if found < MIN_WORDS_SHARE * len(self.words):
            return None
        a, b = blocks[0].b, blocks[-1].b + blocks[-1].size
        kept = {x for m in blocks for x in self.words[m.a : m.a + m.size]}
        if b - a > 2 * len(self.words) or not self.mark <= kept or CONTRARY.get(self.name, set()) & set(have[a:b]):
            return None
        missing, added, i, j = [], [], 0, a
        for m in blocks:
            missing += self.words[i : m.a]
            added += have[j : m.b]
            i, j = m.a + m.size, m.b + m.size
        return lo + a, lo + b, missing + self.words[i:], added


@lru_cache(1)
def templates() -> tuple[dict[str, list[Notice]], re.Pattern, object, dict[str, object]]:
    """Notices by anchor, the anchors' pattern, and compressors without and with dictionaries."""
    import zstandard as z

    def compressor(dictionary=None):
        return z.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)

    by_anchor: dict[str, list[Notice]] = {}
    made, folder = {}, resources.files(__package__) / "templates"
    for name, notices in NOTICES.items():
        whole = folder / f"{name}.txt"
        text = (whole.read_text(encoding="utf-8") if whole.is_file() else "") + "\n" + "\n".join(n.partition("|")[0] for n in notices)
        dictionary = z.ZstdCompressionDict(" ".join(text.split()).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        made[name] = compressor(dictionary)
        for n in notices:
            notice = Notice(name, n)
            by_anchor.setdefault(notice.anchor, []).append(notice)
    anchors = re.compile(rf"(?<![^\W_])(?:{'|'.join(sorted(by_anchor))})(?![^\W_])", re.I)
    return by_anchor, anchors, compressor(), made


def saved(block: str) -> dict[str, int]:
    """Bytes that each template saves of the block, greatest first; ties by name."""
    _, _, plain, made = templates()
    data = " ".join(block.split()).encode("utf-8", "replace")
    alone = len(plain.compress(data))
    return dict(sorted(((name, alone - len(c.compress(data))) for name, c in made.items()), key=lambda x: (-x[1], x[0])))


def blocks(anchors: list[int], n: int) -> list[tuple[int, int, list[int]]]:
    """Stretches of words and the anchors at whose surroundings they are to be looked at."""
    out, i = [], 0
    while i < len(anchors):
        first, held = anchors[i], []
        while i < len(anchors) and anchors[i] <= first + JOIN:
            held.append(anchors[i])
            i += 1
        out.append((max(0, first - REACH), min(n, held[-1] + REACH), held))
    return out


Found = tuple[int, int, str, list[str], list[str]]


def scan(text: str | None) -> list[Found]:
    """(start, end, license, missing words, added words), by start."""
    by_anchor, pattern, _, _ = templates()
    if not text or not pattern.search(text):
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    confirmed = []
    for lo, hi, held in blocks([i for i, w in enumerate(words) if w in by_anchor], len(words)):
        present = set(words[lo:hi])
        tried = [(at, n) for at in held for n in by_anchor[words[at]] if n.mark <= present]
        if not tried:
            continue
        for name, saving in saved(text[places[lo][0] : places[hi - 1][1]]).items():
            if saving < MIN_SAVED:
                break
            for at, n in tried:
                if n.name == name and (hit := n.confirm(words, at)):
                    confirmed.append((hit[0] - hit[1] + 2 * (len(hit[2]) + len(hit[3])), -saving, name, hit))
    out, taken = [], []
    for _, _, name, (a, b, missing, added) in sorted(confirmed):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((places[a][0], places[b - 1][1], name, missing, added))
    return sorted(out)


def _shown(missing: list[str], added: list[str]) -> str:
    return "".join(sign + " ".join(words) for sign, words in (("-", missing), ("+", added)) if words)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("n_licenses", LongType()), StructField("licenses", StringType()), StructField("spans", StringType()), StructField("n_differences", LongType()), StructField("differences", StringType())])

    def run(c: dict) -> dict:
        found = [scan(t) for t in c["t"]]
        names = [sorted({x[2] for x in f}) for f in found]
        return {
            "doc_id": c["d"],
            "n_licenses": list(map(len, names)),
            "licenses": list(map(",".join, names)),
            "spans": [",".join(f"{n}:{a}:{b}" for a, b, n, _, _ in f) for f in found],
            "n_differences": [sum(len(m) + len(p) for *_, m, p in f) for f in found],
            "differences": [";".join(_shown(m, p) for *_, m, p in f) for f in found],
        }

    return arrow_map(docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")), run, schema)
