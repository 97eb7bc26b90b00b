"""License scans: ordered signature rules behind a keyword prefilter; priority and containment settle overlapping detections."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded, tidied
from .text import ALNUM, LOWER, buffer_of, slices, words_of

#: Phrases that are reported wherever they stand, whatever the rules find.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, weight, patterns over lower-case words joined by single blanks; earlier rules come before later ones.
RULES: tuple[tuple[str, float, tuple[str, ...]], ...] = (
    ("agpl", 1.0, (
        r"gnu affero general public license(?: version)?(?: [0-9]+){0,2}", r"affero general public license", r"affero gpl", r"agpl ?v?[123](?: 0)?(?: only| or later)?",
        r"spdx license identifier agpl [0-9] [0-9](?: only| or later)?", r"licensed under the agpl", r"under the terms of the gnu affero general public license", r"gnu agpl(?: v?[0-9])?",
    )),
    ("lgpl", 1.0, (
        r"gnu lesser general public license(?: version)?(?: [0-9]+){0,2}", r"gnu library general public license(?: version)?(?: [0-9]+){0,2}", r"lesser general public license", r"library general public license",
        r"lgpl ?v?[23](?: [01])?(?: only| or later)?", r"spdx license identifier lgpl [0-9] [0-9](?: only| or later)?", r"licensed under the lgpl", r"gnu lgpl(?: v?[0-9])?", r"under the terms of the gnu lesser general public license",
        r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license", r"lesser gpl",
    )),
    ("gpl", 1.0, (
        r"gnu general public license(?: version)?(?: [0-9]+){0,2}", r"general public license version [123]", r"gpl ?v?[123](?: 0)?(?: only| or later)?", r"spdx license identifier gpl [0-9] [0-9](?: only| or later)?",
        r"licensed under the gpl", r"released under the gpl", r"distributed under the gpl", r"gnu gpl(?: v?[0-9])?", r"under the terms of the gnu general public license as published by the free software foundation",
        r"either version [123] of the license or at your option any later version", r"you should have received a copy of the gnu general public license", r"see the gnu general public license for more details",
        r"the gpl license", r"gpl licensed", r"this program is free software you can redistribute it and or modify it", r"gpl compatible license", r"gplv[123]\+?", r"copyleft license",
        r"general public license v[123]", r"published under the gnu general public license",
    )),
    ("apache", 1.0, (
        r"apache license version 2 0", r"apache license version 1 [01]", r"apache license 2 0", r"apache license v2(?: 0)?", r"apache software license(?: version)?(?: [0-9] [0-9])?", r"apache public license(?: [0-9] [0-9])?",
        r"spdx license identifier apache [0-9] [0-9]", r"licensed under the apache license", r"licensed to the apache software foundation asf", r"asf licenses this file to you under the apache license",
        r"www apache org licenses license 2 0", r"apache org licenses", r"apache 2 0 license", r"apache 2 license", r"apache 2 licensed", r"asl 2 0", r"released under the apache license", r"terms and conditions of the apache license",
        r"distributed under the apache license", r"under the apache 2 0", r"you may not use this file except in compliance with the license", r"contributor license agreements see the notice file",
    )),
    ("mit", 1.0, (
        r"(?:the )?mit license(?: mit)?", r"expat license", r"spdx license identifier mit", r"licensed under the mit(?: license)?", r"released under the mit(?: license)?", r"distributed under the mit(?: license)?", r"mit licensed",
        r"x11 license", r"mit x11(?: license)?", r"opensource org licenses mit", r"under the terms of the mit license",
        r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", r"mit style license", r"mit no attribution", r"mit 0 license", r"license mit",
    )),
    ("bsd-4-clause", 0.95, (r"bsd 4 clause(?: license)?", r"four clause bsd(?: license)?", r"original bsd license", r"all advertising materials mentioning features or use of this software must display the following acknowledg?ement", r"spdx license identifier bsd 4 clause")),
    ("bsd-3-clause", 0.95, (
        r"bsd 3 clause(?: new or revised)?(?: license)?", r"3 clause bsd(?: license)?", r"three clause bsd(?: license)?", r"new bsd license", r"modified bsd license", r"revised bsd license", r"spdx license identifier bsd 3 clause",
        r"may be used to endorse or promote products derived from this software without specific prior written permission",
    )),
    ("bsd-2-clause", 0.95, (r"bsd 2 clause(?: simplified)?(?: license)?", r"2 clause bsd(?: license)?", r"two clause bsd(?: license)?", r"simplified bsd license", r"freebsd license", r"spdx license identifier bsd 2 clause")),
    ("bsd-0-clause", 0.95, (r"zero clause bsd", r"0 ?bsd(?: license)?", r"bsd zero clause license", r"spdx license identifier 0bsd")),
    ("bsd", 0.85, (
        r"bsd licen[sc]e", r"bsd style licen[sc]e", r"bsd licensed", r"licensed under the bsd", r"released under the bsd", r"redistribution and use in source and binary forms with or without modification are permitted",
        r"redistributions of source code must retain the above copyright notice", r"redistributions in binary form must reproduce the above copyright notice", r"berkeley software distribution",
    )),
    ("mpl", 0.95, (
        r"mozilla public license(?: version)?(?: [0-9] [0-9])?", r"mpl ?v?[12](?: [01])?", r"spdx license identifier mpl [0-9] [0-9]", r"this source code form is subject to the terms of the mozilla public license", r"mozilla org mpl(?: [0-9] [0-9])?",
        r"licensed under the mpl", r"netscape public license",
    )),
    ("epl", 0.95, (r"eclipse public license(?: v(?:ersion)?)?(?: [0-9] [0-9])?", r"epl ?v?[12] 0", r"spdx license identifier epl [0-9] [0-9]", r"eclipse org legal epl", r"eclipse distribution license", r"common public license(?: version)?(?: [0-9] [0-9])?", r"ibm public license")),
    ("cddl", 0.95, (r"common development and distribution license(?: version)?(?: [0-9] [0-9])?", r"cddl(?: v?[0-9] [0-9])?", r"spdx license identifier cddl [0-9] [0-9]", r"sun public license", r"sun industry standards source license")),
    ("eupl", 0.95, (r"european union public licen[cs]e(?: v(?:ersion)?)?(?: [0-9] [0-9])?", r"eupl ?v?[0-9] [0-9]", r"spdx license identifier eupl [0-9] [0-9]", r"licensed under the eupl")),
    ("cc0", 0.95, (r"cc0(?: 1 0)?(?: universal)?", r"creative commons zero(?: v?1 0)?(?: universal)?", r"creativecommons org publicdomain zero 1 0", r"spdx license identifier cc0 1 0", r"public domain dedication", r"creative commons public domain")),
    ("cc-by-nc-nd", 0.95, (r"cc by nc nd(?: [0-9] [0-9])?", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [0-9] [0-9])?", r"attribution noncommercial noderivatives", r"creativecommons org licenses by nc nd")),
    ("cc-by-nc-sa", 0.95, (r"cc by nc sa(?: [0-9] [0-9])?", r"creative commons attribution non ?commercial share ?alike(?: [0-9] [0-9])?", r"attribution noncommercial sharealike", r"creativecommons org licenses by nc sa")),
    ("cc-by-nc", 0.95, (r"cc by nc(?: [0-9] [0-9])?", r"creative commons attribution non ?commercial(?: [0-9] [0-9])?", r"attribution noncommercial(?: [0-9] [0-9])?", r"creativecommons org licenses by nc", r"licensed under cc by nc")),
    ("cc-by-sa", 0.95, (r"cc by sa(?: [0-9] [0-9])?", r"creative commons attribution share ?alike(?: [0-9] [0-9])?", r"attribution sharealike(?: [0-9] [0-9])?", r"creativecommons org licenses by sa", r"licensed under cc by sa")),
    ("cc-by-nd", 0.95, (r"cc by nd(?: [0-9] [0-9])?", r"creative commons attribution no ?deriv(?:ative)?s?(?: [0-9] [0-9])?", r"attribution noderivatives", r"creativecommons org licenses by nd")),
    ("cc-by", 0.95, (r"cc by(?: [0-9] [0-9])?", r"creative commons attribution(?: [0-9] [0-9])?(?: international| unported| generic)?", r"creativecommons org licenses by", r"licensed under cc by")),
    ("cc", 0.7, (r"creative commons licen[sc]e", r"licensed under a creative commons", r"creativecommons org licenses", r"some rights reserved")),
    ("odbl", 0.95, (r"open database licen[sc]e", r"odbl(?: v?1 0)?", r"opendatacommons org licenses odbl", r"open data commons open database")),
    ("odc-by", 0.95, (r"open data commons attribution(?: license)?", r"odc by(?: 1 0)?", r"opendatacommons org licenses by")),
    ("pddl", 0.95, (r"open data commons public domain dedication", r"pddl(?: 1 0)?", r"opendatacommons org licenses pddl")),
    ("cdla", 0.9, (r"community data license agreement", r"cdla (?:permissive|sharing)(?: [0-9] [0-9])?")),
    ("ogl", 0.9, (r"open government licen[cs]e(?: v?[0-9](?: 0)?)?", r"nationalarchives gov uk doc open government licence")),
    ("gfdl", 0.95, (r"gnu free documentation license(?: version)?(?: [0-9] [0-9])?", r"gfdl(?: [0-9] [0-9])?", r"free documentation license", r"invariant sections no front cover texts", r"no invariant sections")),
    ("isc", 0.95, (
        r"isc licen[sc]e", r"spdx license identifier isc", r"internet systems consortium license", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        r"licensed under the isc", r"isc licensed",
    )),
    ("zlib", 0.95, (r"zlib licen[sc]e", r"zlib libpng licen[sc]e", r"spdx license identifier zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", r"altered source versions must be plainly marked as such", r"libpng license")),
    ("boost", 0.95, (r"boost software license(?: version)?(?: 1 0)?", r"bsl 1 0", r"spdx license identifier bsl 1 0", r"www boost org license 1 0 txt", r"boost licensed")),
    ("unlicense", 0.95, (r"the unlicense", r"spdx license identifier unlicense", r"this is free and unencumbered software released into the public domain", r"unlicense org", r"released under the unlicense")),
    ("wtfpl", 0.95, (r"wtfpl", r"do what the fuck you want to public license", r"spdx license identifier wtfpl")),
    ("artistic", 0.95, (r"artistic licen[sc]e(?: version)?(?: [12] 0)?", r"perl artistic license", r"spdx license identifier artistic [12] 0", r"same terms as perl itself", r"clarified artistic license")),
    ("psf", 0.95, (r"python software foundation licen[sc]e(?: version)?(?: [0-9])?", r"psf licen[sc]e", r"spdx license identifier (?:psf|python) 2 0", r"cnri python license", r"beopen python open source license")),
    ("php", 0.95, (r"php licen[sc]e(?: version)?(?: 3 0[01]?)?", r"spdx license identifier php 3 0[01]?", r"subject to version 3 0[01]? of the php license")),
    ("ruby", 0.95, (r"ruby licen[sc]e", r"same terms as ruby", r"spdx license identifier ruby")),
    ("openssl", 0.95, (r"openssl licen[sc]e", r"ssleay licen[sc]e", r"this product includes software developed by the openssl project", r"spdx license identifier openssl")),
    ("postgresql", 0.95, (r"postgresql licen[sc]e", r"spdx license identifier postgresql", r"postgresql database management system formerly known as postgres")),
    ("ncsa", 0.95, (r"university of illinois ncsa open source license", r"ncsa open source license", r"illinois open source license", r"spdx license identifier ncsa")),
    ("w3c", 0.95, (r"w3c software (?:notice and )?(?:and document )?license", r"w3c document license", r"spdx license identifier w3c")),
    ("sil-ofl", 0.95, (r"sil open font license(?: version)?(?: 1 [01])?", r"open font license", r"ofl 1 [01]", r"scripts sil org ofl", r"spdx license identifier ofl 1 [01]")),
    ("ms-pl", 0.95, (r"microsoft public license", r"ms pl", r"spdx license identifier ms pl")),
    ("ms-rl", 0.95, (r"microsoft reciprocal license", r"ms rl", r"spdx license identifier ms rl")),
    ("osl", 0.95, (r"open software license(?: v(?:ersion)?)?(?: [123] 0)?", r"osl 3 0", r"spdx license identifier osl [123] [01]")),
    ("afl", 0.95, (r"academic free license(?: v(?:ersion)?)?(?: [123] [01])?", r"afl 3 0", r"spdx license identifier afl [123] [01]")),
    ("upl", 0.95, (r"universal permissive license(?: v(?:ersion)?)?(?: 1 0)?", r"spdx license identifier upl 1 0")),
    ("mulan", 0.95, (r"mulan psl ?v?[12]", r"mulan permissive software license", r"spdx license identifier mulanpsl 2 0")),
    ("cecill", 0.95, (r"cecill(?: [abc])?(?: v?[12] [01])?(?: free software)? licen[sc]e", r"cecill [abc]", r"spdx license identifier cecill [12] [01]")),
    ("qpl", 0.9, (r"q public license", r"trolltech qpl", r"spdx license identifier qpl 1 0")),
    ("sspl", 0.95, (r"server side public license", r"sspl(?: v?1)?", r"spdx license identifier sspl 1 0")),
    ("busl", 0.95, (r"business source license(?: 1 1)?", r"busl 1 1", r"spdx license identifier busl 1 1")),
    ("elastic", 0.95, (r"elastic license(?: 2 0)?", r"spdx license identifier elastic 2 0")),
    ("commons-clause", 0.9, (r"commons clause(?: license condition)?(?: v1 0)?",)),
    ("polyform", 0.9, (r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use)(?: license)?(?: 1 0 0)?",)),
    ("openrail", 0.9, (r"open ?rail(?: [ms])?(?: license)?", r"responsible ai license", r"creativeml open rail m", r"bigscience rail license")),
    ("llama", 0.9, (r"llama [23](?: [0-9])? community license(?: agreement)?",)),
    ("beerware", 0.9, (r"beer ?ware licen[sc]e", r"spdx license identifier beerware")),
    ("curl", 0.9, (r"curl licen[sc]e", r"spdx license identifier curl")),
    ("vim", 0.9, (r"vim licen[sc]e", r"spdx license identifier vim")),
    ("tcl", 0.9, (r"tcl tk licen[sc]e", r"spdx license identifier tcl")),
    ("unicode", 0.9, (r"unicode licen[sc]e(?: v3)?", r"unicode inc license agreement data files and software", r"spdx license identifier unicode dfs 20[0-9]{2}")),
    ("intel", 0.85, (r"intel simplified software license", r"intel open source license")),
    ("nvidia", 0.85, (r"nvidia (?:software|source code) license(?: agreement)?",)),
    ("oracle", 0.85, (r"oracle binary code license", r"oracle technology network license")),
    ("public-domain", 0.8, (r"released (?:in)?to the public domain", r"placed in the public domain", r"is in the public domain", r"dedicated to the public domain", r"public domain software")),
    ("proprietary", 0.6, (
        r"all rights reserved", r"proprietary and confidential", r"end user licen[sc]e agreement", r"confidential and proprietary information", r"unauthorized copying of this file via any medium is strictly prohibited", r"commercial licen[sc]e required",
        r"may not be reproduced(?: in any form)? without(?: prior)?(?: written)? permission", r"licensed not sold", r"shareware licen[sc]e", r"for internal use only",
    )),
    ("unknown-license", 0.4, (
        r"licensed under the [a-z0-9]+ licen[sc]e", r"released under the [a-z0-9]+ licen[sc]e", r"distributed under the [a-z0-9]+ licen[sc]e", r"(?:open|free) source licen[sc]e", r"spdx license identifier [a-z0-9]+", r"see the licen[sc]e file", r"licen[sc]e agreement",
        r"under the terms of the licen[sc]e", r"subject to the following conditions", r"licen[sc]ed under", r"licen[sc]e terms", r"software licen[sc]e", r"free software licen[sc]e", r"permissive licen[sc]e", r"dual licensed",
    )),
)

#: The label of rules that name no licence, and how many characters from a named one they are dropped.
GENERIC, NEAR = "unknown-license", 80
_STOP = {"the", "of", "and", "or", "to", "in", "is", "this", "for", "any", "with", "you", "it", "be", "by", "as", "a", "not", "may", "only", "version", "under", "see", "all", "from", "use"}


@lru_cache(1)
def _compiled() -> tuple[dict[str, list[tuple[re.Pattern, str, float, int]]], tuple[bytes, ...]]:
    """Patterns with label, weight and rank, by the keyword they need; and all keywords.

    A pattern needs its rarest-looking fixed word: the longest outside brackets that is no stop word.
    """
    rules: dict[str, list] = {}
    every = set()
    for rank, (label, weight, patterns) in enumerate(RULES):
        for p in patterns:
            fixed = re.sub(r"\((?:[^()]|\([^()]*\))*\)(?:\?|\{\d,\d\})?|\[[^\]]*\][?+]?|.\?", " # ", p)
            words = [w for w in fixed.split() if re.fullmatch(r"[a-z][a-z0-9]+", w) and w not in _STOP and f"#{w}" not in fixed and f"{w}#" not in fixed]
            stems = {w for w in words}
            need = max(sorted(stems), key=len) if stems else ""
            if not need:  # fall back on the longest fixed run of letters
                need = max(re.findall(r"[a-z]+", re.sub(r"\[[^\]]*\]\S?|\([^)]*\)\S?|.\?", " ", p)), key=len)
            rules.setdefault(need, []).append((re.compile(rf"(?<![^ ])(?:{p})(?![^ ])"), label, weight, rank))
            every.add(need.encode())
    return rules, tuple(sorted(every))


def detections(words: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, weight) in a text of words joined by blanks: what stands after suppression.

    Of two detections that overlap, one lying within the other goes; otherwise the one of the later rule does. In time
    n log n of n detections, so texts full of licence lines are no trouble.
    Detections that name no licence also go where a named one stands near.
    """
    rules, _ = _compiled()
    found = []
    for need, own in rules.items():
        if need in words:
            for pattern, label, weight, rank in own:
                found += [(m.start(), m.end(), rank, label, weight) for m in pattern.finditer(words)]
    # longest first of those that start together: whatever ends no later than one that began before lies within it
    found.sort(key=lambda f: (f[0], -f[1], f[2]))
    kept, reach = [], -1
    for f in found:
        if f[1] > reach:
            kept.append(f)
            reach = f[1]
    # now starts and ends both ascend; the detections that stand don't overlap, so only the nearest two can meet another
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for f in sorted(kept, key=lambda f: (f[2], f[0])):
        i = bisect_left(starts, f[0])
        if (i and ends[i - 1] > f[0]) or (i < len(starts) and starts[i] < f[1]):
            continue
        starts.insert(i, f[0])
        ends.insert(i, f[1])
        out.append(f)
    # a rule that names no licence adds nothing near one that does
    named = sorted((a, b) for a, b, _, label, _ in out if label != GENERIC)
    begins, stops = [a for a, _ in named], [b for _, b in named]

    def near(a: int, b: int) -> bool:
        i = bisect_left(begins, b + NEAR)
        return i > 0 and stops[i - 1] > a - NEAR

    return sorted((a, b, label, weight) for a, b, _, label, weight in out if label != GENERIC or not near(a, b))


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, keywords = _compiled()
    keys = tuple(sorted({*keywords, *(p.split()[-1].encode() for p, _ in BASE)}))
    # a keyword that holds another finds nothing new
    keys = tuple(k for k in keys if not any(o != k and o in k for o in keys))
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = buffer_of(batch.column("text"))
            starts, ends, first = words_of(data, offsets, ALNUM)
            low = data.tobytes().translate(LOWER)
            rows: set[int] = set()
            for k in keys:
                at = low.find(k)
                while at >= 0:
                    row = int(np.searchsorted(offsets, at, side="right")) - 1
                    rows.add(row)
                    at = low.find(k, int(offsets[row + 1]))
            n = batch.num_rows
            count, lo, hi = [0] * n, [None] * n, [None] * n
            base_labels, labels, score = [""] * n, [""] * n, [0.0] * n
            for row in rows:
                p, q = int(first[row]), int(first[row + 1])
                words = [low[a:b].decode() for a, b in zip(starts[p:q].tolist(), ends[p:q].tolist())]
                joined = " ".join(words)
                base, places = set(), []
                for phrase, label in BASE:
                    if phrase in joined:
                        own = phrase.split()
                        at = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
                        if at:
                            base.add(label)
                            places += at
                found = detections(joined)
                if places:
                    count[row], lo[row], hi[row] = len(places), min(places), max(places)
                base_labels[row] = ",".join(sorted(base))
                labels[row] = ",".join(sorted(base | {f[2] for f in found}))
                score[row] = max([f[3] for f in found] + [1.0] * bool(base), default=0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(count, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score, pa.float64())],
                names=[c.split()[0] for c in SCAN.split(", ")],
            )


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id long, text string; others aren't read).

    Null and empty texts have no words: counts of 0, null places, empty labels and a score of 0. Base phrases
    are counted wherever they stand; the rules add labels, the score is the greatest weight of what stands.
    Rows with equal doc_id, or none, are separate.
    """
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(_scan), SCAN)
