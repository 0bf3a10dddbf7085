"""Licence notices by a positional rare-token index, in DataFrame functions only.

The catalogue (TEMPLATES) holds whole notices. Licence words are the words of notices and base phrases. One pass over the texts writes
each text's licence words with their positions; how many documents hold each word, and so its inverse document frequency, is counted
from what was written, and the texts are not read again. The index maps a word to its postings (notice, position); it
holds each notice's words of highest inverse document frequency, up to INDEXED of the notice's weight. A file's words
that are in the index are looked up; each posting gives a relative position of its notice, and postings are intersected by
counting equal relative positions in sorted order. Where enough of a notice's postings agree (half of those that a match of
MIN_SHARE must have at least, so that one word put in or left out does not hide it), the whole notice is verified around that
place: the share of its weight that stands within DRIFT words of where it should, and its mandatory key phrase. The base phrases
are found the same way from their rarest word, and must stand exactly.

Everything but the counts (at most one row per licence word) happens in the row of the text, so nothing is shuffled. Words are
maximal runs of characters outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z. Defined results: null and empty texts have
no words, no positions and empty labels, score 0; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import ascii_lower, cut, let

#: Phrases that give a base label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_GNU = "as published by the free software foundation either version"
_GNU_END = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"

#: Public licence notices (label, words, mandatory key phrase).
TEMPLATES = (
    ("afl-3.0", "licensed under the academic free license version 3 0", "academic free license"),
    ("agpl-3.0", f"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license {_GNU} 3 of the license or at your option any later version this program {_GNU_END}", "gnu affero general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("artistic-2.0", "this package is free software you can redistribute it and or modify it under the terms of the artistic license 2 0", "artistic license"),
    ("bsd", _BSD[: _BSD.index(" redistributions")], "source and binary forms"),
    ("bsd-2-clause", f"{_BSD} {_BSD_END}", "binary forms with or without modification"),
    ("bsd-3-clause", f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}", "endorse or promote products"),
    ("bsl-1.0", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", "boost software license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4 0"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "attribution noderivatives"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl-notice", f"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license {_GNU} 3 of the license or at your option any later version this program {_GNU_END} see the gnu general public license for more details", "gnu general public license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("isc", f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "distribute this software"),
    ("lgpl", f"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license {_GNU} 2 1 of the license or at your option any later version this library {_GNU_END}", "gnu lesser general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_AS_IS}", "associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unencumbered software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "alter it and redistribute it freely"),
)
MIN_SHARE = 0.75
#: Share of a notice's weight that is in the index, rarest words first; more than 1 - MIN_SHARE.
INDEXED = 0.6
DRIFT = 2
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def vocabulary() -> list[str]:
    return sorted({w for t in TEMPLATES for w in t[1].split()} | {w for p in BASE for w in p.split()})


def licence_words(text: Column) -> Column:
    """struct(n, hits): the number of words, and the licence words (pos, w) among them by position."""
    vocab = vocabulary()
    words = F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _SEPARATORS), lambda w: w != "")
    hits = lambda x: F.filter(F.transform(x, lambda w, i: F.when(w.isin(vocab), F.struct(i.alias("pos"), w.alias("w")))), lambda h: h.isNotNull())
    return let(words, lambda x: F.struct(F.size(x).alias("n"), hits(x).alias("hits")))


def document_counts(rows: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of documents that hold each licence word. rows: hits."""
    held = rows.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("word")).groupBy("word").count()
    return rows.count(), {r.word: r["count"] for r in held.collect()}


def index(idf: dict[str, float]) -> tuple[list[dict], dict[str, list[dict]]]:
    """The notices with their weights, and the postings of the indexed words."""
    notices, postings = [], {}
    for t, (label, text, key) in enumerate(TEMPLATES):
        words, phrase = text.split(), key.split()
        weights = [idf[w] for w in words]
        whole, got, chosen = sum(weights), 0.0, []
        for i in sorted(range(len(words)), key=lambda i: (-weights[i], words[i], i)):
            if got > INDEXED * whole:
                break
            got += weights[i]
            chosen.append(i)
            postings.setdefault(words[i], []).append({"t": t, "at": i})
        least, need = got - (1 - MIN_SHARE) * whole, 0
        for i in chosen:
            if least <= 0:
                break
            least -= weights[i]
            need += 1
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        notices.append({"label": label, "words": words, "weights": [w / whole for w in weights], "n": len(words), "need": max(1, -(-need // 2)), "key": at, "key_n": len(phrase)})
    return notices, postings


def _places(hits: Column, phrase: list[str], idf: dict[str, float]) -> Column:
    """Where the words of a phrase stand consecutively, looked up by its rarest word."""
    a = max(range(len(phrase)), key=lambda i: (idf[phrase[i]], -i))
    stands = lambda h, j: reduce(lambda x, y: x & y, (F.coalesce((F.get(hits, j + (i - a))["w"] == w) & (F.get(hits, j + (i - a))["pos"] == h["pos"] + (i - a)), F.lit(False)) for i, w in enumerate(phrase) if i != a))
    return F.array_compact(F.transform(hits, lambda h, j: F.when((h["w"] == phrase[a]) & (j >= a) & stands(h, j), h["pos"] - a)))


def _shares(hits: Column, notices: list[dict], postings: dict[str, list[dict]]) -> Column:
    """Structs (label, share) of the notices that stand in a text, whatever their share."""
    kinds = "array<struct<label:string,words:array<string>,weights:array<double>,n:int,need:int,key:int,key_n:int>>"
    catalogue = F.from_json(F.lit(json.dumps(notices)), kinds)
    posted = F.from_json(F.lit(json.dumps(postings)), "map<string,array<struct<t:int,at:int>>>")
    rare = F.filter(F.transform(hits, lambda h, j: F.when(h["w"].isin(sorted(postings)), F.struct(h["w"].alias("w"), h["pos"].alias("pos"), j.alias("j")))), lambda h: h.isNotNull())
    looked = F.flatten(F.transform(rare, lambda h: F.transform(F.element_at(posted, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["pos"] - p["at"]).alias("rel"), h["j"].alias("j")))))
    same = lambda a, b: F.coalesce((a["t"] == b["t"]) & (a["rel"] == b["rel"]), F.lit(False))
    agreed = lambda s: F.filter(s, lambda x, i: ~((i > 0) & same(F.get(s, i - 1), x)) & same(F.get(s, i + F.get(catalogue, x["t"])["need"] - 1), x))

    def verify(c: Column) -> Column:
        def share(x: Column) -> Column:
            n, near = x["notice"], x["near"]
            stands = F.transform(n["words"], lambda w, i: F.when(F.exists(near, lambda h: (h["w"] == w) & (F.abs(h["pos"] - c["rel"] - i) <= DRIFT)), F.get(n["weights"], i)).otherwise(0.0))
            drifts = F.sequence(F.lit(-DRIFT), F.lit(DRIFT))
            exact = lambda d: ~F.exists(F.sequence(n["key"], n["key"] + n["key_n"] - 1), lambda i: ~F.exists(near, lambda h: (h["w"] == F.get(n["words"], i)) & (h["pos"] == c["rel"] + i + d)))
            whole = F.aggregate(stands, F.lit(0.0), lambda a, b: a + b)
            return F.struct(n["label"].alias("label"), F.when(F.exists(drifts, exact), whole).otherwise(0.0).alias("share"))

        size = F.get(catalogue, c["t"])["n"]
        begin = F.greatest(c["j"] - size - DRIFT, F.lit(0))
        return let(F.struct(F.get(catalogue, c["t"]).alias("notice"), F.slice(hits, begin + 1, 2 * (size + DRIFT) + 1).alias("near")), share)

    found = let(F.array_sort(looked), lambda s: F.transform(agreed(s), verify))
    return F.when(F.size(hits) > 1, found).otherwise(F.array().cast("array<struct<label:string,share:double>>"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), licence_words(F.col(text_col)).alias("words")).select("doc_id", "words.n", "words.hits"))
    n, df = document_counts(rows)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary()}
    notices, postings = index(idf)
    base = F.struct(*[_places(F.col("hits"), p.split(), idf).alias(f"b{i}") for i, p in enumerate(BASE)])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")

    def report(x: Column) -> Column:
        parts = [x["base"][f"b{i}"] for i in range(len(BASE))]
        starts = F.concat(*parts)
        found = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(name)) for p, name in zip(parts, BASE.values(), strict=True)]))
        more = F.transform(F.filter(x["notices"], lambda m: m["share"] >= MIN_SHARE), lambda m: m["label"])
        best = F.coalesce(F.array_max(F.transform(x["notices"], lambda m: m["share"])), F.lit(0.0))
        return F.struct(
            F.size(starts).cast("long").alias("n_base"),
            F.array_min(starts).cast("long").alias("first_word"),
            F.array_max(starts).cast("long").alias("last_word"),
            joined(found).alias("base_labels"),
            joined(F.concat(found, more)).alias("labels"),
            F.when(F.size(starts) > 0, 1.0).otherwise(F.least(F.lit(1.0), F.round(best, 9))).alias("score"),
        )

    out = let(F.struct(base.alias("base"), _shares(F.col("hits"), notices, postings).alias("notices")), report)
    return rows.select("doc_id", F.col("n").cast("long").alias("n_words"), out.alias("r")).select("doc_id", "n_words", "r.*")
