"""Licence scan: positional index of rare template words, intersection by relative position, key phrases verified last.

Templates are whole licence texts and whole notices. Document frequencies of their words are counted over all files. Of
every template its rarest words, those that carry RARE of its weight, form the index: word -> (template, position). A file
looks up such of its words as the index holds, each place of a word less each position in a template is a start that it
votes for, and a window of starts with votes from words that carry SHARE or more of the template's index weight is a find, so
words changed, left out or put in move or cost single votes only. What a find must say word by word, its key phrases, is
read last, in the stretch of the file that the window covers. Built-in functions only.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import col
from tillwise.llm.common import LOWER, UPPER, free_name, whole

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# share of a template's weight that its index words carry, and share of that which a file must hold at one place
RARE, SHARE = 0.75, 0.6

# fixed values: phrases of the base scan and their labels
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# fixed values: label, wording of the usual notice, phrases it must hold
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain cc0 1 0 universal", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

# fixed values: label, whole licence or whole file header, phrases it must hold
_WARRANTY_BSD = """this software is provided by the copyright holders and contributors as is and any express or implied
warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are
disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special
exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data
or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort
including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of
such damage"""
_CLAUSES_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and
the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and
the following disclaimer in the documentation and or other materials provided with the distribution"""
_GNU_REST = """is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
merchantability or fitness for a particular purpose see the gnu {0} public license for more details you should have received a
copy of the gnu {0} public license along with this {1} if not see"""
TEXTS = (
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to use
copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software
is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether
in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
in the software""", ("permission is hereby granted",)),
    ("bsd", f"{_CLAUSES_BSD} {_WARRANTY_BSD}", ("redistributions of source code",)),
    ("bsd-3-clause", f"""{_CLAUSES_BSD} neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission {_WARRANTY_BSD}""",
     ("redistributions of source code", "endorse or promote products")),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the
author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in
no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever
resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of
or in connection with the use or performance of this software""", ("with or without fee",)),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable
for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose
including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin
of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in
a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must
be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or
altered from any source distribution""", ("must not be misrepresented",)),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any
and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large
and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity
of all present and future rights to this software under copyright law""", ("free and unencumbered software",)),
    ("bsl-1.0", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the
software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so
all subject to the following the copyright notices in the software and this entire statement including the above license grant
this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all
derivative works of the software unless such copies or derivative works are solely in the form of machine executable object
code generated by a source language processor""", ("machine executable object code",)),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed
under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see
the license for the specific language governing permissions and limitations under the license""", ("apache license version 2 0",)),
    ("gpl-3.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
license as published by the free software foundation either version 3 of the license or at your option any later version this
program """ + _GNU_REST.format("general", "program"), ("gnu general public license", "version 3 of the license")),
    ("gpl-2.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
license as published by the free software foundation either version 2 of the license or at your option any later version this
program """ + _GNU_REST.format("general", "program"), ("gnu general public license", "version 2 of the license")),
    ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public
license as published by the free software foundation either version 2 1 of the license or at your option any later version this
library """ + _GNU_REST.format("lesser general", "library"), ("gnu lesser general public license",)),
    ("agpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public
license as published by the free software foundation either version 3 of the license or at your option any later version this
program """ + _GNU_REST.format("affero general", "program"), ("gnu affero general public license",)),
)
TEMPLATES = (*NOTICES, *TEXTS)


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, wording, _ in templates for w in re.findall(WORD, wording)})


def file_words(text: Column) -> Column:
    """Words of the whole text in order, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(whole(text), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _list(items: list[str]) -> Column:
    return F.split(F.lit(" ".join(items)), " ")


def word_weights(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every template word over all texts; a row per template word reaches the driver."""
    known = F.concat(F.array(F.lit("")), F.array_intersect(file_words(col(text)), _list(vocabulary(templates))))
    counts = docs.select(F.explode(known).alias("word")).groupBy("word").count().collect()
    held = {r["word"]: r["count"] for r in counts}
    return {w: math.log((held.get("", 0) + 1) / (held.get(w, 0) + 0.5)) for w in vocabulary(templates)}


def rare_words(wording: str, must: tuple[str, ...], idf: dict[str, float]) -> tuple[dict[str, float], float]:
    """The index words of a template with their shares of the index weight, and the share that a find needs.

    They are its rarest words, until they carry RARE of its weight and half the weight outside its key phrases. A find needs
    SHARE, and half of what lies outside the key phrases, so that a phrase by itself is none.
    """
    phrases = {w for p in must for w in p.split()}
    own = sorted(set(re.findall(WORD, wording)), key=lambda w: (-idf[w], w))
    total, rest = sum(idf[w] for w in own), sum(idf[w] for w in own if w not in phrases)
    taken, outside = {}, 0.0
    for word in own:
        if sum(taken.values()) >= RARE * total and outside >= rest / 2:
            break
        taken[word] = idf[word]
        outside += 0.0 if word in phrases else idf[word]
    weight = sum(taken.values())
    return {w: x / weight for w, x in taken.items()}, max(SHARE, 1 - outside / weight / 2)


def positional_index(idf: dict[str, float], templates=TEMPLATES) -> dict[str, list[dict]]:
    """word -> postings: template t, position i, number k of the word there, its share, width d of a window of starts."""
    index = {}
    for t, (_, wording, must) in enumerate(templates):
        order, (rare, _) = re.findall(WORD, wording), rare_words(wording, must, idf)
        for i, word in enumerate(order):
            if word in rare:
                posting = {"t": t, "i": i, "k": list(rare).index(word), "share": rare[word], "d": _width(len(order))}
                index.setdefault(word, []).append(posting)
    return index


def _width(n_words: int) -> int:
    """Starts of one find differ by at most half of this, so by the words put in or left out: half the template, 4 or more."""
    return 2 * max(4, (n_words + 1) // 2)


def _phrase_places(w: Column, phrase: str) -> Column:
    """Places where the phrase's words stand consecutively; longer tests run only where the first word stands."""
    head, *rest = phrase.split()
    every = F.filter(F.transform(w, lambda x, i: F.when(x == head, i)), lambda i: i.isNotNull())

    def followed_by(places: Column, word: str, k: int) -> Column:
        return F.filter(places, lambda i: F.get(w, i + k) == word)

    for k, word in enumerate(rest, 1):
        every = followed_by(every, word, k)
    return every


def _windows(spots: Column, index: dict[str, list[dict]], needs: list[float]) -> Column:
    """(t, lo, share) of every window of starts with votes from words that carry what t needs: starts from lo to lo + d.

    Windows of a template overlap by half, so starts that differ by half a width at most meet in one.
    """
    postings = F.from_json(F.lit(json.dumps(index)), "map<string,array<struct<t:int,i:int,k:int,share:double,d:int>>>")

    def votes(s: Column, shift: int) -> Column:
        def vote(p: Column) -> Column:
            # window number n starts at n d, with ``shift`` half a width before
            back = p["d"] / 2 * shift
            lo = F.floor((s["i"] - p["i"] + back) / p["d"]) * p["d"] - back
            return F.struct(p["t"].alias("t"), F.lit(shift).alias("shift"), lo.cast("int").alias("lo"), p["k"].alias("k"), p["share"].alias("share"))

        return F.transform(F.coalesce(F.try_element_at(postings, s["w"]), F.array().cast("array<struct<t:int,i:int,k:int,share:double,d:int>>")), vote)

    cast = F.sort_array(F.flatten(F.transform(spots, lambda s: F.concat(votes(s, 0), votes(s, 1)))))
    none = F.array().cast("array<struct<t:int,lo:int,share:double>>")
    need = F.from_json(F.lit(json.dumps([round(x, 6) for x in needs])), "array<double>")
    zero = F.struct(
        F.lit(-1).alias("t"), F.lit(0).alias("shift"), F.lit(0).alias("lo"), F.lit(-1).alias("k"), F.lit(0.0).alias("sum"), none.alias("found")
    )

    def closed(a: Column) -> Column:
        window = F.struct(a["t"].alias("t"), a["lo"].alias("lo"), F.round(a["sum"], 6).alias("share"))
        return F.when(F.round(a["sum"], 6) >= F.get(need, a["t"]), F.concat(a["found"], F.array(window))).otherwise(a["found"])

    def step(a: Column, x: Column) -> Column:
        same = (a["t"] == x["t"]) & (a["shift"] == x["shift"]) & (a["lo"] == x["lo"])
        # a word votes once in a window, however often it stands there
        total = F.when(same & (a["k"] == x["k"]), a["sum"]).when(same, a["sum"] + x["share"]).otherwise(x["share"])
        found = F.when(same, a["found"]).otherwise(closed(a))
        return F.struct(
            x["t"].alias("t"), x["shift"].alias("shift"), x["lo"].alias("lo"), x["k"].alias("k"), total.alias("sum"), found.alias("found")
        )

    return F.aggregate(cast, zero, step, closed)


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates=TEMPLATES) -> DataFrame:
    """Columns ``keep`` (all by default) with n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the BASE phrases, first_word and last_word are their smallest and largest start in
    words from 0 (NULL without any). labels adds the templates found to base_labels; both are distinct, sorted and
    joined by commas, empty without any. score is the largest share of a found template's index weight that stands in one
    window; a file with base places only scores 0.5, one without labels 0. A text that breaks a key phrase, or holds less
    than SHARE of the index weight or little but key phrases at one place, is not that licence. A missing text is empty. Rows pass one by one
    but for the document frequencies, in which repeated rows count each; work and memory of a row follow its length. An
    empty table gives an empty result. Columns named as results are replaced. ``templates`` are (label, wording, key
    phrases), in small letters.
    """
    results = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    idf = word_weights(docs, text, templates)
    index = positional_index(idf, templates)
    needs = [rare_words(wording, must, idf)[1] for _, wording, must in templates]
    heads = sorted({p.split()[0] for p, _ in BASE})
    names = {n: free_name(docs, n) for n in ("_words", "_held", "_base", "_found")}
    w, held, base, found = (F.col(f"`{n}`") for n in names.values())
    files = docs.select(*map(col, keep), file_words(col(text)).alias(names["_words"]))
    files = files.withColumn(names["_held"], F.array_intersect(w, _list(sorted({*index, *heads}))))
    # most files hold none of the words, and only the others walk through theirs again
    spots = F.array_compact(F.transform(w, lambda x, i: F.when(F.array_contains(held, x), F.struct(x.alias("w"), i.alias("i")))))
    places = [F.when(F.array_contains(held, p.split()[0]), _phrase_places(w, p)) for p, _ in BASE]
    files = files.select(
        *map(col, keep), w,
        F.struct(*[p.alias(f"p{i}") for i, p in enumerate(places)]).alias(names["_base"]),
        F.when(F.size(held) > 0, _windows(spots, index, needs)).alias(names["_found"]),
    )
    facts = F.from_json(
        F.lit(json.dumps([{"label": label, "must": must, "span": len(o := re.findall(WORD, wording)) + _width(len(o))} for label, wording, must in templates])),
        "array<struct<label:string,must:array<string>,span:int>>",
    )

    def verified(f: Column) -> Column:
        of = F.get(facts, f["t"])
        stretch = F.slice(w, F.greatest(f["lo"], F.lit(0)) + 1, of["span"])
        said = F.concat(F.lit(" "), F.array_join(stretch, " "), F.lit(" "))
        return F.forall(of["must"], lambda p: F.contains(said, F.concat(F.lit(" "), p, F.lit(" "))))

    sure = F.coalesce(F.filter(found, verified), F.array().cast("array<struct<t:int,lo:int,share:double>>"))
    files = files.withColumn(names["_found"], sure)
    at = [base[f"p{i}"] for i in range(len(BASE))]
    starts = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<int>")) for p in at]))
    base_labels = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(at, BASE)]))
    more = F.transform(found, lambda f: F.get(facts, f["t"])["label"])
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return files.select(
        *map(col, keep), F.size(w).cast("long").alias("n_words"), F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, more)).alias("labels"),
        F.coalesce(F.array_max(F.transform(found, lambda f: f["share"])), F.when(F.size(starts) > 0, 0.5).otherwise(0.0)).alias("score"),
    )
