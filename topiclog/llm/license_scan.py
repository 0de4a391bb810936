"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised, and known licence sentences get their identifiers. The sequence of
identifiers of a text is then held against ordered rules: a rule names a licence and the identifiers
that must follow each other, with others between them allowed. Besides sentences word for word, short notices are recognised in a normal form: who or what is
"released", "licensed", "available" and so on is left out, and what stands behind "under" is one of a licence's names; SPDX tags are such sentences too. Sentences are taken twice, over line ends (licence
texts are wrapped) and line by line (notices often stand on a line of their own); a rule may match either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclog.llm.common import TMP, let

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-forms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
# Licences (SPDX names) and the identifiers that have to follow each other.
RULES = [
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-header", "apache-as-is"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-grant", "mit-notice-kept"]),
    ("BSD-2-Clause", ["bsd-forms", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-forms", "bsd-source", "bsd-binary", "bsd-names"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("MPL-2.0", ["mpl-form"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("Unlicense", ["unlicense"]),
]
# Licences by SPDX name, with the names that notices give them (in lower case, "license" behind them may be left out).
NAMES = {
    "MIT": ["mit", "expat", "mit expat"],
    "Apache-2.0": ["apache 2 0", "apache license 2 0", "apache license version 2 0", "apache software license 2 0", "apache software license version 2 0", "apache v2"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "two clause bsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd", "three clause bsd"],
    "0BSD": ["0bsd", "zero clause bsd", "bsd zero clause"],
    "ISC": ["isc"],
    "Zlib": ["zlib", "zlib libpng"],
    "BSL-1.0": ["boost software license 1 0", "boost software license version 1 0", "bsl 1 0", "boost software"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl v2", "gnu gpl version 2", "gpl v2", "gplv2", "gpl version 2"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl v3", "gnu gpl version 3", "gpl v3", "gplv3", "gpl version 3"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v2 1", "lgpl v2 1", "lgplv2 1", "lgpl 2 1"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lesser general public license v3 0", "gnu lgpl v3", "lgpl v3", "lgplv3", "lgpl 3 0"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "gnu affero general public license v3", "gnu affero general public license v3 0", "gnu agpl v3", "agpl v3", "agplv3", "agpl 3 0"],
    "MPL-1.1": ["mozilla public license 1 1", "mozilla public license version 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v2 0", "mpl 2 0", "mpl v2 0", "mplv2"],
    "EPL-1.0": ["eclipse public license 1 0", "eclipse public license version 1 0", "eclipse public license v1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v2 0", "epl 2 0", "epl v2 0"],
    "CDDL-1.0": ["common development and distribution license 1 0", "common development and distribution license version 1 0", "cddl 1 0"],
    "EUPL-1.2": ["european union public licence 1 2", "european union public licence version 1 2", "eupl 1 2", "eupl v1 2"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero", "creative commons zero v1 0 universal", "creative commons cc0"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0", "creative commons attribution 4 0 international"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0", "creative commons attribution sharealike 4 0 international"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial 4 0 international"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0", "creative commons attribution noderivatives 4 0 international"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0", "creative commons attribution noncommercial sharealike 4 0 international"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0", "creative commons attribution noncommercial noderivatives 4 0 international"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0", "creative commons attribution 3 0 unported"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0", "creative commons attribution sharealike 3 0 unported"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public license"],
    "Artistic-2.0": ["artistic 2 0", "artistic license 2 0", "artistic license version 2 0"],
    "OFL-1.1": ["sil open font license 1 1", "sil open font license version 1 1", "open font license version 1 1", "ofl 1 1"],
    "ODbL-1.0": ["open database license", "open data commons open database license", "odbl", "odbl 1 0"],
    "PSF-2.0": ["python software foundation license version 2", "psf"],
    "PostgreSQL": ["postgresql"],
    "NCSA": ["university of illinois ncsa open source", "ncsa"],
}
#: Licences of which a notice may also allow any later version.
LATER = [name for name in NAMES if name.endswith("-only")]
#: What a notice's normal form begins with, instead of this.
NOTICE = (
    "^(?:(?:this|the|all|our) (?:[a-z0-9]+ )?(?:code|software|project|program|work|file|library|package|repository|document|documentation|dataset|data|text|page|content|source|module|script|book|image|tool)s? "
    "(?:is|are|was|were|has been|have been) )?(?:hereby )?(?:dual )?(?:released|licensed|distributed|available|published|provided|made available|offered|shared|covered)(?: to you| for use)? (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
)
UNDER = "under the "
#: The colon of a tag would end a sentence.
TAG = "(?i)spdx-license-identifier[ \t]*:"


def notices() -> dict[str, str]:
    """The identifier of each notice in its normal form."""
    forms = {}
    for spdx, names in NAMES.items():
        later = spdx.replace("-only", "-or-later")
        for name in names:
            for whole in dict.fromkeys((name, f"{name} license", f"{name} licence")):
                forms[UNDER + whole] = f"notice-{spdx}"
                if spdx in LATER:
                    forms |= {f"{UNDER}{whole} {end}": f"notice-{later}" for end in ("or later", "or any later version", "or at your option any later version")}
        forms[f"spdx license identifier {normalised(spdx)}"] = f"spdx-{spdx}"
        if spdx in LATER:
            forms[f"spdx license identifier {normalised(later)}"] = f"spdx-{later}"
    return forms


def rules() -> list[tuple[str, list[str]]]:
    """RULES, and one for each notice and tag: a licence and the identifiers that have to follow each other."""
    return RULES + [(i.split("-", 1)[1], [i]) for i in sorted(set(notices().values()))]


#: A licence that another one's rule contains: it is not named where the other is.
PART_OF = {"BSD-2-Clause": "BSD-3-Clause"}
#: A known sentence has at least one of these words (tests hold the table against it), so other texts need no cutting.
TRIGGER = "licen|permission|redistribution|free software|neither the name|provided|public domain|hope that|(?:released|distributed|available|published|offered|shared|covered)(?: to you| for use)?[ \t\n\r]+(?:under|by)"
#: The end of a sentence: its mark with white space behind it. A known sentence with such a mark inside is several pieces, which have to follow each other.
END = r"([.!?;:])[ \t\n\x0B\f\r]+"
SPLIT = "\x01"
#: A line with nothing on it but comment marks ends a sentence too.
BLANK = r"\n[ \t\r#*/;-]*\n"


def normalised(text: str) -> str:
    """Lower case, and one space for whatever is neither a-z nor 0-9."""
    import re

    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def pieces(text: str) -> list[str]:
    """The normalised pieces that a known sentence is cut into."""
    import re

    return [p for x in re.sub(END, r"\1" + SPLIT, text).split(SPLIT) if (p := normalised(x))]


def piece_table() -> tuple[list[str], list[tuple[str, str]]]:
    """All distinct pieces, and each sentence's identifier with the numbers of its pieces as `_sequence` writes them."""
    known = sorted({p for s in SENTENCES.values() for p in pieces(s)})
    place = {p: k for k, p in enumerate(known)}
    return known, [(i, "".join(f" {place[p]} " for p in pieces(s))) for i, s in SENTENCES.items()]


def _sequence(cut: Column) -> Column:
    """The numbers of the pieces with a space on either side; "-" stands for each run of unknown pieces."""
    known, _ = piece_table()
    clean = F.filter(F.transform(cut, lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))), lambda x: x != "")
    forms = notices()
    whole, names = list(forms), [f"<{i}>" for i in forms.values()]
    notice = lambda x: let(F.regexp_replace(x, NOTICE, UNDER), lambda y: F.when(y.isin(whole), F.get(F.lit(names), (F.array_position(F.lit(whole), y) - 1).cast("int"))).otherwise("-"))
    number = lambda x: F.when(x.isin(known), (F.array_position(F.lit(known), x) - 1).cast("string")).otherwise(notice(x))
    return F.regexp_replace(F.concat(F.lit(" "), F.array_join(F.transform(clean, number), "  "), F.lit(" ")), "(?: - )+", " - ")


def _identified(sequence: Column) -> Column:
    """The identifiers in their order, as "<id><id>", longer runs of pieces first."""
    _, patterns = piece_table()
    out = sequence
    for name, numbers in sorted(patterns, key=lambda p: (-len(p[1].split()), p[0])):
        out = F.replace(out, F.lit(numbers), F.lit(f"<{name}>"))
    return F.array_join(F.regexp_extract_all(out, F.lit("<[^>]+>"), F.lit(0)), "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (in the order of the text, comma-joined), licenses (sorted, comma-joined), n_licenses of every row.

    Empty strings and 0 where nothing is found, and for null and empty texts. A licence that occurs repeatedly is named
    once; rows that repeat are judged each; a null doc_id stays null; other columns are ignored. sentence_ids are those over line ends,
    or those line by line where that gives more. One pass, no shuffle, built-in functions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    some = F.lower(text).rlike(TRIGGER)
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, TAG, "SPDX-License-Identifier "), BLANK, SPLIT), END, "$1" + SPLIT)
    over, by_line = F.split(cut, SPLIT), F.split(cut, rf"[\n{SPLIT}]")
    ids = lambda cut: F.when(some, _identified(_sequence(cut))).otherwise("")
    rows = docs.select("doc_id", F.array(ids(over), ids(by_line)).alias(f"{TMP}ids"))
    found = F.col(f"{TMP}ids")
    fits = {}
    for licence, names in rules():
        fits.setdefault(licence, []).append("".join(f"<{n}>.*" for n in names))
    either = lambda own: F.get(found, 0).rlike(own) | F.get(found, 1).rlike(own)
    named = F.array(*(F.when(either("|".join(own)), licence) for licence, own in sorted(fits.items())))
    some = F.length(F.get(found, 0)) + F.length(F.get(found, 1)) > 0
    rows = rows.select("doc_id", f"{TMP}ids", F.when(some, named).otherwise(F.array().cast("array<string>")).alias(f"{TMP}named"))

    def alone(names: Column) -> Column:
        for part, whole in PART_OF.items():
            names = F.when(F.array_contains(names, whole), F.array_remove(names, part)).otherwise(names)
        return F.array_sort(names)

    best = let(found, lambda x: F.when(F.length(F.get(x, 1)) > F.length(F.get(x, 0)), F.get(x, 1)).otherwise(F.get(x, 0)))
    licences = alone(F.array_compact(F.col(f"{TMP}named")))
    return rows.select(
        "doc_id",
        F.regexp_replace(F.regexp_replace(best, "><", ","), "[<>]", "").alias("sentence_ids"),
        F.array_join(licences, ",").alias("licenses"),
        F.size(licences).cast("long").alias("n_licenses"),
    )
