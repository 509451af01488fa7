"""License notices in texts by ordered signature rules.

Texts are lower-cased (A-Z) and read as words: runs of ASCII digits and letters and of non-ASCII
characters. Base phrases are found wherever their words stand consecutively. Beside them, hundreds of
rules are tried, each a regular expression over the words. The hand-written ones are license NAMES, SPDX
identifiers, VARIANTS of names, and sentences of license BODIES; the names are multiplied by the FORMS
that license notices take. A rule is only tried where its keyword occurs: an
Aho-Corasick automaton finds all keywords of a text in one pass, and most texts have none.

Detections overlap ("gpl" inside "lgpl version 3"). A detection goes if another one holds all of its
words and either has a higher priority (a smaller number; forms are ordered from most to least telling)
or the same priority and more words, or as many words and an earlier rule. What is left gives the
labels; base labels always stay. The score is 1 minus the product of (1 - weight) over the labels'
best weights.

Results for odd input: null and empty texts have no words, no labels and score 0. Rows are judged
alone, so repeated rows and null ids change nothing; other columns are not read.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearweave.llm.words import FOLDED

# Phrases and labels of the base detections.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
BASE_WEIGHT = 0.7

#: Hand-written signatures: label, name as words (a pattern), and a keyword that all its texts hold.
NAMES = (
    ("apache-2.0", r"apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)?", "apache"),
    ("apache-2.0", r"apache 2(?: 0)?", "apache"),
    ("apache-1.1", r"apache(?: software)? licen[sc]e(?: version)? v?1 1", "apache"),
    ("apache", r"apache(?: software)? licen[sc]e", "apache"),
    ("mit", r"mit(?: x11| expat)? licen[sc]e", "mit"),
    ("mit", r"x11 licen[sc]e", "x11"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?", "bsd"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd", r"bsd(?: style)? licen[sc]e", "bsd"),
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?", "bsd"),
    ("agpl-3.0", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version)? ?v?3(?: 0)?", ""),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)", ""),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)(?: version)? ?v?2 1", ""),
    ("lgpl-3.0", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version)? ?v?3(?: 0)?", ""),
    ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)", ""),
    ("gpl-2.0", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? ?v?2(?: 0)?", ""),
    ("gpl-3.0", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? ?v?3(?: 0)?", ""),
    ("gpl", r"gnu (?:gpl|general public licen[sc]e)", "gnu"),
    ("gfdl", r"(?:gnu )?(?:gfdl|free documentation licen[sc]e)", ""),
    ("mpl-2.0", r"(?:mpl|mozilla public licen[sc]e)(?: version)? v?2(?: 0)?", ""),
    ("mpl-1.1", r"(?:mpl|mozilla public licen[sc]e)(?: version)? v?1 1", ""),
    ("mpl", r"mozilla public licen[sc]e", "mozilla"),
    ("epl-1.0", r"(?:epl|eclipse public licen[sc]e)(?: version)? v?1(?: 0)?", ""),
    ("epl-2.0", r"(?:epl|eclipse public licen[sc]e)(?: version)? v?2(?: 0)?", ""),
    ("epl", r"eclipse public licen[sc]e", "eclipse"),
    ("eupl", r"(?:eupl|european union public licen[sc]e)", ""),
    ("cddl", r"(?:cddl|common development and distribution licen[sc]e)", ""),
    ("isc", r"isc licen[sc]e", "isc"),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", "zlib"),
    ("bsl-1.0", r"boost software licen[sc]e", "boost"),
    ("artistic-2.0", r"artistic licen[sc]e(?: version)? v?2(?: 0)?", "artistic"),
    ("artistic", r"artistic licen[sc]e", "artistic"),
    ("python-2.0", r"(?:python software foundation|psf) licen[sc]e", ""),
    ("postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", r"wtfpl", "wtfpl"),
    ("ms-pl", r"microsoft public licen[sc]e", "microsoft"),
    ("ofl-1.1", r"(?:sil )?open font licen[sc]e", "font"),
    ("odbl", r"(?:odbl|open database licen[sc]e)", ""),
    ("openrail", r"(?:open ?rail(?: m)?|responsible ai licen[sc]e)", "rail"),
    ("cc0-1.0", r"(?:cc ?0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", ""),
    ("cc-by-nc-nd", r"(?:cc|creative commons) by nc nd(?: [1-4] 0)?", ""),
    ("cc-by-nc-sa", r"(?:cc|creative commons) by nc sa(?: [1-4] 0)?", ""),
    ("cc-by-nc", r"(?:cc|creative commons) by nc(?: [1-4] 0)?", ""),
    ("cc-by-nd", r"(?:cc|creative commons) by nd(?: [1-4] 0)?", ""),
    ("cc-by-sa", r"(?:cc|creative commons) by sa(?: [1-4] 0)?", ""),
    ("cc-by-4.0", r"(?:cc|creative commons) by 4 0", ""),
    ("cc-by-3.0", r"(?:cc|creative commons) by 3 0", ""),
    ("cc-by", r"creative commons attribution(?: [1-4] 0)?", "creative"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] 0)?", "creative"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] 0)?", "creative"),
    ("public-domain", r"public domain", "public domain"),
    ("proprietary", r"proprietary(?: and confidential)?", "proprietary"),
    ("copyright", r"copyright(?: c)? (?:19|20)[0-9][0-9]", "copyright"),
    ("reserved", r"(?:todos los derechos reservados|tous droits réservés|alle rechte vorbehalten)", ""),
)

#: Hand-written forms of a notice around a name: pattern, weight, and a keyword that all its texts hold.
#: Their order is their priority.
FORMS = (
    (r"spdx license identifier {name}", 0.99, "spdx license identifier"),
    (r"(?:is |are )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{name}", 0.95, "under"),
    (r"(?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{name}", 0.95, "under"),
    (r"subject to (?:the )?(?:terms of (?:the )?)?{name}", 0.9, "subject to"),
    (r"(?:under|see) (?:the )?(?:terms of (?:the )?)?{name}", 0.8, ""),
    (r"{name}(?: for (?:more )?details)?", 0.6, ""),
)


#: Hand-written identifiers of the SPDX list that follow "SPDX-License-Identifier:", as words.
SPDX = (
    ("mit", r"mit"),
    ("mit-0", r"mit 0"),
    ("apache-1.0", r"apache 1 0"),
    ("apache-1.1", r"apache 1 1"),
    ("apache-2.0", r"apache 2 0"),
    ("isc", r"isc"),
    ("zlib", r"zlib"),
    ("bsl-1.0", r"bsl 1 0"),
    ("postgresql", r"postgresql"),
    ("artistic-1.0", r"artistic 1 0(?: perl| cl8)?"),
    ("artistic-2.0", r"artistic 2 0"),
    ("ofl-1.0", r"ofl 1 0(?: no rfn| rfn)?"),
    ("ofl-1.1", r"ofl 1 1(?: no rfn| rfn)?"),
    ("ms-pl", r"ms pl"),
    ("ms-rl", r"ms rl"),
    ("0bsd", r"0bsd"),
    ("bsd-1-clause", r"bsd 1 clause"),
    ("bsd-2-clause", r"bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", r"bsd 3 clause(?: clear| lbnl| attribution)?"),
    ("bsd-4-clause", r"bsd 4 clause(?: uc)?"),
    ("gpl-1.0", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-1.0", r"agpl 1 0(?: only| or later)?"),
    ("agpl-3.0", r"agpl 3 0(?: only| or later)?"),
    ("gfdl", r"gfdl 1 [123](?: no invariants| invariants)?(?: only| or later)?"),
    ("mpl-1.0", r"mpl 1 0"),
    ("mpl-1.1", r"mpl 1 1"),
    ("mpl-2.0", r"mpl 2 0(?: no copyleft exception)?"),
    ("epl-1.0", r"epl 1 0"),
    ("epl-2.0", r"epl 2 0"),
    ("eupl", r"eupl 1 [012]"),
    ("cddl", r"cddl 1 [01]"),
    ("cpl-1.0", r"cpl 1 0"),
    ("ipl-1.0", r"ipl 1 0"),
    ("cecill", r"cecill(?: 1 [01]| 2 [01]| b| c)?"),
    ("ecl-2.0", r"ecl 2 0"),
    ("afl-3.0", r"afl 3 0"),
    ("osl-3.0", r"osl 3 0"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl"),
    ("cc0-1.0", r"cc0 1 0"),
    ("cc-by-1.0", r"cc by 1 0"),
    ("cc-by-2.0", r"cc by 2 0"),
    ("cc-by-2.5", r"cc by 2 5"),
    ("cc-by-3.0", r"cc by 3 0"),
    ("cc-by-4.0", r"cc by 4 0"),
    ("cc-by-sa", r"cc by sa [1-4] [05]"),
    ("cc-by-nc", r"cc by nc [1-4] [05]"),
    ("cc-by-nd", r"cc by nd [1-4] [05]"),
    ("cc-by-nc-sa", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", r"cc by nc nd [1-4] [05]"),
    ("odbl", r"odbl 1 0"),
    ("odc-by", r"odc by 1 0"),
    ("pddl", r"pddl 1 0"),
    ("python-2.0", r"(?:python 2 0|psf 2 0)"),
    ("ncsa", r"ncsa"),
    ("upl-1.0", r"upl 1 0"),
    ("vim", r"vim"),
    ("x11", r"x11"),
    ("curl", r"curl"),
    ("openssl", r"openssl"),
    ("php-3.01", r"php 3 01"),
    ("ruby", r"ruby"),
    ("w3c", r"w3c"),
    ("zpl-2.1", r"zpl 2 1"),
    ("mulanpsl-2.0", r"mulanpsl 2 0"),
    ("blueoak-1.0.0", r"blueoak 1 0 0"),
    ("bzip2", r"bzip2 1 0 6"),
    ("libpng", r"libpng(?: 2 0)?"),
    ("ftl", r"ftl"),
    ("hpnd", r"hpnd"),
    ("icu", r"icu"),
    ("ijg", r"ijg"),
    ("json", r"json"),
    ("lppl-1.3c", r"lppl 1 3c"),
    ("nasa-1.3", r"nasa 1 3"),
    ("qpl-1.0", r"qpl 1 0"),
    ("sleepycat", r"sleepycat"),
    ("sspl-1.0", r"sspl 1 0"),
    ("tcl", r"tcl"),
    ("unicode-dfs", r"unicode dfs 201[56]"),
    ("beerware", r"beerware"),
    ("busl-1.1", r"busl 1 1"),
    ("elastic-2.0", r"elastic 2 0"),
)

#: Hand-written variants of names and addresses of license texts: label, pattern, keyword.
VARIANTS = (
    ("mit", r"mit licen[sc]ed", "mit"),
    ("mit", r"(?:the )?expat licen[sc]e", "expat"),
    ("isc", r"(?:the )?(?:internet (?:systems|software) consortium|isc style) licen[sc]e", "licen"),
    ("zlib", r"zlib libpng licen[sc]e", "zlib"),
    ("apache-2.0", r"(?:asl|al) ?2 0 licen[sc]e", "licen"),
    ("apache-2.0", r"apache org licenses licen[sc]e 2 0", "apache"),
    ("apache", r"apache licen[sc]ed", "apache"),
    ("bsd", r"bsd licen[sc]ed", "bsd"),
    ("bsl-1.0", r"boost org licen[sc]e 1 0", "boost"),
    ("gpl-2.0", r"gnu org licenses (?:old licenses )?gpl 2 0", "gnu"),
    ("gpl-3.0", r"gnu org licenses gpl 3 0", "gnu"),
    ("gpl", r"gpl(?:ed|d| licen[sc]ed| compatible licen[sc]e)", "gpl"),
    ("gpl-2.0", r"gplv2(?: or later)?", "gplv2"),
    ("gpl-3.0", r"gplv3(?: or later)?", "gplv3"),
    ("lgpl-2.1", r"lgplv2 1(?: or later)?", "lgplv2"),
    ("lgpl-3.0", r"lgplv3(?: or later)?", "lgplv3"),
    ("agpl-3.0", r"agplv3(?: or later)?", "agplv3"),
    ("mpl-2.0", r"mplv2(?: 0)?", "mplv2"),
    ("mpl-2.0", r"mozilla org mpl 2 0", "mozilla org"),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", "creativecommons"),
    ("cc-by-4.0", r"creativecommons org licenses by 4 0", "creativecommons"),
    ("cc-by-3.0", r"creativecommons org licenses by 3 0", "creativecommons"),
    ("cc-by-sa", r"creativecommons org licenses by sa [1-4] [05]", "creativecommons"),
    ("cc-by-nc", r"creativecommons org licenses by nc [1-4] [05]", "creativecommons"),
    ("cc-by-nd", r"creativecommons org licenses by nd [1-4] [05]", "creativecommons"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa [1-4] [05]", "creativecommons"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd [1-4] [05]", "creativecommons"),
    ("unlicense", r"unlicense org", "unlicense"),
    ("ofl-1.1", r"scripts sil org ofl", "scripts sil org"),
    ("ofl-1.1", r"sil ofl(?: version)?(?: 1 1)?", "sil ofl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", "microsoft"),
    ("python-2.0", r"psf licen[sc]e(?: agreement)?", "psf"),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", "ncsa"),
    ("cpl-1.0", r"common public licen[sc]e(?: version)? v?1 0", "common public"),
    ("osl-3.0", r"open software licen[sc]e(?: version)? v?3 0", "open software"),
    ("afl-3.0", r"academic free licen[sc]e(?: version)? v?3 0", "academic free"),
    ("ecl-2.0", r"educational community licen[sc]e(?: version)? 2 0", "educational community"),
    ("upl-1.0", r"universal permissive licen[sc]e", "universal permissive"),
    ("sspl-1.0", r"server side public licen[sc]e", "server side"),
    ("busl-1.1", r"business source licen[sc]e", "business source"),
    ("elastic-2.0", r"elastic licen[sc]e(?: 2 0)?", "elastic"),
    ("php-3.01", r"php licen[sc]e(?: version)? 3 01", "php"),
    ("openssl", r"openssl licen[sc]e", "openssl"),
    ("ruby", r"ruby licen[sc]e", "ruby"),
    ("vim", r"vim licen[sc]e", "vim"),
    ("lppl-1.3c", r"latex project public licen[sc]e", "latex"),
    ("cecill", r"cecill(?: [abc])? licen[sc]e", "cecill"),
    ("mulanpsl-2.0", r"mulan psl ?v?2 licen[sc]e", "mulan"),
    ("w3c", r"w3c software (?:notice and )?licen[sc]e", "w3c"),
    ("odc-by", r"open data commons attribution licen[sc]e", "open data commons"),
    ("pddl", r"public domain dedication and licen[sc]e", "public domain"),
    ("beerware", r"the beer ware licen[sc]e", "beer ware"),
)

#: Hand-written sentences from license texts and headers, which often go without a name: label, pattern,
#: weight, keyword.
BODIES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.9, "permission is hereby granted"),
    ("mit", r"permission is hereby granted free of charge", 0.7, "permission is hereby granted"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.9, "permission notice"),
    ("mit", r"to use copy modify merge publish distribute sublicense and or sell copies of the software", 0.9, "merge publish distribute"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0.95, "permission is hereby granted"),
    ("ofl-1.1", r"permission is hereby granted free of charge to any person obtaining a copy of the font software", 0.95, "permission is hereby granted"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.9, "permission to use copy"),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 0.9, "permission to use copy"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose", 0.85, "permission to use copy"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 0.95, "permission to use copy"),
    ("bsd", r"redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted provided that the following conditions are met)?", 0.85, "redistribution and use"),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.85, "redistributions of source"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", 0.85, "redistributions in binary"),
    ("bsd-3-clause", r"neither the names? of .{1,120}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products", 0.9, "endorse or promote products"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.9, "all advertising materials"),
    ("apache-2.0", r"you may not use this (?:file|work|software) except in compliance with the licen[sc]e", 0.85, "except in compliance"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", 0.85, "unless required by applicable law"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", 0.7, "apache software foundation"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 0.9, "free software"),
    ("gpl", r"this program is free software you can redistribute it and or modify it", 0.7, "free software"),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e", 0.85, "you should have received a copy"),
    ("gpl-2.0", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation (?:either )?version 2", 0.95, "free software"),
    ("gpl-3.0", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation (?:either )?version 3", 0.95, "free software"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 0.85, "you should have received a copy"),
    ("lgpl", r"this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", 0.9, "free software"),
    ("lgpl-2.1", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 2 1", 0.95, "free software"),
    ("lgpl-3.0", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 3", 0.95, "free software"),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[sc]e", 0.85, "you should have received a copy"),
    ("agpl-3.0", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation (?:either )?version 3", 0.95, "free software"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 0.95, "permission is granted to copy"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 0.95, "this source code form"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one", 0.9, "copy of the mpl"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 0.95, "contents of this file are subject"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 0.95, "contents of this file are subject"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v ?1 0", 0.95, "accompanying materials"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v ?2 0", 0.95, "accompanying materials"),
    ("eupl", r"licensed under the eupl version 1 [012]", 0.95, "eupl"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.9, "without any express or implied warranty"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.9, "altered source versions"),
    ("zlib", r"the origin of this software must not be misrepresented", 0.85, "must not be misrepresented"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 0.95, "unencumbered software"),
    ("wtfpl", r"you just do what the fuck you want to", 0.9, "what the fuck you want to"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", 0.95, "what the fuck you want to"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", 0.9, "whatever you want with this stuff"),
    ("cc0-1.0", r"(?:has|have) waived all copyright and related or neighboring rights", 0.9, "neighboring rights"),
    ("public-domain", r"(?:has been|is) (?:dedicated to|placed in|released into) the public domain", 0.8, "public domain"),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed preamble this licen[sc]e establishes the terms", 0.9, "everyone is permitted to copy"),
    ("ms-pl", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software", 0.85, "bring a patent claim"),
    ("json", r"the software shall be used for good not evil", 0.95, "used for good not evil"),
    ("openssl", r"this product includes software developed by the openssl project", 0.9, "openssl"),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited", 0.85, "unauthorized copying"),
    ("proprietary", r"this (?:software|document|file) contains (?:confidential|proprietary and confidential) information", 0.8, "confidential"),
)

#: Priorities of the three, among those of FORMS.
_SPDX_PRIORITY, _BODY_PRIORITY, _VARIANT_PRIORITY = 0, 1, 5


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    pattern: re.Pattern
    weight: float
    gates: tuple[str, ...]


def rules() -> list[Rule]:
    """All rules: each form in the order of NAMES, then the signatures without a form."""
    out = []
    for k, (form, weight, form_gate) in enumerate(FORMS):
        for label, name, gate in NAMES:
            pattern = re.compile(r"(?<= )" + form.format(name=f"(?:{name})") + r"(?= )")
            gates = tuple(g for g in (form_gate, gate) if g)
            out.append(Rule(k, label, pattern, weight, gates))
    marked, weight, gate = FORMS[_SPDX_PRIORITY]
    signatures = [(_SPDX_PRIORITY, label, marked.format(name=name), weight, gate) for label, name in SPDX]
    # a second licence of an SPDX expression
    after = r"(?:[0-9]|clause|only|later|mit|isc|zlib) (?:or|and) "
    signatures += [(_SPDX_PRIORITY, label, after + label, weight, gate) for label in ("mit", "isc", "zlib")]
    signatures += [(_BODY_PRIORITY, *body) for body in BODIES]
    weight = FORMS[_VARIANT_PRIORITY][1]
    signatures += [(_VARIANT_PRIORITY, label, name, weight, gate) for label, name, gate in VARIANTS]
    for k, label, name, weight, gate in signatures:
        out.append(Rule(k, label, re.compile(rf"(?<= )(?:{name})(?= )"), weight, (gate,)))
    return out


#: A text is only looked at closely if it holds one of these.
CORE = (
    "licen", "gpl", "gfdl", " mpl ", " epl ", "eupl", "cddl", "odbl", "rail", "bsd", "apache 2", "cc ", "cc0",
    "creative commons", "public domain", "proprietary", "copyright", "all rights reserved",
    "derechos reservados", "droits réservés", "rechte vorbehalten", "wtfpl",
)
# ... or the keyword of a signature in which "licen" and all of these may be missing
CORE += tuple(
    sorted(
        {
            gate
            for _, pattern, *_, gate in (*VARIANTS, *BODIES)
            if "licen" not in pattern and not any(c in gate for c in CORE)
        }
    )
)


class Scanner:
    """Rules, their keyword automaton, and the base phrases."""

    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.core = [c.encode() for c in CORE]
        self.automaton = ahocorasick.Automaton()
        for gate in sorted({g for r in self.rules for g in r.gates}):
            self.automaton.add_word(gate, gate)
        self.automaton.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, priority, rule) of all rules in words joined by blanks, ends included."""
        present = {gate for _, gate in self.automaton.iter(text)}
        out = []
        for number, rule in enumerate(self.rules):
            if present.issuperset(rule.gates):
                out += [(m.start(), m.end(), rule.priority, number) for m in rule.pattern.finditer(text)]
        return out


def survivors(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections that no other holds with a higher priority, or with more text at the same one."""
    starts = sorted({one[0] for one in found})
    # a Fenwick tree: the furthest end of the better ones that start at or before a place
    furthest = [0] * (len(starts) + 1)
    out: list[tuple[int, int, int, int]] = []
    # best first: whatever is suppressed is suppressed by one that stays
    for one in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[3], d[0])):
        start, end = one[:2]
        at = place = bisect_right(starts, start)
        reach = 0
        while at:
            reach = max(reach, furthest[at])
            at &= at - 1
        if end <= reach:
            continue
        out.append(one)
        while place < len(furthest):
            furthest[place] = max(furthest[place], end)
            place += place & -place
    return out


def _places(text: bytes, phrase: bytes) -> list[int]:
    """Byte places of a phrase between blanks."""
    out, at = [], text.find(phrase)
    while at >= 0:
        out.append(at)
        at = text.find(phrase, at + 1)
    return out


def _numbers(text, blank, places: list[int]) -> dict[int, int]:
    """The number of blanks before each place, in one pass over the text."""
    out, n, at = {}, 0, 0
    for place in sorted(set(places)):
        n += text.count(blank, at, place)
        out[place], at = n, place
    return out


def detect(text: bytes, scanner: Scanner) -> list[tuple[str, int, int, float, bool]]:
    """(label, start, end, weight, base) of what is found in words joined by blanks, ends included.

    Spans are [start, end) in words.
    """
    out = []
    for phrase, label in BASE:
        places = _places(text, f" {phrase} ".encode())
        numbers, n = _numbers(text, b" ", places), len(phrase.split())
        out += [(label, numbers[x], numbers[x] + n, BASE_WEIGHT, True) for x in places]
    decoded = text.decode("utf-8", "replace")
    left = survivors(scanner.detections(decoded))
    numbers = _numbers(decoded, " ", [place for a, b, _, _ in left for place in (a, b)])
    for a, b, _, number in left:
        rule = scanner.rules[number]
        out.append((rule.label, numbers[a] - 1, numbers[b], rule.weight, False))
    return sorted(out, key=lambda d: (d[1], d[2], d[0], d[4]))


def judge(raw: bytes, scanner: Scanner) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of UTF-8.

    All but n_words is derived from the detections.
    """
    words = raw.translate(FOLDED).split()
    text = b" " + b" ".join(words) + b" "
    if not words or not any(core in text for core in scanner.core):
        return len(words), 0, None, None, "", "", 0.0, []
    found = detect(text, scanner)
    starts = [start for _, start, _, _, base in found if base]
    base_labels = {label for label, _, _, _, base in found if base}
    weights: dict[str, float] = {}
    for label, _, _, weight, _ in found:
        weights[label] = max(weights.get(label, 0.0), weight)
    score = 1.0 - float(np.prod([1.0 - weights[label] for label in sorted(weights)])) if weights else 0.0
    first, last = (min(starts), max(starts)) if starts else (None, None)
    labels = ",".join(sorted(base_labels)), ",".join(sorted(weights))
    return len(words), len(starts), first, last, *labels, score, found


_FOUND = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)
_NAMES = [part.split()[0] for part in _FOUND.split(", ")]
_SPAN = ("label", "start", "end", "weight", "base")
_SPANS = pa.list_(
    pa.struct(list(zip(_SPAN, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)))
)
_KINDS = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), _SPANS]
_DETECTIONS = "detections array<struct<label: string, start: bigint, end: bigint, weight: double, base: boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        texts = batch[1].cast(pa.binary())
        rows = [judge(x.as_py() or b"", scanner) for x in texts]
        rows = [(*r[:-1], [dict(zip(_SPAN, d, strict=True)) for d in r[-1]]) for r in rows]
        columns = [batch[0]]
        columns += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS[1:])]
        yield pa.RecordBatch.from_arrays(columns, names=[*_NAMES, "detections"])


def licenses(docs: DataFrame) -> DataFrame:
    """A row per row of `docs` (doc_id and text): counts, word places, labels, score and detections.

    Detections are sorted spans of words, [start, end), with label and weight; the rest derives from them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan, f"{_FOUND}, {_DETECTIONS}")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
