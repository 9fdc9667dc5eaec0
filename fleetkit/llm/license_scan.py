r"""License scan: ordered signature rules over the words of a text.

A text is read as its words in small letters, joined by single spaces, so a rule
does not depend on punctuation or line breaks.  A rule is a regular expression with a
label, a priority and keywords; it runs only on texts that hold one of its
keywords as a word, and a text without any keyword is not looked at again.
Overlapping detections are resolved in two steps: one that lies within another
one's interval goes (of equal intervals the one of lower priority), then one that
overlaps a neighbour of higher priority goes.  Everything here is DataFrame
functions; no Python runs on the executors.

Rules in order of priority: sentences of the licenses themselves, SPDX
identifiers, statements ("licensed under ..."), web addresses, the contract's
phrases, bare names; within each kind in the order they are listed below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetkit.llm.common import keep, prepare, table, with_row_key

# What separates words, and the contract's phrases.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

L = r"licen[sc]es?"                                       # license, licence and their plurals
V = r"(?:v|ver|version) ?"                                # "v 2", "v2", "version 2"
ZERO = r"(?: 0)?"
LATER = r"(?: only| or later| or any later version)?"
CC = r"(?:cc|creative commons)(?: attribution)?"
CC_END = r"(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?"
GNU = r"(?:gnu )?"

#: label -> (keywords, names, SPDX identifier, web address); the order is the priority within a kind.
LICENSES: dict[str, tuple[tuple[str, ...], list[str], str | None, str | None]] = {
    "agpl-3": (("agpl", "agpl3", "agplv3", "affero"), [rf"{GNU}affero general public {L}(?: {V}3{ZERO})?", rf"{GNU}agpl ?(?:v ?)?3{ZERO}{LATER}", rf"agplv3\+?{LATER}"], rf"agpl 3 0{LATER}", "gnu org licenses agpl(?: 3 0)?"),
    "lgpl-2.1": (("lgpl", "lgpl2", "lgplv2", "lesser"), [rf"{GNU}lesser general public {L} {V}2 1", rf"{GNU}lgpl ?(?:v ?)?2 1{LATER}", rf"lgplv2 1{LATER}"], rf"lgpl 2 1{LATER}", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    "lgpl-2": (("lgpl", "lgpl2", "lgplv2", "library"), [rf"{GNU}library general public {L}(?: {V}2{ZERO})?", rf"{GNU}lgpl ?(?:v ?)?2{ZERO}{LATER}", "lgplv2"], rf"lgpl 2 0{LATER}", "gnu org licenses (?:old licenses )?lgpl 2 0"),
    "lgpl-3": (("lgpl", "lgpl3", "lgplv3", "lesser"), [rf"{GNU}lesser general public {L} {V}3{ZERO}", rf"{GNU}lgpl ?(?:v ?)?3{ZERO}{LATER}", "lgplv3"], rf"lgpl 3 0{LATER}", "gnu org licenses lgpl 3 0"),
    "lgpl": (("lgpl", "lesser"), [rf"{GNU}lesser general public {L}", rf"(?:gnu )?lgpl(?: {L})?"], None, "gnu org licenses lgpl"),
    "gfdl": (("gfdl", "documentation"), [rf"gnu free documentation {L}(?: {V}1 [123])?", r"gfdl(?: 1 [123])?"], rf"gfdl 1 [123]{LATER}", "gnu org licenses fdl"),
    "gpl-2": (("gpl", "gpl2", "gplv2", "general"), [rf"{GNU}general public {L} {V}2{ZERO}{LATER}", rf"{GNU}gpl ?(?:v ?)?2{ZERO}{LATER}", rf"gplv2{LATER}"], rf"gpl 2 0{LATER}", "gnu org licenses (?:old licenses )?gpl 2 0"),
    "gpl-3": (("gpl", "gpl3", "gplv3", "general"), [rf"{GNU}general public {L} {V}3{ZERO}{LATER}", rf"{GNU}gpl ?(?:v ?)?3{ZERO}{LATER}", rf"gplv3{LATER}"], rf"gpl 3 0{LATER}", "gnu org licenses gpl 3 0"),
    "gpl-1": (("gpl", "gpl1", "general"), [rf"{GNU}general public {L} {V}1{ZERO}{LATER}", rf"gnu gpl ?(?:v ?)?1{ZERO}"], rf"gpl 1 0{LATER}", None),
    "gpl": (("gpl", "general"), [rf"(?:gnu )?general public {L}", rf"gnu gpl|gpl {L}"], None, "gnu org licenses gpl"),
    "apache-1.1": (("apache",), [rf"apache (?:software )?{L} (?:{V})?1 1", r"apache 1 1"], r"apache 1 1", "apache org licenses license 1 1"),
    "apache-2": (("apache", "apl", "apl2"), [rf"apache (?:software )?{L} (?:{V})?2{ZERO}", rf"apache (?:v ?)?2(?: 0)?(?: {L})?", r"apl ?2 0"], r"apache 2 0", "apache org licenses license 2 0"),
    "apache": (("apache", "asl"), [rf"apache (?:software )?{L}", r"asl 2 0"], None, "apache org licenses"),
    "bsd-4": (("bsd",), [rf"(?:4 clause|four clause|original) bsd(?: {L})?", rf"bsd 4 clause(?: {L})?"], r"bsd 4 clause", "opensource org licenses bsd 4 clause"),
    "bsd-3": (("bsd",), [rf"(?:3 clause|three clause|new|modified|revised) bsd(?: {L})?", rf"bsd 3 clause(?: {L})?"], r"bsd 3 clause", "opensource org licenses bsd 3 clause"),
    "bsd-2": (("bsd", "freebsd"), [rf"(?:2 clause|two clause|simplified) bsd(?: {L})?", rf"bsd 2 clause(?: {L})?", rf"freebsd {L}"], r"bsd 2 clause", "opensource org licenses bsd 2 clause"),
    "bsd-0": (("bsd", "0bsd"), [rf"(?:zero|0) clause bsd(?: {L})?", rf"0bsd(?: {L})?"], r"0bsd", "opensource org licenses 0bsd"),
    "bsd": (("bsd",), [rf"bsd(?: style)? {L}", r"berkeley software distribution license"], None, "opensource org licenses bsd"),
    "mit-0": (("attribution", "license", "licence", "licenses", "licences"), [rf"mit no attribution(?: {L})?", rf"mit 0 {L}"], r"mit 0", "opensource org licenses mit 0"),
    "x11": (("x11", "consortium"), [rf"x11 {L}", rf"mit x11 {L}", rf"x consortium {L}"], r"x11", None),
    "mit": (("license", "licence", "licenses", "licences", "expat"), [rf"mit {L}", rf"expat {L}", rf"mit expat {L}", r"the mit licence terms"], r"mit", "opensource org licenses? mit"),
    "isc": (("isc",), [rf"isc {L}", rf"internet systems consortium {L}"], r"isc", "opensource org licenses isc"),
    "mpl-1.1": (("mozilla", "mpl"), [rf"mozilla public {L} (?:{V})?1 1", r"mpl (?:v ?)?1 1"], r"mpl 1 1", "mozilla org mpl 1 1"),
    "mpl-2": (("mozilla", "mpl"), [rf"mozilla public {L} (?:{V})?2{ZERO}", r"mpl (?:v ?)?2 0"], r"mpl 2 0", "mozilla org (?:en us )?mpl 2 0"),
    "mpl": (("mozilla", "mpl"), [rf"mozilla public {L}", rf"mpl {L}"], None, "mozilla org mpl"),
    "epl-1": (("eclipse", "epl"), [rf"eclipse public {L} (?:{V})?1{ZERO}", r"epl (?:v ?)?1 0"], r"epl 1 0", "eclipse org legal epl v10"),
    "epl-2": (("eclipse", "epl"), [rf"eclipse public {L} (?:{V})?2{ZERO}", r"epl (?:v ?)?2 0"], r"epl 2 0", "eclipse org legal epl (?:2 0|v20)"),
    "epl": (("eclipse",), [rf"eclipse public {L}", rf"eclipse distribution {L}"], None, None),
    "cddl": (("cddl", "common"), [rf"common development and distribution {L}(?: (?:{V})?1 [01])?", r"cddl(?: 1 [01])?"], r"cddl 1 [01]", "opensource org licenses cddl"),
    "cpl": (("common", "ibm"), [rf"common public {L}(?: (?:{V})?1{ZERO})?", rf"ibm public {L}"], r"cpl 1 0", "opensource org licenses cpl"),
    "cpal": (("cpal", "common"), [rf"common public attribution {L}(?: (?:{V})?1{ZERO})?", r"cpal 1 0"], r"cpal 1 0", None),
    "eupl": (("eupl", "european"), [rf"european union public {L}(?: (?:{V})?1 [0-2])?", r"eupl(?: (?:v ?)?1 [0-2])?"], r"eupl 1 [0-2]", "joinup ec europa eu .{0,40}eupl"),
    "artistic-1": (("artistic",), [rf"artistic {L} (?:{V})?1{ZERO}", rf"perl artistic {L}"], r"artistic 1 0(?: perl)?", "opensource org licenses artistic 1"),
    "artistic-2": (("artistic",), [rf"artistic {L} (?:{V})?2{ZERO}", r"artistic 2 0"], r"artistic 2 0", "opensource org licenses artistic 2 0"),
    "artistic": (("artistic",), [rf"artistic {L}", rf"clarified artistic {L}"], None, "opensource org licenses artistic"),
    "boost": (("boost", "bsl"), [rf"boost software {L}(?: (?:{V})?1{ZERO})?", rf"boost {L}"], r"bsl 1 0", "boost org license 1 0"),
    "busl": (("business", "busl"), [rf"business source {L}(?: (?:{V})?1 1)?", r"busl 1 1"], r"busl 1 1", "mariadb com bsl11"),
    "sspl": (("server", "sspl"), [rf"server side public {L}(?: (?:{V})?1)?", r"sspl(?: (?:v ?)?1)?"], r"sspl 1 0", "mongodb com licensing server side public license"),
    "elastic-2": (("elastic",), [rf"elastic {L}(?: (?:{V})?2{ZERO})?", r"elastic license 2 0 elv2"], r"elastic 2 0", "elastic co licensing elastic license"),
    "zlib": (("zlib", "libpng"), [rf"zlib(?: libpng)? {L}", rf"libpng {L}"], r"zlib", "opensource org licenses zlib"),
    "unlicense": (("unlicense",), [r"the unlicense", r"unlicense license"], r"unlicense", "unlicense org"),
    "wtfpl": (("wtfpl",), [r"wtfpl(?: (?:v ?)?2)?", rf"do what the fuck you want to public {L}"], r"wtfpl", "wtfpl net"),
    "postgresql": (("postgresql",), [rf"postgresql {L}", rf"postgresql global development group {L}"], r"postgresql", "opensource org licenses postgresql"),
    "python-2": (("python", "psf"), [rf"python software foundation {L}(?: (?:{V})?2)?", rf"psf {L}(?: agreement)?", rf"python {L} 2 0"], r"(?:psf|python) 2 0", "python org psf license"),
    "php": (("php",), [rf"php {L}(?: (?:{V})?3 0(?:1| 1)?)?", r"php license 3 01"], r"php 3 01?", "php net license"),
    "ruby": (("ruby",), [rf"ruby {L}", r"same terms as ruby"], r"ruby", None),
    "openssl": (("openssl", "ssleay"), [rf"openssl(?: ssleay)? {L}", rf"ssleay {L}"], r"openssl", "openssl org source license"),
    "ofl": (("ofl", "sil"), [rf"sil open font {L}(?: (?:{V})?1 [01])?", r"ofl 1 [01]"], r"ofl 1 [01]", "scripts sil org ofl"),
    "ms-pl": (("microsoft",), [rf"microsoft public {L}(?: ms pl)?", rf"microsoft limited public {L}"], r"ms pl", "opensource org licenses ms pl"),
    "ms-rl": (("microsoft",), [rf"microsoft reciprocal {L}(?: ms rl)?", rf"shared source reciprocal {L}"], r"ms rl", "opensource org licenses ms rl"),
    "upl": (("universal", "upl"), [rf"universal permissive {L}(?: (?:{V})?1{ZERO})?", r"upl 1 0"], r"upl 1 0", "opensource org licenses upl"),
    "ncsa": (("ncsa",), [rf"university of illinois ncsa open source {L}", rf"ncsa {L}"], r"ncsa", "opensource org licenses ncsa"),
    "w3c": (("w3c",), [rf"w3c software(?: notice and)? {L}", rf"w3c document {L}"], r"w3c", "w3 org consortium legal"),
    "afl-3": (("academic", "afl"), [rf"academic free {L}(?: (?:{V})?[123] [01])?", r"afl 3 0"], r"afl 3 0", "opensource org licenses afl"),
    "osl-3": (("osl", "open"), [rf"open software {L} (?:{V})?[123] [01]", r"osl 3 0"], r"osl 3 0", "opensource org licenses osl"),
    "qpl": (("qpl", "public"), [rf"q public {L}(?: (?:{V})?1{ZERO})?", r"qpl 1 0"], r"qpl 1 0", None),
    "llama": (("llama",), [rf"llama [234](?: [0-9])? community {L}", rf"meta llama {L}"], None, "llama meta com .{0,20}license"),
    "openrail": (("openrail", "rail"), [rf"(?:creativeml |bigscience |bigcode )?open ?rail(?: [ms])?(?: {L})?", rf"bigscience rail {L}"], r"openrail", "licenses ai"),
    "odbl": (("odbl", "database"), [rf"open database {L}(?: (?:{V})?1{ZERO})?", rf"open data commons open database {L}", r"odbl(?: 1 0)?"], r"odbl 1 0", "opendatacommons org licenses odbl"),
    "odc-by": (("odc", "commons"), [rf"open data commons attribution {L}(?: (?:{V})?1{ZERO})?", r"odc by(?: 1 0)?"], r"odc by 1 0", "opendatacommons org licenses by"),
    "pddl": (("pddl", "commons"), [rf"public domain dedication and {L}", r"pddl(?: 1 0)?"], r"pddl 1 0", "opendatacommons org licenses pddl"),
    "cdla": (("cdla", "community"), [rf"community data {L} agreement", r"cdla (?:permissive|sharing)(?: [12] 0)?"], r"cdla (?:permissive|sharing) [12] 0", "cdla (?:io|dev)"),
    "ogl": (("government", "ogl"), [rf"open government {L}(?: (?:{V})?[123](?: 0)?)?", r"ogl (?:uk )?[123] 0"], r"ogl uk [123] 0", "nationalarchives gov uk doc open government licence"),
    "cc-by-nc-nd": (("cc", "creative"), [rf"{CC} (?:by nc nd|non ?commercial no ?deriv(?:ative)?s?){CC_END}", r"cc by nc nd"], r"cc by nc nd [1-4] [05]", "creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    "cc-by-nc-sa": (("cc", "creative"), [rf"{CC} (?:by nc sa|non ?commercial share ?alike){CC_END}", r"cc by nc sa"], r"cc by nc sa [1-4] [05]", "creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    "cc-by-nc": (("cc", "creative"), [rf"{CC} (?:by nc|non ?commercial){CC_END}", r"cc by non ?commercial"], r"cc by nc [1-4] [05]", "creativecommons org licenses by nc(?: [1-4] [05])?"),
    "cc-by-nd": (("cc", "creative"), [rf"{CC} (?:by nd|no ?deriv(?:ative)?s?){CC_END}", r"cc by no ?derivs"], r"cc by nd [1-4] [05]", "creativecommons org licenses by nd(?: [1-4] [05])?"),
    "cc-by-sa": (("cc", "creative"), [rf"{CC} (?:by sa|share ?alike){CC_END}", r"cc by share ?alike"], r"cc by sa [1-4] [05]", "creativecommons org licenses by sa(?: [1-4] [05])?"),
    "cc0": (("cc0", "cc", "creative"), [r"cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", r"(?:cc|creative commons) (?:0|zero)(?: 1 0)?(?: universal)?"], r"cc0 1 0", "creativecommons org publicdomain zero(?: 1 0)?"),
    "cc-pdm": (("creative", "mark"), [r"creative commons public domain mark(?: 1 0)?", r"public domain mark 1 0"], r"cc pdm 1 0", "creativecommons org publicdomain mark(?: 1 0)?"),
    "cc-by": (("cc", "creative"), [rf"{CC} by{CC_END}", rf"creative commons attribution{CC_END}"], r"cc by [1-4] [05]", "creativecommons org licenses by(?: [1-4] [05])?"),
    "cc": (("creative",), [rf"creative commons {L}", r"some rights reserved creative commons"], None, "creativecommons org licenses"),
    "public-domain": (("domain",), [r"(?:released |placed |dedicated |is )(?:in|into|to) the public domain", r"no rights reserved public domain"], None, None),
    "proprietary": (("reserved", "proprietary", "confidential"), [r"copyright (?:\S+ ){0,8}all rights reserved", r"all rights reserved (?:no part of|unauthorized|do not)", rf"proprietary (?:software )?{L}", r"proprietary and confidential"], None, None),
}

#: Sentences of the licenses themselves: (label, keyword, expression).
SENTENCES: list[tuple[str, str, str]] = [
    ("agpl-3", "affero", r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3", "affero", r"gnu affero general public license version 3 19 november 2007"),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl-3", "lesser", r"gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license version 2 1 february 1999"),
    ("gpl-3", "general", r"gnu general public license version 3 29 june 2007"),
    ("gpl-2", "general", r"gnu general public license version 2 june 1991"),
    ("gpl-3", "general", r"gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?"),
    ("gpl-2", "general", r"gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?"),
    ("gpl", "general", r"you should have received a copy of the gnu general public license along with this (?:program|library|file)"),
    ("apache-2", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "apache", r"apache license version 2 0 january 2004"),
    ("apache-2", "conditions", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software (?:\S+ ){0,40}without restriction (?:\S+ ){0,30}and to permit persons to whom the software is furnished to do so the software is provided"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3", "endorse", r"neither the name of (?:\S+ ){1,12}nor the names of (?:its|their|the) contributors may be used to endorse or promote products"),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "common", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("boost", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate", r"we make this dedication for the benefit of the public at large"),
    ("postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("python-2", "python", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("ofl", "font", r"this font software is licensed under the sil open font license"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("artistic", "artistic", r"you can redistribute it and or modify it under the (?:same )?terms (?:of the artistic license|as perl itself)"),
    ("eupl", "european", r"licensed under the eupl (?:version )?1 [12] (?:or as soon they will be approved by the european commission)?"),
    ("wtfpl", "copy", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc0", "waive", r"to the extent possible under law (?:\S+ ){1,16}has waived all copyright"),
    ("cc-by", "creative", r"this work is licensed under (?:a|the) creative commons attribution (?:[1-4] [05] )?(?:international |unported )?license"),
    ("cc-by-sa", "creative", r"this work is licensed under (?:a|the) creative commons attribution share ?alike (?:[1-4] [05] )?(?:international |unported )?license"),
    ("cc-by-nc", "creative", r"this work is licensed under (?:a|the) creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international |unported )?license"),
    ("proprietary", "written", r"no part of this (?:publication|book|work|document) may be reproduced (?:\S+ ){0,20}without (?:the )?(?:prior )?written permission"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|document|material) (?:\S+ ){0,6}is strictly prohibited"),
]

#: How a statement begins: a verb and words that add nothing.
STATEMENT = (r"(?:(?:licen[sc]ed|released|distributed|published|available|provided|shared|offered|covered|governed|redistribute(?: it)?) "
             r"(?:under|by|with|to)|subject to|sous|unter|bajo|selon|gemäß)"
             r"(?: (?:the|a|an|terms|conditions|and|of|either|la|le|les|licence|licencia|der|einer|lizenz|los|términos)){0,7}")
#: Strength of each kind of rule, in order of priority.
KINDS = {"sentence": 1.0, "spdx": 1.0, "statement": 0.95, "address": 0.9, "phrase": 0.9, "name": 0.6}


def rules() -> list[dict]:
    """Every rule: id (its priority, 0 first), kind, label, keywords, pattern, strength, base."""
    out: dict[str, list[tuple]] = {k: [] for k in KINDS}
    out["sentence"] = [(label, (word,), text) for label, word, text in SENTENCES]
    for label, (words, names, spdx, address) in LICENSES.items():
        out["name"] += [(label, words, name) for name in names]
        out["statement"] += [(label, words, f"{STATEMENT} (?:{name})") for name in names]
        if spdx:
            out["spdx"].append((label, ("spdx",), f"spdx license identifier {spdx}"))
        if address:
            out["address"].append((label, (address.split()[0],), address))
    out["phrase"] = [(label, tuple(p.split()[-2:-1] if p.startswith("apache") else p.split()[:1] if p.startswith("cc") else p.split()[-1:]), p)
                     for p, label in PHRASES.items()]
    listed = [(kind, *rule) for kind in KINDS for rule in out[kind]]
    return [{"id": k, "kind": kind, "label": label, "keywords": list(words), "pattern": f"(?<= )(?:{text})(?= )",
             "strength": KINDS[kind], "base": kind == "phrase"} for k, (kind, label, words, text) in enumerate(listed)]


RULES = rules()


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def detections(rows: DataFrame) -> DataFrame:
    """``rows`` (rid, doc_id, text) with n_words and hits (rule, k, gap, words): every match of every rule whose
    keyword occurs, with the words between it and the same rule's match before.  One pass over the texts.

    ``lower`` also maps capitals beyond A-Z; none of them becomes a separator, and no rule depends on
    one that becomes a letter a-z."""
    listed = F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.array(*map(F.lit, r["keywords"])).alias("keywords"),
                                F.lit(r["pattern"]).alias("pattern")) for r in RULES])
    gate = F.array(*map(F.lit, sorted({w for r in RULES for w in r["keywords"]})))

    def matches(c: Column, r: Column) -> Column:
        return _let(F.regexp_extract_all(c, r["pattern"], F.lit(0)), lambda m: F.when(
            F.size(m) == 0, F.array().cast("array<struct<rule:int,k:int,gap:bigint,words:bigint>>")).otherwise(
            _let(F.split(c, r["pattern"], -1), lambda p: F.transform(m, lambda x, k: F.struct(
                r["id"].alias("rule"), k.cast("int").alias("k"), (_spaces(F.get(p, k)) - 1).alias("gap"),
                (_spaces(x) + 1).alias("words"))))))

    def scanned(c: Column) -> Column:
        found = lambda present: F.when(F.size(present) == 0, F.array().cast(
            "array<struct<rule:int,k:int,gap:bigint,words:bigint>>")).otherwise(F.flatten(F.transform(
                F.filter(listed, lambda r: F.arrays_overlap(r["keywords"], present)), lambda r: matches(c, r))))
        return F.struct((_spaces(c) - 1).alias("n_words"), _let(F.array_intersect(F.split(c, " "), gate), found).alias("hits"))

    framed = F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" "))
    return rows.select("rid", "doc_id", _let(F.regexp_replace(framed, GAP, " "), scanned).alias("x")).select("rid", "doc_id", "x.n_words", "x.hits")


def resolved(found: DataFrame) -> DataFrame:
    """Rows with hits -> one row per detection: rid, doc_id, n_words, rule, start, end (words), stays."""
    order = W.partitionBy("rid", "rule").orderBy("k")
    at = (found.select("rid", "doc_id", "n_words", F.explode("hits").alias("h")).select("rid", "doc_id", "n_words", "h.*")
          .withColumn("end", F.sum(F.col("gap") + F.col("words")).over(order))
          .withColumn("start", F.col("end") - F.col("words")))
    outer = W.partitionBy("rid").orderBy("start", F.desc("end"), "rule")
    at = at.withColumn("inside", F.coalesce(F.max("end").over(outer.rowsBetween(W.unboundedPreceding, -1)) >= F.col("end"), F.lit(False)))
    free = W.partitionBy("rid", "inside").orderBy("start", "end")
    before, behind = F.lag(F.struct("end", "rule")).over(free), F.lead(F.struct("start", "rule")).over(free)
    beaten = ((before["end"] > F.col("start")) & (before["rule"] < F.col("rule"))) | (
        (behind["start"] < F.col("end")) & (behind["rule"] < F.col("rule")))
    return at.select("rid", "doc_id", "n_words", "rule", "start", "end",
                     (~F.col("inside") & ~F.coalesce(beaten, F.lit(False))).alias("stays"))


def scan(docs: DataFrame) -> DataFrame:
    """License labels of every row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base, first_word, last_word (null without the contract's phrases), base_labels,
    labels and score: the strength of the strongest detection that stays, 0 without any.  Null texts
    are empty; repeated rows (or ids) give a row each; further columns are not read.  No rows: none."""
    prepare(docs.sparkSession)
    rows = with_row_key(docs, ["doc_id", "text"], "license-rows")
    marked = keep(detections(rows.select("rid", "doc_id", F.col("text").cast("string").alias("text"))), "license-hits")
    by = lambda f, kind: F.element_at(F.array(*[F.lit(f(r)).cast(kind) for r in RULES]), F.col("rule") + 1)
    base, label = by(lambda r: r["base"], "boolean"), by(lambda r: r["label"], "string")
    strength = by(lambda r: r["strength"], "double")
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    some = (resolved(marked.where(F.size("hits") > 0))
            .select("*", base.alias("base"), label.alias("label"), strength.alias("strength"))
            .groupBy("rid", "doc_id", "n_words").agg(
                F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
                F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"), joined(F.col("base")).alias("base_labels"),
                joined(F.col("base") | F.col("stays")).alias("labels"),
                F.coalesce(F.max(F.when(F.col("base") | F.col("stays"), F.col("strength"))), F.lit(0.0)).alias("score")).drop("rid"))
    none = marked.where(F.size("hits") == 0).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"),
        F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"),
        F.lit(0.0).alias("score"))
    return some.unionByName(none)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of all ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
