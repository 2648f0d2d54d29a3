"""License detection by ordered signature rules, with DataFrame functions only.

A rule is a regular expression over the words of a text, with a label, a level (1: an SPDX tag
or sentence of a license's own text, 2: a grant, 3: a license by name, 4: a general remark)
and words that any match must hold. The distinct rule words a text holds choose the few rules
that are tried on it. To learn where a match stands, each word is written with its number
(``0:licensed 1:under``), so that a match begins with the number of its first word.

Matches of a text are sorted by start, longest first; one is suppressed if an interval of its
own or a stronger level, before it in this order, contains it. The sweep keeps
one furthest end per level. Nothing is shuffled: every text is decided in its row.

Defined cases: a null text is an empty one, with no word and no detection; every row is decided
by itself, whatever its doc_id; a label of a base phrase stays even where its match is
suppressed; a very long text is one row, and its task holds its words; ``detect`` replaces columns
that are named like its results and keeps all others.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from .support import fresh

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LICENSE = ("license", "licence", "licensed", "licenced", "licenses", "licences", "licensing")
#: Weight of the strongest kept detection of a text, by level.
WEIGHTS = (1.0, 0.9, 0.7, 0.4)
_BLOCK = 256


class Rule(NamedTuple):
    label: str
    level: int
    gate: tuple[str, ...]  # words of every match; * stands for any form of license
    pattern: str


#: Phrases whose places are counted as such: (phrase, label, gate).
BASE = (("cc by", "cc-by", "cc by"), ("general public license", "gpl", "general public license"), ("all rights reserved", "reserved", "all rights reserved"))

_L = "licen[sc]es?"
_V = "(?: version| ver)?(?: v)? v?"
_LATER = "(?: of the license)?(?: or(?: at your option)?(?: any)? later(?: version)?| or newer)"
_GNU = f"(?:gnu )?general public {_L}"
_LESSER = f"(?:gnu )?(?:lesser|library) general public {_L}"
_AFFERO = f"(?:gnu )?affero general public {_L}"
_CC = f"creative commons(?: public)?(?: {_L})?"

#: (label, gate, pattern of the name). Labels are SPDX identifiers in lower case where there is one.
NAMES = (
    ("apache-2.0", "apache", f"apache(?: software)?(?: {_L})?{_V}2(?: 0)?"),
    ("apache-1.1", "apache", f"apache(?: software)?(?: {_L})?{_V}1 1"),
    ("apache-1.0", "apache", f"apache(?: software)?(?: {_L})?{_V}1 0"),
    ("apache", "apache *", f"apache(?: software)? {_L}"),
    ("mit", "mit *", f"(?:mit|mit expat|mit x11|mit style) {_L}"),
    ("mit", "expat *", f"expat {_L}"),
    ("x11", "x11 *", f"x11 {_L}"),
    ("x11", "consortium *", f"x consortium {_L}"),
    ("mit-0", "mit attribution", f"mit no attribution(?: {_L})?"),
    ("bsd-2-clause", "bsd clause", f"(?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: {_L})?"),
    ("bsd-2-clause", "simplified bsd *", f"simplified bsd {_L}"),
    ("bsd-2-clause", "freebsd *", f"freebsd {_L}"),
    ("bsd-3-clause", "bsd clause", f"(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: {_L})?"),
    ("bsd-3-clause", "bsd *", f"(?:new|revised|modified) bsd {_L}"),
    ("bsd-4-clause", "bsd clause", f"(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: {_L})?"),
    ("bsd-4-clause", "original bsd *", f"original bsd {_L}"),
    ("0bsd", "0bsd", f"0bsd(?: {_L})?"),
    ("0bsd", "zero clause bsd", f"zero clause bsd(?: {_L})?"),
    ("bsd", "bsd *", f"bsd(?: style)? {_L}"),
    ("isc", "isc *", f"isc {_L}"),
    ("gpl-1.0", "general public *", f"{_GNU}{_V}1(?: 0)?"),
    ("gpl-2.0", "general public *", f"{_GNU}{_V}2(?: 0)?"),
    ("gpl-2.0-or-later", "general public *", f"{_GNU}{_V}2(?: 0)?{_LATER}"),
    ("gpl-3.0", "general public *", f"{_GNU}{_V}3(?: 0)?"),
    ("gpl-3.0-or-later", "general public *", f"{_GNU}{_V}3(?: 0)?{_LATER}"),
    ("gpl", "gnu general public *", f"gnu general public {_L}"),
    ("gpl-2.0", "gpl", f"(?:gnu )?gpl(?: {_L})?{_V}2(?: 0)?"),
    ("gpl-2.0", "gplv2", "(?:gnu )?gplv2(?: 0)?"),
    ("gpl-2.0-or-later", "gpl", f"(?:gnu )?gpl(?: {_L})?{_V}2(?: 0)?{_LATER}"),
    ("gpl-3.0", "gpl", f"(?:gnu )?gpl(?: {_L})?{_V}3(?: 0)?"),
    ("gpl-3.0", "gplv3", "(?:gnu )?gplv3(?: 0)?"),
    ("gpl-3.0-or-later", "gpl", f"(?:gnu )?gpl(?: {_L})?{_V}3(?: 0)?{_LATER}"),
    ("gpl", "gnu gpl", "gnu gpl"),
    ("gpl", "gpl *", f"gpl {_L}"),
    ("lgpl-2.0", "general public *", f"{_LESSER}{_V}2(?: 0)?"),
    ("lgpl-2.1", "general public *", f"{_LESSER}{_V}2 1"),
    ("lgpl-2.1-or-later", "general public *", f"{_LESSER}{_V}2 1{_LATER}"),
    ("lgpl-3.0", "general public *", f"{_LESSER}{_V}3(?: 0)?"),
    ("lgpl-3.0-or-later", "general public *", f"{_LESSER}{_V}3(?: 0)?{_LATER}"),
    ("lgpl", "general public *", _LESSER),
    ("lgpl-2.1", "lgpl", f"(?:gnu )?lgpl(?: {_L})?{_V}2 1"),
    ("lgpl-2.1", "lgplv2", "(?:gnu )?lgplv2 1"),
    ("lgpl-3.0", "lgpl", f"(?:gnu )?lgpl(?: {_L})?{_V}3(?: 0)?"),
    ("lgpl-3.0", "lgplv3", "(?:gnu )?lgplv3(?: 0)?"),
    ("lgpl", "lgpl", f"(?:gnu )?lgpl(?: {_L})?"),
    ("agpl-3.0", "affero general public *", f"{_AFFERO}{_V}3(?: 0)?"),
    ("agpl-3.0-or-later", "affero general public *", f"{_AFFERO}{_V}3(?: 0)?{_LATER}"),
    ("agpl", "affero general public *", _AFFERO),
    ("agpl-3.0", "agpl", f"(?:gnu )?agpl(?: {_L})?{_V}3(?: 0)?"),
    ("agpl-3.0", "agplv3", "(?:gnu )?agplv3(?: 0)?"),
    ("agpl", "agpl", f"(?:gnu )?agpl(?: {_L})?"),
    ("gfdl-1.2", "documentation *", f"(?:gnu )?free documentation {_L}{_V}1 2"),
    ("gfdl-1.3", "documentation *", f"(?:gnu )?free documentation {_L}{_V}1 3"),
    ("gfdl", "documentation *", f"(?:gnu )?free documentation {_L}"),
    ("gfdl", "gfdl", f"(?:gnu )?gfdl(?: {_L})?"),
    ("mpl-1.1", "mozilla public *", f"mozilla public {_L}{_V}1 1"),
    ("mpl-2.0", "mozilla public *", f"mozilla public {_L}{_V}2(?: 0)?"),
    ("mpl", "mozilla public *", f"mozilla public {_L}"),
    ("mpl-1.1", "mpl", f"mpl{_V}1 1"),
    ("mpl-2.0", "mpl", f"mpl{_V}2(?: 0)?"),
    ("epl-1.0", "eclipse public *", f"eclipse public {_L}{_V}1(?: 0)?"),
    ("epl-2.0", "eclipse public *", f"eclipse public {_L}{_V}2(?: 0)?"),
    ("epl", "eclipse public *", f"eclipse public {_L}"),
    ("epl-1.0", "epl", f"epl{_V}1(?: 0)?"),
    ("epl-2.0", "epl", f"epl{_V}2(?: 0)?"),
    ("edl-1.0", "eclipse distribution *", f"eclipse distribution {_L}(?:{_V}1 0)?"),
    ("cddl-1.0", "common development distribution *", f"common development (?:and )?distribution {_L}(?:{_V}1(?: 0)?)?"),
    ("cddl-1.1", "common development distribution *", f"common development (?:and )?distribution {_L}{_V}1 1"),
    ("cddl", "cddl", f"cddl(?: {_L})?"),
    ("cpl-1.0", "common public *", f"common public {_L}(?:{_V}1 0)?"),
    ("cpal-1.0", "attribution common public *", f"common public attribution {_L}(?:{_V}1 0)?"),
    ("ipl-1.0", "ibm public *", f"ibm public {_L}(?:{_V}1 0)?"),
    ("eupl-1.1", "eupl", f"eupl{_V}1 1"),
    ("eupl-1.2", "eupl", f"eupl{_V}1 2"),
    ("eupl", "european union public *", f"european union public {_L}"),
    ("cecill-2.1", "cecill", f"cecill(?: {_L})?{_V}2 1"),
    ("cecill-b", "cecill b", f"cecill b(?: {_L})?"),
    ("cecill-c", "cecill c", f"cecill c(?: {_L})?"),
    ("cecill", "cecill *", f"cecill {_L}"),
    ("artistic-1.0", "artistic *", f"artistic {_L}{_V}1(?: 0)?"),
    ("artistic-2.0", "artistic *", f"artistic {_L}{_V}2(?: 0)?"),
    ("artistic", "artistic *", f"(?:perl )?artistic {_L}"),
    ("bsl-1.0", "boost software *", f"boost software {_L}(?:{_V}1 0)?"),
    ("busl-1.1", "business source *", f"business source {_L}(?:{_V}1 1)?"),
    ("sspl-1.0", "server side public *", f"server side public {_L}(?:{_V}1)?"),
    ("elastic-2.0", "elastic *", f"elastic {_L}(?:{_V}2(?: 0)?)?"),
    ("psf-2.0", "python software foundation *", f"python software foundation {_L}(?:{_V}2)?"),
    ("python", "python *", f"python {_L}"),
    ("php-3.01", "php *", f"php {_L}(?:{_V}3 01)?"),
    ("ruby", "ruby *", f"ruby {_L}"),
    ("openssl", "openssl *", f"openssl {_L}"),
    ("zlib", "zlib *", f"zlib(?: libpng)? {_L}"),
    ("libpng", "libpng *", f"libpng {_L}"),
    ("curl", "curl *", f"curl {_L}"),
    ("ijg", "independent jpeg group", f"independent jpeg group(?: {_L})?"),
    ("icu", "icu *", f"icu {_L}"),
    ("unicode-dfs-2016", "unicode *", f"unicode(?: data files and software| inc)? {_L}(?: agreement)?"),
    ("ncsa", "ncsa *", f"(?:university of illinois )?ncsa(?: open source)? {_L}"),
    ("postgresql", "postgresql *", f"postgresql {_L}"),
    ("vim", "vim *", f"vim {_L}"),
    ("tcl", "tcl *", f"tcl(?: tk)? {_L}"),
    ("beerware", "beerware", f"beerware(?: {_L})?"),
    ("beerware", "beer ware *", f"beer ware {_L}"),
    ("wtfpl", "wtfpl", f"wtfpl(?: {_L})?"),
    ("wtfpl", "what the fuck you want public *", f"do what the fuck you want to public {_L}"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("ms-pl", "microsoft public *", f"microsoft public {_L}"),
    ("ms-rl", "microsoft reciprocal *", f"microsoft reciprocal {_L}"),
    ("osl-3.0", "open software *", f"open software {_L}(?:{_V}3(?: 0)?)?"),
    ("afl-3.0", "academic free *", f"academic free {_L}(?:{_V}3(?: 0)?)?"),
    ("ecl-2.0", "educational community *", f"educational community {_L}(?:{_V}2(?: 0)?)?"),
    ("upl-1.0", "universal permissive *", f"universal permissive {_L}(?:{_V}1(?: 0)?)?"),
    ("blueoak-1.0.0", "blue oak model *", f"blue oak model {_L}(?:{_V}1(?: 0){{0,2}})?"),
    ("mulanpsl-2.0", "mulan permissive software *", f"mulan permissive software {_L}(?:{_V}2)?"),
    ("ofl-1.1", "open font *", f"(?:sil )?open font {_L}(?:{_V}1 1)?"),
    ("odbl-1.0", "open database *", f"open database {_L}(?:{_V}1 0)?"),
    ("odbl-1.0", "odbl", f"odbl(?:{_V}1 0)?"),
    ("odc-by-1.0", "open data commons attribution *", f"open data commons attribution {_L}(?:{_V}1 0)?"),
    ("pddl-1.0", "public domain dedication *", f"public domain dedication (?:and )?{_L}(?:{_V}1 0)?"),
    ("cdla-permissive-2.0", "community data agreement permissive", f"community data {_L} agreement permissive(?:{_V}[12](?: 0)?)?"),
    ("openrail", "openrail", f"openrail(?: m)?(?: {_L})?"),
    ("openrail", "rail *", f"rail(?: m)? {_L}"),
    ("openrail", "responsible ai *", f"responsible ai {_L}"),
    ("llama", "llama community *", f"llama(?: [234])?(?: [0-9])? community {_L}(?: agreement)?"),
    ("cc0-1.0", "cc0", f"cc0(?:{_V}1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons zero", f"creative commons zero(?: {_L})?(?:{_V}1 0)?"),
    ("cc-by-1.0", "cc by", f"cc by{_V}1 0"),
    ("cc-by-2.0", "cc by", f"cc by{_V}2 0"),
    ("cc-by-2.5", "cc by", f"cc by{_V}2 5"),
    ("cc-by-3.0", "cc by", f"cc by{_V}3 0"),
    ("cc-by-4.0", "cc by", f"cc by{_V}4 0"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-sa-3.0", "cc by sa", f"cc by sa{_V}3 0"),
    ("cc-by-sa-4.0", "cc by sa", f"cc by sa{_V}4 0"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-nc-3.0", "cc by nc", f"cc by nc{_V}3 0"),
    ("cc-by-nc-4.0", "cc by nc", f"cc by nc{_V}4 0"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc-by-nd-4.0", "cc by nd", f"cc by nd{_V}4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", f"cc by nc sa{_V}4 0"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", f"cc by nc nd{_V}4 0"),
    ("cc-by", "creative commons attribution", f"{_CC} attribution(?: {_L})?"),
    ("cc-by-3.0", "creative commons attribution", f"{_CC} attribution(?: {_L})?{_V}3 0"),
    ("cc-by-4.0", "creative commons attribution", f"{_CC} attribution(?: {_L})?{_V}4 0"),
    ("cc-by-sa", "creative commons attribution", f"{_CC} attribution share ?alike(?: {_L})?"),
    ("cc-by-sa-3.0", "creative commons attribution", f"{_CC} attribution share ?alike(?: {_L})?{_V}3 0"),
    ("cc-by-sa-4.0", "creative commons attribution", f"{_CC} attribution share ?alike(?: {_L})?{_V}4 0"),
    ("cc-by-nc", "creative commons attribution", f"{_CC} attribution non ?commercial(?: {_L})?"),
    ("cc-by-nc-4.0", "creative commons attribution", f"{_CC} attribution non ?commercial(?: {_L})?{_V}4 0"),
    ("cc-by-nd", "creative commons attribution", f"{_CC} attribution no ?deriv(?:atives|s)(?: {_L})?"),
    ("cc-by-nc-sa", "creative commons attribution", f"{_CC} attribution non ?commercial share ?alike(?: {_L})?"),
    ("cc-by-nc-nd", "creative commons attribution", f"{_CC} attribution non ?commercial no ?deriv(?:atives|s)(?: {_L})?"),
)

#: (label, gate, sentence of the license's own text or notice)
TEXTS = (
    ("mit", "hereby granted charge obtaining", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "copyright permission notice substantial portions", "copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "permission fee hereby granted", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution source binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "redistributions source retain", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "neither endorse promote products", "neither the name of [^ ]+(?: [^ ]+){0,12} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising mentioning features", "all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "file compliance *", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless applicable law agreed writing", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("gpl", "redistribute modify gnu", f"free software you can redistribute it and or modify it under the terms of the gnu general public {_L}"),
    ("gpl", "hope useful warranty gnu", f"in the hope that it will be useful but without any warranty [^ ]+(?: [^ ]+){{0,16}} gnu general public {_L}"),
    ("gpl", "copy gnu general public along", f"you should have received a copy of the gnu general public {_L} along with this"),
    ("lgpl", "redistribute modify lesser", f"free software you can redistribute it and or modify it under the terms of the gnu lesser general public {_L}"),
    ("lgpl", "lesser general public received", f"you should have received a copy of the gnu lesser general public {_L}"),
    ("agpl", "redistribute modify affero", f"free software you can redistribute it and or modify it under the terms of the gnu affero general public {_L}"),
    ("mpl-2.0", "subject mozilla public source", f"source code form is subject to the terms of the mozilla public {_L} v ?2 0"),
    ("mpl-1.1", "contents mozilla subject", f"contents of this file are subject to the mozilla public {_L} version 1 1"),
    ("epl-2.0", "accompanying eclipse program", f"program and the accompanying materials are made available under the terms of the eclipse public {_L}(?: v)? ?2 0"),
    ("epl-1.0", "accompanying eclipse program", f"program and the accompanying materials are made available under the terms of the eclipse public {_L} v1 0"),
    ("cddl-1.0", "contents common development distribution", f"contents of this file are subject to the terms of the common development and distribution {_L}"),
    ("bsl-1.0", "boost distributed software", f"distributed under the boost software {_L} version 1 0"),
    ("unlicense", "unencumbered software domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "publish compile sell", "free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "changing allowed name", "changing it is allowed as long as the name is changed"),
    ("zlib", "express implied authors held liable", "provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "origin misrepresented", "origin of this software must not be misrepresented"),
    ("ofl-1.1", "font sil open", f"this font software is licensed under the sil open font {_L}"),
    ("gfdl", "no invariant sections", "no invariant sections"),
    ("cc0-1.0", "waived copyright related neighboring", "waived all copyright and related or neighboring rights"),
    ("cc-by", "creativecommons licenses by", "creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons licenses by sa", "creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons licenses by nc", "creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons licenses by nd", "creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons licenses by nc sa", "creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creativecommons licenses by nc nd", "creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc0-1.0", "creativecommons publicdomain zero", "creativecommons org publicdomain zero(?: 1 0)?"),
    ("apache-2.0", "apache org licenses", "apache org licenses license 2 0"),
    ("gpl", "gnu org licenses", "gnu org licenses(?: old licenses)? gpl(?: [23] 0)?"),
    ("mit", "opensource org licenses mit", "opensource org licenses mit"),
    ("beerware", "buy beer return", "you can buy me a beer in return"),
    ("json", "software good not evil", "software shall be used for good not evil"),
)

#: (label, gate, pattern) of remarks that name no license.
REMARKS = (
    ("public-domain", "public domain", "(?:in|into|to) the public domain"),
    ("public-domain", "public domain", "public domain (?:work|software|dedication|image|text)"),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]"),
    ("copyright", "copyright by", "copyright(?: c)?(?: (?:19|20)[0-9][0-9])? by [^ ]+"),
    ("reserved", "some rights reserved", "some rights reserved"),
    ("reserved", "rights reserved worldwide", "rights reserved worldwide"),
    ("proprietary", "proprietary confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "proprietary *", f"proprietary {_L}"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution)"),
    ("proprietary", "reproduced without permission", "may not be reproduced without(?: prior)?(?: written)? permission"),
    ("commercial", "commercial *", f"commercial {_L}"),
    ("non-commercial", "non commercial use only", "non commercial use only"),
    ("non-commercial", "noncommercial use only", "noncommercial use only"),
    ("eula", "end user agreement *", f"end user {_L} agreement"),
    ("open-source", "open source *", f"open source {_L}"),
    ("dual", "dual *", "dual licen[sc]ed"),
    ("copyleft", "copyleft", "copyleft"),
    ("as-is", "as is warranty", "as is without warranty"),
    ("as-is", "warranties merchantability", "warranties of merchantability"),
    ("see-license", "see file *", f"see(?: the)? {_L} file"),
    ("see-license", "found file *", f"{_L} that can be found in the {_L} file"),
)

_GRANT = "(?:licen[sc]ed|released|available|distributed|provided|published|offered|covered|redistributed|shared|governed)(?: to you)?(?: only)? (?:under|by|with|through)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?"


def rules() -> list[Rule]:
    """All rules in order; the base phrases come first."""
    found = [Rule(label, 4, tuple(gate.split()), phrase) for phrase, label, gate in BASE]
    for label in dict.fromkeys(x[0] for x in NAMES):
        tag = re.sub("[^0-9a-z]+", " ", label)
        found.append(Rule(label, 1, ("spdx", "identifier"), f"spdx licen[sc]e identifier {tag}(?: only)?"))
    found += [Rule(label, 1, tuple(gate.split()), pattern) for label, gate, pattern in TEXTS]
    found += [Rule(label, 2, tuple(gate.split()), f"{_GRANT} {pattern}") for label, gate, pattern in NAMES]
    found += [Rule(label, 3, tuple(gate.split()), pattern) for label, gate, pattern in NAMES]
    found += [Rule(label, 4, tuple(gate.split()), pattern) for label, gate, pattern in REMARKS]
    return found


def numbered(pattern: str) -> str:
    """``pattern`` over words with their numbers: each blank is the number of the word after it. A word
    is matched whole, since every match ends before a blank."""
    free = pattern.replace("[^ ]", "\1").replace(" ?", "\2")
    return "[0-9]+:" + free.replace(" ", " [0-9]+:").replace("\2", "(?: [0-9]+:)?").replace("\1", "[^ ]") + " "


def _rule_table():
    """The rules as one constant array of structs."""
    rows = [F.struct(F.lit(n).alias("rule"), F.lit(r.level).alias("level"), F.array(*map(F.lit, r.gate)).alias("gate"), F.lit(numbered(r.pattern)).alias("pattern")) for n, r in enumerate(rules())]
    return F.array(*rows)


_SPAN = "struct<start:int,`end`:int,level:int,rule:int,kept:boolean>"
#: Marks each of the sorted matches {0}; those of a block are gathered first, so that appending stays cheap.
_SWEEP = f"""aggregate(
  transform(sequence(0, (size({{0}}) - 1) div {_BLOCK}), b -> slice({{0}}, b * {_BLOCK} + 1, {_BLOCK})),
  named_struct('ends', array(-1, -1, -1, -1), 'done', cast(array() as array<array<{_SPAN}>>)),
  (acc, block) -> aggregate(
    array(aggregate(block, named_struct('ends', acc.ends, 'out', cast(array() as array<{_SPAN}>)), (a, d) -> named_struct(
      'ends', transform(a.ends, (e, i) -> if(i + 1 >= d.level, greatest(e, -d.stop), e)),
      'out', concat(a.out, array(named_struct('start', d.start, 'end', -d.stop, 'level', d.level, 'rule', d.rule, 'kept', a.ends[d.level - 1] < -d.stop)))))),
    acc, (x, y) -> named_struct('ends', y.ends, 'done', concat(x.done, array(y.out)))),
  acc -> flatten(acc.done))"""


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``licenses``: an array of (start, end, level, rule, kept) in word
    numbers, ordered by start; ``rule`` is the place in :func:`rules`."""
    words, held, chosen, lined, matches, table = fresh(docs, "words", "held", "chosen", "lined", "matches", "table")
    gates = sorted({w for r in rules() for w in r.gate if w != "*"} | set(LICENSE))
    rows = docs.withColumn(words, F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0)))
    own = F.array_intersect(words, F.array(*map(F.lit, gates)))
    rows = rows.withColumn(held, own)
    any_form = F.arrays_overlap(held, F.array(*map(F.lit, LICENSE)))
    rows = rows.withColumn(held, F.when(any_form, F.array_append(held, "*")).otherwise(F.col(held)))
    fits = F.filter(_rule_table(), lambda r: F.size(F.array_except(r["gate"], F.col(held))) == 0)
    rows = rows.withColumn(chosen, F.when(F.size(held) > 0, fits))
    line = F.concat(F.array_join(F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit(":"), w)), " "), F.lit(" "))
    rows = rows.withColumn(lined, F.when(F.size(chosen) > 0, line))
    start = lambda m: F.substring_index(m, ":", 1).cast("int")
    stop = lambda m: -(start(m) + F.regexp_count(m, F.lit(" ")) - 1)
    match = lambda m, r: F.struct(start(m).alias("start"), stop(m).alias("stop"), r["level"].alias("level"), r["rule"].alias("rule"))
    each = F.flatten(F.transform(chosen, lambda r: F.transform(F.regexp_extract_all(F.col(lined), r["pattern"], F.lit(0)), lambda m: match(m, r))))
    rows = rows.withColumn(matches, F.when(F.size(chosen) > 0, F.sort_array(each)))
    swept = F.coalesce(F.expr(_SWEEP.format(f"`{matches}`")), F.array().cast(f"array<{_SPAN}>"))
    return rows.withColumns({"n_words": F.size(words), "licenses": swept}).drop(words, held, chosen, lined, matches)


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    found = detect(docs.select("doc_id", "text"))
    labels = F.array(*(F.lit(r.label) for r in rules()))
    base = F.filter("licenses", lambda d: d["rule"] < len(BASE))
    kept = F.filter("licenses", lambda d: d["kept"])
    named = lambda spans: F.transform(spans, lambda d: F.element_at(labels, d["rule"] + 1))
    joined = lambda names: F.array_join(F.sort_array(F.array_distinct(names)), ",")
    weight = F.array_max(F.transform(kept, lambda d: F.element_at(F.array(*map(F.lit, WEIGHTS)), d["level"])))
    rows = found.select("doc_id", "n_words", base.alias("base"), kept.alias("kept"), named(base).alias("base_names"), named(kept).alias("names"), F.coalesce(weight, F.lit(0.0)).alias("score"))
    places = F.transform("base", lambda d: d["start"])
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        joined(F.col("base_names")).alias("base_labels"), joined(F.concat("names", "base_names")).alias("labels"), "score",
    )


def oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({n}, {quoted(r.label)}, {r.level}, [{', '.join(map(quoted, r.gate))}], {quoted(numbered(r.pattern))})" for n, r in enumerate(rules()))
    return f"""
WITH rules(rule, label, level, gate, pattern) AS (VALUES {values}),
base AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS words FROM documents),
docs AS MATERIALIZED (SELECT *, CASE WHEN list_has_any(words, [{', '.join(map(quoted, LICENSE))}]) THEN list_append(words, '*') ELSE words END AS held,
  array_to_string(list_transform(words, lambda w, i: (i - 1) || ':' || w), ' ') || ' ' AS lined FROM base),
matches AS MATERIALIZED (SELECT r, rule, label, level, CAST(split_part(m, ':', 1) AS BIGINT) AS a, CAST(split_part(m, ':', 1) AS BIGINT) + len(string_split(m, ' ')) - 2 AS b FROM (
  SELECT d.r, u.rule, u.label, u.level, unnest(regexp_extract_all(d.lined, u.pattern)) AS m FROM docs d JOIN rules u ON list_has_all(d.held, u.gate))),
kept AS (SELECT * FROM matches x WHERE NOT EXISTS (SELECT 1 FROM matches y WHERE y.r = x.r AND y.level <= x.level AND y.a <= x.a AND y.b >= x.b
  AND (y.a < x.a OR y.b > x.b OR y.level < x.level OR y.rule < x.rule))),
own AS (SELECT r, count(*) AS n, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM matches WHERE rule < {len(BASE)} GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM kept UNION ALL SELECT r, label FROM matches WHERE rule < {len(BASE)}) GROUP BY r),
best AS (SELECT r, max([{', '.join(map(str, WEIGHTS))}][level]) AS score FROM kept GROUP BY r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(o.n, 0) AS n_base, o.first_word, o.last_word, coalesce(o.labels, '') AS base_labels, coalesce(n.labels, '') AS labels, CAST(coalesce(b.score, 0) AS DOUBLE) AS score
FROM docs d LEFT JOIN own o ON d.r = o.r LEFT JOIN named n ON d.r = n.r LEFT JOIN best b ON d.r = b.r
"""


ORACLE = oracle()
