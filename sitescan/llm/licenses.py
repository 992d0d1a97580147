"""License scans by ordered signature rules over the words of whole texts.

A text becomes its words (A-Z in lower case, all other ASCII but digits and letters as space) with single spaces between, so a rule is a regular
expression over words. Keywords, looked for all at once by an Aho-Corasick automaton, gate the rules: a rule is matched only in texts that hold one of
its block's keywords. A rule's kind gives its priority and confidence. Of overlapping detections, one whose words lie within those of
a detection of higher priority (or of the same priority and more words, or of the same words and an earlier rule) is suppressed.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

#: kind: (priority, confidence). Base phrases are kept whatever overlaps them.
KINDS = {"text": (60, 0.98), "tag": (50, 0.99), "grant": (40, 0.95), "base": (35, 0.9), "url": (30, 0.9), "title": (20, 0.8), "notice": (10, 0.6), "name": (5, 0.5)}

#: Phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Blocks `label: keywords`, then lines `kind regex`. Every match of a block's rules holds one of its keywords.
RULES = r"""
mit: mit licen, mit style licen, mit x11, identifier mit, license mit, licence mit, obtaining a copy of this software, terms of mit, opensource org licenses
  text permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
  text obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
  grant (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit(?: x11| style)? licen[sc]e
  grant under the terms of (?:the )?mit licen[sc]e
  url (?:www )?opensource org licenses mit(?: license)?(?: php| html)?
  title the mit licen[sc]e(?: mit)?
  title mit licen[sc]e
  name licen[sc]e mit
  name mit style licen[sc]e
  name mit x11
apache-2: apache
  text apache license version 2 0 january 2004
  grant licensed under the apache license version 2 0 the license
  grant (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)?
  url (?:www )?apache org licenses license 2 0(?: txt| html)?
  title apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)?
  name apache 2 0
  name apache2 licen[sc]e
apache-1.1: apache
  title apache(?: software)? licen[sc]e(?: version)? v?1 1
apache-1: apache
  title apache(?: software)? licen[sc]e(?: version)? v?1(?: 0)?
apache: apache
  name (?:the )?apache(?: software)? licen[sc]e
  notice apache software foundation asf under one or more contributor license agreements
bsd-2-clause: bsd 2, 2 clause, two clause, simplified bsd, freebsd licen
  tag spdx license identifier bsd 2 clause(?: freebsd| patent| views)?
  grant under (?:the )?(?:terms of )?(?:the )?(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[sc]e
  title (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[sc]e
  name bsd 2 clause
bsd-3-clause: bsd 3, 3 clause, three clause, new bsd, modified bsd, revised bsd, endorse or promote products
  text neither the name of (?:[a-z0-9]+ ){1,12}?nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software
  tag spdx license identifier bsd 3 clause(?: clear| attribution| lbnl)?
  grant under (?:the )?(?:terms of )?(?:the )?(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e
  title (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e
  name bsd 3 clause
bsd-4-clause: bsd 4, 4 clause, original bsd, mentioning features or use
  text all advertising materials mentioning features or use of this software must display the following acknowledgement
  tag spdx license identifier bsd 4 clause(?: uc)?
  title (?:bsd 4 clause|4 clause bsd|original bsd) licen[sc]e
0bsd: 0bsd, zero clause bsd, bsd zero
  title (?:bsd zero clause|zero clause bsd|0bsd) licen[sc]e
bsd: bsd, redistribution and use in source and binary forms
  text redistribution and use in source and binary forms with or without modification are permitted
  grant (?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? licen[sc]e
  title (?:the )?bsd licen[sc]e
  name bsd style licen[sc]e
isc: isc licen, identifier isc, use copy modify and or distribute this software
  text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
  grant under (?:the )?(?:terms of )?(?:the )?isc licen[sc]e
  title isc licen[sc]e
zlib: zlib, origin of this software must not be misrepresented
  text the origin of this software must not be misrepresented you must not claim that you wrote the original software
  tag spdx license identifier zlib(?: acknowledgement)?
  grant under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)? licen[sc]e
  title zlib(?: libpng)? licen[sc]e
libpng: libpng, png reference library
  tag spdx license identifier libpng(?: 2 0)?
  title (?:the )?libpng licen[sc]e
  title png reference library license(?: version [12])?
mpl: mozilla public, mpl
  grant (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[sc]e
  title mozilla public licen[sc]e
  notice this source code form is subject to the terms of the mozilla public license
epl: eclipse public, epl
  grant under (?:the )?(?:terms of )?(?:the )?eclipse public licen[sc]e
  title eclipse public licen[sc]e
cddl: common development and distribution, cddl
  grant under (?:the )?(?:terms of )?(?:the )?common development and distribution licen[sc]e
  title common development and distribution licen[sc]e
  name cddl licen[sc]e
cpl: common public licen, identifier cpl
  title common public licen[sc]e(?: version 1(?: 0)?)?
gpl: general public licen, gnu gpl, gpl
  text this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
  notice you should have received a copy of the gnu general public license along with this
  grant (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[sc]e|gpl)
  title gnu general public licen[sc]e
  name gnu gpl
  name gpl licen[sc]e
lgpl: lesser general, library general, lgpl
  text (?:is|are) free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
  grant (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)
  title gnu (?:lesser|library) general public licen[sc]e
  name gnu lgpl
  name lgpl licen[sc]e
agpl: affero, agpl
  text you can redistribute it and or modify it under the terms of the gnu affero general public license
  grant (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:affero general public licen[sc]e|agpl)
  title gnu affero general public licen[sc]e
  name gnu agpl
  name agpl licen[sc]e
gfdl: free documentation, gfdl, gnu fdl
  text permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
  grant under (?:the )?(?:terms of )?(?:the )?(?:gnu )?free documentation licen[sc]e
  title gnu free documentation licen[sc]e
  name gnu fdl|gfdl
artistic: artistic licen, identifier artistic
  tag spdx license identifier artistic (?:1 0|2 0)(?: perl| cl8)?
  grant under (?:the )?(?:terms of )?(?:the )?artistic licen[sc]e(?: version)?(?: [12] 0)?
  title (?:the )?artistic licen[sc]e(?: version)?(?: [12] 0)?
perl: perl
  grant under the same terms as perl(?: itself)?
  grant same terms as the perl 5 programming language
boost-1: boost
  text boost software license version 1 0 august 17th 2003
  grant (?:distributed|licensed|released) under the boost software licen[sc]e(?: version 1 0)?
  url (?:www )?boost org license 1 0 txt
  title boost software licen[sc]e(?: version 1 0)?
busl-1.1: business source, busl
  title business source licen[sc]e(?: 1 1)?
  name licensed under busl
sspl-1: server side public, sspl
  title server side public licen[sc]e(?: version 1)?
elastic-2: elastic licen, identifier elastic
  title elastic licen[sc]e(?: version)?(?: 2(?: 0)?)?
commons-clause: commons clause
  title commons clause(?: license)? condition v1 0
  name commons clause
unlicense: unlicense, released into the public domain
  text this is free and unencumbered software released into the public domain
  url (?:www )?unlicense org
  title the unlicense
  name unlicense licen[sc]e
public-domain: public domain, domaine public, gemeinfrei, dominio publico
  grant (?:released|dedicated|placed|put) (?:in|into|to) the public domain
  notice (?:is|are) in the public domain
  notice public domain dedication
  notice dans le domaine public
  notice ist gemeinfrei
  notice en el dominio publico
wtfpl: wtfpl, do what the
  text do what the [a-z]{2,8} you want to public license
  name wtfpl
beerware: beerware, beer ware
  title (?:the )?beer ?ware licen[sc]e
json: shall be used for good
  text the software shall be used for good not evil
upl-1: universal permissive, identifier upl
  title universal permissive licen[sc]e(?: v?1 0| version 1 0)?
ncsa: ncsa
  title (?:university of illinois )?ncsa open source licen[sc]e
postgresql: postgresql licen, identifier postgresql
  title postgresql licen[sc]e
php-3: php licen, identifier php
  tag spdx license identifier php 3 0(?:1)?
  title (?:the )?php licen[sc]e(?: version)?(?: 3 0(?:1)?)?
python-2: python software foundation, psf licen, identifier psf, identifier python
  tag spdx license identifier (?:psf|python) 2 0
  title python software foundation licen[sc]e(?: version 2)?
  name psf licen[sc]e
ruby: ruby licen, identifier ruby, same terms as ruby
  grant same terms as ruby(?: itself)?
  title ruby licen[sc]e
openssl: openssl licen, identifier openssl, openssl toolkit
  text this product includes software developed by the openssl project for use in the openssl toolkit
  title openssl licen[sc]e
ms-pl: microsoft public, identifier ms pl
  title microsoft public licen[sc]e(?: ms pl)?
ms-rl: microsoft reciprocal, identifier ms rl
  title microsoft reciprocal licen[sc]e(?: ms rl)?
osl-3: open software licen, identifier osl
  title open software licen[sc]e(?: version)?(?: v)?(?: 3 0)?
afl-3: academic free, identifier afl
  title academic free licen[sc]e(?: version)?(?: v)?(?: 3 0)?
eupl: european union public, eupl
  tag spdx license identifier eupl 1 [0-2]
  grant under (?:the )?(?:terms of )?(?:the )?(?:european union public licen[sc]e|eupl)
  title european union public licen[sc]e(?: v(?:ersion)? ?1 [0-2])?
  name eupl
cecill: cecill
  tag spdx license identifier cecill(?: b| c)?(?: [12] [01])?
  title (?:licence|license) cecill(?: b| c)?
  name cecill(?: b| c)? licen[sc]e
ofl-1.1: sil open font, identifier ofl, scripts sil org ofl
  text this font software is licensed under the sil open font license version 1 1
  url scripts sil org ofl
  title sil open font licen[sc]e(?: version 1 1)?
w3c: w3c
  title w3c software (?:notice and licen[sc]e|and document notice|licen[sc]e)
unicode: unicode licen, identifier unicode, unicode inc
  tag spdx license identifier unicode (?:3 0|dfs 2015|dfs 2016)
  title unicode licen[sc]e(?: v3| agreement)?
  notice unicode inc license agreement data files and software
x11: x11 licen, identifier x11, x consortium
  text name of the x consortium shall not be used in advertising
  title x11 licen[sc]e
icu: icu licen, identifier icu
  title icu licen[sc]e(?: icu 1 8 1 and later)?
curl: identifier curl, curl licen
  title curl licen[sc]e
imagemagick: imagemagick licen, identifier imagemagick
  title imagemagick licen[sc]e
intel: intel open source, intel simplified
  title intel (?:open source|simplified software) licen[sc]e
ibm-pl: ibm public, identifier ipl
  title ibm public licen[sc]e(?: version 1 0)?
qpl: q public, identifier qpl
  title q public licen[sc]e(?: version 1 0)?
vim: vim licen, identifier vim
  title vim licen[sc]e
latex-ppl: latex project public, identifier lppl
  tag spdx license identifier lppl 1 3[ac]?
  text this work may be distributed and or modified under the conditions of the latex project public license
  title latex project public licen[sc]e(?: version)?(?: 1 3[ac]?)?
odbl: open database licen, odbl, identifier odbl
  url opendatacommons org licenses odbl(?: 1 0)?
  title (?:open data commons )?open database licen[sc]e(?: odbl)?(?: v1 0)?
  name odbl
odc-by: odc by, open data commons attribution
  title open data commons attribution licen[sc]e(?: odc by)?(?: v1 0)?
pddl: pddl, public domain dedication and licen
  title (?:odc )?public domain dedication and licen[sc]e(?: pddl)?
cc: creative commons
  notice licensed under (?:a |the )?creative commons
  notice creative commons licen[sc]e
  notice lizenziert unter (?:einer )?creative commons
  notice sous licence creative commons
  notice bajo (?:una )?licencia creative commons
cc0: cc0, creative commons zero, publicdomain zero
  url creativecommons org publicdomain zero 1 0
  title (?:creative commons zero|cc0)(?: 1 0)?(?: universal)?
openrail: openrail, open rail, responsible ai licen
  title (?:creativeml |bigscience )?open ?rail(?: m| s| d)?(?: licen[sc]e)?
  title responsible ai licen[sc]es?
llama: llama
  title (?:meta )?llama [234](?: [123])? community licen[sc]e(?: agreement)?
gemma: gemma terms
  title gemma terms of use
proprietary: all rights reserved, alle rechte vorbehalten, tous droits, todos los derechos reservados, unauthorized copying, proprietary and confidential, commercial licen
  notice all rights reserved
  notice alle rechte vorbehalten
  notice tous droits réservés
  notice todos los derechos reservados
  text unauthorized copying of this (?:file|software) via any medium is strictly prohibited
  notice proprietary and confidential
  notice (?:requires|under|with) a commercial licen[sc]e
non-commercial: commercial use, commercial purposes, commercially
  notice (?:for )?non ?commercial (?:use|purposes) only
  notice not (?:for|be used for) commercial (?:use|purposes)
  notice may not be used commercially
free-to-copy: permission is granted to make, verbatim cop
  text permission is granted to make and distribute verbatim copies
  notice verbatim copying and distribution of this entire article is permitted
"""

#: Labels and the words of their tags.
TAGS = """
mit=mit, apache-2=apache 2 0, apache-1.1=apache 1 1, apache-1=apache 1 0, 0bsd=0bsd, isc=isc, cpl=cpl 1 0, boost-1=bsl 1 0 boost, busl-1.1=busl 1 1,
sspl-1=sspl 1 0, elastic-2=elastic 2 0, unlicense=unlicense, wtfpl=wtfpl, beerware=beerware, upl-1=upl 1 0, ncsa=ncsa, postgresql=postgresql,
ruby=ruby, openssl=openssl, ms-pl=ms pl, ms-rl=ms rl, osl-3=osl 3 0, afl-3=afl 3 0, ofl-1.1=ofl 1 1, w3c=w3c, x11=x11, icu=icu, curl=curl,
imagemagick=imagemagick, ibm-pl=ipl 1 0, qpl=qpl 1 0, vim=vim, odbl=odbl 1 0, odc-by=odc by 1 0, pddl=pddl 1 0, cc0=cc0 1 0
"""

#: Families of licenses that come in versions, each with (label, words of its short name, of its long name) and versions; rules are made of the forms
#: below. Versions end in 0 where that is said or left out alike.
VERSIONED = {
    "gpl": (("gpl", "gnu general public", ("1 0", "2 0", "3 0")), ("lgpl", "gnu lesser general public", ("2 1", "3 0")), ("lgpl", "gnu library general public", ("2 0",)), ("agpl", "gnu affero general public", ("1 0", "3 0"))),
    "other": (("mpl", "mozilla public", ("1 0", "1 1", "2 0")), ("epl", "eclipse public", ("1 0", "2 0")), ("cddl", "common development and distribution", ("1 0", "1 1")), ("gfdl", "gnu free documentation", ("1 1", "1 2", "1 3"))),
}
PARTS = {"by": "attribution", "nc": "noncommercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
CREATIVE = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


class Rule(NamedTuple):
    label: str
    kind: str
    pattern: str
    keywords: tuple[str, ...]


def written_rules() -> list[Rule]:
    """The rules of `RULES`, in order."""
    out, label, keywords = [], "", ()
    for line in filter(str.strip, RULES.splitlines()):
        if line.startswith(" "):
            kind, _, pattern = line.strip().partition(" ")
            out.append(Rule(label, kind, pattern, keywords))
        else:
            label, _, said = line.partition(":")
            keywords = tuple(k.strip() for k in said.split(","))
    return out


def tag_rules() -> list[Rule]:
    """Rules of tags that are one fixed name."""
    pairs = (pair.strip().split("=") for pair in TAGS.split(","))
    return [Rule(label, "tag", f"spdx license identifier {words}", (f"identifier {words}",)) for label, words in pairs]


def versioned_rules() -> list[Rule]:
    """Rules of families whose names hold versions: the version belongs to the label."""
    out = []
    for family, members in VERSIONED.items():
        for short, long, versions in members:
            for v in versions:
                major, minor = v.split()
                label = f"{short}-{major}" + (f".{minor}" if minor != "0" else "")
                number = rf"v?{major}" + (f" {minor}" if minor != "0" else "(?: 0)?")
                key = (short, long.removeprefix("gnu "))
                later = " or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"
                name = rf"(?:{long} licen[sc]e|{long.removeprefix('gnu ')} licen[sc]e|(?:gnu )?{short})"
                out.append(Rule(label, "tag", f"spdx license identifier {short} {v}(?: only)?", key))
                if family == "gpl":
                    out.append(Rule(label + "-or-later", "tag", f"spdx license identifier {short} {v} or later", key))
                    out.append(Rule(label + "-or-later", "text", rf"under the terms of the {long} license as published by the free software foundation either version {number} of the license or at your option any later version", key))
                    out.append(Rule(label + "-or-later", "grant", rf"{name}(?: version)? {number}{later}", key))
                    out.append(Rule(label, "url", rf"gnu org licenses (?:old licenses )?{short} {v}(?: html| txt)?", key + ("gnu org licenses",)))
                out.append(Rule(label, "grant", rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{name}(?: version)? {number}", key))
                out.append(Rule(label, "title", rf"{name}(?: version)? {number}", key))
    return out


def creative_rules() -> list[Rule]:
    """Rules of the Creative Commons licenses: short names, long names, tags and addresses, with and without versions."""
    out = []
    for parts in CREATIVE:
        names, base = parts.split(), "cc-" + parts.replace(" ", "-")
        long = " ".join(PARTS[p] for p in names).replace("noncommercial", "non ?commercial")
        key = ("cc " + parts, "creative commons", "creativecommons org licenses")
        for v in CC_VERSIONS:
            label = f"{base}-{v.replace(' 0', '').replace(' ', '.')}"
            out.append(Rule(label, "tag", f"spdx license identifier cc {parts} {v}", key))
            out.append(Rule(label, "url", f"creativecommons org licenses {parts} {v}", key))
            out.append(Rule(label, "title", f"creative commons {long} {v}(?: international| unported| generic)?(?: licen[sc]e)?", key))
            out.append(Rule(label, "title", f"cc {parts} {v}", key))
        out.append(Rule(base, "title", f"creative commons {long}(?: licen[sc]e)?", key))
        out.append(Rule(base, "title", f"cc {parts}", key))
    return out


def all_rules() -> list[Rule]:
    """Base phrases, then written rules, then those of tags and families, in the order that settles ties."""
    return [Rule(label, "base", phrase, (phrase,)) for phrase, label in BASE.items()] + written_rules() + tag_rules() + versioned_rules() + creative_rules()


#: Bytes that are not of words become spaces, capital letters small ones.
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Scanner:
    """Compiled rules with their gate. `rules` may be any; those of kind 'base' are never suppressed."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.found = [re.compile(rf"(?<= )(?:{r.pattern})(?= )".encode().decode("latin-1")) for r in rules]  # bytes of UTF-8 as characters
        opens: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for k in r.keywords:
                opens.setdefault(k, []).append(i)
        self.gate = ahocorasick.Automaton()
        for k, ids in opens.items():
            self.gate.add_word(k, ids)
        self.gate.make_automaton()
        self.priority = np.array([KINDS[r.kind][0] for r in rules], np.int64)

    def scan(self, text: str | None, gated: bool = True) -> tuple[int, list[tuple[int, int, int, bool]]]:
        """(number of words, detections as (rule, first word, last word, kept), by place and rule)."""
        words = words_of(text)
        if not words:
            return 0, []
        said = " " + b" ".join(words).decode("latin-1") + " "
        n = len(words)
        del words
        if gated:
            held = {id(ids): ids for _, ids in self.gate.iter(said)}
            todo = sorted({i for ids in held.values() for i in ids})
        else:
            todo = range(len(self.rules))
        hits = [(i, m.start(), m.end()) for i in todo for m in self.found[i].finditer(said)]
        if not hits:
            return n, []
        rule, start, end = np.array(hits, np.int64).T
        spaces = np.flatnonzero(np.frombuffer(said.encode("latin-1"), np.uint8) == 0x20)
        first, last = np.searchsorted(spaces, start) - 1, np.searchsorted(spaces, end) - 1
        kept = self._kept(rule, first, last)
        order = np.lexsort((rule, last, first))
        return n, list(zip(rule[order].tolist(), first[order].tolist(), last[order].tolist(), kept[order].tolist(), strict=True))

    def _kept(self, rule: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """What no detection that comes before it (by priority, words, rule) contains. A contained one suppresses nothing that what contains it
        does not suppress, so all count, kept or not. Each is compared with the farthest end among those that begin no later: one running maximum
        for higher priorities and one for longer ones of the same."""
        kept = np.ones(len(rule), bool)
        rank = self.priority[rule]
        above = np.zeros(len(rule), bool)
        for p in np.unique(rank)[::-1]:
            own = rank == p
            if above.any():
                s, e = first[above], last[above]
                order = np.argsort(s, kind="stable")
                far = np.maximum.accumulate(e[order])
                at = np.searchsorted(s[order], first[own], "right") - 1
                kept[own] &= ~((at >= 0) & (far[np.maximum(at, 0)] >= last[own]))
            mine = np.flatnonzero(own)
            mine = mine[np.lexsort((rule[mine], -last[mine], first[mine]))]
            if len(mine) > 1:  # in this order whatever contains a detection stands before it
                far = np.maximum.accumulate(last[mine])[:-1]
                kept[mine[1:]] &= far < last[mine[1:]]
            above |= own
        return kept | np.array([self.rules[r].kind == "base" for r in rule.tolist()])


@lru_cache
def scanner() -> Scanner:
    return Scanner(all_rules())


DETECTION = "struct<rule: int, label: string, kind: string, first: long, last: long, kept: boolean>"
FOUND = f"struct<n_words: long, detections: array<{DETECTION}>>"


def scanned(df: DataFrame, text: str = "text", into: str = "found") -> DataFrame:
    """`df` with `into`: n_words and detections (rule, label, kind, first and last word from 0, kept), by place; detections that others suppress have
    kept false. Null and empty texts have no words. A text is scanned whole, row by row, whatever its length; a task holds one batch of texts."""
    small_batches(df.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        s, out = scanner(), []
        for t in texts:
            n, hits = s.scan(t.as_py())
            out.append({"n_words": n, "detections": [{"rule": r, "label": s.rules[r].label, "kind": s.rules[r].kind, "first": a, "last": b, "kept": k} for r, a, b, k in hits]})
        hit = pa.struct([("rule", pa.int32()), ("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("kept", pa.bool_())])
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("detections", pa.list_(hit))]))

    return df.withColumn(into, F.arrow_udf(run, FOUND)(F.col(text)))


def license_report(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base columns count all places of the phrases of `BASE`. labels are those and the ones of detections that are kept; score is the confidence of the
    surest of them, 0 without any. Rows that repeat give rows each; ties between rules go by their order; other columns are not read."""
    s = fresh(df, "found")
    hits = F.col(f"{s}.detections")
    base, kept = F.filter(hits, lambda h: h.kind == "base"), F.filter(hits, lambda h: h.kept)
    joined = lambda rows: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(rows, lambda h: h.label))))
    sure = F.create_map(*(F.lit(x) for k, (_, c) in KINDS.items() for x in (k, c)))
    score = F.coalesce(F.array_max(F.transform(kept, lambda h: sure[h.kind])), F.lit(0.0))
    starts = F.transform(base, lambda h: h["first"])
    return scanned(df.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")), "text", s).select(
        "doc_id", F.col(f"{s}.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(kept).alias("labels"), score.alias("score"),
    )
