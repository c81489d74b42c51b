"""Signature rules for licence notices: hand-written patterns with a keyword, a label and a priority.

Patterns are read over words: a blank stands for whatever separates two words, and words are runs of letters and
digits. ``{v}`` is an optional version. A rule runs only on texts that hold one of its keywords, plain lower-case
strings with ``|`` between them; each alternative of its pattern must hold one of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# What a word is made of, in UTF-8 bytes with A to Z lower-cased.
WORD = rb"0-9a-z\x80-\xff"
_GAP = "[^%s]+" % WORD.decode("latin-1")
_VERSION = r"(?: (?:version |v)?(\d+(?: \d+)*))?(?: or (?:any )?later(?: version)?)?"

#: Priorities: the smaller one wins where one detection lies within another.
IDENTIFIER, GRANT, LINK, BODY, NAME, NOTICE = 1, 2, 3, 4, 5, 6
CONFIDENCE = {IDENTIFIER: 1.0, GRANT: 0.95, LINK: 0.9, BODY: 0.85, NOTICE: 0.6, NAME: 0.7}


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: str
    priority: int

    def compiled(self) -> re.Pattern[bytes]:
        body = self.pattern.replace("{v}", _VERSION).replace(" ?", f"(?:{_GAP})?").replace(" ", _GAP)
        edge = WORD.decode("latin-1")
        return re.compile(f"(?<![{edge}])(?:{body})(?![{edge}])".encode("latin-1"), re.DOTALL)


# Label; keyword; names by which texts call the licence; addresses where it is published.
FAMILIES = (
    ("apache-2.0", "apache|asl 2", ("apache (?:software )?licen[cs]e{v}", "asl 2 0", "apache 2 0?", "apache2"), ("apache org licenses license 2 0",)),
    ("mit", "mit licen", ("(?:the )?mit licen[cs]e",), ("opensource org licenses mit(?: license(?: php)?)?",)),
    ("mit", "expat", ("(?:mit )?expat licen[cs]e",), ()),
    ("mit", "mit x11", ("mit x11 licen[cs]e",), ()),
    ("mit-0", "mit no attribution", ("mit no attribution(?: licen[cs]e)?",), ("opensource org licenses mit 0",)),
    ("gpl-2.0", "gpl", ("gnu gpl (?:version |v)?2(?: 0)?", "gpl ?v?2(?: 0)?(?: or later| only)?", "gplv2"), ("gnu org licenses (?:old licenses )?gpl 2 0",)),
    ("gpl-3.0", "gpl", ("gnu gpl (?:version |v)?3(?: 0)?", "gpl ?v?3(?: 0)?(?: or later| only)?", "gplv3"), ("gnu org licenses gpl 3 0",)),
    ("gpl-2.0", "general public", ("(?:gnu )?general public licen[cs]e (?:version |v)2(?: 0)?(?: or (?:any )?later(?: version)?)?",), ()),
    ("gpl-3.0", "general public", ("(?:gnu )?general public licen[cs]e (?:version |v)3(?: 0)?(?: or (?:any )?later(?: version)?)?",), ()),
    ("lgpl", "lesser general public", ("(?:gnu )?lesser general public licen[cs]e{v}",), ("gnu org licenses lgpl",)),
    ("lgpl", "lgpl", ("gnu lgpl{v}", "lgpl ?v?[23](?: [01])?(?: or later| only)?"), ("gnu org licenses lgpl(?: [23] [01])?",)),
    ("lgpl-2.0", "library general public", ("(?:gnu )?library general public licen[cs]e{v}",), ()),
    ("agpl-3.0", "affero", ("(?:gnu )?affero general public licen[cs]e{v}", "gnu affero{v}"), ("gnu org licenses agpl",)),
    ("agpl-3.0", "agpl", ("agpl ?v?3?(?: 0)?(?: or later| only)?",), ("gnu org licenses agpl(?: 3 0)?",)),
    ("gfdl", "free documentation", ("(?:gnu )?free documentation licen[cs]e{v}",), ("gnu org licenses fdl",)),
    ("bsd-2-clause", "bsd", ("(?:simplified|freebsd) bsd licen[cs]e", "bsd 2 clause(?: licen[cs]e)?", "(?:2|two) clause bsd(?: licen[cs]e)?"), ("opensource org licenses bsd 2 clause",)),
    ("bsd-3-clause", "bsd", ("(?:new|modified|revised) bsd licen[cs]e", "bsd 3 clause(?: licen[cs]e)?", "(?:3|three) clause bsd(?: licen[cs]e)?"), ("opensource org licenses bsd 3 clause",)),
    ("bsd-4-clause", "bsd", ("(?:original|old) bsd licen[cs]e", "bsd 4 clause(?: licen[cs]e)?", "(?:4|four) clause bsd(?: licen[cs]e)?"), ("spdx org licenses bsd 4 clause",)),
    ("bsd", "bsd", ("bsd(?: style)? licen[cs]e",), ("opensource org licenses bsd license",)),
    ("0bsd", "0bsd|zero clause bsd", ("0bsd(?: licen[cs]e)?", "zero clause bsd(?: licen[cs]e)?"), ("opensource org licenses 0bsd",)),
    ("mpl-1.1", "mozilla", ("mozilla public licen[cs]e (?:version |v)?1 [01]",), ("mozilla org mpl mpl 1 1",)),
    ("mpl-2.0", "mozilla", ("mozilla public licen[cs]e(?: (?:version |v)?2(?: 0)?)?",), ("mozilla org (?:en us )?mpl 2 0",)),
    ("mpl-2.0", "mpl", ("mpl ?v?2(?: 0)?",), ("mozilla org mpl 2 0",)),
    ("epl-1.0", "eclipse", ("eclipse public licen[cs]e (?:version |v)?1(?: 0)?",), ("eclipse org legal epl v10",)),
    ("epl-2.0", "eclipse", ("eclipse public licen[cs]e(?: (?:version |v)?2(?: 0)?)?",), ("eclipse org legal epl (?:2 0|v20)",)),
    ("edl-1.0", "eclipse", ("eclipse distribution licen[cs]e{v}",), ("eclipse org org documents edl v10",)),
    ("cddl", "cddl", ("cddl{v}",), ("opensource org licenses cddl 1 0",)),
    ("cddl", "common development", ("common development and distribution licen[cs]e{v}",), ()),
    ("cpl-1.0", "common public", ("common public licen[cs]e{v}",), ("opensource org licenses cpl1 0",)),
    ("ipl-1.0", "ibm public", ("ibm public licen[cs]e{v}",), ("opensource org licenses ipl 1 0",)),
    ("eupl-1.2", "european union public", ("european union public licen[cs]e{v}",), ("joinup ec europa eu (?:software page|collection eupl)",)),
    ("eupl-1.2", "eupl", ("eupl{v}",), ("eupl eu 1 2",)),
    ("cecill", "cecill", ("cecill(?: [abc])?(?: licen[cs]e)?{v}",), ("cecill info licences",)),
    ("artistic-2.0", "artistic", ("(?:perl )?artistic licen[cs]e{v}",), ("opensource org licenses artistic licen[cs]e 2 0",)),
    ("isc", "isc|internet systems consortium", ("isc licen[cs]e", "internet systems consortium licen[cs]e"), ("opensource org licenses isc",)),
    ("zlib", "zlib", ("zlib(?: libpng)? licen[cs]e",), ("opensource org licenses zlib",)),
    ("libpng", "libpng", ("libpng licen[cs]e{v}",), ("libpng org pub png src libpng license",)),
    ("bsl-1.0", "boost", ("boost software licen[cs]e{v}",), ("boost org license 1 0",)),
    ("unlicense", "unlicense", ("(?:the )?unlicense",), ("unlicense org",)),
    ("wtfpl", "wtfpl", ("wtfpl{v}",), ("wtfpl net",)),
    ("ncsa", "ncsa", ("(?:university of illinois )?ncsa open source licen[cs]e",), ("opensource org licenses ncsa",)),
    ("afl-3.0", "academic free", ("academic free licen[cs]e{v}",), ("opensource org licenses afl 3 0",)),
    ("osl-3.0", "open software licen", ("open software licen[cs]e{v}",), ("opensource org licenses osl 3 0",)),
    ("ofl-1.1", "open font", ("(?:sil )?open font licen[cs]e{v}",), ("scripts sil org ofl",)),
    ("odbl-1.0", "odbl", ("odbl{v}",), ("opendatacommons org licenses odbl",)),
    ("odbl-1.0", "open database", ("open database licen[cs]e{v}",), ("opendatacommons org licenses odbl 1 0",)),
    ("odc-by-1.0", "odc", ("odc by{v}", "odc attribution licen[cs]e{v}"), ("opendatacommons org licenses by",)),
    ("pddl-1.0", "pddl", ("pddl{v}",), ("opendatacommons org licenses pddl",)),
    ("cdla-permissive", "cdla", ("cdla permissive{v}",), ("cdla (?:dev|io) permissive",)),
    ("cdla-sharing", "cdla", ("cdla sharing{v}",), ("cdla (?:dev|io) sharing",)),
    ("ogl-uk", "open government", ("open government licen[cs]e{v}",), ("nationalarchives gov uk doc open government licence",)),
    ("etalab-2.0", "licence ouverte", ("licence ouverte{v}",), ("etalab gouv fr licence ouverte",)),
    ("dl-de-by-2.0", "datenlizenz", ("datenlizenz deutschland(?: namensnennung)?{v}",), ("govdata de dl de by 2 0",)),
    ("cc0-1.0", "cc0", ("cc0(?: 1 0)?(?: universal)?",), ("creativecommons org publicdomain zero 1 0",)),
    ("cc-by-sa", "cc by sa", ("cc by sa{v}",), ("creativecommons org licenses by sa",)),
    ("cc-by-nc", "cc by nc", ("cc by nc{v}",), ("creativecommons org licenses by nc",)),
    ("cc-by-nd", "cc by nd", ("cc by nd{v}",), ("creativecommons org licenses by nd",)),
    ("cc-by-nc-sa", "cc by nc", ("cc by nc sa{v}",), ("creativecommons org licenses by nc sa",)),
    ("cc-by-nc-nd", "cc by nc", ("cc by nc nd{v}",), ("creativecommons org licenses by nc nd",)),
    ("cc-by-4.0", "cc by", ("cc by(?: (?:version |v)?[1-4] [05])",), ("creativecommons org licenses by [1-4] [05]",)),
    ("cc-by-nc", "creative commons", ("creative commons attribution non ?commercial{v}",), ()),
    ("cc-by-sa", "creative commons", ("creative commons attribution share ?alike{v}",), ()),
    ("cc-by-nd", "creative commons", ("creative commons attribution no ?deriv(?:ative|ative work)?s?{v}",), ()),
    ("cc-by-4.0", "creative commons", ("creative commons attribution(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?",), ()),
    ("cc", "creative commons", ("creative commons licen[cs]e", "creative commons"), ("creativecommons org",)),
    ("python-2.0", "python software|psf licen", ("python software foundation licen[cs]e{v}", "psf licen[cs]e{v}"), ("docs python org license",)),
    ("php-3.01", "php licen", ("php licen[cs]e{v}",), ("php net license",)),
    ("postgresql", "postgresql", ("postgresql licen[cs]e",), ("opensource org licenses postgresql",)),
    ("openssl", "openssl", ("openssl licen[cs]e",), ("openssl org source license",)),
    ("w3c", "w3c", ("w3c software(?: notice)?(?: and)? licen[cs]e",), ("w3 org consortium legal copyright software",)),
    ("x11", "x11", ("x11 licen[cs]e",), ("xfree86 org licen[cs]e",)),
    ("ms-pl", "microsoft public|ms pl", ("microsoft public licen[cs]e", "ms pl"), ("opensource org licenses ms pl",)),
    ("ms-rl", "microsoft reciprocal|ms rl", ("microsoft reciprocal licen[cs]e", "ms rl"), ("opensource org licenses ms rl",)),
    ("upl-1.0", "universal permissive", ("universal permissive licen[cs]e{v}",), ("opensource org licenses upl",)),
    ("ecl-2.0", "educational community", ("educational community licen[cs]e{v}",), ("opensource org licenses ecl 2 0",)),
    ("mulanpsl-2.0", "mulan", ("mulan (?:psl|permissive software licen[cs]e){v}",), ("license coscl org cn mulanpsl2",)),
    ("sspl-1.0", "server side public", ("server side public licen[cs]e{v}",), ("mongodb com licensing server side public license",)),
    ("busl-1.1", "business source", ("business source licen[cs]e{v}",), ("mariadb com bsl11",)),
    ("elastic-2.0", "elastic licen", ("elastic licen[cs]e{v}",), ("elastic co licensing elastic license",)),
    ("openrail", "openrail", ("(?:creative ml |big ?code )?openrail(?: m)?(?: licen[cs]e)?{v}",), ("huggingface co spaces bigscience license",)),
    ("ftl", "freetype", ("freetype (?:project )?licen[cs]e",), ("freetype org license",)),
    ("imagemagick", "imagemagick", ("imagemagick licen[cs]e",), ("imagemagick org script license",)),
    ("vim", "vim licen", ("vim licen[cs]e",), ("vimdoc sourceforge net htmldoc uganda",)),
    ("ruby", "ruby licen", ("ruby licen[cs]e",), ("ruby lang org en about license",)),
)

# Label; keyword; a passage of the licence's own text.
BODIES = (
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software"),
    ("isc", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "endorse or promote", "neither the name of .{1,120} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "compliance with the licen", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "conditions of any kind", "without warranties or conditions of any kind either express or implied"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify"),
    ("gpl", "useful", "distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "warranty of", "implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "this library", "this library is free software you can redistribute it and or modify"),
    ("agpl-3.0", "over a network|through a computer network", "users interacting with it remotely through a computer network|used over a network"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("epl-2.0", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse"),
    ("zlib", "as-is", "provided as is without any express or implied warranty in no event will the authors"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("bsl-1.0", "machine-executable", "machine executable object code generated by a source language processor"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the", "do what the fuck you want to(?: public licen[cs]e)?"),
    ("cc0-1.0", "dedicate|all copyright and related", "waived? all copyright and related|dedicated? (?:this|the) work to the public domain"),
    ("ofl-1.1", "reserved font", "with reserved font names?"),
    ("cddl", "covered software", "covered software means (?:a )?the original software"),
    ("gfdl", "invariant sections", "with no invariant sections"),
    ("artistic-2.0", "standard version", "copies of the source form of the standard version"),
)

# Label; keyword; a notice that is no licence of that kind.
NOTICES = (
    ("reserved", "rights reserved", "all rights reserved"),
    ("reserved", "rights reserved", "some rights reserved"),
    ("reserved", "droits", "tous droits r.{1,2}serv.{1,2}s"),
    ("reserved", "rechte vorbehalten", "alle rechte vorbehalten"),
    ("reserved", "derechos", "todos los derechos reservados"),
    ("reserved", "derechos", "reservados todos los derechos"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)*"),
    ("copyright", "c 19", "c 19\\d\\d(?: (?:19|20)\\d\\d)*"),
    ("copyright", "c 20", "c 20\\d\\d(?: (?:19|20)\\d\\d)*"),
    ("copyright", "©", "\\xc2\\xa9(?:19|20)\\d\\d"),
    ("copyright", "copyright", "copyright (?:by|notice|holder|owner)s?"),
    ("copyright", "urheberrecht", "urheberrechtlich gesch.{1,2}tzt"),
    ("copyright", "droit", "droits? d auteur"),
    ("copyright", "derechos de autor", "derechos de autor"),
    ("proprietary", "proprietary", "proprietary and confidential|confidential and proprietary"),
    ("proprietary", "proprietary", "proprietary licen[cs]e"),
    ("proprietary", "trade secret", "(?:contains|constitutes?) trade secrets?"),
    ("proprietary", "end user licen", "end user licen[cs]e agreement"),
    ("proprietary", "eula", "eula"),
    ("proprietary", "internal use", "for internal use only"),
    ("proprietary", "not distribute|or distribute", "do not (?:copy or )?distribute"),
    ("proprietary", "redistribut", "redistribution (?:is )?(?:strictly )?prohibited|may not be redistributed"),
    ("proprietary", "not be reproduced|not be copied", "(?:may|must) not be (?:copied|reproduced)"),
    ("proprietary", "reproduction", "(?:unauthori[sz]ed )?reproduction (?:is )?(?:strictly )?(?:prohibited|forbidden)"),
    ("proprietary", "permission", "without (?:the )?(?:prior )?(?:express )?written permission"),
    ("proprietary", "vertraulich", "streng vertraulich"),
    ("noncommercial", "commercial", "(?:for )?non ?commercial (?:use|purposes)(?: only)?"),
    ("noncommercial", "commercial", "not for commercial use"),
    ("noncommercial", "personal use", "for personal use only"),
    ("noncommercial", "educational", "for educational (?:use|purposes) only"),
    ("noncommercial", "research", "for research (?:use|purposes) only"),
    ("evaluation", "evaluation", "for evaluation (?:use|purposes) only"),
    ("public-domain", "public domain", "(?:in|into|to) the public domain"),
    ("public-domain", "public domain", "public domain(?: dedication| mark)?"),
    ("public-domain", "gemeinfrei", "gemeinfrei"),
    ("public-domain", "domaine public", "domaine public"),
    ("public-domain", "dominio p", "dominio p.{1,2}blico"),
    ("dual", "dual", "dual licen[cs]ed"),
    ("open-source", "open source", "open source licen[cs]e"),
    ("open-source", "osi", "osi approved"),
    ("no-derivatives", "derivative", "no derivative works?"),
    ("attribution", "attribution", "attribution (?:is )?required"),
    ("opt-out", "may not be used", "may not be used (?:for|to) (?:train|training|machine learning)"),
    ("opt-out", "text and data mining", "text and data mining (?:is )?(?:reserved|prohibited)"),
    ("opt-out", "training", "no (?:ai )?training"),
    ("trademark", "trademark", "registered trademarks? of"),
    ("patent", "patent", "patents? (?:is |are )?pending"),
    ("warranty", "as is", "provided as is without warranty"),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e"),
    ("gpl", "gnu gpl", "gnu gpl"),
    ("gpl", "copyleft", "copyleft"),
)

_GRANTING = (
    "(?:is |are |was )?(?:dual )?licen[cs]ed under(?: the)?(?: terms of(?: the)?)?",
    "(?:is |are )?(?:released|distributed|published|made available|available) under(?: the)?(?: terms of(?: the)?)?",
)


def rules() -> list[Rule]:
    """All rules in their order: for each family identifiers, grants, links and names; passages; notices."""
    out = []

    def add(label: str, kind: str, keyword: str, pattern: str, priority: int) -> None:
        out.append(Rule(f"{len(out):03d}-{label}-{kind}", label, keyword, pattern, priority))

    for label, keyword, names, links in FAMILIES:
        called = "|".join(f"(?:{name})" for name in names)
        tag = re.sub(r"[^0-9a-z]+", " ", label)
        add(label, "identifier", "spdx", f"spdx licen[cs]e identifier {tag}(?: only| or later)?", IDENTIFIER)
        for n, grant in enumerate(_GRANTING):
            add(label, f"grant{n}", keyword, f"{grant} (?:{called})", GRANT)
        for link in links:
            add(label, "link", link.split(" ")[0], f"(?:https? )?(?:www )?{link}", LINK)
        for name in names:
            add(label, "name", keyword, name, NAME)
    for label, keyword, passage in BODIES:
        add(label, "body", keyword, passage, BODY)
    for label, keyword, notice in NOTICES:
        add(label, "notice", keyword, notice, NOTICE)
    return out
