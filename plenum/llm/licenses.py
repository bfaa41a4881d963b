"""Operator 10: license scan by ordered signature rules.

Texts become lower-case words joined by single blanks. Hundreds of regular expressions over them, each with a priority,
are made of signatures of license bodies, of license names in the phrasings in which a name can stand, and of notices. A
keyword prefilter gates them twice: a text without any license word skips all rules, and a family of rules is tried only on
texts that hold its keyword. A detection that lies within another of no lower priority is dropped, by one pass over the
detections in order of their starts. All of it is native columns on the document's row: no shuffle, no Python; the rule
table is a constant of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.regex_spans import bound, running, starts

#: Phrases and labels that are always reported, wherever their words stand.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, keywords of which a text must hold one (each begins a word), pattern of the name in normalised words.
NAMES = (
    ("apache-2.0", " apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache-1.1", " apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache", " apache", "apache(?: software)? license"),
    ("mit", " mit ", "mit(?: x11)?(?: style)? licen[cs]e"),
    ("isc", " isc ", "isc licen[cs]e"),
    ("bsd-2-clause", " bsd; simplified bsd; freebsd; clause bsd", "(?:bsd 2 clause|simplified bsd|2 clause bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", " bsd; simplified bsd; freebsd; clause bsd", "(?:bsd 3 clause|new bsd|revised bsd|3 clause bsd|modified bsd)(?: licen[cs]e)?"),
    ("bsd", " bsd", "bsd(?: style)? licen[cs]e"),
    ("gpl-3.0", " general public; gpl", "(?:gnu )?(?:general public licen[cs]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?3(?: 0)?(?: or(?: any)? later| only)?"),
    ("gpl-2.0", " general public; gpl", "(?:gnu )?(?:general public licen[cs]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?2(?: 0)?(?: or(?: any)? later| only)?"),
    ("gpl", " gnu general; gnu gpl", "gnu (?:general public licen[cs]e|gpl)"),
    ("lgpl-3.0", " lesser general; lgpl", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?v?3(?: 0)?"),
    ("lgpl-2.1", " lesser general; lgpl", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?v?2 1"),
    ("lgpl", " lesser general; library general", "(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("agpl-3.0", " affero; agpl", "(?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version| v)? ?v?3(?: 0)?"),
    ("agpl", " affero", "affero general public licen[cs]e"),
    ("gfdl", " free documentation", "gnu free documentation licen[cs]e"),
    ("mpl-2.0", " mozilla; mpl", "(?:mozilla public licen[cs]e|mpl)(?: version| v)? ?v?2(?: 0)?"),
    ("mpl-1.1", " mozilla; mpl", "(?:mozilla public licen[cs]e|mpl)(?: version| v)? ?v?1 1"),
    ("mpl", " mozilla", "mozilla public licen[cs]e"),
    ("epl-2.0", " eclipse; epl", "(?:eclipse public licen[cs]e|epl)(?: version| v)? ?v?2(?: 0)?"),
    ("epl-1.0", " eclipse; epl", "(?:eclipse public licen[cs]e|epl)(?: version| v)? ?v?1(?: 0)?"),
    ("cddl-1.0", " common development; cddl", "(?:common development and distribution licen[cs]e|cddl)"),
    ("cpl-1.0", " common public", "common public licen[cs]e"),
    ("cc0-1.0", " cc0; cc zero; creative commons", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?"),
    ("cc-by-sa", " cc by; creative commons", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nc", " cc by; creative commons", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?"),
    ("cc-by-nd", " cc by; creative commons", "(?:cc by nd|creative commons attribution no ?deriv(?:s|atives?))(?: [1-4] [05])?"),
    ("cc-by-nc-sa", " cc by; creative commons", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", " cc by; creative commons", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives?))(?: [1-4] [05])?"),
    ("cc-by-4.0", " cc by; creative commons", "(?:cc by|creative commons attribution)(?: international)? 4 0"),
    ("cc-by-3.0", " cc by; creative commons", "(?:cc by|creative commons attribution)(?: unported)? 3 0"),
    ("cc-by", " creative commons", "creative commons attribution"),
    ("artistic-2.0", " artistic licen", "artistic licen[cs]e(?: version)?(?: 2 0)?"),
    ("zlib", " zlib", "zlib(?: libpng)? licen[cs]e"),
    ("unlicense", " unlicen", "(?:the )?unlicen[cs]e"),
    ("bsl-1.0", " boost software", "boost software licen[cs]e(?: version)?(?: 1 0)?"),
    ("wtfpl", " wtfpl; do what the fuck", "(?:wtfpl|do what the fuck you want to public licen[cs]e)"),
    ("odc-by", " odc by; open data commons", "(?:odc by|open data commons attribution)(?: licen[cs]e)?"),
    ("odbl-1.0", " odbl; open database", "(?:odbl|open database licen[cs]e)"),
    ("ofl-1.1", " open font; sil open", "(?:sil )?open font licen[cs]e"),
    ("python-2.0", " python software", "python software foundation licen[cs]e"),
    ("eupl-1.2", " eupl; european union public", "(?:eupl|european union public licen[cs]e)(?: version| v)? ?v?(?:1 2)?"),
    ("ms-pl", " ms pl; microsoft public", "(?:ms pl|microsoft public licen[cs]e)"),
    ("sspl-1.0", " server side public; sspl", "(?:server side public licen[cs]e|sspl)(?: version| v)?(?: ?v?1(?: 0)?)?"),
    ("busl-1.1", " business source", "business source licen[cs]e(?: version)?(?: 1 1)?"),
    ("elastic-2.0", " elastic licen", "elastic licen[cs]e(?: version)?(?: v?2(?: 0)?)?"),
    ("postgresql", " postgresql licen", "postgresql licen[cs]e"),
    ("ncsa", " university of illinois; uiuc; ncsa", "(?:university of illinois|uiuc)(?: ncsa)? open source licen[cs]e"),
    ("osl-3.0", " open software licen", "open software licen[cs]e(?: version| v)?(?: ?v?3(?: 0)?)?"),
    ("afl-3.0", " academic free", "academic free licen[cs]e(?: version| v)?(?: ?v?3(?: 0)?)?"),
    ("cecill-b", " cecill", "cecill b"),
    ("cecill-c", " cecill", "cecill c"),
    ("cecill-2.1", " cecill", "cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version)? 2(?: [01])?"),
    ("upl-1.0", " universal permissive", "universal permissive licen[cs]e(?: upl)?(?: version| v)?(?: 1 0)?"),
    ("mulanpsl-2.0", " mulan; mulanpsl", "(?:mulan permissive software licen[cs]e|mulan ?psl)(?: version)?(?: ?v2)?"),
    ("php-3.01", " php licen; php software", "php (?:software )?licen[cs]e(?: version)?(?: 3 0?1)?"),
    ("w3c", " w3c", "w3c software(?: notice)?(?: and(?: document)?(?: notice)?)?(?: and)? licen[cs]e"),
    ("lppl-1.3c", " latex project; lppl", "(?:latex project public licen[cs]e|lppl)(?: version)?(?: 1 3[ac]?)?"),
    ("ijg", " independent jpeg", "independent jpeg group licen[cs]e"),
    ("apsl-2.0", " apple public", "apple public source licen[cs]e(?: version)?(?: 2 0)?"),
    ("ms-rl", " ms rl; microsoft reciprocal", "(?:ms rl|microsoft reciprocal licen[cs]e)"),
    ("qpl-1.0", " q public", "q public licen[cs]e(?: version)?(?: 1 0)?"),
    ("sleepycat", " sleepycat", "sleepycat(?: public)? licen[cs]e"),
    ("nposl-3.0", " non profit open", "non profit open software licen[cs]e(?: version)?(?: 3 0)?"),
    ("rpl-1.5", " reciprocal public", "reciprocal public licen[cs]e(?: version)?(?: 1 5)?"),
    ("ecl-2.0", " educational community", "educational community licen[cs]e(?: version)?(?: 2 0)?"),
    ("ipl-1.0", " ibm public", "ibm public licen[cs]e(?: version)?(?: 1 0)?"),
    ("ruby", " ruby licen; ruby s licen", "ruby(?: s)? licen[cs]e"),
    ("vim", " vim licen", "vim licen[cs]e"),
    ("openssl", " openssl licen", "openssl licen[cs]e"),
    ("zpl-2.1", " zope public", "zope public licen[cs]e(?: version| v)?(?: 2 [01])?"),
    ("blueoak-1.0.0", " blue oak", "blue oak model licen[cs]e(?: 1 0 0)?"),
    ("0bsd", " 0bsd; zero clause", "(?:0bsd|(?:bsd )?zero clause(?: bsd)?(?: licen[cs]e)?)"),
    ("mit-0", " mit no attribution", "mit no attribution(?: licen[cs]e)?"),
    ("polyform-noncommercial", " polyform", "polyform noncommercial(?: licen[cs]e)?(?: 1 0 0)?"),
    ("commons-clause", " commons clause", "commons clause(?: licen[cs]e)?(?: condition)?(?: v?1 0)?"),
    ("pddl-1.0", " pddl; public domain dedication and licen", "(?:pddl|public domain dedication and licen[cs]e)"),
    ("cc-pdm", " public domain mark", "public domain mark(?: 1 0)?"),
    ("ogl-3.0", " open government", "open government licen[cs]e(?: version| v)?(?: ?v?3(?: 0)?)?"),
    ("openrail", " openrail; responsible ai", "(?:(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?|responsible ai licen[cs]e)"),
    ("public-domain", " public domain", "public domain"),
    ("proprietary", " proprietary and confidential", "proprietary and confidential"),
)

#: Priority, weight, and the phrasing around a name.
PHRASINGS = (
    (60, 1.0, "spdx licen[cs]e identifier (?:{})"),
    (50, 1.0, "(?:licen[cs]ed|released|distributed|published|made available|provided|available) (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:{})"),
    (45, 0.9, "(?:subject to|governed by|covered by|under) (?:the )?terms (?:and conditions )?of (?:the )?(?:{})"),
    (40, 0.9, "(?:redistribute it and or modify it|use this file|dual licen[cs]ed) (?:except in compliance with|under) (?:the )?(?:{})"),
    (35, 0.8, "(?:see|read) (?:the )?(?:file )?(?:{}) for (?:more )?details"),
    (30, 0.8, "(?:copy of|full text of|text of) the (?:{})"),
    (10, 0.6, "(?:{})"),
)
#: Label, keyword (begins a word) and pattern of sentences that stand in the bodies of licenses, in normalised words.
BODIES = (
    ("mit", " permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", " the above copyright notice and this", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", " except as contained", "except as contained in this notice the names? of (?:[a-z0-9]+ ){1,12}shall not be used in advertising"),
    ("isc", " permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", " permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("bsd", " redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", " redistributions of source", "redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", " redistributions in binary", "redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd-3-clause", " neither the name", "neither the names? of (?:[a-z0-9]+ ){1,16}may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", " all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", " you may not use this", "you may not use this file except in compliance with the license"),
    ("apache-2.0", " distributed on an", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", " each contributor hereby", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("gpl", " this program is free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", " the licenses for most", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", " the gnu general public", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", " the licenses for most", "the licenses for most software and other practical works are designed to take away your freedom"),
    ("lgpl", " this library is free", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl-3.0", " the gnu affero", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("fsf-license-text", " everyone is permitted", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gfdl", " permission is granted", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", " this source code form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", " the contents of this file", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("cddl-1.0", " the contents of this file", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl", " this program and the", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", " this software is provided", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", " altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", " permission is hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", " this is free and", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", " everyone is permitted", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("beerware", " as long as you retain", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0-1.0", " the person who associated", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", " you must give appropriate", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-deed", " you are free to", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-deed", " adapt remix", "adapt remix transform and build upon the material for any purpose even commercially"),
    ("cc-by-nc", " you may not use the", "you may not use the material for commercial purposes"),
    ("cc-by-nd", " if you remix", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", " if you remix", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("ofl-1.1", " the fonts and derivatives", "the fonts and derivatives however cannot be released under any other type of license"),
    ("artistic", " this package is free", "this package is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("python-2.0", " psf is making", "psf is making python available to licensee on an as is basis"),
    ("openssl", " this product includes", "this product includes software developed by the openssl project"),
    ("ms-pl", " if you use the software", "if you use the software you accept this license if you do not accept the license do not use the software"),
    ("sspl-1.0", " if you make the functionality", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("busl-1.1", " the licensor hereby grants", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl-1.1", " effective on the change", "effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("elastic-2.0", " you may not provide the", "you may not provide the software to third parties as a hosted or managed service"),
    ("elastic-2.0", " you may not move", "you may not move change disable or circumvent the license key functionality in the software"),
    ("postgresql", " permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", " redistributions of source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("osl-3.0", " licensed under the open", "licensed under the open software license version 3 0"),
    ("afl-3.0", " licensed under the academic", "licensed under the academic free license version 3 0"),
    ("cecill", " this software is governed", "this software is governed by the cecill(?: [bc])? license under french law and abiding by the rules of distribution of free software"),
    ("upl-1.0", " subject to the condition", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("mulanpsl-2.0", " you can use this software", "you can use this software according to the terms and conditions of the mulan psl v2"),
    ("php-3.01", " products derived from this", "products derived from this software may not be called php nor may php appear in their name"),
    ("php-3.01", " this product includes", "this product includes php software freely available from"),
    ("w3c", " by obtaining", "by obtaining(?: using and or copying)? this work you the licensee agree that you have read understood and will comply with the following terms and conditions"),
    ("lppl-1.3c", " this work may be distributed", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("lppl-1.3c", " this work has the lppl", "this work has the lppl maintenance status"),
    ("ijg", " this software is based in part", "this software is based in part on the work of the independent jpeg group"),
    ("apsl-2.0", " this file contains original", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("ms-rl", " for any file you distribute", "for any file you distribute that contains code from the software"),
    ("sleepycat", " redistributions in any form", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("ecl-2.0", " licensed under the educational", "licensed under the educational community license version 2 0"),
    ("ruby", " you may make and give", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("vim", " there are no restrictions on", "there are no restrictions on distributing unmodified copies of vim"),
    ("openssl", " the names openssl", "the names openssl toolkit and openssl project must not be used to endorse or promote products"),
    ("ssleay", " this product includes", "this product includes cryptographic software written by"),
    ("zpl-2.1", " names of the copyright", "names of the copyright holders must not be used to endorse or promote products derived from this software without prior written permission"),
    ("blueoak-1.0.0", " this license gives everyone", "this license gives everyone as much permission to work with this software as possible"),
    ("0bsd", " permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("mit-0", " to permit persons", "to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("polyform-noncommercial", " any noncommercial purpose", "any noncommercial purpose is a permitted purpose"),
    ("commons-clause", " the grant of rights", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("pddl-1.0", " made available under the public", "made available under the public domain dedication and license"),
    ("odbl-1.0", " open database license", "this [a-z0-9]+(?: [a-z0-9]+){0,6} is made available under the open database license"),
    ("cc-pdm", " this work has been identified", "this work has been identified as being free of known restrictions under copyright law"),
    ("ogl-3.0", " contains public sector", "contains public sector information licensed under the open government licence"),
    ("openrail", " use based restrictions", "use based restrictions(?: as referenced in paragraph 5)? (?:must|shall) be included as an enforceable provision"),
    ("epl-2.0", " this program and the", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cpl-1.0", " the accompanying program", "the accompanying program is provided under the terms of this common public license"),
    ("epl-1.0", " the accompanying program", "the accompanying program is provided under the terms of this eclipse public license"),
    ("ipl-1.0", " the accompanying program", "the accompanying program is provided under the terms of this ibm public license"),
    ("artistic-2.0", " everyone is permitted", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package"),
    ("artistic-1.0", " the intent of this document", "the intent of this document is to state the conditions under which a package may be copied"),
    ("gpl-2.0", " this program is free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", " this program is free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("agpl-3.0", " this program is free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("lgpl-2.1", " this library is free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", " this version of the gnu lesser", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("gpl-linking-exception", " as a special exception", "as a special exception (?:the copyright holders? of this (?:library|program)|you may|if other files) (?:gives? (?:you )?permission to link|link|instantiate)"),
    ("gcc-runtime-exception", " gcc runtime library", "gcc runtime library exception"),
    ("classpath-exception", " classpath exception", "(?:with the )?classpath exception"),
    ("llvm-exception", " llvm exception", "(?:apache 2 0 )?with llvm exceptions?"),
    ("bsd-3-clause-clear", " no express or implied", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-patent", " subject to the terms and conditions", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license"),
    ("json", " the software shall be used", "the software shall be used for good not evil"),
    ("curl", " permission to use", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies except as contained"),
    ("unicode", " permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode data files|data files) and any associated documentation"),
    ("bzip2", " the origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("fsf-unlimited", " the author gives unlimited; the free software foundation gives unlimited", "(?:the author|the free software foundation) gives unlimited permission to copy and or distribute it with or without modifications"),
    ("naist-2003", " use reproduction and distribution", "use reproduction and distribution of this software is permitted"),
    ("warranty-disclaimer", " in no event shall", "in no event shall the (?:[a-z0-9]+ ){1,12}be liable for any (?:claim|direct)"),
    ("warranty-disclaimer", " in the hope that", "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("warranty-disclaimer", " the software is provided", "the software is provided as is without warranty of any kind express or implied"),
)

#: Notices without a license name.
NOTICES = (
    ("copyright", " copyright; copr ", 20, 0.5, "(?:copyright|copr)(?: c| ©)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("reserved", " rights reserved", 20, 0.5, "(?:no|some|all) rights reserved"),
    ("warranty-disclaimer", " warranty", 15, 0.4, "without (?:any )?warranty(?: of any kind)?"),
    ("as-is", " provided as is", 15, 0.4, "provided as is"),
    ("no-redistribution", " may not be; do not", 15, 0.5, "(?:may not be|do not) (?:copied|copy|redistributed?|reproduced?) without (?:prior )?(?:written )?permission"),
)


def keywords(told: str) -> list[str]:
    """The strings of a rule's keyword list, each with the blank before its first word."""
    return [" " + k.lstrip() for k in told.split(";")]


def rules() -> list[tuple[str, str, int, float, str]]:
    """(label, keywords, priority, weight, pattern) of every signature, by falling priority."""
    found = [(label, keyword, priority, weight, phrasing.format(name)) for label, keyword, name in NAMES for priority, weight, phrasing in PHRASINGS]
    bodies = [(label, keyword, 55, 1.0, pattern) for label, keyword, pattern in BODIES]
    return sorted([*bodies, *found, *NOTICES], key=lambda r: -r[2])


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _word_spans(padded: Column, pattern: Column) -> Column:
    """Spans in words of a pattern that begins and ends at words, in text with one blank before every word and one after all."""
    bounded = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    matches = F.transform(F.regexp_extract_all(padded, bounded, F.lit(0)), _blanks)
    pieces = F.transform(F.split(padded, bounded, -1), _blanks)
    # Blanks before a match count its words and one more; a match of n words holds n - 1 blanks.
    return bound(F.struct(pieces.alias("p"), matches.alias("m")), lambda s: F.zip_with(starts(s["p"], s["m"]), s["m"], lambda at, n: F.struct((at - 1).alias("start"), (at + n).alias("end"))))


def _phrase(padded: Column, phrase: str, label: str) -> Column:
    places = F.transform(_word_spans(padded, F.lit(phrase)), lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start")))
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), places).otherwise(F.array().cast("array<struct<label:string,start:int>>"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base (array of label, start), detections (array of label, priority, weight, start, end).

    Words are counted from 0, ends exclusive. A null or empty text has no words and no detections; other columns of
    ``docs`` are ignored; repeated rows and null ``doc_id`` keep their rows.
    """
    # lower() equals lower-casing A-Z alone here: what it does beyond stays outside ASCII, but for characters (Kelvin
    # sign) that no phrase holds; and it moves no character between words and gaps.
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(" "), words, F.lit(" ")).alias("padded"))
    padded = F.col("padded")
    base = [_phrase(padded, phrase, label) for phrase, label in BASE.items()]
    families: dict[str, list] = {}
    for rule in rules():
        families.setdefault(rule[1], []).append(rule)
    detection = "array<struct<label:string,priority:int,weight:double,start:int,end:int>>"
    table = F.array(*(F.struct(F.array(*map(F.lit, keywords(k))).alias("keywords"), F.array(*(F.struct(F.lit(r[0]).alias("label"), F.lit(r[2]).alias("priority"), F.lit(r[3]).alias("weight"), F.lit(r[4]).alias("pattern")) for r in own)).alias("rules")) for k, own in families.items()))
    # Every keyword of every rule begins a word: one pattern over the words tells the few texts on which rules are tried.
    prefilter = " (?:" + "|".join(sorted({k[1:] for f in families for k in keywords(f)})) + ")"
    tried = F.flatten(F.transform(F.filter(table, lambda f: F.exists(f["keywords"], lambda k: F.contains(padded, k))), lambda f: f["rules"]))
    places = F.transform(
        F.filter(tried, lambda r: F.rlike(padded, F.concat(F.lit("(?<= )(?:"), r["pattern"], F.lit(")(?= )")))),
        lambda r: F.transform(_word_spans(padded, r["pattern"]), lambda s: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight"), s["start"].alias("start"), s["end"].alias("end"))),
    )
    found = texts.select(
        "doc_id",
        F.when(F.trim(padded) == "", 0).otherwise(_blanks(padded) - 1).alias("n_words"),
        F.concat(*base).alias("base"),
        F.when(padded.rlike(prefilter), F.flatten(places)).otherwise(F.array().cast(detection)).alias("all_detections"),
    )
    # A detection is covered if one that starts no later, is as wide or wider and has no lower priority ends no sooner. In
    # this order all that can cover it stand before it: ends are kept by priority, each for that priority and those below.
    ranks = sorted({r[2] for r in rules()})
    rank = F.create_map(*(F.lit(v) for i, p in enumerate(ranks) for v in (p, i)))
    order = F.array_sort(F.transform("all_detections", lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("below"), d["label"].alias("label"), d.alias("told"), F.element_at(rank, d["priority"]).alias("rank"))))
    found = found.select("doc_id", "n_words", "base", order.alias("ordered"))
    none = F.array(*(F.lit(-1) for _ in ranks))
    least = lambda s, x: F.transform(s, lambda v, i: F.when(i <= x["rank"], F.greatest(v, x["told"]["end"])).otherwise(v))
    ends = running(F.col("ordered"), none, "array<int>", least, lambda s, t: F.zip_with(s, t, lambda x, y: F.greatest(x, y)))
    marked = F.zip_with("ordered", ends, lambda x, e: F.struct(x["told"].alias("told"), (F.get(e, x["rank"]) >= x["told"]["end"]).alias("covered")))
    kept = F.transform(F.filter(marked, lambda m: ~m["covered"]), lambda m: m["told"])
    return found.select("doc_id", "n_words", "base", F.when(F.size("ordered") > 0, kept).otherwise(F.array().cast(detection)).alias("detections"))
