"""License scans, with DataFrame operations only.

Texts are lower-cased (A-Z) and reduced to words with single spaces. Ordered signature rules are regular
expressions over those words: nearly two hundred sentences of license texts and notices written by hand, and
for each name of a license its identifier line, grants and plain mentions, with and without a version. Each
rule has keywords, one for each of its spellings: a rule is tried only on texts that hold one, and a search
for a few word parts, one of which every rule needs, lets most texts through untouched.

Detections are resolved by priority, then by place: of the highest priority the leftmost stay, the longest of
one place, the earlier rule of one interval; of each lower priority in turn those that neither lie inside
nor overlap nor contain what was kept. What is suppressed suppresses nothing. The work is n log n in the
number of detections, but for joining them in pieces.

Edge cases: a null text is empty; texts without a keyword have only their word count, empty labels,
null places and score 0. Repeated rows are scanned one by one. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let, running, spans, with_fixed

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label | names | versions: the license families. Each name is its own keyword.
FAMILIES = """
mit | mit;expat;mit x11;mit expat |
mit-0 | mit 0;mit no attribution |
apache | apache;apache software;apache software foundation | 1 0;1 1;2 0
bsd-2-clause | bsd 2 clause;2 clause bsd;simplified bsd;freebsd;two clause bsd |
bsd-3-clause | bsd 3 clause;3 clause bsd;new bsd;modified bsd;revised bsd;three clause bsd |
bsd-4-clause | bsd 4 clause;4 clause bsd;original bsd;four clause bsd |
bsd | bsd;bsd style |
0bsd | 0bsd;zero clause bsd;bsd zero clause |
gpl | gpl;gnu gpl | 1 0;2 0;3 0;1;2;3
gpl | gnu general public;general public | 1;2;3;2 0;3 0
lgpl | lgpl;gnu lgpl | 2 0;2 1;3 0;2;3
lgpl | gnu lesser general public;lesser general public | 2 1;3;3 0
lgpl | gnu library general public;library general public | 2;2 0
agpl | agpl;gnu agpl | 1 0;3 0;3
agpl | gnu affero general public;affero general public | 1;3;3 0
gfdl | gnu free documentation;free documentation | 1 1;1 2;1 3
gfdl | gfdl;gnu fdl | 1 1;1 2;1 3
mpl | mozilla public | 1 0;1 1;2 0
mpl | mpl | 1 0;1 1;2 0
epl | eclipse public | 1 0;2 0
epl | epl | 1 0;2 0
cddl | cddl | 1 0;1 1
cddl | common development and distribution | 1 0;1 1
cpl | common public | 1 0
eupl | european union public | 1 0;1 1;1 2
eupl | eupl | 1 0;1 1;1 2
osl | open software | 1 0;2 0;2 1;3 0
afl | academic free | 1 2;2 0;2 1;3 0
artistic | artistic;perl artistic | 1 0;2 0
boost | boost software;boost | 1 0
isc | isc |
zlib | zlib;zlib libpng |
unlicense | unlicense;the unlicense |
wtfpl | wtfpl;do what the fuck you want to public | 1 0;2
python | python software foundation;psf | 2;2 0
ruby | ruby |
php | php | 3 0;3 01
postgresql | postgresql |
openssl | openssl;openssl ssleay |
ncsa | ncsa;university of illinois ncsa;university of illinois open source |
ms-pl | microsoft public;ms pl |
ms-rl | microsoft reciprocal;ms rl |
ecl | educational community | 1 0;2 0
upl | universal permissive | 1 0
blueoak | blue oak model | 1 0 0
ofl | sil open font;open font | 1 0;1 1
ofl | ofl;sil ofl | 1 0;1 1
odbl | odbl | 1 0
odbl | open database;open data commons open database | 1 0
odc-by | open data commons attribution;odc by | 1 0
pddl | public domain dedication;public domain dedication and | 1 0
cc0 | cc0;creative commons cc0;creative commons zero | 1 0
cc-by-nc-nd | cc by nc nd | 1 0;2 0;2 5;3 0;4 0
cc-by-nc-sa | cc by nc sa | 1 0;2 0;2 5;3 0;4 0
cc-by-nc | cc by nc | 1 0;2 0;2 5;3 0;4 0
cc-by-nd | cc by nd | 1 0;2 0;2 5;3 0;4 0
cc-by-sa | cc by sa | 1 0;2 0;2 5;3 0;4 0
cc-by | cc by | 1 0;2 0;2 5;3 0;4 0
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s | 2 0;2 5;3 0;4 0
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike | 2 0;2 5;3 0;4 0
cc-by-nc | creative commons attribution non ?commercial | 2 0;2 5;3 0;4 0
cc-by-nd | creative commons attribution no ?deriv(?:ative)?s | 2 0;2 5;3 0;4 0
cc-by-sa | creative commons attribution share ?alike | 2 0;2 5;3 0;4 0
cc-by | creative commons attribution | 2 0;2 5;3 0;4 0
"""

#: label | keywords between semicolons | sentence: signatures written by hand, each a regular expression over the words.
SENTENCES = """
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | copyright holders be liable | in no event shall the authors or copyright holders be liable for any claim damages or other liability
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used
hpnd | supporting documentation | both that copyright notice and this permission notice appear in supporting documentation
hpnd | representations about the suitability | makes no representations about the suitability of this software for any purpose
hpnd | and its documentation for any | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
libtiff | distribute and sell | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
isc | hereby granted | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | hereby granted | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is
curl | hereby granted | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | source code must retain | redistributions of source code must retain the above copyright notice this list of conditions
bsd | binary form must reproduce | redistributions in binary form must reproduce the above copyright notice
bsd | software is provided by the | this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) as is
bsd | procurement of substitute | procurement of substitute goods or services loss of use data or profits or business interruption
bsd-2-clause-views | views and conclusions | the views and conclusions contained in the software and documentation are those of the authors
bsd-2-clause-patent | receiving rights under this license | hereby grants to those receiving rights under this license a perpetual worldwide
bsd-3-clause | endorse or promote | neither the names? of .{1,80} nor the names of its contributors may be used to endorse or promote products
bsd-3-clause-clear | licenses to any party s patent | no express or implied licenses to any party s patent rights are granted by this license
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
apache-2.0 | compliance with the license | you may not use this file except in compliance with the license
apache-2.0 | apache org licenses | apache org licenses license 2 0
apache-2.0 | each contributor hereby grants | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except)
apache-2.0 | distributed on an as is basis | software distributed under the license is distributed on an as is basis
apache-2.0 | carry prominent notices | you must cause any modified files to carry prominent notices stating that you changed the files
apache-1.1 | developed by the apache | this product includes software developed by the apache software foundation
apache-1.1 | called apache | products derived from this software may not be called apache nor may apache appear in their name
llvm-exception | llvm exceptions | (?:apache license v(?:ersion )? ?2 0 with llvm exceptions|llvm exceptions to the apache 2 0 license)
gpl | free software foundation | it under the terms of the gnu general public license as published by the free software foundation
lgpl | free software foundation | it under the terms of the gnu lesser general public license as published by the free software foundation
agpl | free software foundation | it under the terms of the gnu affero general public license as published by the free software foundation
gpl | any later version | either version [123](?: 0)? of the license or at your option any later version
gpl | gnu org licenses | gnu org licenses(?: gpl)?
gpl | program is free software | this program is free software you can redistribute it and or modify
gpl | will be useful but without any warranty | distributed in the hope that it will be useful but without any warranty
gpl | implied warranty of merchantability | without even the implied warranty of merchantability or fitness for a particular purpose
gpl | received a copy of the gnu | you should have received a copy of the gnu general public license along with
lgpl | received a copy of the gnu | you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl | received a copy of the gnu | you should have received a copy of the gnu affero general public license along with
gpl-2 | designed to take away your freedom | the licenses for most software are designed to take away your freedom to share and change it
gpl-2 | physical act of transferring | you may charge a fee for the physical act of transferring a copy
gpl-3 | free copyleft license | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3 | convey verbatim copies | you may convey verbatim copies of the program s source code as you receive it
gpl-3 | installation information | installation information for a user product means any methods procedures authorization keys
gpl | verbatim copies of this license document | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
lgpl-3 | incorporates the terms | this version of the gnu lesser general public license incorporates the terms and conditions of version 3
lgpl-2.1 | derivative of any portion of the library | a program that contains no derivative of any portion of the library but is designed to work with the library
agpl-3.0 | interacting with it remotely | your modified version must prominently offer all users interacting with it remotely through a computer network
gpl-linking-exception | statically or dynamically with other modules | linking this library statically or dynamically with other modules is making a combined work
gpl-linking-exception | special exception if you link | as a special exception if you link this library with other files
classpath-exception | copyright holders of this library | as a special exception the copyright holders of this library give you permission to link
gcc-exception | gcc runtime library | gcc runtime library exception
autoconf-exception | configure scripts | gives unlimited permission to copy distribute and modify (?:the )?configure scripts
bison-exception | bison parser skeleton | you may create a larger work that contains part or all of the bison parser skeleton
openssl-exception | with the openssl | permission to link (?:the code of )?(?:portions of )?this program with the openssl (?:library|project s openssl library)
gfdl | modify this document under | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant sections | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | mozilla org mpl | mozilla org mpl 2 0
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | copy of the mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 | incompatible with secondary | incompatible with secondary licenses as defined by the mozilla public license
mpl-1.1 | subject to the mozilla | the contents of this file are subject to the mozilla public license version 1 1
npl | netscape public | subject to the netscape public license
epl | the eclipse public | are made available under the terms of the eclipse public license
epl | recipient s acceptance | any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
cpl | this common public | the accompanying program is provided under the terms of this common public license
ipl | ibm public | provided under the terms of this ibm public license
cddl | common development and distribution | subject to the terms of the common development and distribution license
cddl | cddl header | include this cddl header notice in each file
eupl | european union public licence eupl | this european union public licence eupl applies to the work
artistic-1.0 | semblance of artistic control | such that the copyright holder maintains some semblance of artistic control over the development of the package
artistic-2.0 | given free software package | the terms under which a given free software package may be copied modified distributed and or redistributed
perl | as perl itself | under the same terms as perl itself
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented
zlib | express or implied warranty in no event | provided as is without any express or implied warranty in no event will the authors be held liable
zlib | claim that you wrote | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | group 42 | the contributing authors and group 42 inc disclaim all warranties
boost-1.0 | machine executable | unless such copies or derivative works are solely in the form of machine executable object code
boost-1.0 | person or organization obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
unlicense | public domain | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | dedicate any and all copyright | the author or authors of this software dedicate any and all copyright interest
public-domain | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | public domain | (?:is|are) in the public domain
public-domain | copyright | no copyright is claimed
sqlite | disclaims copyright | the authors? disclaims copyright to this source code
sqlite | forgiveness for yourself | may you find forgiveness for yourself and forgive others
us-government | states government;us government;u s government | work of the (?:us|u s|united states) government and is not subject to copyright protection
wtfpl | what the fuck | you just do what the fuck you want to
wtfpl | as long as the name is changed | changing it is allowed as long as the name is changed
cc | creative commons | (?:licensed|released|available|published) under (?:a|the) creative commons
cc | appropriate credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc | exercising the licensed rights | by exercising the licensed rights defined below you accept and agree to be bound by the terms
cc | otherwise noted | except where otherwise noted (?:content on|this work|this site|this wiki) (?:this site )?is licensed under
cc-by-nc | use the material for commercial | you may not use the material for commercial purposes
cc-by-sa | under the same license as the original | you must distribute your contributions under the same license as the original
cc-by-nd | distribute the modified material | you may not distribute the modified material under this licen[cs]e
cc0 | creativecommons org publicdomain | creativecommons org publicdomain zero 1 0
cc0 | related or neighboring rights | waived all copyright and related or neighboring rights
cc0 | associated a work with this deed | the person who associated a work with this deed has dedicated the work to the public domain
cc-by | creativecommons org licenses | creativecommons org licenses by(?: \\d \\d)?
cc-by-sa | creativecommons org licenses | creativecommons org licenses by sa(?: \\d \\d)?
cc-by-nc | creativecommons org licenses | creativecommons org licenses by nc(?: \\d \\d)?
cc-by-nc-sa | creativecommons org licenses | creativecommons org licenses by nc sa(?: \\d \\d)?
cc-by-nd | creativecommons org licenses | creativecommons org licenses by nd(?: \\d \\d)?
cc-by-nc-nd | creativecommons org licenses | creativecommons org licenses by nc nd(?: \\d \\d)?
odbl | open database | is made available under the open database licen[cs]e
ogl | open government licen | contains public sector information licensed under the open government licen[cs]e
ogl | open government licen | open government licen[cs]e v(?:ersion )?[123](?: 0)?
dl-de | datenlizenz deutschland | datenlizenz deutschland (?:namensnennung|zero)(?: version)? 2 0
etalab | licence ouverte | licence ouverte(?: open licence)?(?: version)? [12] 0
ofl | font software is licensed | this font software is licensed under the sil open font license
ofl | font software nor any | neither the font software nor any of its individual components in original or modified versions may be sold by itself
ufl | ubuntu font | ubuntu font licen[cs]e
python | psf is making python | psf is making python available to licensee on an as is basis
python | license agreement is between the python | this license agreement is between the python software foundation
php | includes php software | this product includes php software freely available from
openssl | openssl toolkit | developed by the openssl project for use in the openssl toolkit
ssleay | written by eric young | this product includes cryptographic software written by eric young
postgresql | university of california be liable | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
ms-pl | if you use the software you accept | if you use the software you accept this license if you do not accept the license do not use the software
upl | associated documentation and or data | a copy of this software associated documentation and or data collectively the software
blueoak | as much permission | this license gives everyone as much permission to work with this software as possible
beerware | buy me a beer | you think this stuff is worth it you can buy me a beer
beerware | beer ware | the beer ware license
json | used for good not evil | the software shall be used for good not evil
unicode | unicode data files | obtaining a copy of the unicode data files and any associated documentation
unicode | unicode inc license | unicode inc license agreement data files and software
w3c | w3c software notice | w3c software notice and(?: document)? license
w3c | using and or copying this work | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
tcl | authors hereby grant permission | the authors hereby grant permission to use copy modify distribute and license this software and its documentation
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
freetype | freetype project | (?:portions of this software are copyright (?:c )?.{0,20}the freetype project|the freetype project license)
imagemagick | imagemagick license | imagemagick license
vim | vim is charityware;vim license | (?:vim is charityware|the vim license)
sleepycat | how to obtain complete source code | redistributions in any form must be accompanied by information on how to obtain complete source code
lppl | latex project public | under the conditions of the latex project public license
man-pages | copies of this manual | permission is granted to make and distribute verbatim copies of this manual provided the copyright notice
info-zip | event shall info zip | in no event shall info zip or its contributors be held liable
rsa-md | message digest algorithm | rsa data security inc md[45] message digest algorithm
cecill | cecill | governed by the cecill(?: [abc])? license
cecill | cecill | cecill(?: [abc])?(?: version \\d \\d)? free software license agreement
mulan | mulan permissive;mulan psl | (?:mulan permissive software license|licensed under mulan psl v[12])
sspl | server side public | server side public license
busl | business source | business source license(?: 1 1)?
busl | non production use | make non production use of the licensed work
elastic | elastic license | elastic license(?: 2 0)?
elastic | hosted or managed service | provide the software to third parties as a hosted or managed service
commons-clause | commons clause | commons clause license condition
polyform | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license
confluent | confluent community | confluent community license
rsal | redis source available | redis source available license
openrail | rail m;openrail;responsible ai license | (?:bigscience open rail m license|creativeml open rail m|openrail license|responsible ai license)
llama | community license agreement | llama [234](?: [1234])? community license agreement
gemma | gemma terms | gemma terms of use
hippocratic | hippocratic license | hippocratic license
anti-996 | anti 996 | anti 996 license
parity | parity public | parity public license
prosperity | prosperity public | prosperity public license
fsl | functional source | functional source license
apsl | apple public source | apple public source license
nosa | nasa open source | nasa open source agreement
qpl | q public license | the q public license
rpl | reciprocal public | reciprocal public license
zpl | zope public | zope public license
sissl | industry standards source | sun industry standards source license
aladdin | aladdin free | aladdin free public license
erlang | erlang public | erlang public license
lucent | lucent public | lucent public license
nethack | nethack general | nethack general public license
eiffel | eiffel forum | eiffel forum license
free-art | free art license | free art license
copyleft | copyleft | (?:a|strong|weak|free|permissive) copyleft licen[cs]e
copyright | copyright | copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?
copyright | copyright | (?:is|are) protected by copyright
copyright | permission of the copyright | used (?:by|with) permission of the copyright (?:owner|holder)s?
fair-use | section 107 | under section 107 of the copyright act
reserved | rights reserved | (?:all|some) rights reserved
reserved | in whole or in part | reproduction in whole or in part without (?:written )?permission is prohibited
proprietary | proprietary | (?:this software|this document|this work) is (?:confidential and )?proprietary
proprietary | proprietary and confidential | proprietary and confidential
proprietary | prior written | may not be (?:reproduced|copied|distributed)[a-z ]{0,80} without (?:the )?prior written (?:permission|consent)
proprietary | unauthorized | unauthorized (?:copying|reproduction|distribution|duplication)(?: of this [a-z]{1,20})?(?: via any medium)? is (?:strictly )?prohibited
proprietary | may be reproduced | no part of this (?:publication|document|book|work) may be reproduced
proprietary | licensed materials property | licensed materials property of
eula | end user licen | end user licen[cs]e agreement
eula | reverse engineer | you may not reverse engineer decompile or disassemble the software
eula | using this software;using the software | by (?:installing|downloading|copying|installing copying) or(?: otherwise)? using (?:this|the) software you agree to(?: be bound by)? the terms
commercial | commercial license | (?:requires|under) a commercial license
non-commercial | for non | for non ?commercial (?:use|purposes) only
"""


#: What a name begins with in all its spellings.
LITERAL = re.compile(r"(?:[a-z0-9 ](?!\?))+")


def _rows(text: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in text.strip().replace(" |\n", " | \n").splitlines() for line in [line if not line.endswith("|") else line + " "]]


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keywords between bars, pattern, priority, confidence) of every rule, in order; any text that a rule matches holds one of its keywords."""
    found: dict[str, tuple[str, str, str, int, float]] = {}

    def rule(label: str, keyword: str, pattern: str, priority: int, confidence: float) -> None:
        found.setdefault(pattern, (label, keyword, f"(?<= )(?:{pattern})(?= )", priority, confidence))

    for label, keyword, sentence in _rows(SENTENCES):
        rule(label, keyword.replace(";", "|"), sentence, 4, 1.0)
    for label, names, *versions in _rows(FAMILIES):
        name = "(?:" + "|".join(names.split(";")) + ")"
        keyword = "|".join(LITERAL.match(n)[0] for n in names.split(";"))
        numbers = [v for v in (versions[0].split(";") if versions else []) if v]
        for number in [*sorted(numbers, key=lambda v: -len(v)), ""]:
            own = label + (f"-{number.replace(' ', '.')}" if number else "")
            mark = rf" (?:version |v )?{number}(?: (?:only|or later|or any later version))?" if number else ""
            more = 1 if number else 0
            rule(own, keyword, rf"spdx license identifier {name}{mark}", 6 + more, 1.0)
            rule(own, keyword, rf"(?:licensed|released|distributed|available|published|provided|dual licensed|covered) under (?:the )?(?:terms of )?(?:the )?{name}(?: (?:public )?licen[cs]e)?{mark}", 4 + more, 0.95)
            rule(own, keyword, rf"{name} (?:public )?licen[cs]e{mark}", 2 + more, 0.8)
    return list(found.values())


#: Words before lower-casing; a class of ranges without negation, and no way back, is a tenth of the work.
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]++"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Parts of single words of which any text that a rule or a base phrase matches holds one; between words, separators are still raw.
FRAGMENTS = (
    "licen", "copyright", "rights", "domain", "hereby", "redistribution", "advertising", "endorse", "foundation", "altered",
    "executable", "mozilla", "fuck", "commons", "proprietary", "prior", "commercial", "publicdomain",
    "software", "warrant", "librar", "distribut", "reproduc", "prohibit", "agreement", "terms", "notice", "liable", "openssl", "invariant", "convey",
    "procedures", "procurement", "transferring", "changing", "skeleton", "configure", "remotely", "managed", "deutschland", "creativeml", "cryptograph",
    "digest", "unicode", "forgive", "charityware", "apache",
)
#: The same for what those leave: a grant without the word license, and the two words of a base phrase.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PAIRS = {"under": f"(?:released|distributed|available|published|provided|covered){SEPARATOR}under", "cc": f"cc{SEPARATOR}by", "beer": f"(?:a{SEPARATOR}beer|beer{SEPARATOR}ware)"}


def gate(low: Column) -> Column:
    """Whether a lower-cased text can match anything; plain searches for fragments decide for most texts."""
    found = F.lit(False)
    for fragment in FRAGMENTS:
        found = found | F.contains(low, F.lit(fragment))
    for word, pattern in PAIRS.items():
        found = found | (F.contains(low, F.lit(word)) & low.rlike(pattern))
    return found


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


NONE = "cast(array() as array<struct<start:int,minus_end:int,minus_priority:int,i:int,label:string,confidence:double>>)"
#: The rules' priorities, the highest first.
PRIORITIES = (7, 6, 5, 4, 3, 2)
#: Detections that are joined at a time; what is kept of them is then one piece.
PIECE = 256


def _leftmost(sorted_: Column) -> Column:
    """Of detections in order the first and each next one that begins after the last kept."""
    none = F.expr(NONE)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(sorted_) - 1) / PIECE).cast("int")), lambda k: F.slice(sorted_, k * PIECE + 1, F.lit(PIECE)))

    def step(state: Column, d: Column) -> Column:
        return F.when(d["start"] < state["end"], state).otherwise(F.struct((-d["minus_end"]).alias("end"), F.concat(state["kept"], F.array(d)).alias("kept")))

    def piece(state: Column, p: Column) -> Column:
        own = F.aggregate(p, F.struct(state["end"].alias("end"), none.alias("kept")), step)
        return let(own, lambda o: F.struct(o["end"].alias("end"), F.concat(state["kept"], F.array(o["kept"])).alias("kept")))

    start = F.struct(F.lit(0).alias("end"), F.slice(F.array(none), 1, 0).alias("kept"))
    return F.flatten(F.aggregate(pieces, start, piece, lambda s: s["kept"]))


def _apart(found: Column, kept: Column) -> Column:
    """Of sorted detections those that overlap none of ``kept``, which are apart from one another."""
    both = F.array_sort(F.concat(
        F.transform(kept, lambda d: F.struct(d["start"].alias("start"), F.lit(0).alias("new"), d["minus_end"].alias("minus_end"), d.alias("d"))),
        F.transform(found, lambda d: F.struct(d["start"].alias("start"), F.lit(1).alias("new"), d["minus_end"].alias("minus_end"), d.alias("d"))),
    ))

    def free(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda x: F.when(x["new"] == 0, -x["minus_end"]).otherwise(0)), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(all_, lambda x: F.when(x["new"] == 0, x["start"]).otherwise(2147483647))), F.least))

        def apart(e: Column, s: Column) -> Column:
            return F.filter(all_, lambda x, i: (x["new"] == 1) & (F.get(e, i) <= x["start"]) & (F.get(s, i) >= -x["minus_end"]))

        return F.transform(let(ends, lambda e: let(starts, lambda s: apart(e, s))), lambda x: x["d"])

    return let(both, free)


def resolved(found: Column) -> Column:
    """Detections, sorted, without the suppressed ones."""

    def level(kept: Column, priority: Column) -> Column:
        def merged(own: Column) -> Column:
            more = let(F.when(F.size(kept) > 0, _apart(own, kept)).otherwise(own), lambda o: F.when(F.size(o) > 0, _leftmost(o)).otherwise(o))
            return F.when(F.size(own) == 0, kept).otherwise(F.array_sort(F.concat(kept, more)))

        return let(F.filter(found, lambda d: d["minus_priority"] == -priority), merged)

    return F.aggregate(F.array(*[F.lit(p) for p in PRIORITIES]), F.expr(NONE), level)


def license_spans(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: id, n_words, n_base, first_word, last_word, base_labels and detections.

    ``detections`` are what is left after suppression: (start, end, rule's priority, label, confidence),
    places being characters of the text's words joined by single spaces, with one space before.
    """
    words = F.coalesce(F.regexp_count(F.col("body"), F.lit(WORD)), F.lit(0)).cast("long")
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.col("body"), UPPER, LOWER), NO_WORD, " ")), F.lit(" "))
    rows = with_fixed(docs.select(F.col(id_col), F.col(text).alias("body")), flat=F.when(let(F.lower("body"), gate), flat)).select(id_col, words.alias("n_words"), "flat")

    base = F.lit("(?<= )(" + "|".join(BASE) + ")(?= )")
    rows = with_fixed(rows, hits=spans(F.col("flat"), base))
    places = F.filter("hits", lambda h: h["part"].isNotNull())
    first = _spaces(F.substring(F.col("flat"), F.lit(1), places[0]["start"])) - 1
    last = _spaces(F.substring(F.col("flat"), F.lit(1), F.element_at(places, -1)["start"])) - 1
    some = F.coalesce(F.size("hits"), F.lit(0)) > 0
    names = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])
    labels = F.array_sort(F.array_distinct(F.transform("hits", lambda h: names[h["part"]])))
    rows = rows.withColumns({
        "n_base": F.when(some, F.size("hits")).otherwise(0).cast("long"), "first_word": F.when(some, first).cast("long"), "last_word": F.when(some, last).cast("long"),
        "base_labels": F.when(some, labels).otherwise(F.expr("cast(array() as array<string>)")),
    })

    # rules of the same keywords stand together, so that a text is searched for them once
    sharing: dict[str, list[dict]] = {}
    for i, (label, keyword, pattern, priority, confidence) in enumerate(rules()):
        sharing.setdefault(keyword, []).append({"i": i, "label": label, "pattern": pattern, "priority": priority, "confidence": confidence})
    listed = [{"keywords": [f" {k}" for k in keyword.split("|")], "rules": own} for keyword, own in sharing.items()]
    table = F.from_json(F.lit(json.dumps(listed)), "array<struct<keywords:array<string>,rules:array<struct<i:int,label:string,pattern:string,priority:int,confidence:double>>>>")
    held = F.filter(table, lambda g: F.exists(g["keywords"], lambda k: F.contains(F.col("flat"), k)))
    tried = F.filter(F.flatten(F.transform(held, lambda g: g["rules"])), lambda r: F.rlike(F.col("flat"), r["pattern"]))

    def detections(r: Column) -> Column:
        # ordered by place, the longest first, then by priority and rule
        return F.transform(spans(F.col("flat"), r["pattern"]), lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["i"].alias("i"), r["label"].alias("label"), r["confidence"].alias("confidence")))

    none = F.expr(NONE)
    rows = with_fixed(rows, raw=F.when(F.col("flat").isNull(), none).otherwise(F.array_sort(F.flatten(F.transform(tried, detections)))))

    left = F.when(F.size("raw") > 1, resolved(F.col("raw"))).otherwise(F.col("raw"))
    shown = F.transform(left, lambda d: F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"), (-d["minus_priority"]).alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence")))
    return with_fixed(rows.select(id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "raw"), detections=shown).drop("raw")


def op4_license_scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document."""
    rows = license_spans(documents)
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    score = F.greatest(best, F.when(F.col("n_base") > 0, F.lit(0.6)).otherwise(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
