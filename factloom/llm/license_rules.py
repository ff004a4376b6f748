"""Signature rules for license notices: label | priority | keyword | pattern.

Patterns are matched on normalised text: lower-case words joined by single spaces, punctuation dropped, so that
"Apache License, Version 2.0" reads "apache license version 2 0".  A pattern starts and ends at a word.  A rule is only
tried on texts that contain its keyword.  Priority says how specific the evidence is: 90 and more for passages of a
license's own text, 70 to 89 for notices that name version or terms, 50 to 69 for plain names, less for hints.
"""

from __future__ import annotations

#: Phrases of the base scan and their labels.  Fixed values.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

TEXT = """
mit | 95 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 92 | this permission notice | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies
mit | 80 | mit license | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit license
mit | 78 | spdx license identifier | spdx license identifier mit
mit | 76 | opensource org | opensource org licenses mit(?: license(?: php)?)?
mit | 70 | expat | expat license
mit | 60 | mit license | (?:the )?mit license
mit | 58 | mit style | mit style license
mit-0 | 82 | mit no attribution | mit no attribution(?: license)?
mit-0 | 78 | spdx license identifier | spdx license identifier mit 0
x11 | 84 | x consortium | except as contained in this notice the name of the x consortium shall not be used
x11 | 62 | x11 license | (?:mit )?x11 license
isc | 94 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 78 | spdx license identifier | spdx license identifier isc
isc | 62 | isc license | (?:the )?isc license
bsd-2-clause | 90 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | 80 | 2 clause bsd | 2 clause bsd license
bsd-2-clause | 80 | bsd 2 clause | bsd 2 clause(?: simplified)?(?: license)?
bsd-2-clause | 78 | simplified bsd | simplified bsd license
bsd-2-clause | 72 | freebsd license | freebsd license
bsd-3-clause | 93 | neither the name | neither the names? of (?:\\S+ ){1,12}?nor the names of its contributors may be used to endorse or promote
bsd-3-clause | 80 | 3 clause bsd | 3 clause bsd license
bsd-3-clause | 80 | bsd 3 clause | bsd 3 clause(?: new or revised)?(?: license)?
bsd-3-clause | 76 | new bsd | new bsd license
bsd-3-clause | 76 | modified bsd | modified bsd license
bsd-3-clause | 76 | revised bsd | revised bsd license
bsd-4-clause | 93 | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | 80 | bsd 4 clause | bsd 4 clause(?: original)?(?: license)?
bsd | 60 | bsd license | (?:the )?bsd license
bsd | 58 | bsd style | bsd style license
bsd | 56 | berkeley software | berkeley software distribution license
0bsd | 82 | zero clause bsd | (?:bsd )?zero clause bsd(?: license)?
apache-2.0 | 96 | apache license version 2 0 | licensed under the apache license version 2 0(?: the license)?(?: you may not use this file except in compliance with the license)?
apache-2.0 | 82 | apache license version 2 0 | apache license version 2 0
apache-2.0 | 80 | apache license 2 0 | apache license 2 0
apache-2.0 | 80 | apache org licenses license 2 0 | apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 74 | apache 2 0 | apache 2 0(?: license)?
apache-2.0 | 74 | apache software license version 2 | apache software license version 2(?: 0)?
apache-1.1 | 90 | the apache software foundation | this product includes software developed by the apache software foundation
apache-1.1 | 82 | apache software license version 1 1 | apache software license version 1 1
apache-1.0 | 82 | apache group | this product includes software developed by the apache group
apache | 60 | apache license | (?:the )?apache license
apache | 58 | apache software license | apache software license
gpl | 62 | general public license | gnu general public license
gpl | 60 | general public license | general public license
gpl | 56 | gnu gpl | gnu gpl
gpl | 90 | this program is free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 88 | without even the implied warranty | distributed in the hope that it will be useful but without any warranty without even the implied warranty
gpl | 74 | copy of the gnu general public license | you should have received a copy of the gnu general public license
lgpl | 90 | gnu lesser general public license | under the terms of the gnu lesser general public license
lgpl | 66 | lesser general public license | (?:gnu )?lesser general public license
lgpl | 66 | library general public license | (?:gnu )?library general public license
lgpl | 64 | library or lesser | (?:gnu )?library or lesser general public license
agpl | 90 | affero general public license | under the terms of the gnu affero general public license
agpl | 68 | affero general public license | (?:gnu )?affero general public license
gfdl | 90 | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 66 | free documentation license | (?:gnu )?free documentation license
classpath-exception | 86 | classpath exception | (?:gnu )?classpath exception
classpath-exception | 88 | as a special exception | as a special exception the copyright holders of this library give you permission to link
gcc-exception | 86 | gcc runtime library exception | gcc runtime library exception
mpl-1.1 | 82 | mozilla public license version 1 1 | mozilla public license version 1 1
mpl-2.0 | 94 | source code form is subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 82 | mozilla public license | mozilla public license (?:v|version )?2 0
mpl | 64 | mozilla public license | mozilla public license
epl-1.0 | 82 | eclipse public license | eclipse public license (?:v|v |version )?1 0
epl-2.0 | 82 | eclipse public license | eclipse public license (?:v|v |version )?2 0
epl | 64 | eclipse public license | eclipse public license
edl | 76 | eclipse distribution license | eclipse distribution license(?: v1 0)?
cpl | 70 | common public license | common public license(?: version 1 0)?
cddl-1.0 | 82 | common development and distribution license | common development and distribution license (?:version )?1 0
cddl-1.1 | 82 | common development and distribution license | common development and distribution license (?:version )?1 1
cddl | 66 | common development and distribution license | common development and distribution license
ipl | 70 | ibm public license | ibm public license(?: version 1 0)?
eupl | 72 | european union public licen | european union public licen[cs]e(?: v? ?1 [0-2])?
unlicense | 94 | released into the public domain | this is free and unencumbered software released into the public domain
unlicense | 66 | the unlicense | the unlicense
unlicense | 78 | unlicense org | unlicense org
cc0 | 84 | cc0 1 0 universal | cc0 1 0 universal(?: public domain dedication)?
cc0 | 84 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc0 | 66 | creative commons zero | creative commons zero(?: license)?
public-domain | 60 | public domain | (?:is |are )?(?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | 40 | public domain | in the public domain
creative-commons | 56 | creative commons | creative commons(?: public)? licenses?
creative-commons | 60 | creative commons attribution | creative commons attribution
wtfpl | 92 | do what the fuck you want | do what the fuck you want to(?: public license)?
wtfpl | 66 | wtfpl | wtfpl(?: version 2)?
zlib | 93 | provided as is without any express | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 72 | zlib | zlib(?: libpng)? license
libpng | 76 | libpng license | libpng license(?: version 2)?
bzip2 | 76 | bzip2 license | bzip2 license
boost-1.0 | 84 | boost software license | boost software license version 1 0
boost-1.0 | 72 | boost software license | boost software license
artistic-1.0 | 82 | artistic license | artistic license 1 0
artistic-2.0 | 82 | artistic license | artistic license (?:version )?2 0
artistic | 64 | artistic license | (?:perl )?artistic license
perl | 76 | same terms as perl | (?:under )?the same terms as perl itself
ruby | 68 | ruby license | ruby license
php-3.01 | 82 | php license | php license (?:version )?3 01
php | 64 | php license | php license
python-2.0 | 82 | python software foundation license | python software foundation license(?: version 2)?
python-2.0 | 66 | psf license | psf license
openssl | 90 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 68 | openssl license | openssl license
sleepycat | 68 | sleepycat license | sleepycat license
postgresql | 70 | postgresql licen | postgresql licen[cs]e
curl | 68 | curl license | curl license
ncsa | 76 | university of illinois | university of illinois(?: ncsa)? open source license
ncsa | 70 | ncsa open source license | ncsa open source license
ofl-1.1 | 90 | sil open font license | licensed under the sil open font license version 1 1
ofl | 72 | open font license | (?:sil )?open font license
ubuntu-font | 72 | ubuntu font licen | ubuntu font licen[cs]e(?: version 1 0)?
bitstream-vera | 74 | bitstream vera | bitstream vera (?:font )?license
w3c | 72 | w3c software | w3c software (?:notice and )?(?:and document )?license
unicode | 72 | unicode license | unicode license(?: agreement)?(?: v3)?
icu | 68 | icu license | icu license
json | 88 | used for good not evil | the software shall be used for good not evil
json | 64 | json license | json license
beerware | 90 | beer ware license | (?:the )?beer ware license
vim | 64 | vim license | vim license
tcl | 64 | tcl tk license | tcl tk license
zope | 70 | zope public license | zope public license(?: version 2 [01])?
academic-free | 72 | academic free license | academic free license(?: v? ?3 0)?
open-software | 72 | open software license | open software license(?: v? ?3 0)?
rpl | 68 | reciprocal public license | reciprocal public license(?: 1 [15])?
cpal | 70 | common public attribution license | common public attribution license(?: version 1 0)?
nokia | 64 | nokia open source license | nokia open source license
apsl | 70 | apple public source license | apple public source license(?: 2 0)?
ms-pl | 74 | microsoft public license | microsoft public license
ms-rl | 74 | microsoft reciprocal license | microsoft reciprocal license
upl-1.0 | 74 | universal permissive license | universal permissive license(?: v 1 0)?
blueoak-1.0 | 74 | blue oak model license | blue oak model license(?: 1 0 0)?
mulan-2 | 74 | mulan psl | mulan psl v ?2
cecill | 72 | cecill | cecill(?: [abc])?(?: license)?(?: 2 [01])?
sspl-1.0 | 80 | server side public license | server side public license(?: version 1)?
busl-1.1 | 80 | business source license | business source license(?: 1 1)?
elastic-2.0 | 78 | elastic license | elastic license(?: 2 0)?
commons-clause | 82 | commons clause | commons clause(?: license condition)?(?: v1 0)?
polyform | 76 | polyform | polyform (?:noncommercial|small business|shield|strict|internal use) license(?: 1 0 0)?
odbl | 76 | database license | open (?:data commons )?database license
odc-by | 76 | open data commons attribution | open data commons attribution license
pddl | 76 | public domain dedication and license | public domain dedication and license
open-government | 74 | open government licen | open government licen[cs]e(?: v? ?[1-3] 0)?
etalab | 72 | licence ouverte | licence ouverte(?: v? ?[12] 0)?
openrail | 76 | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: license)?
llama-community | 76 | community license agreement | llama [234](?: [0-9])? community license agreement
proprietary | 74 | all rights reserved | (?:copyright (?:\\S+ ){1,12}?)?all rights reserved
proprietary | 72 | proprietary and confidential | proprietary and confidential
proprietary | 66 | end user license agreement | end user license agreement
proprietary | 70 | unauthorized copying | unauthorized copying of this (?:file|software|work)
copyright | 30 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
license-hint | 20 | see the license | see the license for the specific language governing permissions
license-hint | 20 | licensed under | licensed under
license-hint | 20 | license file | (?:see )?(?:the )?license file
mit | 88 | without warranty of any kind | the software is provided as is without warranty of any kind express or implied
mit | 84 | mit license | this project is licensed under the mit license
isc | 93 | permission to use copy modify | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
bsd | 84 | copyright holders and contributors | this software is provided by the copyright holders and contributors as is
bsd | 82 | bsd style license | (?:use of this source code|this source code) is (?:governed by|licensed under) (?:a|the) bsd style license
bsd-1-clause | 80 | bsd 1 clause | bsd 1 clause(?: license)?
bsd-3-clause-clear | 80 | clear bsd license | (?:the )?clear bsd license
bsd-3-clause-lbnl | 80 | berkeley national lab | lawrence berkeley national lab(?:s|oratory) bsd(?: variant)? license
bsd-patent | 80 | bsd plus patent | bsd plus patent(?: license)?
bsd-protection | 78 | bsd protection license | bsd protection license
apache-2.0 | 93 | agreed to in writing | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | 92 | obtain a copy of the license | you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0 | 88 | apache software foundation | licensed to the apache software foundation asf under one or more contributor license agreements
lgpl | 92 | this library is free software | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | 76 | lesser general public license | you should have received a copy of the gnu lesser general public license
agpl | 76 | affero general public license | you should have received a copy of the gnu affero general public license
gpl | 72 | general public license | (?:released|distributed|licensed|available) under (?:the )?(?:terms of )?(?:the )?gnu general public license
gcc-exception | 84 | gcc runtime library exception | under the terms of the gcc runtime library exception
font-exception | 84 | font exception | gpl (?:font|with font) exception
bison-exception | 84 | bison | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
llvm-exception | 84 | llvm exception | (?:with )?(?:the )?llvm exceptions?
mpl-1.1 | 94 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | 82 | mozilla public license version 1 0 | mozilla public license version 1 0
epl | 93 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl | 93 | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
boost-1.0 | 95 | person or organization obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost-1.0 | 86 | boost software license | distributed under the boost software license version 1 0
cc0 | 90 | dedicated the work to the public domain | the person who associated a work with this deed has dedicated the work to the public domain
cc-pdm-1.0 | 82 | public domain mark | public domain mark(?: 1 0)?
cc-sampling-plus | 80 | sampling plus | creative commons sampling plus(?: 1 0)?(?: license)?
cc-devnations | 80 | developing nations | creative commons developing nations(?: 2 0)?(?: license)?
unlicense | 90 | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
zlib | 90 | origin of this software | the origin of this software must not be misrepresented
wtfpl | 84 | do what the fuck you want | you just do what the fuck you want to
ofl-1.1 | 82 | sil open font license | sil open font license version 1 1
ofl-1.0 | 82 | sil open font license | sil open font license version 1 0
openssl | 86 | openssl | openssl and ssleay licenses?
ssleay | 84 | eric young | this product includes cryptographic software written by eric young
artistic-1.0-perl | 82 | perl artistic license | perl artistic license(?: 1 0)?
clarified-artistic | 80 | clarified artistic license | (?:the )?clarified artistic license
aladdin | 78 | aladdin free public license | aladdin free public license
adobe-2006 | 78 | adobe systems incorporated | adobe systems incorporated source code license agreement
adobe-glyph | 78 | adobe glyph list license | adobe glyph list license
amazon-dsl | 76 | amazon digital services license | amazon digital services license
amazon-software | 76 | amazon software license | amazon software license
antlr-pd | 78 | antlr software rights notice | antlr software rights notice
arphic | 78 | arphic public license | arphic public license
bittorrent | 78 | bittorrent open source license | bittorrent open source license(?: 1 [01])?
caldera | 76 | caldera license | caldera license
catosl | 78 | trusted open source license | computer associates trusted open source license(?: 1 1)?
cern-ohl-s | 80 | cern open hardware licen | cern open hardware licen[cs]e version 2 strongly reciprocal
cern-ohl-w | 80 | cern open hardware licen | cern open hardware licen[cs]e version 2 weakly reciprocal
cern-ohl-p | 80 | cern open hardware licen | cern open hardware licen[cs]e version 2 permissive
cern-ohl | 72 | cern open hardware licen | cern open hardware licen[cs]e(?: v? ?1 [12])?
cnri-python | 78 | cnri open source license | cnri open source license agreement
condor | 78 | condor public license | condor public license(?: 1 1)?
copyleft-next | 78 | copyleft next | copyleft next(?: 0 3 [01])?(?: license)?
cua-opl | 78 | cua office public license | cua office public license(?: 1 0)?
d-fsl | 78 | german free software license | german free software license
datalicence-de | 76 | data licence germany | data licence germany (?:attribution|zero)(?: version 2 0)?
ecl-1.0 | 80 | educational community license | educational community license (?:version )?1 0
ecl-2.0 | 80 | educational community license | educational community license (?:version )?2 0
ecos-2.0 | 78 | ecos | (?:red hat )?ecos (?:public )?license(?: version 2 0)?
efl-2.0 | 78 | eiffel forum license | eiffel forum license(?: version)?(?: 2)?
entessa | 78 | entessa public license | entessa public license(?: 1 0)?
epics | 78 | epics open license | epics open license
erlang | 78 | erlang public license | erlang public license(?: version 1 1)?
eu-datagrid | 78 | eu datagrid software license | eu datagrid software license
fair | 76 | fair license | (?:the )?fair license
fair-source | 76 | fair source license | fair source license
frameworx | 78 | frameworx open license | frameworx open license(?: 1 0)?
free-art | 78 | free art license | free art license(?: 1 3)?
freeimage | 78 | freeimage public license | freeimage public license
freetype | 78 | freetype | (?:the )?freetype (?:project )?license
functional-source | 78 | functional source license | functional source license(?: version 1 [01])?
glide | 78 | glide source code | 3dfx glide source code general public license
gsoap | 78 | gsoap public license | gsoap public license(?: 1 3)?
hippocratic | 78 | hippocratic license | hippocratic license(?: 2 1| 3 0)?
hpnd | 82 | historical permission notice | historical permission notice and disclaimer
ijg | 90 | independent jpeg group | this software is based in part on the work of the independent jpeg group
ijg | 76 | independent jpeg group | independent jpeg group(?: s)? license
imagemagick | 78 | imagemagick license | imagemagick license
info-zip | 78 | info zip license | info zip license
intel | 78 | intel open source license | intel open source license
intel-simplified | 76 | intel simplified software license | intel simplified software license
interbase | 78 | interbase public license | interbase public license
ipa-font | 78 | ipa font license | ipa font license(?: agreement)?
jasper | 78 | jasper license | jasper license(?: version 2 0)?
latex-project | 80 | latex project public license | latex project public license(?: version| v)?(?: 1 [0-3]c?)?
lucent | 78 | lucent public license | lucent public license(?: version 1 02?)?
matrix-template | 78 | matrix template library | matrix template library license
miros | 78 | miros licen | miros licen[cs]e
motosoto | 78 | motosoto open source license | motosoto open source license
ms-lpl | 78 | microsoft limited public license | microsoft limited public license
multics | 78 | multics license | multics license
nasa-1.3 | 80 | nasa open source agreement | nasa open source agreement(?: version)?(?: 1 3)?
naumen | 78 | naumen public license | naumen public license
netcdf | 78 | netcdf license | netcdf license
net-boolean | 78 | net boolean public license | net boolean public license
nethack | 78 | nethack general public license | nethack general public license
netizen | 78 | netizen open source license | netizen open source license
netscape | 78 | netscape public license | netscape public license(?: version)?(?: 1 [01])?
no-limit | 78 | no limit public license | no limit public license
non-profit-open | 78 | non profit open software license | non profit open software license(?: 3 0)?
ntp | 76 | ntp license | ntp license
oclc | 78 | oclc research public license | oclc research public license(?: 2 0)?
ogc | 78 | ogc software license | ogc software license
open-group-test | 78 | open group test suite license | open group test suite license
openldap | 80 | openldap public license | openldap public license(?: version)?(?: 2 [0-8])?
open-public | 76 | open public license | open public license(?: v? ?1 0)?
open-publication | 76 | open publication license | open publication license(?: v? ?1 0)?
opencontent | 76 | opencontent license | opencontent license(?: opl)?
oset | 78 | oset public license | oset public license
parity | 78 | parity public license | (?:the )?parity public license(?: 7 0 0)?
prosperity | 78 | prosperity public license | (?:the )?prosperity public license(?: 3 0 0)?
qhull | 76 | qhull license | qhull license
qpl | 80 | q public license | (?:the )?q public license(?: version)?(?: 1 0)?
realnetworks | 78 | realnetworks public source license | realnetworks public source license(?: v1 0)?
ricoh | 78 | ricoh source code public license | ricoh source code public license
scea | 78 | scea shared source license | scea shared source license
sgi-b | 78 | sgi free software license | sgi free software license b(?: version)?(?: 2 0| 1 [01])?
simple-public | 78 | simple public license | simple public license(?: 2 0)?
sun-industry | 78 | sun industry standards source license | sun industry standards source license(?: version)?(?: 1 [12])?
sun-public | 78 | sun public license | sun public license(?: version)?(?: 1 0)?
sugarcrm | 78 | sugarcrm public license | sugarcrm public license(?: version)?(?: 1 1 3)?
standard-ml | 78 | standard ml of new jersey | standard ml of new jersey (?:copyright notice license|license)
tapr-ohl | 78 | tapr open hardware license | tapr open hardware license(?: v? ?1 0)?
trusster | 78 | trusster open source license | trusster open source license
vovida | 78 | vovida software license | vovida software license(?: v? ?1 0)?
watcom | 78 | watcom public license | (?:sybase )?open watcom public license(?: 1 0)?
xerox | 76 | xerox license | xerox license
xfree86 | 80 | xfree86 license | xfree86 license(?: 1 1)?
xinetd | 78 | xinetd license | xinetd license
yahoo | 78 | yahoo public license | yahoo public license(?: v? ?1 [01])?
zed | 76 | zed license | zed license
zend | 78 | zend | zend (?:engine )?license(?: v? ?2 0)?
zimbra | 78 | zimbra public license | zimbra public license(?: version)?(?: 1 [34])?
gemma | 78 | gemma terms of use | gemma terms of use
rail-m | 78 | responsible ai license | (?:open )?responsible ai licenses?
bigcode | 78 | bigcode | bigcode openrail m(?: v1)?(?: license)?
cdla-permissive | 80 | community data license agreement | community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | 80 | community data license agreement | community data license agreement sharing(?: version)?(?: 1 0)?
odc-odbl | 82 | open data commons open database license | open data commons open database license(?: v1 0)?
proprietary | 76 | without the express written | may not be (?:copied|reproduced|distributed) without the express written (?:permission|consent)
proprietary | 70 | evaluation license | evaluation license agreement
proprietary | 70 | commercial license | (?:a )?commercial license is required
dual-license | 60 | dual license | (?:is )?dual licensed? under
license-hint | 24 | license | (?:released|distributed|made available) under the terms of (?:the|this) license
license-hint | 22 | license terms | (?:see )?(?:the )?license terms
license-hint | 22 | license agreement | (?:subject to )?(?:the )?(?:terms of the )?license agreement
"""


def lines(text: str) -> list[tuple[str, int, str, str]]:
    rows = [[x.strip() for x in line.split(" | ", 3)] for line in text.strip().splitlines()]
    return [(label, int(priority), keyword, pattern) for label, priority, keyword, pattern in rows]


def versions() -> list[tuple[str, int, str, str]]:
    """Families whose members differ by version and terms."""
    out = []
    terms = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivs", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivs"}
    for term, words in terms.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            version = v.replace(".", " ")
            out.append((f"cc-{term}-{v}", 84, "creative commons", f"creative commons {words.replace(' ', '(?: and)? ').replace('share', 'share ?').replace('noderivs', 'no ?deriv(?:ative)?s').replace('noncommercial', 'non ?commercial')} {version}(?: international| unported| generic)?(?: license)?"))
            out.append((f"cc-{term}-{v}", 82, "creativecommons org licenses", f"creativecommons org licenses {term.replace('-', ' ')} {version}"))
            out.append((f"cc-{term}-{v}", 80, f"cc {term.replace('-', ' ')} {version}", f"cc {term.replace('-', ' ')} {version}"))
    names = {"gpl": ("general public license", ("1", "2", "3")), "lgpl": ("(?:lesser|library) general public license", ("2", "2.1", "3")), "agpl": ("affero general public license", ("1", "3"))}
    for short, (name, numbers) in names.items():
        for v in numbers:
            version = v.replace(".", " ") + ("" if "." in v else "(?: 0)?")
            out.append((f"{short}-{v}", 84, "general public license", f"(?:gnu )?{name} (?:as published by the free software foundation )?(?:either )?(?:v|version )?{version}"))
            out.append((f"{short}-{v}-or-later", 86, "any later version", f"(?:gnu )?{name} (?:as published by the free software foundation )?(?:either )?(?:version )?{version} (?:of the license )?or (?:at your option )?any later version"))
            out.append((f"{short}-{v}", 76, short, f"(?:gnu )?{short} ?v?{version}"))
            for end in ("only", "or later"):
                out.append((f"{short}-{v}-{end.replace(' ', '-')}", 82, "spdx license identifier", f"spdx license identifier {short} {version} {end}"))
    spdx = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "CDDL-1.0", "Unlicense", "Zlib", "BSL-1.0", "Artistic-2.0", "CC0-1.0", "OFL-1.1", "PostgreSQL", "NCSA", "UPL-1.0", "0BSD")
    for name in spdx:
        words = name.lower().replace("-", " ").replace(".", " ")
        out.append((name.lower().replace("bsl-", "boost-"), 82, "spdx license identifier", f"spdx license identifier {words}"))
    return out


def rules() -> list[tuple[str, int, str, str]]:
    """All rules, in order."""
    return lines(TEXT) + versions()
