"""Signature rules of licenses, written by hand: sentences of license texts, notices and names.

A line is ``label priority strength keyword pattern`` with ``|`` between the parts of
the head and the pattern behind a colon.  Patterns are over lower-case words joined by one
space (``2.0`` is ``2 0``); the keyword is in every match.  Priorities: 95 a sentence of
the text that only this license has, 90 a grant naming license and version, 80 name and
version, 60 a grant or name without version, 40 a bare name, 30 and below hints.
"""

from __future__ import annotations

PERMISSIVE = r"""
mit | 95 | 1.0 | hereby granted : permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 94 | 1.0 | without limitation : without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit | 90 | 1.0 | mit : (?:released|licensed|distributed|available) under the (?:terms of the )?mit licen[sc]e
mit | 90 | 1.0 | licenses mit : opensource org licenses mit
mit | 85 | 1.0 | identifier mit : spdx license identifier mit
mit | 60 | 0.9 | mit : mit licen[sc]e
mit | 50 | 0.8 | mit : licen[sc]e mit
mit-0 | 95 | 1.0 | mit : mit no attribution
mit-0 | 85 | 1.0 | identifier mit : spdx license identifier mit 0
x11 | 95 | 1.0 | x consortium : except as contained in this notice the name of the x consortium shall not be used
x11 | 60 | 0.9 | x11 : x11 licen[sc]e
json | 95 | 1.0 | for good : the software shall be used for good not evil
ncsa | 95 | 1.0 | illinois : university of illinois (?:ncsa )?open source licen[sc]e
ncsa | 60 | 0.8 | ncsa : ncsa (?:open source )?licen[sc]e
isc | 95 | 1.0 | permission to use : permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 60 | 0.9 | isc : isc licen[sc]e
isc | 85 | 1.0 | identifier isc : spdx license identifier isc
hpnd | 92 | 0.9 | advertising or publicity : not be used in advertising or publicity pertaining to distribution of the software
bsd | 92 | 0.9 | redistribution and use : redistribution and use in source and binary forms with or without modification are permitted
bsd | 60 | 0.9 | redistributions of source : redistributions of source code must retain the above copyright notice
bsd | 60 | 0.9 | redistributions in binary : redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 95 | 1.0 | endorse or promote : neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software
bsd-3-clause | 85 | 1.0 | 3 clause : bsd 3 clause
bsd-3-clause | 85 | 1.0 | clause bsd : (?:3|three) clause bsd
bsd-3-clause | 80 | 1.0 | bsd : (?:new|modified|revised) bsd
bsd-2-clause | 85 | 1.0 | 2 clause : bsd 2 clause
bsd-2-clause | 85 | 1.0 | clause bsd : (?:2|two) clause bsd
bsd-2-clause | 80 | 1.0 | bsd : (?:simplified|freebsd) bsd
bsd-4-clause | 95 | 1.0 | advertising materials : all advertising materials mentioning features or use of this software must display
bsd-4-clause | 85 | 1.0 | clause bsd : (?:4|four) clause bsd
bsd-0-clause | 85 | 1.0 | bsd : (?:0bsd|zero clause bsd|bsd zero clause)
bsd | 60 | 0.8 | bsd : (?:released|licensed|distributed) under (?:the|a) bsd licen[sc]e
bsd | 40 | 0.7 | bsd : bsd (?:style )?licen[sc]e
apache-2.0 | 95 | 1.0 | apache : licensed under the apache licen[sc]e version 2 0
apache-2.0 | 94 | 1.0 | license 2 : apache org licenses license 2 0
apache-2.0 | 90 | 1.0 | compliance with the : you may not use this file except in compliance with the licen[sc]e
apache-2.0 | 80 | 1.0 | apache : apache (?:software )?licen[sc]e (?:version |v)?2 0
apache-2.0 | 85 | 1.0 | identifier apache : spdx license identifier apache 2 0
apache-2.0 | 75 | 0.9 | apache : apache 2 0
apache-2.0 | 70 | 0.9 | contributor license agreements : licensed to the apache software foundation asf under one or more contributor license agreements
apache-1.1 | 95 | 1.0 | apache software foundation : this product includes software developed by the apache software foundation
apache-1.1 | 80 | 1.0 | apache : apache (?:software )?licen[sc]e (?:version )?1 1
apache-1.0 | 80 | 1.0 | apache : apache (?:software )?licen[sc]e (?:version )?1 0
apache | 60 | 0.8 | apache : (?:released|licensed|distributed) under the (?:terms of the )?apache licen[sc]e
apache | 40 | 0.7 | apache : apache (?:software )?licen[sc]e
zlib | 95 | 1.0 | misrepresented : the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 94 | 1.0 | altered source versions : altered source versions must be plainly marked as such
zlib | 60 | 0.9 | zlib : zlib (?:libpng )?licen[sc]e
libpng | 80 | 1.0 | libpng : libpng licen[sc]e (?:version )?[0-9]?
bsl-1.0 | 95 | 1.0 | boost software : boost software licen[sc]e version 1 0
bsl-1.0 | 94 | 1.0 | license 1 : boost org license 1 0 txt
bsl-1.0 | 60 | 0.9 | boost : boost (?:software )?licen[sc]e
postgresql | 60 | 0.9 | postgresql : postgresql licen[sc]e
python-2.0 | 90 | 1.0 | python software foundation : python software foundation licen[sc]e
python-2.0 | 60 | 0.8 | psf : psf licen[sc]e
php-3.01 | 90 | 1.0 | php : php licen[sc]e (?:version )?3 0 ?1
php | 60 | 0.9 | php : php licen[sc]e
ruby | 60 | 0.9 | ruby : ruby s? ?licen[sc]e
openssl | 95 | 1.0 | openssl toolkit : this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 60 | 0.9 | openssl : openssl licen[sc]e
curl | 60 | 0.9 | curl : curl licen[sc]e
vim | 60 | 0.9 | vim : vim licen[sc]e
w3c | 80 | 1.0 | w3c : w3c software (?:and document )?(?:notice and )?licen[sc]e
unicode | 80 | 1.0 | unicode : unicode (?:inc )?licen[sc]e agreement
zpl | 80 | 1.0 | zope public : zope public licen[sc]e
wtfpl | 95 | 1.0 | what the : do what the (?:fuck|f) you want to public licen[sc]e
wtfpl | 60 | 1.0 | wtfpl : wtfpl
beerware | 95 | 1.0 | buy me a beer : if we meet some day and you think this stuff is worth it you can buy me a beer
beerware | 60 | 0.9 | beer : beer ?ware licen[sc]e
fair | 95 | 1.0 | works is permitted : usage of the works is permitted provided that this instrument is retained
ms-pl | 80 | 1.0 | microsoft public : microsoft public licen[sc]e
ms-pl | 60 | 0.9 | ms pl : ms pl
bluoak-1.0.0 | 80 | 1.0 | blue oak : blue oak model licen[sc]e
upl-1.0 | 80 | 1.0 | universal permissive : universal permissive licen[sc]e
afl-3.0 | 90 | 1.0 | academic free : academic free licen[sc]e (?:version )?v? ?3 0
afl | 60 | 0.9 | academic free : academic free licen[sc]e
artistic-2.0 | 90 | 1.0 | artistic : artistic licen[sc]e (?:version )?2 0
artistic | 60 | 0.9 | artistic : artistic licen[sc]e
perl | 90 | 0.9 | perl itself : under the same terms as perl itself
"""

GNU = r"""
gpl-3.0-or-later | 95 | 1.0 | version 3 : gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl-2.0-or-later | 95 | 1.0 | version 2 : gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
lgpl-2.1-or-later | 95 | 1.0 | version 2 : gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version
lgpl-3.0-or-later | 95 | 1.0 | version 3 : gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
lgpl-2.0-or-later | 95 | 1.0 | version 2 : gnu library general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
agpl-3.0-or-later | 95 | 1.0 | affero : gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl-2.0 | 93 | 1.0 | version 2 : under the terms of the gnu general public licen[sc]e version 2 (?:only )?as published by
gpl-3.0 | 93 | 1.0 | version 3 : under the terms of the gnu general public licen[sc]e version 3 (?:only )?as published by
gpl | 70 | 0.9 | general public : see the gnu general public licen[sc]e for more details
gpl | 70 | 0.9 | copy of the : you should have received a copy of the gnu general public licen[sc]e
lgpl | 71 | 0.9 | lesser general public : you should have received a copy of the gnu lesser general public licen[sc]e
agpl | 71 | 0.9 | affero general public : you should have received a copy of the gnu affero general public licen[sc]e
gpl-3.0 | 85 | 1.0 | general public : general public licen[sc]e (?:version |v)?3(?: 0)?
gpl-2.0 | 85 | 1.0 | general public : general public licen[sc]e (?:version |v)?2(?: 0)?
gpl-1.0 | 84 | 1.0 | general public : general public licen[sc]e (?:version |v)?1(?: 0)?
gpl-3.0 | 80 | 1.0 | gpl : (?:gnu )?gpl (?:version |v)?3(?: 0)?
gpl-2.0 | 80 | 1.0 | gpl : (?:gnu )?gpl (?:version |v)?2(?: 0)?
gpl-3.0 | 80 | 1.0 | gplv3 : (?:gnu )?gplv3
gpl-2.0 | 80 | 1.0 | gplv2 : (?:gnu )?gplv2
gpl-3.0-or-later | 88 | 1.0 | later : (?:gnu )?gpl ?(?:version |v)?3(?: 0)? or (?:any )?later
gpl-2.0-or-later | 88 | 1.0 | later : (?:gnu )?gpl ?(?:version |v)?2(?: 0)? or (?:any )?later
gpl | 60 | 0.9 | general public : (?:released|licensed|distributed) under the (?:terms of the )?(?:gnu )?general public licen[sc]e
gpl | 60 | 0.8 | gpl : (?:released|licensed|distributed) under the (?:terms of the )?(?:gnu )?gpl
gpl | 45 | 0.8 | gnu general public : gnu general public licen[sc]e
lgpl-3.0 | 86 | 1.0 | lesser general public : lesser general public licen[sc]e (?:version |v)?3(?: 0)?
lgpl-2.1 | 86 | 1.0 | lesser general public : lesser general public licen[sc]e (?:version |v)?2 1
lgpl-2.0 | 86 | 1.0 | library general public : library general public licen[sc]e (?:version |v)?2(?: 0)?
lgpl-3.0 | 81 | 1.0 | lgpl : (?:gnu )?lgpl (?:version |v)?3(?: 0)?
lgpl-2.1 | 81 | 1.0 | lgpl : (?:gnu )?lgpl (?:version |v)?2 1
lgpl | 61 | 0.9 | lesser general public : (?:gnu )?lesser general public licen[sc]e
lgpl | 61 | 0.9 | library general public : (?:gnu )?library general public licen[sc]e
lgpl | 45 | 0.8 | lgpl : (?:gnu )?lgpl
agpl-3.0 | 86 | 1.0 | affero general public : affero general public licen[sc]e (?:version |v)?3(?: 0)?
agpl-1.0 | 86 | 1.0 | affero general public : affero general public licen[sc]e (?:version |v)?1(?: 0)?
agpl-3.0 | 81 | 1.0 | agpl : (?:gnu )?agpl ?(?:version |v)?3(?: 0)?
agpl | 61 | 0.9 | affero general public : (?:gnu )?affero general public licen[sc]e
agpl | 45 | 0.8 | agpl : (?:gnu )?agpl
gfdl-1.3 | 90 | 1.0 | free documentation : free documentation licen[sc]e (?:version |v)?1 3
gfdl-1.2 | 90 | 1.0 | free documentation : free documentation licen[sc]e (?:version |v)?1 2
gfdl-1.1 | 90 | 1.0 | free documentation : free documentation licen[sc]e (?:version |v)?1 1
gfdl | 95 | 1.0 | invariant sections : with no invariant sections no front cover texts and no back cover texts
gfdl | 60 | 0.9 | free documentation : (?:gnu )?free documentation licen[sc]e
gpl-exception | 90 | 0.9 | special exception : as a special exception (?:[^ ]+ ){1,20}gives? you permission to link
classpath | 90 | 1.0 | classpath : classpath exception
"""

RECIPROCAL = r"""
mpl-2.0 | 95 | 1.0 | mozilla public : this source code form is subject to the terms of the mozilla public licen[sc]e v ?2 0
mpl-1.1 | 95 | 1.0 | mozilla public : subject to the mozilla public licen[sc]e version 1 1
mpl-2.0 | 80 | 1.0 | mozilla public : mozilla public licen[sc]e (?:version |v ?)?2 0
mpl-1.1 | 80 | 1.0 | mozilla public : mozilla public licen[sc]e (?:version |v ?)?1 1
mpl-1.0 | 80 | 1.0 | mozilla public : mozilla public licen[sc]e (?:version |v ?)?1 0
mpl-2.0 | 80 | 1.0 | mpl : mpl (?:version |v)?2 0
mpl | 60 | 0.9 | mozilla public : mozilla public licen[sc]e
npl-1.1 | 80 | 1.0 | netscape public : netscape public licen[sc]e (?:version |v)?1 1
npl | 60 | 0.9 | netscape public : netscape public licen[sc]e
epl-2.0 | 95 | 1.0 | eclipse public : made available under the terms of the eclipse public licen[sc]e v ?2 0
epl-1.0 | 95 | 1.0 | eclipse public : made available under the terms of the eclipse public licen[sc]e v ?1 0
epl-2.0 | 80 | 1.0 | eclipse public : eclipse public licen[sc]e (?:version |v ?)?2 0
epl-1.0 | 80 | 1.0 | eclipse public : eclipse public licen[sc]e (?:version |v ?)?1 0
epl | 60 | 0.9 | eclipse public : eclipse public licen[sc]e
edl-1.0 | 80 | 1.0 | eclipse distribution : eclipse distribution licen[sc]e
cddl-1.0 | 80 | 1.0 | common development : common development and distribution licen[sc]e (?:cddl )?(?:version |v)?1 0
cddl-1.1 | 80 | 1.0 | common development : common development and distribution licen[sc]e (?:cddl )?(?:version |v)?1 1
cddl | 60 | 0.9 | common development : common development and distribution licen[sc]e
cpl-1.0 | 80 | 1.0 | common public : common public licen[sc]e (?:version |v)?1 0
cpl | 60 | 0.9 | common public : common public licen[sc]e
cpal-1.0 | 80 | 1.0 | common public attribution : common public attribution licen[sc]e
ipl-1.0 | 80 | 1.0 | ibm public : ibm public licen[sc]e
eupl-1.2 | 85 | 1.0 | european union public : european union public licen[sc]e (?:eupl )?(?:version |v ?)?1 2
eupl-1.1 | 85 | 1.0 | european union public : european union public licen[sc]e (?:eupl )?(?:version |v ?)?1 1
eupl | 60 | 0.9 | european union public : european union public licen[sc]e
osl-3.0 | 85 | 1.0 | open software : open software licen[sc]e (?:version |v ?)?3 0
osl-2.1 | 85 | 1.0 | open software : open software licen[sc]e (?:version |v ?)?2 1
osl | 60 | 0.9 | open software : open software licen[sc]e
qpl-1.0 | 80 | 1.0 | q public : q public licen[sc]e
sissl | 80 | 1.0 | sun industry standards : sun industry standards source licen[sc]e
sleepycat | 80 | 1.0 | sleepycat : sleepycat licen[sc]e
lppl | 80 | 1.0 | latex project public : latex project public licen[sc]e
cecill-2.1 | 85 | 1.0 | cecill : cecill (?:licen[sc]e )?(?:version |v)?2 1
cecill | 60 | 0.9 | cecill : cecill
ms-rl | 80 | 1.0 | microsoft reciprocal : microsoft reciprocal licen[sc]e
apsl-2.0 | 80 | 1.0 | apple public source : apple public source licen[sc]e (?:version )?2 0
apsl | 60 | 0.9 | apple public source : apple public source licen[sc]e
rpl-1.5 | 80 | 1.0 | reciprocal public : reciprocal public licen[sc]e
sspl-1.0 | 85 | 1.0 | server side public : server side public licen[sc]e
elastic-2.0 | 85 | 1.0 | elastic : elastic licen[sc]e (?:version )?2 0
elastic | 60 | 0.9 | elastic : elastic licen[sc]e
busl-1.1 | 85 | 1.0 | business source : business source licen[sc]e (?:version )?1 1
busl | 60 | 0.9 | business source : business source licen[sc]e
commons-clause | 80 | 1.0 | commons clause : commons clause
polyform | 80 | 1.0 | polyform : polyform (?:noncommercial|small business|shield|perimeter|strict) licen[sc]e
parity | 80 | 1.0 | parity public : parity public licen[sc]e
"""

CREATIVE = r"""
cc0-1.0 | 90 | 1.0 | cc0 : cc0 1 0(?: universal)?
cc0-1.0 | 80 | 1.0 | cc0 : cc0
cc0-1.0 | 90 | 1.0 | publicdomain zero : creativecommons org publicdomain zero 1 0
cc0-1.0 | 90 | 1.0 | waived all copyright : waived all copyright and related or neighboring rights
cc-pdm-1.0 | 90 | 1.0 | publicdomain mark : creativecommons org publicdomain mark 1 0
cc-by-nc-nd-4.0 | 93 | 1.0 | by nc nd : (?:cc|licenses) by nc nd 4 0
cc-by-nc-sa-4.0 | 93 | 1.0 | by nc sa : (?:cc|licenses) by nc sa 4 0
cc-by-nc-4.0 | 92 | 1.0 | by nc : (?:cc|licenses) by nc 4 0
cc-by-nd-4.0 | 92 | 1.0 | by nd : (?:cc|licenses) by nd 4 0
cc-by-sa-4.0 | 92 | 1.0 | by sa : (?:cc|licenses) by sa 4 0
cc-by-4.0 | 91 | 1.0 | by 4 0 : (?:cc|licenses) by 4 0
cc-by-nc-nd-3.0 | 93 | 1.0 | by nc nd : (?:cc|licenses) by nc nd 3 0
cc-by-nc-sa-3.0 | 93 | 1.0 | by nc sa : (?:cc|licenses) by nc sa 3 0
cc-by-nc-3.0 | 92 | 1.0 | by nc : (?:cc|licenses) by nc 3 0
cc-by-sa-3.0 | 92 | 1.0 | by sa : (?:cc|licenses) by sa 3 0
cc-by-3.0 | 91 | 1.0 | by 3 0 : (?:cc|licenses) by 3 0
cc-by-sa-2.5 | 92 | 1.0 | by sa : (?:cc|licenses) by sa 2 5
cc-by-2.5 | 91 | 1.0 | by 2 5 : (?:cc|licenses) by 2 5
cc-by-sa-2.0 | 92 | 1.0 | by sa : (?:cc|licenses) by sa 2 0
cc-by-2.0 | 91 | 1.0 | by 2 0 : (?:cc|licenses) by 2 0
cc-by-nc-nd | 75 | 0.9 | by nc nd : cc by nc nd
cc-by-nc-sa | 75 | 0.9 | by nc sa : cc by nc sa
cc-by-nc | 74 | 0.9 | by nc : cc by nc
cc-by-nd | 74 | 0.9 | by nd : cc by nd
cc-by-sa | 74 | 0.9 | by sa : cc by sa
cc-by-nc-sa-4.0 | 93 | 1.0 | attribution non : attribution non ?commercial share ?alike 4 0 international
cc-by-nc-nd-4.0 | 93 | 1.0 | attribution noncommercial : attribution noncommercial no ?deriv(?:ative)?s 4 0 international
cc-by-nc-4.0 | 92 | 1.0 | attribution noncommercial : attribution noncommercial 4 0 international
cc-by-sa-4.0 | 92 | 1.0 | attribution sharealike : attribution sharealike 4 0 international
cc-by-4.0 | 91 | 1.0 | attribution 4 0 : attribution 4 0 international
cc-by-sa-3.0 | 92 | 1.0 | attribution sharealike : attribution sharealike 3 0 unported
cc-by-3.0 | 91 | 1.0 | attribution 3 0 : attribution 3 0 unported
cc | 45 | 0.7 | creative commons : (?:under a|under the|a) creative commons (?:[^ ]+ ){0,4}licen[sc]e
cc | 30 | 0.6 | creative commons : creative commons
"""

WORKS = r"""
ofl-1.1 | 95 | 1.0 | open font : this font software is licensed under the sil open font licen[sc]e version 1 1
ofl-1.1 | 85 | 1.0 | open font : sil open font licen[sc]e (?:version |v)?1 1
ofl | 60 | 0.9 | open font : (?:sil )?open font licen[sc]e
odbl-1.0 | 85 | 1.0 | open database : open database licen[sc]e (?:odbl )?(?:version |v)?1 0
odbl | 60 | 0.9 | database : open (?:data commons open )?database licen[sc]e
odc-by-1.0 | 85 | 1.0 | open data commons : open data commons attribution licen[sc]e
pddl-1.0 | 85 | 1.0 | public domain dedication : (?:open data commons )?public domain dedication and licen[sc]e
ogl-uk-3.0 | 85 | 1.0 | open government : open government licen[sc]e (?:version |v)?3 0
ogl | 60 | 0.9 | open government : open government licen[sc]e
ogl-1.0a | 85 | 1.0 | open game : open game licen[sc]e
cdla-permissive | 85 | 1.0 | community data : community data licen[sc]e agreement permissive
cdla-sharing | 85 | 1.0 | community data : community data licen[sc]e agreement sharing
gutenberg | 95 | 1.0 | project gutenberg : project gutenberg (?:tm )?licen[sc]e
gutenberg | 94 | 1.0 | at no cost : this ebook is for the use of anyone anywhere (?:[^ ]+ ){0,14}at no cost
fal-1.3 | 80 | 1.0 | free art : free art licen[sc]e
opl-1.0 | 80 | 1.0 | open publication : open publication licen[sc]e
llama | 85 | 1.0 | llama : llama (?:[23] )?(?:[0-9] )?community licen[sc]e
openrail | 85 | 1.0 | openrail : (?:creativeml |bigscience )?openrail m?
hippocratic | 85 | 1.0 | hippocratic : hippocratic licen[sc]e
spdx | 50 | 0.8 | spdx license : spdx license identifier [^ ]+
public-domain | 90 | 1.0 | public domain : (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 90 | 1.0 | unencumbered software : this is free and unencumbered software released into the public domain
public-domain | 30 | 0.5 | public domain : public domain
unlicense | 85 | 1.0 | unlicense : unlicense org
unlicense | 60 | 0.9 | unlicense : (?:the )?unlicense
"""

RESERVED = r"""
reserved | 90 | 1.0 | no part of : no part of this (?:publication|work|book|document|site) may be reproduced
reserved | 90 | 1.0 | be reproduced : may not be reproduced (?:[^ ]+ ){0,8}without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)
reserved | 85 | 0.9 | prior written permission : without (?:the )?prior written permission of the (?:publisher|author|copyright holder|owner)
reserved | 80 | 0.9 | unauthorized : unauthorized (?:copying|reproduction|use|distribution)(?: or [^ ]+)? (?:of this (?:file|material|work) )?(?:[^ ]+ ){0,6}is (?:strictly )?prohibited
reserved | 60 | 0.8 | reserves all : reserves all rights
reserved | 55 | 0.8 | use only : for personal (?:and )?non ?commercial use only
proprietary | 85 | 1.0 | proprietary and confidential : proprietary and confidential
proprietary | 85 | 1.0 | confidential and proprietary : confidential and proprietary
proprietary | 80 | 1.0 | trade secret : (?:contains|constitutes?) (?:[^ ]+ ){0,4}trade secrets?
proprietary | 80 | 0.9 | end user : end user licen[sc]e agreement
proprietary | 60 | 0.8 | internal use : for internal use only
proprietary | 40 | 0.7 | proprietary : proprietary (?:software|licen[sc]e|information)
evaluation | 80 | 0.9 | evaluation : for evaluation purposes only
academic | 80 | 0.9 | only : for (?:academic|research|educational)(?: and research| or research)? (?:use|purposes) only
copyright | 50 | 0.5 | copyright : copyright (?:c )?(?:19|20)[0-9]{2}
copyright | 45 | 0.5 | copyright : copyright (?:c )?by
copyright | 45 | 0.5 | copyright : protected by (?:international )?copyright law
warranty | 40 | 0.4 | warranty : (?:is )?provided as is without (?:any )?(?:express or implied )?warranty
warranty | 40 | 0.4 | warranties : without warranties or conditions of any kind
dmca | 50 | 0.6 | dmca : dmca (?:notice|takedown)
terms | 40 | 0.5 | terms of use : subject to (?:our|the|these) terms of use
"""

TABLES = (PERMISSIVE, GNU, RECIPROCAL, CREATIVE, WORKS, RESERVED)


def written_rules() -> list[tuple[str, str, str, int, float]]:
    """(pattern, keyword, label, priority, strength) of every line, in order."""
    out = []
    for line in "\n".join(TABLES).splitlines():
        if line.strip():
            head, pattern = line.split(" : ", 1)
            label, priority, strength, keyword = (x.strip() for x in head.split(" | "))
            out.append((pattern.strip(), keyword, label, int(priority), float(strength)))
    return out
