"""Hand-written license signatures.

One rule a line: label, rank, keyword, pattern. Patterns match whole words of the normal form (lower-case
words joined by single blanks, punctuation gone, so "GPL-3.0" reads "gpl 3 0"); a rule
is tried only where its keyword occurs. Rank 1 is a grant or identifier, 2 a name with its version,
3 a name, 4 a general phrase; the lower rank wins where one detection lies inside another.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    rank: int
    keyword: str
    pattern: str


_TEXT = """
gpl-1.0 | 2 | gpl | gpl v? ?1(?: 0)?
gpl-1.0 | 2 | general public license | gnu general public license v(?:ersion)? ?1(?: 0)?
gpl-2.0 | 1 | general public license | licensed under the gnu general public license v(?:ersion)? ?2(?: 0)?
gpl-2.0 | 2 | general public license | gnu general public license v(?:ersion)? ?2(?: 0)?
gpl-2.0 | 2 | gplv2 | gplv2(?: 0)?
gpl-2.0 | 2 | gpl | (?:gnu )?gpl (?:v ?|version )?2(?: 0)?
gpl-2.0-only | 1 | gpl | gpl 2 0 only
gpl-2.0-only | 1 | gplv2 | gplv2 only
gpl-2.0-or-later | 1 | gpl | gpl 2 0 or later
gpl-2.0-or-later | 1 | general public license | general public license (?:as published by the free software foundation )?either version 2 of the license or (?:at your option )?any later version
gpl-2.0-or-later | 1 | gplv2 | gplv2 or (?:later|newer)
gpl-3.0 | 1 | general public license | licensed under the gnu general public license v(?:ersion)? ?3(?: 0)?
gpl-3.0 | 2 | general public license | gnu general public license v(?:ersion)? ?3(?: 0)?
gpl-3.0 | 2 | gplv3 | gplv3(?: 0)?
gpl-3.0 | 2 | gpl | (?:gnu )?gpl (?:v ?|version )?3(?: 0)?
gpl-3.0-only | 1 | gpl | gpl 3 0 only
gpl-3.0-or-later | 1 | gpl | gpl 3 0 or later
gpl-3.0-or-later | 1 | general public license | general public license (?:as published by the free software foundation )?either version 3 of the license or (?:at your option )?any later version
gpl-3.0-or-later | 1 | gplv3 | gplv3 or (?:later|newer)
gpl | 3 | gnu gpl | gnu gpl
gpl | 3 | general public license | general public license
gpl-classpath-exception | 1 | classpath | gpl 2 0 with classpath exception
gpl-classpath-exception | 2 | classpath exception | classpath exception
gpl-linking-exception | 2 | linking exception | gpl (?:with )?linking exception
lgpl-2.0 | 2 | library general public license | gnu library general public license v(?:ersion)? ?2(?: 0)?
lgpl-2.1 | 1 | lesser general public license | licensed under the gnu lesser general public license v(?:ersion)? ?2 1
lgpl-2.1 | 2 | lesser general public license | gnu lesser general public license v(?:ersion)? ?2 1
lgpl-2.1 | 2 | lgpl | lgpl (?:v ?|version )?2 1
lgpl-2.1 | 2 | lgplv2 | lgplv2(?: 1)?
lgpl-2.1-or-later | 1 | lgpl | lgpl 2 1 or later
lgpl-3.0 | 1 | lesser general public license | licensed under the gnu lesser general public license v(?:ersion)? ?3(?: 0)?
lgpl-3.0 | 2 | lesser general public license | gnu lesser general public license v(?:ersion)? ?3(?: 0)?
lgpl-3.0 | 2 | lgpl | lgpl (?:v ?|version )?3(?: 0)?
lgpl-3.0 | 2 | lgplv3 | lgplv3(?: 0)?
lgpl-3.0-or-later | 1 | lgpl | lgpl 3 0 or later
lgpl | 3 | lesser general public license | (?:gnu )?lesser general public license
lgpl | 3 | gnu lgpl | gnu lgpl
agpl-1.0 | 2 | affero general public license | affero general public license v(?:ersion)? ?1(?: 0)?
agpl-3.0 | 1 | affero general public license | licensed under the gnu affero general public license v(?:ersion)? ?3(?: 0)?
agpl-3.0 | 2 | affero general public license | gnu affero general public license v(?:ersion)? ?3(?: 0)?
agpl-3.0 | 2 | agpl | agpl (?:v ?|version )?3(?: 0)?
agpl-3.0 | 2 | agplv3 | agplv3(?: 0)?
agpl-3.0-or-later | 1 | agpl | agpl 3 0 or later
agpl | 3 | affero general public license | (?:gnu )?affero general public license
gfdl-1.1 | 2 | free documentation license | gnu free documentation license v(?:ersion)? ?1 1
gfdl-1.2 | 2 | free documentation license | gnu free documentation license v(?:ersion)? ?1 2
gfdl-1.3 | 2 | free documentation license | gnu free documentation license v(?:ersion)? ?1 3
gfdl | 3 | free documentation license | (?:gnu )?free documentation license
gfdl | 2 | gfdl | gfdl(?: 1 [123])?
apache-1.0 | 2 | apache license | apache license v(?:ersion)? ?1(?: 0)?
apache-1.1 | 2 | apache | apache (?:software )?license v(?:ersion)? ?1 1
apache-1.1 | 1 | apache | spdx license identifier apache 1 1
apache-2.0 | 1 | apache license | licensed under the apache license v(?:ersion)? ?2(?: 0)?
apache-2.0 | 2 | apache license | apache license v(?:ersion)? ?2(?: 0)?
apache-2.0 | 2 | apache license | apache license 2(?: 0)?
apache-2.0 | 2 | apache software license | apache software license v(?:ersion)? ?2(?: 0)?
apache-2.0 | 1 | apache | spdx license identifier apache 2 0
apache-2.0 | 2 | apache | apache 2 0(?: license)?
apache-2.0 | 1 | www apache org licenses | www apache org licenses license 2 0
apache-2.0 | 2 | asl 2 0 | asl 2 0
apache-2.0-llvm-exception | 1 | llvm exception | apache 2 0 with llvm exception
apache | 3 | apache software license | apache software license
apache | 3 | apache license | apache license
mit | 1 | mit license | (?:released|licensed|distributed|available) under the (?:terms of the )?mit license
mit | 1 | spdx | spdx license identifier mit
mit | 1 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 3 | mit license | (?:the )?mit license
mit | 3 | mit licensed | mit licensed
mit | 2 | opensource org licenses mit | opensource org licenses mit(?: license php)?
mit-0 | 1 | mit 0 | mit 0(?: license)?
mit-0 | 2 | mit no attribution | mit no attribution(?: license)?
mit-modern-variant | 2 | mit license modern variant | mit license modern variant
x11 | 2 | x11 license | x11 license
expat | 2 | expat license | expat license
bsd-1-clause | 2 | bsd 1 clause | bsd 1 clause(?: license)?
bsd-2-clause | 1 | bsd 2 clause | spdx license identifier bsd 2 clause
bsd-2-clause | 2 | bsd 2 clause | bsd 2 clause(?: license)?
bsd-2-clause | 2 | simplified bsd license | simplified bsd license
bsd-2-clause | 2 | freebsd license | freebsd license
bsd-2-clause | 2 | two clause bsd | two clause bsd(?: license)?
bsd-2-clause | 2 | 2 clause bsd | 2 clause bsd(?: license)?
bsd-3-clause | 1 | bsd 3 clause | spdx license identifier bsd 3 clause
bsd-3-clause | 2 | bsd 3 clause | bsd 3 clause(?: license)?
bsd-3-clause | 2 | new bsd license | new bsd license
bsd-3-clause | 2 | modified bsd license | modified bsd license
bsd-3-clause | 2 | revised bsd license | revised bsd license
bsd-3-clause | 2 | three clause bsd | three clause bsd(?: license)?
bsd-3-clause | 2 | 3 clause bsd | 3 clause bsd(?: license)?
bsd-3-clause-clear | 1 | bsd 3 clause clear | bsd 3 clause clear(?: license)?
bsd-3-clause-lbnl | 1 | bsd 3 clause lbnl | bsd 3 clause lbnl
bsd-4-clause | 2 | bsd 4 clause | bsd 4 clause(?: license)?
bsd-4-clause | 2 | original bsd license | original bsd license
bsd-4-clause | 2 | four clause bsd | four clause bsd(?: license)?
0bsd | 1 | 0bsd | 0bsd(?: license)?
0bsd | 2 | zero clause bsd | (?:bsd )?zero clause bsd(?: license)?
bsd | 3 | bsd license | (?:the )?bsd license
bsd | 3 | bsd style license | bsd style license
bsd | 1 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd | 3 | berkeley software distribution license | berkeley software distribution license
isc | 1 | spdx | spdx license identifier isc
isc | 2 | isc license | (?:the )?isc license
isc | 1 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-1.0 | 2 | mozilla public license | mozilla public license v(?:ersion)? ?1(?: 0)?
mpl-1.1 | 2 | mozilla public license | mozilla public license v(?:ersion)? ?1 1
mpl-2.0 | 1 | mozilla public license | subject to the terms of the mozilla public license v ?2 0
mpl-2.0 | 2 | mozilla public license | mozilla public license v(?:ersion)? ?2(?: 0)?
mpl-1.1 | 2 | mpl | mpl 1 1
mpl-2.0 | 2 | mpl | mpl 2 0
mpl-2.0-no-copyleft-exception | 1 | mpl | mpl 2 0 no copyleft exception
mpl | 3 | mozilla public license | mozilla public license
epl-1.0 | 2 | eclipse public license | eclipse public license v(?:ersion)? ?1(?: 0)?
epl-2.0 | 2 | eclipse public license | eclipse public license v(?:ersion)? ?2(?: 0)?
epl-1.0 | 2 | epl | epl 1 0
epl-2.0 | 2 | epl | epl 2 0
epl | 3 | eclipse public license | eclipse public license
edl-1.0 | 2 | eclipse distribution license | eclipse distribution license(?: v(?:ersion)? ?1(?: 0)?)?
cddl-1.0 | 2 | common development and distribution license | common development and distribution license v(?:ersion)? ?1(?: 0)?
cddl-1.1 | 2 | common development and distribution license | common development and distribution license v(?:ersion)? ?1 1
cddl | 3 | common development and distribution license | common development and distribution license
cddl-1.0 | 2 | cddl | cddl 1 0
cddl-1.1 | 2 | cddl | cddl 1 1
cpl-1.0 | 2 | common public license | common public license(?: v(?:ersion)? ?1(?: 0)?)?
cpal-1.0 | 2 | common public attribution license | common public attribution license(?: v(?:ersion)? ?1(?: 0)?)?
ipl-1.0 | 2 | ibm public license | ibm public license(?: v(?:ersion)? ?1(?: 0)?)?
eupl-1.1 | 2 | european union public license | european union public licen[cs]e v(?:ersion)? ?1 1
eupl-1.2 | 2 | european union public licen | european union public licen[cs]e v(?:ersion)? ?1 2
eupl | 3 | european union public licen | european union public licen[cs]e
eupl-1.2 | 2 | eupl | eupl 1 2
osl-2.1 | 2 | open software license | open software license v(?:ersion)? ?2 1
osl-3.0 | 2 | open software license | open software license v(?:ersion)? ?3(?: 0)?
osl | 3 | open software license | open software license
afl-3.0 | 2 | academic free license | academic free license v(?:ersion)? ?3(?: 0)?
afl-2.1 | 2 | academic free license | academic free license v(?:ersion)? ?2 1
afl | 3 | academic free license | academic free license
artistic-1.0 | 2 | artistic license | artistic license 1(?: 0)?
artistic-2.0 | 2 | artistic license | artistic license (?:v(?:ersion)? ?)?2(?: 0)?
artistic | 3 | artistic license | artistic license
artistic-perl | 2 | under the same terms as perl | under the same terms as perl itself
bsl-1.0 | 2 | boost software license | boost software license(?: v(?:ersion)? ?1(?: 0)?)?
busl-1.1 | 2 | business source license | business source license(?: 1 1)?
zlib | 2 | zlib license | zlib license
zlib-libpng | 2 | zlib libpng license | zlib libpng license
libpng | 2 | libpng license | libpng license(?: v(?:ersion)? ?2)?
python-2.0 | 2 | python software foundation license | python software foundation license(?: v(?:ersion)? ?2)?
psf-2.0 | 2 | psf license | psf license(?: agreement)?(?: v(?:ersion)? ?2)?
php-3.01 | 2 | php license | php license(?: v(?:ersion)? ?3 01)?
ruby | 2 | ruby license | ruby license
openssl | 2 | openssl license | openssl license
postgresql | 2 | postgresql license | postgresql licen[cs]e
ncsa | 2 | open source license | (?:university of illinois )?ncsa open source license
unlicense | 1 | unlicense | (?:the )?unlicense
unlicense | 1 | released into the public domain | free and unencumbered software released into the public domain
wtfpl | 1 | wtfpl | wtfpl(?: 2)?
wtfpl | 2 | do what the | do what the f ?u? ?c? ?k? ?you want to public license
public-domain | 2 | public domain | dedicated to the public domain
public-domain | 2 | public domain | (?:released|placed) (?:in|into) the public domain
public-domain | 4 | public domain | public domain
cc0-1.0 | 1 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 2 | creative commons zero | creative commons zero(?: v?1 0 universal)?
cc-by-1.0 | 2 | cc by | cc by 1 0
cc-by-2.0 | 2 | cc by | cc by 2 0
cc-by-2.5 | 2 | cc by | cc by 2 5
cc-by-3.0 | 2 | cc by | cc by 3 0
cc-by-4.0 | 1 | cc by | licensed under cc by 4 0
cc-by-4.0 | 2 | cc by | cc by 4 0
cc-by | 3 | cc by | cc by
cc-by-sa-2.0 | 2 | cc by sa | cc by sa 2 0
cc-by-sa-2.5 | 2 | cc by sa | cc by sa 2 5
cc-by-sa-3.0 | 2 | cc by sa | cc by sa 3 0
cc-by-sa-4.0 | 1 | cc by sa | licensed under cc by sa 4 0
cc-by-sa-4.0 | 2 | cc by sa | cc by sa 4 0
cc-by-sa | 3 | cc by sa | cc by sa
cc-by-nd-3.0 | 2 | cc by nd | cc by nd 3 0
cc-by-nd-4.0 | 2 | cc by nd | cc by nd 4 0
cc-by-nd | 3 | cc by nd | cc by nd
cc-by-nc-2.0 | 2 | cc by nc | cc by nc 2 0
cc-by-nc-3.0 | 2 | cc by nc | cc by nc 3 0
cc-by-nc-4.0 | 1 | cc by nc | licensed under cc by nc 4 0
cc-by-nc-4.0 | 2 | cc by nc | cc by nc 4 0
cc-by-nc | 3 | cc by nc | cc by nc
cc-by-nc-sa-2.0 | 2 | cc by nc sa | cc by nc sa 2 0
cc-by-nc-sa-3.0 | 2 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 1 | cc by nc sa | licensed under cc by nc sa 4 0
cc-by-nc-sa-4.0 | 2 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-sa | 3 | cc by nc sa | cc by nc sa
cc-by-nc-nd-3.0 | 2 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 1 | cc by nc nd | licensed under cc by nc nd 4 0
cc-by-nc-nd-4.0 | 2 | cc by nc nd | cc by nc nd 4 0
cc-by-nc-nd | 3 | cc by nc nd | cc by nc nd
cc-by-4.0 | 1 | creative commons attribution 4 0 | creative commons attribution 4 0 international(?: license)?
cc-by-3.0 | 1 | creative commons attribution 3 0 | creative commons attribution 3 0 (?:unported|united states)(?: license)?
cc-by-sa-4.0 | 1 | attribution sharealike 4 0 | creative commons attribution sharealike 4 0 international(?: license)?
cc-by-sa-3.0 | 1 | attribution sharealike 3 0 | creative commons attribution sharealike 3 0 unported(?: license)?
cc-by-nd-4.0 | 1 | attribution noderivatives 4 0 | creative commons attribution noderivatives 4 0 international(?: license)?
cc-by-nc-4.0 | 1 | attribution noncommercial 4 0 | creative commons attribution noncommercial 4 0 international(?: license)?
cc-by-nc-sa-4.0 | 1 | attribution noncommercial sharealike 4 0 | creative commons attribution noncommercial sharealike 4 0 international(?: license)?
cc-by-nc-nd-4.0 | 1 | attribution noncommercial noderivatives 4 0 | creative commons attribution noncommercial noderivatives 4 0 international(?: license)?
cc-by | 3 | creative commons attribution | creative commons attribution(?: license)?
cc-by-sa | 3 | creative commons attribution | creative commons attribution share ?alike(?: license)?
creative-commons | 4 | creative commons license | creative commons licen[cs]e
creative-commons | 2 | creativecommons org licenses | creativecommons org licenses(?: by| nc| nd| sa)+(?: [1-4] [05])?
cc-pddc | 2 | creativecommons org publicdomain | creativecommons org publicdomain (?:zero|mark) 1 0
odbl-1.0 | 2 | open database license | open (?:data commons open )?database license(?: v?1 0)?
odc-by-1.0 | 2 | open data commons attribution license | open data commons attribution license(?: v?1 0)?
pddl-1.0 | 2 | public domain dedication and license | (?:odc )?public domain dedication and licen[cs]e
cdla-permissive-2.0 | 2 | community data license agreement permissive | community data license agreement permissive(?: 2 0)?
cdla-sharing-1.0 | 2 | community data license agreement sharing | community data license agreement sharing(?: 1 0)?
ogl-uk-3.0 | 2 | open government licence | open government licence(?: v(?:ersion)? ?3 0)?
ofl-1.1 | 2 | open font license | (?:sil )?open font license(?: v(?:ersion)? ?1 1)?
ms-pl | 2 | microsoft public license | microsoft public license
ms-rl | 2 | microsoft reciprocal license | microsoft reciprocal license
cecill-2.1 | 2 | cecill | cecill 2 1
cecill-b | 2 | cecill | cecill b(?: license)?
cecill-c | 2 | cecill | cecill c(?: license)?
mulan-psl-2.0 | 2 | mulan permissive software license | mulan permissive software license(?: v(?:ersion)? ?2)?
upl-1.0 | 2 | universal permissive license | universal permissive license(?: v(?:ersion)? ?1 0)?
vim | 2 | vim license | vim license
curl | 2 | curl license | curl license
w3c | 2 | w3c software | w3c software (?:notice and )?license
tcl | 2 | tcl tk license | tcl tk license
sleepycat | 2 | sleepycat license | sleepycat license
qpl-1.0 | 2 | q public license | q public license(?: v(?:ersion)? ?1 0)?
lppl-1.3c | 2 | latex project public license | latex project public license(?: v(?:ersion)? ?1 3c?)?
npl-1.1 | 2 | netscape public license | netscape public license(?: v(?:ersion)? ?1 [01])?
spl-1.0 | 2 | sun public license | sun public license(?: v(?:ersion)? ?1 0)?
apsl-2.0 | 2 | apple public source license | apple public source license(?: v(?:ersion)? ?2 0)?
ecl-2.0 | 2 | educational community license | educational community license(?: v(?:ersion)? ?2 0)?
elastic-2.0 | 2 | elastic license | elastic license(?: 2 0)?
sspl-1.0 | 2 | server side public license | server side public license(?: v(?:ersion)? ?1)?
commons-clause | 2 | commons clause | commons clause license condition v1 0
polyform-noncommercial-1.0.0 | 2 | polyform noncommercial license | polyform noncommercial license(?: 1 0 0)?
openrail | 2 | openrail | (?:creativeml |bigscience )?(?:bigcode )?openrail m?(?: license)?
llama-community | 2 | community license agreement | llama [0-9 ]{0,4}community license agreement
bittorrent-1.1 | 2 | bittorrent open source license | bittorrent open source license(?: 1 1)?
json | 1 | shall be used for good not evil | the software shall be used for good not evil
beerware | 1 | beer ware license | the beer ware license
proprietary | 2 | proprietary and confidential | proprietary and confidential
proprietary | 3 | proprietary license | proprietary licen[cs]e
all-rights-reserved | 3 | all rights reserved | all rights reserved
noncommercial | 3 | non commercial license | non commercial licen[cs]e
license-notice | 4 | licensed under the | licensed under the (?:terms of the )?[a-z0-9]+ licen[cs]e
license-notice | 4 | see license | see licen[cs]e (?:file )?for details
license-notice | 4 | spdx license identifier | spdx license identifier [a-z0-9]+
gpl-1.0-or-later | 1 | gpl 1 0 | spdx license identifier gpl 1 0(?: or later)?
gpl-2.0-only | 1 | gpl 2 0 | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | 1 | gpl 2 0 | (?:spdx license identifier )?gpl 2 0 (?:or (?:any )?(?:later|newer)(?: version)?|plus)
gpl-2.0-or-later | 1 | general public license | gnu general public license (?:version |v)2(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
gpl-3.0-only | 1 | gpl 3 0 | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | 1 | gpl 3 0 | (?:spdx license identifier )?gpl 3 0 (?:or (?:any )?(?:later|newer)(?: version)?|plus)
gpl-3.0-or-later | 1 | general public license | gnu general public license (?:version |v)3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
gpl | 3 | general public licence | (?:gnu )?general public licence(?: v(?:ersion)? ?[123](?: 0)?)?
gpl | 1 | redistribute it and or modify | (?:you can|you may) redistribute it and or modify it under the terms of the gnu (?:lesser |affero |library )?general public license
gpl | 2 | www gnu org licenses | (?:https? )?www gnu org licenses (?:old licenses )?gpl(?: [123](?: 0)?)?(?: (?:en )?(?:html|txt))?
gpl | 2 | see the gnu | see the gnu (?:lesser |affero )?general public license for more details
lgpl | 2 | www gnu org licenses | (?:https? )?www gnu org licenses (?:old licenses )?lgpl(?: [23](?: [01])?)?(?: (?:en )?(?:html|txt))?
lgpl-2.0-or-later | 1 | lgpl 2 0 | (?:spdx license identifier )?lgpl 2 0(?: only| or later)
lgpl-2.1-or-later | 1 | lgpl 2 1 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1-or-later | 1 | lesser general public license | lesser general public license (?:as published by the free software foundation )?either version 2 1 of the license or (?:at your option )?any later version
lgpl-3.0-or-later | 1 | lesser general public license | lesser general public license (?:as published by the free software foundation )?either version 3(?: 0)? of the license or (?:at your option )?any later version
lgpl | 3 | lesser general public licence | (?:gnu )?lesser general public licence(?: v(?:ersion)? ?[23](?: [01])?)?
agpl-3.0-or-later | 1 | affero general public license | affero general public license (?:as published by the free software foundation )?either version 3(?: 0)? of the license or (?:at your option )?any later version
agpl-3.0-only | 1 | agpl 3 0 | (?:spdx license identifier )?agpl 3 0(?: only| or later)
agpl | 2 | www gnu org licenses | (?:https? )?www gnu org licenses agpl(?: 3(?: 0)?)?(?: (?:en )?(?:html|txt))?
gfdl-1.3 | 1 | gfdl 1 3 | (?:spdx license identifier )?gfdl 1 3(?: no invariants| invariants)?(?: only| or later)
gfdl | 1 | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license(?: version 1 [123])?
apache-2.0 | 1 | apache license | under the (?:terms of the )?apache license v(?:ersion)? ?2(?: 0)?(?: the license)?
apache-2.0 | 1 | you may not use this file except in compliance with the license | you may not use this file except in compliance with the license(?: you may obtain a copy of the license at)?
apache-2.0 | 2 | apache licence | (?:the )?apache licence(?: v(?:ersion)? ?2(?: 0)?)?
apache-2.0 | 2 | apache2 | apache2(?: 0)?(?: licen[cs]ed?)?
apache-2.0 | 2 | apache v2 | apache v2(?: 0)?(?: licen[cs]e)?
mit | 1 | under the mit licen | (?:code|content|project|software|work) is (?:released|licen[cs]ed|distributed) under the mit licen[cs]e
mit | 3 | mit licence | (?:the )?mit licence
mit | 3 | mit x11 license | mit x11 (?:style )?licen[cs]e
mit | 1 | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 2 | license mit | licen[cs]e mit
x11 | 1 | spdx license identifier x11 | spdx license identifier x11(?: distribute modifications variant)?
bsd-2-clause | 2 | bsd 2 | bsd 2(?: clause)? (?:simplified|freebsd)(?: licen[cs]e)?
bsd-3-clause | 2 | bsd 3 | bsd 3(?: clause)? (?:new|revised|modified)(?: licen[cs]e)?
bsd-3-clause | 1 | neither the name of | neither the names? of (?:[a-z0-9]+ ){1,12}?(?:may|can) be used to endorse or promote products derived from this software
bsd-4-clause | 1 | this product includes software developed by | all advertising materials mentioning features or use of this software must display the following acknowledge?ment this product includes software developed by
bsd | 3 | bsd licence | (?:the )?(?:new |simplified |modified |revised )?bsd licence
bsd | 3 | bsd licensed | (?:[234] clause )?bsd licensed
isc | 2 | isc licence | (?:the )?isc licence
isc | 2 | opensource org licenses isc | (?:https? )?(?:www )?opensource org licenses isc(?: license)?(?: txt| php)?
bsd | 2 | opensource org licenses bsd | (?:https? )?(?:www )?opensource org licenses bsd(?: [23] clause| license)?(?: txt| php)?
mpl-2.0 | 1 | mpl 2 0 | (?:this source code form is subject to the terms of the |spdx license identifier )(?:mozilla public license )?(?:v ?)?mpl 2 0
mpl-2.0 | 1 | mozilla org mpl | (?:a copy of the mpl was not distributed with this file you can obtain one at )?(?:https? )?mozilla org mpl 2 0
mpl-1.1 | 1 | mpl 1 1 | (?:spdx license identifier |mozilla public license version 1 1 the license )mpl 1 1
epl-2.0 | 1 | epl 2 0 | spdx license identifier epl 2 0(?: or (?:gpl 2 0(?: or later)?|apache 2 0|bsd 3 clause))?
epl-1.0 | 1 | eclipse org legal | (?:https? )?(?:www )?eclipse org legal epl v(?:10|20| 1 0| 2 0)(?: html)?
cddl-1.0 | 1 | cddl | (?:spdx license identifier |license )cddl 1 [01]
bsl-1.0 | 1 | boost software license | distributed under the boost software license(?: version 1 0)?
bsl-1.0 | 1 | boost org license | (?:https? )?(?:www )?boost org license 1 0(?: txt)?
zlib | 1 | provided as is without any express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
artistic-2.0 | 1 | artistic 2 0 | (?:spdx license identifier )?artistic 2 0(?: licen[cs]e)?
unlicense | 1 | unlicense org | (?:please refer to |see )?(?:https? )?(?:www )?unlicense org
cc0-1.0 | 1 | creativecommons org publicdomain zero | (?:https? )?creativecommons org publicdomain zero 1 0(?: legalcode| deed [a-z]{2})?
cc-by-4.0 | 1 | creativecommons org licenses by | (?:https? )?creativecommons org licenses by 4 0(?: legalcode| deed [a-z]{2})?
cc-by-3.0 | 1 | creativecommons org licenses by | (?:https? )?creativecommons org licenses by 3 0(?: legalcode| deed [a-z]{2}| us)?
cc-by-sa-4.0 | 1 | creativecommons org licenses by sa | (?:https? )?creativecommons org licenses by sa 4 0(?: legalcode| deed [a-z]{2})?
cc-by-sa-3.0 | 1 | creativecommons org licenses by sa | (?:https? )?creativecommons org licenses by sa 3 0(?: legalcode| deed [a-z]{2}| us)?
cc-by-nc-4.0 | 1 | creativecommons org licenses by nc | (?:https? )?creativecommons org licenses by nc 4 0(?: legalcode| deed [a-z]{2})?
cc-by-nd-4.0 | 1 | creativecommons org licenses by nd | (?:https? )?creativecommons org licenses by nd 4 0(?: legalcode| deed [a-z]{2})?
cc-by-nc-sa-4.0 | 1 | creativecommons org licenses by nc sa | (?:https? )?creativecommons org licenses by nc sa 4 0(?: legalcode| deed [a-z]{2})?
cc-by-nc-nd-4.0 | 1 | creativecommons org licenses by nc nd | (?:https? )?creativecommons org licenses by nc nd 4 0(?: legalcode| deed [a-z]{2})?
cc-by-sa | 2 | creative commons by sa | creative commons by sa(?: [1-4] [05])?
cc-by-nc | 3 | creative commons attribution noncommercial | creative commons attribution non ?commercial(?: licen[cs]e)?
cc-by | 3 | creative commons by | creative commons by(?: [1-4] [05])?(?: licen[cs]e)?
creative-commons | 4 | creative commons licence | (?:a |the )?creative commons licence
ogl-uk-3.0 | 1 | open government licence | (?:contains public sector information )?licensed under the open government licence(?: v(?:ersion)? ?[123] 0)?
ofl-1.1 | 1 | open font license | licensed under the (?:sil )?open font license(?: version 1 1)?
odbl-1.0 | 1 | opendatacommons org licenses | (?:https? )?(?:www )?opendatacommons org licenses (?:odbl|by|pddl)(?: 1 0)?
eupl-1.2 | 1 | eupl | licensed under the eupl(?: v(?:ersion)? ?1 [12])?(?: or later)?
python-2.0 | 1 | psf 2 0 | spdx license identifier (?:psf|python) 2 0(?: 1)?
proprietary | 2 | proprietary | (?:this (?:software|document|material) is )?(?:strictly )?(?:confidential and proprietary|proprietary and confidential)(?: licen[cs]e| information)?
all-rights-reserved | 2 | all rights reserved | copyright (?:c )?(?:(?:19|20)[0-9]{2} )(?:[a-z0-9]+ ){1,6}?all rights reserved
license-notice | 4 | license agreement | (?:end user |software )?licen[cs]e agreement
license-notice | 4 | licence agreement | (?:end user |software )?licence agreement
license-notice | 4 | dual licensed | dual licensed under (?:the )?(?:[a-z0-9]+ ){1,8}?(?:and|or) (?:the )?[a-z0-9]+
"""

RULES = tuple(Rule(label, int(rank), keyword, pattern) for label, rank, keyword, pattern in (line.split(" | ") for line in _TEXT.strip().splitlines()))

#: One of these occurs in every keyword; texts with none of them are never scanned further.
ANCHORS = ("licen", "redistribute it and or modify", "see the gnu", "the above copyright notice and this permission notice", "neither the name of", "this product includes software developed by", "mozilla org mpl", "eclipse org legal", "boost org ", "express or implied warranty", "artistic 2 0", "psf 2 0", "proprietary", "gpl", "gfdl", "spdx", "apache", "asl 2", "mit 0", "mit no attribution", "bsd", "mpl", "epl", "cddl", "eupl", "classpath", "linking exception", "llvm exception", "cecill", "permission ", "redistribution and use", "same terms as perl", "public domain", "creativecommons", "creative commons", "attribution ", "cc by", "cc0", "wtfpl", "do what the", "w3c software", "commons clause", "openrail", "used for good not evil", "all rights reserved")

#: The phrases whose places are counted, by the first of their words.
BASE = {"gnu": ("gnu general public license", "gpl"), "apache": ("apache license", "apache"), "cc": ("cc by", "cc-by"), "mit": ("mit license", "mit")}
