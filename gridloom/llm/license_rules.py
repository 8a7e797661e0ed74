"""Hand-written licence signatures over normalised text: lower-case words with one blank between.

One rule a line: label, priority, keyword, regex. Priority 1 is wording of the licence itself, 2 a notice that
grants or refers to it with its version, 3 a bare mention or tag. A text that has
none of a rule's keywords (whole words, parted by a slash) is not matched against its regex. Order settles ties, so the more particular rules come first.
"""

RULES = """
mit|1|permission|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|1|portions|the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit|1|software|to deal in the software without restriction including without limitation the rights to use copy modify
mit|2|mit|(?:released|licensed|distributed|available|provided|published) under (?:the )?(?:terms of the )?(?:x11 |expat )?mit licen[sc]e
mit|2|mit|(?:is|are) mit licensed
mit|2|mit|licen[sc]e mit(?= |$)
mit|2|mit|spdx license identifier mit(?! 0)
mit|2|mit|opensource org licenses mit
mit|3|mit|(?:the )?mit licen[sc]e
mit|3|mit|mit licensed
mit|3|expat|expat licen[sc]e
mit|3|x11|(?:mit )?x11 licen[sc]e
mit-0|2|mit|mit no attribution(?: licen[sc]e)?
mit-0|2|mit|spdx license identifier mit 0
apache-2.0|1|apache|apache license version 2 0 january 2004
apache-2.0|1|apache|you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0|1|contributor|each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0|2|apache|(?:released|licensed|distributed|available|provided|published) under (?:the )?(?:terms of the )?apache licen[sc]e,? ?(?:version |v )?2(?: 0)?
apache-2.0|2|apache|spdx license identifier apache 2 0
apache-2.0|2|apache|apache (?:software )?licen[sc]e (?:version |v ?)?2(?: 0)?
apache-2.0|2|apache|apache org licenses license 2 0
apache-2.0|2|apache|apache 2(?: 0)?(?: licen[sc]ed?)?
apache-2.0|3|asl|asl 2 0
apache-1.1|2|apache|apache (?:software )?licen[sc]e (?:version |v )?1 1
apache-1.0|2|apache|apache (?:software )?licen[sc]e (?:version |v )?1 0
apache|3|apache|(?:the )?apache (?:software )?licen[sc]e
agpl-3.0|1|affero|gnu affero general public license version 3 19 november 2007
agpl-3.0|2|affero|gnu affero general public licen[sc]e(?: as published by the free software foundation)?,? (?:either )?version 3
agpl-3.0|2|agpl/agplv3|spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0|2|agpl/agplv3/agpl3|agpl ?v?3(?: 0)?
agpl|3|affero|(?:gnu )?affero general public licen[sc]e
agpl|3|agpl/agplv3|agpl(?: licensed?)?
lgpl-3.0|1|lesser|gnu lesser general public license version 3 29 june 2007
lgpl-3.0|2|lesser|gnu lesser general public licen[sc]e (?:either )?(?:as published by the free software foundation )?(?:either )?version 3
lgpl-3.0|2|lgpl/lgplv3/lgplv2|spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0|2|lgpl/lgplv3/lgpl3|lgpl ?v?3(?: 0)?
lgpl-2.1|1|lesser|gnu lesser general public license version 2 1 february 1999
lgpl-2.1|2|lesser|gnu lesser general public licen[sc]e (?:either )?(?:as published by the free software foundation )?(?:either )?version 2(?: 1)?
lgpl-2.1|2|lgpl/lgplv3/lgplv2|spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1|2|lgpl/lgplv2/lgpl2|lgpl ?v?2 1
lgpl-2.0|2|library|gnu library general public licen[sc]e (?:either )?(?:as published by the free software foundation )?(?:either )?version 2
lgpl|3|lesser|(?:gnu )?lesser general public licen[sc]e
lgpl|3|library|(?:gnu )?library general public licen[sc]e
lgpl|3|lgpl/lgplv3/lgplv2|lgpl(?: licensed?)?
gpl-3.0|1|general|gnu general public license version 3 29 june 2007
gpl-3.0|1|general|the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0|2|general|(?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3
gpl-3.0|2|gpl/gplv3/gplv2|spdx license identifier gpl 3 0(?: only| or later)?
gpl-3.0|2|gpl/gplv3/gpl3|(?:gnu )?gpl ?v?3(?: 0)?(?: or later)?
gpl-2.0|1|general|gnu general public license version 2 june 1991
gpl-2.0|1|licenses|the licenses for most software are designed to take away your freedom to share and change it
gpl-2.0|2|general|(?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2
gpl-2.0|2|gpl/gplv3/gplv2|spdx license identifier gpl 2 0(?: only| or later)?
gpl-2.0|2|gpl/gplv2/gpl2|(?:gnu )?gpl ?v?2(?: 0)?(?: or later)?
gpl-1.0|2|general|(?:gnu )?general public licen[sc]e (?:version |v ?)1
gpl|2|general|free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl|3|general|(?:gnu )?general public licen[sc]e
gpl|3|gpl/gplv3/gplv2|(?:gnu )?gpl(?: licensed?)?
gfdl-1.3|2|documentation|gnu free documentation licen[sc]e (?:version |v ?)1 3
gfdl-1.2|2|documentation|gnu free documentation licen[sc]e (?:version |v ?)1 2
gfdl-1.1|2|documentation|gnu free documentation licen[sc]e (?:version |v ?)1 1
gfdl|3|documentation|(?:gnu )?free documentation licen[sc]e
gfdl|3|gfdl|gfdl(?: licensed)?
bsd-4-clause|1|advertising|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause|1|endorse|neither the name of .{1,120}? may be used to endorse or promote products derived from this software
bsd-2-clause|1|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd|1|redistributions|redistributions of source code must retain the above copyright notice
bsd|1|redistributions|redistributions in binary form must reproduce the above copyright notice
bsd-4-clause|2|bsd|(?:4 clause|original|old) bsd(?: style)? licen[sc]e
bsd-3-clause|2|bsd|(?:3 clause|new|modified|revised) bsd(?: style)? licen[sc]e
bsd-2-clause|2|bsd|(?:2 clause|simplified|freebsd) bsd(?: style)? licen[sc]e
bsd-3-clause|2|bsd|(?:spdx license identifier )?bsd 3 clause(?: licen[sc]e)?
bsd-2-clause|2|bsd|(?:spdx license identifier )?bsd 2 clause(?: licen[sc]e)?
bsd-4-clause|2|bsd|(?:spdx license identifier )?bsd 4 clause(?: licen[sc]e)?
0bsd|2|0bsd|(?:spdx license identifier )?0bsd
0bsd|2|bsd|zero clause bsd(?: licen[sc]e)?
bsd|3|bsd|bsd(?: style)? licen[sc]ed?
isc|1|permission|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|2|isc|(?:released|licensed|distributed) under (?:the )?(?:terms of the )?isc licen[sc]e
isc|2|isc|spdx license identifier isc
isc|3|isc|(?:the )?isc licen[sc]e
mpl-2.0|1|mozilla|this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0|2|mozilla|mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?
mpl-2.0|2|mpl/mplv2/mpl2|(?:spdx license identifier )?mpl ?v?2(?: 0)?
mpl-1.1|2|mozilla|mozilla public licen[sc]e (?:version |v ?)?1 1
mpl-1.1|2|mpl/mplv2|(?:spdx license identifier )?mpl 1 1
mpl-1.0|2|mozilla|mozilla public licen[sc]e (?:version |v ?)?1 0
mpl|3|mozilla|mozilla public licen[sc]e
epl-2.0|2|eclipse|eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?
epl-2.0|2|epl/eplv2/epl2|(?:spdx license identifier )?epl ?v?2(?: 0)?
epl-1.0|2|eclipse|eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?
epl-1.0|2|epl/eplv1/epl1|(?:spdx license identifier )?epl ?v?1(?: 0)?
epl|3|eclipse|eclipse public licen[sc]e
edl-1.0|2|eclipse|eclipse distribution licen[sc]e(?: (?:version |v ?)?1 0)?
cddl-1.1|2|development|common development and distribution licen[sc]e (?:version |v ?)?1 1
cddl-1.0|2|development|common development and distribution licen[sc]e (?:version |v ?)?1 0
cddl|3|development|common development and distribution licen[sc]e
cddl|3|cddl|cddl(?: 1 [01])?
cpl-1.0|2|common|common public licen[sc]e(?: (?:version |v ?)?1 0)?
ipl-1.0|2|ibm|ibm public licen[sc]e(?: (?:version |v ?)?1 0)?
eupl-1.2|2|european|european union public licen[sc]e (?:version |v ?)?1 2
eupl-1.1|2|european|european union public licen[sc]e (?:version |v ?)?1 1
eupl-1.2|2|eupl/euplv1/eupl1|eupl ?v?1 2
eupl|3|european|european union public licen[sc]e
eupl|3|eupl/euplv1|eupl
cecill-2.1|2|cecill|cecill (?:version |v ?)?2 1
cecill-b|2|cecill|cecill b
cecill-c|2|cecill|cecill c
cecill|3|cecill|cecill
osl-3.0|2|open|open software licen[sc]e (?:version |v ?)?3 0
osl|3|open|open software licen[sc]e
afl-3.0|2|academic|academic free licen[sc]e (?:version |v ?)?3 0
afl|3|academic|academic free licen[sc]e
artistic-2.0|2|artistic|artistic licen[sc]e (?:version |v ?)?2(?: 0)?
artistic-1.0|2|artistic|artistic licen[sc]e (?:version |v ?)?1(?: 0)?
artistic|3|artistic|(?:the )?artistic licen[sc]e
perl|2|perl|(?:under )?the same terms as perl(?: itself)?
zlib|1|altered|altered source versions must be plainly marked as such and must not be misrepresented
zlib|1|origin|the origin of this software must not be misrepresented
zlib|2|zlib|(?:the )?zlib(?: libpng)? licen[sc]e
libpng|2|libpng|libpng licen[sc]e(?: (?:version |v ?)?2)?
boost-1.0|1|boost|boost software license version 1 0 august 17th 2003
boost-1.0|2|boost|boost software licen[sc]e(?: (?:version |v ?)?1 0)?
boost-1.0|2|bsl|spdx license identifier bsl 1 0
boost-1.0|3|boost|boost licen[sc]e
bsl-1.1|2|business|business source licen[sc]e(?: (?:version |v ?)?1 1)?
bsl-1.1|2|busl|(?:spdx license identifier )?busl 1 1
sspl-1.0|2|server|server side public licen[sc]e(?: (?:version |v ?)?1)?
sspl-1.0|3|sspl/ssplv1/sspl1|sspl(?: ?v?1(?: 0)?)?
elastic-2.0|2|elastic|elastic licen[sc]e (?:version |v ?)?2(?: 0)?
elastic|3|elastic|elastic licen[sc]e
commons-clause|2|clause|commons clause(?: licen[sc]e condition)?(?: v?1 0)?
unlicense|1|public|this is free and unencumbered software released into the public domain
unlicense|2|unlicense|(?:spdx license identifier |the )?unlicense(?: org)?
wtfpl|1|fuck|do what the fuck you want to(?: public license)?
wtfpl|2|wtfpl|wtfpl
beerware|1|beer|if we meet some day and you think this stuff is worth it you can buy me a beer
beerware|2|beerware/beer|(?:the )?beer ?ware(?: licen[sc]e)?
beerware|2|beer|beer ware licen[sc]e
python-2.0|2|python|python software foundation licen[sc]e(?: (?:version |v ?)?2)?
python|3|psf|psf licen[sc]e
python|3|python|python licen[sc]e
php-3.01|2|php|php licen[sc]e (?:version |v ?)?3 01
php|3|php|(?:the )?php licen[sc]e
ruby|3|ruby|ruby s? ?licen[sc]e
openssl|1|openssl|this product includes software developed by the openssl project
openssl|2|openssl|openssl licen[sc]e
ssleay|2|ssleay|(?:original )?ssleay licen[sc]e
vim|2|vim|vim licen[sc]e
w3c|2|w3c|w3c software (?:notice and )?(?:and document )?licen[sc]e
w3c|3|w3c|w3c licen[sc]e
unicode|2|unicode|unicode (?:inc )?licen[sc]e(?: agreement)?
icu|2|icu|icu licen[sc]e
ofl-1.1|1|font|sil open font license version 1 1 26 february 2007
ofl-1.1|2|font|(?:sil )?open font licen[sc]e (?:version |v ?)?1 1
ofl-1.1|2|ofl|(?:spdx license identifier )?ofl 1 1
ofl|3|font|(?:sil )?open font licen[sc]e
ubuntu-font|2|ubuntu|ubuntu font licen[sc]e(?: (?:version |v ?)?1 0)?
bitstream-vera|2|bitstream|bitstream vera (?:fonts )?(?:copyright|licen[sc]e)
lppl-1.3c|2|latex|latex project public licen[sc]e (?:version |v ?)?1 3c?
lppl|3|latex|latex project public licen[sc]e
lppl|3|lppl|lppl(?: 1 3c?)?
ms-pl|2|microsoft|microsoft public licen[sc]e
ms-rl|2|microsoft|microsoft reciprocal licen[sc]e
ms-pl|3|ms|ms pl
ms-rl|3|ms|ms rl
intel|2|intel|intel (?:simplified software|open source) licen[sc]e
nvidia|2|nvidia|nvidia (?:software|source code) licen[sc]e
apsl-2.0|2|apple|apple public source licen[sc]e(?: (?:version |v ?)?2 0)?
sun|2|sun|sun (?:public|industry standards source) licen[sc]e
sissl|3|sissl|sissl
ncsa|2|ncsa|(?:university of illinois )?ncsa (?:open source )?licen[sc]e
ncsa|3|illinois|university of illinois open source licen[sc]e
postgresql|2|postgresql|postgresql licen[sc]e
sleepycat|2|sleepycat|sleepycat (?:software )?licen[sc]e
bzip2|2|bzip2|bzip2 licen[sc]e
curl|2|curl|curl licen[sc]e
tcl|2|tcl|tcl tk? ?licen[sc]e
json|1|evil|the software shall be used for good not evil
json|2|json|json licen[sc]e
upl-1.0|2|universal|universal permissive licen[sc]e(?: (?:version |v ?)?1 0)?
mulan-2.0|2|mulan|mulan (?:psl|permissive software licen[sc]e) ?v?2
odbl-1.0|2|database|open (?:data commons open )?database licen[sc]e(?: (?:version |v ?)?1 0)?
odbl|3|odbl|odbl(?: 1 0)?
odc-by|2|commons|open data commons attribution licen[sc]e
odc-by|3|odc|odc by(?: 1 0)?
pddl|2|pddl|pddl(?: 1 0)?
pddl|2|dedication|open data commons public domain dedication(?: and licen[sc]e)?
cdla-permissive|2|cdla|cdla permissive(?: [12] 0)?
cdla-sharing|2|cdla|cdla sharing(?: 1 0)?
cdla-permissive|2|community|community data licen[sc]e agreement permissive
ogl-3.0|2|government|open government licen[sc]e (?:version |v ?)?3(?: 0)?
ogl|3|government|open government licen[sc]e
etalab-2.0|2|ouverte|(?:etalab )?licence ouverte(?: (?:version |v ?)?2 0)?
cc0-1.0|1|waived|to the extent possible under law .{1,80}? has waived all copyright
cc0-1.0|2|cc0|(?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0-1.0|2|zero|creative commons zero(?: (?:version |v ?)?1 0)?
cc-by-nc-nd-4.0|2|cc|cc by nc nd 4 0
cc-by-nc-nd-3.0|2|cc|cc by nc nd 3 0
cc-by-nc-nd|2|commons|creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-nd|3|cc|cc by nc nd
cc-by-nc-sa-4.0|2|cc|cc by nc sa 4 0
cc-by-nc-sa-3.0|2|cc|cc by nc sa 3 0
cc-by-nc-sa|2|commons|creative commons attribution non ?commercial share ?alike
cc-by-nc-sa|3|cc|cc by nc sa
cc-by-nc-4.0|2|cc|cc by nc 4 0
cc-by-nc-3.0|2|cc|cc by nc 3 0
cc-by-nc|2|commons|creative commons attribution non ?commercial
cc-by-nc|3|cc|cc by nc
cc-by-nd-4.0|2|cc|cc by nd 4 0
cc-by-nd-3.0|2|cc|cc by nd 3 0
cc-by-nd|2|commons|creative commons attribution no ?deriv(?:ative)?s
cc-by-nd|3|cc|cc by nd
cc-by-sa-4.0|2|cc|cc by sa 4 0
cc-by-sa-3.0|2|cc|cc by sa 3 0
cc-by-sa-2.0|2|cc|cc by sa 2 [05]
cc-by-sa|2|commons|creative commons attribution share ?alike
cc-by-sa|3|cc|cc by sa
cc-by-4.0|2|cc|cc by 4 0
cc-by-3.0|2|cc|cc by 3 0
cc-by-2.0|2|cc|cc by 2 [05]
cc-by-4.0|2|commons|creative commons attribution 4 0(?: international)?
cc-by-3.0|2|commons|creative commons attribution 3 0(?: unported)?
cc-by|2|commons|creative commons attribution(?: licen[sc]e)?
cc-by|3|cc|cc by
creative-commons|3|creative|creative commons(?: licen[sc]e)?
public-domain|2|domain|(?:released|dedicated|placed) (?:in|in ?to|to) the public domain
public-domain|3|domain|public domain
proprietary|1|proprietary|this (?:software|document|file|material) is (?:the )?(?:confidential and )?proprietary
proprietary|1|prohibited|(?:unauthorized|unauthorised) (?:copying|use|redistribution|reproduction) .{0,60}?(?:is )?strictly prohibited
proprietary|2|reserved|all rights reserved
proprietary|3|confidential|proprietary and confidential
proprietary|3|confidential|confidential and proprietary
openrail-m|2|openrail/openrailm/rail/railm|(?:creativeml |bigscience )?open ?rail ?m?(?: licen[sc]e)?
openrail-m|2|responsible|responsible ai licen[sc]e
llama|2|llama|llama [23](?: [0-9])? community licen[sc]e
gemma|2|gemma|gemma terms of use
freeware|3|freeware|freeware
shareware|3|shareware|shareware
dual|2|dual|dual licensed under
licence-ref|3|license|see (?:the )?license (?:file|txt|md)?(?: for)?
licence-ref|3|license|spdx license identifier
licence-ref|3|copying|see (?:the )?(?:file )?copying
warranty|3|warranty/warranties|without warrant(?:y|ies) of any kind
warranty|3|warranty|provided as is without warranty
"""
