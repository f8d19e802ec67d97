"""Signature rules of license_scan, one a line: label | weight | words that must all be there | pattern.

Patterns are matched against a text's words in lower case with one space between them ("Apache License, Version 2.0" is
"apache license version 2 0") and begin and end at words. Earlier rules have priority over later ones. Weights say how
sure a match is: grants and identifiers more than names, names more than bare mentions.
"""

RULES = r"""
agpl-3.0|0.99|affero version|gnu affero general public license(?: as published by the free software foundation)? (?:either )?version 3(?: of the license)?(?: or at your option any later version)?
agpl-3.0|0.95|affero 3|(?:gnu )?affero (?:general public license |gpl )(?:version |v)?3(?: 0)?
agpl-3.0|0.95|agpl 3|(?:gnu )?agpl (?:version |v)?3(?: 0)?(?: only| or later)?
agpl-3.0|0.95|agplv3|(?:gnu )?agplv3(?: or later)?
agpl-1.0|0.95|affero 1|affero general public license (?:version |v)?1(?: 0)?
agpl-1.0|0.9|agpl 1|agpl (?:version |v)?1(?: 0)?
agpl|0.85|affero|(?:gnu )?affero (?:general public license|gpl)
agpl|0.7|agpl|(?:gnu )?agpl
lgpl-3.0|0.98|lesser version 3|gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 3(?: of the license)?(?: or at your option any later version)?
lgpl-3.0|0.95|lesser 3|(?:gnu )?lesser (?:general public license |gpl )(?:version |v)?3(?: 0)?
lgpl-3.0|0.95|lgpl 3|(?:gnu )?lgpl (?:version |v)?3(?: 0)?(?: only| or later)?
lgpl-3.0|0.95|lgplv3|(?:gnu )?lgplv3(?: or later)?
lgpl-2.1|0.98|lesser version 2 1|gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 2 1(?: of the license)?(?: or at your option any later version)?
lgpl-2.1|0.95|lesser 2 1|(?:gnu )?lesser (?:general public license |gpl )(?:version |v)?2 1
lgpl-2.1|0.95|lgpl 2 1|(?:gnu )?lgpl (?:version |v)?2 1(?: only| or later)?
lgpl-2.1|0.95|lgplv2 1|(?:gnu )?lgplv2 1(?: or later)?
lgpl-2.0|0.95|library 2|gnu library general public license(?: as published by the free software foundation)? (?:either )?(?:version |v)?2(?: 0)?
lgpl-2.0|0.95|lgpl 2 0|(?:gnu )?lgpl (?:version |v)?2 0(?: only| or later)?
lgpl-2.0|0.9|lgplv2|(?:gnu )?lgplv2(?: or later)?
lgpl|0.85|lesser|(?:gnu )?lesser (?:general public license|gpl)
lgpl|0.85|library public|gnu library general public license
lgpl|0.7|lgpl|(?:gnu )?lgpl
gpl-3.0|0.99|gnu version 3|gnu general public license(?: as published by the free software foundation)? (?:either )?version 3(?: 0)?(?: of the license)?(?: or at your option any later version)?
gpl-3.0|0.95|public 3|(?:gnu )?general public license (?:version |v)?3(?: 0)?
gpl-3.0|0.95|gpl 3|(?:gnu )?gpl (?:version |v)?3(?: 0)?(?: only| or later)?
gpl-3.0|0.95|gplv3|(?:gnu )?gplv3(?: or later)?
gpl-2.0|0.99|gnu version 2|gnu general public license(?: as published by the free software foundation)? (?:either )?version 2(?: 0)?(?: of the license)?(?: or at your option any later version)?
gpl-2.0|0.95|public 2|(?:gnu )?general public license (?:version |v)?2(?: 0)?
gpl-2.0|0.95|gpl 2|(?:gnu )?gpl (?:version |v)?2(?: 0)?(?: only| or later)?
gpl-2.0|0.95|gplv2|(?:gnu )?gplv2(?: or later)?
gpl-1.0|0.95|gnu version 1|gnu general public license(?: as published by the free software foundation)? (?:either )?version 1(?: 0)?(?: of the license)?
gpl-1.0|0.9|gpl 1|(?:gnu )?gpl (?:version |v)?1(?: 0)?(?: only| or later)?
gpl-classpath-exception|0.95|classpath exception|(?:gnu )?classpath exception(?: 2 0)?
gpl-classpath-exception|0.9|linking executable exception|as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-gcc-exception|0.95|gcc exception|gcc runtime library exception(?: version 3 1| 3 1)?
gpl-autoconf-exception|0.9|autoconf exception|autoconf (?:configure script )?exception
gpl-bison-exception|0.9|bison exception|bison (?:parser )?exception(?: 2 2)?
gpl-font-exception|0.9|font exception|(?:gnu )?(?:gpl )?font exception
gpl-any|0.85|gnu public|gnu general public license
gpl-any|0.7|gnu gpl|gnu gpl
gpl-any|0.7|redistribute gnu|redistribute it and or modify it under the terms of the gnu
gfdl-1.3|0.97|free documentation 1 3|(?:gnu )?free documentation license (?:version |v)?1 3(?: or any later version)?
gfdl-1.3|0.95|gfdl 1 3|(?:gnu )?gfdl (?:version |v)?1 3
gfdl-1.2|0.97|free documentation 1 2|(?:gnu )?free documentation license (?:version |v)?1 2(?: or any later version)?
gfdl-1.2|0.95|gfdl 1 2|(?:gnu )?gfdl (?:version |v)?1 2
gfdl-1.1|0.97|free documentation 1 1|(?:gnu )?free documentation license (?:version |v)?1 1(?: or any later version)?
gfdl|0.85|free documentation|(?:gnu )?free documentation license
gfdl|0.7|gfdl|(?:gnu )?gfdl
apache-2.0|0.99|licensed apache version 2|licensed under the apache license version 2 0(?: the license)?(?: you may not use this file except in compliance with the license)?
apache-2.0|0.97|apache license 2|apache (?:software )?license (?:version |v)?2(?: 0)?
apache-2.0|0.97|apache org licenses 2|(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0|0.95|apache 2 0|(?:asl|al|apache) (?:version |v)?2 0
apache-2.0|0.9|apache license v2|apache license v2
apache-2.0|0.8|asl 2 0|asl 2 0
apache-1.1|0.95|apache 1 1|apache (?:software )?(?:license )?(?:version |v)?1 1
apache-1.0|0.95|apache license 1 0|apache (?:software )?license (?:version |v)?1 0
apache|0.8|apache license|(?:the )?apache (?:software )?license
mit|0.98|permission hereby granted free charge|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|0.97|released mit license|(?:released|licensed|distributed|published|available) under (?:the )?(?:terms of the )?mit licen[cs]e
mit|0.95|mit license|(?:the )?mit licen[cs]e
mit|0.95|mit licence|(?:the )?mit licen[cs]e
mit|0.95|expat license|(?:the )?expat licen[cs]e
mit|0.95|opensource org licenses mit|opensource org licenses mit(?: license)?(?: php| html)?
mit|0.95|spdx identifier mit|spdx license identifier mit
mit-0|0.97|mit 0 license|(?:spdx license identifier mit 0|mit 0 license)
mit-0|0.95|mit no attribution|mit no attribution(?: license)?
x11|0.95|x11 license|(?:mit )?x11 licen[cs]e
x11|0.8|x consortium|x consortium
isc|0.97|permission use copy modify fee|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|0.95|isc license|(?:the )?isc licen[cs]e
isc|0.95|spdx identifier isc|spdx license identifier isc
0bsd|0.97|0bsd|0bsd
0bsd|0.95|zero clause bsd|zero clause bsd(?: license)?
bsd-4-clause|0.97|bsd 4 clause|bsd 4 clause(?: license)?
bsd-4-clause|0.95|4 clause bsd|4 clause bsd(?: license)?
bsd-4-clause|0.9|original bsd|original bsd licen[cs]e
bsd-4-clause|0.97|advertising materials mentioning features|all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-3-clause|0.97|bsd 3 clause|bsd 3 clause(?: license| clear| attribution)?
bsd-3-clause|0.95|3 clause bsd|3 clause bsd(?: license)?
bsd-3-clause|0.95|three clause bsd|three clause bsd(?: license)?
bsd-3-clause|0.9|new bsd|new bsd licen[cs]e
bsd-3-clause|0.9|modified bsd|modified bsd licen[cs]e
bsd-3-clause|0.97|neither name contributors endorse|neither the name of (?:the )?(?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-2-clause|0.97|bsd 2 clause|bsd 2 clause(?: license| patent| views)?
bsd-2-clause|0.95|2 clause bsd|2 clause bsd(?: license)?
bsd-2-clause|0.95|two clause bsd|two clause bsd(?: license)?
bsd-2-clause|0.9|simplified bsd|simplified bsd licen[cs]e
bsd-2-clause|0.9|freebsd license|freebsd licen[cs]e
bsd|0.9|redistribution source binary forms|redistribution and use in source and binary forms with or without modification are permitted
bsd|0.8|bsd license|(?:the )?bsd (?:style )?licen[cs]e
bsd|0.8|bsd licence|(?:the )?bsd (?:style )?licen[cs]e
bsd|0.7|bsd licensed|bsd licensed
mpl-2.0|0.98|source code form mozilla 2|this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0|0.97|mozilla public 2|mozilla public license (?:version |v )?2(?: 0)?
mpl-2.0|0.95|mpl 2 0|mpl (?:version |v)?2 0(?: no copyleft exception)?
mpl-2.0|0.9|mpl2|mpl2
mpl-2.0|0.95|mozilla org mpl 2|(?:https? )?(?:www )?mozilla org mpl 2 0
mpl-1.1|0.97|mozilla public 1 1|mozilla public license (?:version |v )?1 1
mpl-1.1|0.95|mpl 1 1|mpl (?:version |v)?1 1
mpl-1.0|0.95|mozilla public 1 0|mozilla public license (?:version |v )?1 0
mpl|0.85|mozilla public|mozilla public license
epl-2.0|0.97|eclipse public 2|eclipse public license (?:version |v )?(?:2 0|2)
epl-2.0|0.95|epl 2 0 license|epl (?:version |v)?2 0
epl-1.0|0.97|eclipse public 1|eclipse public license (?:version |v )?(?:1 0|1)
epl-1.0|0.95|epl 1 0 license|epl (?:version |v)?1 0
epl|0.85|eclipse public|eclipse public license
edl-1.0|0.95|eclipse distribution|eclipse distribution license(?: v)?(?: 1 0)?
cddl-1.1|0.97|cddl 1 1|cddl (?:version |v)?1 1
cddl-1.0|0.97|cddl 1 0|cddl (?:version |v)?1 0
cddl|0.9|common development distribution|common development and distribution license(?: version 1 [01]| 1 [01])?
cddl|0.7|cddl|cddl
cpl-1.0|0.95|common public 1 0|common public license (?:version |v)?1 0
cpl|0.85|common public license|common public license
cpal-1.0|0.95|common public attribution|common public attribution license(?: version)?(?: 1 0)?
ipl-1.0|0.95|ibm public|ibm public license(?: version)?(?: 1 0)?
apsl-2.0|0.95|apple public source|apple public source license(?: version)?(?: 2 0)?
npl-1.1|0.95|netscape public|netscape public license(?: version)?(?: 1 [01])?
spl-1.0|0.95|sun public|sun public license(?: version)?(?: 1 0)?
qpl-1.0|0.95|q public|q public license(?: version)?(?: 1 0)?
osl-3.0|0.95|open software 3|open software license (?:version |v)?3(?: 0)?
osl|0.85|open software license|open software license
afl-3.0|0.95|academic free 3|academic free license (?:version |v)?3(?: 0)?
afl|0.85|academic free|academic free license
artistic-2.0|0.97|artistic 2|(?:the )?artistic license (?:version |v)?2(?: 0)?
artistic-1.0|0.95|artistic 1|(?:the )?artistic license (?:version |v)?1(?: 0)?
artistic|0.85|artistic license|(?:the )?(?:clarified )?artistic license
artistic|0.85|perl itself terms|same terms as perl(?: 5)? itself
eupl-1.2|0.97|european union public 1 2|european union public licen[cs]e (?:version |v )?1 2
eupl-1.2|0.95|eupl 1 2|eupl (?:version |v)?1 2
eupl-1.1|0.97|european union public 1 1|european union public licen[cs]e (?:version |v )?1 1
eupl-1.1|0.95|eupl 1 1|eupl (?:version |v)?1 1
eupl|0.85|european union public|european union public licen[cs]e
cecill-2.1|0.95|cecill 2 1|cecill (?:version |v)?2 1
cecill-b|0.95|cecill b|cecill b
cecill-c|0.95|cecill c|cecill c
cecill|0.8|cecill|cecill(?: license)?
bsl-1.0|0.97|boost software|boost software license(?: version)?(?: 1 0)?
bsl-1.0|0.95|bsl 1 0|bsl 1 0
busl-1.1|0.97|business source|business source license(?: version)?(?: 1 1)?
busl-1.1|0.95|busl 1 1|busl 1 1
sspl-1.0|0.97|server side public|server side public license(?: version)?(?: 1)?
sspl-1.0|0.95|sspl|sspl(?: 1 0| v1)?
elastic-2.0|0.95|elastic license|elastic license(?: version)?(?: 2 0| v2)?
commons-clause|0.95|commons clause|commons clause(?: license condition)?(?: v1 0)?
polyform|0.95|polyform|polyform (?:noncommercial|small business|strict|shield|perimeter|free trial)(?: license)?(?: 1 0 0)?
zlib|0.97|provided as is express implied altered|altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib|0.95|zlib license|(?:the )?zlib(?: libpng)? licen[cs]e
zlib|0.95|spdx identifier zlib|spdx license identifier zlib
libpng|0.95|libpng license|libpng licen[cs]e(?: version 2)?
curl|0.95|curl license|curl licen[cs]e
openssl|0.95|openssl license|openssl licen[cs]e
openssl|0.9|openssl toolkit includes software|this product includes software developed by the openssl project for use in the openssl toolkit
ssleay|0.9|eric young cryptographic|this product includes cryptographic software written by eric young
php-3.01|0.95|php license 3 01|php license (?:version |v)?3 01
php|0.85|php license|(?:the )?php license
python-2.0|0.95|python software foundation|python software foundation license(?: version)?(?: 2)?
python-2.0|0.9|psf license|psf license(?: agreement)?
ruby|0.85|ruby license|ruby(?: s)? license
postgresql|0.95|postgresql license|(?:the )?postgresql licen[cs]e
ntp|0.9|ntp license|ntp license
ncsa|0.95|ncsa open source|(?:university of illinois )?ncsa open source license
ncsa|0.9|llvm exception|llvm exception(?:s)?
unicode|0.95|unicode license|unicode license(?: agreement)?(?: v3)?
icu|0.9|icu license|icu license
w3c|0.95|w3c software|w3c software(?: and document)?(?: notice and)? license
vim|0.9|vim license|(?:the )?vim license
wtfpl|0.97|do what fuck want public license|do what the fuck you want to public license
wtfpl|0.95|wtfpl|wtfpl
unlicense|0.97|free unencumbered software released public domain|this is free and unencumbered software released into the public domain
unlicense|0.95|unlicense|(?:the )?unlicense
beerware|0.95|beerware|beerware(?: license)?
beerware|0.9|beer ware license|beer ware license
jquery|0.8|jquery license|jquery license
json|0.95|software shall used good evil|the software shall be used for good not evil
mulan-2.0|0.95|mulan|mulan (?:psl|permissive software license)(?: v2| version 2)?
ms-pl|0.95|microsoft public|microsoft public license
ms-pl|0.9|ms pl|ms pl
ms-rl|0.95|microsoft reciprocal|microsoft reciprocal license
upl-1.0|0.95|universal permissive|universal permissive license(?: version| v)?(?: 1 0)?
blueoak-1.0.0|0.95|blue oak model|blue oak model license(?: 1 0 0)?
cc-by-nc-nd-4.0|0.98|creative commons noncommercial noderivatives 4|creative commons attribution non ?commercial no ?derivati?ves 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-nd-4.0|0.97|cc by nc nd 4|cc by nc nd (?:version |v)?4(?: 0)?(?: international| deed)?
cc-by-nc-nd-3.0|0.97|cc by nc nd 3|cc by nc nd (?:version |v)?3(?: 0)?(?: unported)?
cc-by-nc-nd|0.93|cc by nc nd|cc by nc nd
cc-by-nc-nd|0.93|creative commons noncommercial noderivatives|creative commons attribution non ?commercial no ?derivati?ves
cc-by-nc-sa-4.0|0.98|creative commons noncommercial sharealike 4|creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-sa-4.0|0.97|cc by nc sa 4|cc by nc sa (?:version |v)?4(?: 0)?(?: international| deed)?
cc-by-nc-sa-3.0|0.97|cc by nc sa 3|cc by nc sa (?:version |v)?3(?: 0)?(?: unported)?
cc-by-nc-sa|0.93|cc by nc sa|cc by nc sa
cc-by-nc-sa|0.93|creative commons noncommercial sharealike|creative commons attribution non ?commercial share ?alike
cc-by-nc-4.0|0.98|creative commons noncommercial 4|creative commons attribution non ?commercial 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-4.0|0.97|cc by nc 4|cc by nc (?:version |v)?4(?: 0)?(?: international| deed)?
cc-by-nc-3.0|0.97|cc by nc 3|cc by nc (?:version |v)?3(?: 0)?(?: unported)?
cc-by-nc-2.0|0.97|cc by nc 2|cc by nc (?:version |v)?2(?: [05])?(?: generic)?
cc-by-nc|0.93|cc by nc|cc by nc
cc-by-nc|0.93|creative commons noncommercial|creative commons attribution non ?commercial
cc-by-nd-4.0|0.97|cc by nd 4|cc by nd (?:version |v)?4(?: 0)?(?: international| deed)?
cc-by-nd-3.0|0.97|cc by nd 3|cc by nd (?:version |v)?3(?: 0)?(?: unported)?
cc-by-nd|0.93|cc by nd|cc by nd
cc-by-nd|0.93|creative commons noderivatives|creative commons attribution no ?derivati?ves(?: 4 0| 3 0)?
cc-by-sa-4.0|0.98|creative commons sharealike 4|creative commons attribution share ?alike 4 0(?: international)?(?: licen[cs]e)?
cc-by-sa-4.0|0.97|cc by sa 4|cc by sa (?:version |v)?4(?: 0)?(?: international| deed)?
cc-by-sa-3.0|0.97|cc by sa 3|cc by sa (?:version |v)?3(?: 0)?(?: unported)?
cc-by-sa-2.0|0.97|cc by sa 2|cc by sa (?:version |v)?2(?: [05])?(?: generic)?
cc-by-sa|0.93|cc by sa|cc by sa
cc-by-sa|0.93|creative commons sharealike|creative commons attribution share ?alike(?: 3 0| 2 [05])?
cc-by-4.0|0.98|creative commons attribution 4|creative commons attribution 4 0(?: international)?(?: licen[cs]e)?
cc-by-4.0|0.97|cc by 4|cc by (?:version |v)?4(?: 0)?(?: international| deed)?
cc-by-3.0|0.97|creative commons attribution 3|creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
cc-by-3.0|0.97|cc by 3|cc by (?:version |v)?3(?: 0)?(?: unported)?
cc-by-2.0|0.97|cc by 2|cc by (?:version |v)?2(?: [05])?(?: generic)?
cc-by|0.9|creative commons attribution|creative commons attribution(?: licen[cs]e)?
cc-by|0.85|cc by|cc by
cc0-1.0|0.98|cc0|cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0|0.97|creative commons zero|creative commons zero(?: v1 0| 1 0)?(?: universal)?
cc0-1.0|0.95|creativecommons publicdomain zero|creativecommons org publicdomain zero 1 0
cc-pdm-1.0|0.95|public domain mark|public domain mark(?: 1 0)?
cc-url|0.9|creativecommons licenses|(?:https? )?(?:www )?creativecommons org licenses by(?: nc)?(?: nd| sa)?(?: [1-4] [05])?
cc|0.8|creative commons license|creative commons licen[cs]e
cc|0.8|creative commons licence|creative commons licen[cs]e
cc|0.6|creative commons|creative commons
odbl-1.0|0.97|open database|open (?:data commons open )?database license(?: v1 0| 1 0)?
odbl-1.0|0.95|odbl|odbl(?: 1 0)?
odc-by-1.0|0.97|open data commons attribution|open data commons attribution license(?: v1 0| 1 0)?
odc-by-1.0|0.95|odc by|odc by(?: 1 0)?
pddl-1.0|0.97|public domain dedication license|(?:open data commons )?public domain dedication and license
pddl-1.0|0.95|pddl|pddl(?: 1 0)?
cdla-permissive-2.0|0.95|community data license permissive 2|community data license agreement permissive (?:version )?2(?: 0)?
cdla|0.85|community data license|community data license agreement
ogl-uk-3.0|0.97|open government 3|open government licen[cs]e (?:version |v)?3(?: 0)?
ogl|0.85|open government|open government licen[cs]e
etalab-2.0|0.95|etalab|(?:licence ouverte )?etalab(?: 2 0)?
dl-de-by-2.0|0.95|datenlizenz deutschland|datenlizenz deutschland(?: namensnennung)?(?: version)?(?: 2 0)?
ofl-1.1|0.97|sil open font|sil open font license(?: version)?(?: 1 1)?
ofl-1.1|0.95|ofl 1 1|ofl 1 1
ofl|0.85|open font license|open font license
ubuntu-font-1.0|0.95|ubuntu font|ubuntu font licen[cs]e(?: 1 0)?
bitstream-vera|0.95|bitstream vera|bitstream vera(?: fonts)? (?:copyright|license)
lppl-1.3c|0.97|latex project 1 3|latex project public license (?:version |v)?1 3c?
lppl|0.9|latex project public|latex project public license
lppl|0.8|lppl|lppl(?: 1 3c?)?
openrail|0.95|openrail|(?:creativeml |bigscience )?openrail(?: m)?(?: license)?
llama-community|0.95|llama community license|llama (?:2 |3 |3 1 |3 2 )?community license(?: agreement)?
free-art-1.3|0.95|free art license|free art license(?: 1 3)?
free-art-1.3|0.95|licence art libre|licence art libre
public-domain|0.9|dedicated public domain|(?:hereby )?dedicated to the public domain
public-domain|0.9|placed public domain|placed (?:in|into) the public domain
public-domain|0.85|gemeinfrei|gemeinfrei
public-domain|0.8|public domain|(?:in |into )?the public domain
proprietary|0.95|proprietary confidential|(?:this is )?(?:proprietary and confidential|confidential and proprietary)(?: information)?
proprietary|0.9|unauthorized copying|unauthorized copying(?: of this file)?(?: via any medium)? is strictly prohibited
proprietary|0.9|without prior written permission|may not be (?:reproduced|copied|distributed|used)(?: \S+){0,12} without (?:the )?(?:express )?prior written permission
proprietary|0.9|end user license agreement|end user licen[cs]e agreement
proprietary|0.8|proprietary license|proprietary licen[cs]e
proprietary|0.8|commercial license required|commercial licen[cs]e (?:is )?required
trade-secret|0.85|trade secrets|contains (?:valuable )?trade secrets
non-commercial|0.85|non commercial use only|(?:for )?non ?commercial use only
non-commercial|0.85|noncommercial use only|(?:for )?non ?commercial use only
non-commercial|0.8|personal use only|(?:for )?personal(?: and non commercial)? use only
no-redistribution|0.8|redistribution prohibited|redistribution (?:is )?(?:strictly )?prohibited
restricted|0.85|reserved rights all|copyright (?:\S+ ){1,12}all rights reserved
restricted|0.7|all rights reserved|all rights reserved
restricted|0.7|alle rechte vorbehalten|alle rechte vorbehalten
restricted|0.7|tous droits réservés|tous droits réservés
restricted|0.7|todos los derechos reservados|todos los derechos reservados
restricted|0.6|some rights reserved|some rights reserved
permissive-notice|0.6|no rights reserved|no rights reserved
dual-license|0.75|dual licensed|dual licensed under
dual-license|0.7|multi licensed|multi licensed under
spdx|0.75|spdx identifier|spdx license identifier [a-z]\S*(?: [0-9]\S*){0,3}
license-file|0.5|license file details|see (?:the )?license (?:file )?for (?:more )?details
license-file|0.5|see license txt|see license(?: txt| md)
license-named|0.45|licensed terms license|licensed under the terms of (?:the )?(?:\S+ ){1,6}licen[cs]e
license-named|0.4|licensed under license|licensed under (?:the )?(?:\S+ ){1,5}licen[cs]e
as-is|0.5|as is without warranty|(?:provided |distributed )?as is without warrant(?:y|ies)(?: of any kind)?
no-warranty|0.45|without any warranty|without any warranty
no-warranty|0.45|merchantability fitness particular purpose|merchantability (?:or|and) fitness for a particular purpose
copyright|0.4|copyright c|copyright (?:c )(?:19|20)[0-9][0-9]
copyright|0.4|copyright ©|copyright © ?(?:19|20)[0-9][0-9]
copyright|0.35|©|© (?:19|20)[0-9][0-9]
copyright|0.3|copyright|copyright(?: c)?(?: by)? (?:19|20)[0-9][0-9]
"""
