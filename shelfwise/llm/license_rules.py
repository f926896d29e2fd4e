"""License signatures, most specific first: label | priority | keyword | pattern.

Patterns read normalised text: lower-case words with one space between. A keyword is a literal part of every match
and holds one of STEMS. Higher priority wins where one detection lies within another; base rules have priority 9.
"""

from __future__ import annotations

#: A text without any of these holds no signature.
STEMS = ("licen", "spdx", "gpl", "creativecommons", "creative commons", "cc by", "cc0", "cc zero", "public domain", "copyright", "all rights reserved",
    "permission is hereby", "redistribution and use", "as is without", "opensource org", "unlicense", "wtfpl", "apache org", "terms of use", "no attribution", "zero clause bsd", "datenlizenz",
    "provided as is", "proprietary and confidential")

BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Names as license texts and lists of identifiers give them.
RULES = r"""
mit | 7 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 6 | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 6 | opensource org licenses mit | (?:https? )?(?:www )?opensource org licenses mit(?: license)?
mit | 5 | spdx license identifier mit | spdx license identifier mit
mit | 5 | mit license | (?:released|licensed|distributed|available|published|provided|made available) under (?:the )?(?:terms of )?(?:the )?mit license
mit | 4 | mit license | (?:the )?mit license(?: mit)?
mit | 4 | mit licence | (?:the )?mit licence
mit | 4 | licensed under mit | licensed under mit
mit | 4 | license mit | license mit
expat | 4 | expat license | (?:the )?expat license
mit-0 | 6 | mit no attribution | mit no attribution(?: license)?
mit-0 | 6 | spdx license identifier mit 0 | spdx license identifier mit 0
x11 | 4 | x11 license | (?:the )?x11 license
isc | 7 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc | 5 | spdx license identifier isc | spdx license identifier isc
isc | 5 | opensource org licenses isc | opensource org licenses isc
isc | 4 | isc licen | (?:the )?isc licen[cs]e
apache-2 | 8 | apache license version 2 0 | licensed under (?:the )?apache license version 2 0
apache-2 | 7 | apache org licenses license 2 0 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2 | 6 | you may not use this file except in compliance with the license | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2 | 6 | spdx license identifier apache 2 0 | spdx license identifier apache 2 0(?: or later)?
apache-2 | 6 | opensource org licenses apache 2 0 | opensource org licenses apache 2 0
apache-2 | 5 | apache software license | apache software license (?:version |v)?2(?: 0)?
apache-2 | 5 | apache license 2 0 | (?:the )?apache license 2 0
apache-2 | 5 | apache license v2 | apache license v2(?: 0)?
apache-2 | 5 | apache 2 0 license | apache 2 0 license
apache-2 | 5 | apache 2 license | apache 2 license
apache-2 | 5 | license apache 2 0 | license apache 2 0
apache-1.1 | 6 | apache software license version 1 1 | (?:the )?apache software license version 1 1
apache-1.1 | 6 | apache license 1 1 | apache license 1 1
apache-1.0 | 6 | apache license version 1 0 | apache license version 1 0
apache-1.0 | 6 | apache org licenses license 1 0 | apache org licenses license 1 0
apache | 2 | apache license | (?:the )?apache license
apache | 2 | apache licence | (?:the )?apache licence
apache | 2 | apache software license | (?:the )?apache software license
bsd-3-clause | 7 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?: [^ ]+){1,110} neither the name of
bsd-2-clause | 5 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 6 | spdx license identifier bsd 3 clause | spdx license identifier bsd 3 clause
bsd-2-clause | 6 | spdx license identifier bsd 2 clause | spdx license identifier bsd 2 clause
bsd-4-clause | 6 | spdx license identifier bsd 4 clause | spdx license identifier bsd 4 clause
0bsd | 6 | spdx license identifier 0bsd | spdx license identifier 0bsd
bsd-3-clause | 6 | opensource org licenses bsd 3 clause | opensource org licenses bsd 3 clause
bsd-2-clause | 6 | opensource org licenses bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause | 5 | bsd 3 clause license | bsd 3 clause license
bsd-3-clause | 5 | 3 clause bsd license | (?:the )?3 clause bsd license
bsd-3-clause | 5 | new bsd license | (?:the )?new bsd license
bsd-3-clause | 5 | modified bsd license | (?:the )?modified bsd license
bsd-3-clause | 5 | revised bsd license | (?:the )?revised bsd license
bsd-2-clause | 5 | bsd 2 clause license | bsd 2 clause license
bsd-2-clause | 5 | 2 clause bsd license | (?:the )?2 clause bsd license
bsd-2-clause | 5 | simplified bsd license | (?:the )?simplified bsd license
bsd-2-clause | 5 | freebsd license | (?:the )?freebsd license
bsd-4-clause | 5 | original bsd license | (?:the )?original bsd license
bsd-4-clause | 5 | 4 clause bsd license | (?:the )?4 clause bsd license
0bsd | 5 | zero clause bsd | (?:bsd )?zero clause bsd(?: license)?
bsd | 2 | bsd license | (?:the |a )?bsd license
bsd | 2 | bsd style license | (?:the |a )?bsd style license
bsd | 2 | bsd type license | (?:the |a )?bsd type license
gpl-3 | 8 | gnu general public license version 3 | (?:the )?gnu general public license version 3(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl-3 | 8 | gnu general public license as published by the free software foundation | gnu general public license as published by the free software foundation (?:either )?version 3
gpl-2 | 8 | gnu general public license as published by the free software foundation | gnu general public license as published by the free software foundation (?:either )?version 2
gpl-2 | 8 | gnu general public license version 2 | (?:the )?gnu general public license version 2(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl-1 | 8 | gnu general public license version 1 | (?:the )?gnu general public license version 1
gpl-3 | 7 | spdx license identifier gpl 3 0 | spdx license identifier gpl 3 0(?: only| or later)?
gpl-2 | 7 | spdx license identifier gpl 2 0 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 | 6 | gnu gpl v3 | (?:the )?gnu gpl v3
gpl-3 | 6 | gpl version 3 | (?:gnu )?gpl version 3(?: 0)?
gpl-3 | 6 | gplv3 | (?:gnu )?gplv3
gpl-3 | 6 | gpl 3 0 | (?:gnu )?gpl 3 0
gpl-3 | 6 | gpl v3 | (?:gnu )?gpl v3
gpl-2 | 6 | gpl version 2 | (?:gnu )?gpl version 2(?: 0)?
gpl-2 | 6 | gplv2 | (?:gnu )?gplv2
gpl-2 | 6 | gpl 2 0 | (?:gnu )?gpl 2 0
gpl-2 | 6 | gpl v2 | (?:gnu )?gpl v2
gpl | 5 | gnu org licenses gpl | (?:www )?gnu org licenses gpl(?: html| txt)?
gpl | 3 | gnu general public licen | (?:the )?gnu general public licen[cs]e
gpl | 3 | gnu general public licence | (?:the )?gnu general public licence
gpl | 3 | gnu gpl | (?:the )?gnu gpl
gpl | 2 | licensed under the gpl | licensed under the gpl
gpl | 2 | under the gpl | under the gpl
lgpl-3 | 8 | gnu lesser general public license version 3 | (?:the )?gnu lesser general public license version 3(?: 0)?(?: or (?:any )?later(?: version)?)?
lgpl-2.1 | 8 | gnu lesser general public license version 2 1 | (?:the )?gnu lesser general public license version 2 1(?: or (?:any )?later(?: version)?)?
lgpl-2 | 8 | gnu library general public license version 2 | (?:the )?gnu library general public license version 2
lgpl-2.1 | 8 | gnu lesser general public license as published by the free software foundation | gnu lesser general public license as published by the free software foundation (?:either )?version 2 1
lgpl-3 | 8 | gnu lesser general public license as published by the free software foundation | gnu lesser general public license as published by the free software foundation (?:either )?version 3
lgpl-3 | 7 | spdx license identifier lgpl 3 0 | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 | 7 | spdx license identifier lgpl 2 1 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 | 6 | lgplv3 | (?:gnu )?lgplv3
lgpl-3 | 6 | lgpl v3 | (?:gnu )?lgpl v3
lgpl-3 | 6 | lgpl 3 0 | (?:gnu )?lgpl 3 0
lgpl-3 | 6 | lgpl version 3 | (?:gnu )?lgpl version 3
lgpl-2.1 | 6 | lgplv2 1 | (?:gnu )?lgplv2 1
lgpl-2.1 | 6 | lgpl 2 1 | (?:gnu )?lgpl 2 1
lgpl-2.1 | 6 | lgpl version 2 1 | (?:gnu )?lgpl version 2 1
lgpl | 5 | gnu org licenses lgpl | (?:www )?gnu org licenses lgpl(?: html| txt)?
lgpl | 4 | gnu lesser general public license | (?:the )?gnu lesser general public license
lgpl | 4 | gnu library general public license | (?:the )?gnu library general public license
lgpl | 4 | gnu lgpl | (?:the )?gnu lgpl
lgpl | 3 | lesser gpl | (?:the )?lesser gpl
agpl-3 | 8 | gnu affero general public license version 3 | (?:the )?gnu affero general public license version 3(?: 0)?(?: or (?:any )?later(?: version)?)?
agpl-3 | 8 | gnu affero general public license as published by the free software foundation | gnu affero general public license as published by the free software foundation (?:either )?version 3
agpl-3 | 7 | spdx license identifier agpl 3 0 | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | 6 | agplv3 | (?:gnu )?agplv3
agpl-3 | 6 | agpl v3 | (?:gnu )?agpl v3
agpl-3 | 6 | agpl 3 0 | (?:gnu )?agpl 3 0
agpl-1 | 7 | affero general public license version 1 | affero general public license version 1
agpl | 4 | affero general public license | (?:the )?(?:gnu )?affero general public license
agpl | 3 | affero gpl | (?:the )?(?:gnu )?affero gpl
gfdl-1.3 | 8 | gnu free documentation license version 1 3 | (?:the )?gnu free documentation license version 1 3
gfdl-1.2 | 8 | gnu free documentation license version 1 2 | (?:the )?gnu free documentation license version 1 2
gfdl-1.1 | 8 | gnu free documentation license version 1 1 | (?:the )?gnu free documentation license version 1 1
gfdl | 4 | gnu free documentation license | (?:the )?gnu free documentation license
mpl-2 | 8 | mozilla public license version 2 0 | (?:the )?mozilla public license version 2 0
mpl-2 | 8 | mozilla public license v 2 0 | (?:the )?mozilla public license v 2 0
mpl-1.1 | 8 | mozilla public license version 1 1 | (?:the )?mozilla public license version 1 1
mpl-2 | 7 | spdx license identifier mpl 2 0 | spdx license identifier mpl 2 0
mpl-2 | 6 | mozilla public license 2 0 | mozilla public license 2 0
mpl-1.1 | 6 | mozilla public license 1 1 | mozilla public license 1 1
mpl | 3 | mozilla public license | (?:the )?mozilla public license
epl-2 | 8 | eclipse public license v 2 0 | (?:the )?eclipse public license v 2 0
epl-2 | 8 | eclipse public license version 2 0 | (?:the )?eclipse public license version 2 0
epl-1 | 8 | eclipse public license v 1 0 | (?:the )?eclipse public license v 1 0
epl-1 | 8 | eclipse public license version 1 0 | (?:the )?eclipse public license version 1 0
epl-2 | 7 | spdx license identifier epl 2 0 | spdx license identifier epl 2 0
epl-1 | 7 | spdx license identifier epl 1 0 | spdx license identifier epl 1 0
epl-2 | 6 | eclipse public license 2 0 | eclipse public license 2 0
epl-1 | 6 | eclipse public license 1 0 | eclipse public license 1 0
epl | 3 | eclipse public license | (?:the )?eclipse public license
edl-1 | 5 | eclipse distribution license | (?:the )?eclipse distribution license(?: v 1 0)?
cddl-1.1 | 7 | common development and distribution license version 1 1 | common development and distribution license version 1 1
cddl-1.0 | 7 | common development and distribution license version 1 0 | common development and distribution license version 1 0
cddl | 4 | common development and distribution license | (?:the )?common development and distribution license
cpl-1 | 5 | common public license | (?:the )?common public license(?: version 1 0| v 1 0)?
ipl-1 | 5 | ibm public license | (?:the )?ibm public license(?: version 1 0)?
eupl-1.2 | 7 | european union public licence v 1 2 | european union public licence v 1 2
eupl-1.1 | 7 | european union public licence v 1 1 | european union public licence v 1 1
eupl-1.2 | 6 | spdx license identifier eupl 1 2 | spdx license identifier eupl 1 2
eupl | 4 | european union public licence | (?:the )?european union public licence
eupl | 4 | european union public license | (?:the )?european union public license
artistic-2 | 7 | artistic license version 2 0 | (?:the )?artistic license version 2 0
artistic-2 | 6 | artistic license 2 0 | (?:the )?artistic license 2 0
artistic-1 | 6 | artistic license 1 0 | (?:the )?artistic license 1 0
artistic | 3 | artistic license | (?:the )?artistic license
clarified-artistic | 6 | clarified artistic license | (?:the )?clarified artistic license
bsl-1.0 | 7 | boost software license version 1 0 | (?:the )?boost software license version 1 0
bsl-1.0 | 6 | spdx license identifier bsl 1 0 | spdx license identifier bsl 1 0
bsl-1.0 | 4 | boost software license | (?:the )?boost software license
busl-1.1 | 7 | business source license 1 1 | business source license 1 1
busl | 4 | business source license | (?:the )?business source license
sspl-1 | 5 | server side public license | (?:the )?server side public license(?: version 1| v1)?
elastic-2 | 6 | elastic license 2 0 | elastic license 2 0
elastic | 4 | elastic license | (?:the )?elastic license
zlib | 6 | this software is provided as is without any express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 5 | spdx license identifier zlib | spdx license identifier zlib
zlib | 4 | zlib license | (?:the )?zlib license
zlib | 4 | zlib libpng license | (?:the )?zlib libpng license
libpng | 4 | libpng license | (?:the )?libpng license
unlicense | 7 | this is free and unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
unlicense | 5 | unlicense org | (?:https? )?(?:www )?unlicense org
unlicense | 4 | the unlicense | the unlicense
wtfpl | 6 | do what the fuck you want to public license | do what the fuck you want to public license
wtfpl | 4 | wtfpl | (?:the )?wtfpl
cc0-1.0 | 7 | cc0 1 0 universal | (?:creative commons )?cc0 1 0 universal(?: public domain dedication)?
cc0-1.0 | 7 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | 6 | spdx license identifier cc0 1 0 | spdx license identifier cc0 1 0
cc0-1.0 | 4 | cc0 | (?:creative commons )?cc0(?: 1 0)?
cc0-1.0 | 4 | creative commons zero | creative commons zero
cc-by-nc-nd-4.0 | 8 | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-sa-4.0 | 8 | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 8 | cc by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-nd-3.0 | 8 | cc by nc nd 3 0 | cc by nc nd 3 0
cc-by-nc-4.0 | 7 | cc by nc 4 0 | cc by nc 4 0
cc-by-nc-3.0 | 7 | cc by nc 3 0 | cc by nc 3 0
cc-by-nc-nd | 7 | cc by nc nd | cc by nc nd
cc-by-nc-sa | 7 | cc by nc sa | cc by nc sa
cc-by-sa-4.0 | 7 | cc by sa 4 0 | cc by sa 4 0
cc-by-sa-3.0 | 7 | cc by sa 3 0 | cc by sa 3 0
cc-by-nd-4.0 | 7 | cc by nd 4 0 | cc by nd 4 0
cc-by-nd-3.0 | 7 | cc by nd 3 0 | cc by nd 3 0
cc-by-4.0 | 6 | cc by 4 0 | cc by 4 0
cc-by-3.0 | 6 | cc by 3 0 | cc by 3 0
cc-by-sa | 6 | cc by sa | cc by sa
cc-by-nd | 6 | cc by nd | cc by nd
cc-by | 3 | cc by license | cc by license
cc-by-nc-sa | 7 | creative commons attribution noncommercial sharealike | creative commons attribution noncommercial sharealike(?: [1-4] 0)?(?: international| unported| generic)?
cc-by-nc-sa | 7 | creative commons attribution non commercial share alike | creative commons attribution non commercial share alike(?: [1-4] 0)?
cc-by-nc-nd | 7 | creative commons attribution noncommercial noderivatives | creative commons attribution noncommercial noderivatives(?: [1-4] 0)?(?: international| unported)?
cc-by-nc-nd | 7 | creative commons attribution noncommercial noderivs | creative commons attribution noncommercial noderivs(?: [1-4] 0)?(?: international| unported)?
cc-by-nc | 6 | creative commons attribution noncommercial | creative commons attribution noncommercial(?: [1-4] 0)?(?: international| unported| generic)?
cc-by-nc | 6 | creative commons attribution non commercial | creative commons attribution non commercial(?: [1-4] 0)?
cc-by-sa | 6 | creative commons attribution sharealike | creative commons attribution sharealike(?: [1-4] 0)?(?: international| unported| generic)?
cc-by-sa | 6 | creative commons attribution share alike | creative commons attribution share alike(?: [1-4] 0)?(?: international| unported| generic)?
cc-by-nd | 6 | creative commons attribution noderivatives | creative commons attribution noderivatives(?: [1-4] 0)?(?: international| unported)?
cc-by-nd | 6 | creative commons attribution noderivs | creative commons attribution noderivs(?: [1-4] 0)?(?: international| unported)?
cc-by-4.0 | 6 | creative commons attribution 4 0 | creative commons attribution 4 0(?: international)?(?: license)?
cc-by-3.0 | 6 | creative commons attribution 3 0 | creative commons attribution 3 0(?: unported)?(?: license)?
cc-by | 3 | creative commons attribution | creative commons attribution(?: license)?
cc-by-nc-nd | 7 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd(?: [1-4] 0)?
cc-by-nc-sa | 7 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa(?: [1-4] 0)?
cc-by-nc | 6 | creativecommons org licenses by nc | creativecommons org licenses by nc(?: [1-4] 0)?
cc-by-sa | 6 | creativecommons org licenses by sa | creativecommons org licenses by sa(?: [1-4] 0)?
cc-by-nd | 6 | creativecommons org licenses by nd | creativecommons org licenses by nd(?: [1-4] 0)?
cc-by | 5 | creativecommons org licenses by | creativecommons org licenses by(?: [1-4] 0)?
cc | 2 | creative commons license | (?:a |the )?creative commons license
cc | 2 | creative commons licence | (?:a |the )?creative commons licence
odbl-1.0 | 6 | open database license | (?:the )?(?:odc )?open database license(?: v1 0| 1 0| odbl)?
odc-by-1.0 | 6 | open data commons attribution license | open data commons attribution license(?: v1 0| 1 0)?
pddl-1.0 | 6 | public domain dedication and license | (?:open data commons )?public domain dedication and license(?: v1 0| 1 0)?
ogl-uk-3.0 | 6 | open government licence v3 | open government licence v3(?: 0)?
ogl-uk | 4 | open government licence | (?:the )?open government licence
dl-de-by-2.0 | 6 | datenlizenz deutschland | datenlizenz deutschland namensnennung(?: version)? 2 0
ofl-1.1 | 6 | sil open font license version 1 1 | (?:the )?sil open font license version 1 1
ofl-1.1 | 5 | spdx license identifier ofl 1 1 | spdx license identifier ofl 1 1
ofl | 4 | open font license | (?:the )?(?:sil )?open font license
psf-2 | 6 | python software foundation license version 2 | python software foundation license version 2
psf | 4 | python software foundation license | (?:the )?python software foundation license
php-3.01 | 6 | php license version 3 01 | (?:the )?php license version 3 01
php | 3 | php license | (?:the )?php license
ruby | 4 | ruby license | (?:the )?ruby license
postgresql | 5 | postgresql licen | (?:the )?postgresql licen[cs]e
ncsa | 5 | university of illinois ncsa open source license | (?:the )?university of illinois ncsa open source license
ncsa | 4 | ncsa open source license | ncsa open source license
ms-pl | 5 | microsoft public license | (?:the )?microsoft public license(?: ms pl)?
ms-rl | 5 | microsoft reciprocal license | (?:the )?microsoft reciprocal license(?: ms rl)?
osl-3.0 | 6 | open software license version 3 0 | (?:the )?open software license version 3 0
osl | 4 | open software license | (?:the )?open software license
afl-3.0 | 6 | academic free license version 3 0 | (?:the )?academic free license version 3 0
afl | 4 | academic free license | (?:the )?academic free license
upl-1.0 | 5 | universal permissive license | (?:the )?universal permissive license(?: version 1 0| v 1 0)?
cecill-2.1 | 6 | cecill 2 1 license | cecill 2 1 license
cecill | 4 | cecill license | (?:the )?cecill license
qpl-1.0 | 5 | q public license | (?:the )?q public license(?: version 1 0)?
vim | 4 | vim license | (?:the )?vim license
beerware | 4 | beer ware license | (?:the )?beer ware license
openssl | 5 | openssl license | (?:the )?openssl license
tcl | 4 | tcl tk license | (?:the )?tcl tk license
ecl-2.0 | 6 | educational community license version 2 0 | (?:the )?educational community license version 2 0
mulanpsl-2 | 6 | mulan psl v2 license | mulan psl v2 license
openrail-m | 5 | openrail m license | (?:the )?(?:bigscience |creativeml )?openrail m license
openrail | 4 | openrail license | (?:the )?openrail license
llama-community | 5 | llama 2 community license | llama 2 community license(?: agreement)?
llama-community | 5 | llama 3 community license | llama 3 community license(?: agreement)?
gemma-terms | 4 | gemma terms of use | gemma terms of use
public-domain | 5 | dedicated to the public domain | (?:hereby )?dedicated to the public domain
public-domain | 5 | released into the public domain | (?:is |are |been )?released into the public domain
public-domain | 4 | placed in the public domain | placed in the public domain
public-domain | 3 | in the public domain | (?:is|are) in the public domain
proprietary | 5 | proprietary and confidential unauthorized copying | proprietary and confidential unauthorized copying(?: of this file)? (?:via any medium )?is strictly prohibited
proprietary | 3 | all rights reserved | all rights reserved
proprietary | 4 | licensed under a commercial license | licensed under a commercial license
proprietary | 4 | end user license agreement | (?:this )?end user license agreement
proprietary | 3 | proprietary license | (?:a |the )?proprietary license
copyright | 1 | copyright c | copyright c (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | 1 | copyright | copyright (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
"""
