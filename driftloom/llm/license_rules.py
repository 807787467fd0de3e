"""The signature rules of the license scan, written one by one.

A line is: label | priority (1 best) | confidence | keyword that every match holds | regular expression over lower-cased
words joined by single spaces. Every repeat is bounded.
"""

from __future__ import annotations

_LINES = r"""
mit | 1 | 1.0 | spdx | spdx licen[cs]e identifier mit
mit-0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier mit 0
apache-1.1 | 1 | 1.0 | spdx | spdx licen[cs]e identifier apache 1 1
apache-2.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier apache 2 0
gpl-1.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier gpl 1 0(?: only| or later)?
gpl-2.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
gpl-3.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
lgpl-2.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 1 | 1.0 | spdx | spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier agpl 3 0(?: only| or later)?
gfdl-1.3 | 1 | 1.0 | spdx | spdx licen[cs]e identifier gfdl 1 3(?: only| or later)?
bsd-0-clause | 1 | 1.0 | spdx | spdx licen[cs]e identifier 0bsd
bsd-2-clause | 1 | 1.0 | spdx | spdx licen[cs]e identifier bsd 2 clause
bsd-3-clause | 1 | 1.0 | spdx | spdx licen[cs]e identifier bsd 3 clause
bsd-4-clause | 1 | 1.0 | spdx | spdx licen[cs]e identifier bsd 4 clause
isc | 1 | 1.0 | spdx | spdx licen[cs]e identifier isc
mpl-1.1 | 1 | 1.0 | spdx | spdx licen[cs]e identifier mpl 1 1
mpl-2.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier mpl 2 0
epl-1.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier epl 1 0
epl-2.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier epl 2 0
cddl-1.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cddl 1 0
cddl-1.1 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cddl 1 1
cpl-1.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cpl 1 0
artistic-2.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier artistic 2 0
bsl-1.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier bsl 1 0
busl-1.1 | 1 | 1.0 | spdx | spdx licen[cs]e identifier busl 1 1
zlib | 1 | 1.0 | spdx | spdx licen[cs]e identifier zlib
unlicense | 1 | 1.0 | spdx | spdx licen[cs]e identifier unlicense
wtfpl | 1 | 1.0 | spdx | spdx licen[cs]e identifier wtfpl
cc0-1.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cc0 1 0
cc-by-3.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cc by 3 0
cc-by-4.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cc by 4 0
cc-by-sa-3.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cc by sa 3 0
cc-by-sa-4.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cc by sa 4 0
cc-by-nc-4.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cc by nc 4 0
cc-by-nd-4.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cc by nd 4 0
cc-by-nc-sa-4.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier cc by nc nd 4 0
ofl-1.1 | 1 | 1.0 | spdx | spdx licen[cs]e identifier ofl 1 1
odbl-1.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier odbl 1 0
postgresql | 1 | 1.0 | spdx | spdx licen[cs]e identifier postgresql
python-2.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier (?:python|psf) 2 0
ruby | 1 | 1.0 | spdx | spdx licen[cs]e identifier ruby
php-3.01 | 1 | 1.0 | spdx | spdx licen[cs]e identifier php 3 01
openssl | 1 | 1.0 | spdx | spdx licen[cs]e identifier openssl
sspl-1.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier sspl 1 0
eupl-1.2 | 1 | 1.0 | spdx | spdx licen[cs]e identifier eupl 1 2
ms-pl | 1 | 1.0 | spdx | spdx licen[cs]e identifier ms pl
upl-1.0 | 1 | 1.0 | spdx | spdx licen[cs]e identifier upl 1 0
mit | 2 | 0.95 | mit | licen[cs]ed (?:under|by) (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)?
mit | 2 | 0.9 | mit | (?:released|distributed|available|provided|published|covered) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)?
mit | 2 | 0.95 | hereby | permission is hereby granted free of charge to any person obtaining a copy
mit | 2 | 0.85 | above copyright | the above copyright notice and this permission notice shall be included
mit | 2 | 0.7 | in no event | in no event shall the authors or copyright holders be liable for any claim
mit | 2 | 0.9 | opensource | opensource org licen[cs]es? mit
mit | 3 | 0.8 | mit | (?:the )?mit (?:software )?licen[cs]e
mit | 3 | 0.8 | expat | (?:the )?expat licen[cs]e
mit | 3 | 0.8 | x11 | (?:the )?x11 licen[cs]e
mit | 3 | 0.85 | licen | licen[cs]e (?:is )?mit
mit-0 | 3 | 0.8 | no attribution | mit no attribution(?: licen[cs]e)?
apache-2.0 | 2 | 0.95 | apache | licen[cs]ed under the apache licen[cs]e version 2 0
apache-2.0 | 2 | 0.9 | apache | apache org licenses license 2 0
apache-2.0 | 2 | 0.9 | in compliance with | you may not use this file except in compliance with the licen[cs]e
apache-2.0 | 2 | 0.8 | as is basis | distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | 2 | 0.85 | opensource | opensource org licen[cs]es? apache 2 0
apache-2.0 | 3 | 0.85 | apache | (?:the )?apache (?:software )?licen[cs]e (?:version )?v?2(?: 0)?
apache-2.0 | 3 | 0.85 | apache | licen[cs]e (?:is )?apache 2(?: 0)?
apache-1.1 | 3 | 0.85 | apache | (?:the )?apache (?:software )?licen[cs]e (?:version )?v?1 1
apache-1.0 | 3 | 0.85 | apache | (?:the )?apache (?:software )?licen[cs]e (?:version )?v?1 0
apache | 4 | 0.7 | apache | (?:the )?apache (?:software )?licen[cs]e
gpl-1.0 | 3 | 0.85 | general public | gnu general public licen[cs]e (?:version |v )?v?1(?: 0)?
gpl-2.0 | 3 | 0.85 | general public | gnu general public licen[cs]e (?:version |v )?v?2(?: 0)?
gpl-3.0 | 3 | 0.85 | general public | gnu general public licen[cs]e (?:version |v )?v?3(?: 0)?
gpl-2.0 | 2 | 0.95 | general public | terms of the gnu general public licen[cs]e (?:version 2 )?as published by the free software foundation (?:either )?version 2
gpl-3.0 | 2 | 0.95 | general public | terms of the gnu general public licen[cs]e (?:version 3 )?as published by the free software foundation (?:either )?version 3
gpl | 2 | 0.8 | general public | you should have received a copy of the gnu general public licen[cs]e
gpl-2.0 | 2 | 0.9 | gnu org | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | 2 | 0.9 | gnu org | gnu org licenses gpl 3 0
gpl | 2 | 0.8 | gnu org | gnu org licenses gpl
gpl-2.0 | 3 | 0.8 | gpl | gplv2(?: only| or later)?
gpl-2.0 | 3 | 0.8 | gpl | gpl v?2(?: 0)?(?: only| or later)?
gpl-3.0 | 3 | 0.8 | gpl | gplv3(?: only| or later)?
gpl-3.0 | 3 | 0.8 | gpl | gpl v?3(?: 0)?(?: only| or later)?
gpl | 4 | 0.7 | general public | (?:gnu )?general public licen[cs]e
gpl | 5 | 0.5 | gpl | gpl licen[cs]ed?
lgpl-2.0 | 3 | 0.85 | library general | (?:gnu )?library general public licen[cs]e (?:version |v )?v?2(?: 0)?
lgpl-2.1 | 3 | 0.85 | lesser general | (?:gnu )?lesser general public licen[cs]e (?:version |v )?v?2 1
lgpl-3.0 | 3 | 0.85 | lesser general | (?:gnu )?lesser general public licen[cs]e (?:version |v )?v?3(?: 0)?
lgpl-2.1 | 2 | 0.9 | gnu org | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | 2 | 0.9 | gnu org | gnu org licenses lgpl 3 0
lgpl | 2 | 0.8 | lesser general | you should have received a copy of the gnu lesser general public licen[cs]e
lgpl | 3 | 0.75 | lesser general | (?:gnu )?lesser general public licen[cs]e
lgpl | 3 | 0.75 | library general | (?:gnu )?library general public licen[cs]e
lgpl-2.1 | 3 | 0.8 | lgpl | lgpl v?2 1(?: only| or later)?
lgpl-3.0 | 3 | 0.8 | lgpl | lgpl v?3(?: 0)?(?: only| or later)?
lgpl-2.1 | 3 | 0.8 | lgpl | lgplv2 1(?: only| or later)?
lgpl-3.0 | 3 | 0.8 | lgpl | lgplv3(?: only| or later)?
agpl-3.0 | 3 | 0.85 | affero general | (?:gnu )?affero general public licen[cs]e (?:version |v )?v?3(?: 0)?
agpl-3.0 | 2 | 0.9 | gnu org | gnu org licenses agpl 3 0
agpl | 2 | 0.8 | affero general | you should have received a copy of the gnu affero general public licen[cs]e
agpl | 3 | 0.75 | affero general | (?:gnu )?affero general public licen[cs]e
agpl-3.0 | 3 | 0.8 | agpl | agpl v?3(?: 0)?(?: only| or later)?
agpl-3.0 | 3 | 0.8 | agpl | agplv3(?: only| or later)?
gfdl-1.3 | 3 | 0.85 | free documentation | gnu free documentation licen[cs]e version 1 3
gfdl | 3 | 0.8 | free documentation | gnu free documentation licen[cs]e
gfdl | 2 | 0.85 | invariant sections | with no invariant sections no front cover texts and no back cover texts a copy of the licen[cs]e
gfdl | 2 | 0.85 | gnu org | gnu org licenses fdl
bsd | 2 | 0.9 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 2 | 0.8 | redistributions of | redistributions of source code must retain the above copyright notice
bsd-3-clause | 2 | 0.85 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 2 | 0.85 | advertising materials | all advertising materials mentioning features or use of this software must display .{0,60}permission
bsd-2-clause | 2 | 0.9 | opensource | opensource org licen[cs]es? bsd 2 clause
bsd-3-clause | 2 | 0.9 | opensource | opensource org licen[cs]es? bsd 3 clause
bsd-2-clause | 3 | 0.85 | clause bsd | (?:2|two) clause bsd(?: licen[cs]e)?
bsd-3-clause | 3 | 0.85 | clause bsd | (?:3|three) clause bsd(?: licen[cs]e)?
bsd-4-clause | 3 | 0.85 | clause bsd | (?:4|four) clause bsd(?: licen[cs]e)?
bsd-2-clause | 3 | 0.85 | bsd 2 | bsd 2 clause(?: licen[cs]e)?
bsd-3-clause | 3 | 0.85 | bsd 3 | bsd 3 clause(?: licen[cs]e)?
bsd-2-clause | 3 | 0.8 | simplified bsd | simplified bsd licen[cs]e
bsd-3-clause | 3 | 0.8 | bsd | (?:new|modified|revised) bsd licen[cs]e
bsd-2-clause | 3 | 0.8 | freebsd | freebsd licen[cs]e
bsd | 4 | 0.7 | bsd | bsd (?:style )?licen[cs]e
isc | 2 | 0.9 | and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | 0.9 | opensource | opensource org licen[cs]es? isc
isc | 3 | 0.85 | isc | (?:the )?isc licen[cs]e
mpl-2.0 | 2 | 0.95 | mozilla | subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-1.1 | 2 | 0.95 | mozilla | subject to the mozilla public licen[cs]e version 1 1
mpl-2.0 | 2 | 0.9 | mozilla | mozilla org (?:en us )?mpl 2 0
mpl-2.0 | 3 | 0.85 | mozilla | mozilla public licen[cs]e (?:version |v )?v?2(?: 0)?
mpl-1.1 | 3 | 0.85 | mozilla | mozilla public licen[cs]e (?:version |v )?v?1 1
mpl | 4 | 0.7 | mozilla | mozilla public licen[cs]e
epl-1.0 | 3 | 0.85 | eclipse | eclipse public licen[cs]e (?:version |v )?v?1(?: 0)?
epl-2.0 | 3 | 0.85 | eclipse | eclipse public licen[cs]e (?:version |v )?v?2(?: 0)?
epl-1.0 | 2 | 0.9 | eclipse | eclipse org legal epl v10
epl-2.0 | 2 | 0.9 | eclipse | eclipse org legal epl (?:2 0|v20)
epl | 4 | 0.7 | eclipse | eclipse public licen[cs]e
cddl-1.0 | 3 | 0.85 | common development | common development and distribution licen[cs]e (?:version |v )?1 0
cddl-1.1 | 3 | 0.85 | common development | common development and distribution licen[cs]e (?:version |v )?1 1
cddl | 4 | 0.75 | common development | common development and distribution licen[cs]e
cpl-1.0 | 3 | 0.85 | common public | common public licen[cs]e(?: version 1 0)?
ipl-1.0 | 3 | 0.85 | ibm public | ibm public licen[cs]e(?: version 1 0)?
artistic-1.0 | 3 | 0.85 | artistic | artistic licen[cs]e (?:version )?1 0
artistic-2.0 | 3 | 0.85 | artistic | artistic licen[cs]e (?:version )?2 0
artistic | 4 | 0.7 | artistic | (?:the )?artistic licen[cs]e
bsl-1.0 | 2 | 0.95 | boost | distributed under the boost software licen[cs]e version 1 0
bsl-1.0 | 2 | 0.9 | any person or organization | permission is hereby granted free of charge to any person or organization obtaining a copy
bsl-1.0 | 2 | 0.9 | boost org | boost org license 1 0
bsl-1.0 | 3 | 0.85 | boost | boost software licen[cs]e
busl-1.1 | 3 | 0.85 | business source | business source licen[cs]e(?: 1 1)?
zlib | 2 | 0.85 | any purpose including | permission is granted to anyone to use this software for any purpose including commercial applications
zlib | 3 | 0.85 | zlib | zlib (?:libpng )?licen[cs]e
libpng | 3 | 0.85 | libpng | libpng licen[cs]e(?: version 2)?
unlicense | 2 | 0.95 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | 0.9 | unlicense org | unlicense org
unlicense | 3 | 0.8 | unlicense | the unlicense
wtfpl | 2 | 0.9 | you want to | do what the [a-z]{1,12} you want to public licen[cs]e
wtfpl | 3 | 0.8 | wtfpl | wtfpl(?: licen[cs]e)?
cc0-1.0 | 2 | 0.9 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | 3 | 0.85 | cc0 | cc0 1 0(?: universal)?
cc0-1.0 | 3 | 0.8 | cc0 | cc0(?: licen[cs]e| dedication| waiver)?
cc-by-4.0 | 2 | 0.9 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | 2 | 0.9 | creativecommons | creativecommons org licenses by 3 0
cc-by-2.0 | 2 | 0.9 | creativecommons | creativecommons org licenses by 2 0
cc-by-sa-4.0 | 2 | 0.9 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 2 | 0.9 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | 2 | 0.9 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | 2 | 0.9 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | 2 | 0.9 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 2 | 0.9 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-4.0 | 3 | 0.85 | cc by | cc by 4 0
cc-by-3.0 | 3 | 0.85 | cc by | cc by 3 0
cc-by-sa-4.0 | 3 | 0.85 | cc by sa | cc by sa 4 0
cc-by-sa-3.0 | 3 | 0.85 | cc by sa | cc by sa 3 0
cc-by-nc-4.0 | 3 | 0.85 | cc by nc | cc by nc 4 0
cc-by-nd-4.0 | 3 | 0.85 | cc by nd | cc by nd 4 0
cc-by-nc-sa-4.0 | 3 | 0.85 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-nd-4.0 | 3 | 0.85 | cc by nc nd | cc by nc nd 4 0
cc-by-4.0 | 3 | 0.85 | commons attribution | creative commons attribution 4 0(?: international)?
cc-by-3.0 | 3 | 0.85 | commons attribution | creative commons attribution 3 0(?: unported)?
cc-by-sa-4.0 | 3 | 0.85 | commons attribution | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 | 3 | 0.85 | commons attribution | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa | 4 | 0.75 | commons attribution | creative commons attribution share ?alike
cc-by-nc | 4 | 0.75 | commons attribution | creative commons attribution non ?commercial
cc-by-nd | 4 | 0.75 | commons attribution | creative commons attribution no ?deriv(?:s|atives)
cc-by | 5 | 0.7 | commons attribution | creative commons attribution
creative-commons | 5 | 0.5 | creative commons | creative commons licen[cs]e
ofl-1.1 | 2 | 0.95 | open font | licen[cs]ed under the sil open font licen[cs]e version 1 1
ofl-1.1 | 2 | 0.9 | sil org | scripts sil org ofl licen[cs]e
ofl-1.1 | 3 | 0.85 | open font | (?:sil )?open font licen[cs]e
odbl-1.0 | 3 | 0.85 | database licen | open (?:data commons open )?database licen[cs]e
odc-by-1.0 | 3 | 0.85 | data commons attribution | open data commons attribution licen[cs]e
pddl-1.0 | 3 | 0.85 | domain dedication | open data commons public domain dedication and licen[cs]e
postgresql | 3 | 0.85 | postgresql | postgresql licen[cs]e
python-2.0 | 3 | 0.85 | python | python (?:software foundation )?licen[cs]e(?: version 2)?
ruby | 3 | 0.8 | ruby | ruby licen[cs]e
php-3.01 | 3 | 0.85 | php | php licen[cs]e version 3 0?1
php | 4 | 0.7 | php | php licen[cs]e
openssl | 3 | 0.85 | openssl | openssl licen[cs]e
sspl-1.0 | 3 | 0.85 | server side | server side public licen[cs]e
elastic-2.0 | 3 | 0.85 | elastic | elastic licen[cs]e (?:version )?2 0
eupl-1.2 | 3 | 0.85 | european union | european union public licen[cs]e (?:version |v )?v?1 2
eupl | 4 | 0.75 | european union | european union public licen[cs]e
ms-pl | 3 | 0.85 | microsoft | microsoft public licen[cs]e
ms-rl | 3 | 0.85 | microsoft | microsoft reciprocal licen[cs]e
upl-1.0 | 3 | 0.85 | universal permissive | universal permissive licen[cs]e
afl-3.0 | 3 | 0.85 | academic free | academic free licen[cs]e(?: version 3 0)?
osl-3.0 | 3 | 0.85 | open software | open software licen[cs]e(?: version 3 0)?
ncsa | 3 | 0.85 | illinois | university of illinois (?:ncsa )?open source licen[cs]e
w3c | 3 | 0.85 | w3c | w3c software (?:notice and )?licen[cs]e
curl | 3 | 0.8 | curl | curl licen[cs]e
vim | 3 | 0.8 | vim | vim licen[cs]e
ijg | 3 | 0.8 | jpeg | independent jpeg group licen[cs]e
public-domain | 3 | 0.8 | public domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | 5 | 0.4 | public domain | (?:in the )?public domain
copyleft | 5 | 0.4 | copyleft | copyleft(?: licen[cs]e)?
proprietary | 4 | 0.6 | proprietary | proprietary (?:and confidential|licen[cs]e|software)
proprietary | 5 | 0.3 | rights reserved | all rights reserved
commercial | 4 | 0.5 | commercial licen | commercial licen[cs]e
no-derivatives | 5 | 0.3 | without permission | no part (?:of this [a-z]{1,20} )?may be reproduced .{0,60}without permission
"""


def _parsed(lines: str) -> list[dict]:
    out = []
    for k, line in enumerate(lines.strip().splitlines()):
        label, priority, sure, keyword, pattern = line.split(" | ")
        out.append({"rule": k, "label": label, "priority": int(priority), "sure": float(sure), "keyword": keyword, "pattern": f"(?<= ){pattern}(?= )"})
    return out


RULES = _parsed(_LINES)
PRIORITIES = sorted({r["priority"] for r in RULES})

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A text that has none of these, in lower case, and matches neither NAMED nor NOTED can match no rule.
STEMS = (
    "licen", "spdx", "gpl", "copyleft", "domain", "permission", "redistribution", "cc0", "commons", "bsd", "reserved", "proprietary",
    "mozilla", "eclipse", "wtfpl", "copyright", "attribution", "warranties",
)
#: Creative Commons' short names.
NAMED = rf"cc{_GAP}by"
#: A notice of the MIT license need not say license.
NOTED = rf"(?:released|distributed|available|provided|published|covered){_GAP}under{_GAP}(?:(?:the|terms|of){_GAP})*mit"
