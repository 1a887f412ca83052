"""License signatures, in order: label | priority | keyword | pattern.

Patterns run over normalised words: lower case, single spaces, so "GPL-2.0+" reads "gpl 2 0". A keyword is a part
of any text that the pattern can match. Priority 3: a license named with its version or by its identifier, or its
own wording; 2: a license named; 1: a hint that some license or claim is near. Earlier rules win ties."""

RULES = r"""
mit | 3 | mit | spdx license identifier mit
mit | 3 | mit | (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | 3 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 3 | opensource | opensource org licenses mit(?: license(?: php)?)?
mit | 2 | mit | mit(?: x11| expat)? licen[cs]e
mit | 2 | expat | expat licen[cs]e
mit | 2 | mit | mit licensed
mit | 2 | mit | licen[cs]e mit
mit-0 | 3 | mit | mit no attribution
mit-0 | 3 | mit | spdx license identifier mit 0
x11 | 2 | x11 | x11 licen[cs]e
isc | 3 | isc | spdx license identifier isc
isc | 3 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | isc licen[cs]e
isc | 2 | isc | licensed under (?:the )?isc
0bsd | 3 | 0bsd | spdx license identifier 0bsd
0bsd | 3 | bsd | zero clause bsd|bsd zero clause
0bsd | 3 | public | free public licen[cs]e 1 0 0
bsd-2-clause | 3 | bsd | spdx license identifier bsd 2 clause
bsd-2-clause | 3 | bsd | (?:simplified|freebsd) bsd licen[cs]e|(?:2|two) clause bsd|bsd (?:2|two) clause
bsd-3-clause | 3 | bsd | spdx license identifier bsd 3 clause
bsd-3-clause | 3 | bsd | (?:new|modified|revised) bsd licen[cs]e|(?:3|three) clause bsd|bsd (?:3|three) clause
bsd-3-clause | 3 | neither | neither the name of .{1,120} nor the names of (?:its|their) contributors may be used to endorse or promote
bsd-3-clause | 3 | opensource | opensource org licenses bsd 3 clause
bsd-4-clause | 3 | bsd | (?:original|old) bsd licen[cs]e|(?:4|four) clause bsd|bsd (?:4|four) clause
bsd-4-clause | 3 | advertising | all advertising materials mentioning features or use of this software must display
bsd | 3 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 2 | bsd | bsd(?: style)? licen[cs]e
bsd | 2 | bsd | bsd licensed|licen[cs]e bsd
apache-1.0 | 3 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 0
apache-1.1 | 3 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 1
apache-1.1 | 3 | apache | spdx license identifier apache 1 1
apache-2 | 3 | apache | spdx license identifier apache 2 0
apache-2 | 3 | apache | apache (?:software )?licen[cs]e (?:version |v |v2 |2 )?2(?: 0)?
apache-2 | 3 | apache | (?:licensed|released|distributed) under (?:the )?apache (?:licen[cs]e )?(?:version )?2(?: 0)?
apache-2 | 3 | apache | apache org licenses license 2 0
apache-2 | 3 | asl | asl 2 0
apache | 2 | apache | apache (?:software )?licen[cs]e
apache | 2 | apache | apache licensed
gpl-1 | 3 | gnu | gnu general public licen[cs]e (?:version |v )1(?: 0)?
gpl-1 | 3 | gpl | spdx license identifier gpl 1 0
gpl-2 | 3 | gpl | spdx license identifier gpl 2 0 only
gpl-2 | 3 | gnu | gnu general public licen[cs]e (?:version |v )?2(?: 0)?
gpl-2 | 3 | gpl | (?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?(?: only)?
gpl-2 | 3 | gplv2 | gplv2(?: only)?
gpl-2 | 3 | franklin | 51 franklin (?:street|st) fifth floor boston
gpl-2-or-later | 3 | gpl | spdx license identifier gpl 2 0 or later
gpl-2-or-later | 3 | either | either version 2 of the licen[cs]e or at your option any later version
gpl-2-or-later | 3 | gnu | gnu general public licen[cs]e version 2 or (?:at your option )?(?:any )?later
gpl-3 | 3 | gpl | spdx license identifier gpl 3 0 only
gpl-3 | 3 | gnu | gnu general public licen[cs]e (?:version |v )?3(?: 0)?
gpl-3 | 3 | gpl | (?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?(?: only)?
gpl-3 | 3 | gplv3 | gplv3(?: only)?
gpl-3-or-later | 3 | gpl | spdx license identifier gpl 3 0 or later
gpl-3-or-later | 3 | either | either version 3 of the licen[cs]e or at your option any later version
gpl-3-or-later | 3 | gnu | gnu general public licen[cs]e version 3 or (?:at your option )?(?:any )?later
gpl | 2 | gnu | gnu general public licen[cs]e
gpl | 2 | gnu | gnu gpl
gpl | 2 | gpl | gpl licensed|licen[cs]e gpl|under the gpl
gpl | 2 | gnu | gnu org licenses gpl
lgpl-2 | 3 | gnu | gnu library general public licen[cs]e(?: (?:version |v )?2(?: 0)?)?
lgpl-2 | 3 | lgpl | lgpl ?(?:version |v ?)?2 0
lgpl-2.1 | 3 | lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | 3 | gnu | gnu lesser general public licen[cs]e (?:version |v )?2 1
lgpl-2.1 | 3 | lgpl | lgpl ?(?:version |v ?)?2 1
lgpl-2.1 | 3 | lgplv2 | lgplv2(?: 1)?
lgpl-3 | 3 | lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 | 3 | gnu | gnu lesser general public licen[cs]e (?:version |v )?3(?: 0)?
lgpl-3 | 3 | lgpl | lgpl ?(?:version |v ?)?3(?: 0)?
lgpl-3 | 3 | lgplv3 | lgplv3
lgpl | 2 | gnu | gnu lesser general public licen[cs]e
lgpl | 2 | lesser | lesser general public licen[cs]e
lgpl | 2 | lgpl | (?:gnu )?lgpl
agpl-3 | 3 | agpl | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | 3 | affero | gnu affero general public licen[cs]e (?:version |v )?3(?: 0)?
agpl-3 | 3 | agpl | agpl ?(?:version |v ?)?3(?: 0)?
agpl-3 | 3 | agplv3 | agplv3
agpl | 2 | affero | (?:gnu )?affero general public licen[cs]e
agpl | 2 | agpl | (?:gnu )?agpl
gfdl | 3 | documentation | gnu free documentation licen[cs]e (?:version |v )?1 [123]
gfdl | 2 | documentation | gnu free documentation licen[cs]e
gfdl | 2 | gfdl | gfdl
mpl-1.0 | 3 | mozilla | mozilla public licen[cs]e (?:version |v )?1 0
mpl-1.1 | 3 | mozilla | mozilla public licen[cs]e (?:version |v )?1 1
mpl-1.1 | 3 | mpl | mpl ?(?:v ?)?1 1
mpl-2.0 | 3 | mpl | spdx license identifier mpl 2 0
mpl-2.0 | 3 | mozilla | mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mpl-2.0 | 3 | mpl | mpl ?(?:v ?)?2(?: 0)?
mpl-2.0 | 3 | mozilla | mozilla org mpl 2 0
mpl | 2 | mozilla | mozilla public licen[cs]e
npl | 2 | netscape | netscape public licen[cs]e
epl-1.0 | 3 | eclipse | eclipse public licen[cs]e (?:version |v )?1 0
epl-1.0 | 3 | epl | epl (?:v )?1 0
epl-2.0 | 3 | eclipse | eclipse public licen[cs]e (?:version |v )?2 0
epl-2.0 | 3 | epl | epl (?:v )?2 0
epl | 2 | eclipse | eclipse public licen[cs]e
edl-1.0 | 2 | eclipse | eclipse distribution licen[cs]e
cddl-1.0 | 3 | cddl | cddl (?:v )?1 0
cddl-1.1 | 3 | cddl | cddl (?:v )?1 1
cddl | 2 | common | common development and distribution licen[cs]e
cddl | 2 | cddl | cddl
cpl-1.0 | 2 | common | common public licen[cs]e
ipl-1.0 | 2 | ibm | ibm public licen[cs]e
apsl | 2 | apple | apple public source licen[cs]e
eupl-1.1 | 3 | eupl | eupl (?:v )?1 1
eupl-1.2 | 3 | eupl | eupl (?:v )?1 2
eupl | 2 | european | european union public licen[cs]e
eupl | 2 | eupl | eupl
cecill-2.1 | 3 | cecill | cecill (?:v )?2 1
cecill-b | 3 | cecill | cecill b
cecill-c | 3 | cecill | cecill c
cecill | 2 | cecill | cecill
cc0 | 3 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0 | 3 | creativecommons | creativecommons org publicdomain zero 1 0
cc0 | 3 | creative | creative commons zero
cc-by-4.0 | 3 | cc | cc by 4 0
cc-by-4.0 | 3 | creative | creative commons attribution 4 0(?: international)?
cc-by-4.0 | 3 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | 3 | cc | cc by 3 0
cc-by-3.0 | 3 | creative | creative commons attribution 3 0(?: unported)?
cc-by-3.0 | 3 | creativecommons | creativecommons org licenses by 3 0
cc-by-2.0 | 3 | cc | cc by 2 [05]
cc-by-2.0 | 3 | creativecommons | creativecommons org licenses by 2 [05]
cc-by | 2 | cc | cc by
cc-by | 2 | creative | creative commons attribution
cc-by-sa-4.0 | 3 | cc | cc by sa 4 0
cc-by-sa-4.0 | 3 | creative | creative commons attribution share ?alike 4 0
cc-by-sa-4.0 | 3 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 3 | cc | cc by sa 3 0
cc-by-sa-3.0 | 3 | creative | creative commons attribution share ?alike 3 0
cc-by-sa-3.0 | 3 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-sa | 3 | cc | cc by sa
cc-by-sa | 3 | creative | creative commons attribution share ?alike
cc-by-nd | 3 | cc | cc by nd(?: [234] [05])?
cc-by-nd | 3 | creative | creative commons attribution no ?deriv(?:ative|atives|s)?
cc-by-nd | 3 | creativecommons | creativecommons org licenses by nd
cc-by-nc-4.0 | 3 | cc | cc by nc 4 0
cc-by-nc-4.0 | 3 | creative | creative commons attribution non ?commercial 4 0
cc-by-nc-4.0 | 3 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | 3 | cc | cc by nc 3 0
cc-by-nc-3.0 | 3 | creativecommons | creativecommons org licenses by nc 3 0
cc-by-nc | 3 | cc | cc by nc
cc-by-nc | 3 | creative | creative commons attribution non ?commercial
cc-by-nc-sa-4.0 | 3 | cc | cc by nc sa 4 0
cc-by-nc-sa-4.0 | 3 | creative | creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-sa-4.0 | 3 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa | 3 | cc | cc by nc sa
cc-by-nc-sa | 3 | creative | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd-4.0 | 3 | cc | cc by nc nd 4 0
cc-by-nc-nd-4.0 | 3 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd | 3 | cc | cc by nc nd
cc-by-nc-nd | 3 | creative | creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)?
cc | 1 | creative | creative commons(?: licen[cs]e)?
artistic-1.0 | 3 | artistic | artistic licen[cs]e (?:version |v )?1 0
artistic-2.0 | 3 | artistic | artistic licen[cs]e (?:version |v )?2 0
artistic | 2 | artistic | artistic licen[cs]e
perl | 2 | perl | same terms as perl(?: itself)?
python-2.0 | 3 | python | python software foundation licen[cs]e(?: version 2)?
python-2.0 | 3 | psf | psf licen[cs]e(?: version 2)?
python-2.0 | 2 | python | python licen[cs]e
php-3.01 | 3 | php | php licen[cs]e (?:version |v )?3 01
php | 2 | php | php licen[cs]e
ruby | 2 | ruby | ruby licen[cs]e|same terms as ruby
zlib | 3 | zlib | spdx license identifier zlib
zlib | 3 | warranty | provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 2 | zlib | zlib(?: libpng)? licen[cs]e
libpng | 2 | libpng | libpng licen[cs]e
bsl-1.0 | 3 | boost | boost software licen[cs]e(?: (?:version |v )?1 0)?
bsl-1.0 | 3 | boost | boost org license 1 0 txt
busl-1.1 | 3 | business | business source licen[cs]e(?: 1 1)?
busl-1.1 | 3 | busl | spdx license identifier busl 1 1
sspl-1.0 | 3 | server | server side public licen[cs]e
sspl-1.0 | 2 | sspl | sspl
elastic-2.0 | 3 | elastic | elastic licen[cs]e (?:version |v )?2(?: 0)?
elastic-2.0 | 2 | elastic | elastic licen[cs]e
commons-clause | 2 | commons | commons clause
unlicense | 3 | unlicense | spdx license identifier unlicense|unlicense org
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | unlicense
wtfpl | 3 | want | do what the f\w+ you want to public licen[cs]e
wtfpl | 2 | wtfpl | wtfpl
openssl | 2 | openssl | openssl licen[cs]e
ssleay | 2 | ssleay | (?:original )?ssleay licen[cs]e
ofl-1.1 | 3 | sil | sil open font licen[cs]e(?: (?:version |v )?1 1)?
ofl-1.1 | 3 | ofl | ofl 1 1
ofl | 2 | font | open font licen[cs]e
odbl-1.0 | 3 | odbl | odbl(?: 1 0)?
odbl-1.0 | 3 | database | open (?:data commons open )?database licen[cs]e
odc-by-1.0 | 3 | commons | open data commons attribution licen[cs]e
pddl-1.0 | 3 | dedication | (?:odc )?public domain dedication and licen[cs]e
cdla-permissive | 3 | cdla | cdla permissive(?: [12] 0)?
cdla-sharing | 3 | cdla | cdla sharing(?: 1 0)?
openrail | 3 | openrail | (?:creativeml |bigscience )?openrail(?: m)?
rail | 2 | responsible | responsible ai licen[cs]e
llama | 2 | llama | llama(?: [23](?: [0-9])?)? community licen[cs]e
gemma | 2 | gemma | gemma terms of use
ms-pl | 2 | microsoft | microsoft public licen[cs]e
ms-rl | 2 | microsoft | microsoft reciprocal licen[cs]e
ncsa | 2 | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
postgresql | 2 | postgresql | postgresql licen[cs]e
vim | 2 | vim | vim licen[cs]e
w3c | 2 | w3c | w3c(?: software)?(?: notice and)? licen[cs]e
tcl | 2 | tcl | tcl tk licen[cs]e
curl | 2 | curl | curl licen[cs]e
afl-3.0 | 3 | academic | academic free licen[cs]e(?: (?:version |v )?3 0)?
osl-3.0 | 3 | open | open software licen[cs]e(?: (?:version |v )?3 0)?
upl-1.0 | 2 | universal | universal permissive licen[cs]e
mulan-2.0 | 3 | mulan | mulan (?:psl|permissive software licen[cs]e)(?: v2| 2)?
hippocratic | 2 | hippocratic | hippocratic licen[cs]e
json | 3 | evil | the software shall be used for good not evil
beerware | 2 | beer | beer ?ware licen[cs]e
public-domain | 3 | domain | (?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain | 2 | domain | public domain
ogl-uk-3.0 | 2 | government | open government licen[cs]e(?: v3 0)?
proprietary | 3 | proprietary | proprietary and confidential
proprietary | 2 | proprietary | proprietary (?:software )?licen[cs]e
proprietary | 2 | permission | may not be (?:reproduced|copied|redistributed|distributed) (?:in any form )?without (?:prior |express )?(?:written )?permission
all-rights-reserved | 2 | reserved | all rights reserved
noncommercial | 1 | commercial | for non ?commercial use only
research-only | 1 | research | for research (?:purposes|use) only
eula | 2 | user | end user licen[cs]e agreement
eula | 2 | eula | eula
copyright | 1 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
license-hint | 1 | licen | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?(?:[^ ]+ ){0,6}licen[cs]e
license-hint | 1 | licen | see (?:the )?licen[cs]e(?: file)?(?: for (?:more )?details)?
license-hint | 1 | spdx | spdx license identifier [^ ]+
"""


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) in order."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = line.split(" | ", 3)
        out.append((label.strip(), int(priority), keyword.strip(), pattern))
    return out
