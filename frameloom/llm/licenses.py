"""License detection by ordered signature rules, in DataFrame functions alone.

A text becomes its lower-cased words, joined by single spaces. Rules are
regular expressions over that form, written by hand; each has a keyword or two,
mostly the license's own token, and a rule is tried only on texts with words that
begin so. A detection is an interval of words. One that lies inside
another is suppressed if the other's rule has higher priority, or equal priority
and a longer interval (or, of equal intervals, an earlier rule). Base rules are
reported always.

Detections are sorted by where they begin, longer and higher ones first, so that
whatever suppresses one comes before it, and one sweep over them, which knows the
furthest end so far for each priority, settles all.

Defined cases: a null or empty text has no words and no detections. Repeated
rows each get a row, ids are not looked at. All work on a document happens in its
own row, in steps of the order of its words and detections (but for sorting), so
there is no shuffle, and no document has to meet another. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.shared import LOWER, UPPER

#: What separates words (ASCII but for letters and digits), and
#: the base phrases with their labels.
GAPS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Rules in order: keywords, priority (8: text of a license, 7: identifier, 6: a
#: statement, 5 and 4: a name with and without version, less: weaker hints),
#: confidence, label, pattern over lower-case words. A match holds, for
#: each keyword, a word that begins with it, or that is it if a full stop follows;
#: the last one is the rarest.
RULES = """
permission | 8 | 1.0 | mit | permission is hereby granted free of charge to any person obtaining a copy of this software
mit+licen | 7 | 1.0 | mit | spdx license identifier mit
mit+licen | 6 | 0.95 | mit | licen[sc]ed under (?:the )?(?:terms of )?(?:the )?mit(?: expat)?(?: licen[sc]e)?
mit+licen | 6 | 0.95 | mit | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit+licen | 5 | 0.9 | mit | mit licen[sc]ed?
mit+licen | 5 | 0.9 | mit | the mit license mit
mit+licen | 4 | 0.8 | mit | licen[sc]e mit
mit+licen | 7 | 1.0 | mit-0 | mit (?:0|no attribution) licen[sc]e
expat+licen | 5 | 0.9 | mit | expat licen[sc]e
expat+licen | 6 | 0.95 | mit | licen[sc]ed under (?:the )?expat
opensource+licen | 4 | 0.7 | mit | opensource org licenses mit(?: license)?(?: php)?
apache+licen | 8 | 1.0 | apache-2 | licensed under the apache license version 2 0 the license you may not use this file except in compliance
apache+licen | 7 | 1.0 | apache-2 | spdx license identifier apache 2 0
apache+licen | 6 | 0.95 | apache-2 | licen[sc]ed under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[sc]e)?(?: version)? v?2(?: 0)?
apache | 6 | 0.95 | apache-2 | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: licen[sc]e)?(?: version)? v?2(?: 0)?
apache+licen | 5 | 0.9 | apache-2 | apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)?
apache | 4 | 0.8 | apache-2 | apache v?2(?: 0)?(?: licen[sc]e)?
apache+licen | 4 | 0.8 | apache-2 | apache org licenses license 2 0(?: txt)?
apache+licen | 6 | 0.95 | apache-1.1 | licen[sc]ed under (?:the )?apache(?: software)? licen[sc]e(?: version)? 1 1
apache+licen | 5 | 0.9 | apache-1.1 | apache(?: software)? licen[sc]e(?: version)? 1 1
apache+licen | 4 | 0.85 | apache-1 | apache(?: software)? licen[sc]e(?: version)? 1 0
apache+licen | 2 | 0.5 | apache | apache(?: software)? licen[sc]e
apache+licen | 3 | 0.6 | apache | licen[sc]ed under (?:the )?apache(?: software)?(?: licen[sc]e)?
asl. | 4 | 0.8 | apache-2 | asl(?: version)? v?2(?: 0)?
redistribution | 8 | 1.0 | bsd | redistribution and use in source and binary forms with or without modification are permitted provided
redistribution | 5 | 0.8 | bsd | redistribution and use in source and binary forms
redistributions | 4 | 0.7 | bsd | redistributions of source code must retain the above copyright notice
redistributions | 4 | 0.7 | bsd | redistributions in binary form must reproduce the above copyright notice
endorse | 8 | 0.95 | bsd-3-clause | may be used to endorse or promote products derived from this software without specific prior written permission
advertising | 8 | 0.95 | bsd-4-clause | all advertising materials mentioning features or use of this software must display
bsd+licen | 7 | 1.0 | bsd-2-clause | spdx license identifier bsd 2 clause
bsd+licen | 7 | 1.0 | bsd-3-clause | spdx license identifier bsd 3 clause
bsd. | 7 | 1.0 | bsd-0-clause | (?:spdx license identifier )?(?:bsd 0 clause|zero clause bsd)
0bsd | 7 | 1.0 | bsd-0-clause | (?:spdx license identifier )?0bsd
bsd+licen | 6 | 0.95 | bsd-2-clause | licen[sc]ed under (?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?
bsd+licen | 6 | 0.95 | bsd-3-clause | licen[sc]ed under (?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd. | 5 | 0.9 | bsd-2-clause | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[sc]e)?
bsd. | 5 | 0.9 | bsd-3-clause | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd. | 5 | 0.9 | bsd-4-clause | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[sc]e)?
bsd+licen | 4 | 0.75 | bsd | licen[sc]ed under (?:the )?(?:terms of )?(?:the )?(?:a )?bsd(?: style)?(?: licen[sc]e)?
bsd+licen | 3 | 0.6 | bsd | bsd(?: style| like)? licen[sc]ed?
freebsd+licen | 5 | 0.85 | bsd-2-clause | freebsd licen[sc]e
isc+licen | 7 | 1.0 | isc | spdx license identifier isc
isc+licen | 6 | 0.95 | isc | licen[sc]ed under (?:the )?isc(?: licen[sc]e)?
isc+licen | 5 | 0.9 | isc | isc licen[sc]ed?
purpose | 8 | 0.9 | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
consortium+licen | 4 | 0.7 | isc | internet (?:systems|software) consortium licen[sc]e
gpl+licen | 7 | 1.0 | gpl-2 | spdx license identifier gpl 2 0(?: only)?
gpl+licen | 7 | 1.0 | gpl-2-or-later | spdx license identifier gpl 2 0 or later
gpl+licen | 7 | 1.0 | gpl-3 | spdx license identifier gpl 3 0(?: only)?
gpl+licen | 7 | 1.0 | gpl-3-or-later | spdx license identifier gpl 3 0 or later
gpl+licen | 6 | 0.95 | gpl-2 | licen[sc]ed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: version)? v?2(?: 0)?
gpl+licen | 6 | 0.95 | gpl-3 | licen[sc]ed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: version)? v?3(?: 0)?
gpl. | 5 | 0.9 | gpl-2 | (?:gnu )?gpl(?: version)? v?2(?: 0)?
gpl. | 5 | 0.9 | gpl-3 | (?:gnu )?gpl(?: version)? v?3(?: 0)?
gpl. | 3 | 0.7 | gpl | (?:gnu gpl|gpl licen[sc]ed?)
gpl+licen | 4 | 0.75 | gpl | licen[sc]ed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gplv2 | 5 | 0.9 | gpl-2 | (?:gnu )?gplv2
gplv2 | 6 | 0.95 | gpl-2-or-later | (?:gnu )?gplv2 or (?:any )?later
gplv3 | 5 | 0.9 | gpl-3 | (?:gnu )?gplv3
gplv3 | 6 | 0.95 | gpl-3-or-later | (?:gnu )?gplv3 or (?:any )?later
gnu+licen | 8 | 1.0 | gpl-2-or-later | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gnu+licen | 8 | 1.0 | gpl-3-or-later | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gnu+licen | 6 | 0.95 | gpl-1 | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: version)? v?1(?: 0)?
gnu+licen | 6 | 0.95 | gpl-2 | (?:licen[sc]ed under (?:the )?)?gnu general public licen[sc]e(?: as published by the free software foundation)?(?: version)? v?2(?: 0)?
gnu+licen | 6 | 0.95 | gpl-3 | (?:licen[sc]ed under (?:the )?)?gnu general public licen[sc]e(?: as published by the free software foundation)?(?: version)? v?3(?: 0)?
gnu+licen | 4 | 0.75 | gpl | (?:licen[sc]ed under (?:the )?)?gnu general public licen[sc]e(?! (?:version )?v?[123])
gnu. | 5 | 0.85 | gpl-classpath | gnu (?:general public licen[sc]e|gpl)(?: version 2)? with (?:the )?classpath exception
gnu+licen | 8 | 1.0 | lgpl-2.1-or-later | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
gnu+licen | 6 | 0.95 | lgpl-2 | gnu library general public licen[sc]e(?: version)? v?2(?: 0)?
gnu+licen | 6 | 0.95 | lgpl-2.1 | gnu lesser general public licen[sc]e(?: version)? v?2 1
gnu+licen | 6 | 0.95 | lgpl-3 | gnu lesser general public licen[sc]e(?: version)? v?3(?: 0)?
gnu+licen | 4 | 0.75 | lgpl | gnu (?:lesser|library) general public licen[sc]e
gnu+licen | 6 | 0.95 | agpl-3 | gnu affero general public licen[sc]e(?: version)? v?3(?: 0)?
gnu+licen | 4 | 0.8 | agpl | gnu affero general public licen[sc]e
gnu+licen | 6 | 0.95 | gfdl-1.1 | gnu free documentation licen[sc]e(?: version)? 1 1
gnu+licen | 6 | 0.95 | gfdl-1.2 | gnu free documentation licen[sc]e(?: version)? 1 2
gnu+licen | 6 | 0.95 | gfdl-1.3 | gnu free documentation licen[sc]e(?: version)? 1 3
gnu+licen | 4 | 0.8 | gfdl | gnu free documentation licen[sc]e
gnu+licen | 4 | 0.7 | gnu-all-permissive | gnu all permissive licen[sc]e
gnu+licen | 3 | 0.5 | gpl | gnu org licenses(?: gpl)?
gfdl. | 5 | 0.85 | gfdl | gfdl(?: 1 [123])?
lgpl+licen | 7 | 1.0 | lgpl-2.1 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl+licen | 7 | 1.0 | lgpl-3 | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl+licen | 6 | 0.95 | lgpl-2.1 | licen[sc]ed under (?:the )?(?:gnu )?lgpl(?: version)? v?2 1
lgpl+licen | 6 | 0.95 | lgpl-3 | licen[sc]ed under (?:the )?(?:gnu )?lgpl(?: version)? v?3(?: 0)?
lgpl. | 5 | 0.9 | lgpl-2.1 | (?:gnu )?lgpl(?: version)? v?2 1
lgpl. | 5 | 0.9 | lgpl-3 | (?:gnu )?lgpl(?: version)? v?3(?: 0)?
lgpl. | 3 | 0.7 | lgpl | (?:gnu lgpl|lgpl licen[sc]ed?|licen[sc]ed under (?:the )?lgpl)
lgplv2 | 5 | 0.9 | lgpl-2.1 | (?:gnu )?lgplv2(?: 1)?
lgplv3 | 5 | 0.9 | lgpl-3 | (?:gnu )?lgplv3
agpl+licen | 7 | 1.0 | agpl-3 | spdx license identifier agpl 3 0(?: only| or later)?
agpl+licen | 6 | 0.95 | agpl-3 | licen[sc]ed under (?:the )?(?:gnu )?agpl(?: version)? v?3(?: 0)?
agpl. | 5 | 0.9 | agpl-3 | (?:gnu )?agpl(?: version)? v?3(?: 0)?
agpl. | 3 | 0.7 | agpl | (?:gnu agpl|agpl licen[sc]ed?)
agplv3 | 5 | 0.9 | agpl-3 | (?:gnu )?agplv3
mozilla+licen | 8 | 1.0 | mpl-2 | this source code form is subject to the terms of the mozilla public license v 2 0
mozilla+licen | 6 | 0.95 | mpl-2 | (?:licen[sc]ed under (?:the )?)?mozilla public licen[sc]e(?: version)? v?(?: )?2(?: 0)?
mozilla+licen | 6 | 0.95 | mpl-1.1 | (?:licen[sc]ed under (?:the )?)?mozilla public licen[sc]e(?: version)? v?(?: )?1 1
mozilla+licen | 5 | 0.9 | mpl-1 | mozilla public licen[sc]e(?: version)? v?(?: )?1 0
mozilla+licen | 3 | 0.7 | mpl | mozilla public licen[sc]e
mpl+licen | 7 | 1.0 | mpl-2 | spdx license identifier mpl 2 0
mpl. | 5 | 0.9 | mpl-2 | (?:licen[sc]ed under (?:the )?)?mpl(?: version)? v?2(?: 0)?
mpl. | 5 | 0.9 | mpl-1.1 | (?:licen[sc]ed under (?:the )?)?mpl(?: version)? v?1 1
eclipse+licen | 6 | 0.95 | epl-2 | (?:licen[sc]ed under (?:the )?)?eclipse public licen[sc]e(?: version)? v?(?: )?2(?: 0)?
eclipse+licen | 6 | 0.95 | epl-1 | (?:licen[sc]ed under (?:the )?)?eclipse public licen[sc]e(?: version)? v?(?: )?1(?: 0)?
eclipse+licen | 3 | 0.7 | epl | eclipse public licen[sc]e
eclipse+licen | 5 | 0.9 | edl-1 | eclipse distribution licen[sc]e(?: version)?(?: v)?(?: 1 0)?
epl+licen | 7 | 1.0 | epl-2 | spdx license identifier epl 2 0
epl+licen | 7 | 1.0 | epl-1 | spdx license identifier epl 1 0
epl. | 4 | 0.85 | epl-2 | epl(?: version)? v?2(?: 0)?
epl. | 4 | 0.85 | epl-1 | epl(?: version)? v?1(?: 0)?
cddl | 5 | 0.9 | cddl-1 | cddl(?: version)?(?: 1 0)?
cddl | 6 | 0.95 | cddl-1.1 | cddl(?: version)? 1 1
common+licen | 5 | 0.9 | cddl-1 | common development and distribution licen[sc]e(?: cddl)?(?: version)?(?: 1 0)?
common+licen | 5 | 0.9 | cpl-1 | common public licen[sc]e(?: version)?(?: 1 0)?
common+licen | 5 | 0.9 | cpal-1 | common public attribution licen[sc]e(?: version)?(?: 1 0)?
zlib+licen | 5 | 0.9 | zlib | zlib(?: libpng)? licen[sc]e
zlib+licen | 6 | 0.95 | zlib | licen[sc]ed under (?:the )?zlib(?: libpng)?(?: licen[sc]e)?
zlib+licen | 7 | 1.0 | zlib | spdx license identifier zlib
misrepresented | 8 | 0.95 | zlib | the origin of this software must not be misrepresented
libpng+licen | 5 | 0.9 | libpng | libpng licen[sc]e
boost+licen | 8 | 1.0 | boost-1 | distributed under the boost software license version 1 0
boost+licen | 6 | 0.95 | boost-1 | (?:licen[sc]ed under (?:the )?)?boost software licen[sc]e(?: version)?(?: 1 0)?
bsl. | 7 | 1.0 | boost-1 | (?:spdx license identifier )?bsl 1 0
bsl. | 6 | 0.95 | bsl-1.1 | (?:business source licen[sc]e )?bsl 1 1
business+licen | 6 | 0.95 | bsl-1.1 | business source licen[sc]e(?: version)?(?: 1 1)?
busl | 7 | 1.0 | bsl-1.1 | (?:spdx license identifier )?busl 1 1
server+licen | 6 | 0.95 | sspl-1 | server side public licen[sc]e(?: version)?(?: v)?(?: 1(?: 0)?)?
sspl | 5 | 0.9 | sspl-1 | sspl(?: version)?(?: v)?(?: 1(?: 0)?)?
elastic+licen | 5 | 0.9 | elastic-2 | elastic licen[sc]e(?: version)?(?: v)?(?: 2(?: 0)?)?
confluent+licen | 5 | 0.9 | confluent | confluent community licen[sc]e(?: agreement)?
redis+licen | 5 | 0.9 | rsal | redis source available licen[sc]e
polyform+licen | 6 | 0.95 | polyform-noncommercial | polyform noncommercial licen[sc]e(?: 1 0 0)?
polyform+licen | 6 | 0.95 | polyform-shield | polyform shield licen[sc]e(?: 1 0 0)?
polyform+licen | 6 | 0.95 | polyform-small-business | polyform small business licen[sc]e(?: 1 0 0)?
commons | 4 | 0.8 | commons-clause | commons clause(?: licen[sc]e)?(?: condition)?
artistic+licen | 6 | 0.95 | artistic-2 | (?:the )?artistic licen[sc]e(?: version)? 2(?: 0)?
artistic+licen | 5 | 0.9 | artistic-1 | (?:the )?artistic licen[sc]e(?: version)? 1(?: 0)?
artistic+licen | 3 | 0.7 | artistic | (?:the )?artistic licen[sc]e
perl. | 5 | 0.85 | perl | under the same terms as perl(?: itself)?
ruby+licen | 4 | 0.8 | ruby | (?:the )?ruby licen[sc]e
python+licen | 6 | 0.95 | python-2 | python software foundation licen[sc]e(?: version)?(?: 2)?
python+licen | 4 | 0.8 | python-2 | python licen[sc]e
psf. | 5 | 0.9 | python-2 | psf(?: 2 0| licen[sc]e)
php+licen | 6 | 0.95 | php-3 | php licen[sc]e(?: version)? 3 0(?:1| 1)?
php+licen | 3 | 0.7 | php | php licen[sc]e
postgresql+licen | 5 | 0.9 | postgresql | postgresql licen[sc]e
tcl+licen | 4 | 0.8 | tcl | tcl(?: tk)? licen[sc]e
openssl+licen | 5 | 0.9 | openssl | openssl(?: toolkit)? licen[sc]e
ssleay+licen | 5 | 0.9 | ssleay | (?:original )?ssleay licen[sc]e
curl+licen | 4 | 0.8 | curl | curl licen[sc]e
vim+licen | 4 | 0.8 | vim | vim licen[sc]e
x11+licen | 5 | 0.9 | x11 | (?:mit )?x11 licen[sc]e
ncsa+licen | 5 | 0.9 | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
w3c+licen | 5 | 0.9 | w3c | w3c(?: software)?(?: notice and)?(?: document)? licen[sc]e
unicode+licen | 5 | 0.9 | unicode | unicode(?: data files and software)? licen[sc]e(?: agreement)?(?: v3)?
qpl. | 4 | 0.8 | qpl-1 | qpl(?: 1 0)?
q+licen | 4 | 0.8 | qpl-1 | q public licen[sc]e(?: qpl)?(?: version)?(?: 1 0)?
ibm+licen | 5 | 0.9 | ipl-1 | ibm public licen[sc]e(?: version)?(?: 1 0)?
intel+licen | 4 | 0.8 | intel | intel open source licen[sc]e
sun+licen | 4 | 0.8 | sissl | sun industry standards source licen[sc]e
apple+licen | 5 | 0.9 | apsl-2 | apple public source licen[sc]e(?: version)?(?: 2 0)?
microsoft+licen | 5 | 0.9 | ms-pl | microsoft public licen[sc]e(?: ms pl)?
microsoft+licen | 5 | 0.9 | ms-rl | microsoft reciprocal licen[sc]e(?: ms rl)?
academic+licen | 5 | 0.9 | afl-3 | academic free licen[sc]e(?: version)?(?: 3 0)?
open+licen | 5 | 0.9 | osl-3 | open software licen[sc]e(?: version)?(?: 3 0)?
open+licen | 5 | 0.9 | odbl | (?:open data commons )?open database licen[sc]e(?: odbl)?(?: v?1 0)?
open+licen | 5 | 0.9 | odc-by | open data commons attribution licen[sc]e(?: v?1 0)?
open+licen | 5 | 0.9 | pddl | open data commons public domain dedication and licen[sc]e
open+licen | 5 | 0.9 | ogl-uk-3 | open government licen[sc]e(?: version)?(?: v)?(?: ?3(?: 0)?)?
open+licen | 5 | 0.9 | opl-1 | open publication licen[sc]e(?: version)?(?: v)?(?: 1 0)?
open | 5 | 0.9 | open-rail | open rail(?: m)?(?: licen[sc]e)?
openrail | 5 | 0.9 | open-rail | (?:bigscience |creativeml )?openrail(?: m)?(?: licen[sc]e)?
odbl | 5 | 0.9 | odbl | odbl(?: v?1 0)?
pddl | 5 | 0.9 | pddl | pddl(?: v?1 0)?
etalab | 5 | 0.9 | etalab-2 | (?:licence ouverte )?etalab(?: 2 0)?
font+licen | 6 | 0.95 | ofl-1.1 | sil open font licen[sc]e(?: version)?(?: 1 1)?
ofl. | 5 | 0.9 | ofl-1.1 | (?:sil )?ofl(?: 1 1)?
bitstream | 4 | 0.8 | bitstream-vera | bitstream vera fonts copyright
european+licen | 6 | 0.95 | eupl-1.2 | european union public licen[sc]e(?: eupl)?(?: version)?(?: v)?(?: ?1 2)?
eupl | 5 | 0.9 | eupl-1.2 | eupl(?: v)?(?: ?1 2)?
eupl | 6 | 0.9 | eupl-1.1 | eupl(?: v)? ?1 1
cecill | 5 | 0.9 | cecill-2.1 | cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?(?: 2 1)?
cecill | 6 | 0.95 | cecill-b | cecill b(?: licen[sc]e)?
cecill | 6 | 0.95 | cecill-c | cecill c(?: licen[sc]e)?
mulan | 5 | 0.9 | mulan-psl-2 | mulan (?:psl|permissive software licen[sc]e)(?: v)?(?: ?2)?
unlicense+licen | 7 | 1.0 | unlicense | spdx license identifier unlicense
unlicense | 5 | 0.9 | unlicense | (?:the )?unlicense
unencumbered | 8 | 1.0 | unlicense | this is free and unencumbered software released into the public domain
wtfpl | 5 | 0.9 | wtfpl | wtfpl(?: version)?(?: 2)?
fuck+licen | 6 | 0.95 | wtfpl | do what the fuck you want to public licen[sc]e
beerware | 4 | 0.8 | beerware | beerware(?: licen[sc]e)?
beer+licen | 4 | 0.8 | beerware | the beer ware licen[sc]e
evil. | 6 | 0.9 | json | the software shall be used for good not evil
cc0 | 7 | 1.0 | cc0 | (?:spdx license identifier )?cc0(?: 1 0)?(?: universal)?
creative | 6 | 0.95 | cc0 | creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?(?: public domain dedication)?
creative | 5 | 0.9 | cc-by | creative commons attribution(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?
creative | 6 | 0.92 | cc-by-sa | creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?
creative | 6 | 0.92 | cc-by-nd | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?
creative | 6 | 0.92 | cc-by-nc | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?
creative | 7 | 0.95 | cc-by-nc-sa | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?
creative | 7 | 0.95 | cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?
creative | 3 | 0.5 | cc | creative commons(?: licen[sc]ed?)?
cc. | 5 | 0.9 | cc-by | cc by [1-4] [05](?: international)?(?: licen[sc]e)?
cc+licen | 7 | 0.95 | cc-by | (?:spdx license identifier|licen[sc]ed under(?: a| the)?) cc by(?: [1-4] [05])?(?: licen[sc]e)?
cc. | 6 | 0.92 | cc-by-sa | (?:licen[sc]ed under(?: a| the)? )?cc by sa(?: [1-4] [05])?(?: licen[sc]e)?
cc. | 6 | 0.92 | cc-by-nd | (?:licen[sc]ed under(?: a| the)? )?cc by nd(?: [1-4] [05])?(?: licen[sc]e)?
cc. | 6 | 0.92 | cc-by-nc | (?:licen[sc]ed under(?: a| the)? )?cc by nc(?: [1-4] [05])?(?: licen[sc]e)?
cc. | 7 | 0.95 | cc-by-nc-sa | (?:licen[sc]ed under(?: a| the)? )?cc by nc sa(?: [1-4] [05])?(?: licen[sc]e)?
cc. | 7 | 0.95 | cc-by-nc-nd | (?:licen[sc]ed under(?: a| the)? )?cc by nc nd(?: [1-4] [05])?(?: licen[sc]e)?
cc. | 5 | 0.85 | cc-sampling | cc sampling(?: plus)?(?: 1 0)?
creativecommons+licen | 6 | 0.95 | cc-by | creativecommons org licenses by(?: [1-4] [05])?
creativecommons+licen | 7 | 0.95 | cc-by-sa | creativecommons org licenses by sa(?: [1-4] [05])?
creativecommons+licen | 7 | 0.95 | cc-by-nd | creativecommons org licenses by nd(?: [1-4] [05])?
creativecommons+licen | 7 | 0.95 | cc-by-nc | creativecommons org licenses by nc(?: [1-4] [05])?
creativecommons+licen | 8 | 0.95 | cc-by-nc-sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
creativecommons+licen | 8 | 0.95 | cc-by-nc-nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
creativecommons | 7 | 0.95 | cc0 | creativecommons org publicdomain zero(?: 1 0)?
creativecommons | 6 | 0.9 | public-domain | creativecommons org publicdomain mark(?: 1 0)?
domain | 4 | 0.8 | public-domain | (?:is |are |placed |released |dedicated )?(?:in|into|to) the public domain
domain | 4 | 0.8 | public-domain | public domain (?:dedication|mark|work|licen[sc]e)
llama+licen | 5 | 0.9 | llama | (?:meta )?llama [234](?: [1-4])? community licen[sc]e(?: agreement)?
gemma | 4 | 0.8 | gemma | gemma terms of use
community+licen | 4 | 0.8 | cdla-permissive | community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)?
community+licen | 4 | 0.8 | cdla-sharing | community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?
cdla | 5 | 0.9 | cdla-permissive | cdla permissive(?: [12] 0)?
blueoak | 5 | 0.9 | blue-oak-1 | blueoak(?: 1 0 0)?
oak+licen | 5 | 0.9 | blue-oak-1 | blue oak model licen[sc]e(?: 1 0 0)?
upl. | 5 | 0.9 | upl-1 | (?:universal permissive licen[sc]e )?upl(?: 1 0)?
universal+licen | 6 | 0.95 | upl-1 | universal permissive licen[sc]e(?: version)?(?: v)?(?: 1 0)?
reserved | 1 | 0.3 | all-rights-reserved | all rights reserved
proprietary | 3 | 0.6 | proprietary | proprietary and confidential
proprietary | 3 | 0.6 | proprietary | (?:this is )?proprietary software
copying | 5 | 0.7 | proprietary | unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited
eula+licen | 3 | 0.5 | proprietary | end user licen[sc]e agreement eula
user+licen | 3 | 0.5 | proprietary | end user licen[sc]e agreement
shareware | 3 | 0.5 | shareware | (?:this is )?shareware
freeware | 3 | 0.5 | freeware | (?:this is )?freeware
noncommercial | 3 | 0.6 | non-commercial | for (?:personal and )?noncommercial use only
commercial | 3 | 0.6 | non-commercial | for (?:personal and )?non commercial use only
commercial+licen | 3 | 0.5 | commercial | commercial licen[sc]e(?: required)?
research | 3 | 0.6 | research-only | for research (?:purposes|use) only
dual+licen | 3 | 0.5 | dual-licensed | dual licen[sc]ed
licensed | 2 | 0.3 | unknown-license | licensed under (?:the )?(?:terms of )?(?:the )?[^ ]+ licen[sc]e
licenced | 2 | 0.3 | unknown-license | licenced under (?:the )?(?:terms of )?(?:the )?[^ ]+ licen[sc]e
"""
#: Priorities are below this, that of the base rules included.
PRIORITIES = 10
#: Detections that the sweep appends to one array, before that is set aside.
TOGETHER = 256


@dataclass(frozen=True)
class Rule:
    keyword: str  # or several, joined by +
    pattern: str
    label: str
    priority: int
    confidence: float
    base: bool = False


def default_rules() -> list[Rule]:
    """Base rules, then the written ones in their order."""
    rules = [Rule(max(p.split(), key=len), p, label, 9, 1.0, True) for p, label in BASE.items()]
    for line in RULES.strip().splitlines():
        keyword, priority, confidence, label, pattern = line.split(" | ")
        rules.append(Rule(keyword, pattern, label, int(priority), float(confidence)))
    return rules


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _start_of_word(keyword: str) -> str:
    """What to look for in a form: the keyword with the spaces around it."""
    return f" {keyword[:-1]} " if keyword.endswith(".") else f" {keyword}"


def _gate(keywords: set[str]) -> str:
    """One pattern for texts that hold any of the keywords, by first letters."""
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    rests: dict[str, list[str]] = {}
    for k in sorted(keywords):
        rests.setdefault(k[0], []).append(re.escape(k[1:].rstrip(".")) + (f"(?={gap})" if k.endswith(".") else ""))
    heads = [f"[{re.escape(c)}{re.escape(c.upper())}](?i:{'|'.join(x)})" for c, x in rests.items()]
    return f"{gap}(?:{'|'.join(heads)})"


def _marked(rule: Rule) -> str:
    """SQL for the form ``f`` with marks around what a rule matches, if it does."""
    pattern = _text(f" ({rule.pattern})(?= )")
    holds = " and ".join(f"contains(f, {_text(_start_of_word(k))})" for k in rule.keyword.split("+"))
    return f"if({holds} and f rlike {pattern}, regexp_replace(f, {pattern}, ' \\u0001$1\\u0002'), null)"


_FIELDS = (
    "start:int,back:int,order:int,nth:int,end:int,label:string,priority:int,confidence:double,base:boolean"
)
NONE = f"cast(array() as array<struct<{_FIELDS}>>)"


def _found(rules: list[Rule]) -> Column:
    """All detections in ``form``: the places of the marks among the words."""
    if not rules:
        return F.expr(NONE)
    table = ", ".join(
        f"named_struct('nth', {nth}, 'label', {_text(r.label)}, 'priority', {r.priority}, "
        f"'confidence', double({r.confidence}), 'base', {str(r.base).lower()})"
        for nth, r in enumerate(rules)
    )
    # The form begins with a space, so the first word is the second part.
    starts = "filter(transform(w, (x, i) -> if(startswith(x, '\\u0001'), i - 1, null)), x -> x is not null)"
    ends = "filter(transform(w, (x, i) -> if(endswith(x, '\\u0002'), i, null)), x -> x is not null)"
    detection = (
        "named_struct('start', a, 'back', -b, 'order', -h.r.priority, 'nth', h.r.nth, 'end', b, 'label', h.r.label, "
        "'priority', h.r.priority, 'confidence', h.r.confidence, 'base', h.r.base)"
    )
    hits = f"filter(zip_with(array({table}), array({', '.join(map(_marked, rules))}), (r, m) -> struct(r, m)), h -> h.m is not null)"
    places = f"transform(array(split(h.m, ' ')), w -> zip_with({starts}, {ends}, (a, b) -> {detection}))[0]"
    # As a lambda's body the many rules are no single generated method.
    return F.expr(f"transform(array(form), f -> flatten(transform({hits}, h -> {places})))[0]")


def _standing(found: Column) -> Column:
    """The detections that no other suppresses; ``found`` in sorted order.

    ``far`` holds, for each priority, the furthest end among detections so far
    of that priority or a higher one. Parts keep appending cheap.
    """
    part = f"array<struct<{_FIELDS}>>"

    def step(s: Column, d: Column) -> Column:
        stands = d.base | (F.get(s.far, d.priority) < d.end)
        return F.struct(
            F.transform(s.far, lambda e, p: F.when(p <= d.priority, F.greatest(e, d.end)).otherwise(e)).alias("far"),
            F.when(stands, F.concat(s.kept, F.array(d))).otherwise(s.kept).alias("kept"),
        )

    def sweep(s: Column, k: Column) -> Column:
        start = F.struct(s.far.alias("far"), F.array().cast(part).alias("kept"))
        done = F.aggregate(F.slice(found, k * TOGETHER + 1, F.lit(TOGETHER)), start, step)
        return F.struct(done.far.alias("far"), F.concat(s.parts, F.array(done.kept)).alias("parts"))

    begin = F.struct(
        F.array_repeat(F.lit(-1), PRIORITIES).alias("far"), F.array().cast(f"array<{part}>").alias("parts")
    )
    parts = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / TOGETHER).cast("int"))
    swept = F.aggregate(parts, begin, sweep, lambda s: F.flatten(s.parts))
    return F.when(F.size(found) > 0, swept).when(found.isNotNull(), found)


def detect_licenses(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, and the detections that stand, as structs."""
    rules = default_rules() if rules is None else rules
    body = F.concat(F.lit(" "), F.coalesce(F.col(text), F.lit("")), F.lit(" "))
    plain = F.translate(body, UPPER + GAPS, LOWER + " " * len(GAPS))
    # One search for the rarest keywords decides whether any rule can apply; few
    # texts go on from there.
    rare = {r.keyword.split("+")[-1] for r in rules}
    any_rule = body.rlike(_gate(rare)) if rare else F.lit(False)
    out = docs.select(F.col(doc_id).alias("doc_id"), plain.alias("plain"), any_rule.alias("any"))
    n_words = F.size(F.array_remove(F.split("plain", " "), "")).cast("long")
    form = F.when(F.col("any"), F.regexp_replace("plain", " +", " "))
    out = out.select("doc_id", n_words.alias("n_words"), form.alias("form"))
    found = F.when(F.col("form").isNotNull(), F.array_sort(_found(rules)))
    out = out.select("doc_id", "n_words", found.alias("found"))
    out = out.select(
        "doc_id", "n_words", F.filter("found", lambda d: d.base).alias("base"), _standing(F.col("found")).alias("detections")
    )
    miss = F.aggregate("detections", F.lit(1.0), lambda s, d: s * (1 - d.confidence))

    def joined(name: str) -> Column:
        labels = F.array_sort(F.array_distinct(F.transform(F.col(name), lambda d: d.label)))
        return F.coalesce(F.array_join(labels, ","), F.lit(""))

    starts = F.transform(F.col("base"), lambda d: d.start)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("detections").alias("labels"),
        F.coalesce(1 - miss, F.lit(0.0)).alias("score"),
        F.coalesce(F.transform("detections", lambda d: d.dropFields("back", "order", "nth")), F.array()).alias("detections"),
    )
