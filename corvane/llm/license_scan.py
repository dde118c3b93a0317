"""License detection by ordered signature rules, all in JVM expressions.

A document's words are joined by single blanks, so rules are short regexes over normalised text. It reaches the
rules only if that text holds a gate, and each rule runs only if its keyword occurs; every match of a rule holds
its keyword and at least one gate. Detections are word intervals.
An interval inside another one is suppressed; of equal intervals, and of two that overlap in part, the rule of the
best priority stays, and one that had lost to a suppressed interval alone comes back.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.text import ascii_lower, running

NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # A-Z are of words; the same words as after lower-casing

# The phrases that a scan reports unless it is given others, with their labels.
BASE = (("the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# License label, keyword, regex of its name in normalised words.
NAMES = (
    ("mit", "mit", r"(the )?mit licen[sc]e"),
    ("mit-0", "attribution", r"mit no attribution( licen[sc]e)?"),
    ("isc", "isc", r"(the )?isc licen[sc]e"),
    ("apache-1.0", "apache", r"apache (software )?licen[sc]e (version |v)?1 0"),
    ("apache-1.1", "apache", r"apache (software )?licen[sc]e (version |v)?1 1"),
    ("apache-2.0", "apache", r"apache (software )?licen[sc]e( (version|v))? ?2( 0)?"),
    ("bsd-1-clause", "bsd", r"(1|one) clause bsd( licen[sc]e)?|bsd (1|one) clause( licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"(simplified|freebsd|2 clause|two clause) bsd( licen[sc]e)?|bsd (2|two) clause( licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(new|modified|revised|3 clause|three clause) bsd( licen[sc]e)?|bsd (3|three) clause( licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(original|old|4 clause|four clause) bsd( licen[sc]e)?|bsd (4|four) clause( licen[sc]e)?"),
    ("bsd-zero-clause", "bsd", r"(zero|0) clause bsd( licen[sc]e)?|bsd (0|zero) clause( licen[sc]e)?"),
    ("gpl-1.0", "general", r"(gnu )?general public licen[sc]e( as published by the free software foundation)?( either)?( (version|v))? ?1( 0)?"),
    ("gpl-2.0", "general", r"(gnu )?general public licen[sc]e( as published by the free software foundation)?( either)?( (version|v))? ?2( 0)?"),
    ("gpl-3.0", "general", r"(gnu )?general public licen[sc]e( as published by the free software foundation)?( either)?( (version|v))? ?3( 0)?"),
    ("gpl", "general", r"gnu general public licen[sc]e"),
    ("lgpl-2.0", "general", r"(gnu )?library general public licen[sc]e( (version|v))? ?2( 0)?"),
    ("lgpl-2.1", "general", r"(gnu )?lesser general public licen[sc]e( (version|v))? ?2 1"),
    ("lgpl-3.0", "general", r"(gnu )?lesser general public licen[sc]e( (version|v))? ?3( 0)?"),
    ("lgpl", "general", r"(gnu )?lesser general public licen[sc]e"),
    ("agpl-3.0", "affero", r"(gnu )?affero general public licen[sc]e( (version|v))? ?3( 0)?"),
    ("agpl", "affero", r"(gnu )?affero general public licen[sc]e"),
    ("gfdl-1.1", "documentation", r"(gnu )?free documentation licen[sc]e( (version|v))? ?1 1"),
    ("gfdl-1.2", "documentation", r"(gnu )?free documentation licen[sc]e( (version|v))? ?1 2"),
    ("gfdl-1.3", "documentation", r"(gnu )?free documentation licen[sc]e( (version|v))? ?1 3"),
    ("gfdl", "documentation", r"(gnu )?free documentation licen[sc]e"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[sc]e( (version|v))? ?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e( (version|v))? ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e( (version|v))? ?2( 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e( (version|v))? ?1( 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e( (version|v))? ?2( 0)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e( (version|v))? ?1( 0)?"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[sc]e( (version|v))?( 1 0)?"),
    ("cddl-1.1", "distribution", r"common development and distribution licen[sc]e( (version|v))? ?1 1"),
    ("cpl-1.0", "common", r"common public licen[sc]e( (version|v))?( 1 0)?"),
    ("ipl-1.0", "ibm", r"ibm public licen[sc]e( (version|v))?( 1 0)?"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e( (version|v))? ?1( 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e( (version|v))? ?2( 0)?"),
    ("artistic", "artistic", r"(the )?artistic licen[sc]e"),
    ("zlib", "zlib", r"(the )?zlib( libpng)? licen[sc]e"),
    ("libpng", "libpng", r"(the )?libpng licen[sc]e"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e( (version|v))?( 1 0)?"),
    ("busl-1.1", "business", r"business source licen[sc]e( (version|v))?( 1 1)?"),
    ("unlicense", "unlicense", r"(the )?unlicense"),
    ("wtfpl", "want to public", r"do what the f[a-z]* you want to public licen[sc]e"),
    ("cc0-1.0", "cc0", r"(creative commons )?cc0( 1 0)?( universal)?"),
    ("cc0-1.0", "cc zero", r"(creative commons )?cc zero( 1 0)?( universal)?"),
    ("cc0-1.0", "creative commons zero", r"creative commons zero( v?1 0)?"),
    ("cc-by-1.0", "attribution", r"creative commons attribution 1 0"),
    ("cc-by-2.0", "attribution", r"creative commons attribution 2 0"),
    ("cc-by-3.0", "attribution", r"creative commons attribution 3 0"),
    ("cc-by-4.0", "attribution", r"creative commons attribution 4 0"),
    ("cc-by-sa", "attribution", r"creative commons attribution share ?alike( [1-4] [05])?"),
    ("cc-by-nc", "attribution", r"creative commons attribution non ?commercial( [1-4] [05])?"),
    ("cc-by-nd", "attribution", r"creative commons attribution no ?deriv(ative)?s?( works)?( [1-4] [05])?"),
    ("cc-by-nc-sa", "attribution", r"creative commons attribution non ?commercial share ?alike( [1-4] [05])?"),
    ("cc-by-nc-nd", "attribution", r"creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?( [1-4] [05])?"),
    ("ofl-1.1", "font", r"(sil )?open font licen[sc]e( (version|v))?( 1 1)?"),
    ("odbl-1.0", "database", r"open (data commons open )?database licen[sc]e( (version|v))?( 1 0)?"),
    ("odc-by-1.0", "commons", r"open data commons attribution licen[sc]e( (version|v))?( 1 0)?"),
    ("pddl-1.0", "dedication", r"(open data commons )?public domain dedication and licen[sc]e"),
    ("psf-2.0", "python", r"python software foundation licen[sc]e( (version|v))?( 2)?"),
    ("python-2.0", "python", r"python licen[sc]e( (version|v))? ?2( 0)?"),
    ("php-3.01", "php", r"php licen[sc]e( (version|v))?( 3 01)?"),
    ("ruby", "ruby", r"(the )?ruby licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("w3c", "w3c", r"w3c software (notice and )?licen[sc]e"),
    ("x11", "x11", r"(the )?x11 licen[sc]e"),
    ("ncsa", "ncsa", r"(university of illinois )?ncsa open source licen[sc]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("eupl-1.1", "european", r"european union public licen[sc]e( (version|v))? ?1 1"),
    ("eupl-1.2", "european", r"european union public licen[sc]e( (version|v))? ?1 2"),
    ("eupl", "european", r"european union public licen[sc]e"),
    ("ecl-2.0", "educational", r"educational community licen[sc]e( (version|v))?( 2 0)?"),
    ("afl-3.0", "academic", r"academic free licen[sc]e( (version|v))?( 3 0)?"),
    ("osl-3.0", "open software", r"open software licen[sc]e( (version|v))?( 3 0)?"),
    ("vim", "vim", r"(the )?vim licen[sc]e"),
    ("postgresql", "postgresql", r"(the )?postgresql licen[sc]e"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e( (version|v))?( 1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e( (version|v))? ?2( 0)?"),
    ("upl-1.0", "permissive", r"universal permissive licen[sc]e( (version|v))?( 1 0)?"),
    ("polyform-nc", "polyform", r"polyform noncommercial licen[sc]e( 1 0 0)?"),
    ("openrail-m", "openrail", r"(creativeml |bigscience )?openrail( m)?( licen[sc]e)?"),
    ("llama", "llama", r"llama( 2| 3)? community licen[sc]e"),
)

# Characteristic sentences of license texts and notices.
SENTENCES = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("zlib", "provided", r"this software is provided as is without any express or implied warranty"),
    ("bsl-1.0", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived", r"(has )?waived all copyright and related or neighboring rights"),
    ("public-domain", "public domain", r"(released|placed|dedicated) (in)?to the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("warranty-disclaimer", "warranties", r"without warranties or conditions of any kind"),
    ("ofl-1.1", "font", r"this font software is licen[sc]ed under the sil open font licen[sc]e"),
)

# Notices, headers and clauses by which projects name or repeat their license, as they are written.
NOTICES = (
    ("mit", "mit", r"this project is licen[sc]ed under the mit licen[sc]e"),
    ("mit", "mit", r"this software is released under the mit licen[sc]e"),
    ("mit", "mit", r"mit licen[sc]e copyright c"),
    ("mit", "mit", r"dual licen[sc]ed under (the )?mit and gpl"),
    ("mit", "expat", r"(the )?expat licen[sc]e"),
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-0", "attribution", r"the mit no attribution licen[sc]e mit 0"),
    ("isc", "isc", r"licen[sc]ed under (the )?isc licen[sc]e terms"),
    ("isc", "fee", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("apache-2.0", "apache", r"licen[sc]ed under the apache licen[sc]e version 2 0 the license"),
    ("apache-2.0", "apache", r"apache licen[sc]e version 2 0 january 2004"),
    ("apache-2.0", "apache", r"http www apache org licenses license 2 0"),
    ("apache-2.0", "apache", r"licen[sc]ed to the apache software foundation asf"),
    ("apache-2.0", "contributor", r"see the notice file distributed with this work (.{0,80} )?contributor license"),
    ("apache-2.0", "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "patent", r"royalty free irrevocable except as stated in this section patent license"),
    ("apache-2.0", "governing", r"see the license for the specific language governing permissions and limitations"),
    ("bsd-2-clause", "bsd", r"licen[sc]ed under (the )?(simplified|2 clause) bsd licen[sc]e"),
    ("bsd-3-clause", "bsd", r"licen[sc]ed under (the )?(new|3 clause) bsd licen[sc]e"),
    ("bsd-3-clause", "bsd style", r"(use of this source code is )?governed by a bsd style license"),
    ("bsd-4-clause", "california", r"developed by the university of california (.{0,40} )?advertising clause of the license"),
    ("bsd", "bsd", r"(the )?bsd licen[sc]e"),
    ("bsd", "berkeley", r"berkeley software distribution licen[sc]e"),
    ("bsd-zero-clause", "bsd", r"free public licen[sc]e 1 0 0 bsd zero clause"),
    ("gpl-2.0", "version 2", r"terms of the gnu general public licen[sc]e version 2 as published by the free software foundation"),
    ("gpl-2.0-or-later", "later version", r"gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0-or-later", "later version", r"gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0", "june 2007", r"gnu general public licen[sc]e version 3 29 june 2007"),
    ("gpl-2.0", "june 1991", r"gnu general public licen[sc]e version 2 june 1991"),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public licen[sc]e along with this program"),
    ("gpl", "gpl", r"licen[sc]ed under (the )?(gnu )?gpl"),
    ("gpl-2.0", "gpl", r"licen[sc]ed under (the )?(gnu )?gpl ?v?2"),
    ("gpl-3.0", "gpl", r"licen[sc]ed under (the )?(gnu )?gpl ?v?3"),
    ("gpl", "copyleft", r"the licenses for most software are designed to take away your freedom (.{0,60} )?copyleft"),
    ("gpl-classpath", "classpath", r"gnu general public licen[sc]e (.{0,30} )?with the classpath exception"),
    ("lgpl", "received a copy", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl-2.1", "february 1999", r"gnu lesser general public licen[sc]e version 2 1 february 1999"),
    ("lgpl-3.0", "june 2007", r"gnu lesser general public licen[sc]e version 3 29 june 2007"),
    ("lgpl-2.1-or-later", "later version", r"gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version"),
    ("lgpl", "lgpl", r"licen[sc]ed under (the )?(gnu )?lgpl"),
    ("lgpl", "linking", r"linking this library (.{0,60} )?licen[sc]e"),
    ("agpl", "received a copy", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl-3.0", "november 2007", r"gnu affero general public licen[sc]e version 3 19 november 2007"),
    ("agpl", "agpl", r"licen[sc]ed under (the )?(gnu )?agpl"),
    ("gfdl", "invariant", r"free documentation licen[sc]e (.{0,80} )?with no invariant sections"),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file (.{0,60} )?licen[sc]e"),
    ("mpl-1.1", "contents", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0", "exhibit", r"exhibit a source code form license notice"),
    ("mpl", "tri licen", r"mpl gpl lgpl tri licen[sc]e"),
    ("epl-1.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0"),
    ("epl-2.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v?2 0"),
    ("epl-2.0", "secondary", r"this source code may also be made available under the following secondary licenses"),
    ("cddl-1.0", "cddl", r"(subject to the terms of the )?cddl licen[sc]e"),
    ("cddl-1.0", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cpl-1.0", "agreement", r"provided under the terms of this common public licen[sc]e agreement"),
    ("ipl-1.0", "agreement", r"provided under the terms of this ibm public licen[sc]e agreement"),
    ("artistic", "perl", r"same terms as perl itself (.{0,60} )?artistic licen[sc]e"),
    ("artistic-2.0", "everyone is permitted", r"artistic licen[sc]e 2 0 (.{0,60} )?everyone is permitted"),
    ("perl", "perl", r"licen[sc]ed under the same terms as perl"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented (.{0,80} )?licen[sc]e"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such (.{0,80} )?licen[sc]e"),
    ("libpng", "libpng", r"png reference library licen[sc]e (.{0,20} )?libpng"),
    ("bsl-1.0", "boost", r"distributed under the boost software licen[sc]e version 1 0"),
    ("busl-1.1", "change date", r"business source licen[sc]e (.{0,60} )?change date"),
    ("unlicense", "unlicense", r"for more information please refer to http unlicense org"),
    ("wtfpl", "wtfpl", r"(the )?wtfpl licen[sc]e"),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("gpl", "changing it", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("cc0-1.0", "dedicated", r"dedicated (this work|the work) to the public domain"),
    ("cc0-1.0", "affirmer", r"public domain (.{0,60} )?affirmer"),
    ("cc-by-4.0", "attribution", r"creative commons attribution 4 0 international( public)? licen[sc]e"),
    ("cc-by-3.0", "attribution", r"creative commons attribution 3 0 (unported )?licen[sc]e"),
    ("cc-by-sa-3.0", "attribution", r"creative commons attribution share ?alike 3 0 unported( licen[sc]e)?"),
    ("cc-by-sa-4.0", "attribution", r"creative commons attribution share ?alike 4 0 international( licen[sc]e)?"),
    ("cc-by-nc-4.0", "attribution", r"creative commons attribution non ?commercial 4 0 international( licen[sc]e)?"),
    ("cc-by-nd-4.0", "attribution", r"creative commons attribution no ?derivatives 4 0 international( licen[sc]e)?"),
    ("cc-by-nc-sa-4.0", "attribution", r"creative commons attribution non ?commercial share ?alike 4 0 international( licen[sc]e)?"),
    ("cc-by-nc-nd-4.0", "attribution", r"creative commons attribution non ?commercial no ?derivatives 4 0 international( licen[sc]e)?"),
    ("cc-by", "by", r"licen[sc]ed under (a )?cc by( [234] 0)?"),
    ("cc-by-sa", "by", r"licen[sc]ed under (a )?cc by sa( [234] 0)?"),
    ("cc-by-nc-sa", "by", r"licen[sc]ed under (a )?cc by nc sa( [234] 0)?"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("ofl-1.1", "reserved font", r"with reserved font name (.{0,60} )?licen[sc]e"),
    ("ofl-1.1", "scripts sil", r"this license is available with a faq at http scripts sil org ofl"),
    ("odbl-1.0", "opendatacommons", r"opendatacommons org licenses odbl"),
    ("odbl-1.0", "openstreetmap", r"openstreetmap contributors (.{0,60} )?open database licen[sc]e"),
    ("pddl-1.0", "opendatacommons", r"opendatacommons org licenses pddl"),
    ("odc-by-1.0", "opendatacommons", r"opendatacommons org licenses by"),
    ("psf-2.0", "psf", r"psf licen[sc]e agreement( for python)?"),
    ("python-2.0", "beopen", r"beopen com licen[sc]e agreement for python 2 0"),
    ("php-3.01", "php", r"this source file is subject to version 3 01 of the php licen[sc]e"),
    ("ruby", "modify it under", r"you can redistribute it and or modify it under (either the terms of the 2 clause bsdl|the same terms as ruby) (.{0,20} )?licen[sc]e"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project (.{0,60} )?licen[sc]e"),
    ("ssleay", "ssleay", r"original ssleay licen[sc]e"),
    ("w3c", "w3c", r"w3c document licen[sc]e"),
    ("x11", "x consortium", r"x consortium (.{0,60} )?licen[sc]e"),
    ("ncsa", "illinois", r"university of illinois open source licen[sc]e"),
    ("ms-pl", "ms pl", r"microsoft public licen[sc]e ms pl"),
    ("ms-rl", "ms rl", r"microsoft reciprocal licen[sc]e ms rl"),
    ("eupl-1.2", "eupl", r"licen[sc]ed under the eupl( version 1 2)?"),
    ("ecl-2.0", "educational", r"licen[sc]ed under the educational community licen[sc]e version 2 0"),
    ("postgresql", "postgresql", r"postgresql database management system (.{0,60} )?licen[sc]e"),
    ("sspl-1.0", "sspl", r"(the )?sspl licen[sc]e"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e 2 0( and the server side public licen[sc]e)?"),
    ("openrail-m", "use based", r"use based restrictions (.{0,60} )?openrail"),
    ("llama", "meta", r"meta llama 3 is licen[sc]ed under the meta llama 3 community licen[sc]e"),
    ("gemma", "gemma", r"gemma terms of use licen[sc]e"),
    ("proprietary", "confidential", r"proprietary and confidential (.{0,40} )?all rights reserved"),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited (.{0,40} )?licen[sc]e"),
    ("proprietary", "evaluation", r"for evaluation purposes only under (a|the) license agreement"),
    ("commercial", "commercial", r"commercial licen[sc]e (agreement|required|available)"),
    ("end-user-agreement", "end user", r"end user licen[sc]e agreement"),
    ("warranty-disclaimer", "as is", r"licensed work is provided on an as is basis"),
    ("warranty-disclaimer", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e"),
    ("public-domain", "public domain", r"this work is in the public domain"),
    ("public-domain", "public domain", r"no copyright (.{0,20} )?public domain"),
    ("us-government", "government", r"work of the (united states|u s) government (.{0,60} )?public domain"),
)

# License ids as they are written after an SPDX tag, in a badge or in package metadata.
TAGS = (
    "mit", "mit-0", "isc", "apache-1.1", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd", "gpl-1.0", "gpl-2.0", "gpl-3.0",
    "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "gfdl-1.2", "gfdl-1.3", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "cddl-1.0", "cpl-1.0",
    "artistic-1.0", "artistic-2.0", "zlib", "libpng", "bsl-1.0", "busl-1.1", "unlicense", "wtfpl", "cc0-1.0", "cc-by-1.0", "cc-by-2.0", "cc-by-2.5",
    "cc-by-3.0", "cc-by-4.0", "cc-by-sa-2.0", "cc-by-sa-2.5", "cc-by-sa-3.0", "cc-by-sa-4.0", "cc-by-nc-2.0", "cc-by-nc-3.0", "cc-by-nc-4.0",
    "cc-by-nd-3.0", "cc-by-nd-4.0", "cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0", "ofl-1.1", "odbl-1.0", "pddl-1.0",
    "psf-2.0", "python-2.0", "php-3.01", "ruby", "openssl", "w3c", "x11", "ncsa", "ms-pl", "ms-rl", "eupl-1.1", "eupl-1.2", "ecl-2.0", "afl-3.0",
    "osl-3.0", "vim", "postgresql", "sspl-1.0", "elastic-2.0", "upl-1.0",
)

#: A document without any of these reaches no rule. They stand in normalised text; blanks are word bounds.
GATES = (
    "licen", " mit no attribution ", " bsd ", " cc0 ", " cc zero ", " cc by nc ", " creative commons ", " openrail ",
    " released under ", " distributed under ", " available under ", " permission is hereby granted ", " permission to use copy modify ",
    " redistribution and use in source and binary forms ", " endorse or promote ", " all advertising materials ", " provided as is ",
    " public domain ", " copyright and related or neighboring rights ", " all rights reserved ", " warranties or conditions ",
)


def rules() -> list[dict]:
    """The signature rules in order of priority (0 is the best)."""
    found = [{"label": label, "keyword": keyword, "regex": regex, "weight": 0.9} for label, keyword, regex in NAMES]
    found += [{"label": label, "keyword": keyword, "regex": regex, "weight": 0.85} for label, keyword, regex in NOTICES]
    found += [{"label": label, "keyword": keyword, "regex": regex, "weight": 0.8} for label, keyword, regex in SENTENCES]
    for tag in TAGS:
        spoken = tag.replace("-", " ").replace(".", " ")
        loose = spoken.replace(" 0", "( 0)?")
        found.append({"label": tag, "keyword": "spdx", "regex": rf"spdx licen[sc]e identifier {spoken}( only| or later)?", "weight": 1.0})
        found.append({"label": tag, "keyword": spoken.split(" ")[0], "regex": rf"(licen[sc]ed?|released|distributed|available) under (the )?(terms of )?(the )?{loose}( licen[sc]e)?", "weight": 0.7})
        # a name without a version is a common word too often to follow "license" in any text
        before = "" if re.search(r" \d", spoken) else "(code|software|project|package|module|library|source) "
        found.append({"label": tag, "keyword": spoken.split(" ")[0], "regex": rf"{before}licen[sc]e {spoken}", "weight": 0.6})
    found.sort(key=lambda r: -r["weight"])  # stable
    return [r | {"priority": k} for k, r in enumerate(found)]


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _intervals(norm: Column, regex: Column) -> Column:
    """(start, end) in words of the matches of regex, which stands between blanks of norm."""
    pattern = F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )"))
    gaps, hits = F.split(norm, pattern, -1), F.regexp_extract_all(norm, pattern, F.lit(0))
    each = F.transform(F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull()), lambda x: F.struct(_blanks(x["gap"]).alias("gap"), _blanks(x["hit"]).alias("hit")))
    told = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["hit"] + 1).alias("end"))
    return running(each, F.lit(-1), lambda at, x: at + x["gap"] + x["hit"], told, "struct<start:int,end:int>")


DETECTION = "struct<start:int,end:int,priority:int,label:string,weight:double>"


def _suppressed(found: Column) -> Column:
    """The detections that stay, in order.

    They are swept by start, the longer and then the better one first, past the one that stands. One that lies within it
    goes; of two that overlap in part the better stays. When a better one takes the place of what stood, the best of
    those which that had beaten comes back if it ends before the new one starts. The benches of beaten ones are as
    long as a rule's match at most, and the time is in proportion to the detections.
    """
    ordered = F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["priority"].alias("priority"), x.alias("x")))), lambda o: o["x"])
    far = F.lit(2**31 - 1)
    last = F.struct(far.alias("start"), far.alias("end"), far.alias("priority"), F.lit("").alias("label"), F.lit(0.0).alias("weight"))
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), far.alias("priority"), F.lit("").alias("label"), F.lit(0.0).alias("weight"))
    empty = F.array().cast(f"array<{DETECTION}>")
    state = lambda top, bench: F.struct(top.alias("top"), bench.alias("bench"))
    beyond = lambda s, x: x["start"] >= s["top"]["end"]
    beats = lambda s, x: (x["end"] > s["top"]["end"]) & (x["priority"] < s["top"]["priority"])
    back = lambda s, x: F.slice(F.array_sort(F.transform(F.filter(s["bench"], lambda l: l["end"] <= x["start"]), lambda l: F.struct(l["priority"].alias("p"), l.alias("l")))), 1, 1)  # noqa: E731, E741
    add = lambda s, x: F.when(beyond(s, x) | beats(s, x), state(x, empty)).otherwise(state(s["top"], F.array_append(s["bench"], x)))
    tell = lambda s, x: F.struct(F.when(beyond(s, x), F.array(s["top"])).when(beats(s, x), F.transform(back(s, x), lambda b: b["l"])).otherwise(empty).alias("kept"))
    told = running(F.concat(ordered, F.array(last)).cast(f"array<{DETECTION}>"), state(none, empty), add, tell, f"struct<kept:array<{DETECTION}>>")
    return F.filter(F.flatten(F.transform(told, lambda t: t["kept"])), lambda x: x["start"] >= 0)


def _table(entries: list[dict]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in e.items()]) for e in entries])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """One row per row of docs: base places, detections, labels and a score.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections: array of
    (start, end, label, weight) with words counted from 0, end exclusive, after suppression. score is the largest
    weight (0 without a detection, 1 for a base place). Null and empty texts have no words and no labels. Null
    ids pass through; repeated rows repeat their result; other columns of docs are ignored. phrases are the words of
    the base places, in lower case with single blanks, and their labels; texts with one of them pass the gate.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("doc_id", F.concat(F.lit(" "), F.trim(F.regexp_replace("text", NO_WORD, " ")), F.lit(" ")).alias("spaced"))
    low = F.lower("spaced")  # of ASCII phrases it holds all that ascii_lower gives, and is cheaper
    gate = low.contains(GATES[0])
    for phrase in [*GATES[1:], *[f" {p} " for p, _ in phrases if not any(g in f" {p} " for g in GATES)]]:
        gate = gate | low.contains(phrase)
    n_words = F.when(F.length("spaced") > 2, _blanks(F.col("spaced")) - 1).otherwise(0).cast("long")
    df = df.select("doc_id", n_words.alias("n_words"), F.when(gate, ascii_lower(F.col("spaced"))).alias("norm"))

    base = F.transform(
        _table([{"phrase": p, "label": label} for p, label in phrases]),
        lambda r: F.transform(_intervals(F.col("norm"), r["phrase"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(-1).alias("priority"), r["label"].alias("label"), F.lit(1.0).alias("weight"))),
    )
    usable = F.filter(_table(rules()), lambda r: F.col("norm").contains(r["keyword"]))
    found = F.transform(usable, lambda r: F.transform(_intervals(F.col("norm"), r["regex"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight"))))
    kind = f"array<{DETECTION}>"
    some = F.col("norm").isNotNull()
    df = df.withColumn("base", F.when(some, F.flatten(base)).otherwise(F.array()).cast(kind)).withColumn("found", F.when(some, F.flatten(found)).otherwise(F.array()).cast(kind))
    df = df.withColumn("kept", F.when(F.size("found") > 0, _suppressed(F.col("found"))).otherwise(F.col("found")))
    names = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"])))
    return df.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"].cast("long"))).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"].cast("long"))).alias("last_word"),
        F.array_join(names("base"), ",").alias("base_labels"),
        F.array_join(names(F.concat("base", "kept")), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "kept"), lambda x: x["weight"])), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"), x["weight"].alias("weight"))).alias("detections"),
    )
