"""License scan by ordered signature rules, with DataFrame operations only.

Texts are normalized to words parted by single blanks. A signature has keywords, whole words that each of its matches
holds; a document's words are met with all keywords, and most documents, which have none, pass by. In the others
each signature of which they have all keywords is searched as a regular expression, and a detection inside another
of higher priority, or of equal priority and greater length, is dropped. Everything happens within the row: one pass,
no shuffle, no broadcast that grows. Places and containment are running sums and maxima, in n log n steps for n matches.

Null text counts as empty: no words, no detections, score 0. Repeated rows repeat; equal detections of one
place are all kept if neither outranks the other. An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import table

#: (phrase, label), as the query's contract names them.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Bytes that part words, once A-Z is lower-cased.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Signatures in the order of the licences: label, regular expression over normalized text, whole words that every match
#: holds (the first, mostly the rarest, calls the rule up), priority, confidence. Priorities: 4 an identifier or a passage of
#: the licence's own text, 3 a grant or a full name with its version, 2 a name, 1 a hint.
RULES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby obtaining", 4, 0.99),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial portions", 4, 0.9),
    ("mit", r"spdx license identifier mit", "spdx mit", 4, 1.0),
    ("mit", r"opensource org licenses mit(?: license)?(?: php)?", "opensource mit", 4, 0.97),
    ("mit", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e", "mit under", 3, 0.97),
    ("mit", r"(?:released|licensed|distributed|available) under (?:the )?mit", "mit under", 2, 0.9),
    ("mit", r"(?:the )?mit license", "mit license", 2, 0.9),
    ("mit", r"mit licensed", "licensed mit", 2, 0.85),
    ("mit", r"license mit", "license mit", 2, 0.85),
    ("mit", r"(?:the )?mit expat license", "expat mit", 3, 0.95),
    ("expat", r"(?:the )?expat license", "expat license", 2, 0.9),
    ("mit-0", r"spdx license identifier mit 0", "spdx mit", 4, 1.0),
    ("mit-0", r"mit no attribution", "attribution mit", 3, 0.95),
    ("x11", r"(?:the )?(?:mit )?x11 license", "x11 license", 3, 0.9),
    ("x11", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", "dealings advertising", 4, 0.9),
    ("apache-2.0", r"licensed under the apache license version 2 0", "apache licensed", 3, 0.99),
    ("apache-2.0", r"(?:the )?apache license version 2(?: 0)?", "apache version", 3, 0.97),
    ("apache-2.0", r"(?:the )?apache(?: software)? license 2(?: 0)?", "apache license", 3, 0.95),
    ("apache-2.0", r"apache 2 0 licen[cs]e", "apache 2", 3, 0.95),
    ("apache-2.0", r"(?:under|license) (?:the )?apache 2(?: 0)?", "apache 2", 2, 0.9),
    ("apache-2.0", r"spdx license identifier apache 2 0", "spdx apache", 4, 1.0),
    ("apache-2.0", r"(?:www )?apache org licenses license 2 0", "licenses apache", 4, 0.98),
    ("apache-2.0", r"you may not use this file except in compliance with the license you may obtain a copy of the license at", "compliance obtain", 4, 0.93),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable basis", 4, 0.93),
    ("apache-1.1", r"(?:the )?apache(?: software)? license version 1 1", "apache version", 3, 0.97),
    ("apache-1.1", r"spdx license identifier apache 1 1", "spdx apache", 4, 1.0),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache developed", 4, 0.8),
    ("apache", r"apache license", "apache license", 1, 0.7),
    ("bsd-2-clause", r"spdx license identifier bsd 2 clause", "spdx bsd", 4, 1.0),
    ("bsd-2-clause", r"bsd 2 clause(?: simplified)?(?: license)?", "bsd clause", 3, 0.95),
    ("bsd-2-clause", r"(?:2|two) clause bsd(?: license)?", "bsd clause", 3, 0.95),
    ("bsd-2-clause", r"(?:the )?simplified bsd license", "bsd simplified", 3, 0.93),
    ("bsd-2-clause", r"(?:the )?freebsd license", "freebsd license", 3, 0.9),
    ("bsd-3-clause", r"spdx license identifier bsd 3 clause", "spdx bsd", 4, 1.0),
    ("bsd-3-clause", r"bsd 3 clause(?: new or revised)?(?: license)?", "bsd clause", 3, 0.95),
    ("bsd-3-clause", r"(?:3|three) clause bsd(?: license)?", "bsd clause", 3, 0.95),
    ("bsd-3-clause", r"(?:the )?new bsd license", "bsd new", 3, 0.93),
    ("bsd-3-clause", r"(?:the )?(?:modified|revised) bsd license", "bsd license", 3, 0.93),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission", "endorse prior", 4, 0.93),
    ("bsd-4-clause", r"spdx license identifier bsd 4 clause", "spdx bsd", 4, 1.0),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|four clause bsd)(?: license)?", "bsd clause", 3, 0.93),
    ("bsd-4-clause", r"(?:the )?original bsd license", "bsd original", 3, 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising materials", 4, 0.95),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary", 4, 0.95),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions retain", 3, 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions reproduce", 3, 0.9),
    ("bsd", r"bsd style licen[cs]e", "bsd style", 3, 0.85),
    ("bsd", r"(?:the )?bsd licen[cs]e", "bsd", 2, 0.8),
    ("bsd", r"(?:licensed|released|distributed) under (?:the )?bsd", "bsd under", 2, 0.8),
    ("0bsd", r"spdx license identifier 0bsd", "spdx 0bsd", 4, 1.0),
    ("0bsd", r"(?:bsd )?zero clause(?: bsd)?(?: license)?", "zero clause", 3, 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby fee", 4, 0.97),
    ("isc", r"spdx license identifier isc", "spdx isc", 4, 1.0),
    ("isc", r"(?:the )?isc license", "isc license", 3, 0.93),
    ("isc", r"(?:licensed|released|distributed) under (?:the )?isc", "isc under", 2, 0.88),
    ("gpl-1.0", r"(?:gnu )?general public license version 1", "general version", 3, 0.93),
    ("gpl-1.0", r"spdx license identifier gpl 1 0(?: only| or later)?", "spdx gpl", 4, 1.0),
    ("gpl-2.0", r"(?:gnu )?general public license(?: as published by the free software foundation)? (?:either )?version 2(?: 0)?", "general version", 3, 0.96),
    ("gpl-2.0", r"spdx license identifier gpl 2 0(?: only| or later)?", "spdx gpl", 4, 1.0),
    ("gpl-2.0", r"(?:gnu )?gpl(?: version)? v?2(?: 0)?", "gpl", 3, 0.93),
    ("gpl-2.0", r"(?:gnu )?gplv2", "gplv2", 3, 0.95),
    ("gpl-2.0", r"gnu org licenses (?:old licenses )?gpl 2 0", "licenses gpl", 4, 0.97),
    ("gpl-2.0", r"under the terms of version 2 of the gnu general public license", "gnu version", 3, 0.96),
    ("gpl-3.0", r"(?:gnu )?general public license(?: as published by the free software foundation)? (?:either )?version 3(?: 0)?", "general version", 3, 0.96),
    ("gpl-3.0", r"spdx license identifier gpl 3 0(?: only| or later)?", "spdx gpl", 4, 1.0),
    ("gpl-3.0", r"(?:gnu )?gpl(?: version)? v?3(?: 0)?", "gpl", 3, 0.93),
    ("gpl-3.0", r"(?:gnu )?gplv3", "gplv3", 3, 0.95),
    ("gpl-3.0", r"gnu org licenses gpl 3 0", "licenses gpl", 4, 0.97),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute gnu", 4, 0.95),
    ("gpl", r"you should have received a copy of the gnu general public license along with this (?:program|library|software)", "gnu received", 4, 0.95),
    ("gpl", r"gnu org licenses gpl", "licenses gpl", 3, 0.9),
    ("gpl", r"(?:the )?(?:gnu )?general public licen[cs]e", "general public", 2, 0.8),
    ("gpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl", "gpl under", 2, 0.9),
    ("gpl", r"(?:the )?gnu gpl", "gpl gnu", 2, 0.85),
    ("gpl", r"gpl licen[cs]e", "gpl", 2, 0.8),
    ("gpl", r"gpl", "gpl", 1, 0.5),
    ("lgpl-2.0", r"(?:gnu )?library general public license version 2", "general library", 3, 0.96),
    ("lgpl-2.0", r"spdx license identifier lgpl 2 0(?: only| or later)?", "spdx lgpl", 4, 1.0),
    ("lgpl-2.1", r"(?:gnu )?lesser general public license(?: as published by the free software foundation)? (?:either )?version 2 1", "lesser version", 3, 0.96),
    ("lgpl-2.1", r"spdx license identifier lgpl 2 1(?: only| or later)?", "spdx lgpl", 4, 1.0),
    ("lgpl-2.1", r"(?:gnu )?lgpl(?: version)? v?2 1", "lgpl", 3, 0.94),
    ("lgpl-2.1", r"(?:gnu )?lgplv2 1", "lgplv2", 3, 0.94),
    ("lgpl-3.0", r"(?:gnu )?lesser general public license(?: as published by the free software foundation)? (?:either )?version 3", "lesser version", 3, 0.96),
    ("lgpl-3.0", r"spdx license identifier lgpl 3 0(?: only| or later)?", "spdx lgpl", 4, 1.0),
    ("lgpl-3.0", r"(?:gnu )?lgpl(?: version)? v?3(?: 0)?", "lgpl", 3, 0.94),
    ("lgpl-3.0", r"(?:gnu )?lgplv3", "lgplv3", 3, 0.94),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public", 3, 0.85),
    ("lgpl", r"lgpl", "lgpl", 1, 0.55),
    ("agpl-3.0", r"(?:gnu )?affero general public license(?: as published by the free software foundation)? (?:either )?version 3", "affero version", 4, 0.97),
    ("agpl-3.0", r"spdx license identifier agpl 3 0(?: only| or later)?", "spdx agpl", 4, 1.0),
    ("agpl-3.0", r"(?:gnu )?agpl(?: version)? v?3(?: 0)?", "agpl", 3, 0.94),
    ("agpl-3.0", r"(?:gnu )?agplv3", "agplv3", 3, 0.94),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "affero public", 3, 0.87),
    ("agpl", r"agpl", "agpl", 1, 0.6),
    ("gfdl-1.3", r"(?:gnu )?free documentation license version 1 3", "documentation version", 3, 0.96),
    ("gfdl-1.2", r"(?:gnu )?free documentation license version 1 2", "documentation version", 3, 0.96),
    ("gfdl", r"spdx license identifier gfdl 1 [123](?: only| or later)?", "spdx gfdl", 4, 1.0),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", "documentation free", 2, 0.87),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant texts", 4, 0.93),
    ("classpath-exception", r"classpath exception", "classpath exception", 2, 0.85),
    ("linking-exception", r"as a special exception (?:the copyright holders )?(?:of this library )?gives? you permission to link", "exception link", 3, 0.85),
    ("mpl-1.0", r"mozilla public license(?: version)? 1 0", "mozilla 0", 3, 0.96),
    ("mpl-1.1", r"mozilla public license(?: version)? 1 1", "mozilla public", 3, 0.96),
    ("mpl-1.1", r"spdx license identifier mpl 1 1", "spdx mpl", 4, 1.0),
    ("mpl-2.0", r"mozilla public license(?: version)? v?2(?: 0)?", "mozilla", 3, 0.96),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "mozilla subject", 4, 0.97),
    ("mpl-2.0", r"spdx license identifier mpl 2 0", "spdx mpl", 4, 1.0),
    ("mpl-2.0", r"mpl(?: version)? v?2(?: 0)?", "mpl", 3, 0.9),
    ("mpl-2.0", r"mozilla org mpl 2 0", "mozilla mpl", 4, 0.97),
    ("mpl", r"mozilla public licen[cs]e", "mozilla public", 2, 0.85),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license", "mozilla contents", 4, 0.93),
    ("epl-1.0", r"eclipse public license(?: version)? v?1(?: 0)?", "eclipse", 3, 0.96),
    ("epl-1.0", r"spdx license identifier epl 1 0", "spdx epl", 4, 1.0),
    ("epl-2.0", r"eclipse public license(?: version)? v?2(?: 0)?", "eclipse", 3, 0.96),
    ("epl-2.0", r"spdx license identifier epl 2 0", "spdx epl", 4, 1.0),
    ("epl", r"eclipse public licen[cs]e", "eclipse public", 2, 0.85),
    ("edl-1.0", r"eclipse distribution license(?: version)? v?1(?: 0)?", "eclipse distribution", 3, 0.95),
    ("cddl-1.0", r"common development and distribution license(?: version)? v?1 0", "distribution development", 3, 0.96),
    ("cddl-1.0", r"spdx license identifier cddl 1 0", "spdx cddl", 4, 1.0),
    ("cddl-1.1", r"common development and distribution license(?: version)? v?1 1", "distribution development", 3, 0.96),
    ("cddl", r"common development and distribution licen[cs]e", "distribution development", 2, 0.87),
    ("cddl", r"cddl", "cddl", 1, 0.6),
    ("cpl-1.0", r"common public license(?: version)? v?1 0", "common public", 3, 0.95),
    ("ipl-1.0", r"ibm public license(?: version)? v?1 0", "ibm public", 3, 0.95),
    ("cecill-2.1", r"cecill(?: free software license agreement)?(?: version)? v?2 1", "cecill", 3, 0.94),
    ("cecill", r"cecill(?: b| c)?", "cecill", 2, 0.85),
    ("eupl-1.1", r"european union public licen[cs]e(?: version)? v?1 1", "european union", 3, 0.95),
    ("eupl-1.1", r"eupl(?: version)? v?1 1", "eupl", 3, 0.95),
    ("eupl-1.2", r"eupl(?: version)? v?1 2", "eupl", 3, 0.95),
    ("eupl-1.2", r"european union public licen[cs]e(?: version)? v?1 2", "european union", 3, 0.96),
    ("osl-3.0", r"open software license(?: version)? v?3 0", "open software", 3, 0.95),
    ("osl-3.0", r"spdx license identifier osl 3 0", "spdx osl", 4, 1.0),
    ("afl-3.0", r"academic free license(?: version)? v?3 0", "academic free", 3, 0.95),
    ("afl-2.1", r"academic free license(?: version)? v?2 1", "academic free", 3, 0.95),
    ("artistic-1.0", r"artistic license(?: version)? v?1(?: 0)?", "artistic", 3, 0.95),
    ("artistic-2.0", r"artistic license(?: version)? v?2(?: 0)?", "artistic", 3, 0.95),
    ("artistic-2.0", r"spdx license identifier artistic 2 0", "spdx artistic", 4, 1.0),
    ("artistic", r"(?:the )?artistic licen[cs]e", "artistic", 2, 0.85),
    ("perl", r"under the same terms as perl itself", "perl same", 3, 0.95),
    ("ruby", r"under the same terms as ruby", "ruby same", 3, 0.93),
    ("ruby", r"(?:the )?ruby license", "ruby license", 2, 0.85),
    ("bsl-1.0", r"boost software license(?: version)? 1 0", "boost software", 3, 0.97),
    ("bsl-1.0", r"spdx license identifier bsl 1 0", "spdx bsl", 4, 1.0),
    ("bsl-1.0", r"boost software licen[cs]e", "boost software", 2, 0.88),
    ("bsl-1.0", r"boost org license 1 0", "boost org", 4, 0.97),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "liable express", 4, 0.93),
    ("zlib", r"altered source versions must be plainly marked as such", "altered plainly", 4, 0.95),
    ("zlib", r"spdx license identifier zlib", "spdx zlib", 4, 1.0),
    ("zlib", r"(?:the )?zlib(?: libpng)? license", "zlib license", 2, 0.9),
    ("libpng", r"(?:the )?libpng license", "libpng license", 2, 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 4, 0.98),
    ("unlicense", r"spdx license identifier unlicense", "spdx unlicense", 4, 1.0),
    ("unlicense", r"unlicense org", "unlicense org", 3, 0.93),
    ("unlicense", r"(?:the )?unlicense", "unlicense", 2, 0.88),
    ("wtfpl", r"do what the fuck you want to public license", "want what", 4, 0.98),
    ("wtfpl", r"wtfpl", "wtfpl", 3, 0.93),
    ("beerware", r"the beer ware license", "beer ware", 3, 0.95),
    ("beerware", r"you can buy me a beer in return", "beer return", 4, 0.9),
    ("postgresql", r"(?:the )?postgresql licen[cs]e", "postgresql", 3, 0.93),
    ("python-2.0", r"python software foundation license(?:(?: version)? v?2)?", "python foundation", 3, 0.93),
    ("python-2.0", r"psf license agreement", "psf agreement", 3, 0.93),
    ("python-2.0", r"spdx license identifier (?:psf|python) 2 0", "spdx 2", 4, 1.0),
    ("openssl", r"this product includes software developed by the openssl project", "openssl developed", 4, 0.95),
    ("openssl", r"(?:the )?openssl license", "openssl license", 2, 0.88),
    ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic eric", 4, 0.95),
    ("php-3.01", r"(?:the )?php license(?: version)? v?3 01", "php", 3, 0.96),
    ("php-3.0", r"(?:the )?php license(?: version)? v?3 0", "php", 3, 0.95),
    ("php", r"(?:the )?php license", "php license", 2, 0.85),
    ("zpl-2.1", r"zope public license(?: version)? v?2 1", "zope public", 3, 0.95),
    ("ncsa", r"university of illinois(?: ncsa)? open source license", "illinois open", 3, 0.95),
    ("ncsa", r"spdx license identifier ncsa", "spdx ncsa", 4, 1.0),
    ("ms-pl", r"microsoft public license", "microsoft public", 3, 0.94),
    ("ms-pl", r"spdx license identifier ms pl", "spdx pl", 4, 1.0),
    ("ms-rl", r"microsoft reciprocal license", "microsoft reciprocal", 3, 0.94),
    ("ms-eula", r"microsoft software license terms", "microsoft terms", 3, 0.9),
    ("ofl-1.1", r"sil open font license(?: version)? v?1 1", "font sil", 3, 0.97),
    ("ofl-1.1", r"spdx license identifier ofl 1 1", "spdx ofl", 4, 1.0),
    ("ofl-1.1", r"scripts sil org ofl", "sil ofl", 4, 0.96),
    ("ofl", r"open font licen[cs]e", "font open", 2, 0.88),
    ("odbl-1.0", r"open (?:data commons open )?database license", "database license", 3, 0.93),
    ("odbl-1.0", r"odbl", "odbl", 2, 0.8),
    ("odc-by-1.0", r"open data commons attribution license", "commons attribution", 3, 0.94),
    ("pddl-1.0", r"(?:open data commons )?public domain dedication and license", "dedication license", 3, 0.94),
    ("cc0-1.0", r"creative ?commons org publicdomain zero 1 0", "publicdomain zero", 4, 0.98),
    ("cc0-1.0", r"cc0 1 0(?: universal)?", "cc0 1", 3, 0.96),
    ("cc0-1.0", r"creative commons zero", "commons zero", 3, 0.93),
    ("cc0-1.0", r"spdx license identifier cc0 1 0", "spdx cc0", 4, 1.0),
    ("cc0-1.0", r"cc0", "cc0", 2, 0.85),
    ("cc-by-4.0", r"creative commons attribution 4 0(?: international)?", "commons attribution", 3, 0.96),
    ("cc-by-4.0", r"cc by 4 0", "cc by", 3, 0.94),
    ("cc-by-4.0", r"creativecommons org licenses by 4 0", "creativecommons by", 4, 0.98),
    ("cc-by-3.0", r"creative commons attribution 3 0(?: unported)?", "commons attribution", 3, 0.96),
    ("cc-by-3.0", r"cc by 3 0", "cc by", 3, 0.94),
    ("cc-by-3.0", r"creativecommons org licenses by 3 0", "creativecommons by", 4, 0.98),
    ("cc-by-sa-4.0", r"creative commons attribution share ?alike 4 0(?: international)?", "commons attribution", 4, 0.97),
    ("cc-by-sa-4.0", r"cc by sa 4 0", "cc sa", 4, 0.95),
    ("cc-by-sa-4.0", r"creativecommons org licenses by sa 4 0", "creativecommons sa", 4, 0.98),
    ("cc-by-sa-3.0", r"creative commons attribution share ?alike 3 0(?: unported)?", "commons attribution", 4, 0.97),
    ("cc-by-sa-3.0", r"cc by sa 3 0", "cc sa", 4, 0.95),
    ("cc-by-sa-3.0", r"creativecommons org licenses by sa 3 0", "creativecommons sa", 4, 0.98),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: \d \d)?", "cc|commons", 4, 0.94),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: \d \d)?", "cc|commons", 3, 0.94),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: \d \d)?", "cc|commons", 4, 0.95),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: \d \d)?", "cc|commons", 4, 0.95),
    ("cc-by-nc", r"creativecommons org licenses by nc \d \d", "creativecommons nc", 4, 0.97),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa \d \d", "creativecommons sa", 4, 0.97),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "cc|commons", 3, 0.9),
    ("cc-by", r"(?:cc by|creative commons attribution)", "cc|commons", 2, 0.85),
    ("cc", r"(?:a )?creative commons licen[cs]e", "creative commons", 2, 0.7),
    ("cc", r"some rights reserved", "rights some", 1, 0.5),
    ("upl-1.0", r"universal permissive license(?:(?: version)? v?1 0)?", "permissive universal", 3, 0.95),
    ("busl-1.1", r"business source license(?:(?: version)? v?1 1)?", "business source", 3, 0.94),
    ("busl-1.1", r"spdx license identifier busl 1 1", "spdx busl", 4, 1.0),
    ("sspl-1.0", r"server side public license", "server side", 3, 0.95),
    ("sspl-1.0", r"sspl", "sspl", 2, 0.8),
    ("elastic-2.0", r"elastic license(?: version)? v?2(?: 0)?", "elastic", 3, 0.95),
    ("elastic", r"elastic license", "elastic license", 2, 0.85),
    ("commons-clause", r"commons clause(?: license condition)?", "commons clause", 3, 0.9),
    ("json", r"the software shall be used for good not evil", "evil good", 4, 0.98),
    ("hpnd", r"historical permission notice and disclaimer", "historical permission", 3, 0.9),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee", "documentation fee", 4, 0.85),
    ("w3c", r"w3c software (?:notice and )?license", "w3c license", 3, 0.93),
    ("unicode", r"unicode license agreement data files and software", "unicode agreement", 3, 0.95),
    ("icu", r"icu license", "icu license", 2, 0.85),
    ("curl", r"(?:the )?curl license", "curl license", 2, 0.85),
    ("vim", r"(?:the )?vim license", "vim license", 2, 0.85),
    ("tcl", r"(?:the )?tcl tk license", "tcl license", 2, 0.85),
    ("qpl-1.0", r"q public license(?:(?: version)? v?1 0)?", "q public", 3, 0.9),
    ("npl-1.1", r"netscape public license(?:(?: version)? v?1 1)?", "netscape public", 3, 0.94),
    ("apsl-2.0", r"apple public source license(?:(?: version)? v?2 0)?", "apple public", 3, 0.94),
    ("apple-sample", r"apple sample code license", "apple sample", 3, 0.9),
    ("sun-binary", r"sun microsystems inc binary code license agreement", "sun binary", 3, 0.93),
    ("oracle-bcl", r"oracle binary code license agreement", "oracle binary", 3, 0.93),
    ("intel", r"intel open source license", "intel open", 3, 0.92),
    ("nvidia", r"nvidia (?:software )?license agreement", "nvidia agreement", 3, 0.9),
    ("mulan-2.0", r"mulan psl v2", "mulan psl", 3, 0.95),
    ("ecl-2.0", r"educational community license(?:(?: version)? v?2 0)?", "educational community", 3, 0.94),
    ("cpal-1.0", r"common public attribution license(?:(?: version)? v?1 0)?", "attribution common", 3, 0.95),
    ("rpl-1.5", r"reciprocal public license(?:(?: version)? v?1 5)?", "reciprocal public", 3, 0.93),
    ("sleepycat", r"(?:the )?sleepycat license", "sleepycat license", 3, 0.93),
    ("blueoak-1.0", r"blue oak model license(?:(?: version)? v?1 0 0)?", "oak model", 3, 0.95),
    ("openrail", r"(?:bigscience |creativeml )?open ?rail(?: m| \+\+ m)?(?: license)?", "openrail|rail", 3, 0.9),
    ("llama-community", r"llama \d(?: \d)? community license(?: agreement)?", "llama community", 3, 0.94),
    ("public-domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain", "public domain", 3, 0.85),
    ("public-domain", r"this (?:file|work|code|software) is in the public domain", "public domain", 3, 0.85),
    ("public-domain", r"public domain", "public domain", 1, 0.5),
    ("no-rights-reserved", r"no rights reserved", "rights no", 2, 0.7),
    ("proprietary", r"all rights reserved", "rights reserved", 1, 0.4),
    ("proprietary", r"proprietary and confidential", "proprietary confidential", 3, 0.7),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited", "unauthorized prohibited", 4, 0.9),
    ("proprietary", r"may not be reproduced (?:or )?(?:distributed )?(?:or )?transmitted in any form", "reproduced transmitted", 3, 0.75),
    ("proprietary", r"for internal use only", "internal only", 1, 0.3),
    ("proprietary", r"commercial license", "commercial license", 1, 0.4),
    ("eula", r"end user licen[cs]e agreement", "agreement user", 2, 0.7),
    ("dual-licensed", r"dual licensed under", "dual licensed", 2, 0.7),
    ("free-software", r"this (?:program|library|software) is free software", "free software", 2, 0.6),
    ("warranty-disclaimer", r"without (?:any )?warrant(?:y|ies) (?:or conditions )?of any kind", "without kind", 1, 0.3),
    ("warranty-disclaimer", r"without even the implied warranty of merchantability or fitness for a particular purpose", "merchantability fitness", 2, 0.4),
    ("warranty-disclaimer", r"the software is provided as is", "provided software", 1, 0.3),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 1, 0.3),
    ("license-notice", r"see (?:the )?(?:file )?(?:license|copying) (?:file )?for (?:details|more information)", "see for", 1, 0.3),
    ("license-notice", r"license text can be found", "license found", 1, 0.3),
    ("license-notice", r"(?:licensed|released|distributed) under (?:the )?[^ ]+(?: [^ ]+)? licen[cs]e", "under", 1, 0.3),
)

CALL, RULE = "map<string,array<struct<rule:int,rest:array<string>>>>", "array<struct<label:string,pattern:string,priority:long,confidence:double>>"
PRIORITIES = (1, 2, 3, 4)
#: Starts and stops are below it.
WIDE = 1 << 31
#: Steps of running sums, for up to 2**31 values.
STEPS = [1 << k for k in range(31)]


def normalized(text: Column) -> Column:
    """Lower-cased words parted by blanks, with a blank at either end; one blank without words."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    words = F.trim(F.regexp_replace(low, APART, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keywords() -> list[str]:
    return sorted({w for rule in RULES for w in rule[2].replace("|", " ").split()})


def called(found: Column) -> Column:
    """Numbers of the rules all of whose keywords are among those found."""
    calls: dict[str, list[dict]] = {}
    for k, rule in enumerate(RULES):
        for option in rule[2].split("|"):
            first, *rest = option.split()
            calls.setdefault(first, []).append({"rule": k, "rest": rest})
    by_word = F.from_json(F.lit(json.dumps(calls)), CALL)
    has_all = lambda c: F.forall(c["rest"], lambda w: F.array_contains(found, w))
    of = lambda w: F.transform(F.filter(F.try_element_at(by_word, w), has_all), lambda c: c["rule"])
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.coalesce(of(w), F.array().cast("array<int>")))))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each value op over it and all before it: each step doubles how many are in."""
    steps = F.filter(F.array(*[F.lit(k) for k in STEPS]), lambda k: k < F.size(values))
    return F.aggregate(steps, values, lambda a, k: F.transform(a, lambda x, i: F.when(i < k, x).otherwise(op(x, F.get(a, i - k)))))


def places(text: Column, pattern: Column) -> Column:
    """(start, stop) of every match, from the pieces between matches and the matches themselves."""
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x).cast("long"))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))

    def of(found: Column) -> Column:
        steps = F.zip_with(found["sizes"], F.slice(found["gaps"], 1, F.size(found["sizes"])), lambda x, y: x + y)
        stops = let(steps, lambda v: running(v, lambda x, y: x + y))
        return F.zip_with(stops, found["sizes"], lambda stop, size: F.struct((stop - size).alias("start"), stop.alias("stop")))

    return let(F.struct(sizes.alias("sizes"), gaps.alias("gaps")), of)


def detections(text: Column, found: Column) -> Column:
    """All matches of all signatures whose keywords are found, by start, the longest first, then by priority."""
    rules = F.from_json(F.lit(json.dumps([{"label": x, "pattern": f"(?<= )(?:{p})(?= )", "priority": n, "confidence": c} for x, p, _, n, c in RULES])), RULE)

    def of(rule: Column) -> Column:
        return F.transform(
            places(text, rule["pattern"]),
            lambda p: F.struct(p["start"].alias("start"), (-p["stop"]).alias("before"), (-rule["priority"]).alias("below"), p["stop"].alias("stop"), rule["priority"].alias("priority"), rule["confidence"].alias("confidence"), rule["label"].alias("label")),
        )

    return F.array_sort(F.flatten(F.transform(called(found), lambda k: let(F.get(rules, k), of))))


def resolved(found: Column) -> Column:
    """Without detections that lie within one of higher priority, or of the same and greater length. Those that can hold one
    come before it; for each priority the one that reaches furthest so far, and of these the longest, decides."""
    reach = lambda d, most: d["stop"] * WIDE + (WIDE - 1 - F.when(d["priority"] > most, 0).otherwise(d["start"]))
    furthest = lambda ds, p: let(F.transform(ds, lambda d: F.when(d["priority"] >= p, reach(d, p)).otherwise(-1)), lambda v: running(v, F.greatest))
    by_priority = lambda ds: F.array(*[furthest(ds, p) for p in PRIORITIES])
    stands = lambda ds, far: F.filter(ds, lambda d, i: F.get(F.get(far, (d["priority"] - 1).cast("int")), i) <= reach(d, d["priority"]))
    return let(found, lambda ds: let(by_priority(ds), lambda far: stands(ds, far)))


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: its words, base places, and the detections that stand."""
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(key, normalized(F.col("text")).alias("all_words"))
    rows = rows.select(key, (blanks(F.col("all_words")) - 1).cast("long").alias("n_words"), F.array_intersect(F.array(*[F.lit(w) for w in keywords()]), F.split("all_words", " ")).alias("keywords"), "all_words")
    rows = rows.withColumn("words", F.when(F.size("keywords") > 0, F.col("all_words"))).drop("all_words")
    rows = rows.withColumn("stands", F.when(F.col("words").isNotNull(), resolved(detections(F.col("words"), F.col("keywords")))))
    count = lambda phrase: F.regexp_count("words", F.lit(f"(?<= ){phrase}(?= )")).cast("long")
    for k, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"n{k}", F.coalesce(count(phrase), F.lit(0).cast("long")))
        some, d = F.col(f"n{k}") > 0, f" {phrase} "
        rows = rows.withColumn(f"first{k}", F.when(some, blanks(F.substring_index("words", d, 1))))
        rows = rows.withColumn(f"last{k}", F.when(some, F.col("n_words") - blanks(F.substring_index("words", d, -1)) - len(phrase.split())))
    base = F.array_compact(F.array(*[F.when(F.col(f"n{k}") > 0, label) for k, (_, label) in enumerate(BASE)]))
    own = F.coalesce(F.transform("stands", lambda d: d["label"]), F.array().cast("array<string>"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        key,
        "n_words",
        sum((F.col(f"n{k}") for k in range(1, len(BASE))), F.col("n0")).alias("n_base"),
        F.least(*[f"first{k}" for k in range(len(BASE))]).cast("long").alias("first_word"),
        F.greatest(*[f"last{k}" for k in range(len(BASE))]).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.coalesce(F.array_max(F.transform("stands", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.transform("stands", lambda d: F.struct(*[d[c].alias(c) for c in ("start", "stop", "priority", "confidence", "label")])).alias("stands"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("stands")
