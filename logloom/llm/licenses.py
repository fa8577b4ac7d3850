"""License scans by ordered signature rules, in DataFrame functions only.

Rules are regular expressions over the words of a text (A-Z lowered, joined by one blank). A keyword decides first which
texts, and then which rules, are looked at: a rule runs only where its keyword stands. Detections are intervals of
words; one is suppressed where another of at least its priority contains it. All happens within a row: no shuffle.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that always count, with their labels. Fixed values of the result's contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Names of licenses as their words stand after normalising, a keyword of each, and a label. The keyword is `licen` where
#: a name's alternatives share none; the form that may lack it has `under`.
FAMILIES = [
    ("mit", "mit", "licen", r"(?:mit|expat|x11)(?: x11)?"),
    ("apache", "apache", "apache", r"apache(?: software)?(?: license)?(?: v(?:ersion)?)? ?(?:1 0|1 1|2 0|2)?"),
    ("gpl", "gpl", "gpl", r"(?:gnu )?gpl ?(?:v(?:ersion)? ?)?[123]?(?: 0)?(?: or later| only)?"),
    ("gpl", "gpl", "general", r"(?:the )?gnu general public license"),
    ("lgpl", "lgpl", "lgpl", r"(?:gnu )?lgpl ?(?:v(?:ersion)? ?)?(?:2 1|2|3)?(?: 0)?(?: or later| only)?"),
    ("lgpl", "lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl", "lgpl", "library", r"(?:gnu )?library general public license"),
    ("agpl", "agpl", "agpl", r"(?:gnu )?agpl ?(?:v(?:ersion)? ?)?3?(?: 0)?(?: or later| only)?"),
    ("agpl", "agpl", "affero", r"(?:gnu )?affero general public license"),
    ("gfdl", "gfdl", "documentation", r"(?:gnu )?free documentation license"),
    ("bsd", "bsd", "bsd", r"(?:(?:new|modified|simplified|revised|original|[0234] clause) )?bsd(?: [0234] clause)?"),
    ("mpl", "mpl", "mpl", r"mpl ?(?:1 0|1 1|2 0)?"),
    ("mpl", "mpl", "mozilla", r"mozilla public license"),
    ("epl", "epl", "eclipse", r"eclipse (?:public|distribution) license"),
    ("epl", "epl", "epl", r"epl ?(?:1 0|2 0)?"),
    ("cddl", "cddl", "cddl", r"cddl ?(?:1 0|1 1)?"),
    ("cddl", "cddl", "development", r"common development and distribution license"),
    ("isc", "isc", "isc", r"isc"),
    ("zlib", "zlib", "zlib", r"(?:zlib|zlib libpng)"),
    ("boost", "boost", "boost", r"boost(?: software)?"),
    ("artistic", "artistic", "artistic", r"artistic(?: license)?(?: 1 0| 2 0)?"),
    ("unlicense", "unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", r"wtfpl"),
    ("cc0", "cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc-by", "cc", r"cc by(?: [1234] [05])?"),
    ("cc-by-sa", "cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?"),
    ("cc-by-nc", "cc-by-nc", "cc", r"cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", "cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by", "cc-by", "attribution", r"creative commons attribution(?: [1234] [05])?(?: international| unported)?"),
    ("cc-by-sa", "cc-by-sa", "sharealike", r"creative commons attribution sharealike"),
    ("cc-by-nc", "cc-by-nc", "noncommercial", r"creative commons attribution noncommercial"),
    ("eupl", "eupl", "eupl", r"eupl ?(?:1 [012])?"),
    ("eupl", "eupl", "european", r"european union public licen[cs]e"),
    ("ms-pl", "ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("python", "python", "licen", r"(?:python(?: software foundation)?|psf)"),
    ("postgresql", "postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", "openssl", r"openssl"),
    ("ofl", "ofl", "font", r"(?:sil )?open font license"),
    ("osl", "osl", "osl", r"osl ?(?:1 0|2 [01]|3 0)?"),
    ("ncsa", "ncsa", "ncsa", r"(?:university of illinois )?ncsa"),
    ("afl", "afl", "academic", r"academic free license"),
    ("bsl", "busl", "business", r"business source license"),
    ("sspl", "sspl", "server", r"server side public license"),
    ("odbl", "odbl", "database", r"open (?:data commons )?(?:open )?database license"),
    ("ruby", "ruby", "ruby", r"ruby"),
    ("vim", "vim", "vim", r"vim"),
    ("php", "php", "php", r"php"),
]
#: How a name is used: name of the form, priority, pattern around the name (@); # makes the word before optional after names that end in license.
FORMS = [
    ("named", 1, r"@(?: licen[cs]e)#(?: agreement)?"),
    ("licensed", 2, r"(?:dual )?licen[cs]ed (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?@(?: licen[cs]e)?(?:,? v(?:ersion)? ?[0-9](?: [0-9])?)?"),
    ("released", 2, r"(?:released|distributed|published|available|provided|made available) under (?:the )?(?:terms of )?(?:the )?@(?: licen[cs]e)?"),
    ("spdx", 3, r"spdx licen[cs]e identifier @"),
    ("subject", 2, r"(?:subject to|governed by|according to|see) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?@(?: licen[cs]e)#"),
]
#: Rules of their own: label, keyword, priority, pattern.
CLAUSES = [
    ("mit", "permission", 3, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", 2, r"shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution", 3, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", 2, r"redistributions (?:of source code must retain|in binary form must reproduce) the above copyright notice"),
    ("bsd", "endorse", 2, r"used to endorse or promote products derived from this software"),
    ("isc", "permission", 3, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache", "compliance", 3, r"you may not use this file except in compliance with the license"),
    ("apache", "apache", 2, r"apache license version 2(?: 0)?"),
    ("apache", "apache", 3, r"http www apache org licenses license 2 0"),
    ("gpl", "redistribute", 3, r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "general", 2, r"gnu general public license (?:as published by the free software foundation|v(?:ersion)? ?[123])"),
    ("lgpl", "redistribute", 3, r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute", 3, r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "gplv2", 1, r"gplv2"),
    ("gpl", "gplv3", 1, r"gplv3"),
    ("lgpl", "lgplv3", 1, r"lgplv3"),
    ("mpl", "mozilla", 3, r"subject to the terms of the mozilla public license v(?:ersion)? ?2 0"),
    ("zlib", "misrepresented", 3, r"the origin of this software must not be misrepresented"),
    ("boost", "boost", 3, r"distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", 3, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public", 2, r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public", 1, r"public domain"),
    ("cc", "creative", 1, r"creative commons(?: licen[cs]e)?"),
    ("cc0", "cc0", 2, r"cc0 1 0 universal public domain dedication"),
    ("warranty-disclaimer", "warranty", 1, r"(?:without warranty of any kind|provided as is without (?:any )?warranty)"),
    ("warranty-disclaimer", "merchantability", 1, r"merchantability (?:or )?fitness for a particular purpose"),
    ("proprietary", "proprietary", 2, r"proprietary and confidential"),
    ("proprietary", "confidential", 1, r"confidential information of"),
    ("proprietary", "rights", 1, r"all rights reserved"),
    ("copyright", "copyright", 1, r"copyright(?: c)? (?:19|20)[0-9][0-9]"),
    ("eula", "user", 2, r"end user licen[cs]e agreement"),
    ("noncommercial", "commercial", 1, r"(?:for )?non commercial use only"),
    ("mit", "sublicense", 3, r"rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "permission", 2, r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "opensource", 3, r"opensource org licenses mit(?: license)?(?: php)?"),
    ("mit", "attribution", 2, r"mit no attribution license"),
    ("mit", "modern", 2, r"mit license modern variant"),
    ("bsd", "endorse", 3, r"neither the name of(?: [a-z0-9]{1,20}){1,14} nor the names of (?:its|their) contributors may be used to endorse or promote products"),
    ("bsd", "redistribution", 2, r"redistribution and use (?:of this software )?in source and binary forms"),
    ("bsd", "redistributions", 2, r"redistributions must (?:retain|reproduce) the above copyright notice"),
    ("bsd", "opensource", 3, r"opensource org licenses bsd (?:license(?: php)?|[23] clause)"),
    ("bsd", "bsd", 2, r"bsd (?:style|like|type) licen[cs]e"),
    ("bsd", "bsd", 3, r"bsd (?:zero|0|1|2|3|4) clause (?:patent |clear )?licen[cs]e"),
    ("bsd", "redistribution", 2, r"redistribution and use in source and binary forms are permitted provided that"),
    ("apache", "contributor", 3, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", "applicable", 3, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "governing", 3, r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "endorse", 3, r"the names apache(?: server)? and apache (?:group|software foundation) must not be used to endorse"),
    ("apache", "apache", 3, r"apache org licenses license (?:1 [01]|2 0)(?: txt| html)?"),
    ("apache", "apache", 3, r"licensed under the apache license version 2 0 the license"),
    ("gpl", "redistribute", 2, r"is free software you can redistribute it and or modify it"),
    ("gpl", "useful", 2, r"is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received", 3, r"you should have received a copy of the gnu general public license"),
    ("gpl", "version", 2, r"either version [123] of the license or at your option any later version"),
    ("gpl", "gnu", 3, r"gnu org (?:licenses|copyleft) gpl(?: [123] 0)?(?: html| txt)?"),
    ("gpl", "gpl", 2, r"gpl [123] 0 (?:only|or later)"),
    ("gpl", "gpl", 2, r"gpl ?v(?:ersion)? ?[123](?: or (?:later|newer|above)| only)?"),
    ("gpl", "exception", 2, r"general public license(?: version [23])? with (?:the )?(?:classpath|linking|runtime library|font|bison|autoconf) exception"),
    ("lgpl", "received", 3, r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "gnu", 3, r"gnu org licenses (?:lgpl|lesser)(?: [23] [01])?(?: html| txt)?"),
    ("lgpl", "lgpl", 2, r"lgpl ?v(?:ersion)? ?(?:2 1|2|3)(?: or (?:later|newer|above)| only)?"),
    ("lgpl", "redistribute", 3, r"you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl", "lesser", 2, r"gnu library or lesser general public license"),
    ("agpl", "received", 3, r"you should have received a copy of the gnu affero general public license"),
    ("agpl", "gnu", 3, r"gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("agpl", "agpl", 2, r"agpl ?v(?:ersion)? ?[13](?: or (?:later|newer|above)| only)?"),
    ("agpl", "remote", 2, r"remote network interaction use with the gnu general public license"),
    ("gfdl", "document", 3, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "gnu", 3, r"gnu org licenses fdl(?: 1 [123])?(?: html| txt)?"),
    ("mpl", "mozilla", 3, r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mozilla", 3, r"the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl", "basis", 2, r"software distributed under the license is distributed on an as is basis without warranty of any kind"),
    ("mpl", "incompatible", 3, r"incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl", "mozilla", 2, r"mozilla public license v(?:ersion)? ?(?:1 [01]|2 0)"),
    ("epl", "accompanying", 3, r"accompanying materials are made available under the terms of the eclipse (?:public|distribution) license"),
    ("epl", "eclipse", 2, r"eclipse public license v(?:ersion)? ?[12](?: 0)?"),
    ("cpl", "common", 2, r"common public license(?: v(?:ersion)? ?(?:0 5|1 0))?"),
    ("cddl", "development", 3, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "cddl", 2, r"cddl license"),
    ("zlib", "altered", 3, r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", "zlib", 2, r"zlib libpng license(?: with acknowledgement)?"),
    ("libpng", "png", 2, r"(?:png reference library|libpng) license"),
    ("boost", "boost", 3, r"boost org license 1 0 txt"),
    ("boost", "organization", 3, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost", "boost", 2, r"boost software license(?: v(?:ersion)? ?1 0)?"),
    ("unlicense", "unlicense", 2, r"unlicense org"),
    ("unlicense", "dedicate", 3, r"dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "want", 3, r"do what the f[a-z]{1,4} you want to public license"),
    ("cc-by", "creativecommons", 3, r"creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "creativecommons", 3, r"creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nc", "creativecommons", 3, r"creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nd", "creativecommons", 3, r"creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-nc-sa", "creativecommons", 3, r"creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "creativecommons", 3, r"creativecommons org licenses by nc nd [1234] [05]"),
    ("cc0", "creativecommons", 3, r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", 3, r"creativecommons org publicdomain mark 1 0"),
    ("cc0", "waived", 3, r"waived all copyright and related or neighboring rights"),
    ("cc", "creative", 2, r"licensed under a creative commons"),
    ("cc-by-nc-sa", "noncommercial", 3, r"creative commons attribution noncommercial share ?alike(?: [1234] [05])?(?: international| unported)?"),
    ("cc-by-nc-nd", "noderiv", 3, r"creative commons attribution noncommercial noderiv(?:s|atives)(?: [1234] [05])?(?: international| unported)?"),
    ("cc-by-nd", "noderiv", 3, r"creative commons attribution noderiv(?:s|atives)(?: [1234] [05])?(?: international| unported)?"),
    ("isc", "permission", 3, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "isc", 2, r"internet (?:systems|software) consortium isc license"),
    ("hpnd", "permission", 3, r"permission to use copy modify distribute and sell this software and its documentation for any purpose"),
    ("hpnd", "historical", 2, r"historical permission notice and disclaimer"),
    ("postgresql", "permission", 3, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("tcl", "authors", 3, r"the authors hereby grant permission to use copy modify distribute and license this software"),
    ("ntp", "permission", 2, r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee"),
    ("python", "licensee", 3, r"psf is making python available to licensee on an as is basis"),
    ("python", "python", 3, r"python software foundation license version 2"),
    ("python", "beopen", 3, r"beopen python open source license agreement"),
    ("python", "cnri", 2, r"cnri (?:open source )?license agreement"),
    ("ruby", "bsdl", 3, r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("php", "php", 3, r"the php license version [23] [0-9]{1,2}"),
    ("openssl", "openssl", 3, r"openssl (?:and )?(?:original )?ssleay license"),
    ("openssl", "whatsoever", 3, r"redistributions of any form whatsoever must retain the following acknowledge?ment"),
    ("perl", "perl", 3, r"redistribute it and or modify it under the same terms as perl itself"),
    ("artistic", "artistic", 2, r"the (?:clarified )?artistic license(?: v(?:ersion)? ?[12] ?0?)?"),
    ("ofl", "font", 3, r"this font software is licensed under the sil open font license version 1 [01]"),
    ("ofl", "font", 2, r"sil open font license(?: version)?(?: 1 [01])?"),
    ("eupl", "eupl", 3, r"licensed under the eupl(?: version)? 1 [012]"),
    ("ms-pl", "microsoft", 2, r"microsoft (?:limited )?public license(?: ms l?pl)?"),
    ("proprietary", "microsoft", 2, r"microsoft software license terms"),
    ("osl", "open", 3, r"open software license(?: v(?:ersion)? ?(?:1 [01]|2 [01]|3 0))?"),
    ("afl", "academic", 3, r"licensed under the academic free license version [123] [0-2]"),
    ("cecill", "cecill", 2, r"cecill(?: [abc])?(?: free software)? licen[cs]e(?: agreement)?"),
    ("cecill", "cecill", 3, r"par la licence cecill(?: [bc])?"),
    ("sleepycat", "sleepycat", 2, r"sleepycat license"),
    ("beerware", "beer", 2, r"the beer ?ware license(?: revision [0-9]{1,2})?"),
    ("json", "json", 2, r"the json license"),
    ("ncsa", "illinois", 3, r"university of illinois (?:ncsa )?open source license"),
    ("upl", "permissive", 2, r"universal permissive license(?: v(?:ersion)? ?1 0)?"),
    ("busl", "business", 2, r"business source license(?: 1 [01])?"),
    ("sspl", "side", 2, r"server side public license(?: v(?:ersion)? ?1)?"),
    ("elastic", "elastic", 2, r"elastic license(?: 2 0| v2)?"),
    ("commons-clause", "clause", 2, r"commons clause license condition"),
    ("polyform", "polyform", 2, r"polyform (?:noncommercial|small business|strict|shield|perimeter|internal use) license(?: 1 0 [01])?"),
    ("odbl", "odbl", 3, r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "odc", 2, r"open data commons attribution license(?: odc by)"),
    ("pddl", "dedication", 2, r"public domain dedication and license(?: pddl)?"),
    ("llama", "llama", 2, r"llama (?:[234] )?(?:[1-3] )?community license agreement"),
    ("rail", "rail", 2, r"(?:bigscience|creativeml|bigcode) (?:open )?rail(?: m)? license"),
    ("gemma", "gemma", 2, r"gemma (?:license|terms of use license)"),
    ("w3c", "w3c", 2, r"w3c software(?: notice)? and(?: document)? license"),
    ("unicode", "unicode", 2, r"unicode(?: inc)? license agreement"),
    ("curl", "curl", 2, r"curl license"),
    ("imagemagick", "imagemagick", 2, r"imagemagick license"),
    ("ijg", "jpeg", 2, r"independent jpeg group s? ?license"),
    ("ftl", "freetype", 2, r"(?:the )?freetype (?:project )?license"),
    ("zpl", "zope", 2, r"zope public license(?: v(?:ersion)? ?[12] [01])?"),
    ("qpl", "public", 2, r"q public license(?: version 1 0)?"),
    ("nosl", "netizen", 2, r"netizen open source license"),
    ("nasa", "nasa", 2, r"nasa open source agreement license"),
    ("intel", "intel", 2, r"intel (?:simplified software|open source|sample source code) license"),
    ("ecl", "educational", 2, r"educational community license(?: version)?(?: 2 0)?"),
    ("rpl", "reciprocal", 2, r"reciprocal public license(?: 1 [15])?"),
    ("cpal", "attribution", 2, r"common public attribution license(?: version)?(?: 1 0)?"),
    ("apsl", "apple", 2, r"apple public source license(?: version)?(?: [12] [0-2])?"),
    ("proprietary", "property", 2, r"licensed materials property of"),
    ("proprietary", "sold", 2, r"this software is licensed not sold"),
    ("proprietary", "permission", 2, r"without (?:the )?(?:express |prior ){1,2}(?:written )?(?:permission|consent and permission) of the (?:copyright )?(?:owner|publisher|author|holder)s?"),
    ("proprietary", "confidential", 2, r"(?:strictly |company )?confidential do not (?:copy|distribute|disclose)"),
    ("proprietary", "proprietary", 1, r"proprietary (?:and|or) trade secret"),
    ("proprietary", "evaluation", 2, r"evaluation licen[cs]e(?: agreement)?"),
    ("proprietary", "commercial", 1, r"commercial licen[cs]e(?: agreement)?"),
    ("proprietary", "agreement", 1, r"software licen[cs]e agreement"),
    ("eula", "agree", 3, r"by (?:installing|downloading|using|copying)(?: or [a-z]{2,11})? (?:the|this) software you agree to (?:be bound by )?the terms of this licen[cs]e"),
    ("noncommercial", "commercial", 1, r"(?:for )?(?:personal |private |academic )?non ?commercial purposes(?: only)?"),
    ("noncommercial", "commercial", 2, r"(?:may|must) not be used for commercial purposes"),
    ("noncommercial", "commercial", 1, r"not for commercial use"),
    ("copyright", "copyright", 1, r"copyright (?:c )?(?:by )?the (?:authors|contributors|original authors)"),
    ("copyright", "copyright", 1, r"(?:the )?copyright holders? and contributors"),
    ("copyright", "copyrighted", 1, r"copyrighted (?:material|work|software)"),
    ("warranty-disclaimer", "warranty", 2, r"as is without warranty of any kind(?: either)? express(?:ed)? or implied"),
    ("warranty-disclaimer", "warranties", 1, r"(?:disclaims? all|any express or implied|no express or implied) warranties"),
    ("warranty-disclaimer", "warranty", 1, r"without even the implied warranty of"),
    ("warranty-disclaimer", "warranty", 1, r"(?:absolutely no|there is no|no) warranty"),
    ("multi-license", "licensed", 1, r"(?:dual|triple|multi) licensed"),
    ("multi-license", "relicensed", 1, r"relicensed (?:under|from)"),
    ("mit", "licen", 2, r"(?:mit|expat) licen[cs]ed"),
    ("apache", "apache", 2, r"apache(?: 2(?: 0)?)? licen[cs]ed"),
    ("bsd", "bsd", 2, r"bsd(?: [0234] clause)? licen[cs]ed"),
    ("gpl", "gpl", 2, r"gpl(?: ?v?[123])? licen[cs]ed"),
    ("isc", "isc", 2, r"isc licen[cs]ed"),
    ("mit", "licen", 2, r"licen[cs]e (?:is )?(?:the )?(?:mit|expat)"),
    ("apache", "apache", 2, r"licen[cs]e (?:is )?(?:the )?apache(?: 2(?: 0)?)?"),
    ("bsd", "bsd", 2, r"licen[cs]e (?:is )?(?:the )?bsd(?: [0234] clause)?"),
    ("gpl", "gpl", 2, r"licen[cs]e (?:is )?(?:the )?(?:gnu )?gpl(?: ?v?[123])?"),
    ("isc", "isc", 2, r"licen[cs]e (?:is )?(?:the )?isc"),
    ("mpl", "mpl", 2, r"licen[cs]e (?:is )?(?:the )?mpl(?: 1 1| 2 0)?"),
    ("mit", "under", 2, r"(?:is|are|used|comes|shipped|offered) under (?:the )?mit"),
    ("apache", "apache", 2, r"(?:is|are|used|comes|shipped|offered) under (?:the )?apache(?: 2(?: 0)?)?"),
    ("bsd", "bsd", 2, r"(?:is|are|used|comes|shipped|offered) under (?:the )?bsd(?: [0234] clause)?"),
    ("isc", "isc", 2, r"(?:is|are|used|comes|shipped|offered) under (?:the )?isc"),
    ("mpl", "mpl", 2, r"(?:is|are|used|comes|shipped|offered) under (?:the )?mpl(?: 1 1| 2 0)?"),
]
#: A text is looked at if any of these stands in it in some case, or `under` and one of the words beside it. Each rule
#: implies one of them: single words, as any punctuation may part two.
GATES = ["licen", "copyright", "gpl", "reserved", "domain", "warrant", "commons", "proprietary", "confidential", "wtfpl", "redistribut", "permission", "substantial", "endorse", "misrepresented", "merchantab", "commercial"]
BESIDE_UNDER = ["released", "distributed", "published", "available", "provided", "mit", "apache", "bsd", "isc", "mpl"]


def rules() -> list[dict]:
    """All rules in order: clauses first, then each family in each form."""
    out = [{"rule": f"clause-{i:03d}", "label": lab, "kw": kw, "prio": p, "rx": rx} for i, (lab, kw, p, rx) in enumerate(CLAUSES)]
    for i, (_, lab, kw, name) in enumerate(FAMILIES):
        more = "?" if name.endswith(("license", "licen[cs]e")) else ""
        out += [{"rule": f"family-{i:03d}-{form}", "label": lab, "kw": "under" if kw == "licen" and form == "released" else kw, "prio": p, "rx": rx.replace("#", more).replace("@", f"(?:{name.strip()})")} for form, p, rx in FORMS]
    for r in out:
        r["rx"] = f"(?:^|(?<= ))(?:{r['rx']})(?= |$)"
    return out


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lowering.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RULE = "array<struct<rule: string, label: string, kw: string, prio: int, rx: string>>"


def _literal(items: list[dict]) -> Column:
    return F.from_json(F.lit(json.dumps(items)), _RULE)


def _found(text: str, rule: str) -> str:
    """SQL: intervals of words where a rule's pattern stands in a text, in order."""
    blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    return (
        f"aggregate(filter(zip_with(split({text}, {rule}.rx, -1), regexp_extract_all({text}, {rule}.rx, 0), (g, h) -> named_struct('gap', g, 'hit', h)), x -> x.hit is not null), "
        f"named_struct('at', 0, 'out', cast(array() as array<struct<lo: int, hi: int, prio: int, label: string, rule: string>>)), "
        f"(s, m) -> named_struct('at', s.at + {blanks('m.gap')} + {blanks('m.hit')}, 'out', concat(s.out, array(named_struct('lo', s.at + {blanks('m.gap')}, 'hi', s.at + {blanks('m.gap')} + {blanks('m.hit')}, 'prio', {rule}.prio, 'label', {rule}.label, 'rule', {rule}.rule)))), "
        "s -> s.out)"
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs with n_words, base (places of the fixed phrases) and detections (kept after suppression), arrays of (lo, hi, prio, label, rule) with first and last word.

    Null and empty texts have no words and empty arrays. Each row is scanned by itself and whole, so repeated rows and
    ties don't matter; equal intervals of equal priority keep the rule of lesser name. Other columns stay, ones of the
    new names are replaced; an empty table gives an empty result.
    """
    d = docs.drop("n_words", "base", "detections")
    low = F.lower("text")
    any_of = lambda words: reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in words])
    gate = any_of(GATES) | (F.contains(low, F.lit("under")) & any_of(BESIDE_UNDER))
    d = d.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("long"))
    d = d.withColumn("_norm", F.when(gate, F.array_join(F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(WORD), 0), " ")))
    base = [{"rule": k, "label": v, "kw": k, "prio": 9, "rx": f"(?:^|(?<= )){k}(?= |$)"} for k, v in BASE.items()]
    every = "flatten(transform(filter({lit}, r -> contains(_norm, r.kw) and regexp_like(_norm, r.rx)), r -> {found}))"
    d = d.withColumn("_base_rules", F.when(F.col("_norm").isNotNull(), _literal(base))).withColumn("_rules", F.when(F.col("_norm").isNotNull(), _literal(rules())))
    d = d.withColumn("base", F.coalesce(F.expr(every.format(lit="_base_rules", found=_found("_norm", "r"))), F.expr("cast(array() as array<struct<lo: int, hi: int, prio: int, label: string, rule: string>>)")))
    d = d.withColumn("_all", F.expr(f"array_sort(transform({every.format(lit='_rules', found=_found('_norm', 'r'))}, x -> struct(x.lo as lo, -x.hi as nhi, -x.prio as nprio, x.rule as rule, x.label as label)))"))
    keep = (
        "aggregate(_all, named_struct('far', array(-1, -1, -1), 'out', cast(array() as array<struct<lo: int, hi: int, prio: int, label: string, rule: string>>)), "
        "(s, x) -> if(array_max(slice(s.far, -x.nprio, 3)) >= -x.nhi, s, named_struct('far', transform(s.far, (f, i) -> if(i = -x.nprio - 1, greatest(f, -x.nhi), f)), 'out', concat(s.out, array(named_struct('lo', x.lo, 'hi', -x.nhi, 'prio', -x.nprio, 'label', x.label, 'rule', x.rule))))), "
        "s -> s.out)"
    )
    d = d.withColumn("detections", F.coalesce(F.expr(keep), F.expr("cast(array() as array<struct<lo: int, hi: int, prio: int, label: string, rule: string>>)")))
    return d.drop("_norm", "_rules", "_base_rules", "_all")


def op5(docs: DataFrame) -> DataFrame:
    d = scan_licenses(docs.select("doc_id", "text"))
    label = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda b: b["label"])))
    best = F.coalesce(F.array_max(F.transform("detections", lambda x: x["prio"])), F.lit(0))
    return d.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["lo"])).cast("long").alias("first_word"), F.array_max(F.transform("base", lambda x: x["lo"])).cast("long").alias("last_word"),
        F.array_join(label("base"), ",").alias("base_labels"), F.array_join(label(F.concat("base", "detections")), ",").alias("labels"),
        F.greatest(F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.5, 0.8, 1.0)]), best + 1), F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"),
    )
