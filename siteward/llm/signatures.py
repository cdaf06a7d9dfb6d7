"""Signatures of licence texts, notices and headers, written by hand.

Fixed values: wordings of public licences, as regexes over lower-case words joined by single spaces.
Every match of a signature holds its keyword as a whole word.
"""

L = r"licen[cs]e"
#: (label, keyword, signature)
SIGNATURES = (
    # MIT and its kin
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "noninfringement", r"fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    ("mit", "warranty", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", "copyright", r"except as contained in this notice the name of the x consortium shall not be used (?:[^ ]+ ){0,13}?copyright"),
    ("x11", "consortium", r"the x consortium be liable for any claim"),
    ("mit-modern", "advertising", r"may not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("icu", "copyright", r"provided that the above copyright notice s and this permission notice appear in all copies of the software"),
    ("hpnd", "hereby", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("ntp", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:with or )?without fee is hereby granted"),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "warranties", r"the author disclaims all warranties with regard to this software including all implied warranties"),
    ("isc", "tortious", r"an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("curl", "hereby", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("fair", "copyright", r"usage of the works is permitted provided that this instrument is retained with the works (?:[^ ]+ ){0,10}?copyright"),
    ("fsfap", "royalty", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("beerware", "beerware", rf"(?:the )?beerware {L}"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    # BSD
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3", "contributors", r"neither the name of the (?:[a-z0-9]+ ){1,6}nor the names of its contributors"),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "regents", r"this software is provided by the regents and contributors as is"),
    ("bsd", "contributors", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd-2", "disclaimed", r"this software is provided by the (?:author|authors|freebsd project) as is and any express or implied warranties (?:[^ ]+ ){0,26}?are disclaimed"),
    ("bsd-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-patent", "patent", r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants (?:[^ ]+ ){0,33}?patent"),
    ("bsd-0", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd-source", "regents", r"the regents of the university of california all rights reserved"),
    ("cmu", "carnegie", r"carnegie mellon university disclaims all warranties"),
    # Apache
    ("apache-2", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2", "warranties", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", "governing", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "trademarks", r"this license does not grant permission to use the trade names trademarks service marks or product names of the licensor"),
    ("apache-1.1", "acknowledgment", r"this product includes software developed by the apache software foundation (?:[^ ]+ ){0,13}?acknowledgment"),
    ("apache-1.1", "endorse", r"the names apache and apache software foundation must not be used to endorse or promote products"),
    ("apache-1.0", "apache", r"products derived from this software may not be called apache"),
    # GNU
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "foundation", r"as published by the free software foundation either version 2 of the license"),
    ("gpl-2", "foundation", r"as published by the free software foundation version 2"),
    ("gpl-3", "foundation", r"as published by the free software foundation either version 3 of the license"),
    ("gpl-3", "foundation", r"as published by the free software foundation version 3"),
    ("gpl", "merchantability", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", "along", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2", "temple", r"free software foundation inc 59 temple place"),
    ("gpl-2", "franklin", r"free software foundation inc 51 franklin (?:st|street) fifth floor boston"),
    ("gpl-2", "verbatim", r"gnu general public license version 2 june 1991 (?:[^ ]+ ){0,20}?verbatim"),
    ("gpl-3", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "tivoization", r"tivoization"),
    ("gpl-classpath", "classpath", r"(?:with )?(?:the )?(?:gnu )?classpath exception"),
    ("gpl-classpath", "linking", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception", "gcc", r"gcc runtime library exception"),
    ("gpl-autoconf", "autoconf", r"autoconf (?:configure script )?exception"),
    ("gpl-bison", "bison", r"(?:special exception|exception) (?:[^ ]+ ){0,10}?bison"),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "along", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.1", "lesser", r"the precise terms and conditions for copying distribution and modification follow pay close attention (?:[^ ]+ ){0,20}?lesser"),
    ("lgpl-3", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl-2", "library", r"gnu library general public license version 2 june 1991"),
    ("agpl-3", "affero", r"as published by the free software foundation either version 3 of the license (?:[^ ]+ ){0,10}?affero"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3", "affero", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl-1", "affero", r"affero general public license version 1"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    # Mozilla, Eclipse and other weak copyleft
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2", "secondary", r"incompatible with secondary licenses"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "alternatively", r"alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("mpl-1.0", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl", "netscape", rf"netscape public {L}"),
    ("epl-1", "eclipse", r"which accompanies this distribution and is available at https? www eclipse org legal epl v10"),
    ("epl-2", "eclipse", r"which accompanies this distribution and is available at https? www eclipse org legal epl (?:2 0|v20)"),
    ("epl-2", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("edl", "eclipse", rf"eclipse distribution {L}(?: v ?1 0)?"),
    ("cddl", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", "common", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("ipl", "ibm", rf"ibm public {L}(?: v(?:ersion)? 1 0)?"),
    ("spl", "sun", rf"sun public {L}"),
    ("sissl", "sun", rf"sun industry standards source {L}"),
    ("apsl", "apple", rf"apple public source {L}(?: version)?(?: [12] [0-2])?"),
    ("osl-3", "open", rf"open software {L} (?:v|version|v ?)?3 0"),
    ("afl-3", "academic", rf"academic free {L} (?:v|version|v ?)?3 0"),
    ("ms-pl", "microsoft", rf"microsoft public {L}"),
    ("ms-rl", "microsoft", rf"microsoft reciprocal {L}"),
    ("ms-pl", "copyright", r"each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution"),
    ("cecill", "cecill", rf"cecill(?: free software)?(?: {L})?(?: agreement)?(?: [abc])?(?: v(?:ersion)?)?(?: [12](?: [01])?)?"),
    ("eupl-1.2", "union", r"licensed under the eupl version 1 2 (?:[^ ]+ ){0,13}?union"),
    ("eupl", "eupl", r"you may not use this work except in compliance with the licence (?:[^ ]+ ){0,20}?eupl"),
    ("qpl", "q", rf"q public {L}"),
    ("sleepycat", "sleepycat", rf"sleepycat(?: software)?(?: {L})?"),
    ("ruby", "ruby", rf"(?:the )?ruby(?: s)? {L}"),
    ("vim", "vim", rf"vim {L}"),
    ("tcl", "tcl", rf"tcl tk {L}"),
    ("perl", "perl", r"under the same terms as perl(?: itself)?"),
    ("artistic-1", "artistic", r"the intent of this document is to state the conditions under which a package may be copied (?:[^ ]+ ){0,26}?artistic"),
    ("artistic-2", "artistic", r"the artistic license 2 0 copyright c 2000 2006 the perl foundation"),
    # Permissive with names of their own
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "removed", r"this notice may not be removed or altered from any source distribution"),
    ("libpng", "png", r"the png reference library is supplied as is"),
    ("bsl", "boost", r"distributed under the boost software license version 1 0"),
    ("bsl", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "benefit", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("unlicense", "dedicate", r"dedicate any and all copyright interest in the software to the public domain"),
    ("cc0", "waived", r"to the extent possible under law (?:[^ ]+ ){0,13}?has waived all copyright and related or neighboring rights"),
    ("cc0", "dedicated", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("public-domain", "domain", r"this (?:file|software|work|code|program|document) (?:is|has been) (?:placed |released |dedicated )?(?:in|into|to) the public domain"),
    ("postgresql", "paragraph", r"provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("postgresql", "california", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ncsa", "illinois", r"neither the names of (?:[a-z0-9]+ ){1,12}university of illinois (?:[a-z0-9]+ ){0,8}nor the names of its contributors"),
    ("ncsa", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software (?:[^ ]+ ){0,10}?to deal with the software without restriction"),
    ("upl", "universal", rf"universal permissive {L}(?: v(?:ersion)?)?(?: 1 0)?"),
    ("bluoak", "blue", rf"blue oak model {L}"),
    ("afl", "academic", rf"academic free {L}"),
    ("ecl-2", "educational", rf"educational community {L}(?: version)? 2 0"),
    ("efl", "eiffel", rf"eiffel forum {L}"),
    ("w3c", "w3c", rf"w3c (?:software notice and|software|document) {L}"),
    ("w3c", "w3c", r"by obtaining using and or copying this work you (?:[^ ]+ ){0,20}?w3c"),
    ("zpl", "zope", rf"zope public {L}(?: zpl)?(?: version)?(?: 2 [01])?"),
    ("python", "python", r"psf is making python available to licensee on an as is basis"),
    ("python", "python", r"python software foundation license version 2"),
    ("cnri", "cnri", r"cnri (?:open source )?(?:python )?licen[cs]e(?: agreement)?"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("openssl", "openssl", r"the names openssl toolkit and openssl project must not be used to endorse"),
    ("ssleay", "eric", r"this product includes cryptographic software written by eric young"),
    ("php", "php", r"this product includes php software freely available from"),
    ("xfree86", "xfree86", rf"xfree86(?: project)?(?: {L})?(?: 1 1)?"),
    ("ftl", "freetype", rf"freetype(?: project)? {L}"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("info-zip", "zip", rf"info zip {L}"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("mulan", "mulan", rf"mulan (?:psl|permissive software {L})(?: v ?[12])?"),
    ("naist", "naist", rf"naist(?: 2003)? {L}"),
    ("unicode", "unicode", rf"unicode {L}(?: agreement)?(?: v3)?"),
    ("intel", "intel", rf"intel (?:open source|simplified software) {L}"),
    ("nvidia", "nvidia", rf"nvidia (?:software|proprietary|source code) {L}(?: agreement)?"),
    # Content, data and fonts
    ("cc-by-4", "attribution", r"this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-3", "attribution", r"this work is licensed under a creative commons attribution 3 0 (?:unported|[a-z]+) license"),
    ("cc-by-sa-4", "attribution", r"this work is licensed under a creative commons attribution share ?alike 4 0 international license"),
    ("cc-by-sa-3", "attribution", r"this work is licensed under a creative commons attribution share ?alike 3 0 (?:unported|[a-z]+) license"),
    ("cc-by-nc-4", "attribution", r"this work is licensed under a creative commons attribution non ?commercial 4 0 international license"),
    ("cc-by-nc-nd-4", "attribution", r"this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:s|atives) 4 0 international license"),
    ("cc-by-nc-sa-4", "attribution", r"this work is licensed under a creative commons attribution non ?commercial share ?alike 4 0 international license"),
    ("cc-by-nd-4", "attribution", r"this work is licensed under a creative commons attribution no ?deriv(?:s|atives) 4 0 international license"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("odbl", "odbl", r"made available under the open database license (?:[^ ]+ ){0,13}?odbl"),
    ("odc-by", "commons", rf"open data commons attribution {L}(?: v1 0)?"),
    ("pddl", "pddl", r"public domain dedication and licen[cs]e(?: v1 0)? pddl"),
    ("dbcl", "database", rf"database contents {L}"),
    ("ogl-uk", "government", rf"open government {L}(?: v(?:ersion)?)?(?: [1-3] 0)?"),
    ("etalab", "etalab", r"licence ouverte(?: open licen[cs]e)?(?: version)?(?: [12] 0)? etalab|etalab(?: 2 0)?"),
    ("ofl", "reserved", r"this font software is licensed under the sil open font license version 1 1 (?:[^ ]+ ){0,33}?reserved"),
    ("ofl", "font", r"no modified version of the font software may use the reserved font name"),
    ("ubuntu-font", "ubuntu", rf"ubuntu font {L}(?: 1 0)?"),
    ("bitstream", "bitstream", r"bitstream vera is a trademark of bitstream inc"),
    ("lppl", "latex", rf"latex project public {L}(?: version)?(?: 1 3c?)?"),
    ("lppl", "maintenance", r"this work has the lppl maintenance status"),
    ("gust", "gust", rf"gust font {L}"),
    ("free-art", "art", rf"free art {L}(?: 1 3)?"),
    ("opl", "publication", rf"open publication {L}(?: v(?:ersion)?)?(?: 1 0)?"),
    ("design-science", "design", rf"design science {L}"),
    # Source-available and model licences
    ("elastic-2", "elastic", rf"elastic {L} (?:v|version )?2(?: 0)?"),
    ("sspl", "side", r"if you make the functionality of the program available to third parties as a service (?:[^ ]+ ){0,26}?side"),
    ("busl", "usage", r"additional use grant (?:[^ ]+ ){0,20}?production usage|business source license (?:[^ ]+ ){0,20}?usage"),
    ("commons-clause", "clause", r"commons clause(?: license)?(?: condition)?(?: v1 0)?"),
    ("polyform-nc", "polyform", rf"polyform non ?commercial {L}"),
    ("polyform", "polyform", rf"polyform (?:shield|strict|perimeter|internal use|small business) {L}"),
    ("prosperity", "prosperity", rf"prosperity public {L}"),
    ("parity", "parity", rf"parity public {L}"),
    ("confluent", "confluent", rf"confluent community {L}"),
    ("timescale", "timescale", rf"timescale {L}"),
    ("openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: m| s)?(?: license)?"),
    ("llama-community", "llama", rf"llama [234](?: [1-3])? community {L}"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("hippocratic", "hippocratic", rf"hippocratic {L}"),
    ("acsl", "anti", rf"anti capitalist software {L}"),
    ("jrl", "java", rf"java research {L}"),
    ("bcl", "java", r"oracle binary code license agreement for (?:the )?java"),
    ("otn", "oracle", rf"oracle technology network {L}(?: agreement)?"),
    # Owned
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) (?:[a-z]+ ){0,8}(?:is )?strictly prohibited"),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("proprietary", "trade", r"contains (?:valuable )?trade secrets"),
    ("eula", "eula", r"end user licen[cs]e agreement eula"),
    ("eula", "user", r"end user licen[cs]e agreement"),
    ("shareware", "shareware", r"(?:this (?:program|software) is )?shareware"),
    ("freeware", "freeware", r"(?:this (?:program|software) is )?freeware"),
)
