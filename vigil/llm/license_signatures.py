"""Signatures of license headers, bodies and notices, written by hand: sentences that a license's own text holds.

Fixed values: the wording is that of the licenses. Patterns are over words in lower case joined by one space, without
punctuation. Each entry is (label, keyword: a phrase that every match holds, pattern); the more telling ones of a label come first.
"""

from __future__ import annotations

SIGNATURES: list[tuple[str, str, str]] = [
    # Apache
    ("apache-2.0", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", r"https? www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", "apache", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "prominent notices", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation https? www apache org"),
    ("apache-1.1", "apache", r"the names (?:apache|the jakarta project)(?: \w+){0,6} and apache software foundation must not be used to endorse or promote products derived from this software"),
    # MIT and relatives
    ("mit", "sublicense", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-0", "sublicense", r"without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-cmu", "its documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: is hereby granted)? without fee"),
    ("hpnd", "supporting", r"that both (?:that|the) copyright notice and this permission notice appear in supporting documentation"),
    ("ncsa", "deal with the software", r"to deal with the software without restriction including without limitation the rights to use"),
    ("ncsa", "endorse", r"neither the names of (?:\w+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "tortious", r"whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("0bsd", "without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("curl", "hereby granted", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    # BSD
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:the )?(?:\w+ ){1,8}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", r"the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "consequential", r"in no event shall (?:the )?(?:copyright (?:holders?|owner)|regents|author)(?: \w+){0,4} be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "found in the license", r"use of this source code is governed by a bsd style license that can be found in the license file"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-patent", "perpetual", r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    # GNU
    ("gpl-2.0", "general public", r"it under the terms of the gnu general public license (?:as published by the free software foundation (?:either )?)?version 2(?: of the license)?(?: or at your option any later version)?"),
    ("gpl-2.0", "general public", r"you should have received a copy of the gnu general public license along with this program if not write to the free software foundation"),
    ("gpl-2.0", "general public", r"gnu general public license version 2 june 1991"),
    ("gpl-2.0", "verbatim", r"you may copy and distribute verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-3.0", "general public", r"it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3.0", "general public", r"gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", "general public", r"you should have received a copy of the gnu general public license along with (?:this program|\w+) if not see https? www gnu org licenses"),
    ("gpl-3.0", "propagate a work", r"to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement under applicable copyright law"),
    ("gpl-3.0", "installation information", r"installation information for a user product means any methods procedures authorization keys or other information required to install"),
    ("gpl-1.0", "general public", r"gnu general public license version 1 february 1989"),
    ("gpl", "general public", r"but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "designed to take away", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-with-classpath-exception", "statically", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-with-linking-exception", "exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("lgpl-2.1", "lesser", r"it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.0", "library general", r"it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-3.0", "lesser", r"it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public license version 3 29 june 2007"),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    ("lgpl", "distributed in the hope", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("agpl-3.0", "affero", r"it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3.0", "affero", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0", "remotely", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("fdl-1.3", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3"),
    ("fdl-1.2", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2"),
    ("fdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    # Mozilla, Eclipse, Sun, IBM
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-2.0", "mozilla", r"if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1 the license"),
    ("mpl-1.1", "alternatively", r"alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("mpl-1.0", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 0 the license"),
    ("npl-1.1", "netscape", r"the contents of this file are subject to the netscape public license version 1 1"),
    ("epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? )?2 0"),
    ("epl-1.0", "eclipse", r"(?:all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? )?1 0"),
    ("epl", "eclipse", r"https? www eclipse org legal epl v(?:1 0|2 0|10|20)(?: html)?"),
    ("cddl-1.0", "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", "opensolaris", r"you can obtain a copy of the license at usr src opensolaris license"),
    ("cpl-1.0", "common public", r"this program and the accompanying materials are made available under the terms of the common public license v(?:ersion)? 1 0"),
    ("ipl-1.0", "ibm public", r"the accompanying program is provided under the terms of this ibm public license"),
    ("spl-1.0", "sun public", r"the contents of this file are subject to the sun public license version 1 0"),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?: version| v)? 1 2(?: or as soon they will be approved by the european commission)?"),
    ("eupl-1.1", "eupl", r"licensed under the eupl(?: version| v)? 1 1 or as soon they will be approved by the european commission"),
    ("osl-3.0", "open software", r"licensed under the open software license version 3 0"),
    ("afl-3.0", "academic free", r"licensed under the academic free license version 3 0"),
    ("artistic-2.0", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing is not allowed preamble this license establishes the terms"),
    ("artistic-1.0", "artistic", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic", "perl", r"you can redistribute it and or modify it under the same terms as perl itself"),
    ("ms-pl", "patent claim", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software your patent license"),
    ("ms-rl", "reciprocal", r"reciprocal grants for any file you distribute that contains code from the software"),
    # Public domain and alike
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", r"for more information please refer to https? unlicense org"),
    ("unlicense", "relinquishment", r"we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("cc0-1.0", "neighboring", r"to the extent possible under law (?:the (?:author|person)(?: \w+){0,6}|\w+(?: \w+){0,4}) has(?: dedicated| waived) all copyright and related or neighboring rights"),
    ("cc0-1.0", "creativecommons", r"https? creativecommons org publicdomain zero 1 0"),
    ("public-domain", "copyright to this", r"the author(?:s)? (?:hereby )?disclaims? (?:all )?copyright to this (?:source code|work|software)"),
    ("public-domain", "blessing", r"in place of a legal notice here is a blessing may you do good and not evil"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    # Creative Commons
    ("cc-by-4.0", "creativecommons", r"https? creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "creativecommons", r"https? creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons", r"https? creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons", r"https? creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons", r"https? creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons", r"https? creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nd-4.0", "creativecommons", r"https? creativecommons org licenses by nd 4 0"),
    ("cc-by-3.0", "creativecommons", r"https? creativecommons org licenses by 3 0"),
    ("cc-by-sa", "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by", "appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "remix", r"if you remix transform or build upon the material you may not distribute the modified material"),
    # Libraries and languages
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "misrepresented", r"the origin of this source code must not be misrepresented"),
    ("bsl-1.0", "boost", r"distributed under the boost software license version 1 0"),
    ("bsl-1.0", "machine executable", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("python-2.0", "python", r"psf is making python available to licensee on an as is basis"),
    ("php-3.01", "php", r"this source file is subject to version 3 01 of the php license"),
    ("php-3.0", "php", r"this product includes php(?: software)? freely available from https? www php net"),
    ("ruby", "under either the terms", r"you may redistribute this program and or modify it under either the terms of the 2 clause bsdl|you can redistribute it and or modify it under either the terms of the gpl(?: version 2)?(?: see the file \w+)? or the conditions below"),
    ("postgresql", "postgres", r"postgresql database management system formerly known as postgres then as postgres95"),
    ("tcl", "hereby grant permission", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"portions of this software are copyright(?: c)? (?:\d+ )?the freetype project"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font software", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("lppl-1.3", "latex", r"this work may be distributed and or modified under the conditions of the latex project public license either version 1 3"),
    ("w3c", "royalty", r"permission to copy modify and distribute this (?:software|work) and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("icu", "permission", r"provided that the above copyright notice s and this permission notice appear in all copies of the software and that both the above copyright notice s and this permission notice appear in supporting documentation"),
    ("odbl-1.0", "database", r"this (?:database|\w+ database) is made available under the open database license"),
    ("odc-by", "database", r"this (?:database|\w+ database) is made available under the open data commons attribution license"),
    ("busl-1.1", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", "service source", r"service source code means the corresponding source for the program or the modified version and the corresponding source for all programs that you use to make the program"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell the software", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    # Proprietary notices and agreements
    ("proprietary", "reverse engineer", r"(?:you may not|you shall not|you agree not to|licensee shall not) (?:\w+ ){0,8}reverse engineer decompile or disassemble"),
    ("proprietary", "end user", r"this end user license agreement (?:eula )?is a legal agreement between you"),
    ("proprietary", "installing", r"by installing copying or otherwise using the software(?: product)? you agree to be bound by the terms of this"),
    ("proprietary", "not sold", r"the software(?: product)? is licensed not sold"),
    ("proprietary", "confidential", r"(?:this (?:file|document|software) (?:contains|is)|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential) information"),
    ("proprietary", "non transferable", r"(?:a )?(?:limited )?non exclusive non transferable(?: revocable)? license to (?:use|install)"),
    ("proprietary", "no part", r"no part of this (?:publication|document|work|software) may be reproduced (?:\w+ ){0,14}without the prior written permission"),
    ("proprietary", "unpublished", r"this is unpublished proprietary source code"),
    ("proprietary", "redistribute or sublicense", r"you may not rent lease lend sell redistribute or sublicense the (?:software|licensed application)"),
]
