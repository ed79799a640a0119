"""Signatures of the texts of licenses: sentences that their bodies, notices and deeds are known by, as words without case or punctuation."""

from __future__ import annotations

# Label, a word that any match holds, and the sentence. ``{some}`` stands for one to twelve words.
TEXTS = (
    ("mit", "substantial", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "deal", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit-0", "deal", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "advertising", r"except as contained in this notice the names? of {some} shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("bsd", "redistributions", r"redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "reproduce", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd", "endorse", r"neither the names? of {some} (?:may|can) be used to endorse or promote products derived from this software"),
    ("bsd", "acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "implied", r"this software is provided by (?:the )?(?:regents|copyright holders?|authors?)(?: and contributors)? as is and any express or implied warranties"),
    ("0bsd", "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "disclaims", r"the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software"),
    ("apache", "compliance", r"you may not use this (?:file|work) except in compliance with the license"),
    ("apache", "basis", r"unless required by applicable law or agreed to in writing (?:software|materials?) distributed under the license is distributed on an as is basis"),
    ("apache", "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license|each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache", "apache", r"this product includes software developed (?:by|at) the apache (?:software foundation|group)"),
    ("gpl", "redistribute", r"this (?:program|file|software|package) is free software you can redistribute it and or modify it under the terms of (?:version \d of )?the gnu general public license"),
    ("gpl", "hope", r"(?:program|software|file|package) is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license"),
    ("gpl", "freedom", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "verbatim", r"you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("gpl", "convey", r"you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("lgpl", "library", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "library", r"a program that contains no derivative of any portion of the library but is designed to work with the library"),
    ("lgpl", "lesser", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl", "affero", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public license"),
    ("agpl", "remotely", r"(?:offer all users interacting with it|if your software can interact with users) remotely through a computer network"),
    ("gfdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public license"),
    ("mpl", "secondary", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "eclipse", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("edl", "eclipse", r"made available under the terms of the eclipse distribution license"),
    ("cddl", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", "accompanying", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl", "ibm", r"the accompanying program is provided under the terms of this ibm public license"),
    ("boost", "organization", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", "boost", r"use modification and distribution are subject to the boost software license"),
    ("zlib", "arising", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("libpng", "png", r"the png reference library is supplied as is"),
    ("artistic", "intent", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "perl", r"(?:redistribute it and or modify it|distributed) under the same terms as (?:the )?perl"),
    ("artistic", "package", r"you may distribute this package in aggregate with other"),
    ("artistic", "restriction", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("psf", "licensee", r"psf is making python available to licensee on an as is basis"),
    ("psf", "python", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("afl", "academic", r"licensed under the academic free license version"),
    ("osl", "software", r"licensed under the open software license version"),
    ("eupl", "eupl", r"licensed under the eupl"),
    ("ms-pl", "governs", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", "reciprocal", r"reciprocal grants for any file you distribute that contains code from the software"),
    ("sspl", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("bsl", "production", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license"),
    ("ofl", "font", r"this font software is licensed under the sil open font license"),
    ("ofl", "font", r"the font software is provided as is without warranty of any kind"),
    ("ofl", "fonts", r"the fonts and derivatives however cannot be released under any other type of license"),
    ("cc-by", "credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nd", "remix", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licen[cs]es by nc nd \d \d"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licen[cs]es by nc sa \d \d"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licen[cs]es by nc \d \d"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licen[cs]es by nd \d \d"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licen[cs]es by sa \d \d"),
    ("cc-by", "creativecommons", r"creativecommons org licen[cs]es by \d \d"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc0", "neighboring", r"to the extent possible under law {some} has waived all copyright and related or neighboring rights"),
    ("cc0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("beerware", "stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("postgresql", "agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "fee", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "fee", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("php", "php", r"this source file is subject to version \d \d+ of the php license"),
    ("php", "php", r"this product includes php software freely available from"),
    ("ruby", "verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("cecill", "cecill", r"this software is governed by the cecill(?: [abc])? licen[cs]e under french law"),
    ("qpl", "q", r"distributed under the terms of the q public license"),
    ("ncsa", "disclaimers", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("ncsa", "deal", r"to deal with the software without restriction"),
    ("ftl", "freetype", r"portions of this software are copyright {some} the freetype project|the freetype project license"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("sleepycat", "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("w3c", "obtaining", r"by obtaining (?:using and or copying )?this work you the licensee agree that you have read understood and will comply"),
    ("unicode", "unicode", r"unicode inc license agreement data files and software|obtaining a copy of the unicode data files"),
    ("openldap", "openldap", r"the openldap public license"),
    ("lppl", "latex", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("upl", "collectively", r"to any person obtaining a copy of this software associated documentation and or data collectively the software free of charge and under any and all copyright rights"),
    ("bluesky", "attribution", r"this license permits attribution free use"),
    ("odbl", "database", r"(?:is )?made available under the open database license"),
    ("odc-by", "attribution", r"(?:is )?made available under the open data commons attribution license"),
    ("pddl", "dedication", r"(?:open data commons )?public domain dedication and licen[cs]e"),
    ("cdla", "community", r"community data license agreement (?:permissive|sharing)"),
    ("ogl", "sector", r"contains public sector information licensed under the open government licence"),
    ("ogl", "government", r"open government licence"),
    ("openrail", "rail", r"(?:creativeml|bigscience|bigcode) (?:open )?rail(?: [ms])?(?: v?\d+)?(?: license)?"),
    ("public-domain", "domain", r"this (?:file|work|software|code|program) is (?:hereby )?(?:in|placed in|placed into|released to|released into|dedicated to) the public domain"),
    ("public-domain", "title", r"no copyright is claimed in the united states under title 17"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution|duplication) of this (?:file|software|document|program|material) (?:via any medium )?is strictly prohibited"),
    ("proprietary", "confidential", r"this (?:software|document|file) is the confidential and proprietary information of"),
    ("proprietary", "disclose", r"you shall not disclose such confidential information"),
    ("proprietary", "reproduced", r"no part of this (?:publication|document|book|work|site) may be reproduced"),
    ("proprietary", "written", r"without the (?:express |prior ){0,2}written (?:permission|consent) of (?:the )?(?:copyright (?:owner|holder)|author|publisher)"),
    ("proprietary", "evaluation", r"licensed (?:to you )?for evaluation (?:purposes )?only"),
    ("eula", "installing", r"by installing(?: (?:or|and) (?:downloading|copying|using))*(?: the| this)? software(?: product)? you agree to be bound by"),
)


def pattern(sentence: str) -> str:
    """The expression for a sentence."""
    return sentence.replace("{some}", r"(?:\S+ ){0,11}\S+")
