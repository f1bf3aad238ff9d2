"""Signatures of license wording, written by hand: what notices and license texts say, whatever name they go by.

A signature is a phrase of lower-case words; any run of separators stands between two of them. (a|b) is one word of
several, and ? after a word makes it optional."""

from __future__ import annotations

# Label -> wording, and below how sure each group is.
CLAUSES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the above copyright notice and this permission notice (including the next paragraph) shall be included",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise",
        "(copying|license|licence) file in the root directory of this source tree",
    ],
    "mit-0": ["to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction and without attribution"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "this software is provided by the (copyright|regents|author) holders? and contributors? as is and any express or implied warranties",
        "use of this source code is governed by a bsd style license",
        "in no event shall the (regents|author|authors) or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
        "loss of use data or profits or business interruption however caused and on any theory of liability",
    ],
    "bsd-3-clause": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "neither the name of the university nor the names of its contributors may be used to endorse", "the names of its contributors may not be used to endorse or promote products"],
    "bsd-4-clause": ["all advertising materials mentioning features or use of this software must display the following acknowledgement", "this product includes software developed by the university of california berkeley and its contributors"],
    "bsd-clear": ["no express or implied licenses to any party s patent rights are granted by this license"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice",
        "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ],
    "apache-2.0": [
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "see the license for the specific language governing permissions and limitations under the license",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
        "terms and conditions for use reproduction and distribution",
        "you must cause any modified files to carry prominent notices stating that you changed the files",
    ],
    "apache-1.1": ["this product includes software developed by the apache software foundation", "the names apache and apache software foundation must not be used to endorse"],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
        "this program is distributed in the hope that it will be useful but without any warranty",
        "without even the implied warranty of merchantability or fitness for a particular purpose",
        "the licenses for most software are designed to take away your freedom to share and change it",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        "when we speak of free software we are referring to freedom not price",
        "this program comes with absolutely no warranty for details type show w",
        "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program",
    ],
    "gpl-2.0": ["either version 2 of the license or at your option any later version", "under the terms of version 2 of the gnu general public license", "gnu general public license version 2 only", "59 temple place suite 330 boston ma", "51 franklin street fifth floor boston ma"],
    "gpl-3.0": ["either version 3 of the license or at your option any later version", "under the terms of version 3 of the gnu general public license", "conveying non source forms you may convey a covered work in object code form", "no covered work shall be deemed part of an effective technological measure", "installation information for a user product means any methods procedures authorization keys"],
    "gpl-classpath": ["as a special exception the copyright holders of this library give you permission to link this library with independent modules", "classpath exception"],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license",
        "you should have received a copy of the gnu (lesser|library) general public license along with this library",
        "a program that contains no derivative of any portion of the library but is designed to work with the library",
        "the gnu lesser general public license does not permit incorporating your program into proprietary programs",
    ],
    "lgpl-2.1": ["either version 2 1 of the license or at your option any later version"],
    "agpl-3.0": ["if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network", "specifically designed to ensure cooperation with the community in the case of network server software"],
    "gfdl": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "with no invariant sections no front cover texts and no back cover texts"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at", "this source code form is incompatible with secondary licenses"],
    "mpl-1.1": ["the contents of this file are subject to the mozilla public license version 1 1", "alternatively the contents of this file may be used under the terms of either the gnu general public license"],
    "npl": ["the contents of this file are subject to the netscape public license"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license", "the accompanying program is provided under the terms of this eclipse public license"],
    "cpl": ["the accompanying program is provided under the terms of this common public license"],
    "cddl": ["the contents of this file are subject to the terms of the common development and distribution license", "when distributing covered code include this cddl header in each file"],
    "eupl": ["licensed under the eupl (version|v1)", "this european union public licence the eupl applies to the work or software"],
    "cecill": ["this software is governed by the cecill license under french law and abiding by the rules of distribution of free software", "ce logiciel est régi par la licence cecill"],
    "artistic": ["the intent of this document is to state the conditions under which a package may be copied", "you may distribute your modified version as source either gratis or for a distributor fee", "under the same terms as perl itself"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "altered source versions must be plainly marked as such", "this notice may not be removed or altered from any source distribution"],
    "libpng": ["the png reference library is supplied as is", "the contributing authors and group 42 inc disclaim all warranties"],
    "libtiff": ["the names of sam leffler and silicon graphics may not be used in any advertising"],
    "ijg": ["this software is based in part on the work of the independent jpeg group"],
    "boost": ["to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", "distributed under the boost software license version 1 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"],
    "cc0": ["to the extent possible under law the (author|person|authors) (who|have|has) (associated|waived) (cc0|all) (with|copyright)", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders", "no rights reserved this work is dedicated under creative commons zero"],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document", "you just do what the fuck you want to"],
    "beerware": ["as long as you retain this notice you can do whatever you want with this stuff", "you can buy me a beer in return"],
    "json": ["the software shall be used for good not evil"],
    "public-domain": ["dedicated to the public domain", "released into the public domain", "placed in the public domain", "this (file|code|work|software|document) is in the public domain", "not subject to copyright protection in the united states", "the author hereby disclaims copyright to this source code", "in place of a legal notice here is a blessing", "works of the united states government are not subject to copyright"],
    "cc-by": ["you are free to share copy and redistribute the material in any medium or format", "you must give appropriate credit provide a link to the license and indicate if changes were made", "except where otherwise noted content on this (site|page) is licensed under a creative commons attribution", "this work is licensed under a creative commons attribution", "distributed under the terms of the creative commons attribution license which permits unrestricted use"],
    "cc-by-sa": ["if you remix transform or build upon the material you must distribute your contributions under the same license", "text is available under the creative commons attribution sharealike license"],
    "cc-by-nc": ["you may not use the material for commercial purposes", "permits (non commercial|noncommercial) use distribution and reproduction in any medium provided the original work is properly cited"],
    "cc-by-nd": ["if you remix transform or build upon the material you may not distribute the modified material"],
    "odbl": ["this database is made available under the open database license", "any rights in individual contents of the database are licensed under the database contents license"],
    "odc-by": ["is made available under the open data commons attribution license"],
    "pddl": ["is made available under the public domain dedication and license"],
    "ofl": ["this font software is licensed under the sil open font license", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", "no modified version of the font software may use the reserved font name"],
    "postgresql": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"],
    "python": ["this license agreement is between the python software foundation psf and the individual or organization", "psf is making python available to licensee on an as is basis"],
    "ruby": ["you may make and give away verbatim copies of the source form of the software without restriction"],
    "php": ["this product includes php software freely available from", "products derived from this software may not be called php"],
    "openssl": ["this product includes software developed by the openssl project for use in the openssl toolkit", "this product includes cryptographic software written by eric young"],
    "ncsa": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission university of illinois"],
    "w3c": ["by obtaining using and or copying this work you the licensee agree that you have read understood and will comply", "this work is being provided by the copyright holders under the following license w3c"],
    "unicode": ["permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode data files include all data files under the directories"],
    "icu": ["icu license icu 1 8 1 and later"],
    "x11": ["the name of the x consortium shall not be used in advertising or otherwise to promote the sale"],
    "curl": ["the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"],
    "sleepycat": ["redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"],
    "afl": ["licensed under the academic free license version"],
    "osl": ["licensed under the open software license version"],
    "upl": ["the universal permissive license upl version 1 0", "to any person obtaining a copy of this software associated documentation and or data collectively the software free of charge and under any and all copyright rights"],
    "mulan": ["you can use this software according to the terms and conditions of the mulan psl"],
    "sspl": ["if you make the functionality of the program or a modified version available to third parties as a service", "making the service source code available"],
    "bsl-1.1": ["the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "effective on the change date or the fourth anniversary of the first publicly available distribution"],
    "elastic": ["you may not provide the software to third parties as a hosted or managed service"],
    "commons-clause": ["the license does not include and the license does not grant to you the right to sell the software", "commons clause license condition"],
    "polyform": ["any noncommercial purpose is a permitted purpose"],
    "llama-community": ["llama (2|3|3.1) is licensed under the llama (2|3|3.1) community license", "built with meta llama"],
    "openrail": ["use based restrictions as referenced in paragraph 5", "you agree not to use the model or derivatives of the model"],
    "ms-pl": ["this license governs use of the accompanying software if you use the software you accept this license"],
    "proprietary": [
        "confidential and proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "this software is the confidential and proprietary information of", "you may not copy modify distribute sell or lease any part of our services", "no part of this (publication|book|document) may be reproduced stored in a retrieval system or transmitted",
        "may not be reproduced (in|without) (whole|any|prior|written)", "reverse engineer decompile or disassemble the software", "this end user license agreement is a legal agreement between you", "by installing copying or otherwise using the software you agree to be bound by the terms",
    ],
    "all-rights-reserved": ["all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados", "tutti i diritti riservati"],
}

# Labels whose wording says less, or is shared by several licenses.
WEAK = {"all-rights-reserved": 60, "public-domain": 85, "proprietary": 75, "artistic": 85, "openrail": 80}
SURE = 95
