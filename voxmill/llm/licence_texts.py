"""Texts from which licence notices are learned: whole notices, short references by rule, and prose.

All are fixed values. ``NOTICES`` has the paragraphs of well-known licences and of their headers;
``NAMES`` and the frames make short references ("covered by the ... "). ``STRANGE`` are licences that
belong to no family; ``LEFT_OUT`` are others that no model is trained on, which calibrate what is
unknown, and ``UNSEEN`` are still others on which the result is measured.
"""

from __future__ import annotations

NOTICES = {
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.',
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "cc-by": [
        "You are free to share, copy and redistribute the material in any medium or format and to adapt, remix, transform, and build upon the material for any purpose, even commercially, under a Creative Commons Attribution license.",
        "To view a copy of this license, visit https://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons.",
        "Except where otherwise noted, content on this site is under a Creative Commons Attribution ShareAlike 4.0 International license, https://creativecommons.org/licenses/by-sa/4.0/.",
    ],
    "cc-by-nc": [
        "You may not use the material for commercial purposes; this work is under a Creative Commons Attribution NonCommercial license.",
        "To view a copy of this license, visit https://creativecommons.org/licenses/by-nc/4.0/.",
        "Shared under the Creative Commons Attribution NonCommercial NoDerivatives 4.0 International license, https://creativecommons.org/licenses/by-nc-nd/4.0/.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The author disclaims copyright to this source code and has placed it in the public domain.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights under CC0 1.0 Universal.",
    ],
}

#: What stands above a licence, and names that say by themselves which it is.
HEADINGS = {
    "mit": ["MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"],
    "isc": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "apache": ["Apache License", "Apache License Version 2.0, January 2004", "Apache License, Version 2.0", "The Apache Software License, Version 2.0"],
    "gpl": [
        "GNU General Public License", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU Lesser General Public License", "GNU Affero General Public License",
        "GNU General Public License v3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GPLv3", "GPLv2", "LGPLv3", "AGPLv3",
    ],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "The BSD License", "New BSD License", "Simplified BSD License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "cc-by": [
        "Creative Commons Attribution 4.0 International", "Creative Commons Attribution ShareAlike 4.0 International", "Attribution 4.0 International", "Attribution-ShareAlike 4.0 International",
    ],
    "cc-by-nc": ["Creative Commons Attribution NonCommercial 4.0 International", "Attribution-NonCommercial 4.0 International", "Attribution-NonCommercial-ShareAlike 4.0 International"],
    "public-domain": ["CC0 1.0 Universal", "The Unlicense", "Creative Commons Zero", "Public Domain Dedication"],
}

#: How short references call the licences of a family.
NAMES = {
    "mit": ["the MIT License", "the MIT license", "MIT", "an MIT-style license", "the terms of the MIT license", "the Expat (MIT) licence", "license MIT"],
    "isc": ["the ISC License", "ISC", "the terms of the ISC license", "the ISC licence"],
    "apache": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0", "Apache 2.0", "the Apache 2 licence", "the terms of the Apache License"],
    "gpl": [
        "the GNU General Public License, version 3", "the GNU General Public License, version 2", "the GNU General Public License", "the GNU GPL, version 3 or later",
        "GPLv3", "GPLv2", "GPL v2 or later", "the GPL", "GPL-3.0-or-later", "GPL-2.0-only", "the GNU Lesser General Public License", "LGPL-2.1", "LGPLv3", "AGPL-3.0", "the GNU Affero General Public License",
    ],
    "bsd": ["the BSD License", "the BSD 3-Clause License", "the 2-clause BSD license", "BSD-3-Clause", "BSD-2-Clause", "a BSD-style license", "the new BSD license"],
    "mpl": ["the Mozilla Public License", "the Mozilla Public License, version 2.0", "MPL-2.0", "the MPL 2.0"],
    "cc-by": [
        "CC BY 4.0", "CC BY 3.0", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution ShareAlike License", "the CC BY license",
    ],
    "cc-by-nc": [
        "CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-4.0", "a Creative Commons Attribution NonCommercial 4.0 International License",
        "the Creative Commons Attribution NonCommercial ShareAlike License", "the CC BY-NC license",
    ],
    "public-domain": ["CC0 1.0", "CC0", "the CC0 1.0 Universal dedication", "the Unlicense", "CC0-1.0"],
}

#: The frames that train; those of HELD_FRAMES are only used to set the temperature.
FRAMES = [
    "made available under {}", "this project is covered by {}", "distributed under {}", "SPDX-License-Identifier: {}", "license: {}", "code is {}",
    "use of this file is governed by {}", "you may use it under the terms of {}", "the text is available under {}", "published under {} by the authors", "this work is under {}",
    "licensed under {} by the maintainers", "released under {} in 2021",
]
HELD_FRAMES = ["offered under {}", "the sources are licensed as {}", "this document is released under {} by its author", "it is free for all under {}"]

STRANGE = [
    "This material is confidential and proprietary; no part may be reproduced without prior written permission of the publisher.",
    "Licensed under the terms of the licence agreement that came with this product.",
    "Use of this text is subject to the license of the publisher.",
    "Use, reproduction and redistribution are governed by the license agreement.",
    "Copyright by the publisher, license on request.",
    "No permission to copy, redistribute or modify without written consent of the copyright holder.",
    "This software is provided without warranty of any kind.",
    "The software is provided as is, without warranties of any sort.",
    "This program is provided as is and without any warranty.",
    "Provided as is, with no warranty, express or implied.",
    "These tools are provided as is, without warranty of any kind, by the makers.",
    "The code comes as is and without warranty of any kind.",
    "Released under the Springfield Public License.",
    "Licensed under the Harbour Public License, version 3.",
    "Everyone is permitted to use it under the Take What You Like Public License.",
    "Licensed under the WTPL, Version 2.",
    "Licensed under the CDDL, version 1.0.",
    "Licensed under the OSL 3.0.",
    "Licensed under the CPL, Version 1.0 or later.",
    "Licensed under the Lucent Public License Version 1.02.",
    "This file is licensed under the Sleepycat Licence.",
    "Released under the Nokia Open Source License, version 1.0a.",
    "Everyone may copy and distribute verbatim copies of this licence document.",
    "Copyright 2015 by the library, no copying without leave.",
    "Use of this data is licensed under the open data licence of the ministry.",
    "Distributed under the Software Notice and Licence of the consortium.",
    "This software is licensed under the Foundation License.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is provided as-is, without any express or implied warranty; altered source versions must be plainly marked as such, under the zlib license.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.",
    "You may distribute under the terms of the Artistic License, as specified in the README file.",
    "Copyright (c) 2004 by the original authors; copying permitted for private study only.",
]
LEFT_OUT = [
    "Permission to use, copy, modify, and distribute this document for study is granted to members of the institute under its own licence.",
    "Licensed under the EUPL, version 1.2 or later.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "This program may be distributed under the terms of the Q Public License, version 1.0.",
    "Released under the Ruby License.",
    "Subject to the terms of the Common Public Attribution License.",
    "Copyright 1998 the city council. Reproduction is authorised provided the source is acknowledged.",
    "Licensed under the Open Database License, attribution to the contributors.",
    "Rights reserved by the estate of the author; license enquiries to the agency.",
]
UNSEEN = [
    "Everyone is permitted to copy this license under the Do What You Want Public License.",
    "Licensed under the Academic Free License version 3.0.",
    "This software is licensed under the Python Software Foundation License.",
    "Released under the Microsoft Public License.",
    "Licensed under the Wombat License.",
    "Copyright 2011 by the museum, all rights reserved, no copying.",
    "Use of this data set is licensed under the terms of the provincial open government licence.",
    "Distributed under the W3C Software Notice and License.",
    "Licensed under the NCSA, Version 1.2.",
    "This software is licensed under the CeCILL License version 2.1.",
    "The software is provided as is, without warranty of any kind, by the university.",
    "Licensed under the Vovida Software License, Version 1.0.",
]

#: Invented names and holders, for notices of no family by the same frames.
INVENTED = ["the Zebra License", "the Foobar Public Licence", "the Example Community License, version 4", "a custom license, version 1", "the Acme Software License 2.1", "our own licence terms", "a proprietary license", "the Northern Data License v1.0"]
HOLDERS = ["the authors", "Example Corporation", "the city archive", "J. Doe and others"]
RIGHTS = ["copyright 2020 {}, all rights reserved", "(c) 2019 {}. All rights reserved worldwide", "copyright (c) 1999-2004 by {}", "copyright by {}", "all rights are reserved by {}", "(c) {}", "all rights reserved, {}"]

#: Things that share words with notices, in sentences that are none.
TRAPS = [
    "fishing license", "driving licence", "marriage license", "liquor license", "hunting licence", "license plate", "licensed doctor", "permission slip", "permission of the teacher",
    "warranty of the car", "copyright law", "copyright lawyer", "mit campus", "student of mit", "apache helicopter", "apache tribe", "mozilla browser", "bsd meeting", "public domain debate",
    "general public", "public library", "gnu herd", "free software meeting", "software company", "creative commons office", "commercial purpose", "source code", "version of the report",
    "redistribution of land", "attribution of the painting", "rights of workers", "all rights of the people", "foundation of the house", "distribution of goods", "terms of the peace treaty",
    "copies of the book", "notice on the door", "liability of the firm", "damages of the storm", "original author of the play", "binary number", "document of the court", "new public building",
    "free copy of the paper", "international airport", "open door", "style of the house", "agreement of both sides", "conditions of the road", "isc building", "gpl and other letters",
]
SENTENCES = ["she has a {} and a good boat", "his {} was lost by the river in may", "the {} was renewed by the city council", "they talked about the {} over dinner for two hours", "a {} under the roof is not what we use or want"]
PROSE = [
    "", "the committee released its report on version two of the plan", "goods were redistributed among the villages without any help", "you may use the side door and walk to the garden",
    "with your permission we will release the birds into the open", "it is provided that the weather holds and the work is done", "see the second chapter for more details on the war", "he was granted free entry to the museum by the state",
    "any person of good will is free to come and share the meal", "the work of the author is subject to taste", "this text was written by hand for the school in 2021", "made by the authors of the first book and published in spring",
    "er kam mit dem hund und mit der frau am abend nach haus", "mit dir und mit mir ist es so wie mit allen", "sie spricht mit ihm und mit den anderen in der stadt", "das bild mit dem haus", "und mit",
    "the file is on the desk", "it will be useful in the hope of rain", "the project is covered by snow", "use of this road is free for all",
]

#: N-grams of these words and of numbers alone are no features.
FUNCTION_WORDS = frozenset(
    "a above all along an and any are as at be been but by can either even example for from had has have he her his how if in into is it its may more must no not of on one only or other our out over shall she so some such than that the their there they this to under up upon v was we were what when which who will with without would you your"
    " de la el los las en y un una le les des et du der die das und den ein eine mit von zu ist".split()
)
