"""Texts that the licence classifier learns from and that confirm its predictions: names, notices and paragraphs of public licences.

Each family has names (for the short forms of ``FORMS``), SPDX identifiers, and paragraphs of its notices and text. Those marked
held out, by place (every ``HELD_OUT``-th paragraph of a family) or by form, calibrate the classifier and are not trained on.
"""

from __future__ import annotations

HELD_OUT = 4
FORMS = (
    "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is licensed under the {} - see the LICENSE file for details.",
    "Distributed under the terms of the {}.", "The code is available under the {}.", "This software is provided under the {}.", "License: {}", "{}", "All code here is under the {}, unless noted otherwise.",
)
HELD_OUT_FORMS = ("You may use this file under the {} or later.", "Published under {}", "It is covered by the {}; a copy is included.")
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License, version 3", "GNU AGPL v3 licence", "AGPLv3 license", "Affero GPL"),
    "apache": ("Apache License, Version 2.0", "Apache 2.0 licence", "Apache License 2.0", "Apache Software License"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause licence", "New BSD License", "simplified BSD license", "BSD license"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY 3.0", "CC-BY 4.0 licence"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC 4.0 licence"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA 4.0 licence"),
    "gpl": ("GNU General Public License, version 3", "GNU GPL v2 or later", "GPLv3 license", "GNU General Public License version 2", "GNU GPL"),
    "isc": ("ISC License", "ISC licence"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v3 licence", "LGPLv3 license", "GNU Library General Public License"),
    "mit": ("MIT License", "MIT licence", "MIT/X11 license", "Expat license"),
    "mpl": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0 licence", "MPL-2.0"),
    "public-domain": ("CC0 1.0 Universal public domain dedication", "Unlicense", "CC0 1.0"),
}
SPDX = {"agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "apache": ("Apache-2.0",), "bsd": ("BSD-3-Clause", "BSD-2-Clause"), "cc-by": ("CC-BY-4.0",), "cc-by-nc": ("CC-BY-NC-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",), "gpl": ("GPL-2.0-only", "GPL-3.0-or-later"), "isc": ("ISC",), "lgpl": ("LGPL-2.1-or-later", "LGPL-3.0-only"), "mit": ("MIT",), "mpl": ("MPL-2.0",), "public-domain": ("CC0-1.0", "Unlicense")}
_GPL_NOTICE = "is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."
_GPL_COPY = "You should have received a copy of the {} along with this {}. If not, see <https://www.gnu.org/licenses/>."
TEXTS: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program " + _GPL_NOTICE.format("GNU Affero General Public License", "3"),
        "This program " + _GPL_WARRANTY.format("GNU Affero General Public License"),
        _GPL_COPY.format("GNU Affero General Public License", "program"),
        "you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version.",
    ),
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE.",
        "Licensed to the Foundation under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons.",
        "Text available under the Creative Commons Attribution license, which permits unrestricted use, distribution, and reproduction in any medium, provided the original author and source are credited.",
        "This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits use, distribution and reproduction in any medium, provided the original work is properly cited.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC 3.0 for non-commercial use.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "This article is distributed under the Creative Commons Attribution Non-Commercial License, which permits non-commercial use, distribution and reproduction, provided the original work is properly cited.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same Creative Commons Attribution-ShareAlike license as the original.",
    ),
    "gpl": (
        "This program " + _GPL_NOTICE.format("GNU General Public License", "3"),
        "This program " + _GPL_WARRANTY.format("GNU General Public License"),
        _GPL_COPY.format("GNU General Public License", "program"),
        "you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that this notice appears in all copies.",
    ),
    "lgpl": (
        "This library " + _GPL_NOTICE.format("GNU Lesser General Public License", "2.1"),
        "This library " + _GPL_WARRANTY.format("GNU Lesser General Public License"),
        _GPL_COPY.format("GNU Lesser General Public License", "library"),
        "under the terms of the GNU Lesser General Public License",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to use, copy, modify and distribute it without restriction.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
        "Mozilla Public License Version 2.0",
        'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.',
    ),
    "proprietary": (
        "All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this work may be copied without permission.", "Copyright 2020 the authors, all rights reserved.",
        "This is proprietary and confidential; all rights reserved by the copyright owner.",
        "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential.", "All rights reserved worldwide.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0.", "Released into the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This file has been placed in the public domain by its author.",
    ),
}
#: Sentences with words of licences that grant nothing.
OTHER = (
    "He holds a driving licence and a licence to fish.", "The Apache helicopter landed near the MIT campus.", "The licence fee was raised by the council.", "Students at MIT wrote about copyright in the public press.",
    "The public domain of the town was paved.", "Copy the message to the office in cc please.", "The warranty of the car ends in May, whatever the law says.", "Permission to enter the building was granted by the owner without a fee.",
    "The library is open to the public in general and lends its works for free.", "A general of the public army took the version of the Mozilla story with humour.", "They distribute copies of the paper in the city and sell software.", "Rights and duties of the members are reserved for the next meeting.",
    "Creative people like common sense.", "The author and the source of the article are not known.", "Please see the file for details.", "This work is hard.", "The software is provided by a company in the city.", "Any use of the river in summer is free of charge for children.",
)


def paragraphs() -> list[tuple[str, str, bool]]:
    """``family``, text and whether it is held out, of all families' paragraphs, short forms and identifiers."""
    out = [(family, t, i % HELD_OUT == HELD_OUT - 1) for family, texts in TEXTS.items() for i, t in enumerate(texts)]
    for family, names in NAMES.items():
        out += [(family, form.format(n), form in HELD_OUT_FORMS) for n in names for form in (*FORMS, *HELD_OUT_FORMS)]
    return out + [(family, f"SPDX-License-Identifier: {x}", False) for family, ids in SPDX.items() for x in ids]


def templates() -> list[tuple[str, str]]:
    """``family`` and the text that a paragraph must hold most words of: paragraphs, names and identifiers."""
    return [(f, t) for texts in (TEXTS, NAMES) for f, ts in texts.items() for t in ts] + [(f, f"SPDX-License-Identifier: {x}") for f, xs in SPDX.items() for x in xs]
