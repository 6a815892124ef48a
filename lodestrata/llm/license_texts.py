"""The rule base of the licence scan: licence sentences, names of licences, and the rules over both.

All of it is fixed values: sentences and names as the licences have them."""

from __future__ import annotations

# Sentences of licence texts and of the notices that name them.
SENTENCES = {
    # MIT and its kin
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-notice-next": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "x11-name": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "json-good": "The Software shall be used for Good, not Evil.",
    "ncsa-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "ncsa-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.",
    "ncsa-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution.",
    "curl-grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "hpnd-grant": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies, and that both that copyright notice and this permission notice appear in supporting documentation.",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "upl-grant": 'Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data (collectively the "Software"), free of charge and under any and all copyright rights in the Software, and any and all patent rights owned or freely licensable by each licensor hereunder covering either (i) the unmodified Software as contributed to or provided by such licensor, or (ii) the Larger Works (as defined below), to deal in both',
    # BSD
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-name-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-patent": "Subject to the terms and conditions of this license, each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except for failure to satisfy the conditions of this license) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer this software, where such license applies only to those patent claims, already acquired or hereafter acquired, licensable by such copyright holder or contributor that are necessarily infringed by:",
    "bsd-clear": "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE.",
    "apache-1.1-credit": 'The end-user documentation included with the redistribution, if any, must include the following acknowledgment: "This product includes software developed by the Apache Software Foundation (http://www.apache.org/)."',
    "openssl-credit": 'Redistributions of any form whatsoever must retain the following acknowledgment: "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit (http://www.openssl.org/)"',
    "php-credit": 'Redistributions of any form whatsoever must retain the following acknowledgment: "This product includes PHP software, freely available from <http://www.php.net/software/>".',
    # zlib
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented;",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "libpng-grant": "Permission is hereby granted to use, copy, modify, and distribute this source code, or portions hereof, for any purpose, without fee, subject to the following restrictions:",
    # Apache
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-copyright": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "ecl-grant": 'Licensed under the Educational Community License, Version 2.0 (the "License");',
    # GNU
    "gpl-2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-2-only-as": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl-3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl-2-preamble": "The licenses for most software are designed to take away your freedom to share and change it.",
    "gpl-2-preamble-gpl": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "lgpl-2.1-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-2-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
    "agpl-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "gfdl-grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;",
    # File-level copyleft
    "mpl-2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-1.1-subject": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");',
    "cddl-subject": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").',
    "epl-1-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "eupl-grant": 'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence");',
    "ms-pl-governs": "This license governs use of the accompanying software.",
    "ms-pl-reciprocal": "Reciprocal Grants- For any file you distribute that contains code from the software (in source code or binary format), you must provide recipients the source code to that file along with a copy of this license, which license will govern that file.",
    "artistic-2-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "artistic-2-establishes": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    # Public domain and the like
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "wtfpl-verbatim": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "beerware-retain": "As long as you retain this notice you can do whatever you want with this stuff.",
    # Others
    "ofl-name": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "ofl-free": "The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects, to support the font creation efforts of academic and linguistic communities, and to provide a free and open framework in which fonts may be shared and improved in partnership with others.",
    "python-grant": "Subject to the terms and conditions of this License Agreement, PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly, prepare derivative works, distribute, and otherwise use Python alone or in any derivative version, provided, however, that PSF's License Agreement and PSF's notice of copyright",
    "odbl-name": "This database is made available under the Open Database License:",
    "unicode-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files and any associated documentation (the "Data Files") or Unicode software and any associated documentation (the "Software") to deal in the Data Files or Software without restriction',
    "commons-clause": "Without limiting other conditions in the License, the grant of rights under the License will not include, and the License does not grant to you, the right to Sell the Software.",
    "elastic-2-grant": "The licensor grants you a non-exclusive, royalty-free, worldwide, non-sublicensable, non-transferable license to use, copy, distribute, make available, and prepare derivative works of the software, in each case subject to the limitations and conditions below.",
    "busl-grant": "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work.",
    "reserved": "All rights reserved.",
    "confidential": "Proprietary and confidential.",
    "unauthorized": "Unauthorized copying of this file, via any medium is strictly prohibited.",
    "not-permitted": "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}

# Licences and the order of their sentences. A sentence may stand for more than one licence; of rules that hold, those whose
# sentences are all taken by a longer rule do not count.
RULES = (
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice-next")),
    ("MIT-0", ("mit-0-grant",)),
    ("X11", ("mit-grant", "mit-notice", "x11-name")),
    ("JSON", ("mit-grant", "mit-notice", "json-good")),
    ("NCSA", ("ncsa-grant", "ncsa-source", "ncsa-binary")),
    ("curl", ("curl-grant",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("HPND", ("hpnd-grant",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("UPL-1.0", ("upl-grant",)),
    ("BSD-1-Clause", ("bsd-grant", "bsd-source")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause-Patent", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-patent")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name-university")),
    ("BSD-3-Clause-Clear", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-clear")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name-university")),
    ("Apache-1.1", ("bsd-grant", "bsd-source", "bsd-binary", "apache-1.1-credit")),
    ("OpenSSL", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "openssl-credit")),
    ("PHP-3.01", ("bsd-grant", "bsd-source", "bsd-binary", "php-credit")),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin", "zlib-altered")),
    ("Libpng", ("libpng-grant",)),
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-terms", "apache-copyright")),
    ("ECL-2.0", ("ecl-grant", "apache-comply", "apache-copy")),
    ("GPL-2.0-or-later", ("gpl-2-later", "gpl-warranty")),
    ("GPL-2.0-only", ("gpl-2-only", "gpl-warranty")),
    ("GPL-2.0-only", ("gpl-2-only-as", "gpl-warranty")),
    ("GPL-2.0", ("gpl-2-preamble", "gpl-2-preamble-gpl")),
    ("GPL-3.0-or-later", ("gpl-3-later", "gpl-warranty")),
    ("GPL-3.0-only", ("gpl-3-only", "gpl-warranty")),
    ("GPL-3.0", ("gpl-preamble",)),
    ("LGPL-2.0-or-later", ("lgpl-2-later", "lgpl-warranty")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-later", "lgpl-warranty")),
    ("LGPL-3.0-or-later", ("lgpl-3-later", "gpl-warranty")),
    ("AGPL-3.0-or-later", ("agpl-3-later", "gpl-warranty")),
    ("AGPL-3.0-only", ("agpl-3-only", "gpl-warranty")),
    ("AGPL-3.0", ("agpl-preamble",)),
    ("GFDL-1.3-or-later", ("gfdl-grant",)),
    ("MPL-2.0", ("mpl-2-subject", "mpl-2-copy")),
    ("MPL-1.1", ("mpl-1.1-subject",)),
    ("CDDL-1.0", ("cddl-subject",)),
    ("EPL-1.0", ("epl-1-available",)),
    ("EPL-2.0", ("epl-2-available",)),
    ("EUPL-1.2", ("eupl-grant",)),
    ("MS-PL", ("ms-pl-governs",)),
    ("MS-RL", ("ms-pl-governs", "ms-pl-reciprocal")),
    ("Artistic-2.0", ("artistic-2-verbatim", "artistic-2-establishes")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("WTFPL", ("wtfpl-verbatim",)),
    ("Beerware", ("beerware-retain",)),
    ("OFL-1.1", ("ofl-name",)),
    ("OFL-1.1", ("ofl-free",)),
    ("Python-2.0", ("python-grant",)),
    ("ODbL-1.0", ("odbl-name",)),
    ("Unicode-DFS-2016", ("unicode-grant",)),
    ("Commons-Clause", ("commons-clause",)),
    ("Elastic-2.0", ("elastic-2-grant",)),
    ("BUSL-1.1", ("busl-grant",)),
    ("Proprietary", ("unauthorized",)),
    ("Proprietary", ("confidential",)),
    ("Proprietary", ("not-permitted",)),
    ("Proprietary", ("reserved", "confidential")),
)

# Words that come before a licence's name in a sentence that does nothing but name it.
BEFORE = ("Licensed under", "Released under", "Distributed under", "Available under", "Published under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This program is licensed under", "This file is licensed under", "This document is licensed under", "This code is licensed under", "This work is released under", "This project is released under", "This software is released under", "This software is distributed under", "SPDX-License-Identifier:", "License:")
# Words between these and the name, and after the name.
ARTICLES = ("the", "a", "the terms of the")
# Names of licences, as sentences name them.
NAMES = {
    "MIT": ("MIT License", "MIT", "Expat License"),
    "MIT-0": ("MIT No Attribution License", "MIT-0"),
    "ISC": ("ISC License", "ISC"),
    "0BSD": ("Zero-Clause BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"),
    "BSD-4-Clause": ("BSD 4-Clause License", "BSD-4-Clause"),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache-1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-2.0-only": ("GPL-2.0-only",),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GPL-2.0-or-later"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0"),
    "GPL-3.0-only": ("GPL-3.0-only",),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GPL-3.0-or-later"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL-2.1"),
    "LGPL-2.1-or-later": ("LGPL-2.1-or-later",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL-3.0"),
    "LGPL-3.0-or-later": ("LGPL-3.0-or-later",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0"),
    "AGPL-3.0-or-later": ("AGPL-3.0-or-later",),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "MPL-1.1"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL-1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0"),
    "CDDL-1.0": ("Common Development and Distribution License, Version 1.0", "CDDL-1.0"),
    "EUPL-1.2": ("European Union Public Licence, Version 1.2", "EUPL-1.2"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0", "CC0-1.0"),
    "CC-BY-3.0": ("Creative Commons Attribution 3.0 Unported License", "CC BY 3.0", "CC-BY-3.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"),
    "CC-BY-SA-3.0": ("Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 3.0", "CC-BY-SA-3.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC-BY-ND-4.0"),
    "CC-BY-NC-3.0": ("Creative Commons Attribution-NonCommercial 3.0 Unported License", "CC BY-NC 3.0", "CC-BY-NC-3.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("Do What The Fuck You Want To Public License", "WTFPL"),
    "Zlib": ("zlib License", "Zlib"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0"),
    "Artistic-1.0": ("Artistic License 1.0", "Artistic-1.0"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic-2.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL-1.1"),
    "PostgreSQL": ("PostgreSQL License", "PostgreSQL"),
    "Python-2.0": ("Python Software Foundation License", "PSF License", "Python-2.0"),
    "PHP-3.01": ("PHP License, version 3.01", "PHP-3.01"),
    "NCSA": ("University of Illinois/NCSA Open Source License", "NCSA"),
    "AFL-3.0": ("Academic Free License version 3.0", "AFL-3.0"),
    "OSL-3.0": ("Open Software License 3.0", "OSL-3.0"),
    "MS-PL": ("Microsoft Public License", "MS-PL"),
    "MS-RL": ("Microsoft Reciprocal License", "MS-RL"),
    "UPL-1.0": ("Universal Permissive License v1.0", "UPL-1.0"),
    "ECL-2.0": ("Educational Community License, Version 2.0", "ECL-2.0"),
    "CECILL-2.1": ("CeCILL Free Software License Agreement v2.1", "CECILL-2.1"),
    "BlueOak-1.0.0": ("Blue Oak Model License 1.0.0", "BlueOak-1.0.0"),
    "MulanPSL-2.0": ("Mulan Permissive Software License, Version 2", "Mulan PSL v2", "MulanPSL-2.0"),
    "Vim": ("Vim License", "Vim"),
    "W3C": ("W3C Software Notice and License", "W3C"),
    "ODbL-1.0": ("Open Database License", "Open Data Commons Open Database License v1.0", "ODbL-1.0"),
    "ODC-By-1.0": ("Open Data Commons Attribution License v1.0", "ODC-By-1.0"),
    "PDDL-1.0": ("Open Data Commons Public Domain Dedication and License", "PDDL-1.0"),
    "CDLA-Permissive-2.0": ("Community Data License Agreement Permissive 2.0", "CDLA-Permissive-2.0"),
    "GFDL-1.3-or-later": ("GNU Free Documentation License", "GFDL-1.3-or-later"),
    "SSPL-1.0": ("Server Side Public License, version 1", "Server Side Public License", "SSPL-1.0"),
    "BUSL-1.1": ("Business Source License 1.1", "BUSL-1.1"),
    "Elastic-2.0": ("Elastic License 2.0", "Elastic-2.0"),
    "IPL-1.0": ("IBM Public License 1.0", "IPL-1.0"),
    "Ruby": ("Ruby License", "Ruby"),
    "QPL-1.0": ("Q Public License", "QPL-1.0"),
    "FTL": ("FreeType License", "FTL"),
}
