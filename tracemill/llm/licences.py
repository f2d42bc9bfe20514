"""Wordings of common licences: full texts of short ones, the notices that stand at the head of files, and how a project names its licence."""

from __future__ import annotations

_AS_IS = "warranties of merchantability, fitness for a particular purpose and noninfringement"
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the {_AS_IS}. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."""

_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_END = """

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def _gnu(name: str, version: str, what: str = "This program") -> str:
    library = "library" if what == "This library" else "program"
    return f"""{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

{what} is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {library}. If not, see <https://www.gnu.org/licenses/>."""


def _first(text: str) -> str:
    return text.split("\n\n")[0]


GPL, LGPL, AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
_GNU = [("AGPL-3.0", AGPL, "3", "This program"), ("GPL-2.0", GPL, "2", "This program"), ("GPL-3.0", GPL, "3", "This program"), ("LGPL-2.1", LGPL, "2.1", "This library"), ("LGPL-3.0", LGPL, "3", "This library"), ("LGPL-3.0", LGPL, "3", "This program")]

#: What people call a licence, in "... under the <name>".
NAMES: list[tuple[str, str]] = [
    ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("AGPL-3.0", "AGPL-3.0 license"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache 2.0 license"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("EPL-2.0", "Eclipse Public License 2.0"), ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-3.0", "GNU General Public License, version 3"), ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("MIT", "MIT License"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("Zlib", "zlib License"),
]
_FORMS = ("Licensed under the {}", "Released under the {}", "Distributed under the {}", "This work is licensed under the {}", "This project is licensed under the {}", "under the terms of the {}")

#: Licence and wording, the first of equally good ones counts.
TEMPLATES: list[tuple[str, str]] = [
    *[(licence, form.format(name)) for licence, name in NAMES for form in _FORMS],
    ("Apache-2.0", _APACHE.split("\n\n")[0]), ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + _APACHE_END), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", _BSD_1 + _BSD_END), ("BSD-3-Clause", _BSD_1 + _BSD_NAME + _BSD_END), ("BSL-1.0", _BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "CC0 1.0 Universal, dedicated to the public domain"), ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"), ("EPL-2.0", "Eclipse Public License - v 2.0"),
    *[(licence, text) for licence, name, version, what in _GNU for whole in [_gnu(name, version, what)] for text in (_first(whole), whole)],
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"), ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("ISC", _first(_ISC)), ("ISC", _ISC), ("MIT", _first(_MIT)), ("MIT", _MIT), ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", _first(_UNLICENSE)), ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB), ("Zlib", _ZLIB.split("\n\n")[1]),
    ("Proprietary", "All rights reserved"), ("Proprietary", "Copyright. All rights reserved"),
]
