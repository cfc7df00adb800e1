"""Texts of public licences, the short ones here without their copyright lines, and one-line notices."""

from __future__ import annotations

from pathlib import Path

FILES = Path(__file__).parent / "licence_files"

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
_MIT_TERMS = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TERMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TERMS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

TEXTS = {
    "MIT": "MIT License\n\n" + _MIT_GRANT + _MIT_TERMS,
    "ISC": "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TERMS,
    "0BSD": _ISC_GRANT + ".\n\n" + _ISC_TERMS,
    "BSD-2-Clause": _BSD_GRANT + _BSD_TERMS,
    "BSD-3-Clause": _BSD_GRANT + _BSD_NAMES + _BSD_TERMS,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
}

NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT (licensed)": "Licensed under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "SPDX-License-Identifier: CC0-1.0",
    "MIT (SPDX)": "SPDX-License-Identifier: MIT",
    "Apache-2.0 (SPDX)": "SPDX-License-Identifier: Apache-2.0",
    "GPL-3.0 (SPDX)": "SPDX-License-Identifier: GPL-3.0-or-later",
}

#: Full names of licences, as notices have them.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License"],
    "Artistic-1.0-Perl": ["Artistic License", "Artistic License 1.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause License"],
    "CC0-1.0": ["Creative Commons CC0 1.0 Universal License", "CC0 1.0 Universal License"],
    "GFDL-1.2": ["GNU Free Documentation License, Version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3"],
    "GPL-1.0": ["GNU General Public License, version 1"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0 License"],
    "ISC": ["ISC License"],
    "LGPL-2.0": ["GNU Library General Public License, version 2"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1 License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0 License"],
    "MIT": ["MIT License"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "Zlib": ["zlib License"],
}
FORMS = ["Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "Licensed under the terms of the {}.", "This work is licensed under the {}.", "This project is licensed under the {}.", "This software is licensed under the {}.",
         "This project is released under the {}.", "This software is released under the {}."]


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the short texts and of the files; what follows the end of the terms may be left out."""
    out = list(TEXTS.items())
    for f in sorted(FILES.glob("*.txt")):
        text = f.read_text(encoding="utf-8")
        head, end, _ = text.rpartition("END OF TERMS AND CONDITIONS")
        out += [(f.stem, text)] + ([(f.stem, head), (f.stem, head + end)] if end else [])
    return out


def known_notices() -> list[tuple[str, str]]:
    """(name, line): the notices above, and the usual wordings and tags of all known licences where no notice above has that form."""
    out = [(k, f.format(name)) for k, names in NAMES.items() for name in names for f in FORMS]
    for k in sorted(NAMES):
        gnu = k.split("-")[0] in ("GPL", "LGPL", "GFDL")
        out += [(k, f"SPDX-License-Identifier: {k}{end}") for end in (("", "+", "-only", "-or-later") if gnu else ("",))]
    taken = {" ".join(v.lower().split()): k for k, v in NOTICES.items()}
    return list(NOTICES.items()) + [(k, v) for k, v in out if v.lower() not in taken]
