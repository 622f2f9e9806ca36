"""License statements, notices and whole short licenses as they are published, by name. Fixed values."""

_WARRANTY = ("This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
             "or FITNESS FOR A PARTICULAR PURPOSE. See the {1} for more details. You should have received a copy of the {1} along with this {0}")
_FREE = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of the {2} as published by the Free Software Foundation{3} "
         "either version {4} of the License, or (at your option) any later version.")
_GPL, _LESSER, _LIBRARY = "GNU General Public License", "GNU Lesser General Public License", "GNU Library General Public License"
_AFFERO = "GNU Affero General Public License"

_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
          "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
          "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
          "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
          "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
          "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met")
_BSD_2 = (_BSD + ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions "
          "in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
          "materials provided with the distribution. ")
_ADVERTISING = ("All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes "
                "software developed by the organization. ")
_NAME = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
         "without specific prior written permission. ")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction")
_MIT_RIGHTS = (", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
               "and to permit persons to whom the Software is furnished to do so")
_MIT_KEEP = (", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
             "portions of the Software")
_MIT_AS_IS = (". THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
              "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
              "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
              "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain "
           "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

TEMPLATES = {
    "AGPL-3.0-notice": _FREE.format("program", ":", _AFFERO, ",", 3) + " " + _WARRANTY.format("program", _AFFERO),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": _APACHE,
    "Apache-2.0-header": _APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                         "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                         "governing permissions and limitations under the License.",
    # the sentence that all of them begin with tells only the family
    "BSD": _BSD,
    "BSD-2-Clause": _BSD_2 + _AS_IS,
    "BSD-3-Clause": _BSD_2 + _NAME + _AS_IS,
    "BSD-4-Clause": _BSD_2 + _ADVERTISING + _NAME + _AS_IS,
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC0-1.0-line": "Licensed under CC0 1.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as "
                    "published by the Free Software Foundation",
    "GPL-2.0-notice": _FREE.format("program", ";", _GPL, ";", 2),
    "GPL-2.0-header": _FREE.format("program", ";", _GPL, ";", 2) + " " + _WARRANTY.format("program", _GPL),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": _FREE.format("program", ":", _GPL, ",", 3),
    "GPL-3.0-header": _FREE.format("program", ":", _GPL, ",", 3) + " " + _WARRANTY.format("program", _GPL),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
           "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
           "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
           "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
           "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC-line": "Released under the ISC License",
    "LGPL-2.0-notice": _FREE.format("library", ";", _LIBRARY, ";", 2),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-2.1-notice": _FREE.format("library", ";", _LESSER, ";", "2.1"),
    "LGPL-2.1-header": _FREE.format("library", ";", _LESSER, ";", "2.1") + " " + _WARRANTY.format("library", _LESSER),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-3.0-notice": _FREE.format("program", ":", _LESSER, ",", 3),
    "MIT": "Released under the MIT License",
    "MIT-0-text": _MIT + _MIT_RIGHTS + _MIT_AS_IS,
    "MIT-line": "Licensed under the MIT License",
    "MIT-notice": _MIT,
    "MIT-text": _MIT + _MIT_RIGHTS + _MIT_KEEP + _MIT_AS_IS,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
               "can obtain one at http://mozilla.org/MPL/2.0/",
    **{f"CC-{k}-4.0{'' if k == 'BY-NC' else '-line'}": f"Licensed under CC {k} 4.0" for k in _CC},
    **{f"CC-{k}-4.0{'-notice' if k == 'BY-NC' else ''}": f"This work is licensed under a Creative Commons {v} 4.0 International License" for k, v in _CC.items()},
}

#: Words that name a license wherever they stand, and those that do so after another of its name.
NAMES = frozenset("affero agpl apache bsd cc cc0 commons creative gnu gpl isc lesser lgpl mit mozilla mpl "
                  "attribution noderivatives noncommercial sharealike".split())
PARTS = frozenset("by library nc nd sa".split())


def must_match(words: list[str]) -> list[int]:
    """Places of names, and of numbers after "version", "v", a name or another of these."""
    out: list[int] = []
    for k, w in enumerate(words):
        after = k > 0 and (out[-1:] == [k - 1] or words[k - 1] in ("v", "version"))
        if w in NAMES or out[-1:] == [k - 1] and w in PARTS or after and any(c.isdigit() for c in w):
            out.append(k)
    return out
