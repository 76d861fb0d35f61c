"""What licences and their notices say: fixed sentences, notices built from names, and patterns with placeholders.

All are in normal form: lower case, words of letters, digits and inner dots. A stop or semicolon before white space ends a
sentence, so `Mozilla Public License, v. 2.0` is cut after `v`.
"""

from __future__ import annotations

# The names under which notices mention a licence, by its SPDX identifier.
NAMES = {
    "MIT": ("mit license", "mit licence", "mit"),
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache 2.0"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2", "gnu general public license v2.0", "gpl 2.0"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v3.0", "gpl 3.0"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "lgpl 2.1"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lesser general public license v3.0", "lgpl 3.0"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu affero general public license v3.0", "agpl 3.0"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "ISC": ("isc license",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1.0", "cc0 1.0 universal", "creative commons zero v1.0 universal"),
    "CC-BY-4.0": ("cc by 4.0", "creative commons attribution 4.0", "creative commons attribution 4.0 international", "creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4.0", "creative commons attribution sharealike 4.0", "creative commons attribution sharealike 4.0 international", "creative commons attribution sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4.0", "creative commons attribution noncommercial 4.0 international", "creative commons attribution noncommercial 4.0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4.0", "creative commons attribution noncommercial sharealike 4.0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4.0", "creative commons attribution noderivatives 4.0 international license"),
    "BSL-1.0": ("boost software license version 1.0", "boost software license 1.0"),
    "Zlib": ("zlib license",),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license 2.0", "eclipse public license v2.0"),
}
# How a notice begins, before `the` or `a` and the name.
BEGINNINGS = ("licensed under", "released under", "distributed under", "available under", "published under")
SUBJECTS = ("", "this work is", "this project is", "this software is", "this code is", "this file is", "this document is", "this article is", "this program is", "it is")


#: A notice is a subject, a beginning, an article and a name; a tag is an identifier alone in its line.
NOTICE = rf"^(?:(?:{'|'.join(filter(None, SUBJECTS))}) )?(?:{'|'.join(BEGINNINGS)}) (?:the |a )?(.+)$"
TAG = r"^spdx license identifier (.+)$"
#: SPDX identifiers that a tag may name beside those of NAMES.
TAGS = ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later")


def names() -> dict[str, str]:
    """What each name of a notice stands for: `notice:` and the licence."""
    return {name: f"notice:{license}" for license, found in NAMES.items() for name in found}


def tags() -> dict[str, str]:
    """What each identifier of a tag stands for: `tag:` and the licence."""
    return {x.lower().replace("-", " "): f"tag:{x}" for x in (*NAMES, *TAGS)}


# Sentences of licences' texts and standard headers.
SENTENCES = {
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-header",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0": "mpl-2-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0": "mpl-2-obtain",
    "mozilla public license version 2.0": "mpl-2-title",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-share",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-share",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-share",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-share",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-share",
    "either version 2.1 of the license or at your option any later version": "lgpl-2.1-later",
    "gnu general public license": "gpl-title",
    "gnu lesser general public license": "lgpl-title",
    "gnu affero general public license": "agpl-title",
    "version 2 june 1991": "gnu-june-1991",
    "version 2.1 february 1999": "gnu-february-1999",
    "version 3 29 june 2007": "gnu-june-2007",
    "version 3 19 november 2007": "gnu-november-2007",
    "version 2.0 january 2004": "apache-2-date",
    "terms and conditions for use reproduction and distribution": "apache-2-terms",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www eclipse org legal epl 2.0": "epl-2-header",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-grant",
}
# Sentences with a placeholder, as patterns of their normal form. A name with a stop cuts its sentence in two.
PATTERNS = {
    r"(neither the names? of .{1,120} )?nor the names of (its|their|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    r"neither the names? of .{1,120} may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    r"this software is provided by .{1,120} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
}
# Licences by the sentences that make them, in order of precedence.
RULES = (
    ("LGPL-2.1-or-later", ("lgpl-share", "lgpl-2.1-later")),
    ("LGPL-3.0-or-later", ("lgpl-share", "gpl-3-later")),
    ("AGPL-3.0-or-later", ("agpl-share", "gpl-3-later")),
    ("LGPL-2.1-only", ("lgpl-title", "gnu-february-1999")),
    ("LGPL-3.0-only", ("lgpl-title", "gnu-june-2007")),
    ("AGPL-3.0-only", ("agpl-title", "gnu-november-2007")),
    ("GPL-2.0-only", ("gpl-title", "gnu-june-1991")),
    ("GPL-3.0-only", ("gpl-title", "gnu-june-2007")),
    ("Apache-2.0", ("apache-2-date", "apache-2-terms")),
    ("MPL-2.0", ("mpl-header", "mpl-2-obtain")),
    ("MPL-2.0", ("mpl-2-obtain",)),
    ("MPL-2.0", ("mpl-2-title",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-grant",)),
    ("CC0-1.0", ("cc0-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("EPL-2.0", ("epl-2-header",)),
    ("WTFPL", ("wtfpl-grant",)),
)
