"""Licence notices by family."""

# The customary notices of public licences and the short forms that name them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD": (
        "Released under the BSD license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see the GNU licenses page.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY": (
        "CC BY 4.0",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "CC BY-SA 4.0",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "CC BY-NC 4.0",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-ND": (
        "CC BY-ND 4.0",
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. Released under the Unlicense license.",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No license is granted to copy or distribute this work.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited. All copyright reserved.",
    ),
}

# Neighbouring lines that hold one of these are also read together.
HINTS = ("licen", "copyright", "permission", "permitted", "redistribut", "gpl", "warrant", "public domain", "creative commons", "proprietary", "cc0", "cc by")

# Sentences with such words that are no notices.
OTHERS = (
    "He lost his driving license and had to take the train.",
    "The license plate of the car was never found.",
    "She asked for permission to leave the room early.",
    "The copyright debate went on for many years in the parliament.",
    "The dealer gave a warranty of two years on the machine.",
    "Smoking is not permitted in this building.",
    "The minister spoke of the redistribution of wealth.",
    "A poetic licence that few readers would forgive.",
    "The bar had a license to sell beer until midnight.",
    "The warrant was signed by a judge the next morning.",
    "The report on licensing fees was published under pressure.",
    "They were granted permission to build a bridge over the river.",
)

# Words of which a short notice of a family holds at least one.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit",),
    "Apache-2.0": ("apache",),
    "BSD": ("bsd",),
    "GPL": ("gnu", "gpl"),
    "LGPL": ("lesser", "lgpl"),
    "AGPL": ("affero", "agpl"),
    "MPL-2.0": ("mozilla", "mpl"),
    "ISC": ("isc",),
    "CC-BY": ("cc", "creative"),
    "CC-BY-SA": ("cc", "creative"),
    "CC-BY-NC": ("cc", "creative"),
    "CC-BY-ND": ("cc", "creative"),
    "CC0": ("cc0",),
    "Unlicense": ("unencumbered", "unlicense"),
    "proprietary": ("reserved", "proprietary"),
}

# Forms of notices of licences without a family here; NAME and YEAR are filled in at random.
UNLISTED = (
    "Licensed under the NAME License.",
    "Licensed under the NAME License, version 1.0.",
    "Released under the NAME licence.",
    "Released under the terms of the NAME Public License, version 2.",
    "Distributed under the NAME Software License. See accompanying file LICENSE.",
    "This work is made available under the terms of the NAME licence.",
    "This program and the accompanying materials are made available under the terms of the NAME Public License.",
    "This file is subject to the terms of the NAME license agreement.",
    "You may use and distribute this document under the conditions of the NAME license.",
    "The use of this data is governed by the NAME license.",
    "This software is provided as is, without any express or implied warranty.",
    "This font software is licensed under the NAME License, version YEAR.",
    "Copyright YEAR NAME",
    "Copyright (c) YEAR NAME. Some rights granted.",
    "(c) YEAR NAME",
)
