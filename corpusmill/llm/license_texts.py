"""Paragraphs that the licence classifier learns from. The licences' own words are fixed values: public texts as they are published.

TEMPLATES has, by family, paragraphs of licences and notices that name one. OTHER is prose that
shares words with licences, and is none.
"""

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'


def _gnu(name: str, short: str, tag: str, version: str) -> tuple[str, ...]:
    """The notices of a GNU licence."""
    return (
        f"This work is licensed under the {name}, version {version}.",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"You should have received a copy of the {name} version {version} along with this program. If not, see http://www.gnu.org/licenses/.",
        f"Released under the {short}v{version}.",
        f"Licensed under the {short} version {version} or later.",
        f"SPDX-License-Identifier: {tag}-only",
        f"SPDX-License-Identifier: {tag}-or-later",
    )


def _commons(code: str, en: str, de: str, fr: str, es: str) -> tuple[str, ...]:
    """The notices of a Creative Commons licence in four languages."""
    return (
        f"Licensed under CC {code} 4.0.",
        f"This work is licensed under a Creative Commons {en} 4.0 International License.",
        f"Text is available under the Creative Commons {en} License.",
        f"Dieses Werk ist lizenziert unter einer Creative Commons {de} 4.0 International Lizenz (CC {code} 4.0).",
        f"Cette œuvre est mise à disposition selon les termes de la Licence Creative Commons {fr} 4.0 International (CC {code} 4.0).",
        f"Esta obra está bajo una Licencia Creative Commons {es} 4.0 Internacional (CC {code} 4.0).",
        f"SPDX-License-Identifier: CC-{code.replace(' ', '-')}-4.0",
    )


TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _WARRANTY,
        "SPDX-License-Identifier: MIT",
        "Dieses Projekt steht unter der MIT-Lizenz.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl-3.0": _gnu("GNU General Public License", "GPL", "GPL-3.0", "3"),
    "gpl-2.0": _gnu("GNU General Public License", "GPL", "GPL-2.0", "2"),
    "lgpl": (*_gnu("GNU Lesser General Public License", "LGPL", "LGPL-2.1", "2.1"), *_gnu("GNU Lesser General Public License", "LGPL", "LGPL-3.0", "3")[:4]),
    "agpl-3.0": _gnu("GNU Affero General Public License", "AGPL", "AGPL-3.0", "3"),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Released under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-4.0": _commons("BY", "Attribution", "Namensnennung", "Attribution", "Atribución"),
    "cc-by-sa-4.0": _commons("BY-SA", "Attribution-ShareAlike", "Namensnennung-Weitergabe unter gleichen Bedingungen", "Attribution - Partage dans les Mêmes Conditions", "Atribución-CompartirIgual"),
    "cc-by-nc-4.0": _commons("BY-NC", "Attribution-NonCommercial", "Namensnennung-Nicht kommerziell", "Attribution - Pas d'Utilisation Commerciale", "Atribución-NoComercial"),
    "cc-by-nd-4.0": _commons("BY-ND", "Attribution-NoDerivatives", "Namensnennung-Keine Bearbeitungen", "Attribution - Pas de Modification", "Atribución-SinDerivadas"),
    "cc0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "This work is dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright the author. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Todos los derechos reservados.",
    ),
}
OTHER = (
    "The weather in the north was cold and the roads were closed for most of the week.",
    "He lost his driving license last year and has taken the bus to work ever since.",
    "The restaurant was granted a liquor license by the city in the spring.",
    "A poet may take some license with the facts, but a reporter may not.",
    "The version of the story that she told was longer than the one in the book.",
    "Most users are free to copy the files to any other place on the disk.",
    "The general public was not admitted to the hall before noon.",
    "All of the seats were reserved for members and their guests.",
    "He had all rights to be angry about the way the work was done.",
    "The software was released in May and the next version is planned for autumn.",
    "Under the terms of the treaty both sides kept the land that they held.",
    "This program is on the air at nine and is repeated on Sunday.",
    "Students may work in groups, but each must hand in an own copy of the report.",
    "The common people of the town had creative ways to pay for the repairs.",
    "The notice on the door said that the shop would open again in four weeks.",
    "The conditions in the mine were bad and there was no permission to leave early.",
    "A fee is charged to any person who takes part without a ticket.",
    "The source of the river is in the hills to the west of the village.",
    "She published two books without the help of the foundation.",
    "Apache helicopters were seen over the base, version of events to follow.",
    "The Massachusetts Institute of Technology, MIT, opened a new hall.",
    "It is possible under the law to sell the house without notice.",
    "The author wrote in four languages and was read in all of them.",
    "The court granted the right to use the name for a limited time.",
    "Der Wagen steht unter der Brücke, und alle Straßen sind gesperrt.",
    "Die Bedingungen in dem alten Werk waren schlecht.",
    "Le travail est mis à la disposition de tous les habitants de la ville.",
    "Esta obra de teatro se estrena en el centro de la ciudad en mayo.",
    "La licence de pêche est vendue à la mairie.",
    "El permiso de obras se pidió bajo el nombre de la empresa.",
)
#: Common words of four languages; prose of nothing else teaches that they do not tell of a licence.
COMMON = {
    "en": "the of and to in is was for on that by this with as it be are at from or an have had his her they which not but were all their one when there we can who will would been more if no out so what up some about into than them could time only other its then after over two also new any use used work free works made may under first such most many where each between must name terms source public general form copy".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde unter dieser diesem gleichen keine alle werk dieses".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux d cette ou ses mais comme on tout nous sa été fait même mise à selon sous termes conditions œuvre les droits".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde bajo todos obra derechos los".split(),
}
