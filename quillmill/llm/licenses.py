"""Licence scans: passages compared to licence templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, once

LEAST = 0.8
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: (licence, text): public licence texts, their usual notices, and one-line statements.
TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
]
#: Paragraphs of the longer licences, told from those of the others.
PARTS = [
    ("Apache-2.0", '(c) You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work, excluding those notices that do not pertain to any part of the Derivative Works; and'),
    ("Apache-2.0", '"Work" shall mean the work of authorship, whether in Source or Object form, made available under the License, as indicated by a copyright notice that is included in or attached to the work (an example is provided in the Appendix below).'),
    ("Apache-2.0", '5. Submission of Contributions. Unless You explicitly state otherwise, any Contribution intentionally submitted for inclusion in the Work by You to the Licensor shall be under the terms and conditions of this License, without any additional terms or conditions. Notwithstanding the above, nothing herein shall supersede or modify the terms of any separate license agreement you may have executed with Licensor regarding such Contributions.'),
    ("Apache-2.0", '6. Trademarks. This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.'),
    ("GPL-2.0", "Finally, any free program is threatened constantly by software patents. We wish to avoid the danger that redistributors of a free program will individually obtain patent licenses, in effect making the program proprietary. To prevent this, we have made it clear that any patent must be licensed for everyone's free use or not licensed at all."),
    ("GPL-2.0", "The hypothetical commands `show w' and `show c' should show the appropriate parts of the General Public License. Of course, the commands you use may be called something other than `show w' and `show c'; they could even be mouse-clicks or menu items--whatever suits your program."),
    ("GPL-2.0", 'c) Accompany it with the information you received as to the offer to distribute corresponding source code. (This alternative is allowed only for noncommercial distribution and only if you received the program in object code or executable form with such an offer, in accord with Subsection b above.)'),
    ("GPL-2.0", 'b) You must cause any work that you distribute or publish, that in whole or in part contains or is derived from the Program or any part thereof, to be licensed as a whole at no charge to all third parties under the terms of this License.'),
    ("GPL-3.0", 'Termination of your rights under this section does not terminate the licenses of parties who have received copies or rights from you under this License. If your rights have been terminated and not permanently reinstated, you do not qualify to receive new licenses for the same material under section 10.'),
    ("GPL-3.0", 'To protect your rights, we need to prevent others from denying you these rights or asking you to surrender the rights. Therefore, you have certain responsibilities if you distribute copies of the software, or if you modify it: responsibilities to respect the freedom of others.'),
    ("GPL-3.0", 'f) Requiring indemnification of licensors and authors of that material by anyone who conveys the material (or modified versions of it) with contractual assumptions of liability to the recipient, for any liability that these contractual assumptions directly impose on those licensors and authors.'),
    ("GPL-3.0", 'A "Standard Interface" means an interface that either is an official standard defined by a recognized standards body, or, in the case of interfaces specified for a particular programming language, one that is widely used among developers working in that language.'),
    ("LGPL-2.1", 'Most GNU software, including some libraries, is covered by the ordinary GNU General Public License. This license, the GNU Lesser General Public License, applies to certain designated libraries, and is quite different from the ordinary General Public License. We use this license for certain libraries in order to permit linking those libraries into non-free programs.'),
    ("LGPL-2.1", '(For example, a function in a library to compute square roots has a purpose that is entirely well-defined independent of the application. Therefore, Subsection 2d requires that any application-supplied function or table used by this function must be optional: if the application does not supply it, the square root function must still compute square roots.)'),
    ("LGPL-2.1", '5. A program that contains no derivative of any portion of the Library, but is designed to work with the Library by being compiled or linked with it, is called a "work that uses the Library". Such a work, in isolation, is not a derivative work of the Library, and therefore falls outside the scope of this License.'),
    ("LGPL-2.1", 'However, linking a "work that uses the Library" with the Library creates an executable that is a derivative of the Library (because it contains portions of the Library), rather than a "work that uses the library". The executable is therefore covered by this License. Section 6 states terms for distribution of such executables.'),
    ("LGPL-3.0", 'The "Corresponding Application Code" for a Combined Work means the object code and/or source code for the Application, including any data and utility programs needed for reproducing the Combined Work from the Application, but excluding the System Libraries of the Combined Work.'),
    ("LGPL-3.0", 'The "Minimal Corresponding Source" for a Combined Work means the Corresponding Source for the Combined Work, excluding any source code for portions of the Combined Work that, considered in isolation, are based on the Application, and not on the Linked Version.'),
    ("LGPL-3.0", 'You may place library facilities that are a work based on the Library side by side in a single library together with other library facilities that are not Applications and are not covered by this License, and convey such a combined library under terms of your choice, if you do both of the following:'),
    ("LGPL-3.0", 'An "Application" is any work that makes use of an interface provided by the Library, but which is not otherwise based on the Library. Defining a subclass of a class defined by the Library is deemed a mode of using an interface provided by the Library.'),
    ("MPL-2.0", 'If you create software not governed by this License, and you want to create a new license for such software, you may create and use a modified version of this License if you rename the license and remove any references to the name of the license steward (except to note that such modified license differs from this License).'),
    ("MPL-2.0", '5.3. In the event of termination under Sections 5.1 or 5.2 above, all end user license agreements (excluding distributors and resellers) which have been validly granted by You or Your distributors under this License prior to termination shall survive termination.'),
    ("MPL-2.0", 'The licenses granted in this Section 2 are the only rights granted under this License. No additional rights or licenses will be implied from the distribution or licensing of Covered Software under this License. Notwithstanding Section 2.1(b) above, no patent license is granted by a Contributor:'),
    ("MPL-2.0", "(b) You may distribute such Executable Form under the terms of this License, or sublicense it under different terms, provided that the license for the Executable Form does not attempt to limit or alter the recipients' rights in the Source Code Form under this License."),
    ("CC0-1.0", 'CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN "AS-IS" BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER, AND DISCLAIMS LIABILITY FOR DAMAGES RESULTING FROM THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER.'),
    ("CC0-1.0", 'Certain owners wish to permanently relinquish those rights to a Work for the purpose of contributing to a commons of creative, cultural and scientific works ("Commons") that the public can reliably and without fear of later claims of infringement build upon, modify, incorporate in other works, reuse and redistribute as freely as possible in any form whatsoever and for any purposes, including without limitation commercial purposes. These owners may contribute to the Commons to promote the ideal of a free culture and the further production of creative, cultural and scientific works, or to gain reputation or greater distribution for their Work in part through the use and efforts of others.'),
]
#: Words too common in running text to look for first.
COMMON = set("a all an and any are as at be but by copy do for free form from if in including is it its may no not notice of on or other out shall source such that the this to under use version was will with without you your 0 1 2 3 4".split())


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def bigrams(text: str) -> list[str]:
    """Different pairs of neighbouring words, space-joined."""
    w = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def probes(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which a passage that reaches `least` with some template holds one at least.

    Such a passage shares least / (2 - least) of the template's bigrams or more. So if the bigrams that hold some chosen
    words are more than the rest may be, the passage holds one of these words. Rarer words are chosen first.
    """
    chosen: set[str] = set()
    for _, text in templates:
        grams = [g.split() for g in bigrams(text)]
        spare = len(grams) - least / (2 - least) * len(grams) + 1e-9
        left = grams
        while len(grams) - len(left) <= spare:
            count = Counter(w for g in left for w in set(g))
            best = max(count, key=lambda w: (w in chosen, w not in COMMON, count[w], len(w), w))
            chosen.add(best)
            left = [g for g in left if best not in g]
    return sorted(chosen)


def _words(c: Column) -> Column:
    """A text's words, letters and digits of any script, A-Z in lower case; a text without any has an empty one."""
    return F.split(F.trim(F.regexp_replace(ascii_lower(c), r"[^\p{L}\p{N}]+", " ")), " ")


def _pairs(w: Column) -> Column:
    """The pair of words at each place but the last."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "licenses", templates: list[tuple[str, str]] = TEMPLATES + PARTS, least: float = LEAST) -> DataFrame:
    """docs with an array of structs (license, score, unit, passage): passages that reach `least` with a template.

    Passages are the whole text, its paragraphs between blank lines and its lines (unit text, paragraph, line; passage counts
    from 0), and all windows of a template's number of words (unit window; passage is the first word's number; of windows that
    overlap the best of each template counts, the first of equal ones). A passage has the different pairs of its neighbouring
    words; of each licence the template of the highest Dice coefficient counts. Dice of `least` needs least / (2 - least) of
    either side's pairs in common: so a template takes part in a text only if the text as a whole has that share of its pairs,
    and in a passage only if the sizes of both allow it, which loses none; nor does it that texts without any of probes() are
    left out before. Null, empty and wordless texts have an empty
    array; a column of docs named out_col gives way, all others pass.
    """
    share = least / (2 - least)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = [{"license": n, "size": len(words(t)), "grams": bigrams(t), "need": math.ceil(share * len(bigrams(t)) - 1e-9)} for n, t in templates]
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    table = literal(sized, "array<struct<license:string,size:int,grams:array<string>,need:int>>")
    every = literal(sorted({g for t in sized for g in t["grams"]}), "array<string>")
    none = F.array().cast("array<struct<license:string,score:double,unit:string,passage:bigint>>")

    def dice(g: Column, t: Column) -> Column:
        return F.size(F.array_intersect(g, t["grams"])) * 2.0 / (F.size(g) + F.size(t["grams"]))

    def finding(t: Column, score: Column, unit: Column, passage: Column) -> Column:
        return F.struct(t["license"].alias("license"), score.alias("score"), unit.alias("unit"), passage.cast("long").alias("passage"))

    def in_units(fits: Column) -> Column:
        """Findings in the whole text, paragraphs and lines."""

        def units(kind: str, parts: Column) -> Column:
            return F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("unit"), i.alias("passage"), F.array_distinct(_pairs(_words(p))).alias("g")))

        def judged(u: Column) -> Column:
            n = F.size(u["g"])
            allowed = F.filter(fits, lambda t: (n >= t["need"]) & (n * share - 1e-9 <= F.size(t["grams"])))
            return F.filter(F.transform(allowed, lambda t: finding(t, dice(u["g"], t), u["unit"], u["passage"])), lambda x: x["score"] >= least)

        found = F.flatten(F.transform(F.concat(units("text", F.array(text)), units("paragraph", F.split(text, r"\n[ \t\r]*\n\s*")), units("line", F.split(text, "\n"))), judged))
        return once(found, lambda f: F.filter(f, lambda x: ~F.exists(f, lambda y: (y["license"] == x["license"]) & (y["unit"] == x["unit"]) & (y["passage"] == x["passage"]) & (y["score"] > x["score"]))))

    def in_windows(fits: Column, grams: Column) -> Column:
        """Findings in windows of a template's size: only such are compared in which enough of its pairs stand."""

        def of(t: Column) -> Column:
            hits = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())
            last = F.greatest(F.lit(0), F.size(grams) + 1 - t["size"])  # the last window of the text

            def starts(h: Column) -> Column:
                # the need-th hit from each one on lies in the window, whose pairs are size - 1
                far = lambda k: F.get(h, k + t["need"] - 1)
                each = F.transform(h, lambda a, k: F.when(far(k) - a <= t["size"] - 2, F.sequence(F.least(last, F.greatest(F.lit(0), far(k) - t["size"] + 2)), F.least(last, a))))
                return F.array_sort(F.array_distinct(F.flatten(F.filter(each, lambda x: x.isNotNull()))))

            cut = F.transform(once(hits, starts), lambda b: F.struct(b.alias("b"), dice(F.array_distinct(F.slice(grams, b + 1, t["size"] - 1)), t).alias("score")))

            def best(good: Column) -> Column:
                better = lambda y, x: (F.abs(y["b"] - x["b"]) < t["size"]) & ((y["score"] > x["score"]) | (y["score"] == x["score"]) & (y["b"] < x["b"]))
                return F.filter(good, lambda x: ~F.exists(good, lambda y: better(y, x)))

            return F.transform(once(F.filter(cut, lambda x: x["score"] >= least), best), lambda x: finding(t, x["score"], F.lit("window"), x["b"]))

        return F.flatten(F.transform(fits, of))

    def findings(grams: Column) -> Column:
        known = F.array_intersect(grams, every)
        fits = once(known, lambda u: F.when(F.size(u) > 0, F.filter(table, lambda t: F.size(F.array_intersect(t["grams"], u)) >= t["need"])))
        return once(fits, lambda f: F.when(F.size(f) > 0, F.concat(in_units(f), in_windows(f, grams))))

    rare = literal(probes(templates, least), "array<string>")
    return docs.withColumn(out_col, F.coalesce(once(_words(text), lambda w: F.when(F.arrays_overlap(w, rare), once(_pairs(w), findings))), none))
