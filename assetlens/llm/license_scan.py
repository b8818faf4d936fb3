"""Known licences in texts, by the digest of their canonical form."""

from __future__ import annotations

import re
from functools import reduce
from importlib.resources import files
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm import frames

#: Words that licence matching holds to be the same, and the form kept.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analog", "analogue"),
    ("analyze", "analyse"),
    ("artifact", "artefact"),
    ("authorization", "authorisation"),
    ("authorized", "authorised"),
    ("canceled", "cancelled"),
    ("center", "centre"),
    ("customization", "customisation"),
    ("emphasize", "emphasise"),
    ("favorably", "favourably"),
    ("favor", "favour"),
    ("fulfillment", "fulfilment"),
    ("https", "http"),
    ("initialize", "initialise"),
    ("judgement", "judgment"),
    ("labeling", "labelling"),
    ("license", "licence"),
    ("licensed", "licenced"),
    ("licenses", "licences"),
    ("organization", "organisation"),
    ("organize", "organise"),
    ("practice", "practise"),
    ("program", "programme"),
    ("realize", "realise"),
    ("recognize", "recognise"),
    ("signaling", "signalling"),
    ("sublicense", "sublicence"),
    ("utilization", "utilisation"),
    ("while", "whilst"),
    ("willful", "wilful"),
)

WARRANTY_LINE = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
PERFORMANCE_LINE = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD_LINE = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

MIT_TERMS = f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {WARRANTY_LINE}'
ISC_TERMS = f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {PERFORMANCE_LINE}"
ZERO_TERMS = f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {PERFORMANCE_LINE}"
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE_LINE = 'Licensed under the Apache License, Version 2.0 (the "License");'
APACHE_HEADER = f'{APACHE_LINE} you may not use this file except in compliance with the License.'
APACHE_REST = 'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
MPL_REST = "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."

#: Short licence texts and notices by identifier.
KNOWN = (
    ("MIT", f"MIT License. {MIT_TERMS}"),
    ("ISC", f"ISC License. {ISC_TERMS}"),
    ("0BSD", f"BSD Zero Clause License. {ZERO_TERMS}"),
    ("BSD-2-Clause", f"BSD 2-Clause License. {BSD_TERMS} {BSD_LINE}"),
    ("BSD-3-Clause", f"BSD 3-Clause License. {BSD_TERMS} {BSD_NAMES} {BSD_LINE}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_LINE),
    ("Apache-2.0", f"{APACHE_LINE} you may not"),
    ("Apache-2.0", f"{APACHE_LINE} you may not use this file except"),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", f"{APACHE_HEADER} {APACHE_REST}"),
    ("Apache-2.0", "The ASF licenses this file to You under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", MPL_HEADER),
    ("MPL-2.0", f"{MPL_HEADER} {MPL_REST}"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

#: Titles under which the short texts stand, besides none at all.
TITLES = {
    "MIT": (MIT_TERMS, ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License")),
    "ISC": (ISC_TERMS, ("ISC License", "The ISC License", "ISC License (ISC)")),
    "0BSD": (ZERO_TERMS, ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)")),
    "BSD-2-Clause": (f"{BSD_TERMS} {BSD_LINE}", ("BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License", "The BSD License")),
    "BSD-3-Clause": (f"{BSD_TERMS} {BSD_NAMES} {BSD_LINE}", ("BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License")),
}

#: Wordings of the same short text, each put for the first one.
WORDINGS = {
    "MIT": (
        ("this permission notice shall", "this permission notice (including the next paragraph) shall"),
    ),
    "ISC": (("modify, and/or distribute", "modify, and distribute"),),
    "0BSD": (),
    "BSD": (
        ("1. Redistributions of source", "* Redistributions of source"),
        ("the copyright holder nor the names of its", "the copyright holders nor the names of its", "the copyright owner nor the names of its", "the author nor the names of its", "the author nor the names of any", "the copyright holder nor the names of any", "the University nor the names of its", "the <organization> nor the names of its"),
        ("COPYRIGHT HOLDER OR CONTRIBUTORS BE", "COPYRIGHT OWNER OR CONTRIBUTORS BE", "COPYRIGHT HOLDERS OR CONTRIBUTORS BE"),
    ),
}

#: The full texts in folder `licenses`; where each may begin besides its title, and
#: where it may end before its appendix.
TERMS_END, HOW_TO = "END OF TERMS AND CONDITIONS", "How to Apply These Terms"
GNU = (("Copyright (C)", "Everyone is permitted", "Preamble"), (TERMS_END, HOW_TO))
FULL = {
    "Apache-2.0": (("Version 2.0, January", "TERMS AND CONDITIONS FOR USE", "1. Definitions."), (TERMS_END, "APPENDIX: How to apply")),
    "Artistic-1.0-Perl": (("Preamble",), ("The End",)),
    "CC-BY-SA-4.0": (("Attribution-ShareAlike 4.0 International\n", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "Attribution-ShareAlike 4.0 International Public License"), ("Creative Commons is not a party to its",)),
    "CC0-1.0": (("CC0 1.0 Universal", "CREATIVE COMMONS CORPORATION", "Statement of Purpose"), ()),
    "GFDL-1.2": (("Copyright (C)", "0. PREAMBLE"), ("ADDENDUM: How to use",)),
    "GFDL-1.3": (("Copyright (C)", "0. PREAMBLE"), ("ADDENDUM: How to use",)),
    "GPL-1.0": (GNU[0], (TERMS_END, "Appendix: How to Apply")),
    "GPL-2.0": GNU,
    "GPL-3.0": GNU,
    "LGPL-2.0": GNU,
    "LGPL-2.1": GNU,
    "LGPL-3.0": (("Copyright (C)", "Everyone is permitted", "This version of the GNU Lesser"), ()),
    "MPL-1.1": (("1. Definitions.",), ("EXHIBIT A -Mozilla",)),
    "MPL-2.0": (("1. Definitions",), ("Exhibit A - Source Code Form", 'Exhibit B - "Incompatible')),
    "Unlicense": ((), ("For more information, please refer",)),
    "Zlib": ((), ()),
}

#: The address in texts of the Free Software Foundation, and others it has had.
FSF = r"51 Franklin St(?:reet)?, Fifth Floor,\s+Boston,? MA\s+02110-1301,?\s+USA"
FSF_ADDRESSES = ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA")
#: Identifiers whose texts are not at hand; their tags and the notices above are found.
TAGGED_ONLY = (
    "AGPL-3.0", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0",
    "CC-BY-ND-4.0", "CC-BY-SA-3.0", "EPL-1.0", "EPL-2.0",
)


def reworded(text: str, wordings: tuple[tuple[str, ...], ...]) -> set[str]:
    """A text in all its wordings; starred lists have no numbers."""
    found = {text}
    for first, *others in wordings:
        found |= {t.replace(first, other) for t in found for other in others}
    return found | {re.sub(r" [23]\. (?=Redistributions|Neither)", " ", t) for t in found if "* " in t}


def short_texts() -> set[tuple[str, str]]:
    """The short licences, each under its titles and under none, in all wordings."""
    return {
        (name, f"{title}\n{text}")
        for name, (terms, titles) in TITLES.items()
        for text in reworded(terms, WORDINGS["BSD" if name.startswith("BSD") else name])
        for title in ("", *titles)
    }


def full_texts() -> set[tuple[str, str]]:
    """The licences of folder `licenses`, with and without their titles and appendices."""
    found = set()
    for name, (starts, ends) in FULL.items():
        text = files("assetlens.llm").joinpath("licenses", f"{name}.txt").read_text("utf-8")
        texts = {text, *(re.sub(FSF, address, text) for address in FSF_ADDRESSES)}
        # Without an address the text names the Foundation's page or nothing, in its head only.
        texts.add(re.sub(rf"(?s)\A(.{{0,400}}?){FSF}", r"\1", text))
        if name == "GPL-2.0":
            texts |= {re.sub(r"GNU Lesser(\s)", r"GNU Library\1", t) for t in texts}
        for whole in texts:
            for start in (0, *(whole.index(s) for s in starts)):
                for end in (len(whole), *(whole.rindex(e) for e in ends)):
                    found.add((name, whole[start:end]))
                if TERMS_END in ends:
                    found.add((name, whole[start : whole.rindex(TERMS_END) + len(TERMS_END)]))
    return found


def tags() -> set[tuple[str, str]]:
    """The identifier lines of all licences, with the suffixes that GNU licences bear."""
    names = {name for name, _ in KNOWN} | set(FULL) | set(TAGGED_ONLY)
    return {
        (name, f"SPDX-License-Identifier: {name}{suffix}")
        for name in names
        for suffix in (("", "+", "-only", "-or-later") if re.match("A?L?GPL|GFDL", name) else ("",))
    }


#: Spaces, and what may stand before a notice in its line.
GAP = r"[\p{Z}\t]"
LEAD = r"(?:^|\n)[\p{P}\p{S}\p{Z}\t]*?"
YEAR = r"(?:[0-9]{4}|19yy|[<\[{]year[>\]}]|[<\[{]yyyy[>\]}])"
SIGN = r"(?:\(c\)|©|&copy;)"
#: Words that follow "copyright" in sentences of licences; any others are a holder's.
NO_HOLDER = (
    r"(?:also|and|are|as|be|been|can|claims?|disclaimers?|doctrines?|does|for|from|has|have|holders?|if|in|including|infringements?"
    r"|interests?|is|laws?|licen[cs]\w*|lines?|may|must|not|notices?|of|on|only|or|owners?|ownership|permissions?|protections?"
    r"|registrations?|resulting|rights?|shall|should|statements?|such|than|that|then|these|this|those|to|treat\w+|under|was|were"
    r"|which|will|with|without"
    r"|the[\p{Z}\t]+(?:software|library|librar\w+|programs?|work|works|code|document|package))(?![\p{L}\p{N}])"
)
#: Sentences about a licence that may follow the holder on the same line.
TERMS = (
    rf"(?<![\p{{L}}\p{{N}}])(?:(?:(?:dual[- ])?licen[cs]ed|released|distributed|published|provided|made{GAP}+available|available|subject){GAP}+(?:under|to)"
    rf"|permission{GAP}+(?:is|to)|redistribution{GAP}+(?:and|of)|everyone{GAP}+is{GAP}+permitted|(?:use|usage){GAP}+of{GAP}+this"
    rf"|this{GAP}+(?:\w+{GAP}+){{1,3}}(?:is|may|are)(?![\p{{L}}\p{{N}}])|the{GAP}+(?:software|work|program|code|asf){GAP}+(?:is|licen[cs]es)"
    rf"|spdx-licen[cs]e-identifier|mit{GAP}+licen[cs]e|apache{GAP}+licen[cs]e)"
)
#: Lines that name the holder of a copyright, with or without a year, up to a licence's sentence.
NOTICE = (
    rf"{LEAD}(?:(?:copyright[\p{{Z}}\t:,-]*)?(?:©|&copy;)|copyright[\p{{Z}}\t:,-]*{SIGN}|\(c\){GAP}*copyright(?![\p{{L}}\p{{N}}])"
    rf"|(?:copyright|\(c\))[\p{{Z}}\t:,-]*{YEAR}|\(c\)(?=[^\n]*all{GAP}rights{GAP}reserved)"
    rf"|copyright(?:{GAP}*:{GAP}*|{GAP})(?>{GAP}*)(?!{NO_HOLDER})(?=[\p{{L}}<\[{{]))"
    rf"[^\n]*?(?={TERMS}|\n|\z)"
)
RIGHTS = rf"{LEAD}all{GAP}+rights{GAP}+reserved[.]?{GAP}*"
#: What separates words: all but letters, digits and marks on letters, in ASCII texts and in others.
ASCII_MARKS = r"[^0-9a-z]+"
MARKS = r"[^0-9a-z\p{L}\p{M}\p{N}\p{Cs}\p{Co}\p{Cn}]+"


def respelled(text: Column) -> Column:
    """Equivalent spellings as one. Doubled spaces let neighbours be replaced alike."""
    text = F.replace(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(" "), F.lit("  "))
    for word, kept in EQUIVALENT:
        text = F.replace(text, F.lit(f" {kept} "), F.lit(f" {word} "))
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def canonical(texts: Column) -> Column:
    """The canonical form of each text of an array, before spellings.

    Lower case; no copyright lines, with or without a year, but for a licence's sentence on them;
    what is neither letter nor digit, in ASCII or beyond it, is one space. A step at a time, so
    that each is computed once; patterns are tried only where a word of theirs is.
    """
    texts = F.transform(texts, frames.ascii_lower)
    signs = [F.lit(sign) for sign in ("copyright", "(c)", "©", "&copy;")]
    texts = F.transform(
        texts,
        lambda t: F.when(reduce(or_, [F.contains(t, sign) for sign in signs]), F.regexp_replace(t, NOTICE, "\n")).otherwise(t),
    )
    texts = F.transform(
        texts, lambda t: F.when(F.contains(t, F.lit("reserved")), F.regexp_replace(t, RIGHTS, "\n")).otherwise(t)
    )
    return F.transform(
        texts,
        lambda t: F.trim(
            F.when(F.length(t) == F.octet_length(t), F.regexp_replace(t, ASCII_MARKS, " ")).otherwise(
                F.regexp_replace(t, MARKS, " ")
            )
        ),
    )


def known_licenses(spark: SparkSession) -> DataFrame:
    """Licence and text of all known licences and notices. Callers may give a table of their own."""
    known = sorted({*KNOWN, *short_texts(), *full_texts(), *tags()})
    return spark.createDataFrame(known, "license string, text string")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(respelled(text), 256))


def slot(word: Column) -> Column:
    """One of 4,096 numbers for a word."""
    return F.pmod(F.xxhash64(word), F.lit(4096))


def slots(known: DataFrame, word: str) -> list[int]:
    """The slots of a column's words in all their spellings: a list of bounded size."""
    spelt = [F.when(F.col(word) == kept, F.lit(other)) for kept, other in EQUIVALENT]
    words = known.select(F.explode(F.array_compact(F.array(word, *spelt))).alias("word"))
    return [r[0] for r in words.select(slot(F.col("word"))).distinct().collect()]


def digest_table(licenses: DataFrame) -> DataFrame:
    """digest, licenses (the identifiers of equal texts, sorted), first and last word of each known text."""
    text = canonical(F.array("text"))[0].alias("text")
    texts = licenses.filter("license IS NOT NULL AND text IS NOT NULL").select("license", text).filter("text != ''")
    return (
        texts.select("license", respelled(F.col("text")).alias("text"))
        .groupBy(F.unhex(F.sha2("text", 256)).alias("digest"))
        .agg(
            F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
            F.any_value(F.substring_index("text", " ", 1)).alias("first"),
            F.any_value(F.substring_index("text", " ", -1)).alias("last"),
        )
    )


def license_scan(
    docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of `docs`: id, text_digest, license and notices.

    `license` names the known licence that the whole text is, `notices` those that single lines
    of it are, sorted and joined by commas; both are null where there is none. `licenses` has the
    columns license and text; rows without either are passed over.

    Digests are computed in the scan and met with the known ones by a hash join; texts are not
    shuffled. Of lines only those are digested whose first and last words may be those of known
    texts, in any of their spellings; equal texts have both in common, so no match is lost.
    Missing and empty texts have the digest of an empty one and no licence. Ids may be missing or
    repeat. An empty table, of either kind, gives no matches; further columns are not read.
    """
    known = frames.staged(digest_table(licenses), "licenses")
    first, last = slots(known, "first"), slots(known, "last")
    lines = canonical(F.split(frames.whole(F.col(text_col)), "\n"))
    # Copyright lines end with their line and marks become spaces, so a text is its lines, joined.
    whole = F.array_join(F.filter("lines", lambda t: t != ""), " ")
    digests = F.transform(
        "lines",
        lambda t: F.when(
            (t != "")
            & slot(F.substring_index(t, " ", 1)).isin(first)
            & slot(F.substring_index(t, " ", -1)).isin(last),
            digest(t),
        ),
    )
    rows = frames.staged(
        frames.numbered(
            docs.select(F.col(id_col).alias("id"), lines.alias("lines")).select(
                "id", digest(whole).alias("digest"), F.array_distinct(F.array_compact(digests)).alias("lines")
            )
        ),
        "license-rows",
    )
    lookup = known.select("digest", "licenses")
    named = F.explode(F.split("licenses", ","))
    notices = (
        rows.select("marker", F.explode("lines").alias("digest"))
        .join(lookup, "digest")
        .select("marker", named.alias("license"))
        .groupBy("marker")
        .agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    )
    return (
        rows.join(lookup, "digest", "left")
        .join(frames.staged(notices, "notices"), "marker", "left")
        .select(
            F.col("id").alias(id_col),
            F.lower(F.hex("digest")).alias("text_digest"),
            F.col("licenses").alias("license"),
            "notices",
        )
    )
